"""Operator 5: SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position the
pieces that end there come by its output links, and the Viterbi table relaxes the best way
to reach the position. Two rules of relaxation share the automaton and the table:

* `unigram`: a way is better if the sum of its pieces' scores is larger. This is the dealt method, and what a unigram
  model means. `best_*` of `op5_sentencepiece` are its results over the scores of the public file.
* `bpe`: the public file is a BPE model, whose own pieces are not those of the largest sum. There a piece may follow the
  best way to its start only if the two pieces, joined and merged by rank, come out as those two. Exactly one piece
  passes at each position, and its way is what merging the whole prefix gives; the ids are the library's own.

Texts are cut where no piece can reach across (before a blank after another character, and
at line feeds), and what was encoded once is remembered by its worker process, up to CACHE_BYTES and for chunks of at
most LONG_CHUNK characters. Characters without a piece become byte pieces. Decoding joins the pieces.

Defined cases: a null text gives null ids, an empty text none; invalid UTF-8 counts as U+FFFD; long texts and texts
that are one long word are encoded whole; rows stay rows, repeats included; an empty table gives none. Columns
passed on may have any names; those named like the new ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import long_field, map_texts, read_table, tokenizer_path

#: What a worker process remembers: bytes of chunks and of judged pairs (counted as 200 bytes each), and the longest chunk kept.
CACHE_BYTES = 192 << 20
LONG_CHUNK = 64
_BLANK = "▁"
#: Numbers beside those of the pieces: the start of a chunk, and characters without a piece.
START, ALONE = (1 << 21) - 1, 1 << 20


class _Cache(dict):
    """Chunks to the bytes of their ids."""

    def __init__(self, ids: Callable[[str], bytes]):
        self.ids, self.held = ids, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.ids(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
            self.held += 200 + 2 * len(chunk) + (len(ids) if isinstance(ids, bytes) else 100 + len(ids[0]) + len(ids[1]))
        return ids

    def trim(self) -> None:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


class PieceModel:
    """Pieces with their scores: `encode` and `decode`.

    `kind` is `unigram` or `bpe`; `byte_ids` are the ids of the 256 byte pieces.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], kind: str):
        self.pieces, self.byte_ids, self.bpe = pieces, byte_ids, kind == "bpe"
        self.text_of = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        if any(re.search(f"[^{_BLANK}]{_BLANK}|\n", p) for p in pieces):
            raise ValueError("pieces reach across blanks or line feeds")
        self.names = {i: p for p, (i, _) in pieces.items()}
        self.sizes = {i: len(p) for i, p in self.names.items()}
        self.alone: dict[str, int] = {}  # characters without a piece, numbered from ALONE
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in pieces.items():
            self.automaton.add_word(p, (len(p), i, score))
        self.automaton.make_automaton()
        self.scores = np.full(max([*self.text_of, 0]) + 1, min((s for _, s in pieces.values()), default=0.0) - 10.0)
        for i, score in pieces.values():
            self.scores[i] = score
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.cache, self.pairs = _Cache(self._ids), _Cache(self._both)
        self.singles = {p for p in pieces if len(p) == 1}
        self.table = [self.text_of.get(i, b"") for i in range(max([*self.text_of, 0]) + 1)]
        self.fits: dict[int, bool] = {}

    def _merge(self, text: str) -> list[str]:
        """Merging by rank, the plain way: the best pair first, the leftmost of equals. The text is two pieces at most."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(-self.pieces[a + b][1], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces]
            if not ranked:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _learn(self, before: int, piece: int) -> bool:
        """Whether merging leaves these two neighbours as they are; with START before, the piece."""
        if len(self.fits) * 200 > CACHE_BYTES:
            self.fits.clear()
        parts = [self.names[i] for i in (before, piece) if i != START]
        known = self.fits[before << 21 | piece] = self._merge("".join(parts)) == parts
        return known

    def _single(self, char: str) -> int:
        """The number of a character that no piece ends with here."""
        if char in self.pieces:
            return self.pieces[char][0]
        if char not in self.alone:
            number = self.alone[char] = ALONE + len(self.alone)
            self.names[number], self.sizes[number] = char, 1
            self.text_of[number] = char.encode()
        return self.alone[char]

    def best(self, chunk: str) -> list[int]:
        """The numbers of a chunk's pieces, by one pass of the automaton with a Viterbi table."""
        return self._pieces(chunk, self._best_bpe(chunk) if self.bpe else self._best_unigram(chunk))

    def _pieces(self, chunk: str, best: list[int]) -> list[int]:
        """The numbers on the best way, from the table."""
        out, at = [], len(chunk)
        while at:
            if (piece := best[at]) < 0:
                piece = self._single(chunk[at - 1])
            out.append(piece)
            at -= self.sizes[piece]
        return out[::-1]

    def score(self, ids: bytes) -> float:
        """The sum of the scores of a text's pieces; a byte piece counts as what has no piece."""
        return float(self.scores[np.frombuffer(ids, "<i4")].sum())

    def _best_bpe(self, chunk: str) -> list[int]:
        best = [-1] * (len(chunk) + 1)
        best[0] = START
        fits = self.fits.get
        for end, (size, piece, _) in self.automaton.iter(chunk):
            if best[end + 1] >= 0:
                continue
            start = end + 1 - size
            before = best[start]
            if before < 0:  # the table has passed this place: a character by itself
                before = best[start] = self._single(chunk[start - 1])
            known = fits(before << 21 | piece)
            if self._learn(before, piece) if known is None else known:
                best[end + 1] = piece
        return best

    def _best_unigram(self, chunk: str) -> list[int]:
        n = len(chunk)
        best, total = [-1] * (n + 1), [float("-inf")] * (n + 1)
        best[0], total[0], passed = START, 0.0, 0
        for end, (size, piece, score) in [*self.automaton.iter(chunk), (n, (0, -1, 0.0))]:
            while passed < end:  # one character more is known to have no better way
                passed += 1
                if total[passed - 1] + self.unknown > total[passed]:
                    best[passed], total[passed] = self._single(chunk[passed - 1]), total[passed - 1] + self.unknown
            if size and total[end + 1 - size] + score > total[end + 1]:
                best[end + 1], total[end + 1] = piece, total[end + 1 - size] + score
        return best

    def _ids(self, chunk: str) -> bytes:
        chunk = chunk.replace(" ", _BLANK)
        return self._as_ids(chunk, self._best_bpe(chunk) if self.bpe else self._best_unigram(chunk))

    def _as_ids(self, chunk: str, best: list[int]) -> bytes:
        ids = array("i")
        for piece in self._pieces(chunk, best):
            if piece < ALONE:
                ids.append(piece)
            else:
                ids.extend(self.byte_ids[b] for b in self.text_of[piece])
        return ids.tobytes()

    def _both(self, chunk: str) -> tuple[bytes, bytes]:
        """The ids of a chunk by both rules, BPE's and the largest sum of scores, from one pass of the automaton."""
        chunk = chunk.replace(" ", _BLANK)
        if not self.singles.issuperset(chunk):  # characters without a piece are relaxed by themselves
            return self._as_ids(chunk, self._best_bpe(chunk)), self._as_ids(chunk, self._best_unigram(chunk))
        n = len(chunk) + 1
        bpe, best, total = [-1] * n, [-1] * n, [float("-inf")] * n
        bpe[0], total[0] = START, 0.0
        fits = self.fits.get
        for end, (size, piece, score) in self.automaton.iter(chunk):
            at = end + 1
            start = at - size
            score += total[start]
            if score > total[at]:
                total[at], best[at] = score, piece
            if bpe[at] < 0:
                before = bpe[start]
                known = fits(before << 21 | piece)
                if self._learn(before, piece) if known is None else known:
                    bpe[at] = piece
        return self._back(bpe), self._back(best)

    def _back(self, best: list[int]) -> bytes:
        """The ids of a full table, from its end."""
        out, at, sizes = [], len(best) - 1, self.sizes
        while at:
            piece = best[at]
            out.append(piece)
            at -= sizes[piece]
        return array("i", out[::-1]).tobytes()

    def encode_both(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text by BPE's rule and by the largest sum of scores."""
        if not text:
            return b"", b""
        self.pairs.trim()
        found = list(map(self.pairs.__getitem__, _CHUNKS.findall(" " + text.replace(_BLANK, " "))))
        return b"".join([x for x, _ in found]), b"".join([y for _, y in found])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        self.cache.trim()
        return b"".join(map(self.cache.__getitem__, _CHUNKS.findall(" " + text.replace(_BLANK, " "))))

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank put before every text goes."""
        text = b"".join(map(self.table.__getitem__, array("i", ids))).decode("utf-8", "replace").replace(_BLANK, " ")
        return text[1:] if text[:1] == " " else text


_CHUNKS = re.compile(r" *[^ \n]+| +|\n")
_models: dict[tuple[str, str], PieceModel] = {}


def load_model(path: str, kind: str = "bpe") -> PieceModel:
    """The model of a file, once for each worker process. The file's library only reads the vocabulary."""
    if (path, kind) not in _models:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(file.vocab_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or file.is_byte(i))]
        pieces = {file.id_to_piece(i): (i, file.get_score(i)) for i in plain}
        _models[path, kind] = PieceModel(pieces, [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)], kind)
    return _models[path, kind]


def encode_texts(docs: DataFrame, model_path: str, kind: str = "bpe", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with n_ids, ids_crc32, same (decoding gives the text again) and ids; these replace columns so named."""
    keep = tuple(c for c in keep if c not in ("n_ids", "ids_crc32", "same", "ids"))

    def start():
        model = load_model(model_path, kind)

        def work(texts: list, rows: pa.RecordBatch) -> dict:
            out: dict = {c: [] for c in ("n_ids", "ids_crc32", "same")}
            data, offsets = [], [0]
            for raw in texts:
                text = "" if raw is None else raw.decode("utf-8", "replace")
                ids = model.encode(text)
                data.append(ids)
                offsets.append(offsets[-1] + len(ids) // 4)
                out["n_ids"].append(len(ids) // 4)
                out["ids_crc32"].append(zlib.crc32(ids))
                out["same"].append(model.decode(ids) == text)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(data))])
            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([t is None for t in texts], pa.bool_())).cast(pa.list_(pa.int32()))
            return out

        return work

    schema = T.StructType([*(docs.schema[c] for c in keep), long_field("n_ids"), long_field("ids_crc32"), T.StructField("same", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_texts(docs, start, schema, keep)


def decode_ids(rows: DataFrame, model_path: str, kind: str = "bpe", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with text, from a column `ids`."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches):
        model = load_model(model_path, kind)
        for batch in batches:
            texts = [None if ids is None else model.decode(array("i", ids).tobytes()) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select("ids", *keep).mapInArrow(run, schema)


def best_scores(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with, for the model's own pieces, n_ids, ids_crc32, same and ids_score, and for those of the
    largest sum of scores best_n, best_crc32, best_same and best_score. Both come from one pass over the texts."""
    names = ("n_ids", "ids_crc32", "same", "ids_score", "best_n", "best_crc32", "best_same", "best_score")
    kinds = (T.LongType(), T.LongType(), T.BooleanType(), T.DoubleType())
    keep = tuple(c for c in keep if c not in names)

    def start():
        model = load_model(model_path)

        def work(texts: list, rows: pa.RecordBatch) -> dict:
            out: dict = {c: [] for c in names}
            for raw in texts:
                text = "" if raw is None else raw.decode("utf-8", "replace")
                found = []
                for ids in model.encode_both(text):
                    found += [len(ids) // 4, zlib.crc32(ids), model.decode(ids) == text, model.score(ids)]
                for name, value in zip(names, found):
                    out[name].append(value)
            return out

        return work

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, kinds[i % 4]) for i, c in enumerate(names))])
    return map_texts(docs, start, schema, keep)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_scores(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
