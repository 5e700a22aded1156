"""Operator 4: token ids as seekable Zstandard files.

A file is a sequence of independent Zstandard frames of little-endian unsigned 32-bit
ids, a skippable frame with the document index, and at the end a seek table (again a
skippable frame) with the compressed size, the size and the checksum of every frame, in
the public seekable format. A reader fetches the tail, then decompresses only the frames
of the documents that it wants, and verifies each against its checksum (the low 32
bits of XXH64).

Documents are dealt out by ranges of doc_id (and hash of the text, so that rows of one doc_id can lie in several
files) and written in ascending order, one file per partition; there are as many partitions as
files of FILE_BYTES of text need. Every attempt of a task writes a file of its own name and the rows that come back, one per
file, tell which ones count; `write_index` writes them beside the files and removes what failed attempts left.

Encoding is cached by pre-token: no merge of the vocabulary crosses one, so the ids of a text
are those of its pieces in order (see `PieceEncoder`). Whether the tokenizer's own normaliser and pre-tokeniser are the
ones that this rests on is looked up in its file; if not, every text is encoded whole.

Defined cases: a null text is empty and gives the end id alone; null doc_ids come first;
repeated rows are written as often as they come; texts of any length are encoded whole; an empty table gives no files. Columns
beside doc_id and text are left out.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_field, one_thread, read_table, scratch_path, text_column, tokenizer_path
from pyspark.sql import types as T

END_ID = 1
FRAME_BYTES = 1 << 20
#: Bytes of text in a file, about.
FILE_BYTES = 128 << 20
#: Bytes of pieces that a worker process remembers, and the longest piece kept.
CACHE_BYTES = 256 << 20
LONG_PIECE = 64
# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1


# What \p{L}, \p{N} and \s are below U+0250.
_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BLANKS = "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
#: Texts with these are left to the library whole: other scripts, a letter whose lower case is two, special tokens.
_OTHER = re.compile(r"[^\x00-\u024f]|\u0130|<\|")
# The normaliser and pre-tokeniser for which the pattern above holds.
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def known_pieces(tokenizer) -> bool:
    """Whether a tokenizer cuts texts into the pieces of the pattern above and marks their last tokens."""
    own = json.loads(tokenizer.to_str())
    normaliser, cuts, model = own["normalizer"] or {}, (own["pre_tokenizer"] or {}).get("pretokenizers", []), own["model"]
    if normaliser.get("normalizers") != _NORMALISERS or len(cuts) != 2 or model.get("dropout") or model.get("end_of_word_suffix") != "</w>":
        return False
    split, bytes_ = cuts
    return (
        (split["type"], split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": _SPLIT}, "Removed", True)
        and (bytes_["type"], bytes_.get("add_prefix_space"), bytes_.get("use_regex")) == ("ByteLevel", False, False)
    )


class PieceEncoder:
    """Text to the bytes of its ids, with a bounded cache of pre-token pieces.

    Below U+0250 the vocabulary's normaliser only lowers case and its pre-tokeniser is the pattern
    above, so a text's ids are those of its pieces in order. New pieces are encoded together, with
    blanks between; every piece ends with a token that ends a word. Other texts are encoded whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end = struct.pack("<I", end_id)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.by_piece = known_pieces(self.tokenizer)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(cuts) != len(part):
                self.cache.update((piece, self._whole(piece)) for piece in part)
                continue
            data = ids.tobytes()
            self.cache.update(zip(part, (data[a:b] for a, b in zip([0, *cuts], cuts))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t and (not self.by_piece or _OTHER.search(t)) else _PIECES.findall(t.lower()) if t else [] for t in texts]
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        cache = self.cache
        new = [p for p in {p for pieces in split if pieces for p in pieces} if p not in cache]
        self._learn(new)
        get = cache.__getitem__
        out = [(self._whole(t) if pieces is None else b"".join(map(get, pieces))) + self.end for t, pieces in zip(texts, split)]
        for piece in new:
            if len(piece) > LONG_PIECE:
                del cache[piece]
            else:
                self.held += 200 + len(piece) + len(cache[piece])
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, end_id: int) -> PieceEncoder:
    """The encoder of this worker process: its cache serves task after task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


class FrameWriter:
    """One file: `add` documents in order, then `close`."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            packed = self.packer.compress(data)
            self.out.write(packed)
            self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        ids = np.array([d if d is not None else 0 for d, _ in self.docs], dtype="<i8").tobytes()
        null = np.array([d is None for d, _ in self.docs], dtype=np.uint8).tobytes()
        sizes = np.array([n for _, n in self.docs], dtype="<u8").tobytes()
        index = self.packer.compress(struct.pack("<Q", len(self.docs)) + ids + null + sizes)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        seek = b"".join(struct.pack("<III", *entry) for entry in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek)) + seek)


class FrameReader:
    """Reads documents of a file by their number, decompressing only their frames."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = [struct.unpack("<III", x) for x in _cut(self._at(end - 9 - 12 * count, 12 * count), 12)]
        self.places = np.concatenate(([0], np.cumsum([c for c, _, _ in self.table])))
        self.starts = np.concatenate(([0], np.cumsum([d for _, d, _ in self.table])))
        packed = self._at(int(self.places[-2]), self.table[-1][0])[8:]
        if xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF != self.table[-1][2]:
            raise ValueError("the document index is damaged")
        index = zstandard.ZstdDecompressor().decompress(packed)
        (n,) = struct.unpack_from("<Q", index)
        ids = np.frombuffer(index, "<i8", n, 8)
        null = np.frombuffer(index, np.uint8, n, 8 + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64))))
        self.frame: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        if self.frame[0] != k:
            packed = self._at(int(self.places[k]), self.table[k][0])
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.table[k][1])
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k][2]:
                raise ValueError(f"frame {k} is damaged")
            self.frame = (k, data)
        return self.frame[1]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, number: int) -> np.ndarray:
        start, end = int(self.offsets[number]), int(self.offsets[number + 1])
        k = int(np.searchsorted(self.starts, start, side="right")) - 1
        parts = []
        while start < end:
            data, base = self._frame(k), int(self.starts[k])
            parts.append(data[start - base : end - base])
            start = min(end, base + len(data))
            k += 1
        return np.frombuffer(b"".join(parts), dtype="<u4")


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder that executors share, on any file system that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write doc_id and text of `docs` as files `part-NNNNN-*.tokens.zst` under `uri`.

    Gives one row per file: part, file, n_docs, n_ids, in the order of doc_id. A file counts if a row names it.
    """
    schema = "part int, file string, n_docs long, n_ids long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, total = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                store, folder = open_folder(uri)
                store.create_dir(folder, recursive=True)
                name = f"part-{part:05d}-{uuid.uuid4().hex}.tokens.zst"
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
                writer, encode = FrameWriter(out, frame_bytes), encoder(tokenizer, end_id).encode
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist())):
                    writer.add(doc_id, ids)
                    total += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.docs)]), pa.array([total])], names=["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    text_key = F.xxhash64("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), text_key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), text_key)
    return ordered.mapInArrow(write, schema)


def write_index(parts: DataFrame, uri: str) -> DataFrame:
    """Write the files (the lazy result of `write_files`) and `_index` beside them: file, before (ids of the files before it), n_docs, n_ids.

    Files that no row names, of attempts that failed, go. One row per file passes through the driver.
    """
    spark, before, rows = parts.sparkSession, 0, []
    for r in sorted(parts.collect()):
        rows.append((r["file"], before, r["n_docs"], r["n_ids"]))
        before += r["n_ids"]
    store, folder = open_folder(uri)
    for info in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".tokens.zst") and info.base_name not in {file for file, *_ in rows}:
            store.delete_file(info.path)
    index = spark.createDataFrame(rows, "file string, before long, n_docs long, n_ids long")
    index.repartition(max(1, len(rows))).write.parquet(f"{uri}/_index")
    return spark.read.schema(index.schema).parquet(f"{uri}/_index")


def read_files(files: DataFrame, uri: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, ids."""
    schema = T.StructType([long_field("doc_id"), long_field("start"), long_field("n_tokens"), long_field("ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, folder = open_folder(uri)
                with store.open_input_file(f"{folder}/{name}") as source:
                    reader = FrameReader(source)
                    for a in range(0, len(reader), 10_000):
                        numbers = range(a, min(len(reader), a + 10_000))
                        lengths = [int(reader.offsets[n + 1] - reader.offsets[n]) // 4 for n in numbers]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.doc_ids[n] for n in numbers], pa.int64()),
                                pa.array([before + int(reader.offsets[n]) // 4 for n in numbers], pa.int64()),
                                pa.array(lengths, pa.int64()),
                                pa.array([zlib.crc32(reader.document(n)) for n in numbers], pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return files.select("file", "before").mapInArrow(read, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "token-files")
    files = write_index(write_files(read_table(spark, sf_dir, "documents"), uri, tokenizer_path("word_bpe_49k.json")), uri)
    return read_files(files.repartition(max(1, files.count())), uri)
