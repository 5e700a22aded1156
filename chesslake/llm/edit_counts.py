"""Operator 8: edit-aware token counts.

Each document is kept as a segment tree over its pre-tokens: a leaf holds the text of a short run of pre-tokens
with its token count, an inner node the sums of characters and tokens below it. An
edit descends by characters to the leaves it touches; from the leaf before them on, text is cut into
pre-tokens anew until a cut falls on an old leaf boundary again, only those leaves are
re-encoded, and the sums above them are updated. The count after each edit is the root's.

Trees are stored: `build_trees` gives a table of texts with the characters, pre-tokens and tokens of their leaves, and
`apply_edits` reads such a table, restores each tree from it without cutting or encoding anything, applies a batch of edits and gives the
table as it is then. Batch follows batch; the first costs an encoding of the whole, later ones what they touch.

The pattern has no look-behind and looks one character ahead, so cutting may start at any
old boundary that lies clear of the edit, and agrees with the old cuts after it
as soon as it meets one of them.

Edits are a table (doc_id, seq, start, n_deleted, inserted), one for each doc_id and seq (of several the least counts),
applied in the order of seq; positions are characters of the text as it is then, and are clipped to it. A log that is a
function of the document itself, as `own_edits`, is applied in place; another is gathered per doc_id and joined.

Defined cases: null texts are empty; a document without edits has equal counts; null inserts
are empty; invalid UTF-8 counts as U+FFFD; rows that repeat a doc_id each get that id's edits; texts of any length are
one tree; an empty table gives none. Columns beside doc_id and text are left out.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, map_texts, materialize, read_table, text_column, tokenizer_path

LEAF = 32
#: Bytes of pre-tokens that a worker process remembers, and the longest one kept.
CACHE_BYTES = 192 << 20
LONG_PIECE = 64


class PieceCounter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, int] = {}
        self.held = 0

    def counts(self, pieces: list[str]) -> list[int]:
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        cache, encode, long = self.cache, self.encoding.encode_ordinary, []
        for piece in set(pieces):
            if piece not in cache:
                cache[piece] = len(encode(piece))
                if len(piece) > LONG_PIECE:
                    long.append(piece)
                else:
                    self.held += 150 + 2 * len(piece)
        out = list(map(cache.__getitem__, pieces))
        for piece in long:
            del cache[piece]
        return out


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The counter of this worker process."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


class TokenTree:
    """A text's pre-tokens under a segment tree of (characters, tokens)."""

    def __init__(self, count: PieceCounter, leaves: list[str], pieces: list[int], tokens: list[int]):
        """From the leaves' texts, and how many pre-tokens and tokens each has."""
        self.count, self.leaves, self.pieces, self.recounted = count, leaves or [""], pieces or [0], 0
        self._build(tokens or [0])

    @classmethod
    def of(cls, text: str, count: PieceCounter) -> TokenTree:
        pieces = count.cut.findall(text)
        tree = cls(count, *_leaves(pieces, count.counts(pieces)))
        tree.recounted = len(pieces)
        return tree

    def _build(self, tokens: list[int]) -> None:
        self.n = len(self.leaves)
        # leaves are nodes n to 2n - 1; the sums of node 1 are those of all
        self.chars = [0] * self.n + list(map(len, self.leaves))
        self.tokens = [0] * self.n + tokens
        for k in range(self.n - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def stored(self) -> tuple[list[int], list[int], list[int]]:
        """Characters, pre-tokens and tokens of the leaves that are not empty."""
        some = [k for k in range(self.n) if self.leaves[k]]
        return [len(self.leaves[k]) for k in some], [self.pieces[k] for k in some], [self.tokens[self.n + k] for k in some]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one at the end), and where it starts."""
        at = 0
        for node in self._roots():
            if place < at + self.chars[node]:
                while node < self.n:
                    node *= 2
                    if place >= at + self.chars[node]:
                        at += self.chars[node]
                        node += 1
                return node - self.n, at
            at += self.chars[node]
        last = self.n - 1
        return last, self.n_chars - self.chars[self.n + last]

    def _roots(self) -> list[int]:
        """Nodes whose subtrees hold the leaves from first to last."""
        left, right, low, high = self.n, 2 * self.n, [], []
        while left < right:
            if left & 1:
                low.append(left)
                left += 1
            if right & 1:
                right -= 1
                high.append(right)
            left //= 2
            right //= 2
        return low + high[::-1]

    def edit(self, start: int, n_deleted: int, inserted: str) -> None:
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(n_deleted, 0), self.n_chars)
        first, base = self._leaf(start)
        last, _ = self._leaf(stop)
        clear = 0  # characters and pieces kept before the edit, so that the cut before it stands
        while first > 0 and (start - base < 3 or clear < 2):
            first -= 1
            base -= self.chars[self.n + first]
            clear += self.pieces[first]
        own = "".join(self.leaves[first : last + 1])
        changed = own[: start - base] + inserted + own[stop - base :]
        while True:
            after = self.leaves[last + 1] if last + 1 < self.n else ""
            look = last + 2
            while look < self.n and len(after) < 2:  # emptied leaves say nothing about what follows
                after += self.leaves[look]
                look += 1
            pieces, size = [], 0
            for piece in self.count.cut.findall(changed + after):
                if size >= len(changed):
                    break
                pieces.append(piece)
                size += len(piece)
            if size == len(changed) or not after:
                break
            last += 1
            changed += self.leaves[last]
        counts = self.count.counts(pieces)
        self.recounted += len(pieces)
        if len(pieces) > 8 * LEAF:  # long leaves are cut up; the others stay as they are
            leaves, sizes, tokens = _leaves(pieces, counts)
            after = self.tokens[self.n + last + 1 :]
            tokens = self.tokens[self.n : self.n + first] + tokens + after
            self.leaves[first : last + 1], self.pieces[first : last + 1] = leaves, sizes
            self._build(tokens)
            return
        for leaf in range(first, last + 1):
            self.leaves[leaf] = changed if leaf == first else ""
            self.pieces[leaf] = len(pieces) if leaf == first else 0
            self.chars[self.n + leaf] = len(changed) if leaf == first else 0
            self.tokens[self.n + leaf] = sum(counts) if leaf == first else 0
        touched = {(self.n + leaf) // 2 for leaf in range(first, last + 1)}
        while touched:
            for k in touched:
                if k >= 1:
                    self._sum(k)
            touched = {k // 2 for k in touched if k > 1}


def _leaves(pieces: list[str], tokens: list[int]) -> tuple[list[str], list[int], list[int]]:
    """Leaves of LEAF pre-tokens: their texts, pre-tokens and tokens."""
    runs = range(0, len(pieces), LEAF)
    return ["".join(pieces[i : i + LEAF]) for i in runs], [min(LEAF, len(pieces) - i) for i in runs], [sum(tokens[i : i + LEAF]) for i in runs]


def own_edits(docs: DataFrame, per_document: int = 3, batch: int = 0) -> Column:
    """Edits derived from a document: places, lengths and inserted parts come from hashes of doc_id and the batch's number."""
    text, n = F.coalesce(text_column(docs), F.lit("")), F.length(F.coalesce(text_column(docs), F.lit("")))
    draw = lambda k, what: F.xxhash64(F.col("doc_id"), k, F.lit(what if not batch else f"{what} {batch}"))
    one = lambda k: F.struct(
        k.cast("int").alias("seq"),
        F.pmod(draw(k, "start"), n + 1).cast("long").alias("start"),
        F.pmod(draw(k, "deleted"), F.lit(40)).cast("long").alias("n_deleted"),
        text.substr((F.pmod(draw(k, "from"), n + 1) + 1).cast("int"), F.pmod(draw(k, "size"), F.lit(60)).cast("int")).alias("inserted"),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(per_document - 1)), one)


def edit_log(docs: DataFrame, per_document: int = 3, batch: int = 0) -> DataFrame:
    """`own_edits` as a table: doc_id, seq, start, n_deleted, inserted."""
    return docs.select("doc_id", F.explode(own_edits(docs, per_document, batch)).alias("e")).select("doc_id", "e.*")


_TREE = [T.StructField("text", T.StringType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("leaf_chars", "leaf_pieces", "leaf_tokens"))]
_COUNTS = [long_field(c) for c in ("n_before", "n_after", "n_edits", "n_pieces", "n_recounted", "text_crc32")]


def gathered(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """`rows` with the column `edits`, the edits of their doc_id. A doc_id's edits are one array, as its text is one value."""
    one = F.struct("seq", "start", "n_deleted", "inserted")
    once = edits.groupBy(F.col("doc_id").alias("__id"), "seq").agg(F.min(one).alias("edit"))
    by_doc = once.groupBy("__id").agg(F.sort_array(F.collect_list("edit")).alias("edits"))
    return rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")


def build_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_pieces, leaf_tokens: the tree of every document, to be written as a table."""

    def start():
        count = counter(vocabulary)

        def work(texts: list, batch: pa.RecordBatch) -> dict:
            out: dict = {f.name: [] for f in _TREE}
            for raw in texts:
                text = raw.decode("utf-8", "replace") if raw else ""
                for name, value in zip(out, (text, *TokenTree.of(text, count).stored())):
                    out[name].append(value)
            return out

        return work

    rows = docs.select("doc_id", text_column(docs).alias("text"))
    return map_texts(rows, start, T.StructType([rows.schema["doc_id"], *_TREE]))


def apply_edits(trees: DataFrame, vocabulary: str, passed: tuple[str, ...] = ()) -> DataFrame:
    """Stored trees with a column `edits`, as they are after them; n_before, n_after, n_edits, n_pieces (pre-tokens before),
    n_recounted (pre-tokens counted for these edits) and text_crc32 beside, and the columns of `passed`."""

    def start():
        count = counter(vocabulary)

        def work(texts: list, batch: pa.RecordBatch) -> dict:
            out: dict = {f.name: [] for f in (*_TREE, *_COUNTS)}
            stored = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for raw, edits, chars, pieces, tokens in zip(texts, batch.column(2).to_pylist(), *stored):
                text, at, leaves = raw.decode("utf-8", "replace"), 0, []
                for n in chars:
                    leaves.append(text[at : at + n])
                    at += n
                tree = TokenTree(count, leaves, pieces, tokens)
                before = tree.n_tokens, sum(tree.pieces)
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["n_deleted"] or 0, e["inserted"] or "")
                text = tree.text()
                values = (text, *tree.stored(), before[0], tree.n_tokens, len(edits or ()), before[1], tree.recounted, zlib.crc32(text.encode()))
                for name, value in zip(out, values):
                    out[name].append(value)
            return out

        return work

    keep = ("doc_id", "edits", "leaf_chars", "leaf_pieces", "leaf_tokens")
    schema = T.StructType([*(trees.schema[c] for c in ("doc_id", *passed)), *_TREE, *_COUNTS])
    return map_texts(trees, start, schema, keep=keep + passed, pass_on=("doc_id", *passed))


def count_after_edits(docs: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the counts after the edits of a log, from whole texts."""
    after = apply_edits(gathered(build_trees(docs, vocabulary), edits), vocabulary)
    return after.select("doc_id", *(f.name for f in _COUNTS))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are built and take a first batch of edits, are stored, and take a second one from the store.

    n_before, n_pieces and n_recounted are those of the first batch, n_middle the tokens after it, n_again the
    pre-tokens counted for the second.
    """
    vocabulary = tokenizer_path("byte_bpe_50k.tiktoken")
    built = build_trees(read_table(spark, sf_dir, "documents"), vocabulary)
    first = apply_edits(built.withColumn("edits", own_edits(built)), vocabulary)
    figures = {"first_before": "n_before", "n_middle": "n_after", "first_pieces": "n_pieces", "first_recounted": "n_recounted"}
    stored = materialize(first.select("doc_id", *(f.name for f in _TREE), *(F.col(v).alias(k) for k, v in figures.items())), "trees")
    second = apply_edits(stored.withColumn("edits", own_edits(stored, batch=1)), vocabulary, passed=tuple(figures))
    return second.select(
        "doc_id", F.col("first_before").alias("n_before"), "n_middle", "n_after", F.col("first_pieces").alias("n_pieces"),
        F.col("first_recounted").alias("n_recounted"), F.col("n_recounted").alias("n_again"), "text_crc32",
    )
