"""Operator 7: benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one automaton. Documents stream
through it; wherever the longest match holds a whole window (10 words, or a whole item
of fewer) the words of that window are hit. `decontaminate` removes hit spans, and
drops documents of which too large a part is hit.

The items are a small table next to the corpus, and this is checked: automata are
built for blocks of items of at most `BLOCK_WORDS` words (a longer item is cut into parts that share all but one word of
a window). With more items than that the documents stream through one block after the other: what a pass found is
written before the next block is built and the block's broadcast is destroyed, so a task never holds more than one block, nor
the driver more than two. No shuffle is needed.

Defined cases: null texts and items have no words; an item whose item_id is null hits
words but is not named; repeated items count once per item_id; an empty benchmark
leaves every document clean; texts of any length are taken whole; every row of `docs` gives one row, repeats included;
an empty table gives none. Columns passed on may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Matcher
from .common import _PLAIN_WORDS, long_field, map_texts, materialize, plain_words, read_table, text_column

WINDOW = 10
#: An automaton of a block has at most twice as many states, a few hundred MB.
BLOCK_WORDS = 400_000


class ItemBlock:
    """An automaton of some items, with what is needed to name the items of a window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        lengths = sorted({min(window, len(words)) for _, words in items})
        self.short_lengths = [n for n in lengths if n < window]
        self.matcher = Matcher([words for _, words in items], min(lengths, default=window))
        sam, vocabulary = self.matcher.automaton, self.matcher.vocabulary
        self.short: dict[tuple[int, int], set[int]] = {}  # by state and length: items below the window
        for k, (_, words) in enumerate(items):
            if len(words) < window:
                state = 0
                for w in words:
                    state = sam.next[state][vocabulary[w]]
                self.short.setdefault((sam.suffix_state(state, len(words)), len(words)), set()).add(k)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans, merged and in order, and the names of the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        sam = self.matcher.automaton

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for at, matched, state in self.matcher.statistics(self.matcher.ids(words)):
            if matched >= self.window:
                hit(at + 1 - self.window, at + 1)
                whole = sam.suffix_state(state, self.window)
                if whole not in seen:
                    seen.add(whole)
                    found.update(sam.owners[whole])
            for n in self.short_lengths:
                if n <= matched and (own := self.short.get((sam.suffix_state(state, n), n))):
                    hit(at + 1 - n, at + 1)
                    found |= own
        return spans, {self.names[k] for k in found if self.names[k] is not None}


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[ItemBlock]:
    """Blocks of whole items, built one at a time; one without items if there are none."""
    items, size, made = [], 0, False
    rows = benchmark.select(F.col("item_id").cast("string"), text_column(benchmark)).distinct()
    for name, text in rows.toLocalIterator():
        words = plain_words(text.encode() if text is not None else None)
        for part in _parts(words, window, block_words):
            if items and size + len(part) > block_words:
                yield ItemBlock(items, window)
                items, size, made = [], 0, True
            items.append((name, part))
            size += len(part)
    if items or not made:
        yield ItemBlock(items, window)


def _parts(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """The words in parts of at most `most` (a window at least) that together have every window of them."""
    step = max(1, most - window + 1)
    for i in range(0, max(1, len(words) - window + 1), step):
        if part := words[i : i + step + window - 1]:
            yield part


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        while out and out[-1][1] >= start:
            before = out.pop()
            start, end = min(start, before[0]), max(end, before[1])
        out.append((start, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ("doc_id",), with_clean: bool = False) -> DataFrame:
    """The columns of `keep`, with n_words, starts and ends of the hit runs (in words) and items.

    With `with_clean`, clean_text also: the text without its hit runs.
    """
    spark = docs.sparkSession
    found = [long_field("n_words"), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")), T.StructField("items", T.ArrayType(T.StringType()))]
    kept = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    text = T.StructField("text", T.StringType())
    out = docs.withColumns({"text": text_column(docs)})
    blocks = item_blocks(benchmark, window, block_words)
    block, number = next(blocks), 0
    while block is not None:
        after = next(blocks, None)  # the one block that the driver holds beside this
        load = spark.sparkContext.broadcast(block)  # about BLOCK_WORDS words at most
        last = after is None
        schema = T.StructType(kept + found + ([] if last else [text]) + ([T.StructField("clean_text", T.StringType())] if last and with_clean else []))
        carry = keep + (("starts", "ends", "items") if number else ()) + (() if last and "text" not in keep else ("text",))
        own = tuple(c for c in dict.fromkeys(carry) if c in out.columns)
        out = map_texts(out, _scanner(load, own, bool(number), last and with_clean), schema, keep=own, pass_on=keep + (() if last else ("text",)))
        if not last:
            out = materialize(out, "pass")
            load.destroy()
        block, number = after, number + 1
    return out


def _scanner(load, own: tuple[str, ...], again: bool, clean: bool):
    def start():
        block = load.value

        def work(texts: list, rows: pa.RecordBatch) -> dict[str, list]:
            out = {"n_words": [], "starts": [], "ends": [], "items": [], "clean_text": []}
            before = [rows.column(1 + own.index(c)).to_pylist() for c in ("starts", "ends", "items")] if again else None
            for k, text in enumerate(texts):
                words = plain_words(text)
                spans, items = block.scan(words)
                if before:
                    spans = merged([*spans, *zip(before[0][k], before[1][k])])
                    items |= set(before[2][k])
                out["n_words"].append(len(words))
                out["starts"].append([a for a, _ in spans])
                out["ends"].append([b for _, b in spans])
                out["items"].append(sorted(items))
                if clean:
                    out["clean_text"].append(without_words(text, spans))
            return out

        return work

    return start


def without_words(text: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without these runs of words; what stands between two words of a run goes too."""
    if text is None or not spans:
        return None if text is None else text.decode("utf-8", "replace")
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_PLAIN_WORDS))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def n_hit() -> F.Column:
    """Words inside hit runs, of the columns starts and ends."""
    sums = [F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in ("ends", "starts")]
    return sums[0] - sums[1]


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """`docs` without hit spans; a document goes if more than `max_coverage` of its words are hit."""
    others = [c for c in docs.columns if c != "text"]
    numbered = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(others)), text_column(docs).alias("text"))
    found = scan(numbered, benchmark, window, keep=tuple(c for c in numbered.columns if c != "text"), with_clean=True)
    kept = found.where(n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    back = {c: F.col(f"__c{i}") for i, c in enumerate(others)} | {"text": F.col("clean_text")}
    return kept.select(*(back[c].alias(c) for c in docs.columns))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pieces AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pieces p JOIN win ON p.n = win.n AND p.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word_at FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
