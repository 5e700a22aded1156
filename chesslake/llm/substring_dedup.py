"""Operator 2: substring dedup by sliding spans of sentences.

A sentence is a run of characters up to and with its terminators (those of Latin, Chinese, Japanese, Arabic
and Indic scripts, and line ends) and the blanks after them; sentences compare trimmed and in lower case. Spans of several
consecutive sentences slide over the text: from every sentence the shortest run onward, and to every sentence the
shortest run back, of at least SPAN sentences and MIN_WORDS words. A passage whose sentences hold SPAN sentences and
MIN_WORDS words is so covered from its first sentence to its last, however short its lines are. A sentence of at least
LONG_WORDS words is a run by itself. All runs are hashed (128 bits) and grouped over the whole corpus; the
first occurrence of a run is the one with the smallest doc_id, then hash of the text,
then position, and the sentences that any other occurrence covers are removed.

MIN_WORDS says what a passage is; it leaves alone pairs such as "Yes. No." that authors write anew. At sf0.1 a floor of 0 would
touch 1,280 more documents of 10,000, for repeats of one-word sentences. Words are runs of characters that are no blanks (of any
kind); in scripts written without spaces a Han or kana character is a word, and so are up to four characters of Thai, Lao,
Khmer or Burmese. Every sentence counts as a word at least.

Only hashes and positions are shuffled to find repeats. Runs are counted before the shuffle, so for counting a run that
many documents share is one row per map task; its occurrences then meet one row with its first place, in a join that
Spark can split where it is skewed. Texts move once, to meet the positions to remove.

Defined cases: a null text stays null; an empty text stays empty; a text of any length is taken whole; null doc_ids sort
first; rows of the same doc_id and text are one document and get the same text; a table
without repeats comes back as it is, an empty one empty. Columns of `docs` named n_sentences and n_removed are
replaced; all others, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, text_column

SPAN = 2
MIN_WORDS = 8
LONG_WORDS = 50
_ENDS = r".!?\n\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965".encode().decode("unicode_escape")
_SENTENCE = rf"[^{_ENDS}]+[{_ENDS}]*[ \t\n\r\f]*|[{_ENDS}]+[ \t\n\r\f]*"
_BLANKS = " \t\n\r\f"
_SPACES = " \t\n\x0b\f\r\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_IDEOGRAPHS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_WORD = f"[{_IDEOGRAPHS}]|[{_UNSPACED}]{{1,4}}|[^{_SPACES}{_IDEOGRAPHS}{_UNSPACED}]+"


def sentences(text: Column) -> Column:
    """The sentences of a text; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))


def _words(norm: Column) -> Column:
    """Words of a trimmed sentence, 1 at least; most sentences are ASCII with single blanks, where those are counted."""
    plain = F.octet_length(norm) == F.length(norm)
    for blank in ("  ", "\t", "\x0b", "\f", "\r"):
        plain = plain & ~F.contains(norm, F.lit(blank))
    single = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1
    return F.greatest(F.lit(1), F.when(plain, single).otherwise(F.regexp_count(norm, F.lit(_WORD))))


def spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """Every run: doc_id, text_hash, place (of its first sentence), size, h1, h2."""

    def unit(norm: Column) -> Column:
        return F.struct(F.xxhash64(norm).alias("a"), F.xxhash64(norm, F.lit(1)).alias("b"), _words(norm).alias("w"))

    norms = F.transform(sentences(text_column(docs)), lambda piece: F.lower(F.btrim(piece, F.lit(_BLANKS))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column(docs)).alias("text_hash"), F.transform(norms, unit).alias("u"))

    def words(first: Column, size: int) -> Column:
        return sum((F.get("u", first + k)["w"] for k in range(1, size)), F.get("u", first)["w"])

    def run(first: Column, size: int) -> Column:
        own = [F.get("u", first + k) for k in range(size)]
        return F.struct(
            first.alias("place"), F.lit(size).alias("size"),
            F.xxhash64(*(x["a"] for x in own), F.lit(size)).alias("h1"), F.xxhash64(*(x["b"] for x in own), F.lit(size)).alias("h2"),
        )

    def runs(size: int, least: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size("u") - size), lambda i: words(i, size) >= least)
        return F.when(F.size("u") >= size, F.transform(places, lambda i: run(i, size)))

    most = max(span, min_words)  # sentences have a word at least

    def reach(units: Column) -> Column:
        """How many of `units` have span sentences and min_words words together, their words, and those without the last."""
        none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("words"), F.lit(0).alias("before"))
        step = lambda s, x: F.when((s["words"] >= min_words) & (s["size"] >= span), s).otherwise(F.struct((s["size"] + 1).alias("size"), (s["words"] + x["w"]).alias("words"), s["words"].alias("before")))
        return F.aggregate(units, none, step)

    def grown(first: Column, size: Column) -> Column:
        own = F.slice("u", first + 1, size)
        return F.struct(
            first.alias("place"), size.alias("size"),
            F.xxhash64(F.transform(own, lambda x: x["a"]), size).alias("h1"), F.xxhash64(F.transform(own, lambda x: x["b"]), size).alias("h2"),
        )

    def onward(i: Column) -> Column:
        got = F.filter(F.array(reach(F.slice("u", i + 1, F.lit(most)))), lambda g: g["words"] >= min_words)
        return F.transform(got, lambda g: grown(i, g["size"]))

    def back(i: Column) -> Column:
        end = i + span
        low = F.greatest(F.lit(0), end - most)
        got = F.array(reach(F.reverse(F.slice("u", low + 1, end - low))))
        # the run onward from the same sentence ends there too, unless it has enough words before
        fresh = F.filter(got, lambda g: (g["words"] >= min_words) & (g["words"] - F.get("u", end - 1)["w"] >= min_words))
        return F.transform(fresh, lambda g: grown(end - g["size"], g["size"]))

    empty = F.array().cast("array<struct<place:int,size:int,h1:bigint,h2:bigint>>")
    short = F.filter(F.sequence(F.lit(0), F.size("u") - span), lambda i: words(i, span) < min_words)
    both = F.when(F.size("u") >= span, F.flatten(F.transform(short, lambda i: F.concat(onward(i), back(i)))))
    every = [F.coalesce(x, empty) for x in (runs(span, min_words), runs(1, long_words), both)]
    return rows.select("doc_id", "text_hash", F.inline(F.concat(*every)))


def covered(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, text_hash and the numbers of the sentences to remove, for documents that have some."""
    every = materialize(spans(docs, span, min_words, long_words), "spans")
    place = F.struct("doc_id", "text_hash", "place")
    repeated = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = every.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    numbers = F.flatten(F.transform(F.collect_set(F.struct("place", "size")), lambda x: F.sequence(x["place"], x["place"] + x["size"] - 1)))
    return later.groupBy("doc_id", "text_hash").agg(F.array_distinct(numbers).alias("removed"))


def substring_dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """`docs` with its texts shortened, and n_sentences and n_removed (which replace columns so named)."""
    gone = materialize(covered(docs, span, min_words, long_words), "covered")
    held = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "text")]
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(held)), F.col("doc_id").cast("long").alias("id"), text_column(docs).alias("text"), F.xxhash64(text_column(docs)).alias("hash"))
    rows = own.join(gone, own["id"].eqNullSafe(gone["doc_id"]) & (own["hash"] == gone["text_hash"]), "left").drop(gone["doc_id"], gone["text_hash"])
    pieces = rows.withColumn("pieces", sentences(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("pieces", i)), ""))
    back = {c: F.col(f"c{i}") for i, c in enumerate(held)} | {"text": text}
    numbers = (F.when(F.col("text").isNull(), 0).otherwise(F.size("pieces")), F.coalesce(F.size("removed"), F.lit(0)))
    return pieces.select(*(back[c].alias(c) for c in docs.columns if c in back), *(v.cast("long").alias(c) for v, c in zip(numbers, ("n_sentences", "n_removed"))))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = rf"""
WITH s AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_SENTENCE}') AS pieces FROM documents),
u AS (SELECT doc_id, pieces, list_transform(pieces, lambda x: lower(trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)))) AS n FROM s WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, list_transform(n, lambda x: greatest(1, len(regexp_extract_all(x, '{_WORD}')))) AS w FROM u),
places AS (SELECT doc_id, n, w, unnest(range(1, len(n) + 1)) AS i FROM w),
sizes AS (
  SELECT doc_id, n, i, list_filter(range({SPAN}, {max(SPAN, MIN_WORDS)} + 1), lambda k: i + k - 1 <= len(w) AND list_sum(w[i:i + k - 1]) >= {MIN_WORDS})[1] AS size FROM places
  UNION ALL
  SELECT doc_id, n, i + 1 - k, k FROM (SELECT doc_id, n, i, list_filter(range({SPAN}, {max(SPAN, MIN_WORDS)} + 1), lambda k: k <= i AND list_sum(w[i + 1 - k:i]) >= {MIN_WORDS})[1] AS k FROM places)
  UNION ALL
  SELECT doc_id, n, i, 1 FROM places WHERE w[i] >= {LONG_WORDS}),
runs AS (SELECT DISTINCT doc_id, i - 1 AS place, size, n[i:i + size - 1] AS t FROM sizes WHERE size IS NOT NULL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY size, t ORDER BY doc_id, place) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + size)) AS place FROM later),
kept AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY p.place) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS place FROM s) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.place = p.place) GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(len(pieces), 0) AS BIGINT) AS n_sentences,
  CAST(coalesce(len(pieces), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM s LEFT JOIN kept USING (doc_id)
"""
