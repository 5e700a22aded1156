"""Operator 10: near-duplicates by BagMinHash.

A document is the bag of its five-word shingles, with their counts as weights. Each
shingle drives Poisson processes over the product of time and weight: weights are
discretised to units and grouped hierarchically into the intervals [0,1), [1,2), [2,4),
[4,8) and so on, each with one process whose rate is its length; a point of the last,
partly filled interval counts only if its unit lies below the shingle's count. Points
come in order of time and each falls into one of M registers, which keep their earliest
point. Two bags then agree in a register with the probability of their weighted
Jaccard similarity. A process is left as soon as its next point is later than the
latest register, which makes a long text cost few points a shingle.

Registers are banded (BANDS of ROWS; a pair at the threshold is missed with
probability (1 - 0.8**4)**32, below 1e-7), and candidates are verified on the whole bags: the
multiset overlap over the multiset union is at least `threshold`.

Large groups. Documents with the same words are one node, so exact copies never pair up.
In a bucket every node is verified against one centre, the node with the most company
in all its buckets. Links found join nodes to components. Two nodes x and y of different components
that met the same centre c can only be similar if they share shingles that c lacks, or if
min(|x&c|, |y&c|) alone is large enough for their sizes, so only such pairs are verified
then. Shingles beyond c are matched by prefix: sizes tell how many of them a similar pair must share
at least, so one of the others and one more, taken rarest first, is among those shared; what only c
lacks is the most frequent and comes last. This finds the components of all candidate
pairs without writing out the pairs inside a group.

A pair of documents both of whose bags are known is compared exactly. With five words and 0.8, a copy of which
more than about one word in 45 was changed at random is below the threshold and is no near-duplicate by this definition.

Defined cases: null and wordless texts are classes of their own, but for rows with the
same doc_id and text; texts of one to four words are one shingle; long texts are taken whole; rows of the
same doc_id and text are one document; equal texts with different ids are one class; an empty table gives no
rows. Columns of `docs` may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, map_texts, materialize, one_thread, read_table, text_column, tidied
from .words import mix, sequence_hashes, shingle_hashes, word_hashes

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Products of the threshold are floating-point numbers; overlaps are whole, so this never lets a smaller one pass.
SLACK = 1e-9


def bags(shingles: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: text, element, count.

    The number of the text and 44 bits of the shingle are sorted as one word.
    """
    key = np.sort((texts.astype(np.uint64) << np.uint64(44)) | (shingles >> np.uint64(20)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(key)])))
    key = key[at]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), counts


def signatures(text: np.ndarray, element: np.ndarray, count: np.ndarray, n_texts: int, m: int = M) -> np.ndarray:
    """BagMinHash registers, one row of m for each text; inf where a text has no element."""
    registers = np.full(n_texts * m, np.inf)
    latest = np.full(n_texts, np.inf)
    # one process for each dyadic interval of weight that begins below the count
    own, start, length = [np.arange(len(text))], [np.zeros(len(text))], [np.ones(len(text))]
    low = 1
    while len(rows := np.flatnonzero(count > low)):
        own.append(rows)
        start.append(np.full(len(rows), float(low)))
        length.append(np.full(len(rows), float(low)))
        low *= 2
    row = np.concatenate(own)
    start, length = np.concatenate(start), np.concatenate(length)
    where, weight = text[row], count[row]
    state = mix(element[row] ^ mix((start + 1).view(np.uint64)))
    time = np.zeros(len(row))
    while len(where):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        drawn = mix(state)
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / (length * m)
        alive = time < latest[where]
        where, weight, start, length, state, time, drawn = (x[alive] for x in (where, weight, start, length, state, time, drawn))
        second = mix(drawn ^ np.uint64(0xA0761D6478BD642F))
        register = (second & np.uint64(0xFFFFFFFF)).astype(np.int64) * m >> 32
        unit = start + np.floor((second >> np.uint64(32)).astype(np.float64) * length * 2.0**-32)
        counts = unit < weight
        np.minimum.at(registers, where[counts] * m + register[counts], time[counts])
        touched = np.unique(where)
        latest[touched] = registers.reshape(n_texts, m)[touched].max(axis=1)
    return registers.reshape(n_texts, m)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band; the number of the band is part of it."""
    rounded = registers.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(registers), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rounded.shape[:2]).copy()
    for k in range(rounded.shape[2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rounded[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def _profile():
    one_thread()

    def work(texts: list, rows: pa.RecordBatch) -> dict:
        words, counts = word_hashes(texts)
        shingles, owner = shingle_hashes(words, counts, WIDTH)
        bag = bags(shingles, owner)
        some = counts > 0
        keys = band_keys(signatures(*bag, len(texts)))
        whole = sequence_hashes(words, counts)
        offsets = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
        return {
            "n_words": pa.array(counts),
            "k1": pa.array(whole[:, 0], mask=~some),
            "k2": pa.array(whole[:, 1], mask=~some),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel())).cast(pa.list_(pa.int64())),
        }

    return work


def text_hash(df: DataFrame):
    return F.xxhash64(text_column(df))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n_words and band keys of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), long_field("text_hash"), long_field("n_words"), long_field("k1"), long_field("k2"), T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), text_hash(docs).alias("text_hash"))
    found = map_texts(rows, _profile, schema, keep=("doc_id", "text_hash"))
    alone = F.xxhash64("doc_id", "text_hash", F.lit("no words"))
    return found.withColumn("node", F.when(F.col("n_words") > 0, F.xxhash64("k1", "k2")).otherwise(alone)).drop("k1", "k2")


def _compare(a: bytes, b: bytes, threshold: float, memo: dict) -> tuple[int, int, bool, np.ndarray]:
    """Overlap, size of b, whether they are similar, and b's shingles beyond a (with numbers, if they repeat)."""
    left, right = (_sorted_bag(x, memo) for x in (a, b))
    place = np.minimum(np.searchsorted(left[0], right[0]), len(left[0]) - 1)
    shared = np.where(left[0][place] == right[0], np.minimum(left[1][place], right[1]), 0)
    overlap, size = int(shared.sum()), int(right[1].sum())
    more = np.repeat(np.arange(len(shared)), right[1] - shared)
    which = np.arange(len(more)) - np.concatenate(([0], np.cumsum(right[1] - shared)))[more] + shared[more]
    beyond = mix(right[0][more] + which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    similar = overlap >= threshold * (int(left[1].sum()) + size - overlap) - SLACK
    return overlap, size, similar, beyond


def _sorted_bag(text: bytes, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    if text not in memo:
        if sum(map(len, memo)) > 1 << 20:
            memo.clear()
        words, counts = word_hashes([text])
        memo[text] = np.unique(shingle_hashes(words, counts, WIDTH)[0], return_counts=True)
    return memo[text]


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, overlap, size (of b), similar and beyond of pairs of nodes; `texts` has node and text of those involved."""

    def work(batches):
        memo: dict = {}
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            left, right = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            overlap, size, similar, beyond = zip(*(_compare(x, y, threshold, memo) for x, y in zip(left, right)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(overlap, pa.int64()), pa.array(size, pa.int64()), pa.array(similar, pa.bool_()), pa.array(beyond, pa.list_(pa.int64()))],
                names=["a", "b", "overlap", "size", "similar", "beyond"],
            )

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(work, "a long, b long, overlap long, size long, similar boolean, beyond array<long>")


def _open_pairs(shared: DataFrame, stars: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes that share a bucket, lie in different components and may be similar by what is known."""
    named = shared.join(labels, shared["b"] == labels["node"], "left").select("key", "a", "b", F.coalesce("component", "b").alias("component"))
    named = materialize(named, "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    met = named.where("a <> b").join(mixed, "key").select("key", "a", "b", "component")
    met = materialize(met.join(stars.select("a", "b", "overlap", "size"), ["a", "b"]), "met")

    def across(left: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of different components that share a key: one of the two is not in the key's largest component."""
        sizes = left.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy(*keys).agg(F.max(F.struct("n", "component")).alias("most")).select(*keys, F.col("most.component").alias("largest"))
        few = left.join(largest, keys).where("component <> largest").drop("largest")
        every = left.select(*keys, *(F.col(c).alias(f"{c}_y") for c in ("b", "component", "overlap", "size")))
        enough = F.least("overlap", "overlap_y") * (1 + threshold) >= threshold * (F.col("size") + F.col("size_y")) - SLACK
        pairs = few.join(every, keys).where("component <> component_y").where(enough)
        return pairs.select(F.least("b", "b_y").alias("a"), F.greatest("b", "b_y").alias("b"))

    # sizes of a similar pair differ by the threshold at most, so each has a share of `threshold` in common with the centre
    by_size = across(met.where(F.col("overlap") >= threshold * F.col("size") - SLACK), ["key"])
    once = met.select("a", "b", "component", "overlap", "size").distinct()
    once = once.join(once.groupBy("a").agg(F.min("size").alias("least")), "a")
    each = once.join(stars.select("a", "b", "beyond"), ["a", "b"]).select("a", "b", "component", "overlap", "size", "least", F.explode("beyond").alias("shingle"))
    each = materialize(each, "beyond")
    known = each.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    rarest = F.row_number().over(Window.partitionBy("a", "b").orderBy("n", "shingle"))
    # shingles beyond the centre that x must share with any similar node of the star, and so its prefix
    other = F.greatest(threshold * F.col("size"), F.col("least"))
    needed = F.greatest(F.lit(0), F.ceil(threshold / (1 + threshold) * (F.col("size") + other) - 1e-9) - F.col("overlap"))
    prefix = F.col("size") - F.col("overlap") - needed + 1
    several = F.count_if(F.col("n") > 1).over(Window.partitionBy("a", "b"))
    first = each.join(known, ["a", "shingle"]).withColumns({"place": rarest, "several": several}).where((F.col("place") <= prefix) & F.expr("low <> high"))
    # what two nodes share beyond the centre, others of the star have too: `several` bounds it
    first = first.withColumn("overlap", F.col("overlap") + F.col("several")).select("a", "b", "component", "overlap", "size", "shingle")
    by_shingle = across(materialize(first, "first"), ["a", "shingle"])
    return by_size.union(by_shingle).distinct()


@tidied("components")
def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node that has an edge.

    Each round takes the smallest label among the neighbours and then the label's own label, so
    chains shrink by doubling; rounds go on until no label changes.
    """
    both = materialize(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        closer = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = materialize(closer.join(jump, "next").select("node", F.col("component").alias("was"), F.least("next", "far").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels


@tidied("classes")
def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, class_id, representative.

    class_id is the smallest doc_id of the class; the representative is its document with the
    smallest doc_id, and among those the smallest hash of the text.
    """
    rows = materialize(profiles(docs), "profiles")
    nodes = rows.where("n_words > 0").groupBy("node").agg(F.first("bands").alias("bands"))
    keys = materialize(nodes.select("node", F.explode("bands").alias("key")), "bands")
    sizes = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = materialize(keys.join(sizes, "key"), "shared")
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    shared = materialize(shared.join(company, "node").select("key", "node", "company"), "company")
    centres = shared.groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("least"), "node")).alias("centre")).select("key", F.col("centre.node").alias("a"))
    shared = materialize(shared.join(centres, "key").select("key", "a", F.col("node").alias("b")), "buckets")
    pairs = materialize(shared.where("a <> b").select("a", "b").distinct(), "pairs")

    involved = shared.select(F.col("b").alias("node")).distinct()
    # any document of a node will do: its words are those of the node
    picked = rows.join(involved, "node").select("node", "doc_id", "text_hash").dropDuplicates(["node"])
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), text_column(docs).alias("text"), text_hash(docs).alias("h")).join(
        picked, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    ).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    stars = materialize(verify(pairs, texts, threshold), "stars")
    edges = stars.where("similar").select("a", "b")
    labels = components(edges)
    known = pairs.union(pairs.select("b", "a").toDF("a", "b"))
    rest = materialize(_open_pairs(shared, stars, labels, threshold).join(known, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = materialize(verify(rest, texts, threshold).where("similar").select("a", "b"), "edges")
        if not more.isEmpty():
            labels = components(edges.union(more))

    classed = rows.select("doc_id", "text_hash", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = materialize(classed.select("doc_id", "text_hash", "component"), "classed")
    least = classed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_hash")).alias("least"))
    return classed.join(least, "component").select(
        "doc_id", "text_hash", "class_id", (F.struct("doc_id", "text_hash").eqNullSafe(F.col("least"))).alias("representative")
    )


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class: its representative, one row of it."""
    kept = near_classes(docs, threshold).where("representative").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("id"), text_hash(docs).alias("hash"))
    found = own.join(kept, own["id"].eqNullSafe(kept["doc_id"]) & (own["hash"] == kept["text_hash"]))
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    once = found.where("n = 1").select(*names)
    if kept.where("n > 1").isEmpty():
        return once
    return once.unionByName(found.where("n > 1").dropDuplicates(["id", "hash"]).select(*names))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "representative")
