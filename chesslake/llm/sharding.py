"""Operator 6: sharding by fixed virtual slots.

Every record is hashed into one of `n_slots` virtual slots; bytes are summed per
slot, and a stored, versioned map from slots to shards decides where a slot lives. A
rebalance never rehashes records, it edits the map: version 1 deals slots round
robin; each later version moves or swaps slots between the fullest and the emptiest
shard until their bytes are nearly equal. The map has `n_slots` rows whatever the
input is, so it is edited on the driver; every version is a folder of its own, published whole or not at all (of two
editors of one version the second fails) and read back by whoever needs it, and older versions stay.

Law: `bytes` (the shards' sizes are nearly equal). The slot depends on doc_id, text and the number of the repeat: rows of one doc_id
spread, as do rows that agree in both, and equal texts with different ids need not meet in a shard.

Repeats are counted before anything is numbered: rows that agree are one row with a count (added up in the tasks that read
them), which then becomes rows again in portions of PORTION, so a document that makes up a third of the table passes through no single task.

Defined cases: a null text has size 1 and the CRC of an empty text; a null doc_id is
hashed like a value; repeated rows are numbered, go to slots of their own and take positions of their
own; a text of any length counts whole; an empty table gives no rows and the round-robin map. `write_shards` keeps all
columns of `docs` but those named shard, virtual_slot and version, which it replaces.
"""

from __future__ import annotations

import bisect
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.publish import States
from .common import materialize, read_table, scratch_path, text_column

N_SLOTS = 4096
N_SHARDS = 16


#: Repeats that are numbered together.
PORTION = 4096


def _slot(doc_id: Column, crc: Column, repeat: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), crc, repeat.cast("long")), F.lit(n_slots)).cast("int")


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record.

    The slot depends on doc_id, text and the number of the repeat, so that rows that share any of them spread.
    """
    text = F.coalesce(text_column(docs), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    each = rows.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count(F.lit(1)).alias("n"))
    starts = F.when(F.col("n") <= PORTION, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PORTION).cast("long")))
    portions = each.select("doc_id", "size", "text_crc32", "n", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("n"), F.col("start") + PORTION) - 1)
    # portions of one document are dealt over the tasks; most documents have one and stay
    dealt = portions.where(F.col("n") > PORTION).repartition(F.xxhash64("doc_id", "text_crc32", "start"))
    numbered = portions.where(F.col("n") <= PORTION).unionByName(dealt).select("doc_id", "size", "text_crc32", F.explode(F.sequence("start", "end")).alias("repeat"))
    return numbered.select("doc_id", "size", "text_crc32", _slot(F.col("doc_id"), F.col("text_crc32"), F.col("repeat"), n_slots).alias("virtual_slot"))


def slot_sizes(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of every slot that has rows; n_slots rows at most."""
    return slotted.groupBy("virtual_slot").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")
    )


def initial_map(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> list[int]:
    """Version 1 of the map: slots dealt round robin."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalance(shard_of: list[int], sizes: dict[int, int], n_shards: int = N_SHARDS, tolerance: float = 1e-4) -> list[int]:
    """The next version of a map: moves and swaps of slots that even out the bytes.

    Each step takes the fullest and the emptiest shard and the move or swap that
    best halves their gap; it ends within `tolerance` of the mean or when no step helps.
    """
    shard_of = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        if sizes.get(slot):
            held[shard].append((sizes[slot], slot))
    for own in held:
        own.sort()
    load = [sum(size for size, _ in own) for own in held]
    mean = sum(load) / n_shards
    for _ in range(8 * len(shard_of)):
        high, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        if gap <= tolerance * mean:
            break
        best = (gap, None, None)  # what would be left of the gap, slot given, slot taken
        for size, slot in held[high]:
            for other in _near(held[low], size - gap / 2):
                moved = size - (other[0] if other else 0)
                if 0 < moved < gap:
                    best = min(best, (abs(gap - 2 * moved), (size, slot), other), key=lambda x: x[0])
        if best[1] is None:
            break
        for give, source, target in ((best[1], high, low), (best[2], low, high)):
            if give:
                held[source].remove(give)
                bisect.insort(held[target], give)
                load[source] -= give[0]
                load[target] += give[0]
                shard_of[give[1]] = target
    return shard_of


def _near(own: list[tuple[int, int]], size: float) -> list:
    at = bisect.bisect_left(own, (size, -1))
    return [None, *own[max(0, at - 1) : at + 1]]


_MAP = "version int, virtual_slot int, shard int, n_rows long, n_bytes long"


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the map stored at `path` (the newest by default); None if there is none."""
    states = States(spark, path, "map=")
    found = states.newest() if version is None else (version, states.read(version))
    return spark.read.schema(_MAP).parquet(f"{path}/{found[1]}") if found and found[1] else None


def add_batch(spark: SparkSession, path: str, sizes: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Add a batch's rows and bytes per slot to the map stored at `path`, rebalance it, store it as the next version.

    The first batch makes version 1 (round robin) too. `sizes` and the map have n_slots rows at most, a bound set by the
    parameter.
    """
    now = read_map(spark, path)
    if now is None:
        store_map(spark, path, [(1, slot, shard, 0, 0) for slot, shard in enumerate(initial_map(n_slots, n_shards))])
        now = read_map(spark, path)
    rows = sorted(now.collect(), key=lambda r: r["virtual_slot"])
    new = {r["virtual_slot"]: (r["n_rows"], r["n_bytes"]) for r in sizes.collect()}
    totals = [tuple(a + b for a, b in zip((r["n_rows"], r["n_bytes"]), new.get(r["virtual_slot"], (0, 0)))) for r in rows]
    edited = rebalance([r["shard"] for r in rows], {k: b for k, (_, b) in enumerate(totals)}, n_shards)
    store_map(spark, path, [(rows[0]["version"] + 1, slot, shard, *totals[slot]) for slot, shard in enumerate(edited)])
    return read_map(spark, path)


def store_map(spark: SparkSession, path: str, rows: list[tuple[int, int, int, int, int]]) -> None:
    """Store a version of the map (the first column); it is published when it is whole, and once."""
    folder = f"version={rows[0][0]}.{uuid.uuid4().hex}"
    spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{path}/{folder}")
    States(spark, path, "map=").publish(rows[0][0], folder)


def shard(docs: DataFrame, path: str, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> tuple[DataFrame, DataFrame]:
    """Every record with its shard and its position there, and the version of the map at `path` that decided.

    Positions are numbered within a virtual slot, and the map tells where each slot
    begins, so no task ever sees more than a slot.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, n_slots)
    table = add_batch(spark, path, slot_sizes(slotted), n_slots, n_shards)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)  # n_slots rows
    placed_slots = table.select("version", "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = (
        slotted.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(placed_slots), "virtual_slot")  # n_slots rows, a bound set by the parameter
        .withColumn("slot", F.col("first") + F.col("place"))
        .drop("first", "place")
    )
    return placed, table


def write_shards(docs: DataFrame, path: str, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> int:
    """Add a batch of `docs` to the shards at `path`; gives the version of the map that it was written by.

    Rows go to `data/version=V/shard=S`, the map to `_map/version=V`. What earlier versions wrote stays where it is;
    `moved` tells the slots to move if it is to follow.
    """
    text = F.coalesce(text_column(docs), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    size = F.octet_length(text).cast("long") + 1
    # of documents that repeat beyond a slot's mean bytes, n_slots at most, the repeats are told apart by where they are read
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    often = docs.groupBy(F.col("doc_id").alias("__id"), crc.alias("__crc")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") * n_slots > total)).select("__id", "__crc", F.lit(True).alias("__often"))
    marked = docs.drop("shard", "version", "virtual_slot").withColumn("__own", crc).join(F.broadcast(often), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__crc")), "left")
    repeat = F.when(F.col("__often"), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    slotted = materialize(marked.withColumn("virtual_slot", _slot(F.col("doc_id"), F.col("__own"), repeat, n_slots)).drop("__id", "__crc", "__often", "__own"), "op6-slotted")
    table = add_batch(docs.sparkSession, f"{path}/_map", slot_sizes(slotted.select("virtual_slot", (F.octet_length(F.coalesce(text_column(slotted), F.lit(""))).cast("long") + 1).alias("size"))), n_slots, n_shards)
    version = table.first()["version"]
    slotted.join(F.broadcast(table.select("virtual_slot", "shard")), "virtual_slot").repartition(  # n_slots rows
        F.col("shard"), F.col("virtual_slot") % 64
    ).write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/data/version={version}")
    return version


def moved(spark: SparkSession, path: str, old: int, new: int) -> DataFrame:
    """virtual_slot, from_shard, to_shard and n_bytes of the slots that two versions of the map at `path` place differently."""
    a, b = (read_map(spark, path, v) for v in (old, new))
    both = a.select("virtual_slot", F.col("shard").alias("from_shard")).join(b.select("virtual_slot", F.col("shard").alias("to_shard"), "n_bytes"), "virtual_slot")
    return both.where("from_shard <> to_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard(read_table(spark, sf_dir, "documents"), scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
