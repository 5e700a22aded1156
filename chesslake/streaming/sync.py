"""Arrivals of games by id: idempotent upserts, cursors, and the streaming job around them.

The rules are one DataFrame plan, `actions`, used over a whole log of arrivals or per micro-batch. The
stream keeps the games as a table in versions: a batch publishes the next version under the name of its query and batch, which
makes a repeated batch harmless.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.publish import PublishedMeanwhile, States

OVERLAP_MS = 300_000
AUTO_SYNC_MS = 15 * 60_000


def actions(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """created, updated or unchanged for every arrival (seq, remote_id, content), against what came before it."""
    before = F.lag("content").over(Window.partitionBy("remote_id").orderBy("seq"))
    rows = arrivals.withColumn("before", before).withColumn("first", F.lag("seq").over(Window.partitionBy("remote_id").orderBy("seq")).isNull())
    if stored is not None:
        old = stored.select("remote_id", F.col("content").alias("old"), F.lit(True).alias("known"))
        rows = rows.join(old, "remote_id", "left").withColumn("before", F.when(F.col("first"), F.col("old")).otherwise(F.col("before"))).withColumn("first", F.col("first") & F.col("known").isNull())
    action = F.when(F.col("first"), "created").when(F.col("content").eqNullSafe(F.col("before")), "unchanged").otherwise("updated")
    return rows.withColumn("action", action).drop("before", "first", "old", "known")


def summary(acted: DataFrame) -> DataFrame:
    """Arrivals by action, and the results of those created."""
    c = lambda name: F.count_if(F.col("action") == name).alias(name)
    results = [F.count_if((F.col("action") == "created") & (F.col("player_result") == r)).alias(f"created_{r}") for r in ("win", "draw", "loss", "unfinished")]
    return acted.agg(F.count(F.lit(1)).alias("received"), c("created"), c("updated"), c("unchanged"), *results)


def latest(arrivals: DataFrame) -> DataFrame:
    """The last content and status of every id."""
    return arrivals.groupBy("remote_id").agg(F.max_by("content", "seq").alias("content"), F.max_by("unfinished", "seq").alias("unfinished"))


def plan(cursor_ms: int | None, initial_since: int | None, since: int | None, now_ms: int) -> dict:
    """What to ask for: everything from the stored first day (yyyymmdd) on while there is no cursor, then from shortly before the cursor.

    Until a first sync has ended, another first day than the stored one is refused; afterwards it has no say.
    """
    if cursor_ms is None:
        if since is not None and since != initial_since:
            raise ValueError("the first sync was begun with another since")
        return {"kind": "initial", "since": initial_since, "until": now_ms}
    return {"kind": "incremental", "since_ms": min(max(cursor_ms - OVERLAP_MS, 0), now_ms), "until": now_ms}


def is_due(last_ms: int | None, now_ms: int) -> bool:
    """A first sync, fifteen minutes gone by, or a clock that went back."""
    return last_ms is None or now_ms < last_ms or now_ms - last_ms >= AUTO_SYNC_MS


def due(last_ms, now_ms):
    """`is_due` as a column."""
    return last_ms.isNull() | (now_ms < last_ms) | (now_ms - last_ms >= AUTO_SYNC_MS)


class GameTable:
    """The games of a sync as Parquet folders, one a version; the highest published one is current.

    A version is published with the batch that made it, as `sources.publish` tells: a batch that runs again, after a failure or with the same
    checkpoint, finds its version done; of two writers that saw the same newest version one is told so and folds its batch into the other's. Rows lie in
    `buckets` by a hash of the id; a batch writes the buckets that it touches and the others are read from the versions that hold them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._published = States(spark, self.path, "current=")

    def _versions(self) -> dict[int, tuple[str, str]]:
        """Published versions: number to (folder, batch)."""
        told = {n: self._published.read(n) for n in self._published.numbers()}
        return {n: tuple(text.split(" ", 1)) for n, text in told.items() if text is not None}

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The games as of a version, the newest by default: every bucket from the last version that wrote it."""
        found = {v: name for v, (name, _) in self._versions().items() if version is None or v <= version}
        if not found:
            return None
        rows = self.spark.read.schema("remote_id string, content string, unfinished boolean, seq long, bucket int, version int, bucket_rows boolean").parquet(*(f"{self.path}/{name}" for name in found.values()))
        newest = rows.where("NOT bucket_rows").groupBy("bucket").agg(F.max("version").alias("newest"))
        held = rows.where("bucket_rows").join(F.broadcast(newest), "bucket")  # as many rows as buckets
        return held.where("version = newest").select("remote_id", "content", "unfinished", "seq")

    def upsert(self, batch: DataFrame, batch_id: int, query: str = "batch") -> None:
        """For foreachBatch: fold a batch into the newest version. The latest arrival of an id (by seq) counts, in a batch and against the table."""
        label, bucket = f"{query}-{batch_id}", F.pmod(F.xxhash64("remote_id"), F.lit(self.buckets)).cast("int")
        latest_of = lambda rows: rows.groupBy("remote_id").agg(F.max_by(F.struct("content", "unfinished", "seq"), "seq").alias("g")).select("remote_id", "g.*")
        new = latest_of(batch)
        touched = new.select(bucket.alias("bucket")).distinct()
        while True:
            done = self._versions()
            if any(name == label for _, name in done.values()):
                return
            old, rows = self.read(), new
            if old is not None:
                kept = old.withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")  # as many rows as buckets
                rows = latest_of(kept.unionByName(new.select(*kept.columns)))
            at = self._published.next_number()
            folder = f"version={at}.{uuid.uuid4().hex}"
            rows = rows.select("*", bucket.alias("bucket"), F.lit(at).alias("version"), F.lit(True).alias("bucket_rows"))
            marks = touched.select(*(F.lit(None).cast(t).alias(c) for c, t in (("remote_id", "string"), ("content", "string"), ("unfinished", "boolean"), ("seq", "long"))), "bucket", F.lit(at).alias("version"), F.lit(False).alias("bucket_rows"))
            rows.unionByName(marks).write.mode("errorifexists").parquet(f"{self.path}/{folder}")
            try:
                return self._published.publish(at, f"{folder} {label}")
            except PublishedMeanwhile:
                continue  # onto the version that came between


def start(arrivals: DataFrame, table: GameTable, checkpoint: str):
    """The streaming query; its checkpoint commits the cursor after each batch's version is whole."""
    name = hashlib.sha256(f"{checkpoint}/{_checkpoint_id(table, checkpoint)}".encode()).hexdigest()[:12]
    return arrivals.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _checkpoint_id(table: GameTable, checkpoint: str) -> str:
    """A name that a checkpoint keeps for life: a folder that is removed and made again gets another."""
    at = table.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/_games_id")
    store = at.getFileSystem(table.spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        out = store.create(at, False)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    file = store.open(at)
    name = file.readUTF()
    file.close()
    return name
