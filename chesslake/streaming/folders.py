"""Folders that PGN files arrive in.

Spark's own file stream tells each file once: its log, kept with the query's checkpoint, holds the files that were seen, so a query that is
stopped and started again goes on with the files that came meanwhile. Only names and sizes go through it; each batch's files are then read in ranges like any others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import pgn

SUFFIXES = "*.{pgn,pgn.zst}"
_FILES = "path string, modificationTime timestamp, length long, content binary"  # the content is not read


def arriving(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None], files_per_batch: int | None = None, range_bytes: int = pgn.RANGE_BYTES, **trigger) -> StreamingQuery:
    """Calls `each` with the games (as of `read_frames`) of the files that arrived since the last batch, and the batch's number.

    A file is read once, when it is first seen, so it has to appear whole (by a rename, as the writer of the format `pgn` does). A batch that was broken
    off is given again with the same number and files. `trigger` is that of a streaming query, `availableNow=True` if nothing is said.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true")
    if files_per_batch:
        files = files.option("maxFilesPerTrigger", files_per_batch)
    names = files.schema(_FILES).load(path).select("path", "length")

    def batch(arrived: DataFrame, number: int) -> None:
        listed = [(r["path"], r["length"]) for r in arrived.sort("path").toLocalIterator()]
        each(pgn.frames_of_files(arrived.sparkSession, listed, range_bytes), number)

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def collect_games(spark: SparkSession, path: str, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Keeps a Parquet folder of the games of all files that arrive, by batch; a batch given again replaces what it wrote."""

    def write(frames: DataFrame, number: int) -> None:
        frames.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    return arriving(spark, path, checkpoint, write, **options)


def collected(spark: SparkSession, table: str) -> DataFrame:
    """The games that `collect_games` has kept."""
    return spark.read.schema(pgn.FRAMES + ", batch long").parquet(table)
