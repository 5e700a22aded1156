"""Pages of a library in its sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_PER_PAGE = 200


def order(by: str, descending: bool = True) -> list[Column]:
    """Sort keys; what is missing comes last in either direction, ids make the order total."""
    way = lambda c: F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
    newest = [F.col("played_on").desc_nulls_last(), F.desc("game_id")]
    if by == "date":
        return [way("played_on"), way("game_id")]
    if by == "rating":
        best = F.greatest(F.coalesce("white_elo", F.lit(-1)), F.coalesce("black_elo", F.lit(-1)))
        return [(best < 0).asc(), best.desc() if descending else best.asc(), *newest]
    if by == "result":
        return [(F.col("result") == 0).asc(), way("result"), *newest]
    if by == "player":
        return [way("white_key"), way("black_key"), *newest]
    raise ValueError(f"unknown order {by}")


def page(games: DataFrame, by: str = "date", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    return games.orderBy(*order(by, descending)).offset(max(0, offset)).limit(min(max(limit, 1), MOST_PER_PAGE))


#: Games in a range of a library stored in an order, about.
RANGE_GAMES = 50_000
#: The most folders of a stored library; the driver draws their bounds from so many keys for each. Above, a folder holds several ranges.
MOST_FOLDERS = 256


class SortedLibrary:
    """The games of a library stored in one of its orders, in ranges with their counts, so that a page reads the ranges that it lies in.

    The order is total (ids end it), so games that agree in the rest of the key are split over ranges like any others.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "date", descending: bool = True):
        self.spark, self.path, self.by, self.descending = spark, path.rstrip("/"), by, descending

    def build(self, games: DataFrame, range_games: int = RANGE_GAMES) -> None:
        """Write the games in order; an existing library is an error."""
        keys = order(self.by, self.descending)
        folders = min(max(1, -(-games.count() // range_games)), MOST_FOLDERS)
        at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its sorted part
        ordered = games.repartitionByRange(folders, *keys).sortWithinPartitions(*keys).withColumns({"part": F.floor(at / range_games), "range": F.spark_partition_id()})
        ordered.write.mode("errorifexists").partitionBy("range").parquet(f"{self.path}/games")
        counts = self.spark.read.parquet(f"{self.path}/games").groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        counts.select("range", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).coalesce(1).write.parquet(f"{self.path}/ranges")

    def ranges_of(self, limit: int, offset: int) -> list[tuple[int, int, int]]:
        """(folder, range in it, place of its first game) of the ranges that hold some of the places offset to offset + limit - 1."""
        own = self.spark.read.parquet(f"{self.path}/ranges").where((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset))
        return sorted((r["range"], r["part"], r["first"]) for r in own.collect())  # a page lies in a few

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """The games of a page, as `page` gives them for the whole library; what is skipped within its first range is less than a range."""
        limit, offset = min(max(limit, 1), MOST_PER_PAGE), max(0, offset)
        held = self.ranges_of(limit, offset)
        games = self.spark.read.parquet(f"{self.path}/games")
        chosen = F.lit(False)
        for folder in sorted({r for r, _, _ in held}):
            parts = [p for r, p, _ in held if r == folder]
            chosen |= (F.col("range") == folder) & F.col("part").between(min(parts), max(parts))
        own = games.where(chosen).drop("range", "part")
        return own.orderBy(*order(self.by, self.descending)).offset(offset - held[0][2] if held else 0).limit(limit)


def ranked(rows: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Rows of a page with their place; only for pages, which are small."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order(by, descending))))


def in_order(ids: DataFrame, games: DataFrame) -> DataFrame:
    """Games of a list of ids (place, game_id), in the list's order."""
    return ids.join(games, "game_id").orderBy("place")


def retained_then_recent(retained: DataFrame, recent: DataFrame, most: int = 6) -> DataFrame:
    """Retained ids in their order, then recent ones not among them, `most` in all (both have place, game_id)."""
    fresh = recent.join(retained, "game_id", "left_anti")
    both = retained.select("game_id", F.lit(0).alias("tier"), "place").unionByName(fresh.select("game_id", F.lit(1).alias("tier"), "place"))
    return both.orderBy("tier", "place").limit(most)


def page_with_total(games: DataFrame, by: str = "date", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page's games with `total`, the number of all games that match."""
    total = games.agg(F.count(F.lit(1)).alias("total"))
    return page(games, by, descending, limit, offset).crossJoin(F.broadcast(total))  # one row


MOST_RECENT = 12


def recent_libraries(opened: DataFrame, most: int = MOST_RECENT) -> DataFrame:
    """The paths opened last, each once, newest first, `most` in all: place, path and the state of sync and review last told for each.

    `opened` has path, seq, sync and review; a null state leaves what was told before.
    """
    told = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    last = opened.groupBy("path").agg(F.max("seq").alias("seq"), told("sync"), told("review")).orderBy(F.desc("seq")).limit(most)
    return last.select(F.row_number().over(Window.orderBy(F.desc("seq"))).alias("place"), "path", "sync", "review")  # `most` rows
