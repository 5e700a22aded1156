"""Corpus statistics. Every function gives additive counters, by source or over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def core(games: DataFrame, *by: str) -> DataFrame:
    c = lambda code: F.count_if(F.col("result") == code)
    return games.groupBy(*by).agg(
        F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("mainline_plies"), F.lit(0)).alias("plies"), c(1).alias("white_wins"), c(2).alias("black_wins"), c(3).alias("draws"),
        c(0).alias("unfinished"), F.min("mainline_plies").alias("min_plies"), F.coalesce(F.avg("mainline_plies"), F.lit(0.0)).alias("avg_plies"), F.max("mainline_plies").alias("max_plies"),
    )


def _counts(rows: DataFrame, name, order: list[str], value: str) -> DataFrame:
    """One row per name of `order`, zero counts included."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(order)], f"place int, {value} string")
    found = rows.select(name.alias(value)).groupBy(value).agg(F.count(F.lit(1)).alias("games"))
    return names.join(F.broadcast(found), value, "left").select("place", value, F.coalesce("games", F.lit(0)).alias("games"))  # found has as many rows as names


def lengths(games: DataFrame) -> DataFrame:
    return _counts(games, C.length_bucket(F.col("mainline_plies")), [n for _, n in C.LENGTH_BUCKETS], "bucket")


def time_controls(games: DataFrame) -> DataFrame:
    return _counts(games, C.time_control(F.col("time_control")), list(C.TIME_CONTROLS), "kind")


def headers(games: DataFrame, columns: dict[str, str]) -> DataFrame:
    """How many games have each header; `columns` maps headers to columns."""
    return games.agg(*(F.count(c).alias(name) for name, c in columns.items()))


def dates(games: DataFrame) -> DataFrame:
    """Days of the games, from the raw value of Date or, where that is absent, UTCDate; only dotted dates count.

    Raw values stand in `raw_date_tag` and `raw_utc_date`, or both in `raw_date`; a library without them has `date_text`.
    """
    c = games.columns
    raw = F.coalesce("raw_date_tag", "raw_utc_date") if "raw_date_tag" in c else F.col("raw_date" if "raw_date" in c else "date_text")
    day = C.parse_date(raw, dashes=False)
    return games.select(raw.alias("raw"), day.alias("day")).agg(
        F.count("day").alias("complete"), F.count_if(F.col("raw").isNotNull() & F.col("day").isNull()).alias("incomplete_or_invalid"),
        F.count_if(F.col("raw").isNull()).alias("missing"), F.min("day").alias("earliest"), F.max("day").alias("latest"),
    )


def merged(reports: DataFrame, *by: str) -> DataFrame:
    """Core reports of parts (sources, days) as the report of their whole: counters add up, averages are weighted anew."""
    added = ["games", "plies", "white_wins", "black_wins", "draws", "unfinished"]
    out = reports.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in added), F.min("min_plies").alias("min_plies"), F.max("max_plies").alias("max_plies"))
    return out.select(*by, *added, "min_plies", F.when(F.col("games") > 0, F.col("plies") / F.col("games")).otherwise(0.0).alias("avg_plies"), "max_plies")


def _ratings(games: DataFrame) -> DataFrame:
    both = games.select(F.explode(F.array("white_elo_text", "black_elo_text")).alias("text"))
    return both.withColumn("rating", C.parse_u32(F.col("text")))


def ratings(games: DataFrame) -> DataFrame:
    return _ratings(games).agg(
        F.count("rating").alias("numeric"), F.count_if(F.col("text").isNotNull() & F.col("rating").isNull()).alias("invalid"), F.count_if(F.col("text").isNull()).alias("missing"),
        F.min("rating").alias("lowest"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average"), F.max("rating").alias("highest"),
    )


def rating_bands(games: DataFrame) -> DataFrame:
    return _counts(_ratings(games).where("rating IS NOT NULL"), C.rating_band(F.col("rating")), [n for _, n in C.RATING_BANDS], "band")


def before_first_error(games: DataFrame) -> DataFrame:
    """The games of each source that precede its first game with an error."""
    failed = games.where("error IS NOT NULL").groupBy("source").agg(F.min("source_game").alias("first_error"))
    return games.join(failed, "source", "left").where("first_error IS NULL OR source_game < first_error").drop("first_error")


def batch_status(per_source: DataFrame) -> DataFrame:
    """Sources by status (0 valid, 1 invalid, 3 error) and the exit status, the worst of them."""
    c = lambda code: F.count_if(F.col("status") == code)
    return per_source.agg(F.count(F.lit(1)).alias("sources"), c(0).alias("valid"), c(1).alias("invalid"), c(3).alias("errors"), F.coalesce(F.max("status"), F.lit(0)).alias("exit_status"))


def first_error(games: DataFrame) -> DataFrame:
    """The earliest error of each source, whatever task met it first."""
    return games.where("error IS NOT NULL").groupBy("source").agg(F.min("source_game").alias("source_game"), F.min_by("error", "source_game").alias("error"))
