"""Pages of a stored library against a sort of the whole."""

import pytest
from pyspark.sql import functions as F

from chesslake.operators import library
from chesslake.operators.library import SortedLibrary, page


@pytest.mark.parametrize("by, descending", [("date", True), ("player", False)])
def test_pages_are_those_of_the_whole_sort(spark, tmp_path, by, descending):
    """Two thirds of the games agree in the key, others have none; pages at any depth, over a range's end and past the last game."""
    k = F.col("id")
    games = spark.range(3000).select(
        k.alias("game_id"), F.when(k % 7 == 0, None).when(k % 3 == 0, (20000101 + k % 28).cast("int")).otherwise(F.lit(20200101)).alias("played_on"),
        F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 50).cast("string"))).otherwise("same").alias("white_key"), F.when(k % 5 == 0, None).otherwise(F.lit("b")).alias("black_key"),
    )
    stored = SortedLibrary(spark, str(tmp_path / "lib"), by, descending)
    stored.build(games, 100)
    whole = [r["game_id"] for r in page(games, by, descending, 200).collect()]
    assert [r["game_id"] for r in stored.page(200).collect()] == whole
    for limit, offset in ((50, 0), (200, 950), (7, 2999), (50, 1234), (10, 5000), (0, -5)):
        want = [r["game_id"] for r in page(games, by, descending, limit, offset).collect()]
        assert [r["game_id"] for r in stored.page(limit, offset).collect()] == want
    assert len(stored.ranges_of(50, 1500)) <= 3
    plan = stored.page(50, 1500)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(range" in plan or "PartitionFilters: [range" in plan
    with pytest.raises(Exception):
        stored.build(games)


def test_folders_are_bounded_and_hold_several_ranges(spark, tmp_path, monkeypatch):
    """Ranges keep their size when there are more of them than folders; pages are those of one sort."""
    monkeypatch.setattr(library, "MOST_FOLDERS", 3)
    none = F.lit(None).cast("int")
    games = spark.range(1000).select(F.col("id").alias("game_id"), F.when(F.col("id") % 9 > 0, (F.col("id") % 13).cast("int")).alias("played_on"), none.alias("white_elo"), none.alias("black_elo"))
    stored = library.SortedLibrary(spark, str(tmp_path / "lib"), "date")
    stored.build(games, 20)
    ranges = spark.read.parquet(str(tmp_path / "lib" / "ranges"))
    assert ranges.select("range").distinct().count() <= 3 and ranges.agg(F.max("n")).first()[0] <= 20 and ranges.count() >= 50
    whole = [r["game_id"] for r in games.orderBy(*library.order("date", True)).collect()]
    for offset in (0, 15, 333, 507, 990, 1000):
        assert [r["game_id"] for r in stored.page(35, offset).collect()] == whole[offset : offset + 35]
