"""Work is dealt over the cores whatever the files look like, and numbers of games are told without sorting whole sources."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chesslake import adapters
from chesslake.plans import different_games


def test_numbers_equal_one_sort_of_each_group(spark):
    rows = spark.range(0, 60_000, 7).select(F.when(F.col("id") % 5 > 0, "a").when(F.col("id") % 3 > 0, "b").alias("source"), (F.col("id") * F.col("id") % 100_003 - 40_000).alias("k")).distinct()
    rows = rows.union(spark.createDataFrame([("a", 1 << 40), ("lone", -(1 << 40))], "source string, k long"))
    told = adapters.number_rows(rows, "source", "k").withColumn("whole", F.row_number().over(Window.partitionBy("source").orderBy("k")))
    assert told.where("source_game <> whole OR source_game IS NULL").count() == 0
    assert told.count() == rows.count()
    assert told.schema["source_game"].dataType.simpleString() == "int"


def test_games_keep_their_numbers(spark, sf):
    columns = ("game_id", "source", "source_game", "white", "result", "movetext")
    one, other = (adapters.raw_games(spark, sf, numbered).select(*columns) for numbered in (True, False))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_one_part_of_a_file_is_shared_by_the_cores(spark, sf):
    assert spark.read.parquet(f"{sf}/orders.parquet").rdd.getNumPartitions() == 1
    for rows in (different_games.pawn_games(spark, sf), different_games.pawn_games(spark, sf, True), adapters.raw_games(spark, sf), adapters.raw_games(spark, sf, True)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_random_games_are_made_once_by_all_cores(spark, sf, monkeypatch):
    given, make = [], different_games.synthetic.random_games

    def told(ids, *more):
        given.append(ids.select(F.spark_partition_id().alias("p")).distinct().count())
        return make(ids, *more)

    monkeypatch.setattr(different_games.synthetic, "random_games", told)
    rows = different_games.random_games_sound(spark, sf)
    assert len(given) == 1 and given[0] >= 4
    assert "game_id#" in rows._jdf.queryExecution().toString() and "random-" in "".join(rows.inputFiles())
