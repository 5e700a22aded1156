"""Writing PGN folders: whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from chesslake.sources import remote
from chesslake.sources.pgn import read_frames


@pytest.fixture(scope="module")
def writing(spark):
    remote.register(spark)
    return lambda df, path, mode="append": df.write.format("pgn").mode(mode).save(str(path))


def games(spark, n, parts=3):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("game_id"), F.format_string("  [Site \"%d\"]\n\n1. e4 *\n", "id").cast("binary").alias("pgn"))


def test_a_folder_of_games_is_read_back(spark, tmp_path, writing):
    writing(games(spark, 50), tmp_path / "out")
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 3 and all(n.endswith(".pgn") for n in names) and os.listdir(tmp_path) == ["out"]
    frames = read_frames(spark, str(tmp_path / "out"))
    sites = [r["s"] for r in frames.select(F.regexp_extract(F.col("raw").cast("string"), "Site .([0-9]+)", 1).cast("int").alias("s"), "source", "source_game").orderBy("source", "source_game").collect()]
    assert sites == list(range(50))
    with pytest.raises(Exception, match="FileExistsError"):
        writing(games(spark, 1), tmp_path / "out")
    writing(games(spark, 2, 1), tmp_path / "out", "overwrite")
    assert len(os.listdir(tmp_path / "out")) == 1 and os.listdir(tmp_path) == ["out"]
    writing(games(spark, 0), tmp_path / "none")
    assert os.listdir(tmp_path / "none") == []


def test_a_failing_task_leaves_nothing(spark, tmp_path, writing):
    bad = games(spark, 40, 4).withColumn("pgn", F.when(F.col("game_id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("pgn")))
    with pytest.raises(Exception, match="broken"):
        writing(bad, tmp_path / "out")
    assert os.listdir(tmp_path) == []
