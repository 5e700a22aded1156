"""States that appear whole or not at all, look-ups that read few files, and batches that meet."""

import os

import pytest
from pyspark.sql import functions as F

from chesslake.kernel.board import Board
from chesslake.operators.query import GameQuery
from chesslake.operators.store import Database
from chesslake.plans import different_games
from chesslake.sources import publish
from chesslake.streaming import sync
from chesslake.streaming.collection import Collection

GAMES = "game_id long, source string, source_game long, pgn binary, white string, result int, played_on int, mainline_plies long"
POSITIONS = "position_key binary, game_id long, ply int, source string"


def small(spark, name, game_id):
    games = spark.createDataFrame([(game_id, name, 1, bytearray(b"1. e4 *"), "x", 1, 20200101, 1)], GAMES)
    return games, spark.createDataFrame([(Board().key(), game_id, 0, name)], POSITIONS)


def test_a_database_survives_states_cut_short(spark, tmp_path):
    """An empty state (a writer that died) hides nothing and blocks nothing; neither does a claim without a state."""
    db = Database(spark, str(tmp_path / "db"))
    db.build(*small(spark, "a", 1))
    (tmp_path / "db" / "state=2").write_bytes(b"")
    assert db.manifest().count() == 1 and db.games().count() == 1
    db.update(*small(spark, "b", 2))
    assert {r["source"] for r in db.games().collect()} == {"a", "b"} and db._state()[0] == 3
    claim = tmp_path / "db" / ".claim-4"
    claim.write_bytes(b"")
    with pytest.raises(publish.PublishedMeanwhile):  # perhaps another writer is at work
        db.update(*small(spark, "c", 3))
    os.utime(claim, (1, 1))  # it is not
    db.update(*small(spark, "c", 3))
    assert {r["source"] for r in db.games().collect()} == {"a", "b", "c"}


def test_states_of_a_collection_cut_short(spark, tmp_path):
    own = Collection(spark, str(tmp_path / "c"))
    own.prepare("Someone", 1000)
    (tmp_path / "c" / "_state=2").write_bytes(b"\x00")
    assert own.state()["username"] == "Someone"
    own.write_state(own.state() | {"cursor_ms": 5})
    assert own.state()["cursor_ms"] == 5


def test_batches_that_meet_and_late_arrivals(spark, tmp_path):
    schema = "seq long, remote_id string, content string, unfinished boolean, player_result string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table, other = sync.GameTable(spark, str(tmp_path / "g")), sync.GameTable(spark, str(tmp_path / "g"))
    table.upsert(rows((10, "a", "new", False, "win")), 0, "q0")
    # both writers saw version 1: the second to publish folds its batch into the first's
    seen, first = other._published.next_number, []

    def stale():
        if not first:
            first.append(True)
            number = seen()
            table.upsert(rows((11, "b", "mine", False, "win")), 0, "q1")
            return number
        return seen()

    other._published.next_number = stale
    other.upsert(rows((12, "c", "theirs", False, "win")), 0, "q2")
    contents = lambda: {r["remote_id"]: r["content"] for r in table.read().collect()}
    assert contents() == {"a": "new", "b": "mine", "c": "theirs"}
    table.upsert(rows((5, "a", "old", False, "win"), (13, "d", "x", False, "win")), 1, "q0")
    assert contents() == {"a": "new", "b": "mine", "c": "theirs", "d": "x"}


def test_a_look_up_reads_the_files_that_may_hold_its_key(spark, tmp_path):
    games = spark.range(3000).select(F.col("id").alias("game_id"), F.lit("s").alias("source"), (F.col("id") + 1).alias("source_game"), F.lit(bytearray(b"1. e4 *")).alias("pgn"), F.lit("w").alias("white_key"), F.lit(None).cast("string").alias("black_key"), F.lit(1).alias("result"))
    own = F.unhex(F.substring(F.sha2(F.concat_ws("/", "game_id", "ply"), 256), 1, 32))
    start = Board().key()
    rows = games.select("game_id", "source", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("ply"))
    positions = rows.select(F.when(F.col("ply") == 0, F.lit(start)).otherwise(own).alias("position_key"), "game_id", "ply", "source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        db = Database(spark, str(tmp_path / "db"))
        db.build(games, positions)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = len([n for n in os.listdir(next((tmp_path / "db" / "positions").iterdir())) if n.endswith(".parquet")])
    assert files >= 12
    some = positions.where("game_id = 777 AND ply = 9").first()["position_key"]
    assert 1 <= len(db.files_of(bytes(some))) <= 2
    assert [(r["game_id"], r["ply"]) for r in db.visits(bytes(some)).collect()] == [(777, 9)]
    assert db.visits(bytes(16)).count() == 0 and len(db.files_of(b"\xff" * 16)) == 0
    assert db.query(GameQuery(position=Board().fen())).count() == 3000  # a key that every game has
    assert "PushedFilters: [IsNotNull(position_key), EqualTo(position_key" in db.visits(bytes(some))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_look_ups_follow_updates(spark, tmp_path):
    """Games of a source that is replaced are found no more by what they had before."""
    db = Database(spark, str(tmp_path / "db"))
    games, positions = small(spark, "a", 1)
    db.build(games, positions)
    assert db.visits(Board().key()).count() == 1
    moved = Board("4k3/8/8/8/8/8/8/4K3 w - - 0 1").key()
    db.update(games.withColumn("pgn", F.lit(bytearray(b"1. d4 *"))), positions.withColumn("position_key", F.lit(moved)))
    assert db.visits(Board().key()).count() == 0 and db.visits(moved).count() == 1


def test_pawn_games_differ(spark, sf):
    rows = different_games.pawn_games(spark, sf)
    assert rows.select("pgn").distinct().count() == rows.count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_the_opening_tree_follows_updates(spark, tmp_path):
    """After a build and three updates the tree equals a count over the stored positions, which it does not read."""
    rng = __import__("random").Random(6)

    def corpus(names, seed):
        games, positions = [], []
        for name in names:
            for k in range(rng.randint(3, 9)):
                game_id = hash((name, k)) % 10**9
                games.append((game_id, name, k + 1, bytearray(f"1. e4 {seed} {k} *".encode()), "w", rng.randint(0, 3), 20200101, 50))
                positions += [(bytes([rng.randint(0, 6)] * 16), game_id, ply, name) for ply in range(0, 45)]
        return spark.createDataFrame(games, GAMES), spark.createDataFrame(positions, POSITIONS)

    db = Database(spark, str(tmp_path / "db"))
    db.build(*corpus("abc", 1))
    for names, seed in (("bd", 2), ("a", 3), ("cde", 4)):
        db.update(*corpus(names, seed))
        results = db.games().select("game_id", "result")
        for scope, (low, high) in (("opening", (4, 4)), ("recurring", (8, 40))):
            once = db.positions().where(F.col("ply").between(low, high)).select("position_key", "game_id").distinct().join(results, "game_id")
            want = once.groupBy("position_key").agg(F.count(F.lit(1)), F.count_if(F.col("result") == 1), F.count_if(F.col("result") == 3), F.count_if(F.col("result") == 2), F.count_if(F.col("result") == 0))
            tree = db.openings(scope)
            assert {bytes(r[0]): tuple(r)[1:] for r in tree.collect()} == {bytes(r[0]): tuple(r)[1:] for r in want.collect()}
            assert not any("/positions/" in f for f in tree.inputFiles())
