"""Findings of round 4: results on odd inputs, and steps that grow no faster than their input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chesslake.kernel import pgn as P
from chesslake.kernel.board import START_FEN
from chesslake.operators import doctor, store
from chesslake.operators.query import GameQuery
from chesslake.plans import different_games, registry
from chesslake.sources import pgn, synthetic


@pytest.mark.parametrize("raw", [b"", b" ", b"\n\t \r\n\x0c"])
def test_a_blank_text_is_no_game(raw):
    fault = {"kind": "missing_outcome", "offset": len(raw)}
    assert P.parse_game(raw)["error"] == P.count_game(raw)["error"] == fault
    assert P.parse_game(raw)["outcome"] is None
    assert P.parse_game(raw, strict=False)["error"] is None and not list(P.events(raw))  # a source may be empty


def test_hostile_input_counts_blank_texts(spark, tmp_path):
    import duckdb

    texts = ["", " ", "\n\n", "A word.", "{", "1. e4 $$$", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.hostile_input(spark, str(tmp_path)).first()
    told = duckdb.sql(registry.SQL["hostile_input"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()[0]
    assert tuple(got) == told == (6, 6, 0, 0)


def test_games_are_made_in_few_rounds(monkeypatch):
    """Few games are still without a move after some draws; they don't cost a round each. The games are those of one draw after the other."""
    rounds, draw = [], synthetic._draw
    monkeypatch.setattr(synthetic, "_draw", lambda words, noise: rounds.append(len(words)) or draw(words, noise))
    made = list(synthetic.play_games(np.arange(300, 500), 40, 0))
    assert len(rounds) <= 44 * 2 * 9  # 40 plies, of which 4 have variations
    assert hashlib.sha256(b"".join(g["pgn"] for g in made)).hexdigest() == "bfa5da8e24486acf838133913fbbc7fb9a73d2b70f0afc7998d09edec8639214"


@pytest.mark.parametrize("seed", [0, 1])
def test_drawn_bits_are_the_nth(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    words[:3] = 0, (1 << 64) - 1, 1 << 63
    noise = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for word, n, got in zip(words.tolist(), noise.tolist(), synthetic._draw(words, noise).tolist()):
        bits = [1 << k for k in range(64) if word >> k & 1]
        assert got == (bits[n % len(bits)] if bits else 0)


def test_games_with_a_number_before_every_move_are_told_by_their_words(monkeypatch):
    game = b'[Result "*"]\n\n1. e4 {a} 1... e5 {b} 2. Nf3 {c} %s Nc6 {d} *\n\n'
    assert doctor.validate(game % b"3...") == doctor._walked(game % b"3...", True) and doctor.validate(game % b"3...")["fault"][0] == "incorrect_move_number"
    whole = doctor._walked(game % b"2...", True)

    class Never:
        def finditer(self, text):
            raise AssertionError("read word by word")

    monkeypatch.setattr(doctor, "_PART", Never())
    assert doctor.validate(game % b"2...") == whole and whole["fault"] is None and whole["moves"] == 4


def _database(spark, rows, path, keyed):
    db = store.Database(spark, path)
    games = rows.select("game_id", "source", "source_game", "pgn", "result", *(["keys"] if keyed else []))
    db.build(games, *([] if keyed else [rows.select("game_id", "source", F.posexplode("keys").alias("ply", "position_key"))]))
    return db


@pytest.mark.parametrize("slice_", [1000, store.SLICE])
def test_a_database_of_games_with_keys_is_that_of_their_positions(spark, sf, tmp_path, monkeypatch, slice_):
    """Positions are told from the games' keys, in slices of the keys: nothing is held a second time, and all are there."""
    rows = pgn.with_position_keys(different_games._lines(spark, sf, numbered=True)).where("game_id % 10 = 0").persist()
    one = _database(spark, rows, f"{tmp_path}/one", keyed=False)
    monkeypatch.setattr(store, "SLICE", slice_)
    kept = []
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: kept.append(level) or df)
    two = _database(spark, rows, f"{tmp_path}/two", keyed=True)
    assert not kept
    fields = ("position_key", "game_id", "ply", "source")
    a, b = one.positions().select(*fields), two.positions().select(*fields)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and b.count() == rows.agg(F.sum(F.size("keys"))).first()[0]
    for scope in store.SCOPES:
        a, b = one.openings(scope), two.openings(scope)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not b.isEmpty()
    bounds = sorted((bytes(r["low"]), bytes(r["high"])) for r in spark.read.parquet(f"{two.path}/bounds").collect())
    firsts = {low[0] for low, _ in bounds}
    assert all(high <= low for (_, high), (low, _) in zip(bounds, bounds[1:])) and len(firsts) >= (4 if slice_ == 1000 else 1)
    assert "keys" not in two.games().columns and two.query(GameQuery(position=START_FEN)).count() == rows.count()


def test_pawn_games_are_written_side_by_side(spark, sf):
    """The texts are those that the column expressions gave; the plan has none of their array functions left."""
    games = different_games.pawn_games(spark, sf)
    plan = games._jdf.queryExecution().toString()
    assert "transform(" not in plan and "MapInArrow" in plan
    texts = b"".join(bytes(r["pgn"]) for r in games.orderBy("id").collect())
    assert hashlib.sha256(texts).hexdigest() == "445da6658087ac5ea3fdb1404e49c7a31dd074ba93e637ea7bcab6982388af05"
    assert different_games._pawn_texts(np.zeros(0, np.int64)).to_pylist() == []


def test_many_small_ranges_share_tasks(spark, tmp_path):
    """However small the ranges, tasks are bounded by the cores; ranges, games and their numbers stay the same."""
    import zstandard

    games = [b'[Site "%d"]\n\n1. e4 {%s} e5 *\n\n' % (i, b"x" * (i % 50)) for i in range(900)]
    (tmp_path / "many.pgn.zst").write_bytes(b"".join(zstandard.compress(b"".join(games[i : i + 3])) for i in range(0, 900, 3)))
    (tmp_path / "plain.pgn").write_bytes(b"".join(games))
    files = pgn.discover(spark, str(tmp_path))
    plan = pgn.plan_ranges(spark, files, 50)
    assert plan.count() > 300
    assert plan.rdd.getNumPartitions() <= pgn._TASKS_A_CORE * spark.sparkContext.defaultParallelism
    rows = lambda n: pgn.frames_of_files(spark, files, n).orderBy("source", "source_game").collect()
    assert rows(50) == rows(1 << 30) and len(rows(50)) == 1800


def test_zstd_games_are_put_in_order_before_they_are_written(spark, sf):
    games = different_games.pawn_games(spark, sf, ordered=5)
    parts = games.select(F.spark_partition_id().alias("p"), "id").collect()
    assert len({r["p"] for r in parts}) == 5 and [r["id"] for r in sorted(parts, key=lambda r: r["p"])] == sorted(r["id"] for r in parts)
    plan = games._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
    read = different_games.pawn_games_zstd(spark, sf)
    assert any("told-" in f for f in read.inputFiles()) and [r["numbered"] for r in read.collect()] == [True] * 5
