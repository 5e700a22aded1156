import os

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from chesslake.functions import columns as C
from chesslake.kernel import pgn as P
from chesslake.operators import doctor, evidence, explore, library, stats, store
from chesslake.operators.query import GameQuery, count_unless_failed, match_records, summary
from chesslake.operators.store import Database
from chesslake.plans import registry
from chesslake.sources import pgn
from chesslake.streaming import sync

TWO = b'[White "Alice"]\n[Black "Bob"]\n[Date "2020.01.02"]\n[WhiteElo "1500"]\n\n1. e4 e5 2. Nf3 1-0\n\n[White "bob"]\n[Black "Carol"]\n[UTCDate "2021.03.04"]\n[BlackElo "x"]\n\n1. d4 d5 0-1\n'


def one(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_scalar_functions(spark):
    assert one(spark, C.time_control, ["300", "180+2", "40/7200", "40/7200:3600+30", "*60", "?", "-", "", "40/0", "40/7200:", None, "0", "5+", "99999999999"]) == [
        "sudden_death", "increment", "moves_in_seconds", "multi_stage", "hourglass", "unknown", "unlimited", "invalid", "invalid", "invalid", "missing", "invalid", "invalid", "invalid",
    ]
    assert one(spark, C.parse_date, ["2020.02.29", "2019.02.29", "2020-01-05", "2020.01-05", "0000.01.01", "????.??.??", "2020.01.05\n", "2020.13.01", None, "1900.02.29"]) == [20200229, None, 20200105, None, None, None, None, None, None, None]
    assert one(spark, lambda c: C.parse_date(c, dashes=False), ["2020-01-05", "2020.01.05"]) == [None, 20200105]
    assert one(spark, C.parse_u32, ["0", "007", "4294967295", "4294967296", "+1", " 1", "", "1\n", "00000000000004294967295", None]) == [0, 7, 4294967295, None, None, None, None, None, 4294967295, None]
    assert one(spark, C.ascii_fold, ["ÀBÉ", "zZ"]) == ["ÀbÉ", "zz"]
    assert one(spark, C.length_bucket, [0, 1, 20, 21, 60, 61, 80, 81, 120, 160, 161], "long") == ["0", "1-20", "1-20", "21-40", "41-60", "61-80", "61-80", "81-120", "81-120", "121-160", "161+"]
    assert one(spark, C.rating_band, [0, 999, 1000, 1199, 2399, 2400], "long") == ["<1000", "<1000", "1000-1199", "1000-1199", "2200-2399", "2400+"]
    assert one(spark, C.github_escape, ["a%b\r\nc:d,"]) == ["a%25b%0D%0Ac:d,"]
    assert one(spark, lambda c: C.github_escape(c, True), ["c:d,"]) == ["c%3Ad%2C"]
    assert one(spark, C.remote_game_id, ["https://lichess.org/abCD1234/black", "http://lichess.org/abCD1234", "https://lichess.org/short"]) == ["abCD1234", None, None]
    assert one(spark, C.id_filename, ["abCD1234"]) == ["6162434431323334.pgn"]
    assert one(spark, C.month_label, [202103], "int") == ["Mar ’21"]
    assert one(spark, C.is_username, ["ab", "a", "a b", None]) == [True, False, False, False]
    assert one(spark, lambda c: C.progress_percent(c, F.lit(0), F.lit(200)), [0, 100, 200, None], "long") == [1.0, 50.0, 98.0, None]
    assert one(spark, C.move_text, [["e4", "e5", "Nf3"], []], "array<string>") == ["1. e4 e5 2. Nf3", ""]
    assert one(spark, C.date_to_ms, [20200101, 20000101], "int") == [1577836800000, C.ARCHIVE_START_MS]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pgn")
    (root / "a.pgn").write_bytes(TWO)
    (root / "deep").mkdir()
    (root / "deep" / "b.PGN.zst").write_bytes(zstandard.compress(TWO[:100] + b"\n\n1. a3 *") + zstandard.compress(b"\n1. e4"))
    (root / "notes.txt").write_text("1. e4 *")
    return root


def loaded(spark, folder):
    rows = pgn.game_rows(pgn.parse_games(pgn.read_frames(spark, str(folder))))
    return rows.withColumn("game_id", F.xxhash64("source", "source_game"))


def test_files_become_games(spark, folder):
    frames = pgn.read_frames(spark, str(folder)).collect()
    names = sorted((os.path.basename(f["source"]), f["source_game"], f["error"]) for f in frames)
    assert names[:2] == [("a.pgn", 0, None), ("a.pgn", 1, None)] and names[-1][0] == "b.PGN.zst" and names[-1][2] == "missing_outcome"
    rows = {(r["white"], r["black"]): r for r in loaded(spark, folder).where("frame_error IS NULL AND source LIKE '%a.pgn'").collect()}
    assert rows["Alice", "Bob"]["played_on"] == 20200102 and rows["Alice", "Bob"]["white_elo"] == 1500 and rows["Alice", "Bob"]["result"] == 1
    assert rows["bob", "Carol"]["played_on"] == 20210304 and rows["bob", "Carol"]["black_elo"] is None and rows["bob", "Carol"]["white_key"] == "bob"


def test_large_files_are_read_in_ranges(spark, tmp_path):
    """Ranges give the games, places and lines of the file read whole; so does a file whose comments look like games."""
    import random

    rng = random.Random(4)
    game = lambda i: f'[Event "E{i}"]\n[White "w{rng.randint(0, 9)}"]\n\n1. e4 {{note {i}}} e5 2. Nf3 {"1-0" if i % 2 else "*"}\n\n'
    plain = "".join(game(i) for i in range(500)).encode()
    (tmp_path / "plain.pgn").write_bytes(plain)
    (tmp_path / "tricky.pgn").write_bytes(b'[Event "A"]\n\n1. e4 {' + b'x\n1-0\n\n[Event "no game"]\n\n' * 200 + b'} e5 1-0\n\n' + plain[:3000])
    (tmp_path / "same.pgn.zst").write_bytes(zstandard.compress(plain))
    key = lambda rows: sorted((r["source"].rsplit("/", 1)[1], r["source_game"], r["byte_offset"], bytes(r["raw"]), r["error"], r["first_line"]) for r in rows)
    whole = key(pgn.read_frames(spark, str(tmp_path)).collect())
    assert whole == key(pgn.read_frames(spark, str(tmp_path), range_bytes=1000).collect())
    for fields in (("plies", "outcome", "error"), ("tags", "moves", "outcome")):
        columns = ["source", "source_game", "byte_offset", "frame_error", *fields]
        told = lambda rows: sorted(map(str, rows.select(*columns).collect()))
        assert told(pgn.read_games(spark, str(tmp_path), fields=fields, range_bytes=1000)) == told(pgn.parse_games(pgn.read_frames(spark, str(tmp_path)), fields=fields))
    plan = pgn.plan_ranges(spark, pgn.discover(spark, str(tmp_path)), 1000).collect()
    assert sum(r["source"].endswith("plain.pgn") for r in plan) > 20
    begins = {(r[0], r[2]) for r in whole}
    assert all((r["source"].rsplit("/", 1)[1], r["start"]) in begins for r in plan)
    assert [r[4:] for r in whole if r[0] == "plain.pgn"][499] == (None, plain[: plain.rindex(b"[Event")].count(b"\n") - 2)
    assert [r[1:3] for r in whole if r[0] == "plain.pgn"] == [r[1:3] for r in whole if r[0] == "same.pgn.zst"]
    (tmp_path / "empty").mkdir()
    for missing in ("empty", "nowhere"):
        with pytest.raises(FileNotFoundError):
            pgn.read_frames(spark, str(tmp_path / missing))
    b, a = str(tmp_path / "tricky.pgn"), str(tmp_path / "plain.pgn")
    assert [f.rsplit("/", 1)[1] for f, _ in pgn.discover(spark, b, a)] == ["tricky.pgn", "plain.pgn"]


def test_standard_input(spark):
    import io

    rows = pgn.read_stdin(spark, io.BytesIO(TWO)).collect()
    assert [(r["source"], r["source_game"], r["error"]) for r in rows] == [("stdin", 0, None), ("stdin", 1, None)]


def test_queries_on_files(spark, folder, tmp_path):
    games = loaded(spark, folder).where("source LIKE '%a.pgn'")
    assert GameQuery(player="BOB").run(games).count() == 2
    assert GameQuery(player="BOB", color="black", result="loss").run(games).count() == 1
    replayed = pgn.replay(games)
    found = GameQuery(position="rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2").run(replayed, pgn.position_rows(replayed))
    assert [r["first_ply"] for r in found.collect()] == [2]
    fen = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
    assert [r["first_ply"] for r in GameQuery(position=fen).run(games).collect()] == [2] == [r["first_ply"] for r in GameQuery(position=fen).run(replayed).collect()]
    assert summary(games, GameQuery(player="carol").run(games)).first()["matches"] == 1
    errors = loaded(spark, folder).where("frame_error IS NOT NULL")
    assert count_unless_failed(games, errors).first()["matches"] is None
    pgn.write_jsonl(match_records(GameQuery(player="alice").run(games)), str(tmp_path / "out"))
    assert '"result":"white_win"' in spark.read.text(str(tmp_path / "out")).first()["value"]
    pgn.stage_and_publish(games, str(tmp_path / "pgn"), lambda df, p: pgn.write_pgn(df, p, "raw"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "pgn"), wholetext=True).collect())
    assert text.count("1. e4 e5 2. Nf3 1-0") == 1
    with pytest.raises(FileExistsError):
        pgn.stage_and_publish(games, str(tmp_path / "pgn"), pgn.write_pgn)


@pytest.mark.parametrize("bad", [{"color": "white"}, {"result": "win"}, {"since": 2, "until": 1}, {"player": "a", "min_rating": 2, "max_rating": 1}, {"player": ""}, {"position": "x"}, {"player": "a", "color": "red"}])
def test_query_validation(bad):
    with pytest.raises(ValueError):
        GameQuery(**bad)


def test_explore_a_small_library(spark):
    rows = [(1, "Dave", "Eve", 1, 20200101, 4), (2, "Alice", "Bob", 2, 20200201, 4), (3, "Bob", "Alice", 2, None, 4), (4, "Alice", "Carol", 3, 20200301, 4), (5, "Alice", "ALICE", 1, 20200302, 4)]
    games = spark.createDataFrame(rows, "game_id long, white string, black string, result int, played_on int, mainline_plies long").withColumns({"white_key": F.lower("white"), "black_key": F.lower("black")})
    best = explore.players(games, "alice").collect()
    assert (best[0]["name"], best[0]["games"], best[0]["wins"], best[0]["losses"]) == ("Bob", 2, 1, 1)
    assert [r["month"] for r in explore.timeline(games, "alice").collect()] == [202002, 202003]
    self_play = explore.timeline(games, "alice").collect()[1]
    assert (self_play["wins"], self_play["losses"], self_play["draws"]) == (1, 1, 1)
    positions = spark.createDataFrame([(bytes([k]), g, p) for g in (2, 3, 4) for p, k in ((4, 9), (8, 7))], "position_key binary, game_id long, ply int")
    visited = explore.visits(positions, games, 4, 4, "alice")
    top = explore.common_positions(visited).first()
    assert (top["games"], top["wins"], top["losses"], top["draws"]) == (3, 1, 1, 1)
    assert explore.samples(visited, "alice").first()["game_id"] == 2
    assert [r["game_id"] for r in explore.review_games(visited).collect()] == [2]
    assert library.page(games, "player", False, limit=0).count() == 1
    ids = spark.createDataFrame([(0, 4), (1, 2)], "place int, game_id long")
    assert [r["game_id"] for r in library.in_order(ids, games).collect()] == [4, 2]
    recent = spark.createDataFrame([(0, 4), (1, 5)], "place int, game_id long")
    assert [r["game_id"] for r in library.retained_then_recent(ids, recent).collect()] == [4, 2, 5]


def test_doctor_finds_each_fault(spark):
    good = b'[Result "1-0"]\n1. e4 e5 (1... c5 2. Nf3) 2. Nf3 1-0'
    cases = [
        (good, None), (b'[Result "2-0"]\n1. e4 1-0', "inconsistent_result"), (b'[Result "0-1"]\n1. e4 1-0', "inconsistent_result"), (b'[SetUp "1"]\n1. e4 *', "inconsistent_setup"), (b'[FEN "8/8"]\n1. e4 *', "invalid_fen"),
        (b"1. Ke5 *", "illegal_move"), (b"2. e4 *", "incorrect_move_number"), (b"1. e4 1. e5 *", "incorrect_move_number"), (b"1. e4 e5 (1. c5) *", "incorrect_move_number"), (b"1. zz9 *", "invalid_san"), (b"1. e4+ *", "invalid_check_suffix"), (b"1. e4 ) *", "syntax"),
    ]
    lines = [sum(raw.count(b"\n") for raw, _ in cases[:i]) for i in range(len(cases))]
    frames = spark.createDataFrame([("s", i, 100 * i, bytearray(raw), None, lines[i]) for i, (raw, _) in enumerate(cases)], "source string, source_game long, byte_offset long, raw binary, error string, first_line long")
    got = {r["game"] - 1: r for r in doctor.diagnose(frames).collect()}
    assert [got[i]["category"] for i in range(len(cases))] == [c for _, c in cases]
    assert got[0]["moves"] == 5 and got[5]["byte"] == 503 and (got[5]["line"], got[5]["column"], got[5]["excerpt"]) == (6, 4, "1. Ke5 *")
    assert doctor.validate(cases[5][0], semantic=False) == {"moves": 1, "fault": None, "headers": {}}
    assert [r["game"] for r in doctor.limited(doctor.diagnose(frames), 2).orderBy("place").collect()] == [2, 3]
    assert doctor.totals(doctor.diagnose(frames)).first()["faults"] == len(cases) - 1
    assert [(r["game"], r["category"]) for r in doctor.first_faults(doctor.diagnose(frames)).collect()] == [(2, "inconsistent_result")]
    lost = doctor.inputs(spark.createDataFrame([("t", "no such file")], "source string, message string"))
    both = doctor.diagnose(frames).unionByName(lost)
    assert {(r["source"], r["status"]) for r in doctor.exit_status(both).collect()} == {("s", 1), ("t", 3)}
    assert doctor.first_faults(both).where("source = 't'").first()["message"] == "no such file"


def test_plain_games_are_told_as_by_walking():
    """Games put together at random, most of them plain: the short way and the walk agree on faults, moves and headers."""
    import random

    rng = random.Random(9)
    parts = [b"e4 ", b"e5 ", b"Nf3 ", b"Nc6\n", b"1. ", b"2. ", b"3.", b"1... ", b"O-O ", b"{x} ", b"(", b") ", b"(2. d4) ", b"$1 ", b"2... ", b"Ke2 ", b"e4! ", b"exd5 ", b"d5 "]
    heads = [b"", b'[White "a"]\n', b'[White "a"]\n[White "b"]\n', b'[Result "1-0"]\n', b'[SetUp "0"]\n', b'[FEN "8/8"]\n', b'[Event "\\""]\n']
    short = 0
    for _ in range(6000):
        start = b"1. e4 e5 2. Nf3 " * rng.randint(0, 1)
        raw = rng.choice(heads) + start + b"".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice([b"1-0", b"*", b" 1-0\n\n"])
        for semantic in (True, False):
            assert doctor.validate(raw, semantic) == doctor._walked(raw, semantic), raw
            short += doctor._simple(raw, semantic) is not None
    assert short > 1000


def test_faults_are_located_in_lines():
    """Lines end at line feeds; a long line's excerpt is as long near its end as anywhere."""
    assert doctor.locate(b"ab\rcd\r\nef", 4) == (0, 5, "ab\rcd") and doctor.locate(b"ab\r\nef", 5) == (1, 2, "ef")
    line = bytes(97 + i % 26 for i in range(1000))
    for offset in (0, 50, 500, 999):
        n, column, text = doctor.locate(b"x\n" + line + b"\ny", offset + 2)
        assert (n, column) == (1, offset + 1) and len(text.strip("…")) == 200 and chr(line[offset]) in text
        assert text.startswith("…") == (offset > 100) and text.endswith("…") == (offset < 899)


def test_statistics_merge_over_sources(spark, folder):
    rows = loaded(spark, folder).where("source LIKE '%a.pgn'")
    whole = stats.core(rows).first()
    assert (whole["games"], whole["plies"], whole["white_wins"], whole["avg_plies"]) == (2, 5, 1, 2.5)
    assert sum(r["games"] for r in stats.time_controls(rows).collect()) == 2
    assert stats.core(rows.where("false")).first()["avg_plies"] == 0.0


def test_database_build_and_update(spark, tmp_path):
    def corpus(texts):
        frames = pgn.frames_of_texts(spark.createDataFrame([(n, bytearray(t)) for n, t in texts], "source string, content binary"))
        rows = pgn.game_rows(pgn.parse_games(frames)).withColumn("game_id", F.xxhash64("source", "source_game"))
        replayed = pgn.replay(rows)
        games = replayed.select("game_id", "source", "source_game", F.col("raw").alias("pgn"), "white", "black", "white_key", "black_key", "played_on", "result", "mainline_plies")
        return games, pgn.position_rows(replayed).join(games.select("game_id", "source"), "game_id")

    db = Database(spark, str(tmp_path / "db"))
    with pytest.raises(FileNotFoundError):
        db.manifest()
    assert {(r["source"], r["action"]) for r in db.build(*corpus([("a", TWO), ("b", b"1. e4 *")])).collect()} == {("a", "added"), ("b", "added")}
    with pytest.raises(FileExistsError):
        db.build(*corpus([("a", TWO)]))
    first = db.info().first()
    assert (first["games"], first["sources"], first["positions"]) == (3, 2, 4 + 3 + 2)
    acted = {r["source"]: r["action"] for r in db.update(*corpus([("a", TWO), ("b", b"1. d4 d5 *"), ("c", b"1. c4 *")])).collect()}
    assert acted == {"a": "unchanged", "b": "replaced", "c": "added"}
    assert {r["source"]: r["action"] for r in db.update(*corpus([("c", b"1. c4 *")])).collect()} == {"a": "retained", "b": "retained", "c": "unchanged"}
    last = db.info().first()
    assert (last["games"], last["sources"], last["positions"]) == (4, 3, 4 + 3 + 3 + 2)
    assert db.games().where("source = 'b'").first()["mainline_plies"] == 2


def test_a_database_guards_its_state(spark, tmp_path):
    games = spark.createDataFrame([(1, "a", 1, bytearray(TWO), "x", 1, 20200101, 3)], "game_id long, source string, source_game long, pgn binary, white string, result int, played_on int, mainline_plies long")
    positions = spark.createDataFrame([(bytes(16), 1, 0, "a")], "position_key binary, game_id long, ply int, source string")
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "notes").write_text("x")
    with pytest.raises(ValueError, match="no game database"):
        Database(spark, str(tmp_path / "foreign")).manifest()
    db = Database(spark, str(tmp_path / "db"))
    db.build(games, positions)
    assert db.game(1) == TWO
    with pytest.raises(LookupError):
        db.game(2)
    # two updates at once: the second to publish fails, and the state stays the first one's
    db._publish(db.manifest(), "first", 2)
    with pytest.raises(OSError, match="meanwhile"):
        db._publish(db.manifest(), "second", 2)
    assert db._state() == (2, "first") and db.manifest().count() == 1
    # a database of the first version: no fingerprints
    db._publish(db.manifest().withColumns({"fingerprint": F.lit(None).cast("string"), "schema_version": F.lit(1)}), "old", 3)
    assert db.migrate() == 4 == db.migrate() and db.manifest().first()["fingerprint"] is None
    assert [r["action"] for r in db.update(games, positions).collect()] == ["unchanged"]
    assert len(db.manifest().first()["fingerprint"]) == 64
    dated = games.withColumn("source", F.lit("2020-01-02"))
    assert {r["source"]: r["action"] for r in db.update(dated.unionByName(games.withColumn("source", F.lit("007"))), positions).collect()} == {"2020-01-02": "added", "007": "added", "a": "retained"}
    assert {r["source"] for r in db.games().collect()} == {"2020-01-02", "007", "a"}
    unsteady = games.withColumn("pgn", F.concat(F.col("pgn").cast("string"), F.udf(lambda: os.urandom(8).hex()).asNondeterministic()()).cast("binary"))
    with pytest.raises(store.SourceChanged):
        db.update(unsteady, positions)
    assert db.games().where("source = 'a'").count() == 1
    damaged = games.withColumn("pgn_bytes", F.lit(5))
    assert [r["issue"] for r in store.damaged_games(damaged).collect()] == ["size_differs"]
    assert [r["issue"] for r in store.damaged_games(games.withColumn("pgn", F.lit(b"1. e4 )"))).collect()] == ["pgn_invalid"]
    assert db.games().columns and store.integrity_issues(db.games(), db.positions(), db.manifest()).count() == 0
    sources = spark.createDataFrame([("x/a.pgn",), ("y/a.pgn",), ("y/b.pgn",)], "source string")
    assert store.find_source(sources, "b.pgn") == "y/b.pgn" and store.find_source(sources, "x/a.pgn") == "x/a.pgn"
    for name in ("a.pgn", "c.pgn"):
        with pytest.raises(LookupError):
            store.find_source(sources, name)
    store.export(db.games().where("source = 'a'"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"].count("1-0") == 1


def test_fingerprints_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).select(F.lit("s").alias("source"), (F.col("id") + 1).alias("source_game"), F.col("id").cast("string").cast("binary").alias("pgn"))
    one = store.fingerprints(rows.repartition(1)).first()
    assert one == store.fingerprints(rows.repartition(7)).first() and one["games"] == 5000
    assert one["fingerprint"] != store.fingerprints(rows.where("id <> 4000")).first()["fingerprint"]


def test_streaming_sync_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    schema = "seq long, remote_id string, content string, unfinished boolean, player_result string"
    spark.createDataFrame([(1, "a", "x", True, "win"), (2, "b", "y", False, "loss"), (3, "a", "x", True, "win")], schema).coalesce(1).write.parquet(str(src / "0"))
    table = sync.GameTable(spark, str(tmp_path / "games"))
    arrivals = lambda: spark.readStream.schema(schema).parquet(str(src) + "/*")
    contents = lambda: {r["remote_id"]: r["content"] for r in table.read().collect()}
    sync.start(arrivals(), table, str(tmp_path / "cp")).awaitTermination()
    assert contents() == {"a": "x", "b": "y"}
    more = spark.createDataFrame([(4, "a", "z", False, "win"), (5, "c", "w", False, "draw")], schema)
    got = {r["seq"]: r["action"] for r in sync.actions(more, table.read()).collect()}
    assert got == {4: "updated", 5: "created"}
    more.coalesce(1).write.parquet(str(src / "1"))
    sync.start(arrivals(), table, str(tmp_path / "cp")).awaitTermination()
    now, version = contents(), table.version()
    assert now == {"a": "z", "b": "y", "c": "w"}
    table.upsert(more, 9, "again")
    table.upsert(more.limit(0), 9, "again")  # the same batch again
    assert contents() == now and table.version() == version + 1
    # a new checkpoint goes on behind the newest version, and nothing is lost
    spark.createDataFrame([(6, "d", "v", False, "win")], schema).coalesce(1).write.parquet(str(src / "2"))
    sync.start(arrivals(), table, str(tmp_path / "other")).awaitTermination()
    assert contents() == now | {"d": "v"} and {r["remote_id"]: r["content"] for r in table.read(1).collect()} == {"a": "x", "b": "y"}


def test_sync_plans():
    assert sync.plan(None, 5, 5, 100) == {"kind": "initial", "since": 5, "until": 100} == sync.plan(None, 5, None, 100)
    assert sync.plan(1_000_000, None, None, 2_000_000)["since_ms"] == 700_000 == sync.plan(1_000_000, 5, 6, 2_000_000)["since_ms"]
    assert sync.plan(1_000, None, None, 2_000)["since_ms"] == 0 and sync.plan(9_000_000, None, None, 100)["since_ms"] == 100
    with pytest.raises(ValueError):
        sync.plan(None, 1998, 1999, 10)
    assert sync.is_due(None, 1) and sync.is_due(10, 5) and not sync.is_due(0, 1000) and sync.is_due(0, 900_000)


def searched(spark, *lines):
    log = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], "search string, seq int, line string")
    return evidence.best_evidence(log).first()


def test_engine_evidence(spark):
    lines = ["info depth 10 multipv 1 score cp 31 nodes 5 pv e2e4 e7e5", "info depth 11 score cp 40 lowerbound pv e2e4", "info depth 11 multipv 2 score cp 90 pv d2d4", "info string x", "bestmove e2e4 ponder e7e5"]
    got = searched(spark, *lines)
    assert (got["value"], got["bound"], got["depth"], got["pv"], got["score_source"]) == (31, "exact", 10, ["e2e4", "e7e5"], "previous_completed_iteration")
    mate = searched(spark, "info depth 3 score mate -2 pv a2a3", "bestmove a2a3")
    assert (mate["kind"], mate["value"], mate["error"]) == ("mate_against", 2, None)
    # the latest exact line has another move: the bound of the best move stands, an older exact line does not
    kept = searched(spark, "info depth 9 score cp 10 pv e2e4", "info depth 10 score cp 20 pv d2d4", "info depth 10 score cp 30 lowerbound pv e2e4", "bestmove e2e4")
    assert (kept["seq"], kept["bound"], kept["score_source"]) == (2, "lower", "latest_report")
    assert searched(spark, "info depth 1 score mate 0", "bestmove (none)")["best"] is None


def test_engine_lines_that_break_the_protocol(spark):
    cases = {
        "info string score cp 5 pv e2e4": None, "info depth 1 score cp 5 pv zzzz": "invalid variation", "info score cp 1 lowerbound upperbound pv e2e4": "conflicting score bounds", "info score cp x": "invalid score",
        "info score wdl 5": "invalid score type", "info depth x score cp 1": "invalid depth", "info multipv 2 score cp x": None, "info depth 3": None,
    }
    log = spark.createDataFrame([(line, 0, line) for line in cases], "search string, seq int, line string")
    got = {r["search"]: r["error"] for r in evidence.uci_info(log).collect()}
    assert got == {k: v for k, v in cases.items() if v}
    assert searched(spark, "info depth 1 score cp 1 pv e2e4", "bestmove d2d4")["error"] == "missing score for bestmove"
    assert searched(spark, "bestmove zz")["error"] == "invalid bestmove"


def test_practice_is_folded_in_order(spark):
    def practised(*actions):
        rows = [(1, i, a.split(":")[0], a.split(":")[1] if ":" in a else None) for i, a in enumerate(actions)]
        r = evidence.practice_state(spark.createDataFrame(rows, "game_id long, seq long, action string, verdict string")).first()
        return r["solution"], r["revealed"], r["disposition"], r["total_attempts"]

    assert practised("attempt:strong") == ("without_reveal", False, "completed", 1)
    assert practised("attempt:strong", "attempt:try_again") == ("without_reveal", False, "active", 2)
    assert practised("reveal", "attempt:strong") == ("after_hint", True, "completed", 1)
    assert practised("reveal", "replay") == ("unsolved", True, "active", 0) and practised("skip", "later") == ("unsolved", False, "again_later", 0)
    assert practised("attempt:inconclusive", "done")[2] == "completed" and practised("skip")[2] == "skipped"


def test_lessons_that_were_revealed_are_not_active(spark):
    rows = [(1, "p", "m", "centipawns", 200, True, 0, "active", "unsolved", True), (2, "q", "m", "centipawns", 100, True, 1, "active", "unsolved", False)]
    points = spark.createDataFrame(rows, "game_id long, position string, played_uci string, loss_kind string, loss long, exact boolean, recency int, disposition string, solution string, revealed boolean")
    assert [r["game_id"] for r in evidence.lesson_ranking(points).collect()] == [2]
    assert {r["game_id"] for r in evidence.lesson_ranking(points.withColumn("revealed", F.lit(True))).collect()} == {1, 2}


def test_registered_queries_match_their_sql(spark, sf):
    from chesslake.plans import registry

    duck = duckdb.connect()
    for name in os.listdir(sf):
        duck.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    for name in ("scan_games", "pgn_event_counts", "fn_scalars", "query_combined", "explore_openings_scoped", "explore_sample_game", "stats_partial_on_error", "doctor_setup", "db_fingerprint", "sync_results", "evidence_diagnose"):
        got, want = registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name])
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(want.columns)
        rows = lambda it: sorted(repr([None if v is None else v for v in r]) for r in it)
        assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall()), name


class FakeArchive:
    """A transport: one user with two games, one that is locked out, no others."""

    def fetch(self, options):
        if options.get("user") == "locked":
            return 403, b""
        return (200, TWO) if options.get("user") == "alice" else (404, b"")


def test_data_sources(spark, folder):
    from chesslake.sources import remote

    remote.register(spark)
    files = spark.read.format("pgn").load(str(folder))
    assert files.where("error IS NULL").count() == pgn.read_frames(spark, str(folder)).where("error IS NULL").count()
    (folder / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        remote.discover([str(folder / "none")])
    for status, error in ((401, remote.AccessDenied), (404, remote.GameNotFound), (429, remote.RateLimited), (500, OSError)):
        with pytest.raises(error):
            remote.check_status(status)
    games = spark.read.format("pgn_remote").options(user="alice", transport="tests.test_engine.FakeArchive").load()
    assert games.count() == 2
    with pytest.raises(Exception, match="refused"):
        spark.read.format("pgn_remote").options(user="locked", transport="tests.test_engine.FakeArchive").load().count()


def test_sql_functions(spark):
    from chesslake.functions import udf

    udf.register(spark)
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    row = spark.sql(f"SELECT hex(position_key('{start}')) k, fen_normalize('x') n, fen_error('8/8 w - - 0 1') e, in_check('{start}') c").first()
    assert (row["k"].lower(), row["n"], row["e"], row["c"]) == ("a0fcaf7dd08a1dd221e64656ada2fc8e", None, "invalid_board", False)
    assert spark.sql(f"SELECT * FROM legal_moves('{start}')").count() == 20
    assert [r["error"] for r in spark.sql("SELECT * FROM replay('', 'e4 e5 Ke3')").collect()] == [None, None, "illegal_move"]
    assert [r["kind"] for r in spark.sql("SELECT * FROM pgn_events('1. e4 *')").collect()] == ["game_start", "movetext_start", "move_number", "san", "outcome", "game_end"]
    assert udf.play_uci(start, "e2e4").split()[1] == "b"
    with pytest.raises(ValueError):
        udf.play_uci(start, "e2e5")


def test_results_by_line_equal_results_by_visit(spark):
    # a game counts once however often it has a position in the range; null names, and players on either side
    lines = [("e4 e5 Nf3 Nc6", 1), ("Nf3 Nc6 e4 e5", 2), ("Nf3 Nf6 Ng1 Ng8", 3), ("Nf3 Nf6 Ng1 Ng8 Nf3", 0), ("e4 e5 Nf3 Nc6", 2), ("", 1), ("e4 Ke4", 1)]
    rows = [(i, ("a", "b", None)[i % 3], ("b", None, "a")[i % 3 - 1], 20200101, r, None, None if i != 4 else "standard", text.split()) for i, (text, r) in enumerate(lines * 3)]
    games = spark.createDataFrame(rows, "game_id long, white_key string, black_key string, played_on int, result int, fen string, variant string, moves array<string>")
    keyed = pgn.with_position_keys(games)
    visits = keyed.selectExpr("game_id", "posexplode(keys) AS (ply, position_key)")
    for player in (None, "A"):
        totals = explore.position_results(pgn.with_position_keys(explore.line_results(games, player)), 0, 4)
        old = explore.visits(visits, games, 0, 4, player).groupBy("position_key").agg(F.count(F.lit(1)).alias("games"), *explore._tally(F.col("outcome")))
        assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, old.collect()))


def _python_passes(rows) -> int:
    return rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_openings_replay_lines_and_annotations_diagnose_once(spark):
    sf = "/root/testdata/sf0.001"
    # games are parsed while lines are staged; what is left joins the stored lines, and no game is replayed or shuffled by id
    for name in ("explore_openings", "explore_recurring", "focus_opening"):
        plan = registry.QUERIES[name](spark, sf)
        assert _python_passes(plan) == 0 and "game_id" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert _python_passes(registry.QUERIES["report_annotations"](spark, sf)) == 1


def test_parsing_without_counts_gives_the_same_games():
    texts = [b'[A "1"]\n[A "2"]\n\n1. e4 {x} e5 $1 (1... c5) 2. Nf3! 1-0', b"1. e4 e5 *", b"bad [", b"", b'[Event "x"]\n\n 0-1']
    for raw in texts:
        full, lean = P.parse_game(raw), P.parse_game(raw, counted=False)
        assert {k: v for k, v in full.items() if k != "counts"} == {k: v for k, v in lean.items() if k != "counts"}
