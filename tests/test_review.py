"""Reviews, collections and reports on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chesslake.functions import columns as C
from chesslake.kernel import board as B
from chesslake.operators import doctor, reports, review
from chesslake.sources import pgn, remote
from chesslake.streaming import collection

GAME = '[White "Ann"]\n[Black "Bob"]\n\n1. e4 e5 (1... c5 2. Nf3) 2. Nf3 {x} Nc6 0-1\n'


def refused(spark, text, player="ann"):
    raw = bytearray(text if isinstance(text, bytes) else text.encode())
    return review.parse_reviews(spark.createDataFrame([(1, raw, player)], "game_id long, pgn binary, player string")).first()


def test_reviews_take_one_game_of_one_player(spark):
    got = refused(spark, GAME, " ANN ")
    assert (got["error"], got["color"], got["player_name"], got["san"]) == (None, "white", "ann", ["e4", "e5", "Nf3", "Nc6"]) and got["uci"][2] == "g1f3"
    cases = {
        "player_required": refused(spark, GAME, " "), "player_missing_or_ambiguous": refused(spark, GAME.replace("Bob", "ANN")), "expected_one_game": refused(spark, GAME + GAME), "unsupported_variant": refused(spark, '[Variant "Atomic"]\n' + GAME),
        "invalid_pgn:duplicate_tag": refused(spark, '[White "x"]\n' + GAME), "invalid_setup": refused(spark, '[SetUp "0"]\n[FEN "8/8/8/8/8/8/8/K1k5 w - - 0 1"]\n' + GAME), "illegal_mainline:3": refused(spark, GAME.replace("2. Nf3 {x}", "2. Nf6")),
        "invalid_pgn:missing_outcome": refused(spark, GAME.replace("0-1", "")), "too_large": refused(spark, GAME + " " * review.MOST_BYTES), "invalid_pgn:invalid_utf8_tag": refused(spark, b'[White "\xff"]\n' + GAME.replace('[White "Ann"]\n', "").encode()),
    }
    assert {k: r["error"] for k, r in cases.items()} == {k: k for k in cases}
    assert refused(spark, GAME + "\n", "bob")["color"] == "black" and refused(spark, "", "ann")["error"] == "expected_one_game"
    endless = '[White "ann"]\n\n' + "Nf3 Nf6 Ng1 Ng8 " * 257 + "*"
    assert refused(spark, endless)["error"] == "too_large"


def test_decisions_begin_after_the_shared_plies(spark):
    fen = '[FEN "4k3/8/8/8/8/8/8/4K2R b K - 0 1"]\n[SetUp "1"]\n[White "Ann"]\n\n1... Kd7 2. O-O Kd6 3. Kg2 *'
    rows = spark.createDataFrame([(1, bytearray(GAME.encode()), "bob"), (2, bytearray(fen.encode()), "ann")], "game_id long, pgn binary, player string")
    got = [(r["game_id"], r["ply"], r["played_san"]) for r in review.decisions(review.parse_reviews(rows), 2).orderBy("game_id", "ply").collect()]
    assert got == [(1, 4, "Nc6"), (2, 4, "Kg2")]
    assert review.decisions(review.parse_reviews(rows), 0).count() == 4


def test_lines_and_moves_on_boards(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    mate = "7k/5KQ1/8/8/8/8/8/8 b - - 0 1"
    rows = spark.createDataFrame([(1, start, ["e2e4", "e7e5"]), (2, start, []), (3, mate, []), (4, "8/8", ["a1a2"]), (5, start, None)], "id int, fen string, pv array<string>")
    got = {r["id"]: (r["pv_san"], r["error"]) for r in review.legal_variations(rows).collect()}
    assert got == {1: (["e4", "e5"], None), 2: (None, "missing move in nonterminal position"), 3: ([], None), 4: (None, "invalid_fen:missing_field"), 5: (None, "missing move in nonterminal position")}
    lines = spark.createDataFrame([(1, start, ["g1f3", "g8f6", "f3g1", "f6g8"] * 3)], "id int, fen string, moves array<string>")
    assert len(review.replay_lines(lines).first()["fens"]) == 7
    moves = spark.createDataFrame([("e2e4", 0), ("e2e4", 1024), ("e2e5", 0), (None, 0)], "uci string, plies int").withColumn("fen", F.lit(start))
    assert [r["fen_after"] is not None for r in review.playable(moves, history="plies").collect()] == [True, False, False, False]


def test_entries_are_replayed(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    at = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq e6 0 2"
    sound = dict(initial_fen=start, history=["e2e4", "e7e5"], position_fen=at, player_color="white", played_uci="a2a3", played_san="a3", after_pv=["b8c6"], after_pv_san=["Nc6"], pv=["g1f3"], pv_san=["Nf3"])
    broken = {None: {}, "history": {"history": ["e2e5"]}, "position": {"position_fen": start}, "side": {"player_color": "black"}, "played": {"after_pv_san": ["Nf6"]}, "variation": {"pv": ["g1g3"]}}
    schema = "initial_fen string, history array<string>, position_fen string, player_color string, played_uci string, played_san string, after_pv array<string>, after_pv_san array<string>, pv array<string>, pv_san array<string>"
    names = [f.split()[0] for f in schema.split(", ")]
    rows = spark.createDataFrame([tuple((sound | b)[n] for n in names) for b in broken.values()], schema)
    assert [r["board_fault"] for r in review.board_faults(rows).collect()] == list(broken)


def test_review_goes_round(spark):
    nxt = lambda reviewed, deferred, current: spark.range(1).select(review.next_review_game(F.lit([1, 2, 3, 4]), F.lit(reviewed), F.lit(deferred), F.lit(current))).first()[0]
    none = []
    row = spark.createDataFrame([([1, 2, 3, 4], [3], [4], 2), ([1, 2, 3, 4], none, none, 4), ([1, 2], [1, 2], none, 1), ([5, 6], none, none, 9)], "g array<long>, r array<long>, d array<long>, c long")
    assert [r[0] for r in row.select(review.next_review_game(F.col("g"), F.col("r"), F.col("d"), F.col("c"))).collect()] == [1, 1, None, 5]
    assert nxt is not None
    done = spark.createDataFrame([("p", [1, 2], [1, 2], none, 1), ("q", [1, 2], [1], [2], 1), ("r", [1, 2], none, [1], 1)], "pattern string, game_ids array<long>, reviewed_game_ids array<long>, deferred_game_ids array<long>, current_game_id long")
    got = {r["pattern"]: (r["reviewed_game_ids"], r["deferred_game_ids"], r["current_game_id"]) for r in review.prepared_progress(done).collect()}
    assert got == {"p": ([], [], 1), "q": ([1], [], 2), "r": ([], [1], 2)}


def test_moves_in_words(spark):
    told = lambda fen, uci: spark.range(1).select(C.describe_move(F.lit(fen), F.lit(uci))).first()[0]
    assert told("4k3/8/8/8/8/8/8/R3K3 w Q - 0 1", "e1c1") == "king from e1 to c1 (castling)" and told("x", "e2e4") == "piece from e2 to e4" and told("8/8/8/8/8/8/8/8", "e2e4x") == ""
    assert told("4k3/8/3p4/4N3/8/8/8/4K3 w - - 0 1", "e5d6") == "knight from e5 to d6, capturing a pawn"
    squares = spark.range(1).select(C.fen_squares(F.lit("r3k3/8/8/8/8/8/8/4K2R w K - 0 1"))).first()[0]
    assert len(squares) == 64 and [(s["name"], s["piece"]) for s in squares if s["piece"]] == [("a8", "r"), ("e8", "k"), ("e1", "K"), ("h1", "R")]
    assert spark.range(1).select(C.fen_squares(F.lit("8/8 w"))).first()[0] == []


def site(game_id, result, white="Ann", moves="1. e4"):
    return f'[Site "https://lichess.org/{game_id}"]\n[White "{white}"]\n[Black "Bob"]\n[Date "2020.01.0{len(moves) % 9 + 1}"]\n\n{moves} {result}\n\n'


class Archive:
    """A transport whose answers the tests set; what it was asked stays in a file, as executors ask."""

    games, single, log = "", {}, "/tmp/none"

    def fetch(self, options):
        import json as j

        told = j.load(open("/tmp/chesslake-archive.json"))
        with open(told["log"], "a") as f:
            f.write(j.dumps(options) + "\n")
        if options.get("gameid"):
            text = told["single"].get(options["gameid"])
            return (404, b"") if text is None else (200, text.encode())
        return 200, told["games"].encode()


def test_syncs_of_a_user(spark, tmp_path):
    remote.register(spark)
    log = tmp_path / "asked"
    log.write_text("")

    def archive(games, single=()):
        with open("/tmp/chesslake-archive.json", "w") as f:
            json.dump({"games": games, "single": dict(single), "log": str(log)}, f)

    run = lambda now, **o: collection.sync_user(spark, str(tmp_path / "c"), "Ann", "tests.test_review.Archive", now, database=str(tmp_path / "db"), **o)
    asked = lambda: json.loads(log.read_text().splitlines()[-1])
    state = lambda: collection.Collection(spark, str(tmp_path / "c")).state()
    archive(site("aaaaaaaa", "1-0") + site("bbbbbbbb", "*"))
    first = run(1_600_000_000_000, since=20200101, recent_only=True)
    assert first["created"] == 2 and first["cursor_ms"] is None and asked()["max"] == "24" and state()["cursor_ms"] is None and first["index_mode"] == "build"
    with pytest.raises(ValueError, match="another since"):
        run(1_600_000_000_000, since=20190101)
    second = run(1_600_000_000_000)
    assert (second["unchanged"], second["unfinished"], second["index_mode"]) == (2, 1, "update") and int(asked()["since"]) == 1577836800000 and state()["unfinished_game_ids"] == ["bbbbbbbb"]
    archive(site("cccccccc", "0-1"), {"bbbbbbbb": site("bbbbbbbb", "1/2-1/2", moves="1. e4 e5")})
    third = run(1_600_001_000_000)
    assert (third["created"], third["refreshed_unfinished"], third["unfinished"]) == (1, 1, 0) and state()["cursor_ms"] == 1_600_001_000_000
    assert any(json.loads(x).get("since") == str(1_600_000_000_000 - 300_000) for x in log.read_text().splitlines())
    games = {r["remote_id"]: r["content"] for r in collection.Collection(spark, str(tmp_path / "c")).games.read().collect()}
    assert set(games) == {"aaaaaaaa", "bbbbbbbb", "cccccccc"} and "1. e4 e5 1/2-1/2" in games["bbbbbbbb"]
    with pytest.raises(ValueError, match="only begin"):
        run(1_600_002_000_000, since=20200101)
    with pytest.raises(ValueError, match="belongs to"):
        collection.Collection(spark, str(tmp_path / "c")).prepare("Eve", 5)
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x").write_text("")
    with pytest.raises(ValueError, match="neither empty"):
        collection.Collection(spark, str(tmp_path / "foreign")).prepare("Ann", 5)
    archive(site("dddddddd", "*"))
    run(1_600_003_000_000)
    archive("", {"dddddddd": site("eeeeeeee", "1-0")})
    with pytest.raises(collection.UnexpectedGame):
        run(1_600_004_000_000)
    assert state()["cursor_ms"] == 1_600_003_000_000  # a sync that fails leaves the cursor
    archive("")  # the game is gone: finished
    assert run(1_600_005_000_000)["unfinished"] == 0
    # filters become limits of the request, and are applied again
    archive(site("aaaaaaaa", "1-0") + site("ffffffff", "1-0", white="Zed"))
    rows = spark.read.format("pgn_remote").options(transport="tests.test_review.Archive", user="Ann").load().where("played_on >= 20200102 AND played_on <= 20201231 AND color = 'white' AND opponent = 'Bob'")
    assert rows.count() == 1 and asked() == {"user": "Ann", "since": "1577923200000", "until": "1609459199999", "color": "white", "vs": "Bob"}


def test_states_are_checked():
    good = {"schema_version": 1, "source": "lichess", "username": "Ann", "unfinished_game_ids": ["abcd1234"]}
    assert collection.check_state(good, "aNN") == good
    for wrong in ({"schema_version": 2}, {"source": "other"}, {"username": "Bob"}, {"unfinished_game_ids": ["short"]}):
        with pytest.raises(ValueError):
            collection.check_state(good | wrong, "Ann")


def test_reports_of_checks(spark):
    texts = [b'[Event "E"]\n\n1. e4 e5 *\n', b"1. e4 Ke4 *\n", b"1. e4 ) *\n"]
    rows = [("a,b.pgn", i, 50 * i, bytearray(t), None, 3 * i) for i, t in enumerate(texts)] + [("good.pgn", 0, 0, bytearray(texts[0]), None, 0), ("stdin", 0, 0, bytearray(texts[1]), None, 0)]
    told = reports.doctor_reports(doctor.diagnose(spark.createDataFrame(rows, pgn.FRAMES)), most=1)
    text = {r["source"]: (r["text"], r["stream"]) for r in reports.doctor_text(told).collect()}
    assert text["good.pgn"] == ("valid: good.pgn\nmode: semantic\ngames: 1\nmoves: 2\n", "stdout")
    assert text["a,b.pgn"] == ("invalid: a,b.pgn\nillegal_move: game 2, ply 2: the move cannot be played (Ke4)\n  at line 4:7\n  | 1. e4 Ke4 *\nstopped after reaching the error limit\nprocessed: 1 complete games, 4 moves\n", "stderr")
    assert {r["source"]: r["text"] for r in reports.doctor_text(told, quiet=True).collect()}["good.pgn"] == ""
    lines = sorted(r["line"] for r in reports.doctor_annotations(told).collect())
    assert lines == ["::error file=a%2Cb.pgn,line=4,col=7,title=Doctor%3A illegal move::game 2, ply 2: the move cannot be played (Ke4)", "::error title=Doctor%3A illegal move::game 1, ply 2: the move cannot be played (Ke4)"]
    assert reports.doctor_summary(told).first()[0] == "Doctor: invalid - 3 inputs; 2 diagnostics, 2 complete games, 7 moves; error limit reached"
    assert reports.doctor_summary(told.where("source = 'good.pgn'")).first()[0] == "Doctor: valid - good.pgn; 0 diagnostics, 1 complete game, 2 moves"
    each = [json.loads(r["line"]) for r in reports.doctor_json_lines(told).where("source = 'a,b.pgn'").orderBy("k").collect()]
    assert [x["record"] for x in each] == ["diagnostic", "summary"] and each[0]["diagnostic"]["line"] == 4 and each[1]["error_limit_reached"]


def test_reports_of_statistics(spark):
    texts = [b'[Event "E"]\n[Date "2020.01.02"]\n[WhiteElo "1500"]\n[TimeControl "300"]\n\n1. e4 e5 1-0\n', b'[Date "2020-01-02"]\n[BlackElo "x"]\n\n*\n']
    rows = spark.createDataFrame([("a", len(t), bytearray(t)) for t in texts], "source string, bytes long, raw binary")
    parsed = lambda df: pgn.parse_games(df, fields=("tags", "raw_date_tag", "raw_utc_date", "plies", "outcome"))
    whole = reports.statistics(parsed(rows), "source")
    text = reports.source_texts(whole, F.lit("valid"), F.lit(0.0)).first()["text"].split("\n")
    assert text[5] == "results: 1 white win, 0 black wins, 0 draws, 1 unfinished" and text[6] == "game length (plies): min 0, avg 1.00, max 2"
    assert text[9] == "dates: 1 complete (2020.01.02 to 2020.01.02), 1 incomplete/invalid, 0 missing" and text[10] == "ratings: 1 numeric (min 1500, avg 1500.00, max 1500), 1 invalid, 2 missing"
    assert text[-2] == "throughput: 0.00 MiB/s" and "sudden death=1" in text[12]
    inputs = spark.createDataFrame([("a", 0), ("b", 2)], "source string, status int")
    batch = reports.batch_text(reports.statistics(parsed(rows.where("false"))), inputs).first()["text"].split("\n")
    assert batch[:3] == ["stats: error", "inputs: 2", "input status: 1 valid, 0 invalid, 1 errors"] and "game length (plies): n/a" in batch and "dates: 0 complete, 0 incomplete/invalid, 0 missing" in batch
    assert json.loads(reports.as_json(whole, "source").first()["json"])["ratings"]["distribution"]["1400-1599"] == 1


def test_synthetic_source(spark):
    rows = pgn.repeated_game(spark, GAME.encode(), 10_000)
    assert rows.count() * len(GAME) >= 10_000 and pgn.parse_games(rows, fields=("plies",)).agg(F.min("plies"), F.max("plies")).first() == (4, 4)


def test_lines_in_coordinates_equal_the_board():
    """Side by side, lines of all kinds of moves, impossible ones too, are told as one board tells them."""
    rng = random.Random(5)
    fens = [None, "", "x", "r3k2r/p1ppqpb1/bn2pnp1/3PN2/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", "n1n5/PPPk4/8/8/8/8/4Kppp/5N1N b - - 0 1", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1", "rnbqkbnr/ppp1p1pp/8/3pPp2/8/8/PPPP1PPP/RNBQKBNR w KQkq f6 0 3"]
    lines = []
    for _ in range(150):
        fen = rng.choice(fens)
        moves = []
        try:
            board = B.Board(fen)
        except B.FenError:
            board = B.Board()
        for _ in range(rng.randrange(12)):
            legal = board.legal_moves()
            if not legal:
                break
            move = rng.choice(legal)
            moves.append(B.uci(move))
            board.apply(*move)
        if rng.random() < 0.4:
            moves.insert(rng.randrange(len(moves) + 1), rng.choice(["e1g1", "e8c8", "e1c1", "a7a8", "b7b8k", "e2e4q", "E2E4", "", None, "e5f6", "z9a1", "e1h1"]))
        lines.append((fen, moves if moves or rng.random() < 0.5 else None))
    # every legal move from these positions too, and many that are not
    squares = [f + r for f in "abcdefgh" for r in "12345678"]
    lines += [(fen, [m]) for fen in fens[4:] for m in {B.uci(m) for m in B.Board(fen).legal_moves()} | {rng.choice(squares) + rng.choice(squares) + rng.choice(("", "", "q")) for _ in range(200)}]
    sizes = {f: {B.uci(m): m for m in B.Board(f).legal_moves()} for f in fens[4:]}
    for need, most in ((True, None), (False, 6)):
        got = review._named_together([f for f, _ in lines], [m for _, m in lines], need, most)
        for n, ((fen, moves), told) in enumerate(zip(lines, got)):
            if n < 150 or moves[0] in sizes[fen]:
                assert told == review._named(fen, moves, need, most), (fen, moves)
            else:
                assert told == {"error": "illegal variation"}, (fen, moves)
