"""Many games at once: replay on bitboards, made-up games and easy games, held against one board and the event parser."""

import random

import numpy as np
import pytest

from chesslake.kernel import batch, pgn as P
from chesslake.kernel.board import Board, FenError, SanError, uci
from chesslake.operators import doctor
from chesslake.sources import pgn, synthetic

FENS = [
    "", "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", "r3k2r/8/8/8/8/8/8/R3K2R b KQkq - 0 1", "8/P6k/8/8/8/8/p6K/8 w - - 0 1",
    "rnbqkbnr/ppp1p1pp/8/3pPp2/8/8/PPPP1PPP/RNBQKBNR w KQkq f6 0 3", "8/8/8/1k1Pp2R/8/8/4K3/8 w - e6 0 2", "8/8/8/K2Pp2r/8/8/8/4k3 w - e6 0 2",
]


def wander(rng, fen, plies):
    board, out = Board(fen or None), []
    for _ in range(plies):
        moves = board.legal_moves()
        if not moves:
            break
        rare = [m for m in moves if m[2] or m[1] == board.ep or (board.cells[m[0]] in "Kk" and abs(m[0] - m[1]) == 2)]
        move = rng.choice(rare if rare and rng.random() < 0.5 else moves)
        out.append(board.san(*move))
        board.apply(*move)
    return out


def spoilt(rng, moves):
    moves, i = list(moves), rng.randrange(len(moves))
    moves[i] = rng.choice([rng.choice(["Qa5", "e4", "O-O", "O-O-O", "Kx", "", "Rae1", "Qh4#", "a8=Q", "zz", "0-0"]), moves[i].rstrip("+#") + rng.choice("+#!"), moves[i].replace("x", ""), moves[i][:1] + moves[i][2:]])
    return moves


def by_board(fen, moves):
    try:
        board = Board(fen or None)
    except FenError as error:
        return [], f"invalid_fen:{error}"
    keys = [board.key()]
    for san in moves:
        try:
            board.play_san(san)
        except SanError as error:
            return keys, str(error)
        keys.append(board.key())
    return keys, None


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(17)
    out = [("no fen", ["e4"]), ("", []), (FENS[1], [])]
    for k in range(130):
        fen = rng.choice(FENS)
        moves = wander(rng, fen, rng.randint(1, 90))
        out.append((fen, spoilt(rng, moves) if k % 2 and moves else moves))
    return out


def test_keys_and_faults_are_those_of_the_board(lines):
    run = batch.Replay.of(lines)
    words, counts = run.keys()
    ends = np.cumsum(counts)
    seen = set()
    for i, (fen, moves) in enumerate(lines):
        keys, error = by_board(fen, moves)
        assert [w.tobytes() for w in words[ends[i] - counts[i] : ends[i]]] == keys and run.error[i] == error
        seen.add(error)
    assert {None, "illegal_move", "invalid_check_suffix", "invalid_san", "invalid_fen:missing_field"} <= seen


def test_mates_ambiguous_moves_and_promotions():
    lines = [("", "f3 e5 g4 Qh4#".split()), ("", "f3 e5 g4 Qh4+".split()), ("", "e4 e5 Qh5 Ke7 Qxe5#".split()), ("", "e4 e5 Qh5 Nc6 Qxf7#".split()), ("8/P6k/8/8/8/8/8/K7 w - - 0 1", ["a8"]), ("8/P6k/8/8/8/8/8/K7 w - - 0 1", ["a8=N"]),
             ("4k3/8/8/8/8/8/8/R3K2R w KQ - 0 1", ["Rf1"]), ("4k3/8/8/8/R6R/8/8/4K3 w - - 0 1", ["Rd4"]), ("4k3/8/8/8/R6R/8/8/4K3 w - - 0 1", ["Rad4"]), ("k3r3/8/8/8/8/8/4R3/K3R3 w - - 0 1", ["R1xe8+"])]
    run = batch.Replay.of(lines).finish()
    assert run.error == [by_board(*line)[1] for line in lines]
    assert run.error[:5] == [None, None, None, "invalid_check_suffix", "invalid_san"] and run.error[7] == "ambiguous_move"


def test_steps_are_those_of_the_board(lines):
    """Notation with as few hints as needed, coordinates, squares and FEN with its counters, of every ply."""
    got = [[] for _ in lines]
    for _, games, node, own in batch.Replay.of(lines).steps():
        for g, k in zip(games.tolist(), node.tolist()):
            got[g].append(tuple(own[c][k] for c in ("san", "uci", "board", "fen", "position_key")))
    hints = set()
    for (fen, moves), steps in zip(lines, got):
        if fen == "no fen":
            assert steps == []
            continue
        board = Board(fen or None)
        want = [(None, None, board.board64(), board.fen(), board.key())]
        for move in moves:
            before = board.copy()
            try:
                played = board.play_san(move)
            except SanError:
                break
            want.append((before.san(*played), uci(played), board.board64(), board.fen(), board.key()))
            hints.add(len(want[-1][0].rstrip("+#")))
        assert steps == want
    assert {2, 3, 4, 5} <= hints


def test_first_plies_are_those_of_the_board(lines):
    for target in (Board().key(), by_board(*lines[5])[0][-1]):
        want = [next((n for n, k in enumerate(by_board(*line)[0]) if k == target), -1) for line in lines]
        assert batch.Replay.of(lines).first_plies(target).tolist() == want


def test_columns_of_keys(spark):
    rows = [(1, None, None, ["e4", "e5"]), (2, None, "Chess960", ["e4"]), (3, FENS[3], "standard", ["O-O-O", "O-O"]), (4, "8/8", None, ["e4"]), (5, None, None, None), (6, None, None, []), (7, None, None, ["e4", "Ke8"])]
    games = spark.createDataFrame(rows, "game_id int, fen string, variant string, moves array<string>")
    got = {r["game_id"]: r["keys"] and [bytes(k) for k in r["keys"]] for r in pgn.with_position_keys(games).collect()}
    assert got == {i: None if v == "Chess960" or m is None else by_board(f, m)[0] for i, f, v, m in rows}
    first = {r["game_id"]: r["first_ply"] for r in pgn.first_plies(games, Board().key()).collect()}
    assert first == {1: 0, 2: None, 3: None, 4: None, 5: None, 6: 0, 7: 0}


@pytest.fixture(scope="module")
def made():
    return list(synthetic.play_games(np.arange(900, 1100), 80, seed=3))


def test_made_up_games_are_legal_and_different(made):
    assert len({g["pgn"] for g in made}) == len(made) and np.mean([g["plies"] for g in made]) > 55
    assert sum(g["comments"] for g in made) > 1000 and sum(g["variations"] for g in made) > 100 and sum(g["promotions"] for g in made) > 0
    for g in made:
        got = P.parse_game(g["pgn"])
        assert got["error"] is None and len(got["moves"]) == g["plies"]
        assert got["counts"].get("comment_brace", 0) == g["comments"] and got["counts"].get("variation_start", 0) == g["variations"]
        assert doctor._walked(g["pgn"], True)["fault"] is None
    assert made[7] == next(synthetic.play_games(np.array([907]), 80, seed=3))  # a game depends on its id alone


def test_easy_games_are_told_as_by_events(made):
    """Made-up games, cut and changed at random: framing, counts, moves, outcome and diagnosis with and without the short way."""
    rng = random.Random(3)
    easy = 0
    for g in made[:150]:
        raw = g["pgn"]
        for change in range(6):
            data = bytearray(raw)
            for _ in range(change):
                at = rng.randrange(len(data))
                data[at : at + rng.randint(0, 2)] = rng.choice([b"", b"(", b")", b"{", b"}", b"!?", b"$3 ", b"; x\n", b"\n%", b"1-0 ", b" *", b"[", b'"', b"2... ", b"..", b"9", b" "])
            raw_changed = bytes(data)
            easy += P.easy_game(raw_changed) is not None
            assert P.parse_game(raw_changed) == P._parse_events(raw_changed, True)
            assert P.count_game(raw_changed) == {k: v if k != "moves" else len(v) for k, v in (("plies", len(P._parse_events(raw_changed, True)["moves"])), *((k, P._parse_events(raw_changed, True)[k]) for k in ("outcome", "error")))}
            assert doctor.validate(raw_changed) == doctor._walked(raw_changed, True)
            frames = [(f.offset, f.raw, f.error) for f in P.frame(raw_changed * 2)]
            assert frames == framed_plainly(raw_changed * 2)
    assert easy > 200


def framed_plainly(data):
    """Frames by the general way alone."""
    kept, P._EASY_START = P._EASY_START, P.re.compile(rb"(?!)")
    try:
        return [(f.offset, f.raw, f.error) for f in P.frame(data)]
    finally:
        P._EASY_START = kept
