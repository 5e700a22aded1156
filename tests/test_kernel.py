import itertools
import random

import pytest

from chesslake.kernel import pgn as P
from chesslake.kernel.board import SQUARES, START_FEN, Board, FenError, SanError, perft, uci

KIWIPETE = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"


def test_key_and_fen_of_the_start():
    assert Board().key().hex() == "a0fcaf7dd08a1dd221e64656ada2fc8e"
    assert Board().fen() == START_FEN and len(Board().board64()) == 64


@pytest.mark.parametrize("fen, counts", [(START_FEN, (20, 400, 8902)), (KIWIPETE, (48, 2039)), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", (14, 191, 2812))])
def test_perft(fen, counts):
    assert tuple(perft(Board(fen), d + 1) for d in range(len(counts))) == counts


def wandering(seed, plies):
    """Positions of a random game, with the moves that lead on."""
    rng, board = random.Random(seed), Board()
    for _ in range(plies):
        moves = board.legal_moves()
        if not moves:
            return
        yield board, moves
        board = board.copy()
        board.apply(*rng.choice(moves))


def names_of(board, moves, move):
    """All notations that a move may have by the rules: with no, one or both parts of where it comes from."""
    start, end, promotion = SQUARES[move[0]], SQUARES[move[1]], move[2] and f"={move[2]}"
    piece, taken = board.cells[move[0]].upper(), board.cells[move[1]] != "." or (board.cells[move[0]].upper() == "P" and start[0] != end[0])
    if piece == "K" and abs(ord(start[0]) - ord(end[0])) == 2:
        return ["O-O" if end[0] == "g" else "O-O-O"]
    if piece == "P":
        return [f"{start[0]}x{end}{promotion}" if taken else f"{end}{promotion}"]
    rivals = [m for m in moves if m[1] == move[1] and m != move and board.cells[m[0]].upper() == piece]
    parts = [("", lambda s: True), (start[0], lambda s: s[0] == start[0]), (start[1], lambda s: s[1] == start[1]), (start, lambda s: s == start)]
    return [f"{piece}{part}{'x' * taken}{end}" for part, fits in parts if not any(fits(SQUARES[m[0]]) for m in rivals)]


@pytest.mark.parametrize("seed", range(12))
def test_notation_follows_from_the_legal_moves(seed):
    """The shortest notation that only this move has, and every longer one, is read back as the move; the check signs are those of the position after it."""
    for board, moves in wandering(seed, 90):
        for move in moves:
            names = names_of(board, moves, move)
            after = board.copy()
            after.apply(*move)
            sign = ("#" if not after.legal_moves() else "+") if after.in_check() else ""
            assert board.san(*move) == names[0] + sign
            for name in names:
                for text in (name, name + sign, name.replace("O", "0") if name.startswith("O") else name + "!?"):
                    assert board.copy().play_san(text) == move
            assert uci(move) == SQUARES[move[0]] + SQUARES[move[1]] + move[2].lower()


def test_a_pawn_on_its_last_rank_has_no_moves():
    for fen in ("P3k3/8/8/8/8/8/8/4K3 w - - 0 1", "4k3/8/8/8/8/8/8/p3K3 b - - 0 1", "4k2P/8/8/8/8/8/8/p3K3 w - - 0 1"):
        board = Board(fen)
        assert all(board.cells[m[0]] not in "Pp" for m in board.legal_moves()) and len(board.key()) == 16


@pytest.mark.parametrize(
    "san, kind",
    [("", "empty"), ("!?", "empty"), ("e9", "invalid_san"), ("exd", "invalid_san"), ("Ke5", "illegal_move"), ("e5", "illegal_move"), ("O-O", "illegal_move"), ("e4+", "invalid_check_suffix"), ("e4=Q", "invalid_san"), ("Nxf3", "illegal_move"), ("zz9", "invalid_san")],
)
def test_moves_that_cannot_be_played(san, kind):
    with pytest.raises(SanError, match=kind):
        Board().play_san(san)


def test_ambiguous_move():
    with pytest.raises(SanError, match="ambiguous_move"):
        Board("4k3/8/8/8/8/2N1N3/8/4K3 w - - 0 1").play_san("Nd5")


@pytest.mark.parametrize(
    "fen, kind",
    [
        ("8/8 w - - 0", "missing_field"), (START_FEN + " x", "too_many_fields"), ("8/8/8/8/8/8/8/9 w - - 0 1", "invalid_board"), (START_FEN.replace(" w ", " x "), "invalid_side"), (START_FEN.replace("KQkq", "KX"), "invalid_castling"),
        (START_FEN.replace("KQkq -", "KQkq e4"), "invalid_en_passant"), (START_FEN.replace("0 1", "x 1"), "invalid_halfmove"), (START_FEN.replace("0 1", "0 0"), "invalid_fullmove"), ("8/8/8/8/8/8/8/K7 w - - 0 1", "invalid_kings"),
    ],
)
def test_fens_that_are_none(fen, kind):
    with pytest.raises(FenError, match=kind):
        Board(fen)


def test_key_takes_only_a_usable_en_passant_square():
    usable, none = Board("4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 1"), Board("4k3/8/8/3pP3/8/8/8/4K3 w - - 0 1")
    assert usable.key() != none.key()
    played = Board()
    played.play_san("e4")
    assert played.fen().split()[3] == "e3" and played.key() == Board(played.fen().replace("e3", "-")).key()


def test_castling_rights_go_with_rook_and_king():
    board = Board("r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1")
    board.play_san("Rxa8+")
    assert board.fen().split()[2] == "Kk"
    board.play_san("Ke7")
    assert board.fen().split()[2] == "K"


@pytest.mark.parametrize(
    "text, kind, offset",
    [
        (b"1. e4 (", "unclosed_variation", 7), (b"1. e4", "missing_outcome", 5), (b"1.. e4 *", "invalid_move_number", 0), (b"1. e4 $4294967296 *", "invalid_nag", 6), (b"1. e4 $ *", "invalid_nag", 6), (b"1. e4 } *", "unexpected_byte", 6),
        (b'[A "x', "unterminated_tag_value", 5), (b'[ "x"]', "expected_tag_name", 2), (b"[A x]", "expected_tag_value", 3), (b'[A "x"', "expected_closing_bracket", 6), (b'[A "x\n"]', "newline_in_tag", 5),
        (b"1. e4 {x", "unterminated_comment", 6), (b"1. e4 ) *", "unmatched_variation_end", 6), (b'1. e4 [A "x"] *', "unexpected_header", 6), (b"4294967296. e4 *", "invalid_move_number", 0),
    ],
)
def test_faults_of_pgn(text, kind, offset):
    assert P.parse_game(text)["error"] == {"kind": kind, "offset": offset}


def test_tags_moves_and_outcomes():
    game = P.parse_game(b'[White "A\\"b\\\\"]\n[White "C"]\n\n1. e4 {c 1-0} e5 (1... c5 1-0 2. Nf3) 2. Nf3! $3 ; x 0-1\n%y\nNc6 1/2-1/2')
    assert game["tags"] == {"White": b'A"b\\'} and game["moves"] == ["e4", "e5", "Nf3", "Nc6"] and game["outcome"] == 3 and game["error"] is None


def test_lenient_games_need_no_outcome():
    two = b'1. e4 e5\n\n[White "x"]\n1. d4'
    assert [e.kind for e in P.events(two, strict=False)].count("game_end") == 2
    assert P.parse_game(two)["error"]["kind"] == "unexpected_header"


def test_frames_keep_leading_blanks_and_report_the_rest():
    data = b'[White "1-0"]\n1. e4 {*} (1. d4 *) 1-0\n\n1. d4 ; 0-1\n*\n\n1. c4'
    frames = list(P.frame(data))
    assert [f.raw for f in frames[:2]] == [b'[White "1-0"]\n1. e4 {*} (1. d4 *) 1-0', b"\n\n1. d4 ; 0-1\n*"]
    assert frames[2].error == "missing_outcome" and frames[1].offset == len(frames[0].raw)
    assert [f.error for f in P.frame(b"1. e4 " * 10, max_bytes=20)] == ["game_too_large"]
    assert list(P.frame(b" \n")) == []


def test_lexer_never_breaks_on_short_texts():
    for n in range(5):
        for text in itertools.product(b'" \n[{%1*$!', repeat=n):
            data = bytes(text)
            P.parse_game(data)
            assert b"".join(f.raw for f in P.frame(data) if f.error is None) == data[: sum(len(f.raw) for f in P.frame(data) if f.error is None)]
