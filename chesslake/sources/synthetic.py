"""Different legal games made from ids: random moves of all kinds, with comments and variations.

The games of a batch are played side by side on bitboards. At each ply every game draws a piece and a target among what the piece
attacks until the move is legal; a game whose draws all fail is over. A game depends on its id and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import batch as K
from ..kernel import board as B

GAMES = "game_id long, plies int, comments int, variations int, promotions int, pgn binary"
#: Draws of a move before a game is given up, in rounds: of the few games that still have none, many draws are looked at at once and the first good one counts.
_ROUNDS = (1, 1, 1, 1, 2, 4, 8, 16, 26)
#: Games that are played side by side.
_TOGETHER = 10_000
_LETTERS = ("", "N", "B", "R", "Q", "K")


def _noise(ids: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A random word for each id, the same wherever it is drawn."""
    x = (ids.astype(np.uint64) + np.asarray(salt & 0xFFFFFFFF).astype(K.U)) * K.U(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> K.U(shift))) * K.U(factor)
    return x ^ (x >> K.U(31))


_ONES, _TOPS = K.U(0x0101010101010101), K.U(0x8080808080808080)


@cache
def _nth() -> np.ndarray:
    """The bit of each byte that has so many below it, at 8 times the byte and their number."""
    out = np.zeros((256, 8), dtype=K.U)
    for byte in range(256):
        bits = [1 << k for k in range(8) if byte >> k & 1]
        out[byte, : len(bits)] = bits
    return out.ravel()


def _draw(words: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A random one of the bits of each word; of words without any, 0."""
    upto = np.bitwise_count(words.view(np.uint8)).view(K.U) * _ONES  # bits of a word's bytes up to each
    skip = noise % np.maximum(upto >> K.U(56), K.U(1))
    shift = np.bitwise_count(((skip * _ONES | _TOPS) - upto) & _TOPS).astype(K.U) * K.U(8) & K.U(56)  # of the byte with the bit
    left = skip - (upto << K.U(8) >> shift & K.U(255))
    return _nth()[(words >> shift & K.U(255)) * K.U(8) + left] << shift


def _targets(black: np.ndarray, ep: np.ndarray, ours: np.ndarray, theirs: np.ndarray, kind: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The squares that the piece on a square attacks or, a pawn, may go to."""
    t = K._tables()
    every = ours | theirs
    out = np.zeros(len(a), dtype=K.U)
    for k in range(6):
        at = np.flatnonzero(kind == k)
        if not len(at):
            continue
        s, taken = a[at], every[at]
        if k == K._P:
            down = black[at]
            step = np.where(down, -8, 8)
            one = t["bit"][s + step] & ~taken
            two = np.where((one != 0) & (s // 8 == np.where(down, 6, 1)), t["bit"][np.clip(s + 2 * step, 0, 63)] & ~taken, K.U(0))
            out[at] = one | two | (t["pawn_from"][1 - down.astype(np.int64), s] & (theirs[at] | t["bit"][ep[at]]))
        elif k in (K._N, K._K):
            out[at] = t["NK"[k == K._K]][s]
        else:
            out[at] = (K._bishop(s, taken) if k in (K._BI, K._Q) else K.U(0)) | (K._rook(s, taken) if k in (K._R, K._Q) else K.U(0))
    return out & ~ours


#: A move in notation, without a check sign, as one number: kind, hints of file and rank (8: none), takes, target and promotion (0: none, else a place of these).
_PROMOTIONS, _SHAPE = " QRBN", (6, 9, 9, 2, 64, 5)


@cache
def _notation(code: int) -> str:
    kind, file, rank, takes, to, promotion = (int(x) for x in np.unravel_index(code, _SHAPE))
    return _LETTERS[kind] + "abcdefgh "[file].strip() + "12345678 "[rank].strip() + "x" * takes + B.SQUARES[to] + (f"={_PROMOTIONS[promotion]}" if promotion else "")


@cache
def _row(code: int) -> tuple[int, ...]:
    """The move as a row of `notations`, read from its text."""
    table, faults = K.notations([_notation(code)])
    if faults[0]:
        raise ValueError(f"made no move: {_notation(code)}")
    return tuple(table[0].tolist())


def _told(codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The moves as texts and as rows of `notations`."""
    some, place = np.unique(codes, return_inverse=True)
    texts = pa.array([_notation(c) for c in some.tolist()], pa.string()).take(pa.array(place))
    return texts, np.array([_row(c) for c in some.tolist()], dtype=np.int64).reshape(-1, 7)[place]


def _choose(b: K.Boards, ids: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Which games have a move, and the number of its notation."""
    n = len(ids)
    own, other = b.sides()
    a, to, kind, fine = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    ours, theirs = np.bitwise_or.reduce(own, axis=0), np.bitwise_or.reduce(other, axis=0)
    every = ours | theirs
    left, draw = np.arange(n), 0
    for together in _ROUNDS:
        if not len(left):
            break
        at = np.tile(left, together)
        noise = _noise(ids[at], salt * 64 + np.repeat(np.arange(draw, draw + together), len(left)))
        draw += together
        bit = _draw(ours[at], noise)
        k = np.argmax((own[:, at] & bit) != 0, axis=0)
        from_ = K._square(bit)
        goal = _draw(_targets(b.black[at], b.ep[at], ours[at], theirs[at], k, from_), noise >> K.U(32))
        some = np.flatnonzero(goal)
        of, k, from_, goal = at[some], k[some], from_[some], goal[some]
        square = K._square(goal)
        by_ep = (k == K._P) & ((every[of] & goal) == 0) & (from_ % 8 != square % 8)
        good = np.flatnonzero(K._safe(own[:, of], other[:, of], b.black[of], k, from_, square, by_ep))[::-1]  # of a game's draws the first is put last, and stays
        of = of[good]
        fine[of], a[of], to[of], kind[of] = True, from_[good], square[good], k[good]
        left = left[~fine[left]]
    at = np.flatnonzero(fine)
    t = K._tables()
    rivals = np.zeros(n, dtype=K.U)  # others of the kind that see the target
    for k in range(1, 6):
        of = at[kind[at] == k]
        rivals[of] = K._seen(kind[of], to[of], every[of]) & own[k, of] & ~t["bit"][a[of]]
    takes = (every & t["bit"][to]) != 0
    a, to, kind, rivals, takes = a[at], to[at], kind[at], rivals[at], takes[at]
    pawn, some = kind == K._P, rivals != 0
    by_file = some & ((rivals & t["file"][a % 8]) == 0)
    by_rank = some & ~by_file & ((rivals & t["rank"][a // 8]) == 0)
    file = np.where(np.where(pawn, a % 8 != to % 8, some & ~by_rank), a % 8, 8)
    rank = np.where(some & ~by_file, a // 8, 8)
    promotion = np.where(pawn & ((to < 8) | (to >= 56)), 1 + (_noise(ids[at], salt * 64 + 63) % K.U(4)).astype(np.int64), 0)
    return at, np.ravel_multi_index((kind, file, rank, np.where(pawn, a % 8 != to % 8, takes).astype(np.int64), to, promotion), _SHAPE)


def play_games(ids: np.ndarray, plies: int, seed: int = 0) -> Iterator[dict]:
    """The rows of `played`."""
    yield from played(ids, plies, seed).to_pylist()


def played(ids: np.ndarray, plies: int, seed: int = 0) -> pa.RecordBatch:
    """A game of up to `plies` (three quarters of them at least, unless it ends) for each id, as PGN with the number of its parts.

    Of three games one has a clock comment after every move, another a variation at every tenth move.
    """
    n = len(ids)
    here = K.Boards.of([B.Board()]).take(np.zeros(n, np.int64))
    going = np.arange(n)
    length = plies - (_noise(ids, seed * 7 + 1) % K.U(max(1, plies // 4))).astype(np.int64)
    counts = np.zeros((n, 4), dtype=np.int64)
    outcome, mated = np.full(n, "*", dtype=object), np.zeros(n, bool)
    style = (_noise(ids, seed * 7 + 2) % K.U(3)).astype(np.int64)
    owners, parts = [np.zeros(0, np.int64)], [pa.array([], pa.string())]  # of each ply: whose move, and what is written of it
    for ply in range(plies):
        keep = np.flatnonzero(length[going] > ply)
        going, here = going[keep], here.take(keep)
        if not len(going):
            break
        at, codes = _choose(here, ids[going], seed * 1000 + ply)
        for i in np.setdiff1d(np.arange(len(going)), at).tolist():
            board = here.board(i)
            if not board.legal_moves() and board.in_check():
                g = int(going[i])
                outcome[g], mated[g] = "0-1" if board.white else "1-0", True
        sans, table = _told(codes)
        number = f"{ply // 2 + 1}{'.' if ply % 2 == 0 else '...'} "
        own = going[at]
        aside = np.full(len(at), "", dtype=object)
        if ply % 10 == 9:
            varied = np.flatnonzero(style[own] == 2)
            which, others = _choose(here.take(at[varied]), ids[own[varied]], seed * 1000 + 500 + ply)
            aside[varied[which]] = [f" ({number}{san})" for san in _told(others)[0].to_pylist()]
            counts[own[varied[which]], 2] += 1
        here, fault, _, _ = K.play(here.take(at), table)
        if fault.any():
            raise ValueError(f"made an impossible move: {sans[int(np.flatnonzero(fault)[0])]}")
        us, them = here.sides()
        check = K._attacked(K._square(us[K._K]), them, ~here.black, np.bitwise_or.reduce(here.pieces, axis=0))
        clocked = style[own] == 1
        counts[own, 0] += 1
        counts[own, 1] += clocked
        counts[own, 3] += table[:, 5] > 0
        clock = f" {{[%clk 0:{59 - ply // 60:02d}:{59 - ply % 60:02d}]}}"
        written = (pc.if_else(pa.array(clocked | (ply % 2 == 0)), number, ""), sans, pc.if_else(pa.array(check), "+", ""), pc.if_else(pa.array(clocked), clock, ""), pa.array(aside, pa.string()))
        owners.append(own)
        parts.append(pc.binary_join_element_wise(*written, ""))
        going = own
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    pieces = pa.concat_arrays(parts).take(pa.array(order))
    ends = np.cumsum(np.bincount(owner, minlength=n))
    last = ends[mated & (counts[:, 0] > 0) & (style != 1)] - 1
    if len(last):
        mate = np.zeros(len(pieces), bool)
        mate[last] = True
        pieces = pc.if_else(pa.array(mate), pc.replace_substring(pieces, "+", "#"), pieces)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pieces), " ")
    told, result = (lambda values: pa.array(values).cast(pa.string())), pa.array(outcome, pa.string())
    head = ('[Event "Made up"]\n[Site "', told(ids), '"]\n[White "w', told(ids % 89), '"]\n[Black "b', told(ids % 97), '"]\n[Result "', result, '"]\n[WhiteElo "', told(1000 + ids % 1500), '"]\n\n')
    pgn = pc.binary_join_element_wise(*head, text, " ", result, "\n\n", "").cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int32()) for c in counts.T), pgn], names=["game_id", "plies", "comments", "variations", "promotions", "pgn"])


def random_games(ids: DataFrame, plies: int = 80, seed: int = 0) -> DataFrame:
    """game_id, plies, comments, variations, promotions and pgn of a game for each id (the first column of `ids`)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(own), _TOGETHER):
                yield played(own[k : k + _TOGETHER], plies, seed)

    return ids.select(F.col(ids.columns[0]).cast("long")).where(F.col(ids.columns[0]).isNotNull()).mapInArrow(make, GAMES)
