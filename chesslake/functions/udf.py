"""SQL functions and table functions of the chess kernel. Functions take Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..kernel import board as B
from ..kernel import pgn as P


def _each(values: pd.Series, fn) -> pd.Series:
    """`fn` of every value; null for null and for what raises ValueError."""

    def safe(v):
        try:
            return None if v is None else fn(v)
        except ValueError:
            return None

    return pd.Series([safe(v) for v in values], dtype=object)


@pandas_udf(T.BinaryType())
def position_key(fen: pd.Series) -> pd.Series:
    return _each(fen, lambda f: B.Board(f).key())


@pandas_udf(T.StringType())
def fen_normalize(fen: pd.Series) -> pd.Series:
    return _each(fen, lambda f: B.Board(f).fen())


@pandas_udf(T.StringType())
def fen_error(fen: pd.Series) -> pd.Series:
    """What is wrong with a FEN; null for a position."""

    def kind(f):
        try:
            B.Board(f)
        except B.FenError as error:
            return str(error)

    return pd.Series([None if f is None else kind(f) for f in fen], dtype=object)


@pandas_udf(T.BooleanType())
def in_check(fen: pd.Series) -> pd.Series:
    return _each(fen, lambda f: B.Board(f).in_check())


@pandas_udf(T.LongType())
def perft(fen: pd.Series, depth: pd.Series) -> pd.Series:
    """Legal games of so many plies from a position."""

    def count(pair):
        try:
            return None if None in pair else B.perft(B.Board(pair[0]), int(pair[1]))
        except ValueError:
            return None

    return pd.Series([count(p) for p in zip(fen, depth)], dtype=object)


@udtf(returnType="san string, uci string, fen string")
class LegalMoves:
    """The legal moves of a position, in notation and as the position after them."""

    def eval(self, fen: str):
        board = B.Board(fen)
        for move in board.legal_moves():
            after = board.copy()
            after.apply(*move)
            yield board.san(*move), B.uci(move), after.fen()


@udtf(returnType="ply int, san string, uci string, fen string, error string")
class Replay:
    """Plays moves given as text from a position (or the start); ends with a row that says what went wrong."""

    def eval(self, fen: str, moves: str):
        try:
            board = B.Board(fen or None)
            for ply, san in enumerate((moves or "").split(), 1):
                before = board.copy()
                move = board.play_san(san)
                yield ply, before.san(*move), B.uci(move), board.fen(), None
        except ValueError as error:
            yield None, None, None, None, str(error)


@udtf(returnType="seq int, kind string, text string, depth int")
class PgnEvents:
    """The structural events of PGN text."""

    def eval(self, text: str):
        try:
            for seq, e in enumerate(P.events((text or "").encode())):
                yield seq, e.kind, e.text.decode("utf-8", "replace"), e.depth
        except P.PgnError as error:
            yield -1, "error", error.kind, 0


def play_uci(fen: str, text: str) -> str:
    """The position after a legal move in coordinates; raises ValueError for any other."""
    board = B.Board(fen)
    for move in board.legal_moves():
        if B.uci(move) == text:
            board.apply(*move)
            return board.fen()
    raise ValueError(f"{text} is no legal move")


def register(spark: SparkSession) -> None:
    for name, fn in (("position_key", position_key), ("fen_normalize", fen_normalize), ("fen_error", fen_error), ("in_check", in_check), ("perft", perft)):
        spark.udf.register(name, fn)
    for name, table in (("legal_moves", LegalMoves), ("replay", Replay), ("pgn_events", PgnEvents)):
        spark.udtf.register(name, table)
