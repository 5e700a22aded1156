"""Data-quality checks of games: one diagnostic per faulty game, with its place in the source."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernel import board as B
from ..kernel import pgn as P
from ..kernel.batch import Replay

DIAGNOSTICS = "source string, game long, byte_offset long, moves long, category string, ply long, byte long, context string, message string, headers map<string,string>, line long, `column` long, excerpt string"
_SAN_CATEGORY = {"empty": "invalid_san"}
_RESULTS = (b"1-0", b"0-1", b"1/2-1/2", b"*")
EXCERPT = 200


class _Fault(Exception):
    def __init__(self, category: str, offset: int, ply: int | None, context: str | None, message: str):
        self.details = (category, offset, ply, context, message)


def _show(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def _begin(tags: dict[str, tuple[bytes, int]]) -> B.Board:
    """The start position; FEN, then SetUp, then the Result tag's domain are checked."""
    board = B.Board()
    fen, setup, result = (tags.get(k) for k in ("FEN", "SetUp", "Result"))
    if fen:
        try:
            board = B.Board(_show(fen[0]))
        except B.FenError as error:
            raise _Fault("invalid_fen", fen[1], 0, _show(fen[0]), str(error)) from None
    trouble = None
    if setup and setup[0] not in (b"0", b"1"):
        trouble = (setup, "SetUp is neither 0 nor 1")
    elif setup and setup[0] == b"1" and not fen:
        trouble = (setup, "SetUp is 1 without a FEN tag")
    elif fen and setup and setup[0] != b"1":
        trouble = (setup, "a FEN tag needs SetUp 1")
    elif fen and not setup:
        trouble = (fen, "a FEN tag needs a SetUp tag")
    if trouble:
        raise _Fault("inconsistent_setup", trouble[0][1], None, _show(trouble[0][0]), trouble[1])
    if result and result[0] not in _RESULTS:
        raise _Fault("inconsistent_result", result[1], None, _show(result[0]), "the Result tag is no result")
    return board


_HEADERS = ("Event", "Date", "Round", "White", "Black")
_PART = re.compile(rb"([0-9]+)(\.+)|([^ \n.()]+)|[()]")
_NUMBERS = [b"%d." % n for n in range(1, 301)]
#: Of games with a number before every move, as those with a comment after every move have.
_EACH_NUMBER = [b"%d." % n + b".." * side for n in range(1, 301) for side in (0, 1)]


def _simple(raw: bytes, semantic: bool) -> tuple[list[list[bytes]], int, dict] | None:
    """Lines to play, moves and headers of an easy game without a setup whose tags and numbers are right; None for any other.

    The first line is the mainline; a variation is the moves before the one that it replaces, and its own.
    """
    easy = P.easy_game(raw)
    if easy is None:
        return None
    pairs, text, outcome = easy
    tags = {name.decode(): value for name, value in pairs}
    if semantic and ("FEN" in tags or "SetUp" in tags or tags.get("Result", outcome) != outcome):
        return None
    moves = text.split()
    numbers = moves[::3]
    if numbers == _NUMBERS[: len(numbers)] and text.count(b".") == len(numbers) and b"(" not in text:
        del moves[::3]
        lines, n = [moves], len(moves)
    elif (each := moves[::2]) == _EACH_NUMBER[: len(each)] and text.count(b".") == 2 * len(each) - len(each) % 2 and b"(" not in text:
        lines, n = [moves[1::2]], len(moves) // 2
    else:
        main: list[bytes] = []
        lines, here, n = [main], main, 0
        for m in _PART.finditer(text):
            if m[3]:
                here.append(m[3])
                n += 1
            elif m[1]:
                if semantic and (int(m[1]), len(m[2])) != (len(here) // 2 + 1, 1 if len(here) % 2 == 0 else 3):
                    return None
            elif m[0] == b"(":
                here = main[:-1]
                lines.append(here)
            else:
                here = main
    return lines, n, {k: _show(tags[k]) for k in _HEADERS if k in tags}


def validate_all(games: list[bytes], semantic: bool = True) -> list[dict]:
    """`validate` of each game: those that look sound are replayed together, and only the others and those that are not are walked."""
    simple = [_simple(raw, semantic) for raw in games]
    at = [i for i, s in enumerate(simple) if s is not None]
    sound = np.ones(len(games), bool)
    if semantic and at:
        lines = [line for i in at for line in simple[i][0]]
        owner = np.repeat(at, [len(simple[i][0]) for i in at])
        flat = pa.array([m for line in lines for m in line], pa.binary()).dictionary_encode()
        run = Replay([""] * len(lines), np.array([len(line) for line in lines]), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), [_show(m) for m in flat.dictionary.to_pylist()]).finish()
        sound[owner[[e is not None for e in run.error]]] = False
    return [{"moves": s[1], "fault": None, "headers": s[2]} if s is not None and fine else _walked(raw, semantic) for s, fine, raw in zip(simple, sound.tolist(), games)]


def validate(raw: bytes, semantic: bool = True) -> dict:
    """The first fault of a framed game and the moves before it. Tags that repeat count with their last value."""
    return validate_all([raw], semantic)[0]


def _walked(raw: bytes, semantic: bool) -> dict:
    tags: dict[str, tuple[bytes, int]] = {}
    board = previous = None
    branches: list[tuple] = []
    moves = ply = 0
    fault = None
    try:
        for e in P.events(raw):
            if e.kind == "tag":
                name, value = e.text.split(b"\0", 1)
                tags[name.decode()] = (P.tag_value(value), e.start)
            elif e.kind == "movetext_start" and semantic:
                board = previous = _begin(tags)
            elif e.kind == "san":
                ply += 1
                if semantic:
                    previous, board = board, board.copy()
                    try:
                        board.play_san(_show(e.text))
                    except B.SanError as error:
                        raise _Fault(_SAN_CATEGORY.get(str(error), str(error)), e.start, ply, _show(e.text), "the move cannot be played") from None
                moves += 1
            elif semantic and e.kind == "variation_start":
                branches.append((board, previous))
                board = previous
            elif semantic and e.kind == "variation_end":
                board, previous = branches.pop()
            elif semantic and e.kind == "move_number" and (e.number, e.dots) != (board.full, 1 if board.white else 3):
                raise _Fault("incorrect_move_number", e.start, ply + 1, _show(e.text), f"expected {board.full}{'.' if board.white else '...'}")
            elif semantic and e.kind == "outcome" and e.depth == 0 and (declared := tags.get("Result")) and declared[0] != e.text:
                raise _Fault("inconsistent_result", e.start, None, f"Result={_show(declared[0])}, movetext={_show(e.text)}", "the Result tag differs from the outcome")
    except P.PgnError as error:
        fault = ("syntax", error.offset, None, None, error.kind)
    except _Fault as error:
        fault = error.details
    headers = {k: _show(tags[k][0]) for k in _HEADERS if k in tags}
    return {"moves": moves, "fault": fault, "headers": headers}


def locate(raw: bytes, offset: int) -> tuple[int, int, str]:
    """Line ends before the byte, its column from 1, and its line, of which EXCERPT bytes around it where it is longer.

    Lines end at line feeds; a carriage return is a character of its line but no part of an excerpt's end.
    """
    start = raw.rfind(b"\n", 0, offset) + 1
    end = raw.find(b"\n", offset)
    end = len(raw) if end < 0 else end
    low, high = start, end
    if end - start > EXCERPT:
        low = min(max(offset - EXCERPT // 2, start), end - EXCERPT)
        high = low + EXCERPT
    text = ("…" if low > start else "") + _show(raw[low:high]) + ("…" if high < end else "")
    return raw.count(b"\n", 0, offset), offset - start + 1, text.removesuffix("\r")


def diagnose(frames: DataFrame, semantic: bool = True) -> DataFrame:
    """One row per game: moves, and where there is a fault its category, ply, byte in the source and place in lines.

    Games are numbered from 1. `line` holds for the whole source where the frames tell the line ends before each game
    (`first_line`), as `read_frames` does; else it is the game's own.
    """

    def run(batches):
        for batch in batches:
            rows, columns = [], [batch.column(k).to_pylist() for k in range(6)]
            columns[3] = [raw or b"" for raw in columns[3]]
            for source, number, base, raw, error, lines, got in zip(*columns, validate_all(columns[3], semantic)):
                fault = got["fault"] or ((("limit" if error == "game_too_large" else "syntax"), len(raw), None, None, error) if error else None)
                place = locate(raw, fault[1]) if fault else (None, None, None)
                place = place if place[0] is None else (lines + place[0] + 1, *place[1:])
                category, offset, ply, context, message = fault or (None,) * 5
                rows.append((source, number + 1, base, got["moves"], category, ply, None if offset is None else base + offset, context, message, list(got["headers"].items()), *place))
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.string()]
                names = ["source", "game", "byte_offset", "moves", "category", "ply", "byte", "context", "message", "headers", "line", "column", "excerpt"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    before = F.col("first_line") if "first_line" in frames.columns else F.lit(0).cast("long")
    return frames.select("source", "source_game", "byte_offset", "raw", "error", before.alias("first_line")).mapInArrow(run, DIAGNOSTICS)


def inputs(failed: DataFrame) -> DataFrame:
    """Diagnostics of sources (source, message) that could not be read: the category `input`, without a game."""
    empty = lambda kind: F.lit(None).cast(kind)
    own = {"source": F.col("source"), "moves": F.lit(0).cast("long"), "category": F.lit("input"), "message": F.col("message")}
    fields = [f.strip().rsplit(" ", 1) for f in DIAGNOSTICS.replace("map<string,string>", "map").split(",")]
    return failed.select(*(own[n].alias(n) if n in own else empty("map<string,string>" if t == "map" else t).alias(n) for n, t in ((f[0].strip("`"), f[1]) for f in fields)))


def first_faults(diagnostics: DataFrame) -> DataFrame:
    """The first fault of each source, which a scan that stops there gives."""
    found = diagnostics.where("category IS NOT NULL")
    return found.groupBy("source").agg(F.min_by(F.struct(*(c for c in found.columns if c != "source")), F.coalesce("game", F.lit(0))).alias("f")).select("source", "f.*")


def exit_status(diagnostics: DataFrame) -> DataFrame:
    """source and status: 0 valid, 1 invalid, 3 for what could not be read (2 is a wrong request)."""
    worst = F.max(F.when(F.col("category") == "input", 3).when(F.col("category").isNotNull(), 1).otherwise(0))
    return diagnostics.groupBy("source").agg(worst.alias("status"))


def limited(diagnostics: DataFrame, most: int = 1) -> DataFrame:
    """The first `most` faults of each source."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("game"))
    return diagnostics.where("category IS NOT NULL").withColumn("place", place).where(F.col("place") <= most).drop("place")


def totals(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("source").agg(F.count(F.lit(1)).alias("games"), F.sum("moves").alias("moves"), F.count("category").alias("faults"))
