"""Registered queries over games that all differ, and their SQL for another engine.

*Pawn games* are derived from the orders: each side moves its pawns one step at a time, at most two steps a file, in an order that the
order's key decides, so that no move is ever a capture, a check or impossible. A position is how far each pawn has come, which SQL can
tell: equal positions by other orders of moves are found by the other engine without any chess. A third of the games has a clock comment after every
move, a third a variation. *Random games* have moves of all kinds; of them SQL knows what must hold for any game.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..adapters import number_rows, orders, spread
from ..functions import columns as C
from ..kernel.board import START_FEN, Board
from ..operators import doctor, explore, library, store
from ..operators.query import GameQuery
from ..sources import pgn, remote, synthetic
from ..streaming import folders
from .registry import _shared, _staged, games, oracle, query

START_KEY = bytearray(Board().key())
_NOISE = {"w": (31, 7, 17, 13, 5), "b": (57, 11, 19, 29, 3)}
_PRIME = 1_000_003

_TURNS = " UNION ALL ".join(
    f"SELECT id, '{side}' AS side, j % 8 AS f, row_number() OVER (PARTITION BY id ORDER BY v, j) AS turn, row_number() OVER (PARTITION BY id, j % 8 ORDER BY v, j) AS step FROM (SELECT id, j, ((id * {a} + {b}) * (j * j * {c} + j * {d} + {e})) % {_PRIME} AS v FROM ids, (SELECT unnest(range(16)) AS j))"
    for side, (a, b, c, d, e) in _NOISE.items()
)
#: SQL: ids, turns, plies (id, ply, san), positions (id, ply, name), meta (id, plies, style, result, white, aside).
_SQL = f"""
WITH ids AS (SELECT o_orderkey AS id FROM orders),
t AS ({_TURNS}),
p AS (SELECT id, CASE side WHEN 'w' THEN 2 * turn - 1 ELSE 2 * turn END AS ply, side, f, step, chr(CAST(97 + f AS INTEGER)) || CAST(CASE side WHEN 'w' THEN 2 + step ELSE 7 - step END AS VARCHAR) AS san FROM t WHERE turn <= 8 + id % 9),
meta AS (SELECT id, 2 * (8 + id % 9) AS plies, id % 3 AS style, id % 4 AS result, concat('w', CAST(id % 89 AS VARCHAR)) AS white FROM ids),
four AS (SELECT id, count(*) FILTER (f = 0) AS a, count(*) FILTER (f = 7) AS h FROM t WHERE side = 'w' AND turn <= 4 GROUP BY id),
aside AS (SELECT id, CASE WHEN id % 3 <> 2 THEN NULL WHEN a <> 1 THEN 'Na3' WHEN h <> 1 THEN 'Nh3' END AS move FROM four),
n AS (SELECT id, unnest(range(plies + 1)) AS ply FROM meta),
counted AS (SELECT n.id, n.ply, {", ".join(f"CAST(count(*) FILTER (side = '{s}' AND f = {f}) AS VARCHAR) AS {s}{f}" for s in "wb" for f in range(8))} FROM n LEFT JOIN p ON p.id = n.id AND p.ply <= n.ply GROUP BY n.id, n.ply),
v AS (SELECT id, ply, {" || ".join(f"{s}{f}" for s in "wb" for f in range(8))} || CASE WHEN ply % 2 = 0 THEN 'w' ELSE 'b' END AS name FROM counted)
"""


_OUTCOMES = np.array(["*", "1-0", "0-1", "1/2-1/2"], dtype=object)
#: Squares that pawns of a side come to, as 8 * rank + file from a1.
_PLACES = 64


@cache
def _written() -> pa.Array:
    """What is written of a move, at (form * 32 + its place in the game) * 64 + its square; forms are plain, clocked, and varied with Na3 or Nh3."""
    out = []
    for form in range(4):
        for ply in range(32):
            number, white = ply // 2 + 1, ply % 2 == 0
            before = f"{number}. " if white else f"{number}... " if form == 1 or form > 1 and ply == 9 else ""
            after = f" {{[%clk 0:00:{ply + 1:02d}]}}" if form == 1 else f" (5. {('Na3', 'Nh3')[form - 2]})" if form > 1 and ply == 8 else ""
            out += [f"{before}{'abcdefgh'[k % 8]}{k // 8 + 1}{after}" for k in range(_PLACES)]
    return pa.array(out, pa.string())


def _pawn_texts(ids: np.ndarray) -> pa.Array:
    """The games of ids as PGN; the games of a batch are written side by side."""
    n, j, turns = len(ids), np.arange(16), 8 + np.fmod(ids, 9)
    squares = np.zeros((n, 16, 2), dtype=np.int64)
    for k, (a, b, c, m, e) in enumerate(_NOISE.values()):
        drawn = np.fmod((ids * a + b)[:, None] * (j * j * c + j * m + e), _PRIME)
        files = np.argsort(drawn, axis=1, kind="stable") % 8
        steps = np.ones((n, 16), dtype=np.int64)  # no side moves on a file more than twice
        for i in range(1, 16):
            steps[:, i] += (files[:, :i] == files[:, i : i + 1]).sum(axis=1)
        squares[:, :, k] = 8 * (1 + steps if k == 0 else 6 - steps) + files
        if k == 0:
            ones = [(files[:, :4] == f).sum(axis=1) for f in (0, 7)]
    style = np.fmod(ids, 3)
    form = np.where(style == 1, 1, np.where(style != 2, 0, np.where(ones[0] != 1, 2, np.where(ones[1] != 1, 3, 0))))
    told = (form[:, None] * 32 + np.arange(32)) * _PLACES + squares.reshape(n, 32)
    played = np.arange(32) < 2 * turns[:, None]
    moves = _written().take(pa.array(told[played]))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * turns))), pa.int32()), moves), " ")
    outcome = pa.array(_OUTCOMES[np.fmod(ids, 4)], pa.string())
    parts = ('[Event "Pawns"]\n[White "w', pa.array(np.fmod(ids, 89)).cast(pa.string()), '"]\n[Result "', outcome, '"]\n\n', text, " ", outcome, "\n\n", "")
    return pc.binary_join_element_wise(*parts).cast(pa.binary())


def pawn_games(s, d: str, numbered: bool = False, ordered: int = 0) -> DataFrame:
    """id, source, pgn of a pawn game for every order; `numbered` with source_game, its number in its source; `ordered` in so many partitions by ranges of ids, each in their order."""
    ids = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    number = ["source_game"] if numbered else []
    ids = number_rows(ids, "source", "id") if numbered else ids
    ids = (ids.repartitionByRange(ordered, "id").sortWithinPartitions("id") if ordered else spread(ids, "id")).select("id", "source", *number)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            there = own.is_valid()
            texts = _pawn_texts(own.filter(there).to_numpy(zero_copy_only=False))
            at = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
            texts = texts if not own.null_count else texts.take(pa.array(at, mask=~there.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "pgn"])

    return ids.mapInArrow(write, T.StructType([*ids.schema.fields, T.StructField("pgn", T.BinaryType())]))


def _parsed(s, d: str, *fields: str) -> DataFrame:
    return pgn.parse_games(pawn_games(s, d), "pgn", fields=fields)


def _lines(s, d: str, numbered: bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    made = pawn_games(s, d, numbered)
    number = ["source_game"] if numbered else []
    return pgn.parse_games(made, "pgn", fields=("moves", "outcome", "tags")).select(F.col("id").alias("game_id"), "source", *number, "pgn", none.alias("fen"), none.alias("variant"), "moves", F.coalesce("outcome", F.lit(0)).alias("result"), F.col("tags")["White"].alias("white"))


@query(
    "pawn_games_parsed",
    _SQL + """SELECT meta.id, string_agg(p.san, ' ' ORDER BY p.ply) AS moves, CAST(meta.plies AS INTEGER) AS plies, CAST(result AS INTEGER) AS outcome, CAST(CASE WHEN style = 1 THEN meta.plies ELSE 0 END AS BIGINT) AS comments,
      CAST(count(DISTINCT aside.move) AS BIGINT) AS variations, CAST(any_value(CASE WHEN style = 1 THEN meta.plies ELSE meta.plies // 2 + CASE WHEN aside.move IS NULL THEN 0 ELSE 2 END END) AS BIGINT) AS numbers
      FROM meta JOIN p ON p.id = meta.id JOIN aside ON aside.id = meta.id GROUP BY meta.id, meta.plies, result, style""",
    plain=True,
)
def pawn_games_parsed(s, d):
    """Moves, outcome and counts of every game; all games differ, many have comments after every move or a variation."""
    n = lambda kind: F.coalesce(F.try_element_at("counts", F.lit(kind)), F.lit(0).cast("long"))
    rows = _parsed(s, d, "moves", "plies", "outcome", "counts")
    return rows.select("id", F.array_join("moves", " ").alias("moves"), "plies", "outcome", n("comment_brace").alias("comments"), n("variation_start").alias("variations"), n("move_number").alias("numbers"))


@query("pawn_games_framed", _SQL + "SELECT count(*) AS games, CAST(sum(plies) AS BIGINT) AS plies, count(*) FILTER (result = 1) AS white_wins, count(*) FILTER (result = 2) AS black_wins FROM meta", plain=True)
def pawn_games_framed(s, d):
    """The games written as files and read back in ranges, counted without parsing them further."""
    path = _shared(s, "pawns")
    pgn.write_pgn(pawn_games(s, d).withColumn("game_id", F.col("id")), path, suffix=".pgn")
    rows = pgn.read_games(s, path, fields=("plies", "outcome", "error"), range_bytes=1 << 20).where("frame_error IS NULL AND error IS NULL")
    return rows.agg(F.count(F.lit(1)).alias("games"), F.sum("plies").alias("plies"), F.count_if(F.col("outcome") == 1).alias("white_wins"), F.count_if(F.col("outcome") == 2).alias("black_wins"))


_COUNTED = "count(*) AS games, CAST(sum(plies) AS BIGINT) AS plies, count(*) FILTER (style = 1) AS commented"


@query("pawn_games_zstd", _SQL + f"SELECT source, {_COUNTED}, true AS numbered FROM meta JOIN (SELECT o_orderkey AS id, o_orderpriority AS source FROM orders) USING (id) GROUP BY source", plain=True)
def pawn_games_zstd(s, d):
    """The games written as Zstandard files of many frames and read back by frames: what is in them, and that games are numbered through each file."""
    remote.register(s)
    path = _shared(s, "pawns")
    # ids are put in order before the games are written of them, so no text is shuffled; what is read is kept, as two totals are made of it
    rows = pawn_games(s, d, ordered=s.sparkContext.defaultParallelism).select(F.concat(F.lit('[Origin "'), F.col("source"), F.lit('"]\n'), F.col("pgn").cast("string")).alias("pgn"))
    rows.write.format("pgn").mode("append").option("compression", "zstd").option("frameBytes", 1 << 16).save(path)
    read = pgn.read_games(s, path, fields=("tags", "plies", "error", "counts"), range_bytes=1 << 15).where("frame_error IS NULL AND error IS NULL")
    told = _staged(s, read.select(F.col("tags")["Origin"].alias("origin"), "plies", F.try_element_at("counts", F.lit("comment_brace")).isNotNull().alias("commented"), "source", "source_game", "byte_offset"), "told")
    # numbers of a file's games are gapless and rise with their places: a sum over games of number times 1 equals that of 0 to n - 1, block by block
    block = told.groupBy("source", F.floor(F.col("source_game") / 1024).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_game").alias("different"), F.min("source_game").alias("low"), F.max("source_game").alias("high"), F.min("byte_offset").alias("begin"), F.max("byte_offset").alias("end"))
    after = Window.partitionBy("source").orderBy("block")
    gapless = (F.col("n") == F.col("different")) & (F.col("high") - F.col("low") + 1 == F.col("n")) & (F.col("low") == F.coalesce(F.lag("high").over(after), F.lit(-1)) + 1) & (F.col("begin") > F.coalesce(F.lag("end").over(after), F.lit(-1)))
    numbered = block.select(gapless.alias("good")).agg(F.min("good").alias("numbered"))
    return told.groupBy(F.col("origin").alias("source")).agg(F.count(F.lit(1)).alias("games"), F.sum("plies").alias("plies"), F.count_if("commented").alias("commented")).crossJoin(F.broadcast(numbered))


@query("pawn_games_arriving", _SQL + "SELECT CAST(id % 3 AS BIGINT) AS arrival, count(*) AS games, CAST(sum(plies) AS BIGINT) AS plies FROM meta GROUP BY 1", plain=True)
def pawn_games_arriving(s, d):
    """Three folders of games that arrive one after the other, read by a stream that is stopped and started between them: each game once."""
    remote.register(s)
    folder, table, checkpoint = _shared(s, "arrivals"), _shared(s, "table"), _shared(s, "checkpoint")
    for k in range(3):
        pawn_games(s, d).where(F.col("id") % 3 == k).select("pgn").write.format("pgn").mode("append").save(f"{folder}/{k}")
        folders.collect_games(s, folder, table, checkpoint).awaitTermination()
    rows = pgn.parse_games(folders.collected(s, table), fields=("plies", "error")).where("frame_error IS NULL AND error IS NULL")
    return rows.groupBy(F.col("batch").alias("arrival")).agg(F.count(F.lit(1)).alias("games"), F.sum("plies").alias("plies"))


@query("pawn_positions", _SQL + "SELECT CAST(ply AS INTEGER) AS ply, count(*) AS visits, count(DISTINCT name) AS positions FROM v GROUP BY ply", plain=True)
def pawn_positions(s, d):
    """Visits and different positions of every ply: two orders of the same moves are one position."""
    steps = pgn.with_position_keys(_lines(s, d)).select(F.posexplode("keys").alias("ply", "position_key"))
    each = steps.groupBy("ply", "position_key").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("ply").agg(F.sum("n").alias("visits"), F.count(F.lit(1)).alias("positions"))


#: After d3, e3, d6 and e6 in some order of each side's.
_TARGET, _TARGET_NAME = "rnbqkbnr/ppp2ppp/3pp3/8/8/3PP3/PPP2PPP/RNBQKBNR w KQkq - 0 3", "0001100000011000w"
_FIRST = _SQL + f", hit AS (SELECT id, CAST(min(ply) AS INTEGER) AS first_ply FROM v WHERE name = '{_TARGET_NAME}' GROUP BY id)"


@query("pawn_position_scan", _FIRST + " SELECT id AS game_id, first_ply FROM hit", plain=True)
def pawn_position_scan(s, d):
    """The games that have a position, found by replaying all of them."""
    return GameQuery(position=_TARGET).run(_lines(s, d)).select("game_id", "first_ply")


def _numbered(s, d: str) -> DataFrame:
    """The lines with their keys and their numbers in their sources, worked out once."""
    keyed = pgn.with_position_keys(_lines(s, d, numbered=True))
    return _staged(s, keyed.select("game_id", "source", "source_game", "pgn", "white", "result", F.size("moves").cast("long").alias("mainline_plies"), "keys"), "lines")


def _database(s, d: str) -> store.Database:
    lines = _numbered(s, d)
    stored = lines.select("game_id", "source", "source_game", "pgn", "white", C.ascii_fold(F.col("white")).alias("white_key"), F.lit(None).cast("string").alias("black_key"), "result", "mainline_plies", "keys")
    db = store.Database(s, _shared(s, "pawn-db"))
    db.build(stored)
    return db


@query("db_position_lookup", _FIRST + " SELECT id AS game_id, meta.white, CAST(meta.result AS INTEGER) AS result, first_ply FROM hit JOIN meta USING (id)", plain=True)
def db_position_lookup(s, d):
    """The same games by a look-up in a database: only files whose bounds hold the key are read."""
    return _database(s, d).query(GameQuery(position=_TARGET)).select("game_id", "white", "result", "first_ply")


@query("db_position_start", _SQL + "SELECT count(*) AS games, CAST(sum(result) AS BIGINT) AS results FROM meta", plain=True)
def db_position_start(s, d):
    """The start position, which every game has: its key lies in as many files as it needs."""
    return _database(s, d).query(GameQuery(position=START_FEN)).agg(F.count(F.lit(1)).alias("games"), F.sum("result").alias("results"))


@query("db_position_absent", _SQL + "SELECT count(*) AS games FROM v WHERE name = 'none' AND id IN (SELECT id FROM meta WHERE white = 'w38')", plain=True)
def db_position_absent(s, d):
    """A position that no game has, for a player that exists."""
    return _database(s, d).query(GameQuery(position="4k3/8/8/8/8/8/8/4K3 w - - 0 1", player="W38")).agg(F.count(F.lit(1)).alias("games"))


@query("pawn_openings", _SQL + """SELECT games, wins, draws, losses, unfinished, count(*) AS positions FROM (
      SELECT name, count(*) AS games, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 3) AS draws, count(*) FILTER (result = 2) AS losses, count(*) FILTER (result = 0) AS unfinished
      FROM v JOIN meta USING (id) WHERE ply = 4 GROUP BY name) GROUP BY ALL""", plain=True)
def pawn_openings(s, d):
    """How often results are shared by the positions after four plies, each told once."""
    lines = pgn.with_position_keys(_lines(s, d).withColumn("moves", F.slice("moves", 1, 4)))
    visited = lines.select("game_id", F.get("keys", F.lit(4)).alias("position_key"), F.col("result").alias("outcome"))
    totals = explore.common_positions(visited, top=None)
    return totals.groupBy("games", "wins", "draws", "losses", "unfinished").agg(F.count(F.lit(1)).alias("positions"))


@query("db_openings", _SQL + """SELECT games, wins, draws, losses, unfinished, count(*) AS positions FROM (
      SELECT name, count(*) AS games, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 3) AS draws, count(*) FILTER (result = 2) AS losses, count(*) FILTER (result = 0) AS unfinished
      FROM v JOIN meta USING (id) JOIN orders ON o_orderkey = id WHERE ply = 4 AND o_orderpriority <> '3-MEDIUM' GROUP BY name) GROUP BY ALL""", plain=True)
def db_openings(s, d):
    """The opening tree after a database was built of some sources, one was added, one came back to what it was, and one lost its games."""
    lines = _numbered(s, d)
    db = store.Database(s, _shared(s, "tree-db"))
    changed = lines.withColumns({"result": F.when(F.col("source") == "1-URGENT", F.lit(0)).otherwise(F.col("result")), "pgn": F.when(F.col("source") == "1-URGENT", F.concat(F.col("pgn").cast("string"), F.lit(" ")).cast("binary")).otherwise(F.col("pgn"))})
    db.build(changed.where("source <> '2-HIGH'"))
    db.update(lines.where("source IN ('1-URGENT', '2-HIGH')"))
    one = F.lit("3-MEDIUM")
    gone = s.range(1).select(F.lit(-1).cast("long").alias("game_id"), one.alias("source"), F.lit(1).alias("source_game"), F.lit(bytearray(b"*")).alias("pgn"), F.lit("w").alias("white"), F.lit(0).alias("result"), F.lit(0).cast("long").alias("mainline_plies"))
    db.update(gone, s.range(1).select(F.lit(-1).cast("long").alias("game_id"), one.alias("source"), F.lit(0).alias("ply"), F.lit(START_KEY).alias("position_key")))
    return db.openings().groupBy("games", "wins", "draws", "losses", "unfinished").agg(F.count(F.lit(1)).alias("positions"))


_KIND = "CASE WHEN id % 7 = 3 THEN 'inconsistent_result' WHEN id % 7 = 5 THEN 'incorrect_move_number' WHEN id % 11 = 4 THEN 'illegal_move' WHEN id % 13 = 6 THEN 'syntax' END"


@query(
    "pawn_faults",
    _SQL + f"""SELECT category, count(*) AS games, CAST(sum(moves) AS BIGINT) AS moves, CAST(sum(ply) AS BIGINT) AS plies FROM (
      SELECT k.category, CASE k.category WHEN 'incorrect_move_number' THEN 4 WHEN 'illegal_move' THEN 0 WHEN 'inconsistent_result' THEN 0 ELSE plies + CASE WHEN aside.move IS NULL THEN 0 ELSE 1 END END AS moves,
        CASE k.category WHEN 'incorrect_move_number' THEN 5 WHEN 'illegal_move' THEN 1 END AS ply
      FROM (SELECT id, {_KIND} AS category FROM ids) k JOIN meta USING (id) JOIN aside USING (id)) GROUP BY category""",
    plain=True,
)
def pawn_faults(s, d):
    """Diagnoses of games of which some have a wrong Result tag, a wrong number, an impossible move or no outcome."""
    text = F.col("pgn").cast("string")
    category = F.expr(_KIND)
    spoilt = (
        F.when(category == "inconsistent_result", F.regexp_replace(text, r'\[Result "[^"]*"\]', '[Result "0-0"]'))
        .when(category == "incorrect_move_number", F.regexp_replace(text, r"\b3\. ", "7. "))
        .when(category == "illegal_move", F.regexp_replace(text, r"\n\n1\. [a-h]3", "\n\n1. Qh5"))
        .when(category == "syntax", F.regexp_replace(text, r"(1-0|0-1|1/2-1/2|\*)\s*\z", ""))
        .otherwise(text)
    )
    frames = pawn_games(s, d).select("source", F.col("id").alias("source_game"), F.lit(0).cast("long").alias("byte_offset"), spoilt.cast("binary").alias("raw"), F.lit(None).cast("string").alias("error"))
    found = doctor.diagnose(frames)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("games"), F.sum("moves").alias("moves"), F.sum("ply").alias("plies"))


@query("random_games_sound", "SELECT count(*) AS games, count(*) AS sound, count(*) AS counts_told, count(*) AS keys_told, count(*) AS different, true AS rare_moves FROM (SELECT o_orderkey FROM orders)", plain=True)
def random_games_sound(s, d):
    """Random games of up to 40 plies: every one is legal, its parts are counted as they were made, it visits a position more than it has plies, and no two are the same."""
    made = _staged(s, synthetic.random_games(orders(s, d).select("o_orderkey"), 40), "random")
    rows = pgn.parse_games(made.select("pgn", F.col("plies").alias("made"), "comments", "variations", "promotions"), "pgn", fields=("moves", "counts", "error"))
    none = F.lit(None).cast("string")
    n = lambda kind: F.coalesce(F.try_element_at("counts", F.lit(kind)), F.lit(0).cast("long"))
    told = F.col("error").isNull() & (F.size("moves") == F.col("made")) & (n("comment_brace") == F.col("comments")) & (n("variation_start") == F.col("variations"))
    takes = F.contains(F.array_join("moves", " "), F.lit("x"))
    keyed = pgn.with_position_keys(rows.select(told.alias("told"), takes.alias("takes"), "made", "promotions", "moves", none.alias("fen"), none.alias("variant")))
    frames = made.select(F.lit("made").alias("source"), F.col("game_id").alias("source_game"), F.lit(0).cast("long").alias("byte_offset"), F.col("pgn").alias("raw"), none.alias("error"))
    sound = doctor.diagnose(frames).where("category IS NULL").agg(F.count(F.lit(1)).alias("sound"))
    different = made.select(F.unhex(F.sha2("pgn", 256)).alias("h")).distinct().agg(F.count(F.lit(1)).alias("different"))
    out = keyed.agg(F.count(F.lit(1)).alias("games"), F.count_if("told").alias("counts_told"), F.count_if(F.size("keys") == F.col("made") + 1).alias("keys_told"), ((F.sum("promotions") >= 0) & (F.count_if("takes") > 0)).alias("rare_moves"))
    return out.crossJoin(different).crossJoin(sound).select("games", "counts_told", "keys_told", "different", "rare_moves", "sound")  # one row each


_BEST = "greatest(coalesce(white_elo, -1), coalesce(black_elo, -1))"


@query(
    "library_page_deep",
    oracle(f"""SELECT game_id, place FROM (SELECT game_id, row_number() OVER (ORDER BY ({_BEST} < 0), {_BEST} DESC, played_on DESC NULLS LAST, game_id DESC) AS place, count(*) OVER () AS n FROM g)
      WHERE place > n // 2 AND place <= n // 2 + 200"""),
    plain=True,
)
def library_page_deep(s, d):
    """The page in the middle of all games by rating, from the ranges that it lies in."""
    rows = games(s, d).select("game_id", "played_on", "white_elo", "black_elo")
    stored = library.SortedLibrary(s, _shared(s, "library"), "rating")
    stored.build(rows, 1000)
    middle = rows.count() // 2
    return library.ranked(stored.page(200, middle), "rating").select("game_id", (F.col("place") + middle).alias("place"))
