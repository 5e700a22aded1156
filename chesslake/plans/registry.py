"""Registered queries over the games that `adapters` derives, and their SQL for another engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import games, oracle, orders, raw_games, with_pgn
from ..functions import columns as C
from ..operators import doctor, evidence, explore, library, reports, review, stats, store
from ..operators.query import GameQuery, count_unless_failed, match_records, summary
from ..sources import pgn
from ..streaming import collection, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLAYER = "player38"
_OWN = f"(white_key = '{PLAYER}' OR (black_key = '{PLAYER}' AND (white_key IS NULL OR white_key <> '{PLAYER}')))"
_WHITE = f"white_key = '{PLAYER}'"
_BLACK = f"(black_key = '{PLAYER}' AND (white_key IS NULL OR white_key <> '{PLAYER}'))"


def query(name: str, sql: str | None = None, plain: bool = False):
    """Register a query; `sql` is over the games relation `g`, or whole if `plain`."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql if plain else oracle(sql)
        return fn

    return add


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """The games rendered as PGN and read back by the parser."""
    rows = with_pgn(raw_games(spark, d, numbered=True)).select("game_id", "source", "source_game", "pgn")
    return pgn.game_rows(pgn.parse_games(rows, "pgn"))


def replayed(spark: SparkSession, d: str) -> DataFrame:
    return pgn.replay(parsed(spark, d))


# Sources, framing, parsing


_CHUNK = 500


@query("scan_games", "SELECT source, count(*) AS games, CAST(max(source_game) AS BIGINT) AS last_game FROM g GROUP BY source")
def scan_games(s, d):
    """Sources as texts of bounded size in the order of their games, cut into games again and numbered through the source."""
    order = F.array_sort(F.collect_list(F.struct("source_game", "pgn")))
    chunk = F.floor((F.col("source_game") - 1) / _CHUNK)
    texts = with_pgn(raw_games(s, d, numbered=True)).groupBy("source", chunk.alias("chunk")).agg(F.array_join(F.transform(order, lambda x: x["pgn"].cast("string")), "").cast("binary").alias("content"))
    named = texts.select(F.concat_ws("#", "source", "chunk").alias("source"), "content")
    games = pgn.frames_of_texts(named).where("error IS NULL").select(F.substring_index("source", "#", 1).alias("source"), (F.substring_index("source", "#", -1).cast("long") * _CHUNK + F.col("source_game")).alias("source_game"))
    return games.groupBy("source").agg(F.count(F.lit(1)).alias("games"), (F.max("source_game") + 1).alias("last_game"))


@query("pgn_roundtrip_metadata", "SELECT game_id, white, black, date_text, white_elo, black_elo, time_control, result, mainline_plies, played_on FROM g")
def pgn_roundtrip_metadata(s, d):
    return parsed(s, d).select("game_id", "white", "black", "date_text", "white_elo", "black_elo", "time_control", "result", "mainline_plies", "played_on")


_TAGS = "1 + CAST(white IS NOT NULL AS INT) + CAST(black IS NOT NULL AS INT) + CAST(date_text IS NOT NULL AS INT) + CAST(white_elo_text IS NOT NULL AS INT) + CAST(black_elo_text IS NOT NULL AS INT) + CAST(time_control IS NOT NULL AS INT)"


@query(
    "pgn_event_counts",
    f"""SELECT kind, CAST(sum(n) AS BIGINT) AS events FROM (
      SELECT 'tag' AS kind, sum({_TAGS}) AS n FROM g UNION ALL SELECT 'game_end', count(*) FROM g UNION ALL SELECT 'game_start', count(*) FROM g
      UNION ALL SELECT 'movetext_start', count(*) FROM g UNION ALL SELECT 'outcome', count(*) FROM g UNION ALL SELECT 'san', sum(plies + CASE WHEN line_id = 10 THEN 2 ELSE 0 END) FROM g
      UNION ALL SELECT 'move_number', sum(CAST(ceil(plies / 2.0) AS INT) + CASE WHEN line_id = 10 THEN 1 ELSE 0 END) FROM g
      UNION ALL SELECT k, sum(CASE WHEN line_id = 10 THEN 1 ELSE 0 END) FROM g, (VALUES ('comment_brace'), ('variation_start'), ('variation_end')) AS t(k) GROUP BY k) GROUP BY kind""",
)
def pgn_event_counts(s, d):
    return parsed(s, d).select(F.explode("counts").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("events"))


@query("pgn_lenient", "SELECT game_id, plies AS plies_read FROM g")
def pgn_lenient(s, d):
    """Games whose outcome is missing are still read when the parser is lenient."""
    cut = with_pgn(raw_games(s, d)).withColumn("pgn", F.regexp_replace(F.col("pgn").cast("string"), r"(1-0|0-1|1/2-1/2|\*)\s*\z", "").cast("binary")).select("game_id", "pgn")
    return pgn.parse_games(cut, "pgn", strict=False).select("game_id", F.size("moves").alias("plies_read"))


@query("hostile_input", """SELECT count(*) AS texts, count(*) FILTER (kind = 'error') AS with_error, count(*) FILTER (kind <> 'error') AS with_outcome,
  CAST(coalesce(sum(CASE WHEN kind <> 'error' THEN moves END), 0) AS BIGINT) AS moves FROM (
    SELECT CASE WHEN regexp_full_match(text, '[ \\t\\n\\f\\r]*') THEN 'empty' WHEN regexp_full_match(text, '[a-zA-Z0-9.,''à-ÿÀ-Ý= "_-]*', 's') THEN 'words' ELSE 'other' END AS shape,
      len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')) AS moves, 'error' AS kind FROM documents WHERE text IS NOT NULL)""", plain=True)
def hostile_input(s, d):
    """Text that is no PGN gives an error or games, never an exception, and never both nor neither."""
    texts = s.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select(F.col("text").cast("binary").alias("raw"))
    got = pgn.parse_games(texts, fields=("plies", "outcome", "error"))
    bad, good = F.col("error").isNotNull(), F.col("error").isNull() & F.col("outcome").isNotNull()
    return got.agg(F.count(F.lit(1)).alias("texts"), F.count_if(bad).alias("with_error"), F.count_if(good).alias("with_outcome"), F.coalesce(F.sum(F.when(good, F.col("plies"))), F.lit(0)).alias("moves"))


# Scalar functions

_TC = """CASE WHEN time_control IS NULL THEN 'missing' ELSE CASE time_control WHEN '300' THEN 'sudden_death' WHEN '180+2' THEN 'increment' WHEN '40/7200' THEN 'moves_in_seconds'
  WHEN '40/7200:3600+30' THEN 'multi_stage' WHEN '*60' THEN 'hourglass' WHEN '?' THEN 'unknown' WHEN '-' THEN 'unlimited' ELSE 'invalid' END END"""
_BAND = "CASE WHEN black_elo IS NULL THEN NULL WHEN black_elo < 1000 THEN '<1000' WHEN black_elo >= 2400 THEN '2400+' ELSE concat(CAST(black_elo // 200 * 200 AS VARCHAR), '-', CAST(black_elo // 200 * 200 + 199 AS VARCHAR)) END"
_LENGTH = "CASE WHEN mainline_plies = 0 THEN '0' WHEN mainline_plies <= 20 THEN '1-20' WHEN mainline_plies <= 40 THEN '21-40' ELSE 'more' END"


@query(
    "fn_scalars",
    f"""SELECT game_id, white_key, black_key, played_on, white_elo, black_elo, {_TC} AS tc_kind, {_LENGTH} AS length_bucket, {_BAND} AS band,
      CAST(played_on // 100 AS INTEGER) AS month, CASE result WHEN 0 THEN 'unfinished' WHEN 1 THEN 'white_win' WHEN 2 THEN 'black_win' ELSE 'draw' END AS label,
      CASE WHEN played_on IS NOT NULL THEN date_text END AS formatted FROM g""",
)
def fn_scalars(s, d):
    return games(s, d).select(
        "game_id", "white_key", "black_key", "played_on", "white_elo", "black_elo", C.time_control(F.col("time_control")).alias("tc_kind"), C.length_bucket(F.col("mainline_plies")).alias("length_bucket"),
        C.rating_band(F.col("black_elo")).alias("band"), C.month_of(F.col("played_on")).alias("month"), C.result_label(F.col("result")).alias("label"), C.format_date(F.col("played_on")).alias("formatted"),
    )


@query("fn_parse_u32", "SELECT game_id, CASE WHEN game_id % 3 = 0 THEN NULL WHEN game_id % 3 = 1 THEN game_id ELSE 4294967295 END AS value FROM g")
def fn_parse_u32(s, d):
    text = F.when(F.col("game_id") % 3 == 0, F.concat(F.lit("+"), F.col("game_id").cast("string"))).when(F.col("game_id") % 3 == 1, F.concat(F.lit("000"), F.col("game_id").cast("string"))).otherwise("4294967295")
    return raw_games(s, d).select("game_id", C.parse_u32(text).alias("value"))


@query("fn_remote_ids", "SELECT game_id, lpad(CAST(game_id AS VARCHAR), 8, 'a') AS remote_id, concat(lower(hex(lpad(CAST(game_id AS VARCHAR), 8, 'a'))), '.pgn') AS file FROM g")
def fn_remote_ids(s, d):
    site = F.concat(F.lit("https://lichess.org/"), F.lpad(F.col("game_id").cast("string"), 8, "a"), F.lit("/black"))
    return raw_games(s, d).select("game_id", C.remote_game_id(site).alias("remote_id"), C.id_filename(C.remote_game_id(site)).alias("file"))


@query("fn_player_result", f"SELECT game_id, CASE WHEN {_WHITE} THEN CASE result WHEN 0 THEN 'unfinished' WHEN 3 THEN 'draw' WHEN 1 THEN 'win' ELSE 'loss' END WHEN {_BLACK} THEN CASE result WHEN 0 THEN 'unfinished' WHEN 3 THEN 'draw' WHEN 2 THEN 'win' ELSE 'loss' END ELSE 'unclassified' END AS player_result FROM g")
def fn_player_result(s, d):
    return games(s, d).select("game_id", C.player_result(F.col("result"), F.col("white_key"), F.col("black_key"), PLAYER).alias("player_result"))


@query("fn_date_to_ms", "SELECT game_id, greatest(epoch_ms(CAST(replace(date_text, '.', '-') AS TIMESTAMP)), 1356998400070) AS first_ms, greatest(epoch_ms(CAST(replace(date_text, '.', '-') AS TIMESTAMP)) + 86399999, 1356998400070) AS last_ms FROM g WHERE played_on IS NOT NULL")
def fn_date_to_ms(s, d):
    return games(s, d).where("played_on IS NOT NULL").select("game_id", C.date_to_ms(F.col("played_on")).alias("first_ms"), C.date_to_ms(F.col("played_on"), True).alias("last_ms"))


# Queries


def _count(name: str, q: GameQuery, where: str):
    @query(name, f"SELECT count(*) AS matches, CAST(coalesce(sum(game_id), 0) AS BIGINT) AS ids FROM g WHERE {where}")
    def run(s, d):
        return q.run(games(s, d)).agg(F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum("game_id"), F.lit(0)).alias("ids"))


_count("query_player", GameQuery(player="PLAYER38"), _OWN)
_count("query_color", GameQuery(player=PLAYER, color="black"), _BLACK)
_count("query_opponent", GameQuery(player=PLAYER, opponent="Player83"), f"({_WHITE} AND black_key = 'player83') OR ({_BLACK} AND white_key = 'player83')")
_count("query_result_win", GameQuery(player=PLAYER, result="win"), f"({_WHITE} AND result = 1) OR ({_BLACK} AND result = 2)")
_count("query_result_loss", GameQuery(player=PLAYER, result="loss"), f"({_WHITE} AND result = 2) OR ({_BLACK} AND result = 1)")
_count("query_result_draw", GameQuery(result="draw"), "result = 3")
_count("query_result_unfinished", GameQuery(player=PLAYER, result="unfinished"), f"{_OWN} AND result = 0")
_count("query_since_until", GameQuery(since=19960101, until=19981231), "played_on BETWEEN 19960101 AND 19981231")
_count("query_rating_range", GameQuery(player=PLAYER, min_rating=1200, max_rating=2000), f"({_WHITE} AND white_elo BETWEEN 1200 AND 2000) OR ({_BLACK} AND black_elo BETWEEN 1200 AND 2000)")
_count("query_combined", GameQuery(player=PLAYER, color="white", result="win", since=19960101, min_rating=1000), f"{_WHITE} AND result = 1 AND played_on >= 19960101 AND white_elo >= 1000")


@query("query_jsonl", f"SELECT 1 AS schema_version, source, source_game, white, black, CASE WHEN played_on IS NOT NULL THEN date_text END AS date, white_elo, black_elo, CASE result WHEN 0 THEN 'unfinished' WHEN 1 THEN 'white_win' WHEN 2 THEN 'black_win' ELSE 'draw' END AS result, mainline_plies FROM g WHERE {_OWN}")
def query_jsonl(s, d):
    return match_records(GameQuery(player=PLAYER).run(games(s, d)))


@query("query_pgn", f"SELECT game_id, CAST(length(movetext) AS INTEGER) AS movetext_chars FROM g WHERE {_OWN}")
def query_pgn(s, d):
    """The matching games' texts, as the PGN output has them."""
    found = GameQuery(player=PLAYER).run(with_pgn(games(s, d)))
    body = F.regexp_extract(F.col("pgn").cast("string"), r"\n\n(?s:(.*)) (?:1-0|0-1|1/2-1/2|\*)\n\n\z", 1)
    return found.select("game_id", F.length(body).alias("movetext_chars"))


# Positions. A position is named by the shortest line that reaches it: transpositions share one name.

_MOVES = ", ".join(
    f"({line}, {ply}, '{san}')"
    for line, sans in (
        (0, "e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6"), (1, "d4 d5 c4 e6 Nc3 Nf6 Bg5 Be7"), (2, "e4 c5 Nf3 d6 d4 cxd4 Nxd4 Nf6 Nc3 a6"), (3, "e4 e6 d4 d5 Nc3 Bb4"), (4, "f3 e5 g4 Qh4#"), (5, "Nf3 Nf6 Ng1 Ng8"),
        (6, "e4 e5 Nf3 Nc6 Bc4 Bc5 O-O Nf6"), (7, "d4 Nf6 c4 g6 Nc3 Bg7 e4 d6 Nf3 O-O"), (8, "e4 d5 e5 f5 exf6"), (10, "e4 e5"), (11, "Nf3 Nc6 e4 e5"),
    )
    for ply, san in enumerate(sans.split(), 1)
)
_VISITS = f"""book_moves(line_id, ply, san) AS (VALUES {_MOVES}),
  book_visits AS (SELECT line_id, 0 AS ply, '' AS line FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) AS t(line_id)
    UNION ALL SELECT line_id, ply, string_agg(san, ' ') OVER (PARTITION BY line_id ORDER BY ply) FROM book_moves),
  named AS (SELECT line_id, ply, CASE WHEN line = 'e4 e5 Nf3 Nc6' THEN 'Nf3 Nc6 e4 e5' WHEN line_id = 5 AND ply = 4 THEN '' ELSE line END AS name FROM book_visits),
  v AS (SELECT g.*, n.ply, n.name FROM g JOIN named n USING (line_id))"""


def _positions_sql(select: str) -> str:
    return oracle(select).replace(") SELECT /*visits*/", f"), {_VISITS} SELECT")


def _staged(s, rows: DataFrame, name: str) -> DataFrame:
    """Rows that are read more than once, written to a folder of their own and read from there."""
    path = _shared(s, name)
    rows.write.option("compression", "zstd").parquet(path)
    return s.read.parquet(path)


def _played(s, d) -> DataFrame:
    """What Explore needs of the games, parsed from their texts."""
    games_ = pgn.parse_games(with_pgn(raw_games(s, d)).select("game_id", "pgn"), "pgn", fields=("tags", "moves", "outcome"))
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    date = C.effective_date(tag("Date"), tag("UTCDate"))
    return games_.select(
        "game_id", C.ascii_fold(tag("White")).alias("white_key"), C.ascii_fold(tag("Black")).alias("black_key"), C.parse_date(date).alias("played_on"), F.coalesce("outcome", F.lit(0)).alias("result"),
        tag("FEN").alias("fen"), tag("Variant").alias("variant"), "moves",
    )


def _names(lines: DataFrame) -> DataFrame:
    """Of every position its name: the least line (moves, keys), shortest first, that reaches it."""
    steps = lines.select("moves", F.posexplode("keys").alias("ply", "position_key"))
    line = F.array_join(F.slice("moves", 1, F.col("ply")), " ")
    return steps.groupBy("position_key").agg(F.min(F.struct("ply", line.alias("line"))).alias("n")).select("position_key", F.col("n.line").alias("name"))


def _visits_and_names(s, d) -> tuple[DataFrame, DataFrame]:
    """Game columns, ply and position_key of every visit; and the names of positions.

    Games are parsed once; names come from each different line once. Who counts visits joins names to the counts, not to the visits.
    """
    games_ = _staged(s, pgn.with_position_keys(_played(s, d)), "visits")
    rows = games_.select("game_id", "white_key", "black_key", "played_on", "result", F.posexplode("keys").alias("ply", "position_key"))
    return rows, _names(pgn.with_position_keys(games_.select("fen", "variant", "moves").distinct()))


def _visits(s, d) -> DataFrame:
    """Visits with their positions' names."""
    rows, names = _visits_and_names(s, d)
    return rows.join(names, "position_key")


@query("positions", _positions_sql("SELECT /*visits*/ name, CAST(count(*) AS BIGINT) AS visits, count(DISTINCT game_id) AS games, min(ply) AS first_ply FROM v GROUP BY name"), plain=True)
def positions(s, d):
    rows, names = _visits_and_names(s, d)
    each = rows.groupBy("position_key", "game_id").agg(F.count(F.lit(1)).alias("n"), F.min("ply").alias("ply"))
    totals = each.groupBy("position_key").agg(F.sum("n").alias("visits"), F.count(F.lit(1)).alias("games"), F.min("ply").alias("first_ply"))
    return totals.join(names, "position_key").select("name", "visits", "games", "first_ply")


_ITALIAN = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 4 3"


@query("query_position", oracle("SELECT game_id, 4 AS first_ply FROM g WHERE line_id IN (0, 6, 11)"), plain=True)
def query_position(s, d):
    rows = pgn.parse_games(with_pgn(raw_games(s, d)).select("game_id", "pgn"), "pgn", fields=("tags", "moves"))
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    found = GameQuery(position=_ITALIAN).run(rows.select("game_id", tag("FEN").alias("fen"), tag("Variant").alias("variant"), "moves"))
    return found.select("game_id", "first_ply")


@query("query_position_player", oracle(f"SELECT game_id, 4 AS first_ply FROM g WHERE line_id IN (0, 6, 11) AND {_OWN}"), plain=True)
def query_position_player(s, d):
    games_ = replayed(s, d)
    return GameQuery(position=_ITALIAN, player=PLAYER).run(games_, pgn.position_rows(games_)).select("game_id", "first_ply")


@query("query_position_variant_skip", oracle("SELECT game_id, CAST(CASE WHEN game_id % 2 = 0 THEN NULL ELSE plies + 1 END AS INTEGER) AS visited FROM g"), plain=True)
def query_position_variant_skip(s, d):
    rows = parsed(s, d).withColumn("variant", F.when(F.col("game_id") % 2 == 0, "Chess960").otherwise("STANDARD"))
    return pgn.replay(rows).select("game_id", F.when(F.col("steps").isNotNull(), F.size("steps")).alias("visited"))


def _explore(s, d, low, high, player=None) -> tuple[DataFrame, DataFrame]:
    rows, names = _visits_and_names(s, d)
    return explore.visits(explore.scoped(rows, player).select("position_key", "game_id", "ply"), games(s, d), low, high, player), names


def _results(s, d, low, high, player=None) -> tuple[DataFrame, DataFrame]:
    """Results of the positions within a range of plies, and names: games are counted by line, and each different line is replayed once."""
    lines = _staged(s, pgn.with_position_keys(explore.line_results(_played(s, d), player)), "lines")
    return explore.position_results(lines, low, high), _names(lines)


_TALLY = "CAST(sum(CASE WHEN o = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN o = 3 THEN 1 ELSE 0 END) AS BIGINT) AS draws, CAST(sum(CASE WHEN o = 2 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN o = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unfinished"
_OUTCOME = f"CASE WHEN {_WHITE} THEN result ELSE CASE result WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE result END END"


@query("explore_openings", _positions_sql(f"SELECT /*visits*/ name, count(*) AS games, {_TALLY} FROM (SELECT DISTINCT name, game_id, result AS o FROM v WHERE ply = 4) GROUP BY name"), plain=True)
def explore_openings(s, d):
    """Every opening with its results, without a limit; `explore_top_openings` ranks them."""
    totals, names = _results(s, d, 4, 4)
    return explore.chosen_positions(totals, top=None).join(names, "position_key").drop("position_key")


@query("explore_top_openings", _positions_sql(f"SELECT /*visits*/ games, {_TALLY.replace('sum(', 'max(').replace('CASE WHEN o = 1 THEN 1 ELSE 0 END', 'wins').replace('CASE WHEN o = 3 THEN 1 ELSE 0 END', 'draws').replace('CASE WHEN o = 2 THEN 1 ELSE 0 END', 'losses').replace('CASE WHEN o = 0 THEN 1 ELSE 0 END', 'unfinished')} FROM (SELECT name, count(*) AS games, {_TALLY} FROM (SELECT DISTINCT name, game_id, result AS o FROM v WHERE ply = 4) GROUP BY name ORDER BY games DESC LIMIT 6) GROUP BY name, games"), plain=True)
def explore_top_openings(s, d):
    """The six openings that most games reach; equal counts go by key, which the other engine has not, so names are left out."""
    totals, _ = _results(s, d, 4, 4)
    return explore.chosen_positions(totals).drop("position_key")


@query("explore_openings_scoped", _positions_sql(f"SELECT /*visits*/ name, count(*) AS games, {_TALLY} FROM (SELECT DISTINCT name, game_id, {_OUTCOME} AS o FROM v WHERE ply = 4 AND {_OWN}) GROUP BY name"), plain=True)
def explore_openings_scoped(s, d):
    totals, names = _results(s, d, 4, 4, PLAYER)
    return explore.chosen_positions(totals, top=None).join(names, "position_key").drop("position_key")


@query("explore_recurring", _positions_sql(f"SELECT /*visits*/ name, count(*) AS games, {_TALLY} FROM (SELECT DISTINCT name, game_id, result AS o FROM v WHERE ply BETWEEN 8 AND 40) GROUP BY name HAVING count(*) > 1"), plain=True)
def explore_recurring(s, d):
    totals, names = _results(s, d, 8, 40)
    return explore.chosen_positions(totals, repeated_only=True, top=None).join(names, "position_key").drop("position_key")


@query(
    "explore_review_games",
    _positions_sql(f"""SELECT /*visits*/ name, CAST(place AS INTEGER) AS place, game_id FROM (SELECT name, game_id, row_number() OVER (PARTITION BY name ORDER BY (played_on IS NULL), played_on DESC, game_id DESC) AS place
      FROM (SELECT DISTINCT name, game_id, played_on FROM v WHERE ply = 4 AND {_OWN} AND ({_OUTCOME}) = 2)) WHERE place <= 6"""),
    plain=True,
)
def explore_review_games(s, d):
    visited, names = _explore(s, d, 4, 4, PLAYER)
    return explore.review_games(visited).join(names, "position_key").drop("position_key")


@query(
    "explore_sample_game",
    _positions_sql(f"""SELECT /*visits*/ name, game_id, ply FROM (SELECT name, game_id, ply, row_number() OVER (PARTITION BY name ORDER BY (CASE WHEN o = 2 THEN 0 ELSE 1 END), (played_on IS NULL), played_on DESC, ply, game_id) AS k
      FROM (SELECT name, game_id, played_on, {_OUTCOME} AS o, min(ply) AS ply FROM v WHERE ply = 4 AND {_OWN} GROUP BY ALL)) WHERE k = 1"""),
    plain=True,
)
def explore_sample_game(s, d):
    visited, names = _explore(s, d, 4, 4, PLAYER)
    return explore.samples(visited, PLAYER).join(names, "position_key").drop("position_key")


@query("explore_lines", _positions_sql("SELECT /*visits*/ game_id, regexp_replace(regexp_replace(movetext, ' 3[.].*', ''), '[{(].*[)] ', '') AS line FROM (SELECT DISTINCT game_id, movetext FROM v WHERE ply = 4)"), plain=True)
def explore_lines(s, d):
    games_ = replayed(s, d)
    at = pgn.position_rows(games_).where("ply = 4").select("game_id", "ply")
    return explore.with_lines(at, pgn.move_rows(games_)).select("game_id", "line")


@query("explore_count", f"SELECT count(*) AS games FROM g WHERE {_OWN}")
def explore_count(s, d):
    return explore.count(games(s, d), PLAYER)


@query("explore_players_all", f"SELECT name_key, min(name) AS name, count(*) AS games, {_TALLY} FROM (SELECT white AS name, white_key AS name_key, result AS o FROM g UNION ALL SELECT black, black_key, CASE result WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE result END FROM g) WHERE name_key IS NOT NULL GROUP BY name_key ORDER BY games DESC, name_key LIMIT 8")
def explore_players_all(s, d):
    return explore.players(games(s, d))


@query("explore_players_scoped", f"SELECT name_key, min(name) AS name, count(*) AS games, {_TALLY} FROM (SELECT black AS name, black_key AS name_key, result AS o FROM g WHERE {_WHITE} UNION ALL SELECT white, white_key, CASE result WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE result END FROM g WHERE {_BLACK}) WHERE name_key IS NOT NULL GROUP BY name_key ORDER BY games DESC, name_key LIMIT 8")
def explore_players_scoped(s, d):
    return explore.players(games(s, d), PLAYER)


@query("explore_timeline_all", f"SELECT CAST(played_on // 100 AS INTEGER) AS month, count(*) AS games, {_TALLY.replace('o =', 'result =')} FROM g WHERE played_on IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def explore_timeline_all(s, d):
    return explore.timeline(games(s, d))


_W, _B = f"coalesce(white_key = '{PLAYER}', false)", f"coalesce(black_key = '{PLAYER}', false)"


@query("explore_timeline_scoped", f"SELECT CAST(played_on // 100 AS INTEGER) AS month, count(*) AS games, count(*) FILTER (({_W} AND result = 1) OR ({_B} AND result = 2)) AS wins, count(*) FILTER (result = 3) AS draws, count(*) FILTER (({_W} AND result = 2) OR ({_B} AND result = 1)) AS losses, count(*) FILTER (result = 0) AS unfinished FROM g WHERE played_on IS NOT NULL AND {_OWN} GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def explore_timeline_scoped(s, d):
    return explore.timeline(games(s, d), PLAYER)


# Statistics

_CORE = "count(*) AS games, CAST(sum(mainline_plies) AS BIGINT) AS plies, count(*) FILTER (result = 1) AS white_wins, count(*) FILTER (result = 2) AS black_wins, count(*) FILTER (result = 3) AS draws, count(*) FILTER (result = 0) AS unfinished, min(mainline_plies) AS min_plies, round(avg(mainline_plies), 9) AS avg_plies, max(mainline_plies) AS max_plies"


@query("stats_core", f"SELECT {_CORE} FROM g")
def stats_core(s, d):
    rows = pgn.parse_games(with_pgn(raw_games(s, d)).select("pgn"), "pgn", fields=("plies", "outcome"))
    return stats.core(rows.select(F.col("plies").cast("long").alias("mainline_plies"), F.coalesce("outcome", F.lit(0)).alias("result"))).withColumn("avg_plies", F.round("avg_plies", 9))


@query("stats_merged", f"SELECT {_CORE} FROM g")
def stats_merged(s, d):
    """The reports of the sources put together are the report of the whole."""
    return stats.merged(stats.core(games(s, d), "source")).withColumn("avg_plies", F.round("avg_plies", 9))


@query("db_bytes", "SELECT source, count(*) AS games, CAST(sum(strlen(movetext)) AS BIGINT) AS bytes FROM g GROUP BY source")
def db_bytes(s, d):
    """Bytes per source, of the movetexts."""
    return raw_games(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("games"), F.sum(F.octet_length("movetext").cast("long")).alias("bytes"))


@query("stats_by_source", f"SELECT source, {_CORE} FROM g GROUP BY source")
def stats_by_source(s, d):
    return stats.core(games(s, d), "source").withColumn("avg_plies", F.round("avg_plies", 9))


@query("stats_lengths", "SELECT place, bucket, (SELECT count(*) FROM g WHERE mainline_plies BETWEEN low AND high) AS games FROM (VALUES (0, '0', 0, 0), (1, '1-20', 1, 20), (2, '21-40', 21, 40), (3, '41-60', 41, 60), (4, '61-80', 61, 80), (5, '81-120', 81, 120), (6, '121-160', 121, 160), (7, '161+', 161, 99999)) AS t(place, bucket, low, high)")
def stats_lengths(s, d):
    return stats.lengths(games(s, d))


@query("stats_headers", 'SELECT count(white) AS "White", count(black) AS "Black", count(date_text) AS "Date", count(white_elo_text) AS "WhiteElo", count(black_elo_text) AS "BlackElo", count(time_control) AS "TimeControl", count(*) AS "Event" FROM g')
def stats_headers(s, d):
    tag = lambda n: F.try_element_at("tags", F.lit(n))
    rows = parsed(s, d)
    names = ("White", "Black", "Date", "WhiteElo", "BlackElo", "TimeControl", "Event")
    return stats.headers(rows.select(*(tag(n).alias(f"h{i}") for i, n in enumerate(names))), {n: f"h{i}" for i, n in enumerate(names)})


@query("stats_dates", "SELECT count(played_on) AS complete, count(*) FILTER (date_text IS NOT NULL AND played_on IS NULL) AS incomplete_or_invalid, count(*) FILTER (date_text IS NULL) AS missing, min(played_on) AS earliest, max(played_on) AS latest FROM g")
def stats_dates(s, d):
    """Dates as the games' texts have them: the raw values of their tags."""
    rows = pgn.parse_games(with_pgn(raw_games(s, d)).select("pgn"), "pgn", fields=("raw_date_tag", "raw_utc_date"))
    return stats.dates(rows)


_BOTH = "(SELECT white_elo_text AS text, white_elo AS r FROM g UNION ALL SELECT black_elo_text, black_elo FROM g)"


@query("stats_ratings", f"SELECT count(r) AS numeric, count(*) FILTER (text IS NOT NULL AND r IS NULL) AS invalid, count(*) FILTER (text IS NULL) AS missing, min(r) AS lowest, round(avg(r), 9) AS average, max(r) AS highest FROM {_BOTH}")
def stats_ratings(s, d):
    return stats.ratings(games(s, d)).withColumn("average", F.round("average", 9))


@query("stats_rating_bands", f"SELECT place, band, (SELECT count(*) FROM {_BOTH} WHERE r BETWEEN low AND high) AS games FROM (VALUES (0, '<1000', 0, 999), (1, '1000-1199', 1000, 1199), (2, '1200-1399', 1200, 1399), (3, '1400-1599', 1400, 1599), (4, '1600-1799', 1600, 1799), (5, '1800-1999', 1800, 1999), (6, '2000-2199', 2000, 2199), (7, '2200-2399', 2200, 2399), (8, '2400+', 2400, 99999)) AS t(place, band, low, high)")
def stats_rating_bands(s, d):
    return stats.rating_bands(games(s, d))


@query("stats_time_controls", f"SELECT place, kind, (SELECT count(*) FROM g WHERE ({_TC}) = kind) AS games FROM (VALUES (0, 'missing'), (1, 'unknown'), (2, 'unlimited'), (3, 'moves_in_seconds'), (4, 'sudden_death'), (5, 'increment'), (6, 'hourglass'), (7, 'multi_stage'), (8, 'invalid')) AS t(place, kind)")
def stats_time_controls(s, d):
    return stats.time_controls(games(s, d))


def _faulty(s, d) -> DataFrame:
    """Games of which every thousandth has a move that breaks off the parser."""
    rows = with_pgn(raw_games(s, d, numbered=True)).select("game_id", "source", "source_game", "pgn")
    broken = F.when(F.col("game_id") % 1000 == 7, F.concat(F.lit(")"), F.col("pgn").cast("string")).cast("binary")).otherwise(F.col("pgn"))
    return pgn.game_rows(pgn.parse_games(rows.withColumn("pgn", broken), "pgn"))


_CUT = "(SELECT g.* FROM g LEFT JOIN (SELECT source, min(source_game) AS first_error FROM g WHERE game_id % 1000 = 7 GROUP BY source) e USING (source) WHERE first_error IS NULL OR source_game < first_error)"


@query("stats_partial_on_error", f"SELECT source, {_CORE} FROM {_CUT} GROUP BY source")
def stats_partial_on_error(s, d):
    return stats.core(stats.before_first_error(_faulty(s, d)), "source").withColumn("avg_plies", F.round("avg_plies", 9))


@query("stats_batch", "SELECT CAST(count(*) AS BIGINT) AS sources, count(*) FILTER (bad = 0) AS valid, count(*) FILTER (bad > 0) AS invalid, CAST(0 AS BIGINT) AS errors, CAST(max(CASE WHEN bad > 0 THEN 1 ELSE 0 END) AS INTEGER) AS exit_status FROM (SELECT source, count(*) FILTER (game_id % 1000 = 7) AS bad FROM g GROUP BY source)")
def stats_batch(s, d):
    status = _faulty(s, d).groupBy("source").agg(F.max(F.col("error").isNotNull().cast("int")).alias("status"))
    return stats.batch_status(status)


@query("ordered_first_error", "SELECT source, min(source_game) AS source_game, 'unmatched_variation_end' AS kind FROM g WHERE game_id % 1000 = 7 GROUP BY source")
def ordered_first_error(s, d):
    return stats.first_error(_faulty(s, d)).select("source", "source_game", F.col("error.kind").alias("kind"))


# Library


def _page(by: str, descending: bool, order: str):
    @query(f"library_sort_{by}_{'desc' if descending else 'asc'}", f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, game_id FROM (SELECT * FROM g ORDER BY {order} LIMIT 200 OFFSET 10)")
    def run(s, d):
        return library.ranked(library.page(games(s, d), by, descending, 500, 10), by, descending).select("place", "game_id")


_NEWEST = "played_on IS NULL, played_on DESC, game_id DESC"
_BEST = "greatest(coalesce(white_elo, -1), coalesce(black_elo, -1))"
_page("date", True, _NEWEST)
_page("date", False, "played_on IS NULL, played_on, game_id")
_page("rating", True, f"{_BEST} < 0, {_BEST} DESC, {_NEWEST}")
_page("result", False, f"result = 0, result, {_NEWEST}")
_page("player", False, f"white_key IS NULL, white_key, black_key IS NULL, black_key, {_NEWEST}")


# Doctor


def _faults(s, d) -> DataFrame:
    """Frames with planted faults: which one follows from the game's number."""
    rows = with_pgn(raw_games(s, d, numbered=True))
    text, k = F.col("pgn").cast("string"), F.col("game_id") % 12
    planted = (
        F.when(k == 1, F.concat(F.lit('[Result "2-0"]\n'), text)).when(k == 2, F.concat(F.lit('[SetUp "1"]\n'), text)).when(k == 3, F.concat(F.lit('[FEN "8/8"]\n'), text))
        .when(k == 4, F.regexp_replace(text, r"\n\n", "\n\n1. Ke5 ")).when(k == 5, F.regexp_replace(text, r"\n\n(?=1\. )", "\n\n{x} 2. a3 ")).when(k == 6, F.regexp_replace(text, r"\n\n", "\n\n) "))
        .when(k == 7, F.regexp_replace(text, r"\n\n", "\n\nzz9 ")).otherwise(text)
    )
    planted = F.regexp_replace(planted, r"\s+\z", "")
    return rows.select("source", (F.col("source_game") - 1).alias("source_game"), F.lit(0).cast("bigint").alias("byte_offset"), planted.cast("binary").alias("raw"), F.lit(None).cast("string").alias("error"))


_CATEGORY = """CASE game_id % 12 WHEN 1 THEN 'inconsistent_result' WHEN 2 THEN 'inconsistent_setup' WHEN 3 THEN 'invalid_fen' WHEN 4 THEN 'illegal_move' WHEN 5 THEN CASE WHEN plies > 0 THEN 'incorrect_move_number' END
  WHEN 6 THEN 'syntax' WHEN 7 THEN 'invalid_san' END"""


@query("doctor_categories", f"SELECT category, count(*) AS games, CAST(sum(moves) AS BIGINT) AS moves FROM (SELECT {_CATEGORY} AS category, CASE WHEN ({_CATEGORY}) IS NULL THEN plies + CASE WHEN line_id = 10 THEN 2 ELSE 0 END WHEN game_id % 12 = 1 THEN 0 ELSE 0 END AS moves FROM g) GROUP BY category")
def doctor_categories(s, d):
    """Faults of every kind, one a game at most, and the moves before them."""
    found = doctor.diagnose(_faults(s, d))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("games"), F.sum("moves").alias("moves"))


@query("doctor_first_faults", f"SELECT source, source_game AS game, {_CATEGORY} AS category, CAST(1 AS INTEGER) AS status FROM g WHERE ({_CATEGORY}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY source_game) = 1")
def doctor_first_faults(s, d):
    """What a scan gives that stops at each source's first fault, with the source's exit status."""
    found = _staged(s, doctor.diagnose(_faults(s, d)), "diagnostics")
    return doctor.first_faults(found).join(doctor.exit_status(found), "source").select("source", "game", "category", "status")


@query("doctor_totals", "SELECT source, count(*) AS games, CAST(sum(plies + CASE WHEN line_id = 10 THEN 2 ELSE 0 END) AS BIGINT) AS moves, CAST(0 AS BIGINT) AS faults FROM g GROUP BY source")
def doctor_totals(s, d):
    rows = with_pgn(raw_games(s, d, numbered=True)).select("source", (F.col("source_game") - 1).alias("source_game"), F.lit(0).cast("bigint").alias("byte_offset"), F.col("pgn").alias("raw"), F.lit(None).cast("string").alias("error"))
    return doctor.totals(doctor.diagnose(rows))


@query("doctor_result_consistency", "SELECT source, source_game AS game, 'inconsistent_result' AS category FROM g WHERE game_id % 12 = 1")
def doctor_result_consistency(s, d):
    return doctor.diagnose(_faults(s, d)).where("category = 'inconsistent_result'").select("source", "game", "category")


@query("doctor_setup", "SELECT source, source_game AS game, CASE game_id % 12 WHEN 2 THEN 'inconsistent_setup' ELSE 'invalid_fen' END AS category FROM g WHERE game_id % 12 IN (2, 3)")
def doctor_setup(s, d):
    return doctor.diagnose(_faults(s, d)).where("category IN ('inconsistent_setup', 'invalid_fen')").select("source", "game", "category")


@query("doctor_limit", "SELECT source, CAST(count(*) AS BIGINT) AS listed FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY source_game) AS k FROM g WHERE game_id % 12 IN (1, 2, 3, 4, 6, 7)) WHERE k <= 100 GROUP BY source")
def doctor_limit(s, d):
    keep = doctor.diagnose(_faults(s, d)).where("category <> 'incorrect_move_number'")
    return doctor.limited(keep, 100).groupBy("source").agg(F.count(F.lit(1)).alias("listed"))


# Database


@query("db_info", f"SELECT count(*) AS games, CAST(sum(mainline_plies) AS BIGINT) AS plies, min(played_on) AS earliest, max(played_on) AS latest, count(*) FILTER (result = 1) AS white_wins, count(*) FILTER (result = 2) AS black_wins, count(*) FILTER (result = 3) AS draws, count(*) FILTER (result = 0) AS unfinished, count(DISTINCT source) AS sources, count(DISTINCT source) AS fingerprinted, CAST(sum(plies + 1) AS BIGINT) AS positions FROM g")
def db_info(s, d):
    rows = with_pgn(games(s, d))
    return store.info(rows, store.fingerprints(rows), pgn.position_rows(replayed(s, d)))


_PGN = """concat('[Event "Adapter"]', chr(10), coalesce(concat('[White "', white, '"]', chr(10)), ''), coalesce(concat('[Black "', black, '"]', chr(10)), ''), coalesce(concat('[Date "', date_text, '"]', chr(10)), ''),
  coalesce(concat('[WhiteElo "', white_elo_text, '"]', chr(10)), ''), coalesce(concat('[BlackElo "', black_elo_text, '"]', chr(10)), ''), coalesce(concat('[TimeControl "', time_control, '"]', chr(10)), ''),
  chr(10), movetext, ' ', CASE result WHEN 0 THEN '*' WHEN 1 THEN '1-0' WHEN 2 THEN '0-1' ELSE '1/2-1/2' END, chr(10), chr(10))"""
_PGN = _PGN.replace("concat('[White \"', white, '\"]', chr(10))", "'[White \"' || white || '\"]' || chr(10)")
for _t, _c in (("Black", "black"), ("Date", "date_text"), ("WhiteElo", "white_elo_text"), ("BlackElo", "black_elo_text"), ("TimeControl", "time_control")):
    _PGN = _PGN.replace(f"concat('[{_t} \"', {_c}, '\"]', chr(10))", f"'[{_t} \"' || {_c} || '\"]' || chr(10)")


_BLOCKED = f"(SELECT source, (source_game - 1) // {store.BLOCK} AS block, sha256(string_agg(sha256({_PGN}), '' ORDER BY source_game)) AS digest, count(*) AS n, sum(strlen({_PGN})) AS b FROM g GROUP BY ALL)"


@query("db_fingerprint", f"SELECT source, sha256(string_agg(digest, '' ORDER BY block)) AS fingerprint, CAST(sum(n) AS BIGINT) AS games, CAST(sum(b) AS BIGINT) AS bytes FROM {_BLOCKED} GROUP BY source")
def db_fingerprint(s, d):
    return store.fingerprints(with_pgn(raw_games(s, d, numbered=True)))


@query("db_update_actions", "SELECT source, CASE source WHEN '1-URGENT' THEN 'replaced' WHEN '2-HIGH' THEN 'added' WHEN '3-MEDIUM' THEN 'retained' ELSE 'unchanged' END AS action FROM g GROUP BY source")
def db_update_actions(s, d):
    """One source is new, one has changed, one is not given, the others are as they were."""
    rows = with_pgn(raw_games(s, d, numbered=True))
    old = store.fingerprints(rows.where("source <> '2-HIGH'").withColumn("pgn", F.when(F.col("source") == "1-URGENT", F.concat(F.col("pgn").cast("string"), F.lit(" ")).cast("binary")).otherwise(F.col("pgn"))))
    return store.changes(store.fingerprints(rows.where("source <> '3-MEDIUM'")), old)


@query("db_semi_delete", oracle("SELECT CAST(sum(plies + 1) AS BIGINT) AS positions FROM g WHERE source <> '1-URGENT'"), plain=True)
def db_semi_delete(s, d):
    games_ = replayed(s, d)
    gone = games_.select("source").where("source = '1-URGENT'").distinct()
    return store.without_source(pgn.position_rows(games_), games_, gone).agg(F.count(F.lit(1)).alias("positions"))


@query("db_damaged_games", "SELECT CASE game_id % 1000 WHEN 1 THEN 'size_invalid' WHEN 2 THEN 'size_differs' ELSE 'pgn_invalid' END AS issue, source || ' game ' || source_game AS what FROM g WHERE game_id % 1000 IN (1, 2, 3)")
def db_damaged_games(s, d):
    """Stored games whose recorded size is none, whose text has another, or is no game."""
    rows, k = with_pgn(raw_games(s, d)), F.col("game_id") % 1000
    text = F.when(k == 3, F.concat(F.lit(")"), F.col("pgn").cast("string")).cast("binary")).otherwise(F.col("pgn"))
    size = F.when(k == 1, F.lit(-1)).when(k == 2, F.length("pgn") + 1).otherwise(F.length(text))
    return store.damaged_games(rows.select("source", "source_game", text.alias("pgn"), size.alias("pgn_bytes")))


@query("db_export", f"SELECT game_id, {_PGN} AS text FROM g WHERE {_OWN}")
def db_export(s, d):
    """The texts that the export of a player's games writes."""
    return store.exported_text(GameQuery(player=PLAYER).run(with_pgn(games(s, d))))


@query("db_integrity", "SELECT issue, what FROM (SELECT 'position_without_game' AS issue, CAST(game_id AS VARCHAR) AS what FROM g WHERE game_id % 5000 = 11 UNION ALL SELECT 'fingerprint', source FROM g WHERE game_id % 5000 = 11 GROUP BY source) ORDER BY 1, 2 LIMIT 10")
def db_integrity(s, d):
    rows = with_pgn(raw_games(s, d))
    whole = store.fingerprints(rows)
    left = rows.where("game_id % 5000 <> 11")
    return store.integrity_issues(left, rows.select("game_id"), whole, texts=False)


# Sync over the table `events`: ids arrive again and again, contents change now and then

_ARRIVALS = "SELECT event_id AS seq, CAST(user_id AS STRING) AS remote_id, CAST(floor(value / 20) AS STRING) AS content, event_type = 'view' AS unfinished, CASE event_type WHEN 'purchase' THEN 'win' WHEN 'click' THEN 'draw' WHEN 'error' THEN 'loss' WHEN 'view' THEN 'unfinished' END AS player_result FROM {events}"


def arrivals(s, d) -> DataFrame:
    return s.sql(_ARRIVALS, events=s.read.parquet(f"{d}/events.parquet"))


_ACTED = f"a AS ({_ARRIVALS.format(events='events')}), acted AS (SELECT *, CASE WHEN k = 1 THEN 'created' WHEN content IS NOT DISTINCT FROM before THEN 'unchanged' ELSE 'updated' END AS action FROM (SELECT *, lag(content) OVER w AS before, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY remote_id ORDER BY seq)))"


@query("sync_actions", f"WITH {_ACTED} SELECT seq, action FROM acted", plain=True)
def sync_actions(s, d):
    return sync.actions(arrivals(s, d)).select("seq", "action")


@query("sync_results", f"WITH {_ACTED} SELECT count(*) AS received, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ("created", "updated", "unchanged")) + ", " + ", ".join(f"count(*) FILTER (action = 'created' AND player_result = '{r}') AS created_{r}" for r in ("win", "draw", "loss", "unfinished")) + " FROM acted", plain=True)
def sync_results(s, d):
    return sync.summary(sync.actions(arrivals(s, d)))


@query("sync_unfinished", f"WITH {_ACTED} SELECT remote_id FROM (SELECT remote_id, arg_max(unfinished, seq) AS u FROM a GROUP BY remote_id) WHERE u", plain=True)
def sync_unfinished(s, d):
    return sync.latest(arrivals(s, d)).where("unfinished").select("remote_id")


# Engine evidence: evaluations derived from `orders`

_EVALUATIONS = """SELECT o_orderkey AS id, o_custkey AS game_id, CAST(o_orderkey AS INT) AS ply, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'mate_for' WHEN 1 THEN 'mate_against' ELSE 'centipawns' END AS bk, CAST((o_orderkey * 37) % 900 - 450 AS INT) AS bv,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'lower' WHEN 1 THEN 'upper' ELSE 'exact' END AS bb, CASE CAST(o_orderkey % 13 AS INT) WHEN 0 THEN 'mate_for' WHEN 1 THEN 'mate_against' ELSE 'centipawns' END AS ak,
  CAST((o_orderkey * 53) % 900 - 450 AS INT) AS av, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'lower' WHEN 1 THEN 'upper' ELSE 'exact' END AS ab, concat('m', CAST(o_orderkey % 3 AS STRING)) AS played_uci, concat('m', CAST(o_orderkey % 4 AS STRING)) AS best_uci FROM {orders}"""


def evaluations(s, d) -> DataFrame:
    return s.sql(_EVALUATIONS, orders=s.read.parquet(f"{d}/orders.parquet"))


_SETTLED = "((bk = 'mate_against' AND bb = 'exact') OR (bk = 'centipawns' AND bv < -300 AND bb IN ('exact', 'upper')))"
_ELIGIBLE = "((bk = 'centipawns' AND bv >= -300 AND bb IN ('exact', 'lower')) OR (bk = 'mate_for' AND bb = 'exact'))"
_ASSESSED = f"""e AS ({_EVALUATIONS.format(orders='orders')}), assessed AS (SELECT *, CASE WHEN {_SETTLED} THEN 'no_turning_point' WHEN NOT {_ELIGIBLE} THEN 'inconclusive'
  WHEN ak = 'mate_against' AND ab = 'exact' THEN 'turning_point' WHEN bk = 'mate_for' AND ak = 'centipawns' AND ab = 'exact' THEN 'turning_point' WHEN ak = 'mate_for' AND ab = 'exact' THEN 'no_turning_point'
  WHEN bk = 'centipawns' AND ak = 'centipawns' AND ab IN ('exact', 'upper') THEN CASE WHEN bv - av >= 100 THEN 'turning_point' WHEN bb = 'exact' AND ab = 'exact' THEN 'no_turning_point' ELSE 'inconclusive' END ELSE 'inconclusive' END AS verdict FROM e)"""


def _assessed(s, d) -> DataFrame:
    rows = evaluations(s, d)
    verdict, loss_kind, loss = evidence.assess(tuple(map(F.col, ("bk", "bv", "bb"))), tuple(map(F.col, ("ak", "av", "ab"))))
    return rows.withColumns({"verdict": verdict, "loss_kind": loss_kind, "loss": loss})


@query("evidence_assess", f"WITH {_ASSESSED} SELECT id, verdict, CASE WHEN verdict = 'turning_point' AND bk = 'centipawns' AND ak = 'centipawns' THEN CAST(bv - av AS BIGINT) END AS loss FROM assessed", plain=True)
def evidence_assess(s, d):
    return _assessed(s, d).select("id", "verdict", "loss")


@query(
    "evidence_diagnose",
    f"""WITH {_ASSESSED}, own AS (SELECT game_id, ply, CASE WHEN verdict = 'turning_point' AND played_uci = best_uci THEN 'inconclusive' ELSE verdict END AS verdict FROM assessed),
    turn AS (SELECT game_id, min(ply) FILTER (verdict = 'turning_point') AS turn FROM own GROUP BY game_id)
    SELECT game_id, count(*) AS analyzed_moves, count(*) FILTER (verdict = 'inconclusive') AS inconclusive_moves, min(turn) AS turning_ply FROM own JOIN turn USING (game_id) WHERE turn IS NULL OR ply <= turn GROUP BY game_id""",
    plain=True,
)
def evidence_diagnose(s, d):
    return evidence.diagnose(_assessed(s, d)).select("game_id", "analyzed_moves", "inconclusive_moves", "turning_ply")


@query(
    "evidence_diagnose_checked",
    f"""WITH {_ASSESSED}, own AS (SELECT game_id, ply, CASE WHEN verdict = 'turning_point' AND played_uci = best_uci THEN 'inconclusive' ELSE verdict END AS verdict,
      id % 211 = 0 OR id % 223 = 0 OR (verdict = 'turning_point' AND id % 53 = 0) AS odd FROM assessed),
    turn AS (SELECT game_id, min(ply) FILTER (verdict = 'turning_point') AS turn, min(ply) FILTER (odd) AS odd_at FROM own GROUP BY game_id)
    SELECT game_id, CASE WHEN odd_at IS NULL OR coalesce(odd_at > turn, false) THEN turn END AS turning_ply, CASE WHEN NOT (odd_at IS NULL OR coalesce(odd_at > turn, false)) THEN 'inconsistent_evidence' END AS error FROM turn""",
    plain=True,
)
def evidence_diagnose_checked(s, d):
    """Diagnoses whose analyses must be of one engine at one budget, and name their best move."""
    k = F.col("id")
    rows = _assessed(s, d).withColumns({
        "engine_before": F.lit("e"), "engine_after": F.when(k % 211 == 0, "f").otherwise("e"), "nodes_before": F.lit(100), "nodes_after": F.when(k % 223 == 0, 99).otherwise(100), "pv_first": F.when(k % 53 == 0, "x").otherwise(F.col("best_uci")),
    })
    return evidence.diagnose(rows, 100).select("game_id", "turning_ply", "error")


@query(
    "attempt_verdict",
    f"""WITH {_ASSESSED} SELECT id, CASE WHEN bk = 'centipawns' AND ak = 'centipawns' THEN CASE WHEN bb IN ('exact', 'upper') AND ab IN ('exact', 'lower') AND bv - av <= 30 THEN 'strong' WHEN bb IN ('exact', 'lower') AND ab IN ('exact', 'upper') AND bv - av > 30 THEN 'try_again' ELSE 'inconclusive' END
    WHEN bb = 'exact' AND ab = 'exact' AND ak = 'mate_for' AND bk <> 'mate_against' THEN 'strong' WHEN bb = 'exact' AND ab = 'exact' AND bk <> 'mate_against' AND NOT (bk = 'centipawns' AND ak = 'centipawns') THEN 'try_again' ELSE 'inconclusive' END AS verdict FROM e""",
    plain=True,
)
def attempt_verdict(s, d):
    return evaluations(s, d).select("id", evidence.attempt_verdict(tuple(map(F.col, ("bk", "bv", "bb"))), tuple(map(F.col, ("ak", "av", "ab")))).alias("verdict"))


@query("evidence_flip", f"WITH {_ASSESSED} SELECT id, CASE bk WHEN 'mate_for' THEN 'mate_against' WHEN 'mate_against' THEN 'mate_for' ELSE bk END AS kind, CASE WHEN bk = 'centipawns' THEN -bv ELSE bv END AS value, CASE bb WHEN 'lower' THEN 'upper' WHEN 'upper' THEN 'lower' ELSE bb END AS bound FROM e", plain=True)
def evidence_flip(s, d):
    k, v, b = evidence.flipped(F.col("bk"), F.col("bv"), F.col("bb"))
    return evaluations(s, d).select("id", k.alias("kind"), v.alias("value"), b.alias("bound"))


@query("repeated_positions", f"WITH {_ASSESSED} SELECT position, CAST(sum(n) AS BIGINT) AS games, coalesce(string_agg(concat(played_uci, '=', san, ':', CAST(n AS VARCHAR)), ',' ORDER BY played_uci) FILTER (n > 1), '') AS repeated_choices FROM (SELECT CAST(id % 997 AS VARCHAR) AS position, played_uci, count(*) AS n, concat('S', CAST(min(id) AS VARCHAR)) AS san FROM assessed WHERE verdict = 'turning_point' GROUP BY ALL) GROUP BY position HAVING sum(n) > 1", plain=True)
def repeated_positions(s, d):
    points = _assessed(s, d).where("verdict = 'turning_point'").select((F.col("id") % 997).cast("string").alias("position"), F.col("id").alias("game_id"), "played_uci", F.concat(F.lit("S"), F.col("id").cast("string")).alias("played_san"))
    return evidence.repeated_positions(points)


_SOLUTION = "CASE id % 3 WHEN 0 THEN 'unsolved' WHEN 1 THEN 'without_reveal' ELSE 'after_hint' END"
_DISPOSITION = "CASE id % 5 WHEN 2 THEN 'active' WHEN 1 THEN 'completed' WHEN 0 THEN 'again_later' WHEN 3 THEN 'skipped' ELSE 'active' END"


@query(
    "review_summary",
    f"""WITH {_ASSESSED}, t AS (SELECT *, verdict = 'turning_point' AS turned, CASE WHEN verdict = 'turning_point' AND bk = 'centipawns' AND ak = 'centipawns' THEN bv - av END AS cp, {_SOLUTION} AS solution, {_DISPOSITION} AS disposition, id % 2 = 0 AS revealed FROM assessed)
    SELECT count(*) AS games_analyzed, count(*) FILTER (turned) AS turning_points, count(*) FILTER (NOT turned) AS no_clear_turning_point, CAST(sum(id % 4) AS BIGINT) AS inconclusive_moves, min(ply) FILTER (turned) AS first_move, max(ply) FILTER (turned) AS last_move,
      count(cp) AS losses, round(avg(cp), 6) AS mean_cp, CAST(median(cp) AS DOUBLE) AS median_cp, coalesce(bool_or(cp IS NOT NULL AND NOT (bb = 'exact' AND ab = 'exact')), false) AS minimum_only,
      count(*) FILTER (turned AND ak = 'mate_against' AND ab = 'exact') AS allowed_mates, count(*) FILTER (turned AND bk = 'mate_for' AND ak = 'centipawns') AS lost_forced_mates,
      count(*) FILTER (solution = 'without_reveal') AS solved_without_reveal, count(*) FILTER (solution = 'after_hint') AS solved_after_hint, count(*) FILTER (revealed AND disposition = 'completed' AND solution <> 'without_reveal') AS completed_after_reveal,
      count(*) FILTER (disposition = 'again_later') AS practice_again_later, count(*) FILTER (disposition = 'skipped') AS skipped FROM t""",
    plain=True,
)
def review_summary(s, d):
    rows = _assessed(s, d).select(
        F.col("ply").alias("move_number"), "loss_kind", "loss", ((F.col("bb") == "exact") & (F.col("ab") == "exact")).alias("exact"), (F.col("id") % 4).alias("inconclusive_moves"), F.expr(_SOLUTION).alias("solution"),
        F.expr(_DISPOSITION).alias("disposition"), (F.col("id") % 2 == 0).alias("revealed"),
    )
    return evidence.review_summary(rows).withColumn("mean_cp", F.round("mean_cp", 6))


@query(
    "lesson_ranking",
    f"""WITH {_ASSESSED}, p AS (SELECT *, id % 997 AS position, CASE WHEN bk = 'centipawns' AND ak = 'centipawns' THEN 1 ELSE 0 END AS cp FROM assessed WHERE verdict = 'turning_point'),
    scored AS (SELECT id, round(count(*) OVER (PARTITION BY position, played_uci) * 4 + CASE WHEN cp = 1 THEN least(bv - av, 1000) / 100.0 ELSE 12 END + CASE WHEN cp = 0 OR (bb = 'exact' AND ab = 'exact') THEN 1 ELSE 0 END - (id % 6) * 0.25, 6) AS score FROM p)
    SELECT id AS game_id, score FROM scored WHERE ({_SOLUTION}) = 'unsolved' AND ({_DISPOSITION}) = 'active' AND id % 2 <> 0""",
    plain=True,
)
def lesson_ranking(s, d):
    """The active lessons' scores; revealed ones are not active."""
    points = _assessed(s, d).where("verdict = 'turning_point'").select(
        F.col("id").alias("game_id"), (F.col("id") % 997).alias("position"), "played_uci", "loss_kind", "loss", ((F.col("bb") == "exact") & (F.col("ab") == "exact")).alias("exact"), (F.col("id") % 6).alias("recency"),
        F.expr(_DISPOSITION).alias("disposition"), F.expr(_SOLUTION).alias("solution"), (F.col("id") % 2 == 0).alias("revealed"),
    )
    return evidence.lesson_ranking(points).select("game_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("focus_opening", _positions_sql(f"SELECT /*visits*/ name AS line, wins, draws, losses FROM (SELECT name, {_TALLY} FROM (SELECT DISTINCT name, game_id, result AS o FROM v WHERE ply = 4) GROUP BY name) WHERE wins + draws + losses >= 4 AND losses > 0 ORDER BY (2 * wins + draws) / CAST(wins + draws + losses AS DOUBLE), losses DESC, wins + draws + losses DESC, name LIMIT 1"), plain=True)
def focus_opening(s, d):
    totals, names = _results(s, d, 4, 4)
    openings = explore.chosen_positions(totals, top=None).join(names, "position_key").withColumnRenamed("name", "line")
    return explore.focus_opening(openings).select("line", "wins", "draws", "losses")


_PRACTICE = "SELECT user_id AS game_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'attempt' WHEN 'view' THEN 'replay' WHEN 'purchase' THEN 'reveal' WHEN 'signup' THEN 'later' WHEN 'error' THEN 'skip' ELSE 'done' END AS action, CASE WHEN value > 60 THEN 'strong' ELSE 'try_again' END AS verdict FROM {events}"


@query(
    "practice_state",
    f"""WITH a AS ({_PRACTICE.format(events='events')}), solved AS (SELECT game_id, min(seq) AS solved FROM a WHERE action = 'attempt' AND verdict = 'strong' GROUP BY game_id), shown AS (SELECT game_id, min(seq) AS shown FROM a WHERE action = 'reveal' GROUP BY game_id),
    last AS (SELECT game_id, CASE WHEN action = 'attempt' THEN CASE verdict WHEN 'strong' THEN 'completed' ELSE 'active' END WHEN action IN ('reveal', 'done') THEN 'completed' WHEN action = 'later' THEN 'again_later' WHEN action = 'skip' THEN 'skipped' ELSE 'active' END AS disposition
      FROM a QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY seq DESC) = 1),
    n AS (SELECT game_id, count(*) FILTER (action = 'attempt') AS total_attempts FROM a GROUP BY game_id)
    SELECT n.game_id, total_attempts, CAST(least(total_attempts, 100) AS INTEGER) AS kept_attempts, CASE WHEN solved IS NULL THEN 'unsolved' WHEN shown < solved THEN 'after_hint' ELSE 'without_reveal' END AS solution, shown IS NOT NULL AS revealed, disposition
    FROM n JOIN last USING (game_id) LEFT JOIN solved USING (game_id) LEFT JOIN shown USING (game_id)""",
    plain=True,
)
def practice_state(s, d):
    return evidence.practice_state(s.sql(_PRACTICE, events=s.read.parquet(f"{d}/events.parquet")))


@query("moves", oracle(f"SELECT g.game_id, m.ply, m.san FROM g JOIN (VALUES {_MOVES}) AS m(line_id, ply, san) USING (line_id)"), plain=True)
def moves(s, d):
    return pgn.move_rows(replayed(s, d)).select("game_id", "ply", "san")


_OPENED = "SELECT CAST(user_id AS STRING) AS path, event_id AS seq, CASE WHEN event_type = 'purchase' THEN concat('s', CAST(event_id AS STRING)) END AS sync, CASE WHEN event_type = 'click' THEN concat('r', CAST(event_id AS STRING)) END AS review FROM {events}"


@query("recent_libraries", f"WITH o AS ({_OPENED.format(events='events')}), e AS (SELECT path, max(seq) AS seq, arg_max(sync, seq) FILTER (sync IS NOT NULL) AS sync, arg_max(review, seq) FILTER (review IS NOT NULL) AS review FROM o GROUP BY path) SELECT CAST(row_number() OVER (ORDER BY seq DESC) AS INTEGER) AS place, path, sync, review FROM (SELECT * FROM e ORDER BY seq DESC LIMIT 12)", plain=True)
def recent_libraries(s, d):
    """The twelve paths opened last, each once, with the states told last."""
    return library.recent_libraries(s.sql(_OPENED, events=s.read.parquet(f"{d}/events.parquet")))


@query("snapshot_latest", "SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, (event_id % 10, event_id % 7, event_id)) AS snapshot FROM events GROUP BY user_id", plain=True)
def snapshot_latest(s, d):
    """Of the answers per path the newest by (generation, revision)."""
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 10).alias("generation"), (F.col("event_id") % 7).alias("revision"), F.col("event_id").alias("seq"), F.col("event_type").alias("snapshot"))
    return review.latest_snapshots(rows)


# More of the kernel, text functions and small rules


@query("legal_moves", _positions_sql("""SELECT /*visits*/ DISTINCT v.name, k.n AS moves, CAST(0 AS BIGINT) AS unplayable FROM v JOIN (VALUES ('', 20), ('e4', 20), ('d4', 20), ('f3', 20), ('Nf3', 20)) AS k(name, n) ON v.name = k.name WHERE v.ply <= 1"""), plain=True)
def legal_moves(s, d):
    """Legal moves of the positions after at most one ply, and those of them that their own notation cannot play."""
    from ..functions import udf

    udf.register(s)
    steps = replayed(s, d).select(F.explode("steps").alias("s"), "moves").select("s.fen", F.coalesce("s.san", F.lit("")).alias("name"), "s.ply").where("ply <= 1").distinct()
    return s.sql("SELECT p.name, CAST(count(*) AS INT) AS moves, count_if(m.fen IS NULL) AS unplayable FROM {p} p, LATERAL legal_moves(p.fen) m GROUP BY p.name", p=steps)


@query("fen_roundtrip", oracle("SELECT CAST(sum(plies + 1) AS BIGINT) AS positions, CAST(sum(plies + 1) AS BIGINT) AS same_fen, CAST(sum(plies + 1) AS BIGINT) AS same_key FROM g"), plain=True)
def fen_roundtrip(s, d):
    from ..functions import udf

    steps = replayed(s, d).select(F.explode("steps").alias("s")).select("s.*")
    each = steps.select("fen", "position_key").groupBy("fen", "position_key").agg(F.count(F.lit(1)).alias("n"))
    checked = each.select("n", (udf.fen_normalize("fen") == F.col("fen")).alias("f"), (udf.position_key("fen") == F.col("position_key")).alias("k"))
    return checked.agg(F.sum("n").alias("positions"), F.sum(F.when(F.col("f"), F.col("n"))).alias("same_fen"), F.sum(F.when(F.col("k"), F.col("n"))).alias("same_key"))


@query("san_roundtrip", oracle(f"SELECT m.san, CAST(count(*) AS BIGINT) AS n FROM g JOIN (VALUES {_MOVES}) AS m(line_id, ply, san) USING (line_id) GROUP BY m.san"), plain=True)
def san_roundtrip(s, d):
    """Moves as the kernel writes them, over all games."""
    return pgn.move_rows(replayed(s, d)).groupBy("san").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_texts",
    """SELECT c_custkey, nullif(trim(concat('  ', c_mktsegment, ' ')), '') AS trimmed, regexp_full_match(c_name, '[A-Za-z0-9_-]{2,30}') AS username, CAST(floor((w + dr / 2) / (w + dr + l + 1) * 100 + 0.5) AS INTEGER) AS score,
      concat(w, 'W · ', dr, 'D · ', l, 'L') AS record, greatest(1.0, least(98.0, 100.0 * w / 40)) AS progress FROM (SELECT *, c_custkey % 40 AS w, CAST(c_custkey % 7 AS DOUBLE) AS dd, c_custkey % 7 AS dr, c_custkey % 5 AS l FROM customer)""",
    plain=True,
)
def fn_texts(s, d):
    k = F.col("c_custkey")
    w, dr, lost = k % 40, k % 7, k % 5
    return s.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", C.trimmed_or_null(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).alias("trimmed"), C.is_username(F.col("c_name")).alias("username"), C.score_percent(w, dr, w + dr + lost + 1).alias("score"),
        C.record_text(w, dr, lost).alias("record"), C.progress_percent(w, F.lit(0), F.lit(40)).alias("progress"),
    )


@query("fn_github_escape", "SELECT page_id, replace(replace(replace(html, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS data, replace(replace(replace(replace(replace(url, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS property FROM pages", plain=True)
def fn_github_escape(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", C.github_escape(F.col("html")).alias("data"), C.github_escape(F.col("url"), True).alias("property"))


@query("lesson_sample", "SELECT count(*) AS games FROM g WHERE mainline_plies > 0 AND result IN (1, 2)")
def lesson_sample(s, d):
    """Games that lessons can come from: decided, with moves."""
    return review.lesson_games(games(s, d)).agg(F.count(F.lit(1)).alias("games"))


@query("query_ply_range", _positions_sql("SELECT /*visits*/ ply, CAST(count(*) AS BIGINT) AS visits FROM v WHERE ply BETWEEN 2 AND 6 GROUP BY ply"), plain=True)
def query_ply_range(s, d):
    return pgn.position_rows(replayed(s, d)).where(F.col("ply").between(2, 6)).groupBy("ply").agg(F.count(F.lit(1)).alias("visits"))


@query("partition_plan", f"SELECT source, part, count(*) AS games, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT source, n, CAST((sum(n) OVER (PARTITION BY source ORDER BY source_game) - n) // 100000 AS BIGINT) AS part FROM (SELECT source, source_game, strlen({_PGN}) AS n FROM g)) GROUP BY ALL")
def partition_plan(s, d):
    """Ranges of whole games of about 100,000 bytes in each source."""
    rows = with_pgn(raw_games(s, d, numbered=True)).select("source", "source_game", F.length("pgn").cast("bigint").alias("n"))
    return pgn.balanced_parts(rows).groupBy("source", "part").agg(F.count(F.lit(1)).alias("games"), F.sum("n").alias("bytes"))


@query("db_source_lookup", "SELECT substr(source, 1, 1) AS prefix, count(DISTINCT source) AS sources, count(DISTINCT source) > 1 AS ambiguous FROM g GROUP BY 1")
def db_source_lookup(s, d):
    """Sources by a name that may stand for several."""
    return store.ambiguous_names(raw_games(s, d), F.substring("source", 1, 1))


_LOG = """SELECT o_custkey AS search, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 9 THEN concat('bestmove ', CASE o_orderkey % 3 WHEN 0 THEN 'e2e4' WHEN 1 THEN 'd2d4' ELSE 'a7a8q' END, ' ponder e7e5') WHEN o_orderkey % 23 = 0 THEN 'info string score cp 5 pv e2e4'
  WHEN o_orderkey % 29 = 0 THEN 'info depth 3 multipv 2 score cp 90 pv d2d4' ELSE concat('info  depth ', CAST(o_orderkey % 20 AS STRING), ' multipv 1 score ', CASE WHEN o_orderkey % 7 = 0 THEN concat('mate ', CAST(o_orderkey % 9 - 4 AS STRING)) ELSE concat('cp ', CAST(o_orderkey % 400 - 200 AS STRING)) END,
  CASE WHEN o_orderkey % 4 = 0 THEN ' lowerbound' ELSE '' END, CASE WHEN o_orderkey % 44 = 0 THEN ' upperbound' ELSE '' END, ' nodes 5 pv ', CASE WHEN o_orderkey % 31 = 0 THEN 'zzzz' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'e2e4' WHEN 1 THEN 'd2d4' ELSE 'a7a8q' END END, ' e7e5') END AS line FROM {orders}"""
_INFO = """info AS (SELECT o_custkey AS search, o_orderkey AS seq, CAST(o_orderkey % 20 AS INTEGER) AS depth, CASE WHEN o_orderkey % 7 <> 0 THEN 'centipawns' WHEN o_orderkey % 9 - 4 > 0 THEN 'mate_for' ELSE 'mate_against' END AS kind,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN abs(o_orderkey % 9 - 4) ELSE o_orderkey % 400 - 200 END AS INTEGER) AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'lower' ELSE 'exact' END AS bound,
  CASE WHEN o_orderkey % 31 = 0 THEN 'zzzz' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'e2e4' WHEN 1 THEN 'd2d4' ELSE 'a7a8q' END END AS move, CASE WHEN o_orderkey % 44 = 0 THEN 'conflicting score bounds' WHEN o_orderkey % 31 = 0 THEN 'invalid variation' END AS error
  FROM orders WHERE o_orderkey % 10 <> 9 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0)"""


@query("uci_parse", f"WITH {_INFO} SELECT search, seq, depth, kind, value, bound, concat(move, ' e7e5') AS moves, error FROM info", plain=True)
def uci_parse(s, d):
    log = s.sql(_LOG, orders=s.read.parquet(f"{d}/orders.parquet"))
    return evidence.uci_info(log).select("search", "seq", "depth", "kind", "value", "bound", F.array_join("pv", " ").alias("moves"), "error")


@query(
    "uci_evidence",
    f"""WITH {_INFO}, best AS (SELECT o_custkey AS search, o_orderkey AS ended, CASE o_orderkey % 3 WHEN 0 THEN 'e2e4' WHEN 1 THEN 'd2d4' ELSE 'a7a8q' END AS best FROM orders WHERE o_orderkey % 10 = 9 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    own AS (SELECT info.*, best FROM info JOIN best USING (search) WHERE seq < ended), latest AS (SELECT * FROM own WHERE move = best QUALIFY row_number() OVER (PARTITION BY search ORDER BY seq DESC) = 1),
    exact AS (SELECT * FROM own WHERE bound = 'exact' QUALIFY row_number() OVER (PARTITION BY search ORDER BY seq DESC) = 1), broken AS (SELECT search, arg_min(error, seq) AS error FROM own WHERE error IS NOT NULL GROUP BY search)
    SELECT best.search, best.best, CASE WHEN latest.bound <> 'exact' AND exact.move = best.best AND exact.depth + 1 = latest.depth THEN exact.seq ELSE latest.seq END AS seq, coalesce(broken.error, CASE WHEN latest.seq IS NULL THEN 'missing score for bestmove' END) AS error
    FROM best LEFT JOIN latest USING (search) LEFT JOIN exact USING (search) LEFT JOIN broken USING (search)""",
    plain=True,
)
def uci_evidence(s, d):
    return evidence.best_evidence(s.sql(_LOG, orders=s.read.parquet(f"{d}/orders.parquet"))).select("search", "best", "seq", "error")


@query("player_decisions", _positions_sql(f"SELECT /*visits*/ v.game_id, CAST(count(*) AS BIGINT) AS decisions FROM v WHERE ply > 2 AND {_OWN} AND (ply % 2 = 1) = ({_W}) GROUP BY v.game_id"), plain=True)
def player_decisions(s, d):
    """Moves after two shared plies that the player had to find, by game."""
    own = explore.scoped(replayed(s, d), PLAYER).select("game_id", "white_key", F.explode("steps").alias("s")).select("game_id", "white_key", "s.ply")
    return review.player_moves(own, 2, PLAYER).groupBy("game_id").agg(F.count(F.lit(1)).alias("decisions"))


_EXERCISES = "SELECT user_id AS path, event_id AS place, event_id AS game_id, CASE event_type WHEN 'error' THEN 'completed' ELSE 'active' END AS disposition, CASE WHEN value > 40 THEN 'without_reveal' ELSE 'unsolved' END AS solution, event_id % 9 = 0 AS here FROM {events}"


@query("practice_entry", f"SELECT path, arg_min(game_id, (CASE WHEN disposition = 'active' AND solution = 'unsolved' THEN CASE WHEN here THEN 0 ELSE 1 END WHEN here THEN 2 ELSE 3 END, place)) AS entry FROM ({_EXERCISES.format(events='events')}) GROUP BY path", plain=True)
def practice_entry(s, d):
    """The exercise to open: the current one if it is active and unsolved, the first such, the current one, the first."""
    rows = s.sql(_EXERCISES, events=s.read.parquet(f"{d}/events.parquet"))
    return review.practice_entry(rows, F.when(F.col("here"), F.col("game_id")))


# Reports


def _reports(s, d) -> DataFrame:
    rows = with_pgn(raw_games(s, d)).select("source", F.length("pgn").cast("long").alias("bytes"), "pgn")
    return reports.statistics(pgn.parse_games(rows, "pgn", fields=("tags", "raw_date_tag", "raw_utc_date", "plies", "outcome")), "source")


@query("report_json", f"SELECT source, count(*) AS games, CAST(count(*) FILTER (result = 1) AS BIGINT) AS white_wins, CAST(count(*) FILTER (mainline_plies BETWEEN 1 AND 20) AS BIGINT) AS short, round(avg(mainline_plies), 6) AS average, count(white) AS white, max(played_on) AS latest, min(least(coalesce(white_elo, 99999), coalesce(black_elo, 99999))) AS lowest, count(*) FILTER (({_TC}) = 'sudden_death') AS sudden FROM g GROUP BY source")
def report_json(s, d):
    """Statistics reports of the sources as JSON, and what is read out of them again."""
    j = lambda path, kind: F.get_json_object("json", f"$.{path}").cast(kind)
    return reports.as_json(_reports(s, d), "source").select(
        "source", j("games", "long").alias("games"), j("results.white_wins", "long").alias("white_wins"), j("game_length.distribution.1-20", "long").alias("short"), F.round(j("game_length.average_plies", "double"), 6).alias("average"),
        j("header_coverage.white", "long").alias("white"), F.replace(j("dates.latest", "string"), F.lit("."), F.lit("")).cast("int").alias("latest"), j("ratings.minimum", "long").alias("lowest"), j("time_controls.sudden_death", "long").alias("sudden"),
    )


_TEXT = f"""SELECT source, concat('stats: valid', chr(10), 'source: ', source, chr(10), 'bytes: ', sum(strlen({_PGN})), chr(10), 'games: ', count(*), chr(10), 'mainline plies: ', sum(mainline_plies), chr(10),
  'results: ', count(*) FILTER (result = 1), ' white wins, ', count(*) FILTER (result = 2), ' black wins, ', count(*) FILTER (result = 3), ' draws, ', count(*) FILTER (result = 0), ' unfinished', chr(10),
  'game length (plies): min ', min(mainline_plies), ', avg ', printf('%.2f', avg(mainline_plies)), ', max ', max(mainline_plies), chr(10),
  'game-length buckets: 0=', count(*) FILTER (mainline_plies = 0), ', 1-20=', count(*) FILTER (mainline_plies > 0), ', 21-40=0, 41-60=0, 61-80=0, 81-120=0, 121-160=0, 161+=0', chr(10),
  'header coverage: Event ', count(*), '/', count(*), ', Site 0/', count(*), ', Date ', count(date_text), '/', count(*), ', Round 0/', count(*), ', White ', count(white), '/', count(*), ', Black ', count(black), '/', count(*), ', Result 0/', count(*), chr(10),
  'dates: ', count(played_on), ' complete (', arg_min(date_text, played_on), ' to ', arg_max(date_text, played_on), '), ', count(*) FILTER (date_text IS NOT NULL AND played_on IS NULL), ' incomplete/invalid, ', count(*) FILTER (date_text IS NULL), ' missing', chr(10)) AS text FROM g GROUP BY source"""


@query("report_text", _TEXT)
def report_text(s, d):
    """Statistics reports for people, up to their dates; the lines of ratings and time controls follow from `report_json`'s figures."""
    told = reports.source_texts(_reports(s, d), F.lit("valid"))
    return told.select("source", F.regexp_extract("text", r"\A(?s:.*?)(?=ratings: )", 0).alias("text"))


_ANNOTATED = f"SELECT source, source_game, {_CATEGORY} AS category, row_number() OVER (PARTITION BY source ORDER BY source_game) AS k FROM g WHERE ({_CATEGORY}) IS NOT NULL"


@query("report_annotations", f"SELECT source, CAST(k - 1 AS INTEGER) AS k, concat('::error file=', source, ',line=1,col=1,title=Doctor%3A inconsistent result::game ', source_game, ': the Result tag is no result (2-0)') AS line FROM ({_ANNOTATED}) WHERE k <= 100 AND category = 'inconsistent_result'")
def report_annotations(s, d):
    """Workflow commands of the first hundred faults of each source; those of one kind, whose text is the same in every game."""
    told = reports.first_diagnostics(doctor.diagnose(_faults(s, d)))
    return reports.doctor_annotations(told).where("line LIKE '%inconsistent result%'")


@query("report_json_lines", f"""WITH a AS ({_ANNOTATED}), n AS (SELECT source, count(*) AS n, count(*) > 100 AS over FROM a GROUP BY source), good AS (SELECT source, count(*) FILTER (({_CATEGORY}) IS NULL) AS games FROM g GROUP BY source)
  SELECT n.source, CAST(least(n, 100) AS BIGINT) AS diagnostics, 'invalid' AS status, games, over AS limited FROM n JOIN good USING (source)""")
def report_json_lines(s, d):
    """A source's JSON lines: how many diagnostics they hold, and what its summary says."""
    lines = reports.doctor_json_lines(reports.doctor_reports(_staged(s, doctor.diagnose(_faults(s, d)), "diagnostics")))
    j = lambda path: F.get_json_object("line", f"$.{path}")
    told = lambda path: F.max(F.when(j("record") == "summary", j(path)))
    return lines.groupBy("source").agg(F.count_if(j("record") == "diagnostic").alias("diagnostics"), told("status").alias("status"), told("games").cast("long").alias("games"), told("error_limit_reached").cast("boolean").alias("limited"))


@query("report_summary", f"""WITH a AS ({_ANNOTATED}), n AS (SELECT source, least(count(*), 100) AS n, count(*) > 100 AS over FROM a GROUP BY source)
  SELECT concat('Doctor: invalid - ', (SELECT count(*) FROM n), ' inputs; ', (SELECT CAST(sum(n) AS BIGINT) FROM n), ' diagnostics, ', (SELECT count(*) FROM g WHERE ({_CATEGORY}) IS NULL), ' complete games, ',
    (SELECT CAST(sum(plies + CASE WHEN line_id = 10 THEN 2 ELSE 0 END) AS BIGINT) FROM g WHERE ({_CATEGORY}) IS NULL), ' moves', CASE WHEN (SELECT bool_or(over) FROM n) THEN '; error limit reached' ELSE '' END) AS line""")
def report_summary(s, d):
    """The last line over all sources."""
    return reports.doctor_summary(reports.doctor_reports(_staged(s, doctor.diagnose(_faults(s, d)), "diagnostics")))


@query("library_page_total", f"SELECT CAST(row_number() OVER (ORDER BY {_NEWEST}) AS INTEGER) AS place, game_id, total FROM (SELECT *, count(*) OVER () AS total FROM g WHERE {_OWN} ORDER BY {_NEWEST} LIMIT 50 OFFSET 20)")
def library_page_total(s, d):
    found = GameQuery(player=PLAYER).run(games(s, d))
    return library.ranked(library.page_with_total(found, "date", True, 50, 20), "date").select("place", "game_id", "total")


# Reviews

_REVIEW_PLAYER = "CASE WHEN game_id % 8 = 5 THEN '' ELSE coalesce(black, white) END"
_REVIEW_ERROR = f"""CASE WHEN ({_REVIEW_PLAYER}) IS NULL OR ({_REVIEW_PLAYER}) = '' THEN 'player_required' WHEN game_id % 8 = 2 THEN 'invalid_pgn:duplicate_tag' WHEN game_id % 8 = 1 THEN 'unsupported_variant'
  WHEN coalesce(white_key = black_key, false) THEN 'player_missing_or_ambiguous' WHEN game_id % 8 = 3 THEN 'invalid_setup' WHEN game_id % 8 = 4 THEN 'expected_one_game' WHEN game_id % 8 = 6 THEN 'illegal_mainline:1' END"""


def _reviews(s, d) -> DataFrame:
    """Games with a player and planted faults, as reviews take them."""
    rows, k, text = with_pgn(games(s, d)), F.col("game_id") % 8, F.col("pgn").cast("string")
    planted = (
        F.when(k == 1, F.concat(F.lit('[Variant "Chess960"]\n'), text)).when(k == 2, F.concat(F.lit('[Black "x"]\n[Black "y"]\n'), text)).when(k == 3, F.concat(F.lit('[SetUp "1"]\n'), text))
        .when(k == 4, F.concat(text, text)).when(k == 6, F.regexp_replace(text, r"\n\n(?=(?s:.))", "\n\n1. Ke5 ")).otherwise(text)
    )
    return review.parse_reviews(rows.select("game_id", planted.cast("binary").alias("pgn"), F.expr(_REVIEW_PLAYER).alias("player")))


@query("review_parse", f"SELECT game_id, e AS error, CASE WHEN e IS NULL THEN CASE WHEN black IS NOT NULL THEN 'black' ELSE 'white' END END AS color, CASE WHEN e IS NULL THEN CAST(plies AS INTEGER) END AS plies FROM (SELECT *, {_REVIEW_ERROR} AS e FROM g)")
def review_parse(s, d):
    return _reviews(s, d).select("game_id", "error", "color", F.when(F.col("error").isNull(), F.size("uci")).alias("plies"))


@query("review_decisions", f"SELECT game_id, m.ply, m.san AS played_san FROM (SELECT *, {_REVIEW_ERROR} AS e FROM g) JOIN (VALUES {_MOVES}) AS m(line_id, ply, san) USING (line_id) WHERE e IS NULL AND m.ply > 2 AND (m.ply % 2 = 0) = (black IS NOT NULL)")
def review_decisions(s, d):
    return review.decisions(_reviews(s, d), 2).select("game_id", "ply", "played_san")


_START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
_PVS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'e2e4 e7e5 g1f3 b8c6 f1b5 a7a6 b5a4 g8f6' WHEN 1 THEN 'e2e5' WHEN 2 THEN '' WHEN 3 THEN 'g1f3 g8f6 f3g1 f6g8' ELSE 'e2e4 e7e4' END AS moves FROM {orders}"


@query("legal_variations", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6' WHEN 3 THEN 'Nf3 Nf6 Ng1 Ng8' END AS sans, CASE o_orderkey % 5 WHEN 1 THEN 'illegal variation' WHEN 2 THEN 'missing move in nonterminal position' WHEN 4 THEN 'illegal variation' END AS error FROM orders", plain=True)
def legal_variations(s, d):
    rows = s.sql(_PVS, orders=orders(s, d)).select("id", F.lit(_START).alias("fen"), F.filter(F.split("moves", " "), lambda m: m != "").alias("pv"))
    return review.legal_variations(rows).select("id", F.array_join("pv_san", " ").alias("sans"), "error")


@query("replay_lines", "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 7 WHEN 2 THEN 1 WHEN 3 THEN 5 END AS INTEGER) AS positions, CASE o_orderkey % 5 WHEN 0 THEN 'r1bqkbnr/1ppp1ppp/p1n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R w KQkq - 0 4' WHEN 2 THEN 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1' WHEN 3 THEN 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 4 3' END AS last FROM orders", plain=True)
def replay_lines(s, d):
    """Positions of lines, after six moves at most."""
    rows = s.sql(_PVS, orders=orders(s, d)).select("id", F.lit(_START).alias("fen"), F.filter(F.split("moves", " "), lambda m: m != "").alias("moves"))
    return review.replay_lines(rows).select("id", F.when(F.col("fens").isNotNull(), F.size("fens")).alias("positions"), F.try_element_at("fens", F.lit(-1)).alias("last"))


_ATTEMPTS = "SELECT o_orderkey AS attempt_id, o_custkey AS game_id, CASE o_orderkey % 6 WHEN 0 THEN 'e2e4' WHEN 1 THEN 'd2d4' WHEN 2 THEN 'e2e5' WHEN 3 THEN 'g1f3' WHEN 4 THEN 'e2e4qq' ELSE 'a2a3' END AS uci FROM {orders}"
_AFTER = {"e2e4": "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1", "d2d4": "rnbqkbnr/pppppppp/8/8/3P4/8/PPP1PPPP/RNBQKBNR b KQkq d3 0 1", "g1f3": "rnbqkbnr/pppppppp/8/8/8/5N2/PPPPPPPP/RNBQKB1R b KQkq - 1 1"}


@query("verify_attempts", """SELECT o_orderkey AS attempt_id, CASE WHEN c.c_custkey % 7 = 0 OR o_orderkey % 6 = 4 THEN NULL WHEN o_orderkey % 6 = 2 THEN 'illegal' WHEN o_orderkey % 6 = 5 THEN NULL
    WHEN o_orderkey % 6 = 0 THEN CASE WHEN c.c_custkey % 3 = 2 THEN 'inconclusive' ELSE 'strong' END WHEN c.c_custkey % 3 = 2 THEN 'inconclusive' WHEN o_orderkey % 6 = 1 THEN CASE c.c_custkey % 3 WHEN 0 THEN 'strong' ELSE 'try_again' END ELSE 'try_again' END AS verdict,
  CASE WHEN o_orderkey % 6 = 4 THEN 'invalid move text' WHEN c.c_custkey % 7 = 0 THEN 'no exercise' WHEN o_orderkey % 6 = 5 THEN 'missing evidence' END AS error FROM orders JOIN customer c ON o_custkey = c_custkey""", plain=True)
def verify_attempts(s, d):
    """Attempts at the customers' exercises, with evaluations by the engine of each."""
    attempts = s.sql(_ATTEMPTS, orders=orders(s, d))
    customers = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("game_id"), F.concat(F.lit("engine"), (F.col("c_custkey") % 3).cast("string")).alias("engine"), F.lit(100).alias("nodes"))
    exercises = customers.where("game_id % 7 <> 0").select("*", F.lit(_START).alias("position_fen"), F.lit("e2e4").alias("best_uci"))
    best = {"e2e4": (50, 50), "d2d4": (30, -40), "g1f3": (-60, -60)}
    each = F.explode(F.array(*(F.struct(F.lit(_AFTER[m]).alias("fen"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, (a, b) in best.items())))
    rows = customers.select("engine", "nodes", each.alias("e")).distinct()
    mate = F.col("engine") == "engine2"
    analyses = rows.select(F.col("e.fen").alias("fen"), "engine", "nodes", F.when(mate, "mate_against").otherwise("centipawns").alias("kind"), F.when(F.col("engine") == "engine0", F.col("e.a")).otherwise(F.col("e.b")).alias("value"), F.lit("exact").alias("bound"))
    return review.verify_attempts(attempts, exercises, analyses)


_OPENINGS = "SELECT c_custkey, concat(' P', CAST(c_custkey AS STRING), ' ') AS player, CAST(c_custkey % 9 AS INT) AS ply, c_mktsegment AS line, c_custkey % 4 + 1 AS losses, c_custkey AS k FROM (SELECT c_custkey + 1 AS c_custkey, c_mktsegment FROM {customer})"


def _progress(s, d) -> DataFrame:
    rows = s.sql(_OPENINGS, customer=s.read.parquet(f"{d}/customer.parquet"))
    k = F.col("k")
    openings = rows.select("player", "ply", "line", "losses", F.array(k, k + 1, k, k + 2, F.lit(0).cast("long")).alias("review_game_ids"), k.alias("game_id"))
    saved = rows.where("k % 5 <> 0").select(review.pattern_key(F.col("player"), F.col("ply"), F.col("line")).alias("pattern"), F.array(k + 1, k + 9).alias("reviewed_game_ids"), F.array(k + 1, k + 2).alias("deferred_game_ids"), F.when(k % 2 == 0, k + 2).otherwise(k + 7).alias("current_game_id"))
    return review.reconciled_progress(openings, saved)


@query("progress_reconciled", "SELECT concat('v1:p', c_custkey, ':', c_custkey % 9, ':', c_mktsegment) AS pattern, c_mktsegment AS title, concat(c_custkey, ' ', c_custkey + 1, ' ', c_custkey + 2) AS game_ids, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE '' END AS reviewed, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey + 2 AS VARCHAR) ELSE '' END AS deferred, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN c_custkey + 2 ELSE c_custkey END AS current_game_id, c_custkey % 4 + 1 AS matching_losses FROM (SELECT c_custkey + 1 AS c_custkey, c_mktsegment FROM customer)", plain=True)
def progress_reconciled(s, d):
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return _progress(s, d).select("pattern", "title", text("game_ids").alias("game_ids"), text("reviewed_game_ids").alias("reviewed"), text("deferred_game_ids").alias("deferred"), "current_game_id", "matching_losses")


@query("progress_next", "SELECT concat('v1:p', c_custkey, ':', c_custkey % 9, ':', c_mktsegment) AS pattern, c_custkey AS current_game_id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END AS next_game_id FROM (SELECT c_custkey + 1 AS c_custkey, c_mktsegment FROM customer)", plain=True)
def progress_next(s, d):
    """Progress as a review begins with it, and the game after the current one."""
    rows = review.prepared_progress(_progress(s, d))
    nxt = review.next_review_game(F.col("game_ids"), F.col("reviewed_game_ids"), F.col("deferred_game_ids"), F.col("current_game_id"))
    return rows.select("pattern", "current_game_id", nxt.alias("next_game_id"))


@query("progress_coached", """WITH e AS (SELECT user_id, event_id, event_type, user_id % 2 = 0 AS running FROM events), ids AS (SELECT user_id, event_id, running, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'again_later' WHEN 'view' THEN 'active' END AS disposition FROM e)
  SELECT CAST(user_id AS VARCHAR) AS path, CAST(count(*) FILTER (disposition = 'completed' OR (disposition IS NULL AND running AND event_id % 3 = 0)) AS INTEGER) AS reviewed, CAST(count(*) FILTER (disposition = 'again_later' OR (disposition IS NULL AND event_id % 3 = 1)) AS INTEGER) AS deferred FROM ids GROUP BY user_id""", plain=True)
def progress_coached(s, d):
    """Saved progress brought in line with practice: every third game was reviewed, every third put off."""
    e = s.read.parquet(f"{d}/events.parquet")
    path, k = F.col("user_id").cast("string").alias("path"), F.col("event_id")
    of = lambda c: F.collect_list(F.when(c, k))
    progress = e.groupBy(path).agg(F.collect_list("event_id").alias("game_ids"), of(k % 3 == 0).alias("reviewed_game_ids"), of(k % 3 == 1).alias("deferred_game_ids"))
    t = F.col("event_type")
    practice = e.select(path, k.alias("game_id"), F.when(t == "purchase", "completed").when(t == "click", "again_later").when(t == "view", "active").alias("disposition"), (F.col("user_id") % 2 == 0).alias("running"))
    return review.coached_progress(progress, practice).select("path", F.size("reviewed_game_ids").alias("reviewed"), F.size("deferred_game_ids").alias("deferred"))


@query("cache_keys", f"SELECT game_id, (SELECT count(DISTINCT (line_id, black IS NULL)) FROM g) > 0 AS some, line_id IS NOT NULL AS named FROM (SELECT *, {_REVIEW_ERROR} AS e FROM g) WHERE e IS NULL")
def cache_keys(s, d):
    """Keys of the reviewable games: every one has a digest, and equal mainlines of one side share their line's hash."""
    rows = _reviews(s, d).where("error IS NULL").select("game_id", "initial_fen", "uci", "color", "player_name", F.lit(4).alias("shared_ply"), F.lit("engine").alias("engine_name"), F.lit("00").alias("engine_binary_hash"), F.lit(100_000).alias("nodes"), F.lit("x").alias("architecture"))
    keyed = review.cache_keys(rows)
    return keyed.select(F.col("game_id").cast("long").alias("game_id"), F.col("mainline_hash").rlike("^[0-9a-f]{64}$").alias("some"), F.col("digest").rlike("^[0-9a-f]{64}$").alias("named"))


@query("cache_lines", f"SELECT count(DISTINCT line_id) AS lines, count(DISTINCT game_id) AS keys FROM (SELECT *, {_REVIEW_ERROR} AS e FROM g) WHERE e IS NULL")
def cache_lines(s, d):
    """Different mainlines and different keys of the reviewable games."""
    rows = _reviews(s, d).where("error IS NULL").select("game_id", "initial_fen", "uci", "color", "player_name", F.lit(4).alias("shared_ply"), F.lit("engine").alias("engine_name"), F.lit("00").alias("engine_binary_hash"), F.lit(100_000).alias("nodes"), F.lit("x").alias("architecture"))
    keyed = review.cache_keys(rows).groupBy("mainline_hash").agg(F.count("digest").alias("n"))  # a key has its game's id, so digests don't repeat
    return keyed.agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("keys"))


@query("save_diagnoses", """WITH n AS (SELECT o_custkey AS k, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS old, c_custkey % 10 AS practice FROM customer WHERE c_custkey % 4 <> 0)
  SELECT CAST(coalesce(n.k, o.k) AS VARCHAR) AS digest, CASE WHEN lo IS NULL THEN 'untouched' WHEN lo <> hi OR (old IS NOT NULL AND old <> lo) THEN 'inconsistent' WHEN old IS NOT NULL THEN 'kept' ELSE 'created' END AS action, coalesce(old, CASE WHEN lo = hi THEN lo END) AS diagnosis, practice FROM n FULL JOIN o ON n.k = o.k""", plain=True)
def save_diagnoses(s, d):
    new = s.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("digest"), F.col("o_orderstatus").alias("diagnosis"))
    k = F.col("c_custkey")
    stored = s.read.parquet(f"{d}/customer.parquet").where(k % 4 != 0).select(k.cast("string").alias("digest"), F.when(k % 2 == 0, "F").otherwise("O").alias("diagnosis"), (k % 10).alias("practice"))
    return review.save_diagnoses(new, stored)


_FAULTS = ["versions", "diagnosis_versions", "nodes", "shared_ply", "analyzed_moves", "inconclusive_moves", "engine", "attempts", "ply", "best_move", "variation", "reply", "loss", "completed", "practice_without_point", "hint"]
_FAULT_SQL = " ".join(f"WHEN {i + 1} THEN '{name}'" for i, name in enumerate(_FAULTS))


@query("entry_faults", f"SELECT o_orderkey AS id, CASE o_orderkey % 17 {_FAULT_SQL} END AS fault FROM orders", plain=True)
def entry_faults(s, d):
    """Sound entries, of which each breaks one rule told by its number."""
    base = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 17).alias("k"))
    k = F.col("k")
    put = lambda i, wrong, right: F.when(k == i, wrong).otherwise(right)
    text = lambda *xs: F.array(*map(F.lit, xs))
    turned = k != 15
    point = lambda c: F.when(turned, c)
    rows = base.select(
        "id", put(1, 2, 1).alias("schema"), *(F.lit(1).alias(f"{c}_version") for c in ("selection", "evidence", "practice")), put(2, 2, 1).alias("diagnosis_selection"), F.lit(1).alias("diagnosis_evidence"), F.lit(100).alias("nodes"), put(3, 99, 100).alias("diagnosis_nodes"),
        F.lit(2).alias("shared_ply"), put(4, 3, 2).alias("diagnosis_shared_ply"), put(5, 1025, 9).alias("analyzed_moves"), put(6, 10, 1).alias("inconclusive_moves"), put(7, "other", "own").alias("engine"), F.lit("own").alias("engine_name"),
        F.when(k == 15, 0).otherwise(1).alias("total_attempts"), F.when(k == 8, 2).when(k == 15, 0).otherwise(1).alias("kept_attempts"), point(put(9, 2, 3)).alias("ply"), point(text("e2e4", "e7e5")).alias("history"), point(put(10, "g1f3", "a2a3")).alias("played_uci"), point(F.lit("g1f3")).alias("best_uci"),
        point(F.lit("Nf3")).alias("best_san"), point(F.when(k == 11, text("b1c3")).otherwise(text("g1f3"))).alias("pv"), point(text("Nf3")).alias("pv_san"), point(F.when(k == 12, text("e7e5", "d7d5")).otherwise(text("e7e5"))).alias("after_pv"), point(text("e5")).alias("after_pv_san"),
        *(point(F.lit(v)).alias(c) for c, v in (("bk", "centipawns"), ("bv", 200), ("bb", "exact"), ("ak", "centipawns"), ("av", 50), ("ab", "exact"), ("loss_kind", "centipawns"))), point(put(13, 151, 150).cast("long")).alias("loss"),
        F.when(k == 14, "completed").when(k == 15, "skipped").otherwise("active").alias("disposition"), F.lit(False).alias("revealed"), F.when(k == 16, "after_hint").otherwise("unsolved").alias("solution"),
    )
    return review.entry_faults(rows).select("id", "fault")


# Arrivals asked for again, previews, texts


@query("sync_refreshed", """WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n, count(*) FILTER (event_type = 'view' AND event_id % 50 = 0) AS others, bool_or(event_id % 2 = 0) FILTER (event_type = 'view') AS open, max(CASE WHEN user_id % 11 = 0 THEN 404 WHEN user_id % 13 = 0 THEN 500 ELSE 200 END) AS http FROM events GROUP BY user_id)
  SELECT CAST(user_id AS VARCHAR) AS requested_id, CASE WHEN http = 404 THEN 'vanished' WHEN http <> 200 THEN 'failed' WHEN others > 0 THEN 'unexpected_game_id' WHEN n <> 1 THEN 'unexpected_game_count' ELSE 'refreshed' END AS status FROM a""", plain=True)
def sync_refreshed(s, d):
    """What became of games that were asked for again, one by one."""
    e = s.read.parquet(f"{d}/events.parquet")
    u, k = F.col("user_id"), F.col("event_id")
    own = F.when(F.col("event_type") == "view", F.when(k % 50 == 0, F.lit("another")).otherwise(u.cast("string")))
    answers = e.select(u.cast("string").alias("requested_id"), F.when(u % 11 == 0, 404).when(u % 13 == 0, 500).otherwise(200).alias("http_status"), own.alias("remote_id"), (k % 2 == 0).alias("unfinished"))
    return collection.refreshed(answers.select("requested_id"), answers).select("requested_id", "status")


@query("sync_preview", "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS remote_id FROM events ORDER BY event_id LIMIT 24", plain=True)
def sync_preview(s, d):
    """The twenty-four newest games of a stream that is told newest first."""
    return collection.preview(arrivals(s, d)).select("seq", "remote_id")


@query("sync_state_unfinished", f"WITH a AS ({_ARRIVALS.format(events='events')}) SELECT count(*) AS unfinished FROM (SELECT remote_id, arg_max(unfinished, seq) AS u FROM a GROUP BY remote_id) WHERE u", plain=True)
def sync_state_unfinished(s, d):
    return collection.unfinished(arrivals(s, d)).agg(F.count(F.lit(1)).alias("unfinished"))


@query(
    "fn_evidence_texts",
    f"""WITH {_ASSESSED} SELECT id, concat(CASE bb WHEN 'lower' THEN 'at least ' WHEN 'upper' THEN 'at most ' ELSE '' END, CASE WHEN bk = 'centipawns' THEN concat(CASE WHEN bv >= 0 THEN '+' ELSE '' END, printf('%.2f', bv / 100.0), ' pawns') ELSE concat('mate ', CASE bk WHEN 'mate_for' THEN 'for' ELSE 'against' END, ' you', CASE WHEN bv <> 0 THEN concat(' in ', bv) ELSE '' END) END) AS score,
      CASE WHEN verdict = 'turning_point' THEN CASE WHEN bk = 'centipawns' AND ak = 'centipawns' THEN concat(CASE WHEN bb = 'exact' AND ab = 'exact' THEN '' ELSE 'at least ' END, printf('%.2f', (bv - av) / 100.0), ' pawns of evaluation lost') WHEN ak = 'mate_against' THEN 'allowed a forced mate' ELSE 'lost a forced mate' END END AS loss_told,
      CASE id % 3 WHEN 0 THEN 'Practice ' || (id % 5 + 1) || CASE WHEN id % 5 = 0 THEN ' position →' ELSE ' positions →' END WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'View diagnosis summary →' ELSE 'Continue diagnosis →' END ELSE 'Diagnose ' || (id % 4) || CASE WHEN id % 4 = 1 THEN ' loss →' ELSE ' losses →' END END AS recommended,
      CASE id % 4 WHEN 0 THEN 'COMPLETED ✓' WHEN 1 THEN 'FOR LATER' WHEN 2 THEN CASE WHEN id % 8 = 2 THEN 'ATTEMPTED' ELSE 'READY TO PRACTICE' END ELSE 'FAILED' END AS label FROM assessed""",
    plain=True,
)
def fn_evidence_texts(s, d):
    rows, k = _assessed(s, d), F.col("id")
    exact = (F.col("bb") == "exact") & (F.col("ab") == "exact")
    state = C.queue_state(F.lit("failed"), F.when(k % 4 == 0, "completed").when(k % 4 == 1, "again_later").when(k % 4 == 2, "active"), F.lit("unsolved"), F.lit(False), F.when(k % 8 == 2, 3).otherwise(0))
    return rows.select(
        "id", C.score_text(F.col("bk"), F.col("bv"), F.col("bb")).alias("score"), F.when(F.col("verdict") == "turning_point", C.loss_text(F.col("loss_kind"), F.col("loss"), exact)).alias("loss_told"),
        C.recommendation_label(F.when(k % 3 == 0, k % 5 + 1).otherwise(0), k % 3 == 1, k % 2 == 0, k % 4).alias("recommended"), C.choice(state, C.QUEUE_LABELS).alias("label"),
    )


@query(
    "fn_moves_told",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'pawn from e2 to e4' WHEN 1 THEN 'king from e1 to g1 (castling)' WHEN 2 THEN 'pawn from b7 to a8, capturing a rook, promote to queen' WHEN 3 THEN 'piece from d5 to d6' ELSE '' END AS told,
      CASE o_orderkey % 5 WHEN 0 THEN '450 650 450 450' WHEN 1 THEN '450 750 650 750' WHEN 2 THEN '150 150 50 50' WHEN 3 THEN '350 350 350 250' END AS arrow, CAST(o_orderkey % 64 AS INTEGER) AS square, chr(CAST(97 + o_orderkey % 8 AS INTEGER)) || CAST(o_orderkey % 64 // 8 + 1 AS VARCHAR) AS name, 64 AS squares FROM orders""",
    plain=True,
)
def fn_moves_told(s, d):
    """Moves in words, their arrows, and squares by number and name."""
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    k = F.col("id")
    uci = F.when(k % 5 == 0, "e2e4").when(k % 5 == 1, "e1g1").when(k % 5 == 2, "b7a8q").when(k % 5 == 3, "d5d6").otherwise("e9e4")
    fen = F.lit("r3k3/1P6/8/8/8/8/4P3/4K2R w K - 0 1")
    arrow = C.move_arrow(uci)
    at = (k % 64).cast("int")
    return rows.select(
        "id", C.describe_move(fen, uci).alias("told"), F.concat_ws(" ", *(F.when(arrow.isNotNull(), arrow[c].cast("string")) for c in ("x1", "y1", "x2", "y2"))).alias("arrow"), C.square_index(C.square_name(at)).alias("square"),
        C.square_name(at).alias("name"), F.size(C.fen_squares(fen)).alias("squares"),
    ).withColumn("arrow", F.nullif("arrow", F.lit("")))


@query("fn_throughput", f"SELECT source, round(CASE WHEN count(*) % 2 = 0 THEN 0 ELSE sum(strlen({_PGN})) / 1048576.0 / (count(*) / 1000.0) END, 9) AS rate, round(sum(strlen(movetext)) / CAST(sum(strlen({_PGN})) AS DOUBLE), 9) AS ratio FROM g GROUP BY source")
def fn_throughput(s, d):
    """Bytes a second (of no time for even numbers of games), and movetexts as a share of the texts."""
    rows = with_pgn(raw_games(s, d)).groupBy("source").agg(F.sum(F.length("pgn")).alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("movetext")).alias("m"))
    return rows.select("source", F.round(C.throughput(F.col("b"), F.when(F.col("n") % 2 == 0, 0.0).otherwise(F.col("n") / 1000)), 9).alias("rate"), F.round(C.compression_ratio(F.col("m"), F.col("b")), 9).alias("ratio"))


# Small outputs and orders


@query("query_summary", f"SELECT count(*) AS games, CAST(sum(strlen({_PGN})) AS BIGINT) AS bytes, count(*) FILTER ({_OWN}) AS matches FROM g")
def query_summary(s, d):
    rows = with_pgn(games(s, d)).withColumn("pgn_bytes", F.length("pgn").cast("long"))
    return summary(rows, GameQuery(player=PLAYER).run(rows))


@query("query_count_guarded", f"SELECT name, CASE name WHEN 'whole' THEN (SELECT count(*) FROM g WHERE {_OWN}) END AS matches FROM (VALUES ('whole'), ('failed')) AS t(name)")
def query_count_guarded(s, d):
    """A count is given only if no source failed."""
    rows, faulty = games(s, d), _faulty(s, d).where("error IS NOT NULL")
    found = GameQuery(player=PLAYER).run(rows)
    return count_unless_failed(found, faulty.where("false")).select(F.lit("whole").alias("name"), "matches").unionByName(count_unless_failed(found, faulty).select(F.lit("failed").alias("name"), "matches"))


@query("library_in_order", "SELECT CAST(l_linenumber AS INTEGER) AS place, g.game_id, white_key FROM (SELECT DISTINCT l_linenumber, l_orderkey FROM lineitem WHERE l_linenumber <= 2) JOIN g ON g.game_id = l_orderkey + 1")
def library_in_order(s, d):
    """Summaries of a list of ids, in the list's order; ids without a game are left out."""
    ids = s.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 2").select(F.col("l_linenumber").cast("int").alias("place"), (F.col("l_orderkey") + 1).alias("game_id")).distinct()
    return library.in_order(ids, games(s, d)).select("place", "game_id", "white_key")


@query("library_retained", "SELECT CAST(row_number() OVER (ORDER BY tier, place) AS INTEGER) AS place, game_id FROM (SELECT 0 AS tier, game_id AS place, game_id FROM g WHERE game_id IN (2, 5, 9) UNION ALL SELECT 1, -game_id, game_id FROM g WHERE game_id NOT IN (2, 5, 9)) ORDER BY tier, place LIMIT 6")
def library_retained(s, d):
    """Three retained games, then the newest ones, six in all."""
    rows = raw_games(s, d).select("game_id")
    retained = rows.where("game_id IN (2, 5, 9)").select("game_id", F.col("game_id").alias("place"))
    got = library.retained_then_recent(retained, rows.select("game_id", (-F.col("game_id")).alias("place")))
    kept = F.col("game_id").isin(2, 5, 9)
    return got.select(F.row_number().over(Window.orderBy(~kept, F.when(kept, F.col("game_id")).otherwise(-F.col("game_id")))).cast("int").alias("place"), "game_id")  # six rows


@query("fn_tag_values", """SELECT c_custkey, concat('"', c_name, '"\\') AS value, concat('n', chr(65533), 'x') AS lossy FROM customer""", plain=True)
def fn_tag_values(s, d):
    """Tag values with escaped quotes and backslashes, and one with a byte that is no UTF-8."""
    name = F.concat(F.lit('[White "\\"'), F.col("c_name"), F.lit('\\"\\\\"]\n[Black "n')).cast("binary")
    text = F.concat(name, F.lit(bytearray(b"\xff")), F.lit('x"]\n\n1. e4 *').cast("binary"))
    rows = pgn.parse_games(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.alias("raw")), fields=("tags",))
    return rows.select("c_custkey", F.col("tags")["White"].alias("value"), F.col("tags")["Black"].alias("lossy"))


_AT_ONE = "FROM g JOIN (VALUES (0, 'e4'), (1, 'd4'), (2, 'e4'), (3, 'e4'), (4, 'f3'), (5, 'Nf3'), (6, 'e4'), (7, 'd4'), (8, 'e4'), (10, 'e4'), (11, 'Nf3')) AS f(line_id, san) USING (line_id)"


@query("board_codes", f"""SELECT san, count(*) AS games, CASE san WHEN 'e4' THEN 'RNBQKBNRPPPP.PPP............P...................' WHEN 'd4' THEN 'RNBQKBNRPPP.PPPP...........P....................' WHEN 'f3' THEN 'RNBQKBNRPPPPP.PP.....P..........................' ELSE 'RNBQKB.RPPPPPPPP.....N..........................' END || 'pppppppprnbqkbnr' AS board {_AT_ONE} GROUP BY san""")
def board_codes(s, d):
    """Boards after the first move, from a1 to h8."""
    return pgn.move_rows(replayed(s, d)).where("ply = 1").groupBy("san", "board").agg(F.count(F.lit(1)).alias("games"))


@query("positions_in_check", "SELECT CAST(sum(plies + 1) AS BIGINT) AS positions, count(*) FILTER (line_id = 4) AS in_check FROM g")
def positions_in_check(s, d):
    """Of the book's positions only the mate is a check."""
    from ..functions import udf

    each = replayed(s, d).select(F.explode("steps.fen").alias("fen")).groupBy("fen").agg(F.count(F.lit(1)).alias("n"))
    return each.select("n", udf.in_check("fen").alias("c")).agg(F.sum("n").alias("positions"), F.sum(F.when(F.col("c"), F.col("n")).otherwise(0)).alias("in_check"))


@query("perft", f"SELECT san, CASE san WHEN 'e4' THEN 600 WHEN 'd4' THEN 560 WHEN 'f3' THEN 380 ELSE 440 END AS nodes FROM (SELECT DISTINCT san {_AT_ONE})")
def perft(s, d):
    """Legal games of two plies from the positions after the first move."""
    from ..functions import udf

    at = pgn.move_rows(replayed(s, d)).where("ply = 1").select("san", "fen").distinct()
    return at.select("san", udf.perft("fen", F.lit(2)).cast("int").alias("nodes"))


@query("uci_playable", "SELECT o_orderkey AS id, o_orderkey % 4 IN (0, 1) AND o_orderkey % 2000 < 1024 AS legal FROM orders", plain=True)
def uci_playable(s, d):
    """Moves in coordinates from the start: legal ones, others, and ones after too long a history."""
    k = F.col("o_orderkey")
    rows = s.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.lit(_START).alias("fen"), F.when(k % 4 == 0, "e2e4").when(k % 4 == 1, "b1c3").when(k % 4 == 2, "e1e2").otherwise("e9").alias("uci"), (k % 2000).alias("plies"))
    return review.playable(rows, history="plies").select("id", F.col("fen_after").isNotNull().alias("legal"))


@query("sync_due", "SELECT event_id, event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 1800 >= 900 AS due FROM events", plain=True)
def sync_due(s, d):
    """Whether a sync is due: never yet, the clock went back, or fifteen minutes have gone by."""
    k = F.col("event_id")
    last = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, 2_000_001).otherwise(2_000_000 - (k % 1800) * 1000)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", sync.due(last.cast("long"), F.lit(2_000_000)).alias("due"))


@query("doctor_syntax_only", "SELECT source, count(*) AS games, CAST(sum(CASE WHEN game_id % 12 = 6 THEN 0 ELSE plies + CASE WHEN line_id = 10 THEN 2 ELSE 0 END + CASE WHEN game_id % 12 IN (4, 7) THEN 2 WHEN game_id % 12 = 5 AND plies > 0 THEN 1 ELSE 0 END END) AS BIGINT) AS moves, count(*) FILTER (game_id % 12 IN (4, 6, 7)) AS faults FROM g GROUP BY source")
def doctor_syntax_only(s, d):
    """Without the rules of the game every notation counts as a move, at any depth; planted moves stand before the game and behind it, where they lack an outcome."""
    return doctor.totals(doctor.diagnose(_faults(s, d), semantic=False))


@query("doctor_headers", f"SELECT source, source_game AS game, white, black FROM g WHERE ({_CATEGORY}) IS NOT NULL")
def doctor_headers(s, d):
    """The headers that a fault's game has told so far."""
    found = doctor.diagnose(_faults(s, d)).where("category IS NOT NULL")
    return found.select("source", "game", F.try_element_at("headers", F.lit("White")).alias("white"), F.try_element_at("headers", F.lit("Black")).alias("black"))


@query("doctor_places", "SELECT source, source_game AS game, CAST(1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS at, CASE game_id % 12 WHEN 1 THEN '[Result \"2-0\"]' WHEN 2 THEN '[SetUp \"1\"]' ELSE '[FEN \"8/8\"]' END AS excerpt FROM g WHERE game_id % 12 IN (1, 2, 3)")
def doctor_places(s, d):
    """Line, column and excerpt of faults in the first tag."""
    found = doctor.diagnose(_faults(s, d)).where("category IN ('inconsistent_result', 'inconsistent_setup', 'invalid_fen')")
    return found.select("source", "game", "line", F.col("column").alias("at"), "excerpt")


def _shared(s, name: str) -> str:
    """A new folder in the shared one of the session; in local mode without one, a temporary folder."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not root and not s.sparkContext.master.startswith("local-") and s.sparkContext.master.startswith("local"):
        root = "file://" + tempfile.mkdtemp(prefix="chesslake-")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("files_roundtrip", f"SELECT count(*) AS games, CAST(sum(plies) AS BIGINT) AS plies, count(white) AS white, true AS in_order FROM g")
def files_roundtrip(s, d):
    """The games written as PGN files in the order of their ids and read from them again, in ranges."""
    path = _shared(s, "pgn")
    named = with_pgn(raw_games(s, d)).withColumn("pgn", F.concat(F.concat(F.lit('[Site "'), F.col("game_id").cast("string"), F.lit('"]\n')), F.col("pgn").cast("string")))
    pgn.write_pgn(named, path, suffix=".pgn")
    frames = pgn.read_frames(s, path, range_bytes=1 << 20)
    rows = pgn.parse_games(frames, fields=("tags", "plies", "error")).where("frame_error IS NULL AND error IS NULL")
    told = rows.select("source", "source_game", "plies", F.col("tags")["Site"].cast("long").alias("id"), F.try_element_at("tags", F.lit("White")).alias("white"))
    by_file = told.groupBy("source", F.floor(F.col("source_game") / 4096).alias("block")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("plies").alias("p"), F.count("white").alias("w"), F.min("source_game").alias("first"))
    after = F.coalesce(F.col("low") > F.lag("high").over(Window.partitionBy("source").orderBy("first")), F.lit(True))
    return by_file.withColumn("sorted", after).agg(F.sum("n").alias("games"), F.sum("p").alias("plies"), F.sum("w").alias("white"), F.min("sorted").alias("in_order"))


@query("db_build", "SELECT source, CASE source WHEN '1-URGENT' THEN 'replaced' WHEN '2-HIGH' THEN 'added' WHEN '3-MEDIUM' THEN 'retained' ELSE 'unchanged' END AS action, count(*) AS games, CAST(sum(plies + 1) AS BIGINT) AS positions FROM g GROUP BY source")
def db_build(s, d):
    """A database built of four sources and then updated: what happened to each, and what is stored."""
    rows = pgn.with_position_keys(pgn.game_rows(pgn.parse_games(with_pgn(raw_games(s, d, numbered=True)).select("game_id", "source", "source_game", "pgn"), "pgn")))
    rows = _staged(s, rows.select("game_id", "source", "source_game", "pgn", "white", "black", "white_key", "black_key", "played_on", "result", "mainline_plies", "pgn_bytes", "keys"), "lines")
    stored, visited = rows.drop("keys"), rows.select("game_id", "source", F.posexplode("keys").alias("ply", "position_key"))
    db = store.Database(s, _shared(s, "db"))
    old = stored.where("source <> '2-HIGH'").withColumn("pgn", F.when(F.col("source") == "1-URGENT", F.concat(F.col("pgn").cast("string"), F.lit(" ")).cast("binary")).otherwise(F.col("pgn")))
    db.build(old, visited.where("source <> '2-HIGH'"))
    acted = db.update(stored.where("source <> '3-MEDIUM'"), visited.where("source <> '3-MEDIUM'"))
    games_ = db.games().groupBy("source").agg(F.count(F.lit(1)).alias("games"))
    return acted.join(games_, "source").join(db.positions().groupBy("source").agg(F.count(F.lit(1)).alias("positions")), "source")
