"""Exploring a library: opponents, months, openings and positions of a player or of all games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

TOP_PLAYERS, MONTHS, TOP_POSITIONS, REVIEW_GAMES = 8, 12, 6, 6


def _is_white(player: str) -> Column:
    return F.col("white_key") == C.ascii_fold(F.lit(player))


def _is_black(player: str) -> Column:
    p = C.ascii_fold(F.lit(player))
    return (F.col("black_key") == p) & (F.col("white_key").isNull() | (F.col("white_key") != p))


def scoped(games: DataFrame, player: str | None) -> DataFrame:
    """The games of a player, White looked at first; all games without one."""
    return games if player is None else games.where(_is_white(player) | _is_black(player))


def _outcome(player: str | None) -> Column:
    """1 win, 2 loss, 3 draw, 0 unfinished; without a player, as White."""
    if player is None:
        return F.col("result")
    return F.when(_is_white(player), F.col("result")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 1, 3))), F.col("result")))


def _tally(outcome: Column) -> list[Column]:
    return [F.count_if(outcome == code).alias(n) for code, n in ((1, "wins"), (3, "draws"), (2, "losses"), (0, "unfinished"))]


def count(games: DataFrame, player: str | None = None) -> DataFrame:
    return scoped(games, player).agg(F.count(F.lit(1)).alias("games"))


def players(games: DataFrame, player: str | None = None, top: int = TOP_PLAYERS) -> DataFrame:
    """The players with the most games, or a player's most frequent opponents with the player's results."""
    own = lambda name, key, codes: F.struct(F.col(name).alias("name"), F.col(key).alias("name_key"), F.get(F.array(*map(F.lit, codes)), F.col("result")).alias("outcome"))
    white, black = (0, 1, 2, 3), (0, 2, 1, 3)
    if player is None:
        sides = F.array(own("white", "white_key", white), own("black", "black_key", black))
    else:
        sides = F.array(F.when(_is_white(player), own("black", "black_key", white)), F.when(_is_black(player), own("white", "white_key", black)))
    rows = games.select(F.explode(sides).alias("s")).where("s IS NOT NULL").select("s.*").where("name_key IS NOT NULL")
    totals = rows.groupBy("name_key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("games"), *_tally(F.col("outcome")))
    return totals.orderBy(F.desc("games"), "name_key").limit(top)


def timeline(games: DataFrame, player: str | None = None, months: int = MONTHS) -> DataFrame:
    """The newest months with their results, oldest first.

    Of a player's games against the player itself, a decided one counts as win and as loss.
    """
    rows = scoped(games, player).where("played_on IS NOT NULL").withColumn("month", C.month_of(F.col("played_on")))
    if player is None:
        tally = _tally(F.col("result"))
    else:
        p = C.ascii_fold(F.lit(player))
        w, b = F.coalesce(F.col("white_key") == p, F.lit(False)), F.coalesce(F.col("black_key") == p, F.lit(False))
        r = F.col("result")
        tally = [F.count_if((w & (r == 1)) | (b & (r == 2))).alias("wins"), F.count_if(r == 3).alias("draws"), F.count_if((w & (r == 2)) | (b & (r == 1))).alias("losses"), F.count_if(r == 0).alias("unfinished")]
    newest = rows.groupBy("month").agg(F.count(F.lit(1)).alias("games"), *tally).orderBy(F.desc("month")).limit(months)
    return newest.orderBy("month")


def visits(positions: DataFrame, games: DataFrame, low: int, high: int, player: str | None = None) -> DataFrame:
    """One row per position and game: the first ply within a range, with what the game is about."""
    first = positions.where(F.col("ply").between(low, high)).groupBy("position_key", "game_id").agg(F.min("ply").alias("ply"))
    return first.join(scoped(games, player), "game_id").withColumn("outcome", _outcome(player))


def common_positions(visited: DataFrame, repeated_only: bool = False, top: int | None = TOP_POSITIONS) -> DataFrame:
    """The positions that most games reach, with results; all of them without `top`."""
    return chosen_positions(visited.groupBy("position_key").agg(F.count(F.lit(1)).alias("games"), *_tally(F.col("outcome"))), repeated_only, top)


def line_results(games: DataFrame, player: str | None = None) -> DataFrame:
    """Every different line (fen, variant, moves) of the games, with how many of a player's games, or of all, play it and their results."""
    own = F.lit(True) if player is None else _is_white(player) | _is_black(player)
    outcome = F.when(own, _outcome(player))
    return games.groupBy("fen", "variant", "moves").agg(F.count_if(own).alias("games"), *_tally(outcome))


def position_results(lines: DataFrame, low: int, high: int) -> DataFrame:
    """As the totals of `visits` by position, from `line_results` with keys: a game counts once however often it has a position within the range."""
    totals = [c for c in lines.columns if c in ("games", "wins", "draws", "losses", "unfinished")]
    own = F.array_distinct(F.slice("keys", low + 1, high - low + 1))
    rows = lines.where("games > 0").select(*totals, F.explode(own).alias("position_key"))
    return rows.groupBy("position_key").agg(*(F.sum(c).alias(c) for c in totals))


def chosen_positions(totals: DataFrame, repeated_only: bool = False, top: int | None = TOP_POSITIONS) -> DataFrame:
    """Of positions with results those that most games reach; all of them without `top`."""
    chosen = totals.where("games > 1") if repeated_only else totals
    return chosen if top is None else chosen.orderBy(F.desc("games"), "position_key").limit(top)


def samples(visited: DataFrame, player: str | None = None) -> DataFrame:
    """A game to show for each position: a player's losses first, then the newest, the earliest ply, the least id."""
    order = [F.asc("ply"), F.asc("game_id")]
    if player is not None:
        order = [F.desc(F.coalesce(F.col("outcome") == 2, F.lit(False))), F.col("played_on").isNull().asc(), F.desc("played_on"), *order]
    ranked = visited.withColumn("k", F.row_number().over(Window.partitionBy("position_key").orderBy(*order)))
    return ranked.where("k = 1").select("position_key", "game_id", "ply")


def review_games(visited: DataFrame, top: int = REVIEW_GAMES) -> DataFrame:
    """A player's lost games through each position, newest first, games without a date last."""
    order = Window.partitionBy("position_key").orderBy(F.col("played_on").isNull().asc(), F.desc("played_on"), F.desc("game_id"))
    return visited.where("outcome = 2").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("position_key", "place", "game_id")


def with_lines(sampled: DataFrame, moves: DataFrame, most: int = 8) -> DataFrame:
    """Adds `line`, the numbered moves that lead to the sampled position, `most` plies of them."""
    m = moves.select(F.col("game_id").alias("g"), F.col("ply").alias("at"), "san")
    near = (sampled["game_id"] == m["g"]) & (m["at"] <= F.least(sampled["ply"], F.lit(most)))
    lines = sampled.join(m, near, "left").groupBy(*sampled.columns).agg(F.sort_array(F.collect_list(F.struct("at", "san"))).alias("m"))
    return lines.withColumn("line", C.move_text(F.transform("m", lambda x: x["san"]))).drop("m")


def focus_opening(openings: DataFrame, least: int = 4) -> DataFrame:
    """The opening to work on: the lowest score with a loss and at least `least` completed games."""
    done = F.col("wins") + F.col("draws") + F.col("losses")
    rows = openings.withColumn("completed", done).where((F.col("completed") >= least) & (F.col("losses") > 0))
    rows = rows.withColumn("score", C.score_percent(F.col("wins"), F.col("draws"), F.col("completed")))
    return rows.orderBy((2 * F.col("wins") + F.col("draws")) / F.col("completed"), F.desc("losses"), F.desc("completed"), "line").limit(1)
