"""Rules over recorded engine evidence: scores, turning points, attempts, review summaries.

Evaluations are columns kind (centipawns, mate_for, mate_against), value and bound (exact, lower, upper),
from the player's point of view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rules.
MINIMUM_LOSS_CP, ALREADY_LOST_CP, ACCEPTANCE_CP = 100, -300, 30


def flipped(kind: Column, value: Column, bound: Column) -> tuple[Column, Column, Column]:
    """The same evaluation from the other side."""
    other = F.when(kind == "mate_for", "mate_against").when(kind == "mate_against", "mate_for").otherwise(kind)
    turned = F.when(bound == "lower", "upper").when(bound == "upper", "lower").otherwise(bound)
    return other, F.when(kind == "centipawns", -value).otherwise(value), turned


def assess(before: tuple[Column, Column, Column], after: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """(verdict, loss kind, least loss): turning_point, no_turning_point or inconclusive."""
    (bk, bv, bb), (ak, av, ab) = before, after
    cp, lost = bk == "centipawns", bv < ALREADY_LOST_CP
    settled = ((bk == "mate_against") & (bb == "exact")) | (cp & lost & bb.isin("exact", "upper"))
    eligible = (cp & ~lost & bb.isin("exact", "lower")) | ((bk == "mate_for") & (bb == "exact"))
    drop = bv.cast("bigint") - av.cast("bigint")
    compared = cp & (ak == "centipawns") & ab.isin("exact", "upper")
    exact = (bb == "exact") & (ab == "exact")
    loss = (
        F.when(settled | ~eligible, None).when((ak == "mate_against") & (ab == "exact"), "allowed_mate")
        .when((bk == "mate_for") & (ak == "centipawns") & (ab == "exact"), "lost_forced_mate")
        .when(compared & (drop >= MINIMUM_LOSS_CP), "centipawns")
    )
    verdict = (
        F.when(settled, "no_turning_point").when(~eligible, "inconclusive").when(loss.isNotNull(), "turning_point")
        .when((ak == "mate_for") & (ab == "exact"), "no_turning_point").when(compared & exact, "no_turning_point").otherwise("inconclusive")
    )
    return verdict, loss, F.when(loss == "centipawns", drop)


def attempt_verdict(best: tuple[Column, Column, Column], tried: tuple[Column, Column, Column]) -> Column:
    """strong, try_again or inconclusive for a move that was tried instead of the best."""
    (bk, bv, bb), (tk, tv, tb) = best, tried
    cp = (bk == "centipawns") & (tk == "centipawns")
    loss = bv.cast("bigint") - tv.cast("bigint")
    exact = (bb == "exact") & (tb == "exact")
    return (
        F.when(cp & bb.isin("exact", "upper") & tb.isin("exact", "lower") & (loss <= ACCEPTANCE_CP), "strong")
        .when(cp & bb.isin("exact", "lower") & tb.isin("exact", "upper") & (loss > ACCEPTANCE_CP), "try_again")
        .when(cp, "inconclusive")
        .when(bk.isin("centipawns", "mate_for") & (tk == "mate_for") & exact, "strong")
        .when((((bk == "mate_for") & tk.isin("centipawns", "mate_against")) | ((bk == "centipawns") & (tk == "mate_against"))) & exact, "try_again")
        .otherwise("inconclusive")
    )


def diagnose(decisions: DataFrame, nodes: int | None = None) -> DataFrame:
    """The earliest turning point of each game after its shared plies.

    `decisions` has game_id, ply, verdict, played_uci, best_uci, loss_kind and loss. A move that was the engine's
    own choice is inconclusive. Counts go up to the turning point, or over all decisions. With `nodes`, decisions also have engine_before,
    engine_after, nodes_before, nodes_after and pv_first, and a game has `error` if what was analysed up to its end is not of one engine at
    this budget, or a turning point lacks its best move; the game then has no result.
    """
    c = F.col
    own = decisions.withColumn("told", c("verdict")).withColumn("verdict", F.when((c("verdict") == "turning_point") & c("played_uci").eqNullSafe(c("best_uci")), "inconclusive").otherwise(c("verdict")))
    if nodes is None:
        own = own.withColumn("odd", F.lit(False))
    else:
        whole = F.coalesce((c("nodes_before") == nodes) & (c("nodes_after") == nodes) & (c("engine_before") != "") & (c("engine_before") == c("engine_after")), F.lit(False))
        lacks = (c("told") == "turning_point") & (c("best_uci").isNull() | ~c("pv_first").eqNullSafe(c("best_uci")))
        other = c("engine_before") != F.min_by("engine_before", "ply").over(Window.partitionBy("game_id"))
        own = own.withColumn("odd", ~whole | lacks | F.coalesce(other, F.lit(False)))
    first = own.groupBy("game_id").agg(F.min(F.when(c("verdict") == "turning_point", c("ply"))).alias("turn"), F.min(F.when(c("odd"), c("ply"))).alias("odd_at"))
    seen = own.join(first, "game_id").where("turn IS NULL OR ply <= turn")
    good = c("odd_at").isNull() | F.coalesce(c("odd_at") > c("turn"), F.lit(False))
    told = seen.withColumn("good", good).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("analyzed_moves"), F.count_if(c("verdict") == "inconclusive").alias("inconclusive_moves"), F.min("turn").alias("turning_ply"),
        F.max(F.when(c("ply") == c("turn"), c("loss_kind"))).alias("loss_kind"), F.max(F.when(c("ply") == c("turn"), c("loss"))).alias("loss"), F.min("good").alias("good"),
    )
    results = ("analyzed_moves", "inconclusive_moves", "turning_ply", "loss_kind", "loss")
    return told.select("game_id", *(F.when(c("good"), c(n)).alias(n) for n in results), F.when(~c("good"), "inconsistent_evidence").alias("error"))


def review_summary(records: DataFrame) -> DataFrame:
    """One row over reviewed games with move_number, loss_kind, loss, exact, inconclusive_moves, solution, revealed and disposition."""
    turned = F.col("loss_kind").isNotNull()
    cp = F.when(F.col("loss_kind") == "centipawns", F.col("loss"))
    done = F.col("disposition") == "completed"
    return records.agg(
        F.count(F.lit(1)).alias("games_analyzed"), F.count_if(turned).alias("turning_points"), F.count_if(~turned).alias("no_clear_turning_point"),
        F.sum("inconclusive_moves").alias("inconclusive_moves"), F.min(F.when(turned, F.col("move_number"))).alias("first_move"), F.max(F.when(turned, F.col("move_number"))).alias("last_move"),
        F.count(cp).alias("losses"), F.avg(cp).alias("mean_cp"), F.percentile(cp, F.lit(0.5)).alias("median_cp"), F.coalesce(F.bool_or(~F.col("exact") & cp.isNotNull()), F.lit(False)).alias("minimum_only"),
        F.count_if(F.col("loss_kind") == "allowed_mate").alias("allowed_mates"), F.count_if(F.col("loss_kind") == "lost_forced_mate").alias("lost_forced_mates"),
        F.count_if(F.col("solution") == "without_reveal").alias("solved_without_reveal"), F.count_if(F.col("solution") == "after_hint").alias("solved_after_hint"),
        F.count_if(F.col("revealed") & done & (F.col("solution") != "without_reveal")).alias("completed_after_reveal"),
        F.count_if(F.col("disposition") == "again_later").alias("practice_again_later"), F.count_if(F.col("disposition") == "skipped").alias("skipped"),
    )


def repeated_positions(points: DataFrame) -> DataFrame:
    """Positions that several games turned at, and moves that several of those games chose, each with its games and first notation.

    `points` has position, game_id, played_uci and played_san; the first notation is that of the least game_id.
    """
    moves = points.groupBy("position", "played_uci").agg(F.count(F.lit(1)).alias("n"), F.min_by("played_san", "game_id").alias("san"))
    return (
        moves.groupBy("position").agg(F.sum("n").alias("games"), F.sort_array(F.filter(F.collect_list(F.struct("played_uci", "san", "n")), lambda x: x["n"] > 1)).alias("repeated"))
        .where("games > 1").select("position", "games", F.array_join(F.transform("repeated", lambda x: F.concat(x["played_uci"], F.lit("="), x["san"], F.lit(":"), x["n"].cast("string"))), ",").alias("repeated_choices"))
    )


def lesson_ranking(points: DataFrame) -> DataFrame:
    """Points by recurrence, consequence, confidence and recency; active ones first, else those for later, else the unskipped.

    Active is what is not solved, not revealed and not put away.
    """
    same = Window.partitionBy("position", "played_uci")
    cp = F.col("loss_kind") == "centipawns"
    consequence = F.when(cp, F.least(F.col("loss"), F.lit(1000)) / 100).otherwise(12)
    confidence = F.when(~cp | F.col("exact"), 1).otherwise(0)
    active = (F.col("disposition") == "active") & (F.col("solution") == "unsolved") & ~F.col("revealed")
    tier = F.when(active, 0).when(F.col("disposition") == "again_later", 1).when(F.col("disposition") != "skipped", 2)
    rows = points.withColumn("score", F.count(F.lit(1)).over(same) * 4 + consequence + confidence - F.col("recency") * 0.25).withColumn("tier", tier).where("tier IS NOT NULL")
    best = rows.agg(F.min("tier").alias("t"))
    # if all are finished, those of every tier but the skipped stand
    return rows.join(F.broadcast(best), F.col("tier") == F.col("t")).select("game_id", "score", "tier")  # one row


_MOST_EVIDENCE, _MOST_PV, _MOST_LINE = 128, 32, 65_536
_MOVE = r"\A[a-h][1-8][a-h][1-8][qrbn]?\z"


def uci_info(lines: DataFrame) -> DataFrame:
    """Engine log lines (search, seq, line) to evaluations: search, seq, depth, kind, value, bound, pv and error.

    Secondary variations, lines without a score and `info string` give nothing; a line that breaks the protocol gives a row
    with what is wrong.
    """
    rows = lines.withColumn("w", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
    after = lambda name, k: F.when(F.array_contains("w", name), F.get("w", F.array_position("w", F.lit(name)).cast("int") - 1 + k))
    multi = after("multipv", 1)
    has = lambda name: F.array_contains("w", name)
    told = (F.get("w", F.lit(0)) == "info") & ~F.coalesce(F.get("w", F.lit(1)) == "string", F.lit(False)) & (~has("multipv") | F.coalesce(multi == "1", F.lit(False))) & has("score")
    number = lambda c, least: F.when(c.rlike(r"\A[+-]?[0-9]{1,10}\z"), c.cast("bigint")).cast("bigint")
    value = number(after("score", 2), 0)
    value = F.when((value > -2147483648) & (value <= 2147483647), value.cast("int"))
    kind, depth = after("score", 1), F.when(after("depth", 1).rlike(r"\A\+?[0-9]{1,10}\z"), after("depth", 1).cast("bigint"))
    pv = F.when(has("pv"), F.slice("w", F.array_position("w", F.lit("pv")).cast("int") + 1, F.lit(_MOST_PV))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"long": F.octet_length("line") > _MOST_LINE, "told": told}).where("long OR told")
    error = (
        F.when(F.col("long"), "oversized line").when(value.isNull(), "invalid score").when(~F.coalesce(kind.isin("cp", "mate"), F.lit(False)), "invalid score type")
        .when(has("lowerbound") & has("upperbound"), "conflicting score bounds").when(has("depth") & depth.isNull(), "invalid depth")
        .when(F.exists(pv, lambda m: ~m.rlike(_MOVE)), "invalid variation")
    )
    mate = kind == "mate"
    return rows.select(
        "search", "seq", depth.cast("int").alias("depth"), F.when(~mate, "centipawns").when(value > 0, "mate_for").otherwise("mate_against").alias("kind"), F.when(mate, F.abs(value)).otherwise(value).alias("value"),
        F.when(has("lowerbound"), "lower").when(has("upperbound"), "upper").otherwise("exact").alias("bound"), pv.alias("pv"), error.alias("error"),
    )


def best_evidence(lines: DataFrame) -> DataFrame:
    """search, best, seq, depth, kind, value, bound, pv, score_source and error of each search that ended with a best move.

    The evidence is the latest line that begins with the best move (without a move for a finished game). If that is only
    a bound, the latest exact line stands in, if it has the same move and is of the iteration before. Of a search's lines the last 128 count.
    """
    best = lines.where(F.col("line").startswith("bestmove ")).groupBy("search").agg(F.min_by("line", "seq").alias("line"), F.min("seq").alias("ended"))
    word = F.get(F.split(F.trim(F.regexp_replace(F.col("line").substr(F.lit(10), F.length("line")), r"\s+", " ")), " "), F.lit(0))
    best = best.select("search", "ended", F.when(~word.isin("(none)", "0000"), word).alias("best"), F.when(~word.isin("(none)", "0000") & ~word.rlike(_MOVE), "invalid bestmove").alias("bad"))
    info = uci_info(lines).join(best, "search").where("seq < ended")
    info = info.withColumn("k", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("seq")))).where(F.col("k") <= _MOST_EVIDENCE)
    fields = F.struct("seq", "depth", "kind", "value", "bound", "pv")
    own = F.get("pv", F.lit(0)).eqNullSafe(F.col("best"))
    found = info.groupBy("search").agg(
        F.max_by(F.when(own, fields), F.when(own, F.col("seq"))).alias("last"), F.max_by(F.when(F.col("bound") == "exact", fields), F.when(F.col("bound") == "exact", F.col("seq"))).alias("exact"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("broken"),
    )
    rows = best.join(found, "search", "left")
    stands_in = (F.col("last.bound") != "exact") & F.get("exact.pv", F.lit(0)).eqNullSafe(F.col("best")) & (F.col("exact.depth") + 1 == F.col("last.depth"))
    stands_in = F.coalesce(stands_in, F.lit(False))
    chosen = F.when(stands_in, F.col("exact")).otherwise(F.col("last"))
    error = F.coalesce("broken", "bad", F.when(F.col("last").isNull(), "missing score for bestmove"))
    return rows.select("search", "best", chosen.alias("e"), F.when(stands_in, "previous_completed_iteration").otherwise("latest_report").alias("score_source"), error.alias("error")).select("search", "best", "e.*", "score_source", "error")


_STATE = "struct<total:bigint,kept:int,solution:string,revealed:boolean,disposition:string>"


def practice_state(actions: DataFrame, most: int = 100) -> DataFrame:
    """Practice per exercise from its actions in order (game_id, seq, action, verdict), folded one by one.

    `attempt` counts (all of them, `most` are kept); the first strong one settles the solution, after_hint if the answer had been
    revealed and else without_reveal; a strong attempt completes the exercise, any other makes it active. `reveal` and `done`
    complete it, `later` puts it off, `skip` skips it, `replay` makes it active again.
    """
    def step(s: Column, x: Column) -> Column:
        a, strong = x["action"], F.coalesce(x["verdict"] == "strong", F.lit(False))
        attempt = a == "attempt"
        solution = F.when(attempt & strong & (s["solution"] == "unsolved"), F.when(s["revealed"], "after_hint").otherwise("without_reveal")).otherwise(s["solution"])
        disposition = (
            F.when(attempt, F.when(strong, "completed").otherwise("active")).when(a.isin("reveal", "done"), "completed").when(a == "later", "again_later").when(a == "skip", "skipped")
            .when(a == "replay", "active").otherwise(s["disposition"])
        )
        return F.struct(
            (s["total"] + attempt.cast("bigint")).alias("total"), F.least(s["kept"] + attempt.cast("int"), F.lit(most)).alias("kept"), solution.alias("solution"),
            (s["revealed"] | (a == "reveal")).alias("revealed"), disposition.alias("disposition"),
        ).cast(_STATE)

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("kept"), F.lit("unsolved").alias("solution"), F.lit(False).alias("revealed"), F.lit("active").alias("disposition")).cast(_STATE)
    ordered = actions.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("seq", "action", "verdict"))).alias("a"))
    state = ordered.select("game_id", F.aggregate("a", start, step).alias("s"))
    return state.select("game_id", F.col("s.total").alias("total_attempts"), F.col("s.kept").alias("kept_attempts"), "s.solution", "s.revealed", "s.disposition")
