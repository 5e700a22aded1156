"""Reports of statistics and of checks as rows of text: for people, as JSON, as JSON lines, and as workflow annotations.

A report is one row per source, or one of a batch of sources; its text is made by column expressions where the row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

SCHEMA_VERSION = 1
HEADERS = ("Event", "Site", "Date", "Round", "White", "Black", "Result")
STATUS = ("valid", "invalid", "error")
# How a report names time controls, in its order.
_CONTROL_NAMES = {
    "sudden_death": "sudden death", "increment": "increment", "moves_in_seconds": "moves/period", "multi_stage": "multi-stage", "hourglass": "hourglass", "unknown": "unknown", "unlimited": "unlimited",
    "invalid": "invalid", "missing": "missing",
}


def _when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def statistics(games: DataFrame, *by: str) -> DataFrame:
    """Everything that a statistics report tells, in one aggregation: structs results, game_length, header_coverage, dates, ratings and
    time_controls beside bytes, games and mainline_plies.

    `games` has bytes, plies, outcome, tags and the raw dates, as `parse_games` gives them.
    """
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    raw = F.coalesce("raw_date_tag", "raw_utc_date")
    elos = [tag("WhiteElo"), tag("BlackElo")]
    rows = games.select(
        *by, "bytes", F.col("plies").cast("long").alias("p"), F.coalesce("outcome", F.lit(0)).alias("r"), raw.alias("raw"), C.parse_date(raw, dashes=False).alias("day"), *(tag(h).isNotNull().alias(f"h{i}") for i, h in enumerate(HEADERS)),
        C.length_bucket(F.col("plies")).alias("bucket"), C.time_control(tag("TimeControl")).alias("control"), *(e.alias(f"e{i}") for i, e in enumerate(elos)), *(C.parse_u32(e).alias(f"n{i}") for i, e in enumerate(elos)),
    )
    c = F.col
    both = lambda f: f(0) + f(1)
    band = lambda i: C.rating_band(c(f"n{i}"))
    numeric = both(lambda i: F.count(f"n{i}"))
    total = both(lambda i: F.coalesce(F.sum(f"n{i}"), F.lit(0)))
    return rows.groupBy(*by).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("p"), F.lit(0)).alias("mainline_plies"),
        F.struct(*(_when(c("r") == k).alias(n) for k, n in ((1, "white_wins"), (2, "black_wins"), (3, "draws"), (0, "unfinished")))).alias("results"),
        F.struct(
            F.min("p").alias("minimum_plies"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("average_plies"), F.max("p").alias("maximum_plies"), F.struct(*(_when(c("bucket") == n).alias(n) for _, n in C.LENGTH_BUCKETS)).alias("distribution"),
        ).alias("game_length"),
        F.struct(*(_when(c(f"h{i}")).alias(h.lower()) for i, h in enumerate(HEADERS))).alias("header_coverage"),
        F.struct(
            F.count("day").alias("complete"), _when(c("raw").isNotNull() & c("day").isNull()).alias("incomplete_or_invalid"), _when(c("raw").isNull()).alias("missing"),
            C.format_date(F.min("day")).alias("earliest"), C.format_date(F.max("day")).alias("latest"),
        ).alias("dates"),
        F.struct(
            numeric.alias("numeric"), both(lambda i: _when(c(f"e{i}").isNotNull() & c(f"n{i}").isNull())).alias("invalid"), both(lambda i: _when(c(f"e{i}").isNull())).alias("missing"), F.least(F.min("n0"), F.min("n1")).alias("minimum"),
            F.when(numeric > 0, total / numeric).otherwise(0.0).alias("average"), F.greatest(F.max("n0"), F.max("n1")).alias("maximum"), F.struct(*(both(lambda i, n=n: _when(band(i) == n)).alias(n) for _, n in C.RATING_BANDS)).alias("distribution"),
        ).alias("ratings"),
        F.struct(*(_when(c("control") == k).alias(k) for k in _CONTROL_NAMES)).alias("time_controls"),
    )


def _count(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def _listed(struct: str, names: dict[str, str], between: str = "=") -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{label}{between}"), F.col(f"{struct}.`{name}`").cast("string")) for name, label in names.items()))


def statistics_text(reports: DataFrame, head: list[Column], seconds: Column | None = None) -> DataFrame:
    """Adds `text`, the lines of a statistics report for people, after the lines of `head`."""
    c = F.col
    some = lambda column, told, none: F.when(column.isNotNull(), told).otherwise(none)
    covered = F.concat_ws(", ", *(F.concat(F.lit(f"{h} "), c(f"header_coverage.{h.lower()}").cast("string"), F.lit("/"), c("games").cast("string")) for h in HEADERS))
    lines = [
        *head, F.concat(F.lit("bytes: "), c("bytes").cast("string")), F.concat(F.lit("games: "), c("games").cast("string")), F.concat(F.lit("mainline plies: "), c("mainline_plies").cast("string")),
        F.concat(F.lit("results: "), _count(c("results.white_wins"), "white win"), F.lit(", "), _count(c("results.black_wins"), "black win"), F.lit(", "), _count(c("results.draws"), "draw"), F.lit(", "), c("results.unfinished").cast("string"), F.lit(" unfinished")),
        some(c("game_length.minimum_plies"), F.format_string("game length (plies): min %d, avg %.2f, max %d", "game_length.minimum_plies", "game_length.average_plies", "game_length.maximum_plies"), F.lit("game length (plies): n/a")),
        F.concat(F.lit("game-length buckets: "), _listed("game_length.distribution", {n: n for _, n in C.LENGTH_BUCKETS})), F.concat(F.lit("header coverage: "), covered),
        F.concat(
            F.lit("dates: "), some(c("dates.earliest"), F.concat(c("dates.complete").cast("string"), F.lit(" complete ("), c("dates.earliest"), F.lit(" to "), c("dates.latest"), F.lit(")")), F.lit("0 complete")),
            F.format_string(", %d incomplete/invalid, %d missing", "dates.incomplete_or_invalid", "dates.missing"),
        ),
        F.concat(
            F.lit("ratings: "), some(c("ratings.minimum"), F.format_string("%d numeric (min %d, avg %.2f, max %d)", "ratings.numeric", "ratings.minimum", "ratings.average", "ratings.maximum"), F.lit("0 numeric")),
            F.format_string(", %d invalid, %d missing", "ratings.invalid", "ratings.missing"),
        ),
        F.concat(F.lit("rating bands: "), _listed("ratings.distribution", {n: n for _, n in C.RATING_BANDS})), F.concat(F.lit("time controls: "), _listed("time_controls", _CONTROL_NAMES)),
    ]
    if seconds is not None:
        lines += [F.format_string("elapsed: %.3fs", seconds), F.format_string("throughput: %.2f MiB/s", C.throughput(c("bytes"), seconds))]
    return reports.withColumn("text", F.concat(F.concat_ws("\n", *lines), F.lit("\n")))


def source_texts(reports: DataFrame, status: Column, seconds: Column | None = None) -> DataFrame:
    """Statistics reports of sources for people."""
    return statistics_text(reports, [F.concat(F.lit("stats: "), status), F.concat(F.lit("source: "), F.col("source"))], seconds)


def batch_text(report: DataFrame, inputs: DataFrame, seconds: Column | None = None) -> DataFrame:
    """The statistics report of a whole batch for people; `inputs` has source and status (0, 1, 2)."""
    c = lambda k: F.count_if(F.col("status") == k)
    told = inputs.agg(F.count(F.lit(1)).alias("n_inputs"), c(0).alias("n_valid"), c(1).alias("n_invalid"), c(2).alias("n_errors"), F.coalesce(F.max("status"), F.lit(0)).alias("worst"))
    head = [
        F.concat(F.lit("stats: "), F.get(F.array(*map(F.lit, STATUS)), F.col("worst"))), F.concat(F.lit("inputs: "), F.col("n_inputs").cast("string")),
        F.format_string("input status: %d valid, %d invalid, %d errors", "n_valid", "n_invalid", "n_errors"),
    ]
    return statistics_text(report.crossJoin(told), head, seconds)  # one row each


def as_json(reports: DataFrame, *keys: str) -> DataFrame:
    """The reports as JSON, one object a row, without fields that are null; `keys` stay as columns too."""
    fields = [c for c in reports.columns if c != "text"]
    return reports.select(*keys, F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *fields)).alias("json"))


def doctor_reports(diagnostics: DataFrame, most: int = 100, mode: str = "semantic") -> DataFrame:
    """One row per source: status, mode, games, moves, diagnostic_count, error_limit_reached and up to `most` diagnostics in order."""
    bad = F.col("category").isNotNull()
    worst = F.max(F.when(F.col("category") == "input", 2).when(bad, 1).otherwise(0))
    totals = diagnostics.groupBy("source").agg(
        F.get(F.array(*map(F.lit, STATUS)), worst).alias("status"), F.lit(mode).alias("mode"), F.count_if(F.col("game").isNotNull() & ~bad).alias("games"), F.coalesce(F.sum("moves"), F.lit(0)).alias("moves"),
        F.least(F.count_if(bad), F.lit(most)).alias("diagnostic_count"), (F.count_if(bad) > most).alias("error_limit_reached"),
    )
    listed = first_diagnostics(diagnostics, most)
    empty = F.array().cast(listed.schema["diagnostics"].dataType)
    return totals.join(listed, "source", "left").withColumn("diagnostics", F.coalesce("diagnostics", empty))


def first_diagnostics(diagnostics: DataFrame, most: int = 100) -> DataFrame:
    """source and its first `most` diagnostics in order, of sources with any: all that annotations need, in one pass over the games."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.coalesce("game", F.lit(0))))
    first = diagnostics.where("category IS NOT NULL").withColumn("k", place).where(F.col("k") <= most)
    fault = F.struct("game", "ply", "category", "byte", "line", "column", "message", "context", "excerpt", F.to_json("headers").alias("headers"))
    return first.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", fault.alias("d")))), lambda x: x["d"]).alias("diagnostics"))


def _place(d: Column) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("game "), d["game"].cast("string")), F.concat(F.lit("ply "), d["ply"].cast("string")))


def _message(d: Column) -> Column:
    place = _place(d)
    return F.concat(F.when(place != "", F.concat(place, F.lit(": "))).otherwise(""), d["message"], F.coalesce(F.concat(F.lit(" ("), d["context"], F.lit(")")), F.lit("")))


def doctor_text(reports: DataFrame, quiet: bool = False) -> DataFrame:
    """Adds `text` and `stream` (stdout of sound sources, stderr of others) of check reports for people; with `quiet` sound ones say nothing."""
    c = F.col
    sound = c("status") == "valid"
    good = F.concat_ws("\n", F.concat(F.lit("valid: "), c("source")), F.concat(F.lit("mode: "), c("mode")), F.format_string("games: %d", "games"), F.format_string("moves: %d", "moves"))
    where = lambda d: F.concat_ws(":", F.coalesce(F.concat(F.lit("line "), d["line"].cast("string")), F.lit(None)), d["column"].cast("string"))
    one = lambda d: F.concat_ws("\n", F.concat(d["category"], F.lit(": "), _message(d)), F.nullif(F.concat(F.lit("  at "), where(d)), F.lit("  at ")), F.concat(F.lit("  | "), d["excerpt"]))
    bad = F.concat_ws(
        "\n", F.concat(c("status"), F.lit(": "), c("source")), F.array_join(F.transform("diagnostics", one), "\n\n"), F.when(c("diagnostic_count") > 1, F.format_string("diagnostics: %d", "diagnostic_count")),
        F.when(c("error_limit_reached"), "stopped after reaching the error limit"), F.format_string("processed: %d complete games, %d moves", "games", "moves"),
    )
    text = F.when(sound, F.lit("") if quiet else F.concat(good, F.lit("\n"))).otherwise(F.concat(bad, F.lit("\n")))
    return reports.withColumns({"text": text, "stream": F.when(sound, "stdout").otherwise("stderr")})


def doctor_json_lines(reports: DataFrame) -> DataFrame:
    """source, k and line: every diagnostic as a JSON object, then its source's summary."""
    rows = reports.select("*", F.posexplode_outer("diagnostics").alias("k", "d"))
    version = F.lit(SCHEMA_VERSION).alias("schema_version")
    each = rows.where("d IS NOT NULL").select("source", "k", F.to_json(F.struct(version, F.lit("diagnostic").alias("record"), "source", F.col("d").alias("diagnostic"))).alias("line"))
    summary = F.struct(version, F.lit("summary").alias("record"), "status", "source", "mode", "games", "moves", "diagnostic_count", "error_limit_reached")
    return each.unionByName(reports.select("source", F.size("diagnostics").alias("k"), F.to_json(summary).alias("line")))


def doctor_annotations(reports: DataFrame) -> DataFrame:
    """source, k and line: a workflow command for every diagnostic."""
    rows = reports.select("source", F.posexplode("diagnostics").alias("k", "d"))
    d, c = F.col("d"), F.col("source")
    at = F.concat(F.lit("file="), C.github_escape(c, True), F.lit(","), F.coalesce(F.concat(F.lit("line="), d["line"].cast("string"), F.lit(","), F.coalesce(F.concat(F.lit("col="), d["column"].cast("string"), F.lit(",")), F.lit(""))), F.lit("")))
    title = C.github_escape(F.concat(F.lit("Doctor: "), F.replace(d["category"], F.lit("_"), F.lit(" "))), True)
    return rows.select("source", "k", F.concat(F.lit("::error "), F.when(c == "stdin", "").otherwise(at), F.lit("title="), title, F.lit("::"), C.github_escape(_message(d))).alias("line"))


def doctor_summary(reports: DataFrame) -> DataFrame:
    """The last line of annotated output: what all sources come to."""
    rank = F.max(F.array_position(F.array(*map(F.lit, STATUS)), F.col("status")))
    total = reports.agg(
        F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), rank.cast("int").alias("rank"), F.sum("diagnostic_count").alias("d"), F.sum("games").alias("g"), F.sum("moves").alias("m"), F.coalesce(F.bool_or("error_limit_reached"), F.lit(False)).alias("limit"),
    )
    name = F.when(F.col("n") == 1, F.translate("source", "\r\n", "  ")).otherwise(_count(F.col("n"), "input"))
    c = F.col
    return total.select(
        F.concat(
            F.lit("Doctor: "), F.get(F.array(*map(F.lit, STATUS)), c("rank") - 1), F.lit(" - "), name, F.lit("; "), _count(c("d"), "diagnostic"), F.lit(", "), _count(c("g"), "complete game"), F.lit(", "), _count(c("m"), "move"),
            F.when(c("limit"), "; error limit reached").otherwise(""),
        ).alias("line")
    )


def sync_text(summary: DataFrame) -> DataFrame:
    """Adds `text` to a sync's summary (received, created, updated, unchanged, unfinished)."""
    return summary.withColumn("text", F.format_string("received: %d\ncreated: %d\nupdated: %d\nunchanged: %d\n", "received", "created", "updated", "unchanged"))


def info_text(info: DataFrame) -> DataFrame:
    """Adds `text` to a database's totals."""
    day = lambda c: F.coalesce(C.format_date(F.col(c)), F.lit("n/a"))
    lines = [F.format_string("games: %d", "games"), F.format_string("sources: %d (%d fingerprinted)", "sources", "fingerprinted"), F.format_string("positions: %d", "positions"), F.format_string("mainline plies: %d", "plies"),
             F.concat(F.lit("dates: "), day("earliest"), F.lit(" to "), day("latest")), F.format_string("results: %d white, %d black, %d draws, %d unfinished", "white_wins", "black_wins", "draws", "unfinished")]
    return info.withColumn("text", F.concat(F.concat_ws("\n", *lines), F.lit("\n")))
