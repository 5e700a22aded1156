"""Column expressions of the chess domain; nothing here leaves the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295
RESULT_LABELS = ("unfinished", "white_win", "black_win", "draw")
OUTCOME_MARKERS = ("*", "1-0", "0-1", "1/2-1/2")
#: Upper bounds (exclusive of the next) and names of game lengths and rating bands.
LENGTH_BUCKETS = [(0, "0"), (20, "1-20"), (40, "21-40"), (60, "41-60"), (80, "61-80"), (120, "81-120"), (160, "121-160"), (None, "161+")]
RATING_BANDS = [(999, "<1000"), *((low + 199, f"{low}-{low + 199}") for low in range(1000, 2400, 200)), (None, "2400+")]
TIME_CONTROLS = ("missing", "unknown", "unlimited", "moves_in_seconds", "sudden_death", "increment", "hourglass", "multi_stage", "invalid")
# Fixed value: the first moment of the remote archive.
ARCHIVE_START_MS = 1356998400070


def ascii_fold(c: Column) -> Column:
    """A-Z to a-z and nothing else, as names compare."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parse_u32(c: Column) -> Column:
    """ASCII digits only, up to 4294967295; else null."""
    value = F.when(c.rlike(r"\A[0-9]+\z") & (F.length(F.ltrim(c, F.lit("0"))) <= 10), F.try_to_number(F.lpad(F.ltrim(c, F.lit("0")), 10, "0"), F.lit("9999999999")).cast("bigint"))
    return F.when(value <= U32, value)


def parse_date(c: Column, dashes: bool = True) -> Column:
    """`YYYY.MM.DD` (or with dashes) of a real day of a year from 1, as yyyymmdd; else null."""
    shape = r"\A[0-9]{4}(\.[0-9]{2}\.|-[0-9]{2}-)[0-9]{2}\z" if dashes else r"\A[0-9]{4}\.[0-9]{2}\.[0-9]{2}\z"
    y, m, d = (F.when(c.rlike(shape), c.substr(a, n)).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when((y >= 1) & m.between(1, 12) & d.between(1, days), y * 10000 + m * 100 + d)


def format_date(played_on: Column) -> Column:
    return F.when(played_on.isNotNull(), F.format_string("%04d.%02d.%02d", (played_on / 10000).cast("int"), (played_on / 100).cast("int") % 100, played_on % 100))


def month_of(played_on: Column) -> Column:
    return F.floor(played_on / 100).cast("int")


def effective_date(date: Column, utc_date: Column) -> Column:
    """UTCDate stands in only where Date is absent, not where it is no date."""
    return F.coalesce(date, utc_date)


def bucket(c: Column, table: list[tuple[int | None, str]]) -> Column:
    out = None
    for high, name in table[:-1]:
        out = F.when(c <= high, name) if out is None else out.when(c <= high, name)
    return F.when(c.isNotNull(), out.otherwise(table[-1][1]))


def length_bucket(plies: Column) -> Column:
    return bucket(plies, LENGTH_BUCKETS)


def rating_band(rating: Column) -> Column:
    return bucket(rating, RATING_BANDS)


def result_label(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, RESULT_LABELS)), code)


def outcome_marker(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, OUTCOME_MARKERS)), code)


def _stage(c: Column) -> Column:
    """The kind of one time-control stage; `invalid` if it is none."""
    number = lambda i: parse_u32(F.get(F.split(c, r"[/+*]"), F.lit(i)))
    return (
        F.when(c.rlike(r"\A\*[0-9]+\z") & (number(1) > 0), "hourglass")
        .when(c.rlike(r"\A[0-9]+\+[0-9]+\z") & number(0).isNotNull() & number(1).isNotNull(), "increment")
        .when(c.rlike(r"\A[0-9]+/[0-9]+\z") & (number(0) > 0) & (number(1) > 0), "moves_in_seconds")
        .when(c.rlike(r"\A[0-9]+\z") & (number(0) > 0), "sudden_death")
        .otherwise("invalid")
    )


def time_control(c: Column) -> Column:
    stages = F.split(c, ":", -1)
    return (
        F.when(c.isNull(), "missing").when(c == "?", "unknown").when(c == "-", "unlimited")
        .when(c.contains(":"), F.when((F.size(stages) >= 2) & F.forall(stages, lambda s: _stage(s) != "invalid"), "multi_stage").otherwise("invalid"))
        .otherwise(_stage(c))
    )


def remote_game_id(site: Column) -> Column:
    """The eight characters of a game id in a lichess address; else null."""
    return F.nullif(F.regexp_extract(site, r"\Ahttps://lichess\.org/([0-9A-Za-z]{8})", 1), F.lit(""))


def id_filename(game_id: Column) -> Column:
    return F.concat(F.lower(F.hex(game_id)), F.lit(".pgn"))


def player_result(result: Column, white_key: Column, black_key: Column, player: str) -> Column:
    """win, draw, loss, unfinished or unclassified of a player; White is looked at first."""
    p = ascii_fold(F.lit(player))
    side = F.when(white_key == p, 1).when(black_key == p, 2)
    return F.when(side.isNull(), "unclassified").when(result == 0, "unfinished").when(result == 3, "draw").when(result == side, "win").otherwise("loss")


def date_to_ms(played_on: Column, end_of_day: bool = False) -> Column:
    """Unix milliseconds of the first (or last) moment of a day, not before the archive's start."""
    day = F.unix_date(F.make_date((played_on / 10000).cast("int"), (played_on / 100).cast("int") % 100, played_on % 100)).cast("bigint")
    return F.greatest(day * 86400000 + (86399999 if end_of_day else 0), F.lit(ARCHIVE_START_MS))


def trimmed_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_username(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9_-]{2,30}\z"), F.lit(False))


def github_escape(c: Column, attribute: bool = False) -> Column:
    """Workflow-command escapes of text, or of an attribute."""
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if attribute else ())):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def score_percent(wins: Column, draws: Column, games: Column) -> Column:
    return F.when(games > 0, F.floor((wins + draws / 2) / games * 100 + 0.5).cast("int"))


def record_text(wins: Column, draws: Column, losses: Column) -> Column:
    return F.concat(wins.cast("string"), F.lit("W · "), draws.cast("string"), F.lit("D · "), losses.cast("string"), F.lit("L"))


def month_label(month: Column) -> Column:
    names = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    return F.concat(F.get(names, (month % 100 - 1).cast("int")), F.lit(" ’"), F.lpad((F.floor(month / 100) % 100).cast("string"), 2, "0"))


def progress_percent(reached: Column, start: Column, end: Column) -> Column:
    share = 100.0 * (reached - start) / F.nullif((end - start).cast("double"), F.lit(0.0))
    return F.when(share.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(98.0), share)))


def move_text(numbered_sans: Column) -> Column:
    """`1. e4 e5 2. Nf3` of an array of moves in order, numbered from 1."""
    return F.array_join(F.transform(numbered_sans, lambda s, i: F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"), F.lit(". "), s)).otherwise(s)), " ")


def score_text(kind: Column, value: Column, bound: Column | None = None) -> Column:
    """Pawns to two decimals, or mate for or against you; bounds say at least or at most."""
    prefix = F.lit("") if bound is None else F.when(bound == "lower", "at least ").when(bound == "upper", "at most ").otherwise("")
    mate = F.concat(F.lit("mate "), F.when(kind == "mate_for", "for").otherwise("against"), F.lit(" you"), F.when(value != 0, F.concat(F.lit(" in "), value.cast("string"))).otherwise(""))
    return F.concat(prefix, F.when(kind == "centipawns", F.concat(F.when(value >= 0, "+").otherwise(""), F.format_string("%.2f pawns", value / 100))).otherwise(mate))


def loss_text(kind: Column, least: Column, exact: Column) -> Column:
    cp = F.concat(F.when(exact, "").otherwise("at least "), F.format_string("%.2f pawns of evaluation lost", least / 100))
    return F.when(kind == "centipawns", cp).when(kind == "allowed_mate", "allowed a forced mate").otherwise("lost a forced mate")


def choice(c: Column, table: dict[str, str]) -> Column:
    """The text that a fixed table has for a value, else an empty one."""
    out = F.lit("")
    for value, text in reversed(table.items()):
        out = F.when(c == value, text).otherwise(out)
    return out


# Labels of queue states, and feedback on attempts.
QUEUE_LABELS = {
    "unseen": "NOT ANALYZED", "analyzing": "ANALYZING", "ready": "READY TO PRACTICE", "skipped": "SKIPPED", "attempted": "ATTEMPTED", "completed": "COMPLETED ✓", "deferred": "FOR LATER",
    "unsupported": "UNSUPPORTED", "failed": "FAILED",
}
FEEDBACK = {
    "strong": "Strong move — within the accepted tolerance.", "try_again": "Try again — a stronger continuation is available.",
    "inconclusive": "The engine evidence is inconclusive at this budget. Try another move or reveal the answer.", "illegal": "That move is not legal.",
}


def queue_state(status: Column, disposition: Column, solution: Column, revealed: Column, attempts: Column) -> Column:
    """What a game of the review queue is: its practice decides where there is one (disposition not null), else its analysis."""
    tried = revealed | (solution != "unsolved") | (attempts > 0)
    return (
        F.when(disposition == "completed", "completed").when(disposition == "again_later", "deferred").when(disposition == "skipped", "skipped")
        .when(disposition.isNotNull() & tried, "attempted").when(disposition.isNotNull(), "ready").otherwise(status)
    )


def recommendation_label(points: Column, begun: Column, all_ready: Column, losses: Column) -> Column:
    """What to do next with a player's lost games: practise, look at or go on with the diagnosis, or begin it."""
    many = lambda n, one, more: F.when(n == 1, one).otherwise(more)
    return (
        F.when(points > 0, F.concat(F.lit("Practice "), points.cast("string"), F.lit(" "), many(points, "position", "positions"), F.lit(" →")))
        .when(begun & all_ready, "View diagnosis summary →").when(begun, "Continue diagnosis →")
        .otherwise(F.concat(F.lit("Diagnose "), losses.cast("string"), F.lit(" "), many(losses, "loss", "losses"), F.lit(" →")))
    )


def _cells(fen: Column) -> tuple[Column, Column]:
    """The 64 characters of a FEN's placement from a8 to h1, with dots for empty squares; and whether it has eight rows of eight."""
    rows, cells = F.split(F.split(fen, " ")[0], "/"), F.split(fen, " ")[0]
    for n in range(1, 9):
        cells = F.replace(cells, F.lit(str(n)), F.lit("." * n))
    shaped = (F.size(rows) == 8) & cells.rlike(r"\A[^/]{8}(/[^/]{8}){7}\z")
    return F.replace(cells, F.lit("/"), F.lit("")), shaped


def fen_squares(fen: Column) -> Column:
    """The 64 squares of a FEN's placement from a8 to h1, as structs of name and piece (empty where there is none); none for another shape."""
    cells, shaped = _cells(fen)
    square = lambda c, i: F.struct(F.concat(F.char(F.lit(97) + i % 8), (8 - F.floor(i / 8)).cast("string")).alias("name"), F.nullif(c, F.lit(".")).alias("piece"))
    named = F.transform(F.filter(F.split(cells, ""), lambda c: c != ""), square)
    return F.when(shaped, F.transform(named, lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["piece"], F.lit("")).alias("piece")))).otherwise(F.array().cast("array<struct<name:string,piece:string>>"))


_UCI = r"\A[a-h][1-8][a-h][1-8][qrbn]?\z"


def describe_move(fen: Column, uci: Column) -> Column:
    """`pawn from e2 to e4`, with castling, what is taken and what a pawn becomes; empty for what is no move."""
    names = F.create_map(*(F.lit(x) for pair in (("p", "pawn"), ("n", "knight"), ("b", "bishop"), ("r", "rook"), ("q", "queen"), ("k", "king")) for x in pair))
    cells, shaped = _cells(fen)
    at = lambda name: (56 - F.ascii(F.substring(name, 2, 1))) * 8 + F.ascii(name) - 96
    piece = lambda name: F.when(shaped, F.replace(F.lower(cells.substr(at(name).cast("int"), F.lit(1))), F.lit("."), F.lit("")))
    start, end, promoted = F.substring(uci, 1, 2), F.substring(uci, 3, 2), F.substring(uci, 5, 1)
    moved, taken = piece(start), F.nullif(piece(end), F.lit(""))
    castles = (moved == "k") & (F.abs(F.ascii(start) - F.ascii(end)) == 2)
    parts = (
        F.coalesce(F.try_element_at(names, moved), F.lit("piece")), F.lit(" from "), start, F.lit(" to "), end, F.when(castles, " (castling)").otherwise(""),
        F.coalesce(F.concat(F.lit(", capturing a "), F.try_element_at(names, taken)), F.lit("")), F.coalesce(F.concat(F.lit(", promote to "), F.try_element_at(names, promoted)), F.lit("")),
    )
    return F.when(F.coalesce(uci.rlike(_UCI), F.lit(False)), F.concat(*parts)).otherwise("")


def move_arrow(uci: Column, black: bool = False) -> Column:
    """x1, y1, x2, y2 of a move's arrow on a board of 800 by 800, seen from a side; null for what is no move."""
    file = lambda k: F.ascii(uci.substr(k, 1)) - 97
    rank = lambda k: F.ascii(uci.substr(k, 1)) - 49
    x = lambda k: 750 - file(k) * 100 if black else 50 + file(k) * 100
    y = lambda k: 50 + rank(k) * 100 if black else 750 - rank(k) * 100
    return F.when(uci.rlike(_UCI), F.struct(x(1).alias("x1"), y(2).alias("y1"), x(3).alias("x2"), y(4).alias("y2")))


def throughput(size: Column, seconds: Column) -> Column:
    """MiB a second; 0 where no time has passed."""
    return F.when(seconds > 0, size / 1048576 / seconds).otherwise(0.0)


def compression_ratio(packed: Column, plain: Column) -> Column:
    """Packed bytes as a share of the plain ones; 0 where there are none."""
    return F.when(plain > 0, packed / plain).otherwise(0.0)


def square_index(name: Column) -> Column:
    """a1 is 0, h8 is 63; null for what names no square."""
    return F.when(name.rlike(r"\A[a-h][1-8]\z"), (F.ascii(name.substr(2, 1)) - 49) * 8 + F.ascii(name) - 97)


def square_name(index: Column) -> Column:
    return F.when(index.between(0, 63), F.concat(F.char(97 + index % 8), (F.floor(index / 8) + 1).cast("string")))
