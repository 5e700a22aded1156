"""Reviewing lost games: what is reviewed, whose decisions count, attempts at exercises, stored diagnoses and progress.

Board work (one game, one variation) runs in Arrow batches; everything else is columns and joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..kernel import board as B
from ..kernel import pgn as P
from ..kernel.batch import Coordinates, Replay
from .evidence import assess, attempt_verdict

MOST_BYTES, MOST_PLIES, MOST_NAME, MOST_PV, MOST_LINE, MOST_ATTEMPTS = 256 * 1024, 1024, 256, 32, 6, 100
#: Versions that an entry must agree with: of the entry, of the selection, of the evidence and of practice.
SCHEMA, SELECTION, EVIDENCE, PRACTICE = 1, 1, 1, 1


class _Refused(ValueError):
    pass


def _one_game(raw: bytes, player: str | None) -> dict:
    """A game as a review takes it: its setting, its moves, and what speaks against it behind them; raises _Refused where something does before."""
    name = (player or "").strip()
    if len(raw) > MOST_BYTES:
        raise _Refused("too_large")
    if not name or len(name.encode()) > MOST_NAME:
        raise _Refused("player_required")
    own, first, side, moves, starts, ends = {}, None, None, [], 0, 0
    easy = P.easy_game(raw)
    events = P.events(raw) if easy is None else ()
    if easy is not None:
        for tag, value in easy[0]:
            _tagged(own, tag, value)
        side, first = _setting(own, name)
        moves = [m.decode("utf-8", "replace") for m in P.easy_moves(easy[1])]
        starts = ends = 1
    fault = None
    try:
        for e in events:
            if e.kind == "game_start":
                starts += 1
                if starts > 1:
                    raise _Refused("expected_one_game")
            elif e.kind == "game_end":
                ends += 1
            elif e.kind == "tag":
                _tagged(own, *e.text.split(b"\0", 1))
            elif e.kind == "movetext_start":
                side, first = _setting(own, name)
            elif e.kind == "san" and e.depth == 0:
                moves.append(e.text.decode("utf-8", "replace"))
                if len(moves) > MOST_PLIES:
                    break
    except P.PgnError as error:
        fault = f"invalid_pgn:{error.kind}"
    except _Refused as error:
        if first is None:
            raise
        fault = str(error)
    if fault is None and (starts, ends) != (1, 1) and len(moves) <= MOST_PLIES:
        fault = "expected_one_game"
    return {"initial_fen": first, "color": side, "player_name": "".join(c.lower() if c.isascii() else c for c in name), "moves": moves, "fault": fault}


def _tagged(own: dict[bytes, str], tag: bytes, value: bytes) -> None:
    if tag in (b"White", b"Black", b"FEN", b"SetUp", b"Variant"):
        if tag in own:
            raise _Refused("invalid_pgn:duplicate_tag")
        try:
            own[tag] = P.tag_value(value).decode()
        except UnicodeDecodeError:
            raise _Refused("invalid_pgn:invalid_utf8_tag") from None


def _setting(own: dict[bytes, str], name: str) -> tuple[str, str]:
    """The player's side and the start position's FEN, from the tags."""
    fold = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip())
    if b"Variant" in own and fold(own[b"Variant"]) != "standard":
        raise _Refused("unsupported_variant")
    is_side = [tag in own and fold(own[tag]) == fold(name) for tag in (b"White", b"Black")]
    if sum(is_side) != 1:
        raise _Refused("player_missing_or_ambiguous")
    setup, fen = own.get(b"SetUp"), own.get(b"FEN")
    if setup not in (None, "0", "1") or (setup == "1" and fen is None) or (setup == "0" and fen is not None):
        raise _Refused("invalid_setup")
    try:
        return ("white" if is_side[0] else "black"), B.START_FEN if fen is None else B.Board(fen).fen()
    except B.FenError:
        raise _Refused("invalid_setup") from None


_REVIEW = "initial_fen string, color string, player_name string, uci array<string>, san array<string>, error string"


def _each(rows: DataFrame, inputs: list[str], fn, schema: str, together: bool = False) -> DataFrame:
    """Columns of `rows` and the fields that `fn` gives for the values of `inputs`, row by row or, `together`, for a batch's lists of them."""
    own = T._parse_datatype_string(schema)
    full, places = T.StructType([*rows.schema.fields, *own.fields]), [rows.columns.index(c) for c in inputs]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in places]
            got = fn(*lists) if together else [fn(*values) for values in zip(*lists)]
            new = [pa.array([g.get(f.name) for g in got], type=arrow.field(f.name).type) for f in own.fields]
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)), *new], schema=arrow)

    return rows.mapInArrow(run, full)


def parse_reviews(games: DataFrame, pgn: str = "pgn", player: str = "player") -> DataFrame:
    """Adds initial_fen, color, player_name and the mainline (uci, san) of exactly one standard game with one side the player's; else error.

    A batch's games are replayed together.
    """

    def read(raws, names):
        got: list[dict] = []
        for raw, name in zip(raws, names):
            try:
                got.append(_one_game(raw or b"", name))
            except _Refused as error:
                got.append({"error": str(error)})
        at = [i for i, g in enumerate(got) if "moves" in g]
        run = Replay.of([(got[i]["initial_fen"], got[i]["moves"][: MOST_PLIES]) for i in at])
        told: list[list[tuple[str, str]]] = [[] for _ in at]
        for ply, games_, node, own in run.steps(positions=False):
            if ply:
                for g, k in zip(games_.tolist(), node.tolist()):
                    told[g].append((own["uci"][k], own["san"][k]))
        for k, i in enumerate(at):
            g = got[i]
            # the first of: a move that can't be played, one too many, a fault behind the moves
            error = f"illegal_mainline:{int(run.done[k]) + 1}" if run.error[k] else "too_large" if len(g["moves"]) > MOST_PLIES else g["fault"]
            got[i] = {"error": error} if error else {**g, "uci": [u for u, _ in told[k]], "san": [x for _, x in told[k]]}
        return got

    return _each(games, [pgn, player], read, _REVIEW, together=True)


def decisions(reviews: DataFrame, shared_ply: int | Column) -> DataFrame:
    """game_id, ply, played_uci, played_san of the player's moves after the shared plies.

    The side to move at the start is the initial position's.
    """
    shared = F.lit(shared_ply) if isinstance(shared_ply, int) else shared_ply
    rows = reviews.where("uci IS NOT NULL").select("game_id", "color", F.split("initial_fen", " ")[1].alias("first"), shared.alias("shared"), F.posexplode(F.arrays_zip("uci", "san")).alias("at", "m"))
    white = (F.col("at") % 2 == 0) == (F.col("first") == "w")
    return rows.where((F.col("at") >= F.col("shared")) & (white == (F.col("color") == "white"))).select("game_id", (F.col("at") + 1).alias("ply"), F.col("m.uci").alias("played_uci"), F.col("m.san").alias("played_san"))


def player_moves(moves: DataFrame, shared_ply: int, player: str) -> DataFrame:
    """Moves (ply, white_key, ...) after the shared plies that the player made; White is looked at first."""
    white = F.coalesce(F.col("white_key") == C.ascii_fold(F.lit(player)), F.lit(False))
    return moves.where((F.col("ply") > shared_ply) & ((F.col("ply") % 2 == 1) == white))


def _named(fen: str | None, moves: list[str] | None, need_move: bool, most: int | None = None) -> dict:
    """Notations of moves in coordinates from a position, and the positions on the way."""
    try:
        board = B.Board(fen)
    except B.FenError as error:
        return {"error": f"invalid_fen:{error}"}
    sans, fens = [], [board.fen()]
    if need_move and not moves and board.legal_moves():
        return {"error": "missing move in nonterminal position"}
    for text in (moves or [])[:most]:
        move = next((m for m in board.legal_moves() if B.uci(m) == text), None)
        if move is None:
            return {"error": "illegal variation"}
        sans.append(board.san(*move))
        board.apply(*move)
        fens.append(board.fen())
    return {"pv_san": sans, "fens": fens}


def _named_together(fens: list, lines: list, need_move: bool, most: int | None = None) -> list[dict]:
    """What `_named` gives for the lines of a batch, played side by side; what they share is worked out once."""
    # an empty text is no position, while none at all is the start; the batch's own name for that is the empty text
    run = Coordinates.of([("-" if fen == "" else fen or "", [m or "" for m in (own or [])[:most]]) for fen, own in zip(fens, lines)])
    sans, told = run.lines()
    movable: dict[int, bool] = {}
    out = []
    for i, own in enumerate(lines):
        at = int(run.start[i])
        board = run.boards[at]
        if board is None:
            out.append(_named(fens[i], None, False))
            continue
        if need_move and not own:
            if at not in movable:
                movable[at] = bool(board.legal_moves())
            if movable[at]:
                out.append({"error": "missing move in nonterminal position"})
                continue
        out.append({"error": "illegal variation"} if run.error[i] else {"pv_san": sans[i], "fens": told[i]})
    return out


def legal_variations(rows: DataFrame, fen: str = "fen", pv: str = "pv") -> DataFrame:
    """Adds pv_san, the notation of a variation's moves, or error: a move that is not legal, or none where there is one."""
    return _each(rows, [fen, pv], lambda f, m: _named_together(f, m, True), "pv_san array<string>, error string", together=True)


def replay_lines(rows: DataFrame, fen: str = "fen", moves: str = "moves") -> DataFrame:
    """Adds fens, the position and those after at most six moves of a line, or error."""
    return _each(rows, [fen, moves], lambda f, m: _named_together(f, m, False, MOST_LINE), "fens array<string>, error string", together=True)


def playable(rows: DataFrame, fen: str = "fen", uci: str = "uci", history: str | None = None) -> DataFrame:
    """Adds fen_after of a move in coordinates, null where it is not legal, or after MOST_PLIES plies of history."""

    def play(fens, texts, *plies):
        got = _named_together(fens, [[t or ""] for t in texts], False)
        told = plies[0] if plies else [0] * len(got)
        return [{"fen_after": g["fens"][-1] if "fens" in g and (n or 0) < MOST_PLIES else None} for g, n in zip(got, told)]

    return _each(rows, [fen, uci, *([] if history is None else [history])], play, "fen_after string", together=True)


def verify_attempts(attempts: DataFrame, exercises: DataFrame, analyses: DataFrame) -> DataFrame:
    """attempt_id and verdict of attempts (attempt_id, game_id, uci) at exercises (game_id, position_fen, best_uci, engine, nodes).

    `analyses` has recorded evaluations, from the player's side, of positions (fen, engine, nodes, kind, value, bound). The best move's
    position is the reference; an attempt at another legal move needs an evaluation of its own by the same engine and budget. illegal
    needs none. What is missing or was made otherwise gives the verdict null and says so in `error`.
    """
    rows = attempts.join(exercises, "game_id", "left")
    rows = playable(playable(rows, "position_fen", "best_uci").withColumnRenamed("fen_after", "best_fen"), "position_fen", "uci").withColumnRenamed("fen_after", "own_fen")
    evaluation = lambda name: analyses.groupBy("fen", "engine", "nodes").agg(F.min(F.struct("kind", "value", "bound")).alias(name)).withColumnRenamed("fen", f"{name}_fen")
    rows = rows.join(evaluation("best"), ["best_fen", "engine", "nodes"], "left").join(evaluation("own"), ["own_fen", "engine", "nodes"], "left")
    parts = lambda name: tuple(F.col(f"{name}.{c}") for c in ("kind", "value", "bound"))
    same = F.col("uci") == F.col("best_uci")
    verdict = F.when(F.col("own_fen").isNull(), "illegal").when(same, F.when(F.col("best.kind") == "mate_against", "inconclusive").otherwise("strong")).otherwise(attempt_verdict(parts("best"), parts("own")))
    error = (
        F.when(F.length("uci") > 5, "invalid move text").when(F.col("best_uci").isNull(), "no exercise").when(F.col("own_fen").isNull(), F.lit(None))
        .when(F.col("best").isNull() | (~same & F.col("own").isNull()), "missing evidence")
    )
    return rows.select("attempt_id", F.when(error.isNull(), verdict).alias("verdict"), error.alias("error"))


def practice_entry(exercises: DataFrame, current: Column | None = None) -> DataFrame:
    """path and entry of queues of exercises (path, place, game_id, disposition, solution): the current one if it is active, the first
    active, the current one, the first."""
    active = (F.col("disposition") == "active") & (F.col("solution") == "unsolved")
    here = F.coalesce(F.col("game_id") == current, F.lit(False)) if current is not None else F.lit(False)
    tier = F.when(active & here, 0).when(active, 1).when(here, 2).otherwise(3)
    return exercises.groupBy("path").agg(F.min_by("game_id", F.struct(tier, "place")).alias("entry"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Of the answers per path (path, generation, revision, snapshot) the newest; of two of one revision the later in `seq`."""
    return snapshots.groupBy("path").agg(F.max_by("snapshot", F.struct("generation", "revision", "seq")).alias("snapshot"))


def lesson_games(games: DataFrame) -> DataFrame:
    """Games that lessons can come from: decided, with moves."""
    return games.where("mainline_plies > 0 AND result IN (1, 2)")


def pattern_key(player: Column, ply: Column, line: Column) -> Column:
    """Under what a player's progress with an opening is kept."""
    return F.concat_ws(":", F.lit("v1"), F.lower(F.trim(F.coalesce(player, F.lit("")))), F.coalesce(ply, F.lit(0)).cast("string"), F.coalesce(line, F.lit("")))


def reconciled_progress(openings: DataFrame, saved: DataFrame) -> DataFrame:
    """Progress with openings (player, ply, line, losses, review_game_ids, game_id) as it was saved under their pattern, as far as it still holds.

    Games are the opening's; reviewed and deferred ones are those saved that are among them, a reviewed one is not deferred;
    the current one stays if it is among them, else it is the first untouched, else the first. `saved` has pattern, reviewed_game_ids,
    deferred_game_ids and current_game_id.
    """
    given = F.when(F.size("review_game_ids") > 0, F.col("review_game_ids")).otherwise(F.array("game_id"))
    rows = openings.withColumns({"pattern": pattern_key(F.col("player"), F.col("ply"), F.col("line")), "game_ids": F.array_distinct(F.filter(given, lambda i: i > 0))})
    rows = rows.join(saved.select("pattern", *(F.col(c).alias(f"s_{c}") for c in ("reviewed_game_ids", "deferred_game_ids", "current_game_id"))), "pattern", "left")
    none = F.array().cast("array<bigint>")
    among = lambda c: F.filter(F.array_distinct(F.coalesce(c, none)), lambda i: F.array_contains("game_ids", i))
    rows = rows.withColumn("reviewed_game_ids", among(F.col("s_reviewed_game_ids")))
    rows = rows.withColumn("deferred_game_ids", F.array_except(among(F.col("s_deferred_game_ids")), "reviewed_game_ids"))
    untouched = F.array_except(F.array_except("game_ids", "reviewed_game_ids"), "deferred_game_ids")
    current = F.when(F.array_contains("game_ids", F.col("s_current_game_id")), F.col("s_current_game_id"))
    first = F.coalesce(current, F.get(untouched, F.lit(0)), F.get("game_ids", F.lit(0)))
    return rows.select("pattern", F.coalesce(F.nullif("line", F.lit("")), F.lit("Recurring opening losses")).alias("title"), "game_ids", "reviewed_game_ids", "deferred_game_ids", first.alias("current_game_id"), "ply", F.coalesce("losses", F.size("game_ids").cast("long")).alias("matching_losses"))


def prepared_progress(progress: DataFrame) -> DataFrame:
    """Progress to begin with: one that is done begins anew, and so do deferred games when nothing else is left."""
    done = F.size("reviewed_game_ids") == F.size("game_ids")
    none = F.array().cast("array<bigint>")
    rows = progress.withColumns({"reviewed_game_ids": F.when(done, none).otherwise(F.col("reviewed_game_ids")), "deferred_game_ids": F.when(done, none).otherwise(F.col("deferred_game_ids"))})
    left = F.size(F.array_except(F.array_except("game_ids", "reviewed_game_ids"), "deferred_game_ids")) > 0
    rows = rows.withColumn("deferred_game_ids", F.when(left, F.col("deferred_game_ids")).otherwise(none))
    available = F.array_except(F.array_except("game_ids", "reviewed_game_ids"), "deferred_game_ids")
    current = F.when(F.array_contains(available, F.col("current_game_id")), F.col("current_game_id"))
    return rows.withColumn("current_game_id", F.coalesce(current, F.get(available, F.lit(0)), F.get("game_ids", F.lit(0))))


def next_review_game(game_ids: Column, reviewed: Column, deferred: Column, current: Column) -> Column:
    """The next game to review after the current one, round the list; null if none is left."""
    available = F.array_except(F.array_except(game_ids, reviewed), deferred)
    at = F.coalesce(F.array_position(game_ids, current), F.lit(0)).cast("int")
    round_ = F.concat(F.slice(game_ids, at + 1, F.greatest(F.size(game_ids), F.lit(1))), F.slice(game_ids, 1, F.greatest(at, F.lit(0))))
    return F.get(F.array_intersect(round_, available), F.lit(0))


def coached_progress(progress: DataFrame, practice: DataFrame) -> DataFrame:
    """Progress (path, game_ids, reviewed_game_ids, deferred_game_ids) brought in line with stored practice (path, game_id, disposition, running).

    Practice decides: completed is reviewed, put off is deferred, and nothing else is either. A game without practice (disposition null) is
    not reviewed, unless the queue is still being filled.
    """
    of = lambda c: F.collect_list(F.when(c, F.col("game_id")))
    told = practice.groupBy("path").agg(
        of(F.col("disposition").isNotNull() | ~F.col("running")).alias("no_reviewed"), of(F.col("disposition").isNotNull()).alias("no_deferred"),
        of(F.col("disposition") == "completed").alias("yes_reviewed"), of(F.col("disposition") == "again_later").alias("yes_deferred"),
    )
    rows = progress.join(told, "path", "left")
    none = F.array().cast("array<bigint>")
    value = lambda c: F.coalesce(F.col(c), none)
    brought = lambda c: F.filter("game_ids", lambda i: (F.array_contains(F.col(f"{c}_game_ids"), i) & ~F.array_contains(value(f"no_{c}"), i)) | F.array_contains(value(f"yes_{c}"), i))
    return rows.withColumns({"reviewed_game_ids": brought("reviewed"), "deferred_game_ids": brought("deferred")}).select(*progress.columns)


_KEY = ("schema", "selection_version", "evidence_version", "practice_version", "game_id", "mainline_hash", "player", "player_color", "shared_ply", "engine_name", "engine_binary_hash", "nodes", "threads", "hash_mib", "multipv", "architecture")


def cache_keys(reviews: DataFrame) -> DataFrame:
    """Adds the sixteen fields of a diagnosis's key, and its digest.

    `reviews` has game_id, initial_fen, uci, color, player_name, shared_ply, engine_name, engine_binary_hash, nodes and architecture. Comments and
    variations are no part of a key; the digest is null for a key that is none.
    """
    framed = lambda c: F.concat(F.lpad(F.hex(F.octet_length(c)), 16, "0"), c)
    line = F.sha2(F.array_join(F.concat(F.array(framed(F.col("initial_fen"))), F.transform("uci", framed)), ""), 256)
    fixed = {"schema": SCHEMA, "selection_version": SELECTION, "evidence_version": EVIDENCE, "practice_version": PRACTICE, "threads": 1, "hash_mib": 16, "multipv": 1}
    named = reviews.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "game_id": F.col("game_id").cast("string"), "mainline_hash": line, "player": F.col("player_name"), "player_color": F.col("color")})
    good = (F.octet_length("game_id") > 0) & (F.octet_length("game_id") <= MOST_NAME) & (F.col("nodes") > 0)
    return named.withColumn("digest", F.when(good, F.sha2(F.to_json(F.struct(*_KEY), {"ignoreNullFields": "false"}), 256)))


def save_diagnoses(new: DataFrame, stored: DataFrame) -> DataFrame:
    """digest, action, diagnosis and practice after saving diagnoses (digest, diagnosis) to a store (digest, diagnosis, practice).

    An equal one keeps its practice (kept), another one under the same key is refused and the stored one stands (inconsistent); of
    several new ones under a key all must agree. Nothing stored is lost.
    """
    fresh = new.groupBy("digest").agg(F.min("diagnosis").alias("n"), F.max("diagnosis").alias("m"))
    both = fresh.join(stored.select("digest", F.col("diagnosis").alias("old"), "practice"), "digest", "full")
    agree = F.col("n") == F.col("m")
    action = F.when(F.col("n").isNull(), "untouched").when(~agree | (F.col("old").isNotNull() & (F.col("old") != F.col("n"))), "inconsistent").when(F.col("old").isNotNull(), "kept").otherwise("created")
    return both.select("digest", action.alias("action"), F.coalesce("old", F.when(agree, F.col("n"))).alias("diagnosis"), "practice")


def entry_faults(entries: DataFrame) -> DataFrame:
    """Adds `fault` to stored entries: the first rule that one breaks, null for a sound one. Rules on columns; boards are checked by `board_faults`."""
    c = F.col
    turned = c("ply").isNotNull()
    checks = [
        ("versions", (c("schema") != SCHEMA) | (c("selection_version") != SELECTION) | (c("evidence_version") != EVIDENCE) | (c("practice_version") != PRACTICE)),
        ("diagnosis_versions", (c("diagnosis_selection") != c("selection_version")) | (c("diagnosis_evidence") != c("evidence_version"))),
        ("nodes", c("nodes") != c("diagnosis_nodes")), ("shared_ply", c("diagnosis_shared_ply") != c("shared_ply")), ("analyzed_moves", c("analyzed_moves") > MOST_PLIES), ("inconclusive_moves", c("inconclusive_moves") > c("analyzed_moves")),
        ("engine", (c("engine").isNotNull() & (c("engine") != c("engine_name"))) | ((c("analyzed_moves") > 0) & c("engine").isNull())),
        ("attempts", (c("kept_attempts") > MOST_ATTEMPTS) | (c("total_attempts") < c("kept_attempts"))),
        ("ply", turned & ((c("ply") == 0) | (c("ply") > MOST_PLIES) | (F.size("history") != c("ply") - 1) | (c("ply") <= c("shared_ply")))),
        ("best_move", turned & (c("best_uci") == c("played_uci"))),
        ("variation", turned & (~F.get("pv", F.lit(0)).eqNullSafe(c("best_uci")) | ~F.get("pv_san", F.lit(0)).eqNullSafe(c("best_san")) | (F.size("pv") != F.size("pv_san")) | (F.size("pv") > MOST_PV))),
        ("reply", turned & ((F.size("after_pv") != F.size("after_pv_san")) | (F.size("after_pv") > MOST_PV))),
        ("loss", turned & ~_assessed_as_told()),
        ("completed", turned & (c("disposition") == "completed") & ~c("revealed") & (c("solution") == "unsolved")),
        ("practice_without_point", ~turned & (c("revealed") | (c("solution") != "unsolved") | c("disposition").isin("again_later", "skipped") | (c("total_attempts") != 0) | (c("kept_attempts") != 0))),
        ("hint", (c("solution") == "after_hint") & ~c("revealed")),
    ]
    return entries.withColumn("fault", F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in checks)))


def _assessed_as_told() -> Column:
    """Whether the recorded loss is what the recorded evaluations give."""
    verdict, kind, loss = assess(tuple(map(F.col, ("bk", "bv", "bb"))), tuple(map(F.col, ("ak", "av", "ab"))))
    return F.coalesce((verdict == "turning_point") & (kind == F.col("loss_kind")) & loss.eqNullSafe(F.col("loss")), F.lit(False))


def board_faults(entries: DataFrame) -> DataFrame:
    """Adds `board_fault` to turning points (initial_fen, history, position_fen, player_color, played_uci, played_san, after_pv, after_pv_san, pv, pv_san): what
    cannot be replayed as it is told; null if all can, or where there is no position."""

    def check(initial, history, position, color, played, played_san, after, after_san, pv, pv_san):
        if position is None:
            return {}
        start = _named(initial, history, False)
        if "error" in start:
            return {"board_fault": "history"}
        if start["fens"][-1] != position:
            return {"board_fault": "position"}
        if ("white" if position.split()[1] == "w" else "black") != color:
            return {"board_fault": "side"}
        for name, moves, sans in (("played", [played, *(after or [])], [played_san, *(after_san or [])]), ("variation", pv or [], pv_san or [])):
            if _named(position, moves, False).get("pv_san") != sans:
                return {"board_fault": name}
        return {}

    return _each(entries, ["initial_fen", "history", "position_fen", "player_color", "played_uci", "played_san", "after_pv", "after_pv_san", "pv", "pv_san"], check, "board_fault string")


def ranked_places(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds `place`, the order of a path's rows by game_id."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(path).orderBy("game_id")))
