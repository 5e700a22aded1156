"""A user's collection: what to ask an archive for, what to do with its answers, and when the cursor moves.

A collection is a folder with the state of its syncs (`_state=N`, written exclusively, one after the other) and its games
(`GameTable`). The cursor moves only when a stream has been taken whole; a preview never moves it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.store import Database
from ..sources import pgn
from ..sources.publish import States
from . import sync

STATE_SCHEMA, SOURCE, PREVIEW_GAMES = 1, "lichess", 24
_GAME_ID = r"\A[0-9A-Za-z]{8}\z"


class UnexpectedGame(ValueError):
    """An archive's answer for one game is another game, or not one."""


def check_state(state: dict, username: str) -> dict:
    """The state, if it is a user's; names compare without regard to ASCII case."""
    fold = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    if state.get("schema_version") != STATE_SCHEMA:
        raise ValueError(f"unsupported sync schema version {state.get('schema_version')}")
    if state.get("source") != SOURCE:
        raise ValueError("the folder is of another archive")
    if fold(state["username"]) != fold(username):
        raise ValueError(f"the folder belongs to {state['username']}, not {username}")
    for game_id in state["unfinished_game_ids"]:
        if not (len(game_id) == 8 and game_id.isascii() and game_id.isalnum()):
            raise ValueError(f"invalid unfinished game id {game_id}")
    return state


class Collection:
    """The state and the games of a user's syncs in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.games = sync.GameTable(spark, f"{self.path}/games")
        self._published = States(spark, self.path, "_state=")

    def state(self) -> dict | None:
        names = [n for n in self._published.names() if not n.startswith(".")]
        if names and not any(n.startswith("_state=") for n in names):
            raise ValueError(f"{self.path} is neither empty nor a sync's folder")
        found = self._published.newest()
        return found and json.loads(found[1])

    def write_state(self, state: dict) -> None:
        """The next state; of two writers at once one fails."""
        self._published.publish(self._published.next_number(), json.dumps(state))

    def prepare(self, username: str, now_ms: int, since: int | None = None) -> dict:
        """What to ask for next: `sync.plan` over the stored state, with the ids to ask for again."""
        if not username.strip():
            raise ValueError("a user name is needed")
        stored = self.state()
        state = stored or {"schema_version": STATE_SCHEMA, "source": SOURCE, "username": username.strip(), "initial_since": since, "cursor_ms": None, "unfinished_game_ids": []}
        check_state(state, username.strip())
        plan = sync.plan(state["cursor_ms"], state["initial_since"], since, now_ms)
        if stored is None:
            self.write_state(state)
        return {**plan, "username": state["username"], "initial_since": state["initial_since"], "unfinished_game_ids": sorted(set(state["unfinished_game_ids"]))}

    def finish(self, plan: dict, statuses: DataFrame) -> int:
        """Move the cursor to the plan's end; gives how many games are unfinished by the last status (remote_id, seq, unfinished) of each.

        The ids of one user's unfinished games pass through the driver.
        """
        open_ids = sorted(r["remote_id"] for r in unfinished(statuses).collect())
        state = {"schema_version": STATE_SCHEMA, "source": SOURCE, "username": plan["username"], "initial_since": plan["initial_since"], "cursor_ms": plan["until"], "unfinished_game_ids": open_ids}
        self.write_state(check_state(state, plan["username"]))
        return len(open_ids)


def unfinished(statuses: DataFrame) -> DataFrame:
    """Ids whose last status is unfinished."""
    return statuses.groupBy("remote_id").agg(F.max_by("unfinished", "seq").alias("unfinished")).where("unfinished").select("remote_id")


def received(frames: DataFrame, player: str) -> DataFrame:
    """Framed games as arrivals: seq, remote_id, content, unfinished, player_result. A frame that is no whole game breaks the stream off."""
    rows = pgn.game_rows(pgn.parse_games(frames.select("source", "source_game", "raw", "error")))
    result = C.player_result(F.col("result"), F.col("white_key"), F.col("black_key"), player)
    whole = F.when(F.col("frame_error").isNotNull(), F.raise_error(F.concat(F.lit("the archive's stream broke off: "), F.col("frame_error")))).otherwise(F.concat(F.btrim(F.col("raw").cast("string"), F.lit(" \t\r\n")), F.lit("\n")))
    return rows.select(F.col("source_game").alias("seq"), C.remote_game_id(F.col("site")).alias("remote_id"), whole.alias("content"), (F.col("result") == 0).alias("unfinished"), result.alias("player_result"))


def refreshed(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requested_id, status and unfinished for games asked for again, one by one.

    `answers` has requested_id, http_status and, for games, remote_id and unfinished. A game that is gone is finished; another
    game than the one asked for, or not exactly one, is an error.
    """
    told = answers.groupBy("requested_id").agg(
        F.max("http_status").alias("http"), F.count("remote_id").alias("n"), F.count_if(F.col("remote_id") != F.col("requested_id")).alias("others"), F.bool_or("unfinished").alias("open"),
    )
    rows = requests.select("requested_id").distinct().join(told, "requested_id", "left")
    status = (
        F.when(F.col("http") == 404, "vanished").when(F.col("http").isNull() | (F.col("http") != 200), "failed").when(F.col("others") > 0, "unexpected_game_id").when(F.col("n") != 1, "unexpected_game_count").otherwise("refreshed")
    )
    return rows.select("requested_id", status.alias("status"), F.when(status == "vanished", F.lit(False)).when(status == "refreshed", F.col("open")).alias("unfinished"))


def preview(arrivals: DataFrame, most: int = PREVIEW_GAMES) -> DataFrame:
    """The newest games of a stream that is told newest first; nothing is committed by them."""
    return arrivals.orderBy("seq").limit(most)


def maintain(spark: SparkSession, collection: Collection, database: str) -> tuple[str, DataFrame]:
    """Build or update a collection's database: a source per game. Gives what was done and each source's action."""
    stored = collection.games.read().select(C.id_filename(F.col("remote_id")).alias("source"), F.col("content").cast("binary").alias("content"))
    rows = pgn.game_rows(pgn.parse_games(pgn.frames_of_texts(stored).where("error IS NULL"))).withColumn("game_id", F.xxhash64("source", "source_game"))
    replayed = pgn.replay(rows.withColumn("source_game", F.col("source_game") + 1))
    games = replayed.select("game_id", "source", "source_game", F.col("raw").alias("pgn"), "white", "black", "white_key", "black_key", "played_on", "white_elo", "black_elo", "result", "mainline_plies", "pgn_bytes")
    positions = replayed.select("game_id", "source", F.explode("steps").alias("s")).select("s.position_key", "game_id", "s.ply", "source")
    db = Database(spark, database)
    return ("update", db.update(games, positions)) if db.exists() else ("build", db.build(games, positions))


def sync_user(spark: SparkSession, path: str, username: str, transport: str, now_ms: int, since: int | None = None, database: str | None = None, recent_only: bool = False) -> dict:
    """One sync of a user's games from an archive into a collection, and from there into a database.

    Games in the stream are folded into the collection; games that were unfinished are asked for one by one; then the cursor
    moves, and then the database follows: if that fails, the cursor has moved all the same. With `recent_only` a collection without
    a cursor takes its newest PREVIEW_GAMES games and keeps having none.
    """
    collection = Collection(spark, path)
    plan = collection.prepare(username, now_ms, since)
    if since is not None and plan["kind"] != "initial":
        raise ValueError("since can only begin a sync")
    only = recent_only and plan["kind"] == "initial"
    day = lambda c: str(spark.range(1).select(C.date_to_ms(F.lit(c))).first()[0])
    options = {"user": username, "until": str(plan["until"]), "ongoing": str(not only).lower(), "sort": "dateDesc" if only else "dateAsc"}
    first = plan.get("since_ms") if plan["kind"] == "incremental" else plan["since"] and day(plan["since"])
    options |= ({"since": str(first)} if first is not None else {}) | ({"max": str(PREVIEW_GAMES)} if only else {})
    read = lambda **o: spark.read.format("pgn_remote").options(transport=transport, **o).load()
    arrivals = received(read(**options), username)
    arrivals = preview(arrivals) if only else arrivals
    at = plan["until"] << 20  # later syncs come behind, and games asked for again behind their sync's
    arrivals = arrivals.withColumn("seq", F.col("seq") + at)
    label = f"{plan['until']}-{'preview' if only else 'sync'}"
    arrivals = spark.createDataFrame(arrivals.collect(), arrivals.schema)  # one user's answer, which came through one reader
    summary = sync.summary(sync.actions(arrivals, collection.games.read())).first().asDict()
    if arrivals.count():
        collection.games.upsert(arrivals, 0, label)
    statuses = arrivals.select("remote_id", "seq", "unfinished")
    if not only:
        for k, game_id in enumerate(plan["unfinished_game_ids"]):
            status, answer = _asked_again(spark, read, game_id, username)
            if status == "unexpected_game_id" or status == "unexpected_game_count":
                raise UnexpectedGame(f"{game_id}: {status}")
            again = answer if answer is not None else spark.createDataFrame([(game_id, None, False)], "remote_id string, content string, unfinished boolean")
            if answer is not None:
                collection.games.upsert(answer.withColumn("seq", F.lit(at + (1 << 20) - 1)), k + 1, label)
            statuses = statuses.unionByName(again.select("remote_id", F.lit(at + (1 << 20) - 1).alias("seq"), "unfinished"))
        summary["unfinished"] = collection.finish(plan, statuses)
    if database is not None:
        summary["index_mode"] = maintain(spark, collection, database)[0]
    return summary | {"refreshed_unfinished": 0 if only else len(plan["unfinished_game_ids"]), "cursor_ms": None if only else plan["until"]}


def _asked_again(spark: SparkSession, read, game_id: str, username: str) -> tuple[str, DataFrame | None]:
    """The status of one game that was asked for again, and the game."""
    try:
        got = received(read(gameid=game_id), username).collect()
        http = 200
    except Exception as error:
        if "GameNotFound" not in str(error):
            raise
        got, http = [], 404
    rows = [(game_id, http, r["remote_id"], r["unfinished"]) for r in got] or [(game_id, http, None, None)]
    answers = spark.createDataFrame(rows, "requested_id string, http_status int, remote_id string, unfinished boolean")
    told = refreshed(answers.select("requested_id"), answers).first()
    if told["status"] != "refreshed":
        return told["status"], None
    return told["status"], spark.createDataFrame([(r["remote_id"], r["content"], r["unfinished"]) for r in got], "remote_id string, content string, unfinished boolean")
