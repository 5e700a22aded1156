"""Game queries relative to a player, exact positions, and their outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.pgn import first_plies, position_key


@dataclass(frozen=True)
class GameQuery:
    """All given conditions hold together. Ratings, colour, opponent, win and loss are the player's."""

    player: str | None = None
    color: str | None = None
    opponent: str | None = None
    result: str | None = None
    since: int | None = None
    until: int | None = None
    min_rating: int | None = None
    max_rating: int | None = None
    position: str | None = None

    def __post_init__(self):
        relative = [n for n in ("color", "opponent", "min_rating", "max_rating") if getattr(self, n) is not None]
        if self.result in ("win", "loss"):
            relative.append("result")
        if self.player is None and relative:
            raise ValueError(f"{relative[0]} needs a player")
        if any(getattr(self, n) == "" for n in ("player", "opponent")):
            raise ValueError("names must not be empty")
        if self.color not in (None, "white", "black") or self.result not in (None, "win", "loss", "draw", "unfinished"):
            raise ValueError("unknown colour or result")
        for low, high in (("since", "until"), ("min_rating", "max_rating")):
            if None not in (getattr(self, low), getattr(self, high)) and getattr(self, low) > getattr(self, high):
                raise ValueError(f"{low} is above {high}")
        if self.position is not None:
            position_key(self.position)

    def condition(self) -> Column:
        """The predicate over games, positions left out."""
        out = F.lit(True)
        if self.player is not None:
            p = C.ascii_fold(F.lit(self.player))
            white = F.col("white_key") == p
            black = (F.col("black_key") == p) & (F.col("white_key").isNull() | (F.col("white_key") != p))
            sides = []
            for name, mine, own, other, win, loss in (("white", white, "white_elo", "black_key", 1, 2), ("black", black, "black_elo", "white_key", 2, 1)):
                if self.color not in (None, name):
                    continue
                side = mine
                if self.opponent is not None:
                    side = side & (F.col(other) == C.ascii_fold(F.lit(self.opponent)))
                if self.result in ("win", "loss"):
                    side = side & (F.col("result") == (win if self.result == "win" else loss))
                if self.min_rating is not None:
                    side = side & (F.col(own) >= self.min_rating)
                if self.max_rating is not None:
                    side = side & (F.col(own) <= self.max_rating)
                sides.append(side)
            out = sides[0] if len(sides) == 1 else sides[0] | sides[1]
        if self.result in ("draw", "unfinished"):
            out = out & (F.col("result") == (3 if self.result == "draw" else 0))
        if self.since is not None:
            out = out & (F.col("played_on") >= self.since)
        if self.until is not None:
            out = out & (F.col("played_on") <= self.until)
        return out

    def run(self, games: DataFrame, positions: DataFrame | None = None) -> DataFrame:
        """The games that match, with first_ply where a position was asked for.

        Positions come from a table of them, or without one from the `steps` of replayed games or the `moves` of parsed ones.
        """
        found = games.where(self.condition())
        if self.position is None:
            return found
        if positions is None and "steps" not in games.columns:
            return first_plies(found, position_key(self.position)).where("first_ply IS NOT NULL")
        if positions is None:
            keys = F.transform("steps", lambda s: s["position_key"])
            return found.withColumn("first_ply", (F.array_position(keys, F.lit(position_key(self.position))) - 1).cast("int")).where("first_ply >= 0")
        hits = positions.where(F.col("position_key") == F.lit(position_key(self.position))).groupBy("game_id").agg(F.min("ply").alias("first_ply"))
        return found.join(hits, "game_id")


def match_records(found: DataFrame) -> DataFrame:
    """One record per match, as the JSON lines output has it; null fields are left out there."""
    ply = [F.col("first_ply").alias("position_ply")] if "first_ply" in found.columns else []
    return found.select(
        F.lit(1).alias("schema_version"), "source", "source_game", "white", "black", C.format_date(F.col("played_on")).alias("date"),
        "white_elo", "black_elo", C.result_label(F.col("result")).alias("result"), "mainline_plies", *ply,
    )


def summary(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """Games scanned and matched, and bytes read, in one row."""
    return scanned.agg(F.count(F.lit(1)).alias("games"), F.sum("pgn_bytes").alias("bytes")).crossJoin(found.agg(F.count(F.lit(1)).alias("matches")))  # one row each


def count_unless_failed(found: DataFrame, errors: DataFrame) -> DataFrame:
    """The number of matches, or null if any source failed."""
    return found.agg(F.count(F.lit(1)).alias("n")).crossJoin(errors.agg(F.count(F.lit(1)).alias("failed"))).select(F.when(F.col("failed") == 0, F.col("n")).alias("matches"))  # one row each
