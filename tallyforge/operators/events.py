"""Event streams: parsing plays and shifts, running score, face-off winners, shot values on shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import rink, text
from tallyforge.operators import joins, ranks
from tallyforge.sources.files import explode_variant

#: Where a play's fields are found, the first that is there.
PLAY_FIELDS = {
    "period": ("$.periodDescriptor.number", "$.period"), "time": ("$.timeInPeriod", "$.timeElapsed"), "type": ("$.typeDescKey", "$.type"), "owner": ("$.details.eventOwnerTeamId", "$.teamId"),
    "x": ("$.details.xCoord", "$.x"), "y": ("$.details.yCoord", "$.y"), "situation_code": ("$.situationCode",), "zone": ("$.details.zoneCode",),
}


def parse_plays(games: DataFrame, json: str = "json", keep: Sequence[str] = ("gameId", "home_id", "away_id")) -> DataFrame:
    """One row for each play with its order, kind, side, place, geometry and strength."""
    rows = explode_variant(games, json, ["$.plays", "$.items"], PLAY_FIELDS, keep)
    home = F.col("team_id") == F.col("home_id")
    rows = rows.select(
        *keep, F.col("item_seq").alias("event_seq"), F.col("period").try_cast("int").alias("period"), text.clock_seconds(F.col("time")).alias("eventSec"), F.upper("type").alias("type"),
        F.col("owner").try_cast("bigint").alias("team_id"), F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"), rink.situation(F.col("situation_code")).alias("s"),
    )
    right = rink.attacks_right(home, F.col("period"))
    geo = rink.shot_geometry(F.col("x"), F.col("y"), right)
    own, other = F.when(home, F.col("s.home")).otherwise(F.col("s.away")), F.when(home, F.col("s.away")).otherwise(F.col("s.home"))
    return rows.select("*", home.alias("is_home"), right.alias("attRight"), geo["dist"].alias("dist"), geo["angle"].alias("angle"), rink.is_fenwick(F.col("type")).alias("isFenwick"), rink.strength_bucket(own, other).alias("strengthBucket"))


def parse_shifts(rows: DataFrame) -> DataFrame:
    """Shift rows typed, with seconds; zero ends and repeats of (game, player, number) fall away, the last staying."""
    out = rows.withColumn("startSec", text.clock_seconds(F.col("startTime"))).withColumn("endSec", text.clock_seconds(F.col("endTime"))).where("startSec is not null and endSec is not null")
    out = out.withColumn("durSec", F.col("endSec") - F.col("startSec"))
    return ranks.keep_first(out, ["gameId", "playerId", "shiftNumber"], [F.col("ingest_seq").desc()])


def running_score(events: DataFrame, keys: Sequence[str] = ("gameId",), order: Sequence[str] = ("period", "eventSec", "event_seq")) -> DataFrame:
    """Both sides' goals up to and with each event."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    goal = F.col("type") == "GOAL"
    for side, own in (("home", F.col("is_home")), ("away", ~F.col("is_home"))):
        events = events.withColumn(f"{side}_score", F.coalesce(F.sum((goal & own).cast("int")).over(w), F.lit(0)))
    diff = F.col("home_score") - F.col("away_score")
    return events.withColumn("score_diff_home", diff).withColumn("score_diff_for_event_team", F.when(F.col("is_home"), diff).otherwise(-diff))


def faceoff_winner(events: DataFrame, keys: Sequence[str] = ("gameId", "period"), order: Sequence[str] = ("eventSec", "event_seq")) -> DataFrame:
    """The side of the next event that has a team after each face-off."""
    out = ranks.next_non_null(events, keys, [F.col(c) for c in order], F.when(F.col("type") != "FACEOFF", F.when(F.col("is_home"), "H").when(~F.col("is_home"), "A")), "_next")
    return out.withColumn("fo_winner_side", F.when(F.col("type") == "FACEOFF", F.col("_next"))).drop("_next")


def annotate_on_ice(events: DataFrame, shifts: DataFrame, is_goalie: str = "isGoalie", bin_size: float = 60.0) -> DataFrame:
    """Skaters of both sides and pulled goalies at each event; events at a period's end have none."""
    keys = ["gameId", "period"]
    limit = F.when(F.col("period") <= 3, 1200).otherwise(600)
    row = ["gameId", "event_seq"]
    base = events.where((F.col("eventSec") >= 0) & (F.col("eventSec") < limit)).select(*keys, "event_seq", "eventSec")
    for side, mark in (("home", True), ("away", False)):
        own = shifts.where(F.col("is_home") == F.lit(mark))
        skaters = own.where(~F.col(is_goalie)).select(*keys, "playerId", "startSec", "endSec")
        goalies = own.where(F.col(is_goalie)).select(*keys, "playerId", "startSec", "endSec")
        n = joins.points_in_intervals(base, skaters, keys, "eventSec", "startSec", "endSec", bin_size=bin_size).groupBy(*row).agg(F.count_distinct("playerId").alias(f"{side}_skaters"))
        g = joins.points_in_intervals(base, goalies, keys, "eventSec", "startSec", "endSec", bin_size=bin_size).select(*row).distinct().withColumn(f"{side}_goalie", F.lit(True))
        events = events.join(n, row, "left").join(g, row, "left").fillna({f"{side}_skaters": 0, f"{side}_goalie": False})
    return events.withColumn("pulled_home", ~F.col("home_goalie")).withColumn("pulled_away", ~F.col("away_goalie")).withColumn("manpower_str", F.concat_ws("v", F.col("home_skaters").cast("string"), F.col("away_skaters").cast("string")))
