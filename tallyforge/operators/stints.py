"""Segmentation: cutting time into stints of one state, and what holds in each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import fixed
from tallyforge.sources import sinks

PERIOD_END = 1200


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], state: Sequence[str], cut: Column | None = None, out: str = "island") -> DataFrame:
    """Rows numbered by runs of equal state; ``cut`` forces a new run. The number starts at 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in state:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    step = F.when(first, 0).when(changed | (cut if cut is not None else F.lit(False)), 1).otherwise(0)
    df = df.withColumn("_step", step)
    return df.withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def build(events: DataFrame, shifts: DataFrame, games: DataFrame, skaters: DataFrame, b2b: DataFrame | None = None) -> DataFrame:
    """Two rows for each stint, one for each side."""
    return sides(segments(events, shifts, games, skaters), b2b)


def segments(events: DataFrame, shifts: DataFrame, games: DataFrame, skaters: DataFrame) -> DataFrame:
    """One row for each stint, from which ``sides`` makes two: half of their bytes, for what is to be stored or moved.

    ``events``: gameId, period, eventSec, event_seq, type, teamAbbrev, home_score, away_score, faceoff_zone_home, isFenwick, xG;
    ``shifts``: gameId, period, playerId, teamAbbrev, startSec, endSec; ``games``: gameId, home_team, away_team;
    ``skaters``: playerId of those that count. Players are those with start <= t < end; a state at grid point j is both
    sets at j with the score at the point before; a stint runs from one cut to the next and carries the state of its
    opening; cuts are changes of state, goals and face-off starts (Q6, Q7). A face-off start is a face-off with a stoppage
    in that second or the one before. Expected goals fall in (start, end].

    Shifts and events go to their game's task in one shuffle. There each second of a period that holds something becomes a
    row, and windows over the period, all in one order, carry the score, the sums and the shifts so far: nothing is
    joined or moved again.
    """
    keys = ["gameId", "period"]
    counted = shifts.where(F.col("endSec") >= F.col("startSec")).join(sinks.small(skaters.select("playerId").distinct()), "playerId", "left_semi")
    line = counted.select(*keys, "teamAbbrev", F.struct("playerId", "startSec", "endSec").alias("shift"))
    play = F.struct(F.col("eventSec").cast("bigint").alias("t"), "event_seq", "type", "home_score", "away_score", F.col("faceoff_zone_home").alias("zone"), F.when(F.col("isFenwick"), F.col("xG").cast("double")).alias("xG"))
    line = line.unionByName(events.select(*keys, "teamAbbrev", play.alias("play")), allowMissingColumns=True)
    line = line.repartition("gameId").join(sinks.small(games.select("gameId", "home_team", "away_team")), "gameId")
    at_home, away = F.col("teamAbbrev") == F.col("home_team"), F.col("teamAbbrev") == F.col("away_team")
    is_shift, kind = F.col("shift").isNotNull(), F.col("play.type")
    line = line.where(~is_shift | at_home | away)
    # what a row says is told in its first second; its others, and the ends of the period, are only points
    own = F.when(is_shift, F.array(*[F.col(f"shift.{c}").cast("bigint") for c in ("startSec", "endSec")])).otherwise(F.array("play.t"))
    line = line.select("*", F.posexplode(F.concat(own, F.array(F.lit(0), F.lit(PERIOD_END)).cast("array<bigint>"))).alias("i", "t"))
    line = line.withColumns({c: F.when(F.col("i") == 0, F.col(c)) for c in ("shift", "play")}).drop("i")
    plays = F.col("play").isNotNull()
    seconds = line.groupBy(*keys, "t").agg(
        F.first("home_team").alias("home_team"), F.first("away_team").alias("away_team"),
        F.collect_list(F.when(is_shift & at_home, F.col("shift"))).alias("home_from"), F.collect_list(F.when(is_shift & away, F.col("shift"))).alias("away_from"),
        F.bool_or(is_shift).alias("shifts"), F.bool_or(plays & (kind == "GOAL")).alias("goal"), F.bool_or(plays & (kind == "FACEOFF")).alias("fo"), F.bool_or(plays & (kind == "STOPPAGE")).alias("stop"),
        F.max(F.when(plays & (kind == "FACEOFF"), F.col("play.zone"))).alias("fo_zone"), F.max(F.when(plays, F.struct("play.event_seq", "play.home_score", "play.away_score"))).alias("score"),
        F.sum(F.when(plays & at_home, F.col("play.xG"))).alias("h"), F.sum(F.when(plays & ~at_home, F.col("play.xG"))).alias("a"),
    )
    w = Window.partitionBy(*keys).orderBy("t")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {c: F.coalesce(F.sum(c).over(past), F.lit(0.0)) for c in ("h", "a")}
    grid = seconds.withColumns({"fo_start": F.coalesce(F.col("fo") & F.bool_or("stop").over(w.rangeBetween(-1, 0)), F.lit(False)), "score": F.last("score", ignorenulls=True).over(past), "home": F.flatten(F.collect_list("home_from").over(past)), "away": F.flatten(F.collect_list("away_from").over(past)), **so_far})
    grid = grid.withColumn("shifts", F.max("shifts").over(Window.partitionBy("gameId"))).where(F.col("shifts") & F.col("t").isNotNull())
    for side in ("home", "away"):
        on = F.filter(side, lambda s: (s["startSec"] <= F.col("t")) & (F.col("t") < s["endSec"]))
        grid = grid.withColumn(side, F.array_sort(F.array_distinct(F.transform(on, lambda s: s["playerId"]))))
    grid = grid.withColumn("diff_here", F.coalesce("score.home_score", F.lit(0)) - F.coalesce("score.away_score", F.lit(0)))
    # the state at a point carries the score of the point before; the first point has that of itself and the sets of the second
    grid = grid.withColumn("j", F.row_number().over(w) - 1).withColumn("diff", F.coalesce(F.lag("diff_here").over(w), F.col("diff_here")))
    for side in ("home", "away"):
        grid = grid.withColumn(f"{side}_", F.when(F.col("j") == 0, F.lead(side).over(w)).otherwise(F.col(side)))
    state = F.struct("home_", "away_", "diff")
    changed = (F.col("j") > 1) & (F.col("state") != F.lag("state").over(w))
    grid = grid.withColumn("state", state)
    cut = (F.col("j") > 0) & (changed | F.coalesce("goal", F.lit(False)) | F.col("fo_start"))
    grid = grid.withColumn("cut", cut).withColumn("last", F.lead("t").over(w).isNull())
    opened = grid.where((F.col("j") == 0) | F.col("cut") | F.col("last"))
    nh, na = F.size("home_"), F.size("away_")
    opened = opened.withColumn("strength", F.when(nh == na, "ES").when(nh > na, "PP").otherwise("PK"))
    opened = opened.withColumns({"before": F.lag("strength").over(w), "endSec": F.lead("t").over(w), "home_xg": F.lead("h").over(w) - F.col("h"), "away_xg": F.lead("a").over(w) - F.col("a")})
    stints = opened.where(F.col("endSec").isNotNull() & (F.col("endSec") > F.col("t")))
    return stints.select(*keys, F.col("t").alias("startSec"), "endSec", "home_", "away_", "diff", "fo_start", "fo_zone", "before", "strength", "home_team", "away_team", "j", "home_xg", "away_xg")


def sides(stints: DataFrame, b2b: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The home and the away row of each stint, with the features of A2 seen from that side, and the columns ``keep``."""
    minutes = (F.col("endSec") - F.col("startSec")) / 60.0
    zone = F.coalesce("fo_zone", F.lit("N"))

    def row(home: bool) -> Column:
        own, other = ("home", "away") if home else ("away", "home")
        flip = {"ES": "ES", "PP": "PK", "PK": "PP"}
        turned = lambda c: c if home else F.when(c == "PP", flip["PP"]).when(c == "PK", flip["PK"]).otherwise(c)
        now, prev = turned(F.col("strength")), turned(F.col("before"))
        diff = F.col("diff") if home else -F.col("diff")
        fo, later = F.col("fo_start"), F.col("before").isNotNull()
        flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        return F.struct(
            F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), F.lit(int(home)).alias("is_home"), F.col(f"{own}_").alias("players"), F.col(f"{other}_").alias("opp_players"),
            F.col(f"{own}_xg").alias("xGF"), F.col(f"{other}_xg").alias("opp_xGF"), now.alias("situation"),
            flag(fo & (zone == ("O" if home else "D"))).alias("zone_off"), flag(fo & (zone == ("D" if home else "O"))).alias("zone_def"), flag(fo & (zone == "N")).alias("zone_neu"),
            flag(later & fo & (now == "ES") & (prev == "PP")).alias("PPx"), flag(later & fo & (now == "ES") & (prev == "PK")).alias("PKx"),
            flag(later & ~fo & (now == "ES") & prev.isin("PP", "PK")).alias("ev_after_pp_on_fly"), flag(later & ~fo & now.isin("PP", "PK") & (prev == "ES")).alias("pp_started_on_fly"),
            flag(diff == 1).alias("score_plus1"), flag(diff == -1).alias("score_minus1"), flag(diff == 2).alias("score_plus2"), flag(diff == -2).alias("score_minus2"),
            flag(diff >= 3).alias("score_plus3p"), flag(diff <= -3).alias("score_minus3p"), F.size(f"{own}_").alias("row_n_skaters"), F.size(f"{other}_").alias("opp_n_skaters"),
            F.concat_ws("v", F.size(f"{own}_").cast("string"), F.size(f"{other}_").cast("string")).alias("strength_key"),
        )

    out = stints.withColumn("minutes", minutes).select("gameId", "period", "startSec", "endSec", "minutes", *keep, (F.col("period") == 2).cast("int").alias("per2"), (F.col("period") >= 3).cast("int").alias("per3"), F.inline(F.array(row(True), row(False))))
    if b2b is not None:
        for side, name in (("team", "row_b2b"), ("opponent", "opp_b2b")):
            out = out.join(F.broadcast(b2b.select("gameId", F.col("team").alias(side), F.col("b2b").alias(name))), ["gameId", side], "left").fillna({name: 0})
    return out


def for_situation(stints: DataFrame, situation: str, least_seconds: float = 10.0) -> DataFrame:
    """stints long enough, of the situation's numbers of skaters."""
    return stints.where((F.col("endSec") - F.col("startSec") >= least_seconds) & F.col("strength_key").isin(*fixed.STRENGTHS[situation]))
