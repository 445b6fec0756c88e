"""Event geometry and state: shots, sides, situations, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import fixed


def attacks_right(is_home: Column, period: Column) -> Column:
    """The home side in periods 1 and 3, the other in 2, 4 and 5."""
    return F.when(is_home, period.isin(1, 3)).otherwise(period.isin(2, 4, 5))


def shooter_is_home(owner_side: Column, x: Column, period: Column, owner_side_rule: str = "literal") -> Column:
    """The literal sides 1 and 2 where they are given, else from which end the shot was taken."""
    right = F.when(period.isin(1, 3), x > 0).otherwise(x < 0)
    if owner_side_rule == "literal":
        return F.when(owner_side == 1, True).when(owner_side == 2, False).otherwise(right)
    return right


def shot_geometry(x: Column, y: Column, right: Column) -> Column:
    """Distance to the goal and angle off its axis in degrees, after turning shots to one end."""
    dx, dy = fixed.GOAL_X - F.when(right, x).otherwise(-x), -y
    return F.struct(F.hypot(dx, dy).alias("dist"), F.degrees(F.abs(F.atan2(dy, dx))).alias("angle"))


def is_fenwick(kind: Column) -> Column:
    return F.coalesce(kind.isin(*fixed.FENWICK), F.lit(False))


def situation(code: Column) -> Column:
    """Skaters of a four-digit code, home from the second digit and away from the third; goalies from the first and last."""
    text = F.when(F.length(F.trim(code)) == 4, F.trim(code))
    digit = [F.substring(text, i, 1).try_cast("int") for i in (1, 2, 3, 4)]
    return F.struct(
        digit[1].alias("home"), digit[2].alias("away"), (digit[3] == 0).alias("pulled_home"), (digit[0] == 0).alias("pulled_away"),
        F.concat_ws("v", digit[1].cast("string"), digit[2].cast("string")).alias("manpower"),
    )


def strength_bucket(own: Column, other: Column) -> Column:
    """EV, PP or SH for the event's team; null if a count is missing."""
    return F.when(own == other, "EV").when(own > other, "PP").when(own < other, "SH")


def faceoff_zone_home(x: Column, period: Column) -> Column:
    """O, D or N for the home side; neutral within the zone lines."""
    right = period.isin(1, 3)
    return F.when(x.isNull(), None).when(F.abs(x) < fixed.ZONE_X, "N").when((x > 0) == right, "O").otherwise("D")
