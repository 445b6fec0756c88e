"""Numeric functions: guarded rates, shrinkage, clipping, compression, blends, pricing, curves, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import fixed


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def per_60(count: Column, seconds: Column) -> Column:
    """P16."""
    return ratio(count, seconds / 3600)


def shrink(n: Column, k: Column | float) -> Column:
    """N / (n + k); 0 without n."""
    return F.when(n > 0, n / (n + k)).otherwise(0.0)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null."""
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def compress(x: Column, centre: float = fixed.COMPRESS["centre"], above: float = fixed.COMPRESS["above"], below: float = fixed.COMPRESS["below"]) -> Column:
    """As it is within ±centre; beyond, the distance from the centre raised to a power, above and below."""
    return F.when(x > centre, centre + F.pow(x - centre, F.lit(above))).when(x < -centre, -centre - F.pow(-x - centre, F.lit(below))).otherwise(x)


def blend(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of the values that are there; null if none is."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        top, bottom = top + F.coalesce(v * w, F.lit(0.0)), bottom + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def price(metric: Column, rate: Column, cap: Column, least: Column) -> Column:
    """Compressed value above zero, times the share of the cap a unit costs, times the cap, no less than the minimum."""
    return F.greatest(F.greatest(compress(F.coalesce(metric, F.lit(0.0))), F.lit(0.0)) * rate * cap, least)


def piecewise(x: Column, knots: Column, low: float = 0.0, high: float = 1.05) -> Column:
    """Linear between sorted (x, y) knots, level outside, clipped. ``knots``: an array of structs x, y."""
    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(knots, i), F.get(knots, i + 1)
        inside = (x >= a["x"]) & (x <= b["x"])
        return F.when(acc.isNull() & inside, a["y"] + (b["y"] - a["y"]) * ratio(x - a["x"], b["x"] - a["x"])).otherwise(acc)

    between = F.aggregate(F.sequence(F.lit(0), F.size(knots) - 2), F.lit(None).cast("double"), step)
    first, last = F.get(knots, F.lit(0)), F.element_at(knots, -1)
    value = F.when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(between)
    return clip(value, low, high)


def cumulative(values: Column, terms: int) -> Column:
    """Sums of the first 1..terms values."""
    return F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda t: F.aggregate(F.slice(values, F.lit(1), t), F.lit(0.0), lambda a, v: a + v))


BANDS = ("m", "lo", "hi")


def project_bands(base: Column, age: Column, ratios: Column, tails: Column, horizon: int = 9, switch: float = 0.2, growth: tuple[float, float] = (0.6, 1.15), decline: tuple[float, float] = (0.3, 0.95), power: float = 1.10) -> Column:
    """A struct of arrays ``m``, ``lo`` and ``hi``, the next ``horizon`` values and their band, all from one base.

    ``ratios`` maps an age to a struct of the ratios of next to this; ``tails`` has those beyond. While a value is on the
    curve it is multiplied by its age's ratio, clipped, or by a clipped power of the tail; a ratio of zero or less is 1.
    Once the middle is below ``switch`` before step k, all three fall by the step that takes it to zero at the horizon.
    Ages are rounded, halves to the even one; null without a base."""
    beyond = {b: F.when(tails[b] > 0, F.greatest(F.lit(decline[0]), F.least(F.lit(decline[1]), F.pow(tails[b], F.lit(power))))).otherwise(1.0) for b in BANDS}

    def clipped(r: Column) -> Column:
        return F.when(r > 0, F.greatest(F.lit(growth[0]), F.least(F.lit(growth[1]), r))).otherwise(1.0)

    def step(acc: Column, k: Column) -> Column:
        turns = ~acc["linear"] & (acc["m"] < switch)
        linear = acc["linear"] | turns
        fall = F.when(turns, acc["m"] / (horizon - k + 1).cast("double")).otherwise(acc["fall"])
        found = F.try_element_at(ratios, acc["age"])
        times = {b: F.when(found["m"].isNotNull(), clipped(F.coalesce(found[b], found["m"]))).otherwise(beyond[b]) for b in BANDS}
        now = {b: F.when(linear, acc[b] - fall).otherwise(acc[b] * times[b]) for b in BANDS}
        out = F.concat(acc["out"], F.array(F.struct(*[now[b].alias(b) for b in BANDS])))
        return F.struct(*[now[b].alias(b) for b in BANDS], linear.alias("linear"), fall.alias("fall"), (acc["age"] + 1).cast("int").alias("age"), out.alias("out"))

    none = F.array().cast("array<struct<m:double,lo:double,hi:double>>")
    start = F.struct(*[base.cast("double").alias(b) for b in BANDS], F.lit(False).alias("linear"), F.lit(0.0).alias("fall"), F.bround(age.cast("double"), 0).cast("int").alias("age"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: F.struct(*[acc["out"][b].alias(b) for b in BANDS]))


def project(base: Column, age: Column, ratios: Column, tail: Column, horizon: int = 9, **rules) -> Column:
    """The middle of ``project_bands`` alone, from a map of ages to ratios and the tail's ratio."""
    alike = lambda r: F.struct(*[r.cast("double").alias(b) for b in BANDS])
    return project_bands(base, age, F.transform_values(ratios, lambda _, r: alike(r)), alike(tail), horizon, **rules)["m"]
