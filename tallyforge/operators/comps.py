"""Comparables: block distances, kernel neighbours, term statistics, blending, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import fixed
from tallyforge.operators import cells, joins, ranks, stats
from tallyforge.sources import sinks


def fit_blocks(train: DataFrame, blocks: Mapping[str, Sequence[str]], euclid: Sequence[str] = ("CTX",)) -> dict[str, dict]:
    """For each block the means, population deviations and the inverse of the covariance of standardised columns
    (plus 1e-6 on the diagonal), over training rows complete in the block. One aggregation for all blocks."""
    aggs = []
    for name, cols in blocks.items():
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        xs = [F.when(ok, F.col(c).cast("double")) for c in cols]
        aggs.append(F.count(F.when(ok, 1)).alias(f"{name}_n"))
        aggs += [f(x).alias(f"{name}_{k}{i}") for i, x in enumerate(xs) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
        aggs += [F.covar_samp(xs[i], xs[j]).alias(f"{name}_c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    row = train.agg(*aggs).first()
    out = {}
    for name, cols in blocks.items():
        p, n = len(cols), row[f"{name}_n"]
        mean = [row[f"{name}_m{i}"] or 0.0 for i in range(p)]
        sd = [row[f"{name}_s{i}"] or 1.0 for i in range(p)]
        inverse = np.eye(p)
        if name not in euclid and n >= 3 and p > 1:
            cov = np.array([[(row[f"{name}_c{min(i, j)}_{max(i, j)}"] or 0.0) / (sd[i] * sd[j]) for j in range(p)] for i in range(p)])
            inverse = np.linalg.inv(cov + 1e-6 * np.eye(p))
        out[name] = {"columns": list(cols), "mean": mean, "sd": sd, "inverse": inverse.tolist()}
    return out


def with_blocks(df: DataFrame, blocks: Mapping[str, dict]) -> DataFrame:
    """The standardised block vectors ``z_<block>``, null where a column of the block is."""
    for name, b in blocks.items():
        z = [(F.col(c).cast("double") - m) / s for c, m, s in zip(b["columns"], b["mean"], b["sd"], strict=True)]
        ok = F.lit(True)
        for c in b["columns"]:
            ok = ok & F.col(c).isNotNull()
        df = df.withColumn(f"z_{name}", F.when(ok, F.array(*z)))
    return df


def block_distance(blocks: Mapping[str, dict], left: str = "t_", right: str = "c_", weights: Mapping[str, float] = fixed.BLOCK_WEIGHTS) -> Column:
    """Weighted sum of Mahalanobis distances (Euclidean where the inverse is the identity); a block that either side
    lacks counts nothing. Plain column arithmetic, so that it stays in generated code."""
    total = F.lit(0.0)
    for name, b in blocks.items():
        p = len(b["columns"])
        d = [F.col(f"{left}z_{name}")[i] - F.col(f"{right}z_{name}")[i] for i in range(p)]
        q = F.lit(0.0)
        for i in range(p):
            for j in range(p):
                if b["inverse"][i][j]:
                    q = q + d[i] * d[j] * float(b["inverse"][i][j])
        total = total + F.coalesce(F.sqrt(F.greatest(q, F.lit(0.0))) * weights[name], F.lit(0.0))
    return total


def kernel(dist: Column, scale: float = 0.85, power: float = 0.85) -> Column:
    """R9."""
    return F.pow(F.exp(-scale * F.greatest(dist, F.lit(0.0))), F.lit(power))


def euclid(a: Column, b: Column) -> Column:
    """The distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


euclid.scale = None  # by what the vectors are multiplied for this to be their Euclidean distance: nothing


def _scale(inverse: Sequence[Sequence[float]], weight: float) -> np.ndarray:
    """The matrix m for which the weighted Mahalanobis distance of x and y is the length of m(x - y)."""
    s = np.array(inverse, float)
    values, axes = np.linalg.eigh((s + s.T) / 2)
    return weight * np.sqrt(np.maximum(values, 0))[:, None] * axes.T


def block_metrics(blocks: Mapping[str, dict], weights: Mapping[str, float] = fixed.BLOCK_WEIGHTS) -> dict[str, Callable[[Column, Column], Column]]:
    """R8 in parts: for each block's vector ``z_<block>`` its weighted distance, Mahalanobis or Euclidean."""

    def metric(b: dict, weight: float) -> Callable[[Column, Column], Column]:
        p = len(b["columns"])

        def between(x: Column, y: Column) -> Column:
            d = [x[i] - y[i] for i in range(p)]
            q = F.lit(0.0)
            for i in range(p):
                for j in range(p):
                    if b["inverse"][i][j]:
                        q = q + d[i] * d[j] * float(b["inverse"][i][j])
            return F.sqrt(F.greatest(q, F.lit(0.0))) * weight

        between.scale = _scale(b["inverse"], weight)
        return between

    return {f"z_{name}": metric(b, weights[name]) for name, b in blocks.items()}


PIVOTS, BLOCK = 8, 2000
MOST_RINGS = 4096


def nearest(targets: DataFrame, pool: DataFrame, target_id: str, pool_id: str, bucket: str, metrics: Mapping[str, Callable[[Column, Column], Column]], k: int = 100, prefix: tuple[str, str] = ("t_", "c_"), but_itself: bool = False, block: int = BLOCK, pivots: int = PIVOTS, counts: list | None = None) -> DataFrame:
    """The k nearest of the pool by distance within the target's bucket, or of all where the bucket holds
    fewer than k; with ``weight`` summing to one and ``sim_pct``. Exact, and no target meets rows that surely are too far.

    ``metrics`` has for each column of vectors a metric; the distance is the sum over them, and a vector that either side
    lacks counts nothing. Where each metric has a ``scale``, by which it is a Euclidean distance, rows lie in boxes of a tree
    (``cells``). For other metrics some rows of the pool are pivots. By their distances to these, rows lie in cells, of the pivot
    that is nearest, and in rings of the cells; a row that lacks a vector has a cell of its own. A target first looks at
    the rings around it, which bounds its radius where they hold k rows; then, by the triangle inequality, at the rings alone that
    its radius touches, and of their rows at those that no pivot shows to be farther. A ring is split by hash into blocks
    of some ``block`` rows, each with its targets a task's work. ``counts`` is given how many distances were computed, and
    how many pairs there are."""
    t, c = prefix
    names = list(metrics)
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    size = sinks.cut(pool.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")))
    scope = targets.join(sinks.small(size), bucket, "left").withColumn("_scope", F.when(F.coalesce("_n", F.lit(0)) < k, "*").otherwise(F.col(bucket).cast("string"))).drop("_n")
    every = not scope.where("_scope = '*'").isEmpty()
    scopes = F.array(F.lit("*"), F.col(bucket).cast("string")) if every else F.array(F.col(bucket).cast("string"))
    if all(hasattr(m, "scale") for m in metrics.values()):
        return _weighted(_boxed(scope, pool.withColumn("_scope", F.explode(scopes)).where("_scope is not null"), target_id, pool_id, metrics, k, prefix, but_itself, block, counts), f"{t}{target_id}")
    centres = [r.asDict() for r in pool.where(whole).select(*names).orderBy(F.xxhash64(*names)).limit(pivots).collect()]

    def placed(df: DataFrame) -> DataFrame:
        """With the distances to the pivots by part (``_p``), the cell and the distance to its pivot (``_d``)."""
        literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
        far = F.array(*[F.array(*[F.when(F.col(n).isNotNull(), m(F.col(n), literal(v[n]))) for n, m in metrics.items()]) for v in centres])
        df = df.withColumn("_p", far if centres else F.array().cast("array<array<double>>"))
        sums = F.transform("_p", lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v))
        df = df.withColumn("_sums", F.when(whole, sums))
        df = df.withColumn("_d", F.array_min("_sums"))
        return df.withColumn("_cell", F.coalesce(F.array_position("_sums", F.col("_d")).cast("int") - 1, F.lit(-1)))

    mine = placed(pool.withColumn("_scope", F.explode(scopes)).where("_scope is not null")).drop("_sums")
    mine = sinks.cut(mine)
    cells = mine.groupBy("_scope", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    cells = cells.withColumn("_rings", F.when(F.col("_cell") < 0, 1).otherwise(F.least(F.ceil(F.col("_n") / block), F.lit(MOST_RINGS))).cast("int"))
    cells = sinks.cut(cells.withColumn("_wide", F.greatest((F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0))) / F.col("_rings"), F.lit(1e-12))))
    ring = lambda d: F.coalesce(F.floor(F.least(F.greatest((d - F.col("_lo")) / F.col("_wide"), F.lit(0.0)), F.col("_rings") - 1.0)), F.lit(0)).cast("int")
    cells, place = sinks.small(cells), ["_scope", "_cell", "_ring"]
    mine = mine.join(cells, ["_scope", "_cell"]).withColumn("_ring", ring(F.col("_d"))).drop("_n", "_lo", "_hi", "_rings", "_wide")
    splits = sinks.small(sinks.cut(mine.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_splits"))))
    right = mine.join(splits, place).withColumn("_block", F.pmod(F.xxhash64(pool_id), F.col("_splits")).cast("int")).drop("_splits")
    right = right.withColumnsRenamed({x: f"{c}{x}" for x in [*pool.columns, "_p", "_d"]})
    left = sinks.cut(placed(scope).withColumnsRenamed({x: f"{t}{x}" for x in [*targets.columns, "_p", "_d", "_cell", "_sums"]}))
    who, other = F.col(f"{t}{target_id}"), F.col(f"{c}{pool_id}")
    there = lambda n: F.col(f"{t}{n}").isNotNull() & F.col(f"{c}{n}").isNotNull()
    parts = [F.when(there(n), m(F.col(f"{t}{n}"), F.col(f"{c}{n}"))).otherwise(0.0) for n, m in metrics.items()]
    distance = sum(parts[1:], parts[0])
    slack = lambda r: r * (1 + 1e-9) + 1e-9

    def judged(visits: DataFrame, radius: bool) -> DataFrame:
        """The k nearest within the rings that each target visits, with ``dist``: its best of each block, then of all."""
        asked = visits.join(splits, place).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))).drop("_splits")
        pairs = asked.join(right, [*place, "_block"])
        pairs = pairs.where(who != other) if but_itself else pairs
        if radius:
            # no pivot may show the pair to be farther than the radius
            apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.coalesce(F.abs(u - v), F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v)
            pairs = pairs.where(F.coalesce(F.array_max(F.zip_with(f"{t}_p", f"{c}_p", apart)), F.lit(0.0)) <= slack(F.col("_radius")))
        if counts is not None:
            counts.append(pairs.count())
        best = ranks.top_k(pairs.withColumn("dist", distance), [f"{t}{target_id}", *place, "_block"], [F.col("dist"), other], k, "_place")
        best = best.drop("_place", "_cell", "_ring", "_block", f"{c}_p", f"{c}_d")
        return ranks.top_k(best, [f"{t}{target_id}"], [F.col("dist"), other], k, "neighbour")

    between = lambda low, high: F.explode(F.sequence(low, high))
    numbers = ("_n", "_lo", "_hi", "_rings", "_wide")
    own = ring(F.col(f"{t}_d"))
    home = left.withColumn("_cell", F.col(f"{t}_cell")).join(cells, ["_scope", "_cell"])
    home = home.withColumn("_ring", between(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.col("_rings") - 1))).drop(*numbers)
    radius = judged(home, False).groupBy(who.alias("_who")).agg(F.count(F.lit(1)).alias("_m"), F.max("dist").alias("_radius"))
    radius = sinks.cut(radius.select("_who", F.when(F.col("_m") >= k, F.col("_radius")).otherwise(float("inf")).alias("_radius")))
    touched = left.join(radius, who == F.col("_who"), "left").drop("_who").withColumn("_radius", F.coalesce("_radius", F.lit(float("inf")))).join(cells, "_scope")
    at = F.when(F.col("_cell") >= 0, F.get(f"{t}_sums", F.col("_cell")))
    low, high = at - slack(F.col("_radius")), at + slack(F.col("_radius"))
    touched = touched.where(at.isNull() | F.col("_lo").isNull() | ((low <= F.col("_hi")) & (high >= F.col("_lo"))))
    last = F.col("_rings") - 1
    touched = touched.withColumn("_ring", between(F.when(at.isNull(), 0).otherwise(ring(low)), F.when(at.isNull(), last).otherwise(ring(high)))).drop(*numbers)
    best = judged(touched, True)
    if counts is not None:
        counts.append(scope.groupBy("_scope").count().join(mine.groupBy("_scope").agg(F.count(F.lit(1)).alias("m")), "_scope").agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0)
    return _weighted(best.drop(f"{t}_p", f"{t}_d", f"{t}_cell", f"{t}_sums", "_radius", "_scope"), f"{t}{target_id}")


def _boxed(scope: DataFrame, mine: DataFrame, target_id: str, pool_id: str, metrics: Mapping[str, Callable[[Column, Column], Column]], k: int, prefix: tuple[str, str], but_itself: bool, block: int, counts: list | None) -> DataFrame:
    """The k nearest with ``dist`` and ``neighbour``: what the boxes leave, judged by the metrics themselves."""
    t, c = prefix
    if counts is not None:
        pairs = scope.groupBy("_scope").count().join(mine.groupBy("_scope").agg(F.count(F.lit(1)).alias("m")), "_scope").agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0
    found = cells.near(scope, mine, target_id, pool_id, {n: m.scale for n, m in metrics.items()}, k, but_itself, block, counts)
    if counts is not None:
        counts.append(pairs)
    found = found.withColumnsRenamed({x: f"{c}{x}" for x in mine.columns if x != "_scope"})
    left = scope.drop("_scope").withColumnsRenamed({x: f"{t}{x}" for x in scope.columns})
    who, other = F.col(f"{t}{target_id}"), F.col(f"{c}{pool_id}")
    both = found.join(left, F.col("_who").eqNullSafe(who)).drop("_who")
    both = both.where(who != other) if but_itself else both
    there = lambda n: F.col(f"{t}{n}").isNotNull() & F.col(f"{c}{n}").isNotNull()
    parts = [F.when(there(n), m(F.col(f"{t}{n}"), F.col(f"{c}{n}"))).otherwise(0.0) for n, m in metrics.items()]
    return ranks.top_k(both.withColumn("dist", sum(parts[1:], parts[0])), [f"{t}{target_id}"], [F.col("dist"), other], k, "neighbour")


def _weighted(best: DataFrame, target: str) -> DataFrame:
    """With ``weight`` and ``sim_pct``."""
    best = ranks.share_of_total(best.withColumn("_kernel", kernel(F.col("dist"))), [target], "_kernel", "weight")
    far = F.max("dist").over(Window.partitionBy(target))
    sim = F.when(far > 0, F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dist") / F.nullif(far, F.lit(0.0)))), 1)).otherwise(100.0)
    return best.withColumn("sim_pct", sim).drop("_kernel")


def term_statistics(neighbours: DataFrame, target: str, term: str, value: str) -> DataFrame:
    """Weighted mean, middle width (of four or more) and effective number by target and term."""
    w = F.col("weight")
    return neighbours.groupBy(target, term).agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias("knn"), stats.iqr(F.col(value)).alias("iqr"), stats.quantile_share(F.col(value), w).alias("eff_n"))


def blend_weight(n: Column, iqr: Column, base: float = 0.5, strong: float = 0.8, cap: float = 0.75, least: int = 5) -> Column:
    """How much the model weighs against the neighbours."""
    spread = F.least(F.lit(cap), base + 0.1 * F.coalesce(iqr, F.lit(0.0)) / 0.05)
    return F.when(F.coalesce(n, F.lit(0)) == 0, strong).when(n < least, base).otherwise(spread)


def blended(knn: Column, model: Column, weight: Column) -> Column:
    """The other where one is missing."""
    return F.coalesce(weight * model + (1 - weight) * knn, model, knn)


def top_comps(neighbours: DataFrame, target: str, comp: str, k: int = 5, own: str | None = None) -> DataFrame:
    """Distinct comparables by weight downwards; not the target itself, or the one that ``own`` names where a target
    is not a comparable's kind, as a contract is not a player."""
    others = neighbours.where(F.col(comp).isNotNull() & ~F.col(own or target).eqNullSafe(F.col(comp)))
    once = ranks.keep_first(others, [target, comp], [F.col("weight").desc(), F.col("dist")])
    return ranks.top_k(once, [target], [F.col("weight").desc(), F.col(comp)], k, "comp_rank")


def wide_comps(comps: DataFrame, target: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """P13."""
    picks = [F.max(F.when(F.col("comp_rank") == i, F.col(c))).alias(f"comp{i}_{c}") for i in range(1, k + 1) for c in columns]
    return comps.groupBy(target).agg(*picks)


def evaluate(df: DataFrame, predictions: str, term: str, actual: str) -> DataFrame:
    """Absolute error at the true term, from an array of predictions by term."""
    at = F.try_element_at(F.col(predictions), F.col(term).cast("int"))
    return df.withColumn("predicted", at).withColumn("abs_error", F.abs(at - F.col(actual))).where("abs_error is not null")


def errors_by_term(evaluated: DataFrame, term: str) -> DataFrame:
    """R12."""
    means = evaluated.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"))
    return joins.null_safe(means, stats.quantile_columns(evaluated, [term], "abs_error", {"median_abs_error": 0.5}), [term], "left")


def baseline_by_term(history: DataFrame, targets: DataFrame, term: str, actual: str) -> DataFrame:
    """Error of the historical median of each term."""
    medians = stats.quantile_columns(history, [term], actual, {"baseline": 0.5})
    return targets.join(medians, term, "left").groupBy(term).agg(F.count("baseline").alias("n"), F.avg(F.abs(F.col(actual) - F.col("baseline"))).alias("baseline_mae"))
