"""Aggregates: null rules, weighted and trimmed means, quantile bands, histograms, correlations, slopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import joins
from tallyforge.schema import numeric_columns
from tallyforge.sources import sinks


def sum_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, empty_zero: bool = True, dropna: bool = True) -> DataFrame:
    """Sums by key; of no values 0, or null; rows with a null key fall away unless ``dropna`` is off."""
    columns = columns or numeric_columns(df, keys)
    rows = df.na.drop(subset=list(keys)) if dropna else df
    zero = (lambda c: F.coalesce(F.sum(c), F.lit(0))) if empty_zero else F.sum
    return rows.groupBy(*keys).agg(*[zero(c).alias(c) for c in columns])


def ordered_distinct(order: Column, value: str, sep: str = ",") -> Column:
    """Distinct values joined in order of first appearance, as an aggregate."""
    seen = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.array_distinct(F.transform(seen, lambda x: x["v"])), sep)


def weighted_mean(value: str, weight: str) -> Column:
    """Weights of all rows below, values that are there above; the plain mean where the weights do not sum above zero."""
    w = F.sum(weight)
    return F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / w).otherwise(F.avg(value))


def weighted_mean_strict(value: str, weight: str, eps: float = 1e-9) -> Column:
    """Null if any value is; weights a little above zero."""
    w = F.col(weight) + eps
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col(value) * w) / F.sum(w))


def is_finite(c: Column) -> Column:
    """a number that is neither null, NaN nor infinite."""
    return F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c.cast("double"), F.lit(0.0)))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], accuracy: int = 2_000) -> DataFrame:
    """Exact interpolated quantiles by key (keys, q, quantile), as ``percentile`` gives them, for keys of any size, in two
    passes over ``df``.

    ``percentile`` holds every value of a key in one task. Here a first pass sketches a narrow band around each quantile,
    wider than the sketch can err. The second counts, in the tasks that read, what lies below each band, and keeps only
    values inside, by their number: so the column itself is never shuffled, but for keys of up to ``accuracy`` values,
    whose band is everything. Several columns or grouping sets are one call, with a key that names them. Null values do
    not count; null keys are a key. The edges of the bands are sent to every task when counted as few."""
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(value).cast("double").alias("_v"))
    margin = 4 / accuracy
    ends = [F.lit(min(max(q + d, 0.0), 1.0)) for q in at for d in (-margin, margin)]
    edges = rows.groupBy(*k).agg(F.percentile_approx("_v", F.array(*ends), accuracy).alias("_e"), F.count(F.lit(1)).alias("_all"))
    few = F.col("_all") <= accuracy
    low = lambda i: F.when(~few, F.get("_e", F.lit(2 * i)))
    high = lambda i: F.when(~few, F.get("_e", F.lit(2 * i + 1)))
    band = [F.struct(F.lit(float(q)).alias("q"), low(i).alias("lo"), high(i).alias("hi")) for i, q in enumerate(at)]
    edges = sinks.small(sinks.cut(edges.where("_all > 0").select(*k, "_all", F.array(*band).alias("_bands"))))
    placed = joins.null_safe(rows, edges, k) if k else rows.crossJoin(edges)
    placed = placed.select(*k, "_v", "_all", F.inline("_bands")).where(F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))
    inside = F.col("lo").isNull() | (F.col("_v") >= F.col("lo"))
    counted = placed.groupBy(*k, "q", "_all", F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*k, "q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("_upto", F.sum("_n").over(run)).withColumn("_h", (F.col("_all") - 1) * F.col("q"))
    value_at = lambda r: F.min(F.when((F.col("_upto") > r) & F.col("_v").isNotNull(), F.col("_v")))
    below = F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0))
    found = counted.groupBy(*k, "q").agg(F.first("_h").alias("_h"), value_at(F.floor("_h")).alias("_x"), value_at(F.ceil("_h")).alias("_y"), below.alias("_below"), F.max("_upto").alias("_to"))
    held = (F.floor("_h") >= F.col("_below")) & (F.ceil("_h") < F.col("_to"))
    between = (F.ceil("_h") - F.col("_h")) * F.col("_x") + (F.col("_h") - F.floor("_h")) * F.col("_y")
    quantile = F.when(~held, F.raise_error(F.lit("a sketch erred by more than its bound"))).when((F.col("_x") == F.col("_y")) | (F.ceil("_h") == F.floor("_h")), F.col("_x")).otherwise(between)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], "q", quantile.alias("quantile"))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, columns: Mapping[str, float]) -> DataFrame:
    """The exact quantiles of each key that has values, in columns by name."""
    of = lambda q: F.max(F.when(F.col("q") == float(q), F.col("quantile")))
    return quantiles(df, keys, value, list(columns.values())).groupBy(*keys).agg(*[of(q).alias(n) for n, q in columns.items()])


def within_quantiles(df: DataFrame, keys: Sequence[str], value: str, low: float | None, high: float | None) -> DataFrame:
    """with a flag ``inside`` for rows within the inclusive quantile band of their key. Exact quantiles, aggregated
    and joined back."""
    bounds = [(n, q) for n, q in (("_lo", low), ("_hi", high)) if q is not None]
    inside = F.col(value).isNotNull()
    if not bounds:
        return df.withColumn("inside", inside)
    edges = quantile_columns(df, keys, value, dict(bounds))
    out = df.join(edges, list(keys), "left") if keys else df.crossJoin(F.broadcast(edges))
    inside = inside & (F.col(value) >= F.col("_lo")) if low is not None else inside
    inside = inside & (F.col(value) <= F.col("_hi")) if high is not None else inside
    return out.withColumn("inside", inside).drop("_lo", "_hi")


def weighted_trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str, drop_low: float = 0.0, drop_high: float = 0.0, out: str = "trimmed", default: float | None = None) -> DataFrame:
    """Weighted mean within the unweighted quantile band, bounds included; over all values where the band has no
    weight; else the default. Only finite values with a positive weight count."""
    ok = df.where(is_finite(F.col(value)) & (F.col(weight) > 0))
    band = within_quantiles(ok, keys, value, drop_low or None, (1 - drop_high) if drop_high else None)
    w, v = F.col(weight), F.col(value)
    inner, whole = F.sum(F.when(F.col("inside"), w)), F.sum(w)
    mean = F.when(inner > 0, F.sum(F.when(F.col("inside"), v * w)) / inner).otherwise(F.sum(v * w) / whole)
    return band.groupBy(*keys).agg(F.coalesce(mean, F.lit(default)).alias(out))


def cross_fill(df: DataFrame, key: str, value: str, pair: tuple[str, str] = ("F", "D")) -> DataFrame:
    """Two groups side by side, each taking the other's value where its own is not there."""
    a, b = (F.max(F.when(F.col(key) == p, F.col(value))) for p in pair)
    return df.agg(F.coalesce(a, b).alias(pair[0]), F.coalesce(b, a).alias(pair[1]))


def grouping_sets(df: DataFrame, dimensions: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One grouping by each dimension alone, with ``group_by`` naming it; null values of a dimension are a group."""
    return df.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(F.array(*[F.lit(d) for d in dimensions])[_which(dimensions)].alias("group_by"), *aggregates)


def grouping_set_quantiles(df: DataFrame, dimensions: Sequence[str], value: str, columns: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of one grouping by each dimension alone, all placed together: a row stands once for each
    dimension, and no group is held by a task. Keys as ``grouping_sets`` gives them: ``group_by`` and the dimensions."""
    own = lambda d, c: F.col(d) if c == d else F.lit(None).cast(df.schema[c].dataType)
    sets = F.array(*[F.struct(F.lit(d).alias("group_by"), *[own(d, c).alias(c) for c in dimensions]) for d in dimensions])
    return quantile_columns(df.select(F.col(value), F.inline(sets)), ["group_by", *dimensions], value, columns)


def _which(dimensions: Sequence[str]) -> Column:
    out = F.lit(0)
    for i, d in enumerate(dimensions):
        out = F.when(F.grouping(d) == 0, F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of [low, high]; values beyond are clipped, the last bin is closed."""
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value)))
    b = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def corr_top_pairs(df: DataFrame, columns: Sequence[str], k: int = 12) -> DataFrame:
    """Pearson correlation of each pair of columns over rows that have both, the strongest first. One aggregation."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    long = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(long)).where("r is not null").orderBy(F.abs("r").desc(), "a", "b").limit(k)


def share(flag: Column) -> Column:
    """Percentage of rows for which the flag holds."""
    return F.avg(flag.cast("double")) * 100


def quantile_share(value: Column, weights: Column) -> Column:
    """How many equal weights these are worth: 1 / Σ (w/Σw)²."""
    return F.pow(F.sum(weights), 2) / F.nullif(F.sum(weights * weights), F.lit(0.0))


def iqr(value: Column, least: int = 4) -> Column:
    """The middle half's width, null of fewer than ``least`` values."""
    return F.when(F.count(value) >= least, F.percentile(value, 0.75) - F.percentile(value, 0.25))


def ape(actual: Column, predicted: Column) -> Column:
    """Absolute percentage error, null for an actual of zero."""
    return F.abs(actual - predicted) / F.nullif(F.abs(actual), F.lit(0.0))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """N rows by a seeded hash of the key; the same rows every time, whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def pass_rates(df: DataFrame, error: str, multiples: Sequence[float] = (1, 2), keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose error is within each multiple of the mean error over all rows."""
    mean = df.agg(F.avg(error).alias("_mae"))
    rows = df.crossJoin(F.broadcast(mean))
    rates = [F.avg((F.col(error) <= F.col("_mae") * m).cast("double")).alias(f"within_{m:g}x") for m in multiples]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *rates)


def weighted_mse(actual: str, predicted: str, weight: str) -> Column:
    """G27."""
    e = F.col(actual) - F.col(predicted)
    return F.sum(F.col(weight) * e * e) / F.greatest(F.lit(1e-9), F.sum(weight))


def wls_slope(x: Column, y: Column, w: Column, least: int = 3) -> Column:
    """Weighted least squares slope in closed form, null of fewer rows than ``least`` or no spread."""
    ok = x.isNotNull() & y.isNotNull() & w.isNotNull()
    x, y, w = (F.when(ok, v.cast("double")) for v in (x, y, w))
    n, sw, sx, sy = F.count(x), F.sum(w), F.sum(w * x), F.sum(w * y)
    below = sw * F.sum(w * x * x) - sx * sx
    return F.when((n >= least) & (F.abs(below) > 1e-12), (sw * F.sum(w * x * y) - sx * sy) / F.nullif(below, F.lit(0.0)))


def wls_slope_window(df: DataFrame, year: str, x: str, y: str, window: int = 3, out: str = "slope", targets: DataFrame | None = None) -> DataFrame:
    """For each year the slope over it and the years before, the latest weighing most (1, 2, 3). Rows are
    replicated to the years they serve, a fixed number, and grouped: no self-join."""
    served = df.withColumn("_ahead", F.explode(F.array(*[F.lit(i) for i in range(window)])))
    served = served.withColumn("target", F.col(year) + F.col("_ahead")).withColumn("_w", F.lit(window) - F.col("_ahead"))
    known = (targets if targets is not None else df.select(F.col(year).alias("target"))).distinct()
    rows = served.join(F.broadcast(known) if targets is None else known, "target", "left_semi")
    return rows.groupBy("target").agg(wls_slope(F.col(x), F.col(y), F.col("_w")).alias(out))


def outlier_reasons(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, joined; null if none does."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return F.when(F.size(found) > 0, F.array_join(found, ";"))


def any_flag(flag: Column) -> Column:
    """G14."""
    return F.coalesce(F.bool_or(flag), F.lit(False))


def first_non_blank(value: str, order: str) -> Column:
    """G15."""
    return F.min_by(F.nullif(F.trim(value), F.lit("")), F.when(F.trim(value) != "", F.col(order)))


def mode_stable(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def exact_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """The two sorted distinct values of each key that has exactly two."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("pair")).where(F.size("pair") == 2)


def list_scalars(df: DataFrame, columns: Sequence[str], quantiles_at: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """One row with the number of values and the quantiles of each column, exact; the columns are keys of one call, so
    all are placed together and none is held by a task."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])))
    found = quantiles(long, ["_column"], "_value", quantiles_at)
    pick = lambda c, q: F.max(F.when((F.col("_column") == c) & (F.col("q") == float(q)), F.col("quantile")))
    wide = found.agg(*[pick(c, q).alias(f"{c}_p{round(100 * q)}") for c in columns for q in quantiles_at])
    return df.agg(*[F.count(c).alias(f"{c}_n") for c in columns]).crossJoin(F.broadcast(wide))


def minutes_by_member(df: DataFrame, members: str, amount: str, out: str = "total") -> DataFrame:
    """An amount summed for each member of a list column."""
    return df.select(F.explode(members).alias("member"), amount).groupBy("member").agg(F.sum(amount).alias(out))


def pair_key(a: Column, b: Column) -> Column:
    """Two values in one order."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))
