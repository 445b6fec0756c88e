"""Windows over ordered rows: ranks, percentiles, running and next values, dedupe, adjacent ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1, 2, 3 in the order given, ties told apart by it."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in the order (for the last, order downwards)."""
    return rank_first(df, keys, order, "_rank").where("_rank = 1").drop("_rank")


def dedupe_by(df: DataFrame, parts: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row for each composite key, the first in the order. Parts are compared as text, nulls as empty."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return keep_first(df.withColumn("_key", key), ["_key"], order).drop("_key")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """O3: the first k rows of each key."""
    return rank_first(df, keys, order, out).where(F.col(out) <= k)


def pct_rank_avg(df: DataFrame, keys: Sequence[str], value: str, out: str, mask: Column | None = None, digits: int | None = 1) -> DataFrame:
    """Percentile rank with average ties, times 100; rows outside the mask, or without a value, get null and do
    not count. Three window functions over two sorts."""
    x = F.when(mask, F.col(value)) if mask is not None else F.col(value)
    df = df.withColumn("_x", x)
    rank = F.rank().over(Window.partitionBy(*keys, F.col("_x").isNull()).orderBy("_x"))
    ties = F.count("_x").over(Window.partitionBy(*keys, "_x"))
    n = F.count("_x").over(Window.partitionBy(*keys))
    pct = 100.0 * (rank + (ties - 1) / 2.0) / n
    return df.withColumn(out, F.when(F.col("_x").isNotNull(), F.bround(pct, digits) if digits is not None else pct)).drop("_x")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """W3, W10."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def next_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """The next value that is not null, after this row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def back_to_back(df: DataFrame, key: str, day: str, out: str = "b2b", distinct: bool = True) -> DataFrame:
    """1 where the day before is there too. Days of a key are made distinct first; ``distinct=False`` keeps the
    behaviour in which a repeated day hides the one before."""
    rows = df.select(key, day).distinct() if distinct else df
    before = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    return rows.withColumn(out, F.coalesce((F.datediff(F.col(day), before) == 1).cast("int"), F.lit(0)))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """W7."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns})


def adjacent_ratio(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "ratio", tail: str = "tail_ratio") -> DataFrame:
    """The next value over this one, and the last such ratio of the key."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn(out, F.lead(value).over(w) / F.nullif(F.col(value).cast("double"), F.lit(0.0)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(tail, F.last(out, ignorenulls=True).over(whole))


def over_peak(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """W12."""
    return df.withColumn(out, F.col(value) / F.max(value).over(Window.partitionBy(*keys)))


def centred(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Less the mean of the keys, or of all rows. The mean over all rows comes from an aggregate of one row, not
    from a window without keys, which would take every row to one task."""
    if keys:
        return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    return df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_mean")))).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """W15."""
    return df.withColumn(out, F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*keys)).cast("double"), F.lit(0.0)))


def last_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W9 by aggregation: the row of the greatest order, with map-side combining and no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
