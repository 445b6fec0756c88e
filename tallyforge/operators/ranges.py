"""Row numbers, running sums and carried values over whole tables, without a window that has no keys.

Rows are cut by range over any number of tasks; each task works on its own, and what lies before it is added.  The driver
holds one value for each task, never a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources import sinks

ROW_BITS = 33  # monotonically_increasing_id keeps a row's number in its partition in so many low bits


def _ranged(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """The rows with their task ``_part`` and number in it ``_at``, cut, so that every later pass meets the same tasks."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return sinks.cut(dealt.withColumns({"_part": F.spark_partition_id(), "_at": place}))


def _before(rows: DataFrame, total: Column, add) -> DataFrame:
    """(part, before): ``add`` over the totals of the parts before, null where there is none."""
    sums = rows.groupBy("_part").agg(total.alias("v"))
    out, before = [], None
    for part, v in sorted(sums.collect(), key=lambda r: r[0]):
        out.append((part, before))
        before = v if before is None else before if v is None else add(before, v)
    kind = sums.schema["v"].dataType.simpleString()
    return F.broadcast(rows.sparkSession.createDataFrame(out, f"_part int, _before {kind}"))


def numbered(df: DataFrame, order: Sequence[Column], out: str, partitions: int | None = None) -> DataFrame:
    """The rows numbered from 0 in a total order; rows that it does not tell apart are numbered in any order."""
    rows = _ranged(df, order, partitions)
    before = _before(rows, F.count(F.lit(1)), lambda a, b: a + b)
    return rows.join(before, "_part").withColumn(out, F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_before")


def prefix_sums(df: DataFrame, order: Sequence[Column], value: str, out: str, inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """The sum of ``value`` up to each row of a total order, or before it. Nulls add nothing; a sum of nothing is 0."""
    rows = _ranged(df, order, partitions)
    before = _before(rows, F.sum(value), lambda a, b: a + b)
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    run = rows.withColumn("_inside", F.sum(value).over(w)).join(before, "_part")
    return run.withColumn(out, F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_before", "_inside")


def carried(df: DataFrame, order: Sequence[Column], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """The last value that is not null at or before each row of a total order; null before the first."""
    rows = _ranged(df, order, partitions)
    before = _before(rows, F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))), lambda a, b: b)
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_own", F.last(value, ignorenulls=True).over(w)).join(before, "_part")
    return run.withColumn(out, F.coalesce("_own", "_before")).drop("_part", "_at", "_before", "_own")
