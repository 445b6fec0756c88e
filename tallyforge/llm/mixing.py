"""Mixing sources to target weights: hash-random order, range sort within a source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

#: Fixed values of the mixing contract: the weights of the sources in code point order, again and again, and the share of all words to deal out.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BROADCAST_SOURCES = 100_000


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo, hi, block in V.blocks(batch.column(2)):
        yield R.record(id=batch.column(0).slice(lo, hi - lo), source=batch.column(1).slice(lo, hi - lo), size=V.per_doc(block.words()[2], hi - lo))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): the words of each whole text, none for null."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return R.map_arrow(rows, _count, f"id {kind}, source string, size long")


def running(df: DataFrame, order: list, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Prefix sums over a total order, over any number of tasks: range partition and cut, sum each partition, then add
    the sums of the partitions before. ``out`` is the sum of ``value`` over all rows before a row. The driver holds one
    number for each partition, never a row."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = R.cut(df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()))
    before, offsets = 0, []
    for p, total in sorted(dealt.groupBy("part_").agg(F.sum(value)).collect()):
        offsets.append((p, before))
        before += total or 0
    offsets = spark.createDataFrame(offsets, "part_ int, offset_ long")
    inside = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "part_").withColumn(out, F.col(out) + F.col("offset_")).drop("part_", "offset_")


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target). Sources in code point order, null last, take the weights in turn. Targets are in
    proportion to the weights and stop at ``most`` times the source's size; what is over goes to the others by weight,
    until none is above. The driver holds three sums a round, never a source."""
    ranked = source_sizes.withColumn("one_", F.lit(1)).withColumn("last_", F.col("source").isNull().cast("int"))
    ranked = running(ranked, [F.col("last_"), F.col("source")], "one_", "rank", 1 if source_sizes.count() < 10_000 else None)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = R.cut(ranked.withColumn("weight", pick.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double")))
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, None
    while True:  # a source once over its cap stays there: the level only rises
        is_open = F.lit(True) if closed is None else F.col("weight") * closed <= F.col("cap")
        rest, weight, n = ranked.agg(F.coalesce(F.sum(F.when(~is_open, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(is_open, F.col("weight"))), F.lit(0.0)), F.count(F.when(is_open, 1))).first()
        if not n or not weight:
            break
        level = (wanted - rest) / weight
        if closed is not None and level <= closed:
            break
        closed = level
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row for each document: the id, size, source_size, target (its source's) and taken, the words that the mix takes.

    Each source's whole epochs are taken first; the rest of its budget, the target rounded down, goes to documents in
    the order of an md5 of seed and id, and the document at the cut is taken in part, so a source's taken words equal
    its budget exactly and no document exceeds ``most`` times its size. Null text has size 0, very long texts are counted whole, null source is a source of
    its own, null ids and repeated rows are rows like others (equal rows may be told apart only by their place in the
    order, so reruns return the same rows), an empty table gives an empty result, and other columns are ignored.
    One source may hold any share of the rows: the order is cut over all tasks by range, not by source.
    """
    rows = sizes(docs, id_col, text_col, source_col).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    spread = running(rows, [F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("size")], "size", "before")
    spread = R.cut(spread)
    by_source = spread.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("first"))
    aim = targets(by_source.select("source", "source_size"), weights, share, most)
    aim = aim.join(by_source.select(F.col("source").alias("s_"), "first"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumnRenamed("source", "source_")
    budget, size = F.floor("target"), F.greatest(F.col("source_size"), F.lit(1))
    left = budget - F.floor(budget / size) * F.col("source_size") - (F.col("before") - F.col("first"))
    taken = F.floor(budget / size) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    aim = R.cut(aim)
    # few sources are sent to every task; beyond the limit both sides are shuffled by source, and a hot one is split
    aim = F.broadcast(aim) if aim.count() <= BROADCAST_SOURCES else aim
    out = spread.join(aim, F.col("source").eqNullSafe(F.col("source_")), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
