"""Uniform sharding with exact shard sizes: a hypergeometric communication matrix, a local permutation, one exchange, and
a permutation inside the shards, in DataFrame operations only.

How many rows of each partition go to each shard is drawn from the law that a uniform shuffle of all rows would give,
one partition and shard after the other.  Rows are permuted inside their partition and cut at those counts; that
exchange and a second permutation inside each shard together make every assignment and order equally likely.  The driver
holds the matrix, which is bounded by the number of partitions it is drawn for, and never a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R

SHARDS = 24
MOST_PARTITIONS = 4096  # rows of the matrix at most: with 24 shards it has 98,304 numbers
ROW_BITS = 33  # monotonically_increasing_id keeps the row's number in its partition in so many low bits
REACH = 40  # deviations of the hypergeometric law that are looked at; beyond lies less than 1e-300 of it


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` from ``good`` and ``bad`` are good. Probabilities go from the mode outwards by their exact
    ratios and are normalised by their sum, so no size is too large; all are looked at that a double can tell from none."""
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    total = good + bad
    mode = min(max((good + 1) * (drawn + 1) // (total + 2), least), most)
    share = good / total
    reach = int(REACH * np.sqrt(drawn * share * (1 - share) * max(total - drawn, 1) / max(total - 1, 1))) + REACH
    up = np.arange(mode, min(most, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(least, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    below = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    at = int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right"))
    return mode - len(below) + min(at, len(weight) - 1)


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart; the first shards have the one more."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """A draw of the communication matrix: rows sum to the counts of the partitions, columns to the sizes of the shards."""
    rng = np.random.default_rng(seed)
    left, out = list(sizes), []
    for n in counts:
        row, rest, wanted = [], sum(left), n
        for s, room in enumerate(left):
            rest -= room
            k = hypergeometric(rng, room, rest, wanted)
            row.append(k)
            left[s] -= k
            wanted -= k
        out.append(row)
    return out


def _row_number() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = 0, most_partitions: int = MOST_PARTITIONS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The rows with ``shard``, 0 to ``shards`` - 1, and ``slot``, their place in it from 0 without gaps; both replace
    columns of their names. Shards' counts are at most one apart, and every assignment and order is equally likely.

    The random keys hash the place of a row and the seed, never its values, so repeated rows and ties are dealt
    independently and nulls, empty and very long texts are rows like others; the same table read in the same partitions
    is dealt in the same way. An empty table gives an empty result. Rows move once for the exchange, so select the
    columns that are wanted; of the texts themselves only those that are asked for move. Each row's place is stored
    before it is used, so a lost executor changes nothing. No task holds a shard: the exchange is a range sort by shard
    and random key over any number of tasks, and slots are row numbers of the sorted partitions plus offsets.
    """
    spark = df.sparkSession
    part, rank, key, home, at = (R.unused(df, c) for c in ("part_", "rank_", "key_", "home_", "at_"))
    own = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    place = F.monotonically_increasing_id()
    # permuted locally: sorted by a random key, each row's number in its partition is its place in a uniform permutation
    with R.Scratch(spark) as scratch:
        keyed = df.select(*own).coalesce(most_partitions).withColumn(key, F.xxhash64(F.lit(seed), place)).withColumn(home, F.spark_partition_id())
        local = scratch.stored(keyed.sortWithinPartitions(key).withColumn(rank, _row_number()), "permuted")
        counts = sorted((p, n) for p, n in local.groupBy(home).count().collect())
        sizes = shard_sizes(sum(n for _, n in counts), shards)
        drawn = matrix([n for _, n in counts], sizes, seed)
        edges = [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, drawn, strict=True)]
        cuts = spark.createDataFrame(edges, f"{home} int, {at} array<long>")
        # the shard is the first whose running count is beyond the row's place
        dealt = local.join(F.broadcast(cuts), home).withColumn(shard, F.size(F.filter(at, lambda x: x <= F.col(rank))))
        # exchanged, and permuted again: one total order by shard and a second key, cut by range
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.withColumn(key, F.xxhash64(F.lit(seed + 1), F.col(home), F.col(rank))).drop(home, rank, at)
        order = [F.col(shard), F.col(key)]
        ranged = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), at: _row_number()})
        ranged = R.stored(ranged.drop(key), "sharded")
    before, offsets = 0, []
    for p, rows in sorted((p, rows) for p, rows in ranged.groupBy(part).count().collect()):
        offsets.append((p, before))
        before += rows
    first = [0, *np.cumsum(sizes).tolist()]
    offsets = spark.createDataFrame(offsets, f"{part} int, {rank} long")
    starts = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in first[:shards]]), F.col(shard) + 1)
    out = ranged.join(F.broadcast(offsets), part).withColumn(slot, F.col(rank) + F.col(at) - starts)
    return out.select(*own, shard, slot)


def write(df: DataFrame, folder: str, shards: int = SHARDS, seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The shuffled rows as Parquet, a folder for each shard, whose files hold neighbouring slots in their order; returns
    them read back. Nulls, ties, repeats and empty tables are dealt with as by ``shuffle``."""
    spark = df.sparkSession
    out = shuffle(df, shards, seed, shard=shard, slot=slot)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(n, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row for each document: the id, size (UTF-8 bytes of the text and 8), text_crc32, law ``rows``, shard, slot, and
    grown_shard, null as this law names none. Null texts have no bytes, so size 8 and the checksum 0; other cases as in
    ``shuffle``. Only ids, sizes and checksums move."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shuffle(narrow, shards, seed)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
