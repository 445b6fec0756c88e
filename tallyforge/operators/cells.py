"""Neighbours among many rows: boxes of a tree over the space, judged block by block in numpy.

Distances are sums over parts of Euclidean distances of scaled vectors; a part that either side lacks counts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.sources import sinks

MOST_CELLS = 16_384  # boxes whose cuts the driver and each task hold
SAMPLED = 32  # rows a box by which the cuts are placed
MOST_NUMBERS = 4_000_000  # of a sample on the driver
MOST_ASKED = 20_000  # targets that one task meets with a block at a time
AT_ONCE = 2_000_000  # distances in memory
PLACE = ["_scope", "_parts", "_cell"]
Scale = tuple[int, np.ndarray | None]  # the length of a part's vectors, and by what they are multiplied


def vectors(table: pa.Table | pa.RecordBatch, scales: Mapping[str, Scale]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which parts a row has, as bits; for each part the scaled vectors, NaN where there is none)."""
    bits, out = np.zeros(table.num_rows, np.int64), []
    for i, (name, (width, scale)) in enumerate(scales.items()):
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        there = column.is_valid().to_numpy(zero_copy_only=False)
        flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
        x = np.full((len(there), width), np.nan)
        if len(flat):
            x[there] = flat.reshape(-1, width) @ scale.T if scale is not None else flat.reshape(-1, width)
        bits |= there.astype(np.int64) << i
        out.append(x)
    return bits, out


@dataclass
class Tree:
    """Cuts of the space by medians of a sample, and the boxes that they leave."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, depth: int) -> Tree:
        d = x.shape[1]
        axis, cut = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        low, high = np.full((2**depth, d), -np.inf), np.full((2**depth, d), np.inf)

        def split(node: int, level: int, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            if level == depth:
                low[node - 2**depth + 1], high[node - 2**depth + 1] = lo, hi
                return
            mine = x[rows]
            j = int(np.argmax(np.nan_to_num(mine.std(axis=0)))) if len(rows) else 0
            at = float(np.median(mine[:, j])) if len(rows) else 0.0
            axis[node], cut[node] = j, at
            right = mine[:, j] > at
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[j], right_lo[j] = min(hi[j], at), max(lo[j], at)
            split(2 * node + 1, level + 1, rows[~right], lo, left_hi)
            split(2 * node + 2, level + 1, rows[right], right_lo, hi)

        split(0, 0, np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf))
        return Tree(axis, cut, depth, low, high)

    def place(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _together(parts: Sequence[np.ndarray], bits: int) -> np.ndarray:
    return np.concatenate([x for i, x in enumerate(parts) if bits >> i & 1] or [np.zeros((len(parts[0]), 0))], axis=1)


def fit(mine: DataFrame, scales: Mapping[str, Scale], pool_id: str, block: int) -> tuple[dict[tuple[str, int], Tree], list[int]]:
    """(a tree for each scope and set of parts that has more than ``block`` rows, the sets of parts that occur). The cuts
    come from a sample by hash; every row is placed by them, and boxes hold whatever the sample was."""
    sizes = mine.groupBy("_scope", "_parts").agg(F.count(F.lit(1)).alias("n"))
    sizes = sinks.cut(sizes)
    patterns = [r[0] for r in sizes.select("_parts").distinct().collect()]
    large = sizes.where(F.col("n") > block)
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return {}, patterns
    most = max(block, -(-2 * total // MOST_CELLS))
    rows = {(r["_scope"], r["_parts"]): r["n"] for r in large.where(F.col("n") > most).collect()}
    if not rows:
        return {}, patterns
    width = sum(n for n, _ in scales.values())
    wanted = max(1, min(SAMPLED * max(1, total // most), MOST_NUMBERS // max(1, width)))
    step = max(1, total // wanted)
    keys = mine.sparkSession.createDataFrame(list(rows), "_scope string, _parts long")
    sample = mine.where(F.pmod(F.xxhash64(F.lit(7), F.col(pool_id)), F.lit(step)) == 0).join(F.broadcast(keys), ["_scope", "_parts"]).select("_scope", "_parts", *scales).toArrow()
    _, x = vectors(sample, scales)
    scope, parts = np.array(sample.column("_scope").to_pylist(), dtype=object), sample.column("_parts").to_numpy()
    trees = {}
    for (s, p), n in rows.items():
        on = np.flatnonzero((scope == s) & (parts == p))
        if p and len(on):
            trees[s, p] = Tree.fit(_together([a[on] for a in x], p), max(1, int(np.ceil(np.log2(n / most)))))
    return trees, patterns


def _groups(scope: list, bits: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
    names, code = np.unique(np.array(scope, dtype=str), return_inverse=True)
    for s, name in enumerate(names):
        for p in np.unique(bits[code == s]):
            yield str(name), int(p), np.flatnonzero((code == s) & (bits == p))


def _between(a: list[np.ndarray], b: list[np.ndarray], bits: int) -> tuple[np.ndarray, float]:
    """All distances, and how much they may be off."""
    out, off = np.zeros((len(a[0]), len(b[0]))), 1e-12
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not bits >> i & 1:
            continue
        off += 1e-12 * float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
        if x.shape[1] <= 8:
            square = np.zeros_like(out)
            for j in range(x.shape[1]):
                square += np.subtract.outer(x[:, j], y[:, j]) ** 2
        else:
            centre = y.mean(axis=0)
            x, y = x - centre, y - centre
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            square = np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0)
            off += 1e-6 * float(np.sqrt(max(xx.max(initial=0), yy.max(initial=0))))
        out += np.sqrt(square)
    return out, off


def near(targets: DataFrame, mine: DataFrame, target_id: str, pool_id: str, scaled: Mapping[str, np.ndarray | None], k: int, but_itself: bool, block: int, counts: list | None = None) -> DataFrame:
    """(_who, the columns of ``mine`` but its ``_`` ones): for each target its k nearest rows of its ``_scope``, ties and some others.

    Both sides have ``_scope`` and the vectors. Of rows with equal vectors those with the k least ids stand for all. Rows lie
    in boxes of some ``block`` rows. A target first meets the box that it lies in, which bounds its radius; then those other
    boxes that its radius touches. A box with its targets is a task's work; one that holds too many is split by hash."""
    names = list(scaled)
    kept = [c for c in mine.columns if c != "_scope"]
    copies = F.dense_rank().over(Window.partitionBy("_scope", *names).orderBy(pool_id))
    mine = mine.withColumn("_copy", copies).where(F.col("_copy") <= k + int(but_itself)).drop("_copy")
    mine = mine.withColumn("_parts", sum([F.when(F.col(n).isNotNull(), F.lit(1 << i)).otherwise(0) for i, n in enumerate(names)], F.lit(0)).cast("long"))
    mine = sinks.cut(mine.withColumn("_scope", F.col("_scope").cast("string")))
    widths = mine.agg(*[F.coalesce(F.max(F.size(n)), F.lit(0)).alias(n) for n in names]).first()
    scales = {n: (max(0, widths[n]), scaled[n]) for n in names}
    trees, patterns = fit(mine, scales, pool_id, block)
    sent = mine.sparkSession.sparkContext.broadcast(trees)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, x = vectors(batch, scales)
            cell = np.zeros(batch.num_rows, np.int32)
            for s, p, on in _groups(batch.column("_scope").to_pylist(), bits):
                if (s, p) in sent.value:
                    cell[on] = sent.value[s, p].place(_together([a[on] for a in x], p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "_cell"])

    pool = sinks.cut(mine.mapInArrow(placed, StructType([*mine.schema.fields]).add("_cell", "integer")))
    sizes = pool.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n"))
    splits = sinks.small(sinks.cut(sizes.where(F.col("_n") > 4 * block).select(*PLACE, F.ceil(F.col("_n") / (2 * block)).cast("int").alias("_splits"))))
    pool = pool.join(splits, PLACE, "left").withColumn("_block", F.pmod(F.xxhash64(pool_id), F.coalesce("_splits", F.lit(1))).cast("int")).drop("_splits")
    asked = targets.select(F.col(target_id).alias("_who"), F.col("_scope").cast("string").alias("_scope"), *names)
    kind = StructType([*asked.schema.fields]).add("_radius", "double").add("_parts", "long").add("_cell", "integer")

    def visits(others: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits, x = vectors(batch, scales)
                rows, parts, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for s, own, on in _groups(batch.column("_scope").to_pylist(), bits):
                    for p in patterns:
                        tree = sent.value.get((s, p))
                        at = _together([a[on] for a in x], p)
                        home = tree.place(at) if tree is not None else np.zeros(len(on), np.int64)
                        if not others:
                            rows.append(on), parts.append(np.full(len(on), p)), cells.append(home)
                        elif tree is not None:
                            radius = batch.column("_radius").to_numpy(zero_copy_only=False)[on]
                            step = max(1, AT_ONCE // max(1, tree.low.size))
                            for lo in range(0, len(on), step):
                                some, bound, column = slice(lo, lo + step), 0.0, 0
                                for i, a in enumerate(x):
                                    if not p >> i & 1:
                                        continue
                                    width = a.shape[1]
                                    if own >> i & 1:
                                        part = a[on[some]][:, None, :]
                                        low, high = tree.low[None, :, column : column + width], tree.high[None, :, column : column + width]
                                        bound = bound + np.sqrt((np.maximum(np.maximum(low - part, part - high), 0) ** 2).sum(axis=2))
                                    column += width
                                r = radius[some] * (1 + 1e-9) + 1e-9
                                touched = ~(np.broadcast_to(bound, (len(r), len(tree.low))) > r[:, None])
                                touched[np.arange(len(r)), home[some]] = False
                                i, j = np.nonzero(touched)
                                rows.append(on[some][i]), parts.append(np.full(len(i), p)), cells.append(j)
                all_rows, all_parts, all_cells = np.concatenate(rows), np.concatenate(parts), np.concatenate(cells)
                for lo in range(0, len(all_rows), 20_000):
                    part = slice(lo, lo + 20_000)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(all_rows[part])).columns, pa.array(all_parts[part].astype(np.int64)), pa.array(all_cells[part].astype(np.int32))], [*batch.schema.names, "_parts", "_cell"])

        return go

    out = StructType([asked.schema["_who"], *[mine.schema[c] for c in kept]]).add("_d", "double")
    columns = out.names
    key = [*PLACE, "_block", "_turn"]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: (left if c == "_who" else right)[c].slice(0, 0) for c in columns[:-1]} | {"_d": pa.array([], pa.float64())})
        bits, x = vectors(left, scales)
        have, y = vectors(right, scales)
        who, other = (np.array(t.column(c).to_pylist(), dtype=object) if but_itself else None for t, c in ((left, "_who"), (right, pool_id)))
        radius = left.column("_radius").to_numpy()
        rows, cols, far = [], [], []
        for own in np.unique(bits):
            both, on = int(own) & int(have[0]), np.flatnonzero(bits == own)
            step = max(1, AT_ONCE // right.num_rows)
            for lo in range(0, len(on), step):
                some = on[lo : lo + step]
                d, off = _between([a[some] for a in x], y, both)
                if but_itself:
                    d[who[some][:, None] == other[None, :]] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(some), np.inf)
                i, j = np.nonzero(~(d > (np.minimum(last, radius[some]) * (1 + 1e-9) + 4 * off)[:, None]))
                exact = np.zeros(len(i))
                for n, (a, b) in enumerate(zip(x, y, strict=True)):
                    if both >> n & 1:
                        exact += np.sqrt(((a[some[i]] - b[j]) ** 2).sum(axis=1))
                rows.append(some[i]), cols.append(j), far.append(exact)
        i, j = np.concatenate(rows), np.concatenate(cols)
        left_rows, right_rows = left.select(["_who"]).take(pa.array(i)), right.select(kept).take(pa.array(j))
        return pa.Table.from_arrays([left_rows.column(0), *right_rows.columns, pa.array(np.concatenate(far))], names=columns)

    def judged(visited: DataFrame) -> DataFrame:
        visited = sinks.cut(visited)
        asks = visited.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n"))
        turns = sinks.small(sinks.cut(asks.where(F.col("_n") > MOST_ASKED).select(*PLACE, F.ceil(F.col("_n") / MOST_ASKED).cast("int").alias("_turns"))))
        left = visited.join(splits, PLACE, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))).drop("_splits")
        left = left.join(turns, PLACE, "left").withColumn("_turn", F.pmod(F.xxhash64("_who"), F.coalesce("_turns", F.lit(1))).cast("int")).drop("_turns")
        right = pool.join(turns, PLACE, "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.coalesce("_turns", F.lit(1)) - 1))).drop("_turns")
        if counts is not None:
            counts.append(left.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).join(right.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key).agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0)
        return sinks.cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(judge, out))

    first = judged(asked.withColumn("_radius", F.lit(float("inf"))).mapInArrow(visits(False), kind))
    place = F.row_number().over(Window.partitionBy("_who").orderBy("_d"))
    own = first.where(F.col("_who") != F.col(pool_id)) if but_itself else first
    radius = own.withColumn("_place", place).where(F.col("_place") == k).select(F.col("_who").alias("_of"), F.col("_d").alias("_radius"))
    again = asked.join(radius, F.col("_who").eqNullSafe(F.col("_of")), "left").withColumn("_radius", F.coalesce("_radius", F.lit(float("inf")))).drop("_of")
    found = first.unionByName(judged(again.select(*asked.columns, "_radius").mapInArrow(visits(True), kind))).drop("_d")
    return found
