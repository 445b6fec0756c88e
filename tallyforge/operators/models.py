"""Models: logistic regression, ridge by Gram matrices, cross validation, standardising."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import ranges
from tallyforge.sources import sinks

GRID = (0.0, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5)


@dataclass
class Logit:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def table(self, spark):
        return spark.createDataFrame([*zip(self.features, self.coefficients, strict=True), ("intercept", self.intercept)], "feature string, coef double")


def fit_logit(df: DataFrame, features: Sequence[str], label: str, c: float = 10.0) -> Logit | None:
    """L2 logistic regression; ``c`` is the inverse strength over the sum of losses. None without both labels."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")).na.drop()
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not good or good == n:
        return None
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(rows))
    return Logit(list(features), [float(x) for x in model.coefficients], float(model.intercept))


def score_logit(df: DataFrame, model: Logit | None, out: str = "xG", when: Column | None = None) -> DataFrame:
    """R2: the probability as a column expression; 0 outside ``when`` or without a model; null where a feature is."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    z = F.lit(model.intercept)
    for f, w in zip(model.features, model.coefficients, strict=True):
        z = z + F.col(f).cast("double") * w
    p = 1 / (1 + F.exp(-z))
    return df.withColumn(out, p if when is None else F.when(when, p).otherwise(0.0))


def _dealt(load: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size go to each fold, each to the lightest, of equal ones to the first: those
    with the ``count`` least numbers load + j·size."""
    low, high = min(load), min(load) + size * (count + 1)
    taken = lambda level: [max(0, -(-(level - x) // size)) for x in load]  # noqa: E731  numbers under the level
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(taken(middle)) <= count else (low, middle)
    out = taken(low)
    for i, x in enumerate(load):  # numbers at the level, in the order of the folds
        if sum(out) < count and (low - x) >= 0 and (low - x) % size == 0:
            out[i] += 1
    return out


def balanced_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A fold for each group: by size downwards, then by id, each to the lightest fold.

    Groups of one size are dealt in closed form: the lightest folds take the least of the numbers load + j·size. So the
    driver holds the distinct sizes and ``k`` loads, and a group's fold is that of its number among those of its size;
    the numbers come by range, and both sides are joined."""
    spark = df.sparkSession
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    groups = ranges.numbered(groups, [F.col("_n").desc(), F.col(group)], "_place")
    classes = groups.groupBy("_n").agg(F.count(F.lit(1)).alias("m"), F.min("_place").alias("first")).orderBy(F.col("_n").desc()).collect()
    load, rows = [0] * k, []
    for size, count, first in classes:
        taken = _dealt(load, size, count)
        rows += [(size, first, list(load), i, n) for i, n in enumerate(taken) if n]
        load = [x + n * size for x, n in zip(load, taken, strict=True)]
    dealt = spark.createDataFrame(rows, "_n long, first long, loads array<long>, fold int, taken long")
    turn = dealt.select("_n", "first", "loads", "fold", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("j"))
    number = F.get("loads", F.col("fold")) + F.col("j") * F.col("_n")
    before = F.lit(0).cast("long")
    for i in range(k):  # groups that go to fold i before this one
        gap = number - F.get("loads", F.lit(i))
        smaller = F.when(gap > 0, F.ceil(gap / F.col("_n"))).otherwise(0)
        before = before + F.when(F.col("fold") == i, F.col("j")).otherwise(smaller + F.when((F.lit(i) < F.col("fold")) & (gap >= 0) & (gap % F.col("_n") == 0), 1).otherwise(0))
    turn = turn.select((F.col("first") + before).cast("long").alias("_place"), "fold")
    return groups.join(turn, "_place").select(group, "fold")


def gram(long: DataFrame, row: Sequence[str], feature: str, value: str, weight: str, target: str, fold: str, features: int) -> DataFrame:
    """(fold, i, j, s): sums of w·x·x', w·x·y, w·y·y and w for each fold, from long rows (row, feature, value),
    i <= j. Feature -1 is the target and -2 the constant. Rows of a task are laid out densely a thousand at a time and
    multiplied in numpy, and each task sends one triangle for each fold, so that nothing is expanded into pairs of
    features; a task holds folds times features squared numbers (2,000 features: 32 MB a fold)."""
    cells = F.collect_list(F.struct(F.col(feature).cast("int").alias("f"), F.col(value).cast("double").alias("v")))
    rows = long.groupBy(*row, fold).agg(cells.alias("xs"), F.first(weight).cast("double").alias("w"), F.first(target).cast("double").alias("y"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                lists = batch.column(1)
                edge = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.flatten()
                x = np.zeros((batch.num_rows, features + 2))
                at = np.repeat(np.arange(batch.num_rows), np.diff(edge[: batch.num_rows + 1]))
                np.add.at(x, (at, flat.field(0).to_numpy(zero_copy_only=False) + 2), flat.field(1).to_numpy(zero_copy_only=False))
                x[:, 0], x[:, 1] = 1.0, batch.column(3).to_numpy(zero_copy_only=False)
                w, folds = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
                for k in np.unique(folds):
                    on = folds == k
                    sums[int(k)] = sums.get(int(k), 0) + (x[on] * w[on, None]).T @ x[on]
        for k, g in sums.items():
            i, j = np.nonzero(np.triu(g))
            yield pa.RecordBatch.from_pydict({"fold": np.full(len(i), k, np.int32), "i": (i - 2).astype(np.int32), "j": (j - 2).astype(np.int32), "s": g[i, j]})

    out = rows.select(F.col(fold).cast("int").alias("fold"), "xs", "w", "y").mapInArrow(partial, "fold int, i int, j int, s double")
    return out.groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))


class Normal:
    """Normal equations of ridge with a free intercept, from summed Grams: a whole matrix, or its cells by (i, j)."""

    def __init__(self, sums: dict[tuple[int, int], float] | np.ndarray, features: int):
        self.p = features
        g = sums
        if isinstance(sums, dict):
            g = np.zeros((features + 2, features + 2))
            for (i, j), s in sums.items():
                g[i + 2, j + 2] = g[j + 2, i + 2] = s
        self.w, self.wy, self.wyy = g[0, 0], g[0, 1], g[1, 1]
        self.wx, self.xy, self.xx = g[0, 2:], g[1, 2:], g[2:, 2:]

    def solve(self, alpha: float) -> tuple[np.ndarray, float]:
        mean_x, mean_y = self.wx / self.w, self.wy / self.w
        a = self.xx - self.w * np.outer(mean_x, mean_x)
        b = self.xy - self.w * mean_x * mean_y
        beta = np.linalg.solve(a + alpha * np.eye(self.p), b) if alpha > 0 else np.linalg.lstsq(a, b, rcond=None)[0]
        return beta, float(mean_y - mean_x @ beta)

    def loss(self, beta: np.ndarray, intercept: float) -> float:
        """Weighted mean squared error of these sums' rows."""
        s = self.wyy - 2 * (beta @ self.xy + intercept * self.wy) + beta @ self.xx @ beta + 2 * intercept * (beta @ self.wx) + intercept**2 * self.w
        return float(max(s, 0.0) / max(1e-9, self.w))


def ridge_cv(long: DataFrame, row: Sequence[str], feature: str, value: str, weight: str, target: str, fold: str, grid: Sequence[float] = GRID, features: int | None = None) -> dict:
    """Losses by penalty over folds, the best (the first of equal ones, Q15), its fit on all rows, and a paired
    t-test of fold losses against no penalty. One aggregation serves every penalty and fold."""
    if features is None:
        features = (long.agg(F.max(feature)).first()[0] or 0) + 1
    if features > MOST_DENSE:
        return ridge_sparse(long, row, feature, value, weight, target, fold, grid, features=features)
    # the driver holds a dense matrix of features squared for each fold, filled from columns
    f, i, j, s = (c.to_numpy() for c in gram(long, row, feature, value, weight, target, fold, features).toArrow().columns)
    by_fold: dict[int, np.ndarray] = {}
    for k in sorted(set(f.tolist())):
        on, g = f == k, np.zeros((features + 2, features + 2))
        g[i[on] + 2, j[on] + 2] = g[j[on] + 2, i[on] + 2] = s[on]
        by_fold[k] = g
    total = sum(by_fold.values(), np.zeros((features + 2, features + 2)))
    losses = {a: [] for a in grid}
    for sums in by_fold.values():
        rest = Normal(total - sums, features)
        held = Normal(sums, features)
        for a in grid:
            losses[a].append(held.loss(*rest.solve(a)))
    weight_of = {k: g[0, 0] for k, g in by_fold.items()}
    mean = {a: float(np.average(v, weights=list(weight_of.values()))) for a, v in losses.items()}
    best = min(grid, key=lambda a: (mean[a], list(grid).index(a)))
    beta, intercept = Normal(total, features).solve(best)
    rmse = {a: [math.sqrt(x) for x in v] for a, v in losses.items()}
    t, p = paired_t(rmse[best], rmse[0.0]) if 0.0 in rmse else (math.nan, math.nan)
    return {"lambda": best, "cv": mean, "beta": beta, "intercept": intercept, "t": t, "p": p, "folds": len(by_fold)}


MOST_DENSE = 4096  # features up to which normal equations are kept as a matrix


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (fold, cells, weight, target) laid out for products, a batch in a row: row and feature of each cell, features
    numbered within the batch, and its features."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            flat = lists.flatten()
            names, f = np.unique(flat.field(0).to_numpy(zero_copy_only=False), return_inverse=True)
            at = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy().astype(np.int64)[: n + 1]))
            fold, w, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            arrays = {"at": at.astype(np.int32), "f": f.astype(np.int32), "v": flat.field(1).to_numpy(zero_copy_only=False), "names": names.astype(np.int32), "fold": fold.astype(np.int32), "w": w, "y": y}
            yield pa.RecordBatch.from_pydict({k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in arrays.items()})

    return rows.mapInArrow(packed, ", ".join(f"{k} binary" for k in _KINDS))


_KINDS = {"at": np.int32, "f": np.int32, "v": np.float64, "names": np.int32, "fold": np.int32, "w": np.float64, "y": np.float64}


def _reader() -> Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]]:
    """What reads blocks in tasks; made here, so that it goes to workers that do not have this module."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, f, *rest = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(_KINDS.values()))
                yield [at.astype(np.intp), f.astype(np.intp), *rest]

    return unpacked


def _stint_blocks(rows: DataFrame, context: Sequence[str], n: int, ids: np.ndarray, place: np.ndarray, scale: np.ndarray) -> DataFrame:
    """The blocks of A3's design straight from rows (fold, players, opp_players, w, y, context), without a row for each
    cell: tasks hold the players' ids in order, their places of ``n`` and their scales, a few numbers a player."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, place, scale))

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, scale = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 10_000):
                batch = whole.slice(lo, 10_000)
                at, f, v = [], [], []
                for i, offset in ((1, 0), (2, n)):
                    members = batch.column(i)
                    size = np.diff(members.offsets.to_numpy().astype(np.int64)[: batch.num_rows + 1])
                    flat = members.flatten()
                    there = flat.is_valid().to_numpy(zero_copy_only=False)
                    p = np.searchsorted(ids, flat.drop_null().to_numpy(zero_copy_only=False))
                    at.append(np.repeat(np.arange(batch.num_rows), size)[there])
                    f.append(place[p] + offset)
                    v.append(np.repeat(1 / np.maximum(size, 1), size)[there] * scale[p])
                x = np.array([batch.column(5 + i).to_numpy(zero_copy_only=False) for i in range(len(context))], float).reshape(len(context), batch.num_rows)
                i, j = np.nonzero(x)
                at, f, v = np.concatenate([*at, j]), np.concatenate([*f, 2 * n + i]), np.concatenate([*v, x[i, j]])
                names, f = np.unique(f, return_inverse=True)
                fold, w, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
                arrays = {"at": at, "f": f, "v": v, "names": names, "fold": fold, "w": w, "y": y}
                yield pa.RecordBatch.from_pydict({k: pa.array([np.ascontiguousarray(a.astype(kind)).tobytes()], pa.binary()) for (k, kind), a in zip(kinds.items(), arrays.values(), strict=True)})

    kinds = dict(_KINDS)
    rows = rows.select("fold", "players", "opp_players", F.col("w").cast("double"), F.col("y").cast("double"), *[F.col(c).cast("double") for c in context])
    return rows.mapInArrow(laid, ", ".join(f"{k} binary" for k in _KINDS))


FEATURES_A_PART = 4096  # features whose sums one row carries and one task adds up


def _summed(blocks: DataFrame, p: int, out_of: np.ndarray, directions: np.ndarray | None) -> np.ndarray:
    """Xᵀ W X d for each system's direction d, a system in a row, without the rows of its fold ``out_of``; without directions
    Xᵀ W y and, in as many more rows, the diagonal of Xᵀ W X. The last number of each is the constant's."""
    m = len(out_of)
    height = m if directions is not None else 2 * m
    unpacked = _reader()
    sent = blocks.sparkSession.sparkContext.broadcast(directions)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total, met = sent.value, np.zeros((height, p + 1)), np.zeros(p + 1, bool)
        met[p] = True
        for at, f, v, names, fold, w, y in unpacked(batches):
            met[names] = True
            for s in range(m):
                own = w * (fold != out_of[s])
                part = own * (y if d is None else np.bincount(at, v * d[s][names][f], len(w)) + d[s, p])
                total[s, names] += np.bincount(f, v * part[at], len(names))
                total[s, p] += part.sum()
                if d is None:
                    total[m + s, names] += np.bincount(f, v * v * own[at], len(names))
                    total[m + s, p] += own.sum()
        for lo in range(0, p + 1, FEATURES_A_PART):
            some = lo + np.flatnonzero(met[lo : lo + FEATURES_A_PART])
            if len(some):
                yield pa.RecordBatch.from_pydict({"part": pa.array([lo // FEATURES_A_PART], pa.int32()), "f": [some.astype(np.int32).tobytes()], "s": [total[:, some].tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lo = part * FEATURES_A_PART
        total = np.zeros((height, min(FEATURES_A_PART, p + 1 - lo)))
        for f, s in zip(table.column("f"), table.column("s"), strict=True):
            some = np.frombuffer(f.as_buffer(), np.int32) - lo
            total[:, some] += np.frombuffer(s.as_buffer(), np.float64).reshape(height, len(some))
        return pa.table({"part": pa.array([part], pa.int32()), "s": [total.tobytes()]})

    sums = blocks.mapInArrow(partial, "part int, f binary, s binary").groupBy("part").applyInArrow(added, "part int, s binary").toArrow()
    sent.destroy()
    out = np.zeros((height, p + 1))
    for part, s in zip(sums.column("part").to_pylist(), sums.column("s"), strict=True):
        lo = part * FEATURES_A_PART
        out[:, lo : lo + FEATURES_A_PART] = np.frombuffer(s.as_buffer(), np.float64).reshape(height, -1)
    return out


def ridge_sparse(long: DataFrame, row: Sequence[str], feature: str, value: str, weight: str, target: str, fold: str | None = None, grid: Sequence[float] = (1.0,), tolerance: float = 1e-13, most_rounds: int = 1000, features: int | None = None) -> dict:
    """R3, R4 for any number of features: ridge with a free intercept by conjugate gradients over sparse rows.

    One system for each penalty on all rows and, with ``fold``, one for each penalty and fold on the other rows; all go on
    together, each until it has converged. Rows are laid out once, in as many tasks as run at a time and in their order,
    so that a task meets few features. A round is one job: each task multiplies its rows by the directions and sends the
    vectors of the features that it met, in a row for each part of them, and a task adds up a part. No task and not the
    driver holds features squared, only vectors: features times systems numbers. Directions are scaled by the diagonal.
    Without a penalty and with too many features one of the solutions is found. ``cv``: weighted mean squared error of
    the held-out rows by penalty."""
    spark = long.sparkSession
    p = features if features is not None else int(long.agg(F.max(feature)).first()[0] or 0) + 1
    tag = F.col(fold).cast("int") if fold else F.lit(-1)
    filled = F.col(value).cast("double")
    cells = F.collect_list(F.when(~filled.eqNullSafe(0.0), F.struct(F.col(feature).cast("int").alias("f"), filled.alias("v"))))
    rows = long.withColumn("_fold", tag).groupBy(*row, "_fold").agg(cells.alias("xs"), F.first(weight).cast("double").alias("w"), F.first(target).cast("double").alias("y"))
    rows = rows.repartitionByRange(spark.sparkContext.defaultParallelism, *row).select("_fold", "xs", "w", "y")
    return _conjugate(_blocks(rows), p, fold is not None, grid, tolerance, most_rounds)


SWEEP = 4  # rounds after which what they shuffled is deleted


def _conjugate(blocks: DataFrame, p: int, fold: bool, grid: Sequence[float], tolerance: float = 1e-13, most_rounds: int = 1000) -> dict:
    """The rounds of ``ridge_sparse`` over rows laid out in blocks."""
    blocks = sinks.cut(blocks)
    sinks.sweep(blocks.sparkSession)
    folds = _folds(blocks) if fold else []
    systems = [(a, None) for a in grid] + [(a, k) for k in folds for a in grid]
    out_of = np.array([-2 if k is None else k for _, k in systems])
    penalty = np.repeat(np.array([[a] for a, _ in systems], float), p + 1, axis=1)
    penalty[:, p] = 0.0
    ways, of = np.unique(out_of, return_inverse=True)
    first = _summed(blocks, p, ways, None)
    b, diagonal = first[: len(ways)][of], first[len(ways) :][of] + penalty
    scale = 1 / np.where(diagonal > 0, diagonal, 1.0)
    x = np.zeros_like(b)
    r = b.copy()
    d = scale * r
    rz = (r * d).sum(axis=1)
    aim = tolerance**2 * np.maximum(rz, 1e-300)
    rounds = 0
    while (rz > aim).any() and rounds < most_rounds:
        on = np.flatnonzero(rz > aim)
        q = _summed(blocks, p, out_of[on], d[on]) + penalty[on] * d[on]
        curve = (d[on] * q).sum(axis=1)
        step = rz[on] / np.where(curve > 0, curve, 1.0)
        x[on] += step[:, None] * d[on]
        r[on] -= step[:, None] * q
        z = scale[on] * r[on]
        after = (r[on] * z).sum(axis=1)
        d[on] = z + (after / rz[on])[:, None] * d[on]
        rz[on], rounds = after, rounds + 1
        if rounds % SWEEP == 0:
            sinks.sweep(blocks.sparkSession)
    solved = {a: x[i] for i, (a, k) in enumerate(systems) if k is None}
    losses = _held_out(blocks, systems, x, p) if fold else {}
    mean = {a: float(np.sum([losses[a, k][0] for k in folds]) / max(1e-9, np.sum([losses[a, k][1] for k in folds]))) for a in grid} if fold else {}
    best = min(grid, key=lambda a: (mean[a], list(grid).index(a))) if mean else grid[0]
    rmse = {a: [math.sqrt(losses[a, k][0] / max(1e-9, losses[a, k][1])) for k in folds] for a in grid} if fold else {}
    t, pr = paired_t(rmse[best], rmse[0.0]) if 0.0 in rmse else (math.nan, math.nan)
    return {"lambda": best, "cv": mean, "beta": solved[best][:p], "intercept": float(solved[best][p]), "t": t, "p": pr, "folds": len(folds), "rounds": rounds}


def _folds(blocks: DataFrame) -> list[int]:
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                yield pa.RecordBatch.from_pydict({"fold": np.unique(np.frombuffer(one.as_buffer(), np.int32))})

    return sorted(r[0] for r in blocks.select("fold").mapInArrow(distinct, "fold int").distinct().collect())


def _held_out(blocks: DataFrame, systems: list[tuple[float, int | None]], x: np.ndarray, p: int) -> dict[tuple[float, int], tuple[float, float]]:
    """(sum of weighted squared errors, sum of weights) of each held-out system, by penalty and fold."""
    sent = blocks.sparkSession.sparkContext.broadcast(x)
    unpacked = _reader()
    held = [(i, k) for i, (_, k) in enumerate(systems) if k is not None]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(systems), 2))
        for at, f, v, names, fold, w, y in unpacked(batches):
            for i, k in held:
                own, one = w * (fold == k), sent.value[i]
                fit = np.bincount(at, v * one[names][f], len(w)) + one[p]
                total[i] += (own * (y - fit) ** 2).sum(), own.sum()
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(systems), dtype=np.int32), "e": total[:, 0], "w": total[:, 1]})

    got = blocks.mapInArrow(partial, "i int, e double, w double").groupBy("i").agg(F.sum("e").alias("e"), F.sum("w").alias("w")).collect()
    return {systems[i]: (e, w) for i, e, w in got if systems[i][1] is not None}


def paired_t(a: Sequence[float], b: Sequence[float]) -> tuple[float, float]:
    """Student's t of paired differences and its two-sided probability."""
    d = np.subtract(a, b)
    n = len(d)
    sd = d.std(ddof=1) if n > 1 else 0.0
    if n < 2 or sd == 0:
        return math.nan, math.nan
    t = float(d.mean() / (sd / math.sqrt(n)))
    v = n - 1
    return t, _beta_tail(v / 2, 0.5, v / (v + t * t))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by midpoint sums over a substitution that removes the end's pole."""
    if x <= 0:
        return 0.0
    s = (np.arange(200_000) + 0.5) / 200_000
    top = math.asin(math.sqrt(min(x, 1.0)))
    inner = np.sin(s * top) ** (2 * a - 1) * np.cos(s * top) ** (2 * b - 1)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return float(min(1.0, 2 * top * inner.mean() / math.exp(log_beta)))


def numbered_players(stints: DataFrame, least_minutes: float = 120.0) -> DataFrame:
    """A3: (playerId, minutes, p, scale): players by order of id, their minutes, and the scale of their cells."""
    rows = stints.where("minutes > 0")
    minutes = rows.select(F.explode("players").alias("playerId"), "minutes").groupBy("playerId").agg(F.sum("minutes").alias("minutes"))
    everyone = rows.select(F.explode(F.concat("players", "opp_players")).alias("playerId")).distinct().join(minutes, "playerId", "left").fillna({"minutes": 0.0})
    return ranges.numbered(everyone, [F.col("playerId")], "p").withColumn("scale", 1 / F.sqrt(F.greatest(F.lit(least_minutes), F.col("minutes"))))


def design_long(stints: DataFrame, context: Sequence[str], least_minutes: float = 120.0, folds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: (long design, players). Off cells 1/#own, def cells 1/#others, both times 1/√max(120, minutes); context after
    them. Target 60·xGF/minutes, weight minutes. Features are numbered by player in order of id. Context that is 0 has no
    cell, but for the first, so that each row has one. With ``folds`` (gameId, fold) rows have the fold of their game."""
    rows = stints.where("minutes > 0").withColumn("row_id", F.struct("gameId", "period", "startSec", "is_home"))
    numbered = numbered_players(stints, least_minutes)
    n = numbered.count()
    base = rows.select("row_id", "gameId", F.col("minutes").alias("w"), (60 * F.col("xGF") / F.col("minutes")).alias("y"), "players", "opp_players", *context)
    named = ["row_id", "gameId", "w", "y"]
    if folds is not None:
        base, named = base.join(folds, "gameId"), [*named, "fold"]
    side = lambda members, offset: F.transform(members, lambda one: F.struct(one.alias("playerId"), F.lit(offset).alias("offset"), (1 / F.size(members)).alias("cell")))
    on = base.select(*named, F.inline(F.concat(side("players", 0), side("opp_players", n)))).join(sinks.small(numbered), "playerId")
    long = on.select(*named, (F.col("p") + F.col("offset")).alias("feature"), (F.col("cell") * F.col("scale")).alias("value"))
    if context:
        cells = F.array(*[F.struct(F.lit(2 * n + i).cast("bigint").alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(context)])
        long = long.unionByName(base.select(*named, F.inline(F.filter(cells, lambda c: (c["feature"] == 2 * n) | ~c["value"].eqNullSafe(F.lit(0.0))))))
    return long, numbered


def rapm(stints: DataFrame, context: Sequence[str], grid: Sequence[float] = GRID, k: int = 5) -> tuple[DataFrame, dict]:
    """Offensive, defensive (sign turned) and total rates of players, and the fit's figures. Stints that have a
    ``fold`` keep it. Up to ``MOST_DENSE`` features the design is a row for each cell; beyond, stints are laid out in blocks
    as they are, by range of their games; those that have a fold stay where they lie."""
    players = numbered_players(stints)
    n = players.count()
    features = 2 * n + len(context)
    dealt = "fold" in stints.columns
    folds = stints.select("gameId", "fold").distinct() if dealt else sinks.small(balanced_folds(stints, "gameId", k))
    if features > MOST_DENSE:
        rows = stints.where("minutes > 0").withColumns({"w": F.col("minutes"), "y": 60 * F.col("xGF") / F.col("minutes")})
        if not dealt:
            rows = rows.join(folds, "gameId").repartitionByRange(stints.sparkSession.sparkContext.defaultParallelism, "gameId", "period", "startSec", "is_home")
        known = players.where("playerId is not null").select("playerId", "p", "scale").orderBy("p").toArrow()
        fit = _conjugate(_stint_blocks(rows, context, n, *(known.column(c).to_numpy() for c in known.column_names)), features, True, grid)
    else:
        long, players = design_long(stints.drop("fold"), context, folds=folds)
        fit = ridge_cv(long, ["row_id"], "feature", "value", "w", "y", "fold", grid, features)
    beta = fit["beta"]
    coefs = stints.sparkSession.createDataFrame(pa.table({"p": np.arange(n), "b_off": beta[:n], "b_def": beta[n : 2 * n]}))
    out = players.join(coefs, "p").select("playerId", "minutes", (F.col("b_off") * F.col("scale")).alias("off"), (-F.col("b_def") * F.col("scale")).alias("def"))
    return out.withColumn("total", F.col("off") + F.col("def")), fit


def ridge_fit(df: DataFrame, features: Sequence[str], target: str, alpha: float = 2.0) -> Logit | None:
    """Ridge with a free intercept on rows that have every feature and the target, by one aggregation of sums."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).na.drop()
    names = [*features, "_y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    if not one["n"]:
        return None
    m = len(features)
    sums = {(-2, -2): float(one["n"]), (-2, -1): one[f"s{m}"], (-1, -1): one[f"p{m}_{m}"]}
    for i in range(m):
        sums |= {(-2, i): one[f"s{i}"], (-1, i): one[f"p{i}_{m}"]} | {(i, j): one[f"p{i}_{j}"] for j in range(i, m)}
    beta, intercept = Normal(sums, m).solve(alpha)
    return Logit(list(features), [float(b) for b in beta], intercept)


def predict_linear(df: DataFrame, model: Logit | None, out: str) -> DataFrame:
    """Null where any feature is, or without a model."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    z = F.lit(model.intercept)
    for f, w in zip(model.features, model.coefficients, strict=True):
        z = z + F.col(f).cast("double") * w
    return df.withColumn(out, z)
