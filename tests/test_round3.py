"""Ranges, quantiles, folds, sparse ridge, pivots, dyadic joins, sweeps, versioned tables, reuse: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import comps, joins, models, ranges, stats
from tallyforge.sources import sinks


def test_numbers_sums_and_carried_values_over_any_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v) if rng.random() > 0.3 else None) for k, v in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k long, v long")
    want = sorted(rows)
    for n in (1, 7):
        assert [r.i for r in ranges.numbered(df, [F.col("k")], "i", n).orderBy("k").collect()] == list(range(500))
        sums = [r.s for r in ranges.prefix_sums(df, [F.col("k")], "v", "s", partitions=n).orderBy("k").collect()]
        assert sums == np.cumsum([v or 0 for _, v in want]).tolist()
        before = [r.s for r in ranges.prefix_sums(df, [F.col("k")], "v", "s", False, n).orderBy("k").collect()]
        assert before == [0, *sums[:-1]]
        last, carried = None, []
        for _, v in want:
            last = v if v is not None else last
            carried.append(last)
        assert [r.c for r in ranges.carried(df, [F.col("k")], "v", "c", n).orderBy("k").collect()] == carried
    assert ranges.numbered(df.limit(0), [F.col("k")], "i").count() == 0


@pytest.mark.parametrize("accuracy", [20, 2000])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    rows = [(k, float(x)) for k, n in (("a", 3000), ("b", 1), ("c", 2), ("d", 700)) for x in np.round(rng.lognormal(0, 2, n), 1)]
    rows += [("e", None), (None, 4.0), ("f", 5.0), *[("g", 7.0)] * 300]
    at = [0.0, 0.05, 0.2, 0.5, 0.95, 1.0]
    got = {(r.k, r.q): r.quantile for r in stats.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at, accuracy).collect()}
    for key in {k for k, _ in rows}:
        values = [x for k, x in rows if k == key and x is not None]
        for q in at:
            assert (key, q) not in got if not values else got[key, q] == pytest.approx(np.quantile(values, q), abs=1e-9)
    assert stats.quantiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).count() == 0


def greedy(sizes, k):
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        i = min(range(k), key=lambda j: (load[j], j))
        load[i] += n
        out[g] = i
    return out


@pytest.mark.parametrize("seed", range(4))
def test_folds_are_the_greedy_ones(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {int(g): int(n) for g, n in enumerate(rng.integers(1, (3, 12, 60, 5)[seed], (200, 90, 40, 7)[seed]))}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g long")
    assert {r.g: r.fold for r in models.balanced_folds(df, "g", 5).collect()} == greedy(sizes, 5)


def design(rng, n, p, cells):
    rows = []
    for i in range(n):
        f = rng.choice(p, cells, replace=False)
        rows.append((i, f, rng.normal(0, 1, cells), float(rng.uniform(0.5, 2)), i % 3))
    return rows


def test_sparse_ridge_equals_the_dense_fit(spark):
    rng = np.random.default_rng(2)
    rows = design(rng, 600, 60, 5)
    beta = rng.normal(0, 1, 60)
    y = [float(v @ beta[f] + rng.normal(0, 0.1) + 3) for _, f, v, _, _ in rows]
    long = spark.createDataFrame([(i, int(a), float(b), w, t, k) for (i, f, v, w, k), t in zip(rows, y) for a, b in zip(f, v)], "row long, f int, v double, w double, y double, fold int")
    args = (["row"], "f", "v", "w", "y", "fold", (0.0, 1.0, 5.0))
    dense, sparse = models.ridge_cv(long, *args), models.ridge_sparse(long, *args)
    assert sparse["lambda"] == dense["lambda"] and sparse["folds"] == 3
    assert np.abs(sparse["beta"] - dense["beta"]).max() < 1e-8 and abs(sparse["intercept"] - dense["intercept"]) < 1e-8
    assert sparse["cv"] == pytest.approx(dense["cv"], rel=1e-8)


def test_sparse_ridge_of_twenty_thousand_features(spark):
    """Against the dual form, which is dense in the rows and so holds no features squared either."""
    rng = np.random.default_rng(3)
    n, p = 900, 20_000
    rows = design(rng, n, p, 8)
    rows[0][1][0] = p - 1
    y = rng.normal(0, 1, n)
    long = spark.createDataFrame([(i, int(a), float(b), w, float(y[i])) for i, f, v, w, _ in rows for a, b in zip(f, v)], "row long, f int, v double, w double, y double")
    got = models.ridge_sparse(long, ["row"], "f", "v", "w", "y", grid=(2.0,))
    x, w = np.zeros((n, p)), np.array([r[3] for r in rows])
    for i, f, v, _, _ in rows:
        np.add.at(x[i], f, v)
    mean_x, mean_y = w @ x / w.sum(), w @ y / w.sum()
    xc = (x - mean_x) * np.sqrt(w)[:, None]
    want = xc.T @ np.linalg.solve(xc @ xc.T + 2.0 * np.eye(n), (y - mean_y) * np.sqrt(w))
    assert np.abs(got["beta"] - want).max() < 1e-8 and abs(got["intercept"] - (mean_y - mean_x @ want)) < 1e-8


def brute_nearest(asked, pool, k, itself):
    out = {}
    for i, b, x in asked:
        own = [r for r in pool if r[1] == b]
        rows = own if len(own) >= k else pool
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, _, y in rows if not (itself and j == i))
        out[i] = [(round(a, 9), j) for a, j in d[:k]]
    return out


@pytest.mark.parametrize(("block", "k", "pivots"), [(20, 5, 6), (7, 30, 3), (1000, 3, 0)])
def test_neighbours_by_pivots(spark, block, k, pivots):
    rng = np.random.default_rng(block)
    centre = rng.normal(0, 20, (5, 3))
    pool = [(i, "abc"[i % 3] if i > 10 else "rare", [float(v) for v in centre[i % 5] + rng.normal(0, 1, 3).round(1)]) for i in range(400)]
    kind = "id long, b string, x array<double>"
    df = spark.createDataFrame(pool, kind)
    got = comps.nearest(df.where("id % 9 = 0"), df, "id", "id", "b", {"x": comps.euclid}, k, but_itself=True, block=block, pivots=pivots)
    found = {}
    for r in got.orderBy("t_id", "neighbour").collect():
        found.setdefault(r.t_id, []).append((round(r.dist, 9), r.c_id))
    assert found == brute_nearest([r for r in pool if r[0] % 9 == 0], pool, k, True)


def test_neighbours_where_vectors_are_missing(spark):
    rng = np.random.default_rng(5)
    vec = lambda: [float(v) for v in rng.normal(0, 3, 2)] if rng.random() > 0.2 else None
    pool = [(i, "a", vec(), vec()) for i in range(150)]
    df = spark.createDataFrame(pool, "id long, b string, x array<double>, y array<double>")
    zero = lambda a, b: F.greatest(comps.euclid(a, b), F.lit(0.0))  # noqa: E731  of a missing vector this is 0, not null
    got = comps.nearest(df.where("id < 30"), df, "id", "id", "b", {"x": zero, "y": comps.euclid}, 4, but_itself=True, block=10, pivots=4)
    d = lambda a, b: 0.0 if a is None or b is None else float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
    want = {(i, j) for i, _, x, y in pool[:30] for _, j in sorted((round(d(x, u) + d(y, v), 9), j) for j, _, u, v in pool if j != i)[:4]}
    assert {(r.t_id, r.c_id) for r in got.collect()} == want


def test_fewer_distances_of_a_larger_pool(spark):
    rng = np.random.default_rng(6)
    share = []
    for n in (400, 3200):
        points = rng.uniform(0, 100, (n, 2))
        df = spark.createDataFrame([(i, "a", [float(a), float(b)]) for i, (a, b) in enumerate(points)], "id long, b string, x array<double>").cache()
        counts: list[int] = []
        comps.nearest(df.where("id < 40"), df, "id", "id", "b", {"x": comps.euclid}, 5, but_itself=True, block=20, counts=counts).count()
        share.append(sum(counts[:2]) / counts[2])
    assert share[1] < 0.6 * share[0] and share[1] < 0.3, share


@pytest.mark.parametrize("left_open", [False, True])
def test_dyadic_joins_without_keys(spark, left_open):
    rng = np.random.default_rng(7)
    points = [(i, float(t)) for i, t in enumerate(rng.integers(-500, 40_000, 300) / 4)]
    spans = [(j, float(s), float(s + length)) for j, (s, length) in enumerate(zip(rng.integers(-600, 40_000, 200) / 4, 10.0 ** rng.uniform(-1, 4, 200)))] + [(900, 5.0, 5.0), (901, 7.0, 3.0)]
    p, s = spark.createDataFrame(points, "i long, t double"), spark.createDataFrame(spans, "j long, a double, b double")
    want = {(i, j) for i, t in points for j, a, b in spans if (a < t <= b if left_open else a <= t < b)}
    for unit in (1.0, 0.25, 8.0):
        rows = [tuple(r) for r in joins.points_in_intervals(p, s, [], "t", "a", "b", left_open, unit=unit).select("i", "j").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert joins.points_in_intervals(p, s.limit(0), [], "t", "a", "b", unit=1.0).count() == 0


@pytest.mark.parametrize("bin_size", [5.0, 60.0, 10_000.0])
def test_active_sets_by_a_sweep(spark, bin_size):
    rng = np.random.default_rng(8)
    spans = [(int(g), int(w), int(a), int(a + n)) for g, w, a, n in zip(rng.integers(0, 2, 80), rng.integers(0, 12, 80), rng.integers(0, 300, 80), rng.integers(0, 90, 80))]
    points = [(int(g), i, int(t)) for i, (g, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-5, 400, 60)))]
    p, s = spark.createDataFrame(points, "g int, i long, t long"), spark.createDataFrame(spans, "g int, who long, a long, b long")
    got = {r.i: list(r.active) for r in joins.active_set_at(p, s, ["g"], ["i"], "t", "a", "b", "who", bin_size).collect()}
    assert got == {i: sorted({w for h, w, a, b in spans if h == g and a <= t < b}) for g, i, t in points}


def test_two_writers_and_one_version(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"{tmp_path}/t")
    assert table.version() == 0
    assert table.commit(spark.range(3), 0) == 1
    before = table.read()
    other = sinks.VersionedTable(spark, f"{tmp_path}/t")
    assert table.commit(table.read().where("id > 0"), 1) == 2  # from itself
    with pytest.raises(sinks.VersionConflict):
        other.commit(spark.range(100), 1)
    assert table.commit(spark.range(7, 9), 2, "append") == 3
    assert [before.count(), table.read(1).count(), table.read(2).count(), other.read().count()] == [3, 3, 2, 4]
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("data-")]) == 3  # the loser's rows are gone
    assert table._store.claim(f"{tmp_path}/t/_versions/{9:020d}.json", "{}") and not other._store.claim(f"{tmp_path}/t/_versions/{9:020d}.json", "{}")


def test_reuse_follows_plan_and_files(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/kept"
    spark.range(5).write.parquet(source)
    read = lambda: spark.read.parquet(source).where("id > 1")
    key = sinks.content_key(read())
    assert sinks.reused_by_content(read(), root).count() == 3 and sinks.content_key(read()) == key
    marked = f"{root}/{key}"
    spark.range(50).write.mode("overwrite").parquet(marked)  # a table that is there is taken as it is
    assert sinks.reused_by_content(read(), root).count() == 50
    assert sinks.content_key(spark.read.parquet(source).where("id > 2")) != key
    spark.range(9).write.mode("overwrite").parquet(source)
    assert sinks.content_key(read()) != key and sinks.reused_by_content(read(), root).count() == 7


def test_append_adds_rows(spark, tmp_path):
    for _ in range(2):
        sinks.append(spark.range(3).withColumn("season", F.lit("2020-2021")), f"{tmp_path}/log", ["season"])
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
