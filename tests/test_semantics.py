"""Null keys, ties, quantiles, rounding, coercion, dedupe: small frames against pandas or by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge import schema as S
from tallyforge.functions import numeric, rink, text
from tallyforge.operators import comps, joins, models, ranks, stats, value


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 10), (3, 30)], "k int, x int")
    out = rows(joins.upsert_coalesce(a, b, ["k"]).select("k", "x"), F.col("k").asc_nulls_first())
    assert out == [(None, 10), (2, 2), (3, 30)]
    assert rows(joins.null_safe(a, b, ["k"], "left_anti")) == [(2, 2)]


def test_group_sums_and_null_keys(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), ("b", 2.0)], "k string, x double")
    assert rows(stats.sum_by(df, ["k"], ["x"]), "k") == [("a", 0.0), ("b", 2.0)]
    assert (None, 1.0) in rows(stats.sum_by(df, ["k"], ["x"], empty_zero=False, dropna=False))


def test_percentile_rank_as_pandas(spark):
    pdf = pd.DataFrame({"g": list("aaaabbbb"), "x": [3.0, 1.0, 3.0, None, 5.0, 5.0, 5.0, 2.0]})
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples()], "i int, g string, x double")
    got = {r.i: r.p for r in ranks.pct_rank_avg(df, ["g"], "x", "p", digits=None).collect()}
    want = pdf.groupby("g").x.rank(method="average", pct=True) * 100
    assert all((got[i] is None and np.isnan(w)) or abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_trimmed_mean_as_numpy(spark):
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=50), rng.integers(1, 9, 50)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(v, w)], "g string, v double, w double")
    keep = v <= np.quantile(v, 0.95)
    got = stats.weighted_trimmed_mean(df, ["g"], "v", "w", drop_high=0.05).first().trimmed
    assert got == pytest.approx(np.average(v[keep], weights=w[keep]))


@pytest.mark.parametrize("accuracy", [4, 2_000])  # a poor sketch changes nothing
def test_quantiles_as_percentile(spark, accuracy):
    rng = np.random.default_rng(2)
    values = [("hot", float(x)) for x in rng.normal(size=3_000)] + [("ties", float(x)) for x in rng.integers(0, 3, 200)] + [(None, 1.0), (None, 4.0), (None, None), ("one", 7.0), ("none", None), ("ends", float("inf")), ("ends", 1.0), ("ends", 2.0)]
    df = spark.createDataFrame(values, "g string, v double")
    at = [0.0, 0.05, 0.5, 0.8, 1.0]
    got = {(r.g, r.q): r.quantile for r in stats.quantiles(df, ["g"], "v", at, accuracy).collect()}
    want = {(r.g, q): r[f"p{i}"] for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(f"p{i}") for i, q in enumerate(at)]).collect() for i, q in enumerate(at) if r.g != "none"}
    assert got == want
    whole = stats.quantiles(df, [], "v", [0.5]).collect()
    assert [r.quantile for r in whole] == [df.agg(F.percentile("v", 0.5)).first()[0]]
    assert stats.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_locf_between_before_and_at_null(spark):
    df = spark.createDataFrame([(1, 1989), (2, 1990), (3, 1992), (4, 1996), (5, None), (6, 1992)], "id int, y int")
    table = spark.createDataFrame([(1990, 10.0), (1995, 20.0)], "year int, cap double")
    got = rows(value.locf(df, table, "y", "year", "cap", growth=0.5).select("id", "cap"), "id")
    assert got == [(1, 10.0), (2, 10.0), (3, 22.5), (4, 30.0), (5, 10.0), (6, 22.5)]


def test_text_functions(spark):
    df = spark.createDataFrame([(s,) for s in ["Côté, José Jr.", "MatÃ©j Blumel", "  O’Neil–Smith  III ", None, "jr"]], "s string")
    got = [r[0] for r in df.select(text.canonical_name(F.col("s"))).collect()]
    assert got == ["jose jr cote", "matej blumel", "o'neil-smith", "", ""]
    one = spark.createDataFrame([("12:34", "1:02:03", "x", "$1,234.5", "6'2\"", "2024-05-06 - A at B", "2023-2024", "10-5-2")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = one.select(text.clock_seconds("a") if False else text.clock_seconds(F.col("a")), text.clock_seconds(F.col("b")), text.clock_seconds(F.col("c")), text.money(F.col("d")), text.height_inches(F.col("e")), text.iso_date(F.col("f")).cast("string"), text.shift_season(F.col("g"), -1), text.record(F.col("h"))["pts"]).first()
    assert tuple(got) == (754, 3723, None, 1234.5, 74.0, "2024-05-06", "2022-2023", 22)
    names = spark.createDataFrame([("jean-luc o'neil",)], "s string").select(text.title_name(F.col("s"))).first()[0]
    assert names == "Jean-Luc O'Neil"
    teams = spark.createDataFrame([("T.B",), ("Boston Bruins",), ("bos",), ("nobody",)], "t string")
    assert [r[0] for r in teams.select(text.team_code(F.col("t"))).collect()] == ["TBL", "BOS", "BOS", None]


def test_column_units(spark):
    clocks = spark.createDataFrame([("10:00",), ("5",)], "t string")
    assert [r.s for r in text.column_seconds(clocks, "t", "s").collect()] == [600.0, 300.0] or [r.s for r in text.column_seconds(clocks, "t", "s").collect()] == [600.0, None]


def test_schema_helpers(spark):
    df = spark.createDataFrame([("1,000", 1, None), ("x", 1, None)], "a string, one int, none string")
    assert [r.v for r in df.select(S.number(F.col("a")).alias("v")).collect()] == [1000.0, None]
    assert S.drop_uninformative(df).columns == ["a"]
    schema = spark.createDataFrame([], "one bigint, extra double").schema
    assert rows(S.conform(df, schema)) == [(1, None), (1, None)]
    with pytest.raises(ValueError):
        S.require(df, ["zz"])


def test_tolerant_dates(spark):
    a = spark.createDataFrame([(1, "k", "2024-01-02"), (2, "k", "2024-01-10")], "i int, k string, d string").withColumn("d", F.to_date("d"))
    b = spark.createDataFrame([("k", "2024-01-01", "before"), ("k", "2024-01-03", "after"), ("k", "2024-01-09", "b9")], "k string, e string, n string").withColumn("e", F.to_date("e"))
    out = joins.tolerant_date_join(a, b, ["k"], "d", "e", ["i"])
    assert rows(out.select("i", "n", "day_offset"), "i") == [(1, "before", -1), (2, "b9", -1)]


def test_binned_intervals_equal_plain(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, "k", int(t)) for i, t in enumerate(rng.integers(0, 300, 60))], "i int, k string, t bigint")
    spans = spark.createDataFrame([(j, "k", int(a), int(a + n)) for j, (a, n) in enumerate(zip(rng.integers(0, 300, 30), rng.integers(0, 90, 30)))], "j int, k string, a bigint, b bigint")
    for left_open in (False, True):
        plain = joins.points_in_intervals(points, spans, ["k"], "t", "a", "b", left_open).select("i", "j")
        binned = joins.points_in_intervals(points, spans, ["k"], "t", "a", "b", left_open, bin_size=25).select("i", "j")
        assert rows(plain, "i", "j") == rows(binned, "i", "j")


def test_lookup_chain_and_lags(spark):
    people = spark.createDataFrame([(1, "ann", "F"), (2, "bob", "D"), (3, "cy", "F")], "i int, name string, pos string")
    by_both = spark.createDataFrame([("ann", "F", 11, 1)], "name string, pos string, id int, seq int")
    by_name = spark.createDataFrame([("ann", 99, 1), ("bob", 22, 2), ("bob", 23, 1)], "name string, id int, seq int")
    out = joins.lookup_chain(people, [(by_both, ["name", "pos"]), (by_name, ["name"])], "id", ["seq"], "pid")
    assert rows(out.select("i", "pid"), "i") == [(1, 11), (2, 23), (3, None)]
    left = spark.createDataFrame([(7, 1, 2020)], "row int, p int, y int")
    right = spark.createDataFrame([(1, 2019, "a"), (1, 2017, "b"), (1, 2016, "c"), (1, 2015, "d"), (1, 2020, "no")], "p int, s int, v string")
    assert [r.v for r in joins.latest_before(left, right, "p", "y", "s", 3, ["row"]).orderBy("recency").collect()] == ["a", "b", "c"]


def test_numeric(spark):
    df = spark.createDataFrame([(3.0,), (-3.0,), (1.0,)], "x double")
    assert [round(r[0], 6) for r in df.select(numeric.compress(F.col("x"))).collect()] == [3.0, -3.0, 1.0]
    one = spark.range(1).select(numeric.blend([F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)], (0.55, 0.35, 0.10))).first()[0]
    assert one == pytest.approx((0.55 + 0.3) / 0.65)
    geo = spark.range(1).select(rink.shot_geometry(F.lit(-80.0), F.lit(5.0), F.lit(False))).first()[0]
    assert geo.dist == pytest.approx(np.hypot(9, 5)) and geo.angle == pytest.approx(np.degrees(np.arctan2(5, 9)))
    sit = spark.range(1).select(rink.situation(F.lit("1541"))).first()[0]
    assert (sit.home, sit.away, sit.pulled_home) == (5, 4, False)


def test_caps(spark):
    df = spark.createDataFrame([(2014,), (2027,), (2028,)], "y int")
    assert [r[0] for r in df.select(value.cap_of(F.col("y"))).collect()] == [71400000.0, 113500000.0, 119175000.0]
    assert df.select(value.min_salary_of(F.col("y"))).first()[0] == 775000.0


def test_logit_against_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.3)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = models.fit_logit(df, ["a", "b"], "y")
    full, w, ridge = np.c_[x, np.ones(400)], np.zeros(3), np.diag([0.1, 0.1, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ w))
        w += np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (y - p) - ridge @ w)
    assert np.allclose([*m.coefficients, m.intercept], w, atol=1e-4)


def test_ridge_cv_and_fit_against_closed_form(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(120, 3)), rng.integers(1, 5, 120).astype(float)
    y = x @ [1.0, 0.5, 0.0] + rng.normal(size=120)
    long = spark.createDataFrame([(i, i % 5, j, float(x[i, j]), float(w[i]), float(y[i])) for i in range(120) for j in range(3)], "r int, f int, j int, v double, w double, y double")
    fit = models.ridge_cv(long, ["r"], "j", "v", "w", "y", "f", (0.0, 2.0))

    def solve(rows, alpha):
        mx, my = np.average(x[rows], axis=0, weights=w[rows]), np.average(y[rows], weights=w[rows])
        c = x[rows] - mx
        b = np.linalg.solve((c * w[rows, None]).T @ c + alpha * np.eye(3), (c * w[rows, None]).T @ (y[rows] - my))
        return b, my - mx @ b

    fold = np.arange(120) % 5
    for alpha in (0.0, 2.0):
        losses, sums = [], []
        for k in range(5):
            b, c = solve(np.flatnonzero(fold != k), alpha)
            on = fold == k
            losses.append(np.average((y[on] - x[on] @ b - c) ** 2, weights=w[on]))
            sums.append(w[on].sum())
        assert fit["cv"][alpha] == pytest.approx(np.average(losses, weights=sums))
    b, c = solve(np.arange(120), fit["lambda"])
    assert np.allclose(fit["beta"], b) and fit["intercept"] == pytest.approx(c)
    plain = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    w[:] = 1
    b, c = solve(np.arange(120), 2.0)
    m = models.ridge_fit(plain, ["a", "b", "c"], "y", 2.0)
    assert np.allclose(m.coefficients, b) and m.intercept == pytest.approx(c)


def test_paired_t():
    t, p = models.paired_t([1.0, 2.0, 3.0, 4.0], [1.1, 2.3, 2.9, 4.6])
    d = np.array([-0.1, -0.3, 0.1, -0.6])
    assert t == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and 0.2 < p < 0.35


def test_blocks_and_neighbours(spark):
    rng = np.random.default_rng(2)
    data = [(i, "F" if i % 3 else "D", *map(float, rng.normal(size=3))) for i in range(40)]
    df = spark.createDataFrame(data, "id int, pos string, a double, b double, c double")
    blocks = comps.fit_blocks(df, {"VALUE": ["a", "b"], "AGE": ["c"]})
    z = comps.with_blocks(df, blocks)
    out = comps.nearest(z.where("id < 5"), z.where("id >= 5"), "id", "id", "pos", comps.block_metrics(blocks), k=6).toPandas()
    x = np.array([r[2:] for r in data])
    std = (x - x.mean(0)) / x.std(0)
    inv = np.linalg.inv(np.cov(std[:, :2].T) + 1e-6 * np.eye(2))
    for t in range(5):
        pool = [i for i in range(5, 40) if data[i][1] == data[t][1]]
        d = {i: 1.5 * np.sqrt((std[t, :2] - std[i, :2]) @ inv @ (std[t, :2] - std[i, :2])) + 2.0 * abs(std[t, 2] - std[i, 2]) for i in pool}
        got = out[out.t_id == t].sort_values("neighbour")
        assert got.c_id.tolist() == sorted(d, key=lambda i: (d[i], i))[:6]
        assert got.weight.sum() == pytest.approx(1.0)


def test_goal_slopes(spark):
    rng = np.random.default_rng(8)
    data = [(y, int(t), float(a), float(b)) for y in (2020, 2021, 2022) for t, a, b in zip(range(6), rng.random(6), rng.random(6))]
    df = spark.createDataFrame(data, "y int, t int, a double, b double")
    got = {r.target: r.slope for r in stats.wls_slope_window(df, "y", "a", "b").collect()}
    use = [(a, b, {2020: 1, 2021: 2, 2022: 3}[y]) for y, _, a, b in data]
    a, b, w = map(np.array, zip(*use))
    ma, mb = np.average(a, weights=w), np.average(b, weights=w)
    assert got[2022] == pytest.approx((w * (a - ma) * (b - mb)).sum() / (w * (a - ma) ** 2).sum())
