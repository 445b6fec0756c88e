"""Boxes of neighbours, first rows of a day, sums in intervals, names judged once: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions import text
from tallyforge.operators import comps, joins
from tallyforge.plans import seasons
from tests.plans import most_rows


@pytest.mark.parametrize("itself", [True, False])
def test_neighbours_in_boxes_with_missing_parts_and_copies(spark, itself):
    """Few distances of all where rows lack a part, and a crowd of copies is met by its least ids alone."""
    rng = np.random.default_rng(11)
    rows = [(i, "a", *map(float, rng.uniform(0, 100, 2)), float(rng.uniform(0, 100)) if i % 11 else None) for i in range(2600)]
    rows += [(i, "a", 50.0, 50.0, 7.0) for i in range(2600, 3200)]
    df = spark.createDataFrame(rows, "id long, b string, x double, y double, c double")
    blocks = comps.fit_blocks(df, {"USAGE": ["x", "y"], "CTX": ["c"]})
    z, counts = comps.with_blocks(df, blocks), []
    got = comps.nearest(z.where("id % 40 = 0"), z, "id", "id", "b", comps.block_metrics(blocks), 5, but_itself=itself, block=20, counts=counts)
    found = {}
    for r in got.orderBy("t_id", "neighbour").collect():
        found.setdefault(r.t_id, []).append((round(r.dist, 9), r.c_id))
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
    m, s = np.array([blocks[b]["mean"] for b in ("USAGE",)])[0], np.array(blocks["USAGE"]["sd"])
    u, v = (x[:, :2] - m) / s, (x[:, 2] - blocks["CTX"]["mean"][0]) / blocks["CTX"]["sd"][0]
    inverse = np.array(blocks["USAGE"]["inverse"])
    want = {}
    for t in range(0, 3200, 40):
        d = u[t] - u
        dist = 2.0 * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0)) + np.nan_to_num(1.2 * np.abs(v[t] - v))
        want[t] = [(round(a, 9), j) for a, j in sorted((round(float(a), 12), j) for j, a in enumerate(dist) if not (itself and j == t))[:5]]
    assert found == want
    assert sum(counts[:2]) < 0.1 * counts[2], counts


def test_a_day_of_a_dense_key_joins_one_row(spark):
    """300 left and 300 right rows of a key and day, and of the next: as many joined rows as left ones, not 300 times."""
    left = [(i, "k", f"2024-01-0{1 + i % 4}") for i in range(300)] + [(900, None, "2024-01-01"), (901, "k", None), (902, "q", "2024-01-01")]
    right = [(j, "k", f"2024-01-0{2 + j % 2}") for j in range(300)]
    a, b = spark.createDataFrame(left, "i long, k string, d string"), spark.createDataFrame(right, "j long, k string, e string")
    out = joins.tolerant_date_join(a, b, ["k"], "d", "e", ["i"], 1, [F.col("j").desc()])
    got = {r.i: (r.j, r.day_offset) for r in out.collect()}
    best = {"2024-01-02": 298, "2024-01-03": 299}
    want = {}
    for i, _, d in left[:300]:
        at = {"2024-01-01": ("2024-01-02", 1), "2024-01-02": ("2024-01-02", 0), "2024-01-03": ("2024-01-03", 0), "2024-01-04": ("2024-01-03", -1)}[d]
        want[i] = (best[at[0]], at[1])
    assert got == want

    assert most_rows(out) <= 2 * len(left) + 3 * len(right)


def test_a_canonical_name_works_out_each_step_once(spark):
    """The column itself stands in the plan a few times, whatever the steps that name their input several times."""
    df = spark.createDataFrame([("Müller Jr., Jörg",), ("Ã‰ric O’Neil",), (None,)], "s string")
    out = df.select(text.canonical_name(F.concat("s", F.lit("")), {}).alias("name"))
    assert [r.name for r in out.collect()][::2] == ["jorg muller", ""]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(s#") <= 2 and plan.lower().count("regexp_replace") < 40


@pytest.mark.parametrize("unit", [1.0, 0.25, 8.0])
def test_sums_in_intervals_pair_nothing(spark, unit):
    """Long intervals over all points: no join gives out more rows than intervals have nodes."""
    rng = np.random.default_rng(12)
    points = [(float(t), float(v) if v % 5 else None) for t, v in zip(rng.integers(-2000, 8000, 1500) / 4, rng.integers(0, 50, 1500))]
    spans = [(j, float(s), float(s + n)) for j, (s, n) in enumerate(zip(rng.integers(-3000, 8000, 60) / 4, 10.0 ** rng.uniform(-1, 4, 60)))] + [(900, 5.0, 5.0), (901, 7.0, 3.0), (902, -1e4, 1e4), (903, None, 4.0)]
    p, s = spark.createDataFrame(points, "t double, v double"), spark.createDataFrame(spans, "j long, a double, b double")
    out = joins.sums_in_intervals(p, s, ["j"], "t", "a", "b", {"n": None, "total": "v"}, unit)
    got = {r.j: (r.n, r.total or 0.0) for r in out.collect() if r.n}
    want = {}
    for j, a, b in spans:
        inside = [v for t, v in points if a is not None and a <= t < b]
        if inside:
            want[j] = (len(inside), float(sum(v or 0 for v in inside)))
    assert got == want
    assert most_rows(out) <= 60 * 2 * 16


def test_a_shift_stays_one_row_when_shots_meet_it(spark):
    """No shift is multiplied by bins: nothing of the plan is a row for each minute."""
    plays = spark.createDataFrame([(1, 1, 10 * i, i, "GOAL" if i % 3 == 0 else "SHOT-ON-GOAL", "H" if i % 2 else "A", i % 2 == 1, float(i % 7), float(i % 5), True, "EV") for i in range(100)], "gameId long, period int, eventSec long, event_seq long, type string, teamAbbrev string, is_home boolean, dist double, angle double, isFenwick boolean, strengthBucket string")
    shifts = spark.createDataFrame([(1, 1, 7, "H", 0, 600, 1), (1, 1, 8, "A", 300, 1200, 1), (1, None, 9, "A", 0, 1200, 1)], "gameId long, period int, playerId long, teamAbbrev string, startSec long, endSec long, shiftNumber int")
    _, out, _ = seasons.shot_values(plays, shifts)
    got = {r.playerId: (r.fenwickF, r.fenwickA) for r in out.collect()}
    assert got == {7: (30, 30), 8: (35, 35), 9: (0, 0)}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
