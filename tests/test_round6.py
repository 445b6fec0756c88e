"""Stints stored once and laid out as they are; exact market rates in parts; statistics of every row's neighbours."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import models, stints, value
from tallyforge.plans import catalogue
from tests.compare import duck
from tests.test_round5 import PLAYS, SHIFTS

CONTEXT = ["is_home", "late"]


def season(spark, rows=300, players=30):
    rng = np.random.default_rng(6)
    out = []
    for i in range(rows):
        on = [int(x) for x in rng.choice(players, 7, replace=False) * 1000 + 5]
        out.append((i % 40, 1, i, i % 2, float(rng.uniform(0.2, 2)) if i % 37 else 0.0, float(rng.uniform(0, 1)), on[:3], on[3:] + [None] * (i % 50 == 0), i % 3))
    return spark.createDataFrame(out, "gameId long, period int, startSec long, is_home int, minutes double, xGF double, players array<long>, opp_players array<long>, late int").repartition(3)


@pytest.mark.parametrize("dealt", [False, True])
def test_ratings_of_many_players_equal_the_matrix(spark, monkeypatch, dealt):
    rows = season(spark)
    if dealt:
        rows = rows.join(models.balanced_folds(rows, "gameId"), "gameId")
    want, dense = models.rapm(rows, CONTEXT, (0.5, 1.0, 3.0))
    monkeypatch.setattr(models, "MOST_DENSE", 10)
    got, sparse = models.rapm(rows, CONTEXT, (0.5, 1.0, 3.0))
    assert sparse["rounds"] > 0 and sparse["lambda"] == dense["lambda"] and sparse["folds"] == dense["folds"] == 5
    assert sparse["cv"] == pytest.approx(dense["cv"], rel=1e-6)
    one, two = (x.orderBy("playerId").toPandas().fillna(-1) for x in (want, got))  # one of them is null
    assert (one.playerId == two.playerId).all() and len(one) == 31
    assert np.allclose(one[["minutes", "off", "def", "total"]], two[["minutes", "off", "def", "total"]], atol=1e-8)


def test_a_design_of_many_players_is_not_a_row_for_each_cell(spark):
    """Stints that have a fold are laid out where they lie: no shuffle, and no cell is a row."""
    rows = season(spark).withColumns({"fold": F.col("gameId") % 5, "w": F.lit(1.0), "y": F.lit(1.0)})
    ids = np.arange(30) * 1000 + 5
    plan = models._stint_blocks(rows.repartition(3).where("minutes > 0"), CONTEXT, 30, ids, np.arange(30), np.ones(30))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "hashpartitioning" not in text and "SortMergeJoin" not in text
    blocks = models._summed(plan, 62, np.array([-2]), None)
    assert blocks[0, 62] == rows.where("minutes > 0").count()


def test_a_stint_is_one_row_until_its_sides_are_asked_for(spark):
    shifts = spark.createDataFrame([(1, 1, 10, "HOM", 0, 600), (1, 1, 20, "AWY", 0, 1200)], SHIFTS)
    games = spark.createDataFrame([(1, "HOM", "AWY")], "gameId bigint, home_team string, away_team string")
    made = stints.segments(spark.createDataFrame([(1, 1, 300, 2, "SHOT-ON-GOAL", "HOM", "N", True, 0.25, 0, 0)], PLAYS), shifts, games, shifts.select("playerId"))
    assert [(r.startSec, r.endSec) for r in made.orderBy("startSec").collect()] == [(0, 600), (600, 1200)]
    both = stints.sides(made.withColumn("fold", F.lit(3)), keep=["fold"])
    assert both.count() == 4 and both.where("fold = 3").count() == 4


def test_market_rates_hold_no_group_in_a_task(spark):
    """Two metrics at once against numpy; groups above and below what a sketch keeps whole, and thin ones that take ALL's rate."""
    rng = np.random.default_rng(8)
    rows = [(2000 + i % 2, "D" if i % 5 == 0 else "F", float(rng.integers(1, 50)), float(rng.normal(1, 1)), float(rng.integers(-1, 4))) for i in range(9000)]
    rows += [(2002, "D" if i < 9 else "F", float(i + 1), 2.0, None) for i in range(30)] + [(2003, "F", None, 1.0, 1.0), (2003, "F", 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y long, b string, share double, u double, v double")
    out = value.market_rates(df, ["y"], "b", "share", ["u", "v"])
    want = {}
    for at, m in ((3, "u"), (4, "v")):
        for y in (2000, 2001, 2002):
            own = {}
            for b in ("ALL", "D", "F"):
                x = np.array([r[2] / r[at] for r in rows if r[0] == y and b in ("ALL", r[1]) and r[2] and r[at] is not None and r[at] > 0])
                if len(x):
                    lo, hi = np.quantile(x, [0.2, 0.8])
                    own[b] = x if len(x) < 20 else x[(x >= lo - 1e-12) & (x <= hi + 1e-12)]
            want |= {(y, b, m): (round(float(np.median(x if len(x) >= 15 else own["ALL"])), 9), len(x)) for b, x in own.items()}
    assert {(r.y, r.bucket, r.metric): (round(r.rate, 9), r.n) for r in out.collect()} == want
    one = value.market_rates(df, ["y"], "b", "share", "u")
    assert one.columns == ["y", "bucket", "rate", "n"] and one.count() == sum(m == "u" for _, _, m in want)
    calls = []
    kept, value.sinks.cut = value.sinks.cut, lambda x: calls.append(x._jdf.queryExecution().analyzed().toString()) or kept(x)
    try:
        value.market_rates(df, ["y"], "b", "share", "u")
    finally:
        value.sinks.cut = kept
    assert calls and not any(re.search(r"\b(percentile|median)\(", plan) for plan in calls)


def test_every_row_has_statistics_of_its_neighbours(spark):
    """In the query and in its SQL, and knn_comps keeps the rows that it is asked for."""
    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r.t_id for r in catalogue.knn_term_stats(spark, sf).select("t_id").collect()} == ids
    found = duck(sf).sql(catalogue.ORACLES["knn_term_stats"]).df()
    assert set(found.t_id) == ids and (found.groupby("t_id").n.sum() == 5).all()
    assert {r.t_id for r in catalogue.knn_comps(spark, sf).select("t_id").collect()} == {i for i in ids if i % 50 == 0}
