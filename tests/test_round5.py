"""Stints in one shuffle, plays without a time, and sums of the sparse ridge by parts of features."""

import numpy as np

from tallyforge.operators import models, stints

PLAYS = "gameId bigint, period int, eventSec bigint, event_seq bigint, type string, teamAbbrev string, faceoff_zone_home string, isFenwick boolean, xG double, home_score int, away_score int"
SHIFTS = "gameId bigint, period int, playerId bigint, teamAbbrev string, startSec bigint, endSec bigint"


def stint_rows(spark, plays):
    shifts = spark.createDataFrame([(1, 1, 10, "HOM", 0, 600), (1, 1, 20, "AWY", 0, 1200)], SHIFTS)
    games = spark.createDataFrame([(1, "HOM", "AWY")], "gameId bigint, home_team string, away_team string")
    return stints.build(spark.createDataFrame(plays, PLAYS), shifts, games, shifts.select("playerId"))


def test_a_play_without_a_time_cuts_nothing(spark):
    plays = [(1, 1, 300, 2, "SHOT-ON-GOAL", "HOM", "N", True, 0.25, 0, 0), (1, 1, None, 1, "HIT", "HOM", "N", False, 0.0, 0, 0)]
    rows = stint_rows(spark, plays).where("is_home = 1").orderBy("startSec").collect()
    assert [(r.startSec, r.endSec, r.players, r.opp_players, r.xGF) for r in rows] == [(0, 600, [10], [20], 0.25), (600, 1200, [], [20], 0.0)]


def test_stints_move_shifts_and_plays_once(spark):
    plan = stint_rows(spark, [(1, 1, 300, 2, "GOAL", "HOM", "N", True, 0.25, 1, 0)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(gameId") == 1 and plan.count("Exchange hashpartitioning") <= 2


def test_sums_by_parts_of_features(spark, monkeypatch):
    monkeypatch.setattr(models, "FEATURES_A_PART", 7)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((50, 40)) < 0.1, rng.normal(size=(50, 40)), 0.0)
    w, y, fold = rng.uniform(1, 2, 50), rng.normal(size=50), np.arange(50) % 3
    rows = spark.createDataFrame([(int(fold[i]), [(int(f), float(x[i, f])) for f in np.flatnonzero(x[i])], float(w[i]), float(y[i])) for i in range(50)], "_fold int, xs array<struct<f:int,v:double>>, w double, y double").repartition(3)
    blocks, full, out_of, d = models._blocks(rows).cache(), np.c_[x, np.ones(50)], np.array([-2, 1]), rng.normal(size=(2, 41))
    want = [full.T @ (w * (fold != k) * (full @ d[i])) for i, k in enumerate(out_of)]
    assert np.allclose(models._summed(blocks, 40, out_of, d), want)
    first = models._summed(blocks, 40, out_of, None)
    assert np.allclose(first, [full.T @ (w * (fold != k) * y) for k in out_of] + [(full * full).T @ (w * (fold != k)) for k in out_of])


def test_rows_without_cells_and_features_without_rows(spark):
    """A row of zeros still counts for the intercept, and features that no row has get 0."""
    long = spark.createDataFrame([(0, 0, 1.0, 1.0, 3.0), (1, 0, 0.0, 1.0, 1.0), (2, 1, 0.0, 2.0, 1.0)], "row long, f int, v double, w double, y double")
    got = models.ridge_sparse(long, ["row"], "f", "v", "w", "y", grid=(1.0,), features=5)
    x, w, y = np.array([1.0, 0.0, 0.0]), np.array([1.0, 1.0, 2.0]), np.array([3.0, 1.0, 1.0])
    mx, my = w @ x / 4, w @ y / 4
    b = (w * (x - mx)) @ (y - my) / ((w * (x - mx)) @ (x - mx) + 1.0)
    assert np.allclose(got["beta"], [b, 0, 0, 0, 0]) and np.isclose(got["intercept"], my - mx * b)
