"""Stints against a sequential walk; interval counts and shot sums; tiling."""

import numpy as np
import pytest

from tallyforge.operators import events as E
from tallyforge.operators import stints


def season(seed, games=3):
    rng = np.random.default_rng(seed)
    shifts, plays = [], []
    for g in range(games):
        for period in (1, 2):
            for team, base in (("HOM", 100), ("AWY", 200)):
                for p in range(8):
                    t = int(rng.integers(0, 60))
                    while t < 1200:
                        n = int(rng.integers(0, 90))
                        shifts.append((g, period, base + p, team, t, min(1200, t + n)))
                        t += n + int(rng.integers(1, 120))
            secs = np.sort(rng.integers(0, 1201, 40))
            for i, s in enumerate(secs):
                kind = str(rng.choice(["SHOT-ON-GOAL", "GOAL", "FACEOFF", "STOPPAGE", "HIT"], p=[0.4, 0.05, 0.2, 0.2, 0.15]))
                plays.append((g, period, int(s), period * 1000 + i, kind, str(rng.choice(["HOM", "AWY"])), str(rng.choice(["O", "D", "N"])), kind in ("SHOT-ON-GOAL", "GOAL"), float(rng.integers(1, 9)) / 16))
    return shifts, plays


def walk(shifts, plays, g, period):
    """The loop, one point after another."""
    own = {side: [(a, b, p) for gg, pp, p, t, a, b in shifts if (gg, pp, t) == (g, period, side)] for side in ("HOM", "AWY")}
    ev = [p for p in plays if p[0] == g and p[1] == period]
    kinds = {}
    for p in ev:
        kinds.setdefault(p[2], set()).add(p[4])
    starts = {t for t, k in kinds.items() if "FACEOFF" in k and ("STOPPAGE" in k or "STOPPAGE" in kinds.get(t - 1, ()))}
    grid = sorted({0, 1200, *kinds, *(x for side in own.values() for a, b, _ in side for x in (a, b))})
    at = lambda side, t: tuple(sorted({p for a, b, p in own[side] if a <= t < b}))

    def diff(t):
        past = [p for p in ev if p[2] <= t]
        return 0 if not past else past[-1][9] - past[-1][10]

    state = lambda j: (at("HOM", grid[j]), at("AWY", grid[j]), diff(grid[j - 1]))
    out, begin, open_ = [], grid[0], state(1)
    for j in range(1, len(grid)):
        now = state(j)
        if now != open_ or "GOAL" in kinds.get(grid[j], ()) or grid[j] in starts:
            out.append((begin, grid[j], open_))
            begin, open_ = grid[j], now
    out.append((begin, grid[-1], open_))
    return [(a, b, s, sum(p[8] for p in ev if p[7] and a < p[2] <= b and p[5] == "HOM")) for a, b, s in out if b > a]


@pytest.mark.parametrize("seed", [0, 1])
def test_stints_equal_the_walk(spark, seed):
    shifts, plays = season(seed)
    scored, h, a, last = [], 0, 0, None
    for p in sorted(plays, key=lambda p: (p[0], p[3])):
        if last != p[0]:
            h = a = 0
            last = p[0]
        h, a = h + (p[4] == "GOAL" and p[5] == "HOM"), a + (p[4] == "GOAL" and p[5] == "AWY")
        scored.append((*p, h, a))
    ev = spark.createDataFrame(scored, "gameId bigint, period int, eventSec bigint, event_seq bigint, type string, teamAbbrev string, faceoff_zone_home string, isFenwick boolean, xG double, home_score int, away_score int")
    sh = spark.createDataFrame(shifts, "gameId bigint, period int, playerId bigint, teamAbbrev string, startSec bigint, endSec bigint")
    games = spark.createDataFrame([(g, "HOM", "AWY") for g in range(3)], "gameId bigint, home_team string, away_team string")
    out = stints.build(ev, sh, games, sh.select("playerId").distinct()).toPandas()
    for g in range(3):
        for period in (1, 2):
            rows = out[(out.gameId == g) & (out.period == period)].sort_values("startSec")
            home = rows[rows.is_home == 1]
            want = walk(shifts, scored, g, period)
            got = [(r.startSec, r.endSec, tuple(r.players), tuple(r.opp_players), r.xGF) for r in home.itertuples()]
            assert got == [(a, b, s[0], s[1], x) for a, b, s, x in want]
            assert home.startSec.iloc[0] == 0 and home.endSec.iloc[-1] == 1200 and (home.startSec.values[1:] == home.endSec.values[:-1]).all()
            away = rows[rows.is_home == 0]
            assert (away.xGF.values == home.opp_xGF.values).all() and (away.zone_off.values == home.zone_def.values).all()


def test_on_ice_counts(spark):
    ev = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 50, 2), (1, 1, 1200, 3)], "gameId bigint, period int, eventSec bigint, event_seq bigint")
    sh = spark.createDataFrame([(1, 1, 10, True, False, 0, 50), (1, 1, 11, True, False, 0, 1200), (1, 1, 11, True, False, 0, 60), (1, 1, 30, True, True, 0, 1200), (1, 1, 20, False, False, 50, 60)], "gameId bigint, period int, playerId bigint, is_home boolean, isGoalie boolean, startSec bigint, endSec bigint")
    got = {r.event_seq: (r.home_skaters, r.away_skaters, r.pulled_home, r.pulled_away) for r in E.annotate_on_ice(ev, sh).collect()}
    assert got == {1: (2, 0, False, True), 2: (1, 1, False, True), 3: (0, 0, True, True)}


def test_plays_are_parsed(spark):
    json = '{"plays":[{"timeInPeriod":"01:00","typeDescKey":"goal","periodDescriptor":{"number":1},"situationCode":"1551","details":{"eventOwnerTeamId":1,"xCoord":80,"yCoord":5}},{"timeInPeriod":"bad","typeDescKey":"hit","period":2}]}'
    games = spark.createDataFrame([(7, 1, 2, json)], "gameId bigint, home_id bigint, away_id bigint, json string")
    rows = E.parse_plays(games).orderBy("event_seq").collect()
    assert rows[0].eventSec == 60 and rows[0].type == "GOAL" and rows[0].isFenwick and rows[0].dist == pytest.approx(np.hypot(9, 5)) and rows[0].strengthBucket == "EV"
    assert rows[1].eventSec is None and rows[1].period == 2 and not rows[1].isFenwick
