"""Registered queries of the whole plans: contract predictions, comparables, projections, market values, the goal table, game
matching, situation masters, expected goals on shifts and ratings of skaters, each called as it is over whole tables.

Orders stand for contracts and customers for their players; parts of a table that a plan wants in two tables are dealt by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import fixed
from tallyforge.operators import joins, models, stints, value
from tallyforge.plans import seasons
from tallyforge.plans.catalogue import _r, _t, query
from tallyforge.sources import files, sinks

# ---- contracts: predictions and comparables ---------------------------------------------------------------------------

BLOCKS = {"USAGE": ["a", "b"], "CTX": ["c"]}
K = 20


def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    o, k, cents = _t(spark, sf, "orders"), F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        k.alias("contract_id"), F.col("o_custkey").alias("playerId"), F.when(k % 3 == 0, "D").otherwise("F").alias("PosBucket"), (k % 8 + 1).cast("int").alias("length"), (F.col("o_totalprice") / 36871.37).alias("cap_pct"),
        ((cents * 7919 + k) % 10007).cast("double").alias("a"), ((cents * 104729 + k) % 9973).cast("double").alias("b"), F.when(k % 11 > 0, ((cents * 31 + k) % 8191).cast("double")).alias("c"),
    )


CONTRACTS = """o AS (SELECT o_orderkey AS id, o_custkey AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'F' END AS pos, o_orderkey % 8 + 1 AS len, o_totalprice / 36871.37::DOUBLE AS cap, ((round(o_totalprice * 100)::BIGINT * 7919 + o_orderkey) % 10007)::DOUBLE AS a, ((round(o_totalprice * 100)::BIGINT * 104729 + o_orderkey) % 9973)::DOUBLE AS b, CASE WHEN o_orderkey % 11 > 0 THEN ((round(o_totalprice * 100)::BIGINT * 31 + o_orderkey) % 8191)::DOUBLE END AS c FROM orders)"""
NEAREST = f"""{CONTRACTS}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_samp(a, a) AS caa, covar_samp(a, b) AS cab, covar_samp(b, b) AS cbb, avg(c) AS mc, stddev_pop(c) AS sc FROM o),
v AS (SELECT caa / (sa * sa) + 1e-6 AS x, cab / (sa * sb) AS y, cbb / (sb * sb) + 1e-6 AS w FROM m), z AS (SELECT o.*, (a - ma) / sa AS za, (b - mb) / sb AS zb, (c - mc) / sc AS zc FROM o, m),
d AS (SELECT t.id AS t, t.p AS tp, k.id AS k, k.p AS kp, k.len, k.cap, 2.0::DOUBLE * sqrt(greatest(0, (w * (t.za - k.za) ** 2 - 2 * y * (t.za - k.za) * (t.zb - k.zb) + x * (t.zb - k.zb) ** 2) / (x * w - y * y))) + coalesce(1.2::DOUBLE * abs(t.zc - k.zc), 0) AS dist
  FROM z t JOIN z k ON t.pos = k.pos, v WHERE t.id % 50 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY dist, k) AS r FROM d QUALIFY r <= {K}),
wt AS (SELECT *, exp(-0.85 * dist) ** 0.85 / sum(exp(-0.85 * dist) ** 0.85) OVER (PARTITION BY t) AS weight FROM n)"""


@query(f"""WITH {NEAREST}, g AS (SELECT t, len, count(*) AS n, sum(weight * cap) / sum(weight) AS knn, CASE WHEN count(*) >= 4 THEN quantile_cont(cap, 0.75) - quantile_cont(cap, 0.25) END AS iqr FROM wt GROUP BY t, len),
e AS (SELECT len, avg(a) AS ma, avg(b) AS mb, avg(cap) AS my FROM o GROUP BY len), q AS (SELECT len, sum((a - ma) ** 2) + 2 AS xx, sum((a - ma) * (b - mb)) AS xy, sum((b - mb) ** 2) + 2 AS yy, sum((a - ma) * (cap - my)) AS xt, sum((b - mb) * (cap - my)) AS yt FROM o JOIN e USING (len) GROUP BY len),
f AS (SELECT e.*, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS wa, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS wb FROM e JOIN q USING (len)),
s AS (SELECT id AS contract_id, f.len AS term, my + wa * (a - ma) + wb * (b - mb) AS model, n, knn, iqr, CASE WHEN coalesce(n, 0) = 0 THEN 0.8 WHEN n < 5 THEN 0.5 ELSE least(0.75, 0.5 + 0.1 * coalesce(iqr, 0) / 0.05) END AS w FROM o CROSS JOIN f LEFT JOIN g ON g.t = o.id AND g.len = f.len WHERE id % 50 = 0)
SELECT contract_id, term::INT AS term, round(model, 6) AS model, coalesce(n, 0) AS n, round(knn, 5) AS knn, round(iqr, 5) AS iqr, round(w, 5) AS w_model, round(coalesce(w * model + (1 - w) * knn, model, knn), 5) AS prediction FROM s""")
def predicted_terms(spark, sf):
    """What each asked contract would cost at each length: neighbours, the ridge model, and their blend."""
    train = _contracts(spark, sf)
    out = seasons.predict_terms(train, train.where("contract_id % 50 = 0"), BLOCKS, ["a", "b"], K)
    return out.select("contract_id", "term", _r("model", 6).alias("model"), F.coalesce("n", F.lit(0)).alias("n"), _r("knn", 5).alias("knn"), _r("iqr", 5).alias("iqr"), _r("w_model", 5).alias("w_model"), _r("prediction", 5).alias("prediction"))


@query(f"""WITH {NEAREST}, u AS (SELECT t, kp, max(weight) AS weight, min(dist) AS dist FROM wt WHERE kp <> tp GROUP BY t, kp), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY weight DESC, kp) AS i FROM u QUALIFY i <= 5)
SELECT t AS contract_id, max(CASE WHEN i = 1 THEN kp END) AS comp1, round(max(CASE WHEN i = 1 THEN weight END), 6) AS weight1, max(CASE WHEN i = 2 THEN kp END) AS comp2, round(max(CASE WHEN i = 2 THEN dist END), 5) AS dist2, max(CASE WHEN i = 5 THEN kp END) AS comp5 FROM r GROUP BY t""")
def contract_comparables(spark, sf):
    """The five nearest other players of each asked contract, side by side."""
    train = _contracts(spark, sf)
    out = seasons.comparables(train, train.where("contract_id % 50 = 0"), BLOCKS, K)
    return out.select(F.col("t_contract_id").alias("contract_id"), F.col("comp1_c_playerId").alias("comp1"), _r("comp1_weight", 6).alias("weight1"), F.col("comp2_c_playerId").alias("comp2"), _r("comp2_dist", 5).alias("dist2"), F.col("comp5_c_playerId").alias("comp5"))


# ---- projections ------------------------------------------------------------------------------------------------------

_GROWS = "CASE WHEN linear OR v < 0.2 THEN {x} - CASE WHEN linear THEN fall ELSE v / (9 - k) END ELSE {x} * CASE WHEN {r} IS NOT NULL THEN greatest(0.6, least(1.15, {r})) ELSE greatest(0.3, least(0.95, {t} ** 1.1)) END END"


@query(f"""WITH RECURSIVE b AS (SELECT o_custkey AS p, year(o_orderdate) AS y, sum(o_totalprice) / 3e5 AS g FROM orders GROUP BY ALL),
cv AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'D' ELSE 'F' END AS pos, 18 + o_orderkey % 21 AS age, avg(o_totalprice) AS m, min(o_totalprice + 1e5) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL),
ra AS (SELECT pos, age, lead(m) OVER w / m AS m, lead(lo) OVER w / lo AS lo, lead(hi) OVER w / hi AS hi FROM cv WINDOW w AS (PARTITION BY pos ORDER BY age)),
ta AS (SELECT pos, max_by(m, age) AS tm, max_by(lo, age) AS tlo, max_by(hi, age) AS thi FROM ra WHERE m IS NOT NULL GROUP BY pos),
c AS (SELECT c_custkey AS id, 1996 + c_custkey % 6 AS y, CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'F' END AS pos, 19 + c_custkey % 17 AS age FROM customer),
l AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY b.y DESC) AS i FROM c JOIN b ON b.p = c.id AND b.y < c.y QUALIFY i <= 3),
s AS (SELECT id, sum(g * CASE i WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END) / sum(CASE i WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END) AS base FROM l GROUP BY id),
r AS (SELECT id, pos, 0 AS k, age, base AS v, base AS lo, base AS hi, false AS linear, 0::DOUBLE AS fall, base FROM c JOIN s USING (id)
UNION ALL SELECT id, r.pos, k + 1, r.age + 1, {_GROWS.format(x="v", r="ra.m", t="tm")}, {_GROWS.format(x="r.lo", r="ra.lo", t="tlo")}, {_GROWS.format(x="r.hi", r="ra.hi", t="thi")}, linear OR v < 0.2, CASE WHEN NOT linear AND v < 0.2 THEN v / (9 - k) ELSE fall END, base
  FROM r LEFT JOIN ra ON ra.pos = r.pos AND ra.age = r.age JOIN ta ON ta.pos = r.pos WHERE k < 9)
SELECT c.id AS contract_id, round(max(base), 6) AS base, round(max(CASE WHEN k = 1 THEN v END), 6) AS year1, round(max(CASE WHEN k = 9 THEN v END), 6) + 0.0 AS year9, round(max(CASE WHEN k = 4 THEN r.lo END), 6) + 0.0 AS low4, round(max(CASE WHEN k = 4 THEN r.hi END), 6) + 0.0 AS high4, round(sum(CASE WHEN k BETWEEN 1 AND 8 THEN v END), 5) + 0.0 AS term8 FROM c LEFT JOIN r USING (id) GROUP BY c.id""")
def projected_contracts(spark, sf):
    """Each customer's contract with its base of the last three years, the years ahead and their band."""
    o = _t(spark, sf, "orders")
    bank = o.groupBy(F.col("o_custkey").alias("playerId"), F.year("o_orderdate").cast("bigint").alias("start_year")).agg((F.sum("o_totalprice") / 3e5).alias("GAR_total"))
    curve = o.groupBy(F.when(F.col("o_custkey") % 2 == 0, "D").otherwise("F").alias("pos"), (18 + F.col("o_orderkey") % 21).alias("age")).agg(F.avg("o_totalprice").alias("avg"), F.min(F.col("o_totalprice") + 1e5).alias("lower"), F.max("o_totalprice").alias("upper"))
    k = F.col("c_custkey")
    contracts = _t(spark, sf, "customer").select(k.alias("contract_id"), k.alias("playerId"), (1996 + k % 6).alias("start_year"), F.when(k % 2 == 0, "D").otherwise("F").alias("PosBucket"), (19 + k % 17).alias("age"))
    out = seasons.project_contracts(contracts, bank, curve)
    year = lambda c, i: _r(F.get(c, F.lit(i - 1)), 6)
    return out.select("contract_id", _r("base", 6).alias("base"), year("projection", 1).alias("year1"), (year("projection", 9) + F.lit(0.0)).alias("year9"), (year("projection_low", 4) + F.lit(0.0)).alias("low4"), (year("projection_high", 4) + F.lit(0.0)).alias("high4"), (_r(F.get("term_values", F.lit(7)), 5) + F.lit(0.0)).alias("term8"))


# ---- market -----------------------------------------------------------------------------------------------------------


def _years(table: dict[str, int]) -> str:
    return ", ".join(f"({k[:4]}, {v}::DOUBLE)" for k, v in table.items())


@query(f"""WITH cap(y, cap) AS (VALUES {_years(fixed.LEAGUE_CAP)}), low(y, least_) AS (VALUES {_years(fixed.MIN_SALARY)}),
k AS (SELECT l_suppkey AS p, year(l_shipdate) + 22 AS y, sum(l_extendedprice) / 1e6 - 1 AS "WAR", sum(l_discount * l_extendedprice) / 4e4 - 1 AS "SPAR" FROM lineitem GROUP BY ALL),
bl AS (SELECT n.p, n.y + 1 AS y, (0.55 * n."WAR" + coalesce(0.35 * a."WAR", 0) + coalesce(0.10 * b."WAR", 0)) / (0.55 + CASE WHEN a.p IS NULL THEN 0 ELSE 0.35 END + CASE WHEN b.p IS NULL THEN 0 ELSE 0.10 END) AS v FROM k n LEFT JOIN k a ON a.p = n.p AND a.y = n.y - 1 LEFT JOIN k b ON b.p = n.p AND b.y = n.y - 2),
f AS (SELECT bl.*, CASE WHEN p % 3 = 0 THEN 'D' ELSE 'F' END AS bucket, CASE WHEN y < 2015 THEN 71400000.0 ELSE (SELECT cap FROM cap WHERE cap.y = bl.y) END AS cap, coalesce((SELECT least_ FROM low WHERE low.y = bl.y), 775000) AS least_ FROM bl),
c AS (SELECT l_suppkey AS p, year(l_shipdate) + 22 AS y, l_quantity * 2e5 AS hit FROM lineitem WHERE l_linenumber > 1 AND l_quantity > 1),
j AS (SELECT f.y, bucket, hit / cap / v AS ratio FROM c JOIN f ON f.p = c.p AND f.y = c.y WHERE v > 0),
e AS (SELECT y, 'ALL' AS b, ratio FROM j UNION ALL SELECT * FROM j), q AS (SELECT y, b, count(*) AS n, quantile_cont(ratio, 0.2) AS lo, quantile_cont(ratio, 0.8) AS hi FROM e GROUP BY ALL),
m AS (SELECT y, b, median(ratio) AS own, count(*) AS n FROM e JOIN q USING (y, b) WHERE q.n < 20 OR ratio BETWEEN lo AND hi GROUP BY y, b), rt AS (SELECT y, b, CASE WHEN n >= 15 THEN own ELSE max(CASE WHEN b = 'ALL' THEN own END) OVER (PARTITION BY y) END AS rate FROM m),
x AS (SELECT f.*, coalesce((SELECT rate FROM rt WHERE rt.y = f.y AND b = bucket), (SELECT rate FROM rt WHERE rt.y = f.y AND b = 'ALL')) AS rate, CASE WHEN v > 2 THEN 2 + (v - 2) ** 0.6 WHEN v < -2 THEN -2 - (-v - 2) ** 0.7 ELSE v END AS z FROM f)
SELECT p AS "playerId", y AS year, round(v, 6) AS war, round(rate, 8) AS rate, round(greatest(greatest(z, 0) * rate * cap, least_), 1) AS usd, round(100 * greatest(greatest(z, 0) * rate * cap, least_) / cap, 6) AS pct FROM x""")
def market_values(spark, sf):
    """Rates by contract season and position, and each skater's price."""
    line = _t(spark, sf, "lineitem")
    skaters = line.groupBy(F.col("l_suppkey").alias("playerId"), (F.year("l_shipdate") + 22).cast("bigint").alias("start_year")).agg((F.sum("l_extendedprice") / 1e6 - 1).alias("WAR"), (F.sum(F.col("l_discount") * F.col("l_extendedprice")) / 4e4 - 1).alias("SPAR"))
    pos = lambda c: F.when(c % 3 == 0, "D").otherwise("F")
    skaters = skaters.withColumns({"Player": F.col("playerId").cast("string"), "PosBucket": pos(F.col("playerId"))})
    contracts = line.select(F.col("l_suppkey").alias("playerId"), (F.year("l_shipdate") + 22).cast("bigint").alias("start_year"), F.when(F.col("l_linenumber") == 1, "ELC").alias("level"), F.when(F.col("l_quantity") > 1, F.col("l_quantity") * 2e5).otherwise(0.0).alias("cap_hit"), pos(F.col("l_suppkey")).alias("PosBucket"))
    _, priced = seasons.market_and_values(skaters, contracts)
    return priced.select("playerId", "year", _r("WAR", 6).alias("war"), _r("rate_WAR", 8).alias("rate"), _r("usd_WAR", 1).alias("usd"), _r("pct_WAR", 6).alias("pct"))


@query("""WITH s AS (SELECT year(o_orderdate) + 25 AS y, o_custkey % 25 AS t, count(*)::DOUBLE AS gp, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS wins, sum(CASE WHEN o_orderkey % 2 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE AS points, sum(o_totalprice) / 1e5 AS gd FROM orders GROUP BY ALL),
r AS (SELECT y, gd / gp AS g, wins / gp AS w, points / gp AS p FROM s WHERE y >= 2020), v AS (SELECT y + a AS target, 3 - a AS k, g, w, p FROM r, (SELECT unnest([0, 1, 2]) AS a) WHERE y + a IN (SELECT y FROM r))
SELECT target AS start_year, round_even((sum(k) * sum(k * w * g) - sum(k * w) * sum(k * g)) / (sum(k) * sum(k * w * w) - sum(k * w) ** 2), 4) AS goals_per_win, round_even((sum(k) * sum(k * p * g) - sum(k * p) * sum(k * g)) / (sum(k) * sum(k * p * p) - sum(k * p) ** 2), 4) AS goals_per_point FROM v GROUP BY target""")
def goal_table(spark, sf):
    """Goals to a win and to a standing point by season."""
    o = _t(spark, sf, "orders")
    key = [(F.year("o_orderdate") + 25).cast("bigint").alias("year"), (F.col("o_custkey") % 25).alias("team")]
    won, tied = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5 == 0
    standings = o.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("gp"), F.sum(won.cast("double")).alias("wins"), F.sum(F.when(won, 2.0).when(tied, 1.0).otherwise(0.0)).alias("points"))
    teams = o.groupBy(*key).agg((F.sum("o_totalprice") / 1e5).alias("goal_diff"))
    return value.goal_table(standings, teams).select("start_year", "goals_per_win", "goals_per_point")


# ---- intervals --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT event_id, epoch(ts)::DOUBLE AS t, value FROM events), i AS (SELECT s_suppkey AS id, (SELECT min(t) FROM p) + (s_suppkey * 7919) % 2592000 AS a, power(10.0::DOUBLE, s_suppkey % 8) * (1 + s_suppkey % 3) AS len FROM supplier)
SELECT id, len::BIGINT AS seconds, count(event_id) AS n, round(coalesce(sum(value), 0), 2) + 0.0 AS total FROM i LEFT JOIN p ON t >= a AND t < a + len GROUP BY id, len""")
def intervals_without_keys(spark, sf):
    """Events within intervals of seconds to years that share no key with them."""
    points = _t(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "value").withColumn("t", F.col("us") / 1e6)
    first = points.agg(F.min("t").alias("first"))
    k = F.col("s_suppkey")
    made = _t(spark, sf, "supplier").crossJoin(F.broadcast(first)).select(k.alias("id"), (F.col("first") + (k * 7919) % 2592000).alias("a"), (F.pow(F.lit(10.0), k % 8) * (1 + k % 3)).alias("len")).withColumn("b", F.col("a") + F.col("len"))
    sums = joins.sums_in_intervals(points, made, ["id"], "t", "a", "b", {"n": None, "total": "value"})
    return made.join(sums, "id", "left").select("id", F.col("len").cast("bigint").alias("seconds"), F.coalesce("n", F.lit(0)).alias("n"), (_r(F.coalesce("total", F.lit(0.0)), 2) + F.lit(0.0)).alias("total"))


@query("""WITH s AS (SELECT l_orderkey AS g, l_partkey % 400 AS a, l_partkey % 400 + 5 + l_quantity::INT AS b, 4 + l_linenumber % 3 AS n, 4 + l_suppkey % 3 AS m FROM lineitem)
SELECT u.situation, count(*) AS n, sum(b - a)::BIGINT AS seconds FROM s JOIN (VALUES ('ES', 5, 5), ('PP', 5, 4), ('PP', 6, 5), ('PK', 4, 5), ('PK', 5, 6)) u(situation, x, y) ON s.n = u.x AND s.m = u.y WHERE b - a >= 10 GROUP BY u.situation""")
def stints_by_situation(spark, sf):
    """Stints that are long enough, by the numbers of skaters that each situation allows."""
    line = _t(spark, sf, "lineitem")
    n, m = 4 + F.col("l_linenumber") % 3, 4 + F.col("l_suppkey") % 3
    made = line.select((F.col("l_partkey") % 400).alias("startSec"), (F.col("l_partkey") % 400 + 5 + F.col("l_quantity").cast("int")).alias("endSec"), F.concat_ws("v", n.cast("string"), m.cast("string")).alias("strength_key"))
    out = None
    for situation in fixed.STRENGTHS:
        one = stints.for_situation(made, situation).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("endSec") - F.col("startSec")).cast("bigint").alias("seconds")).select(F.lit(situation).alias("situation"), "n", "seconds")
        out = one if out is None else out.unionByName(one)
    return out


# ---- texts and games --------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN (props ->> '$.k')::BIGINT END AS k, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS shown, event_id % 7 = 0 AS is_malformed FROM events""")
def variant_props(spark, sf):
    """Properties of events as VARIANT: alternative paths of a field, blanks, and texts that are cut off."""
    e = _t(spark, sf, "events")
    number = F.col("value").cast("string")
    nested = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "shown": {"x": '), (F.col("value") * 2).cast("string"), F.lit("}}"))).otherwise(F.concat(F.lit(', "shown": {"x": " "}, "old": "'), number, F.lit('"}')))
    whole = F.concat(F.regexp_replace("props", r"\}$", ""), nested)
    rows = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 6)).otherwise(whole).alias("json"))
    out = files.variant_fields(rows, "json", {"k": ("bigint", ["$.k"]), "shown": ("double", ["$.shown.x", "$.old"])})
    return out.select("event_id", "k", "shown", "is_malformed")


_TEAMS = sorted({code for code in fixed.TEAM_CODES.values()})
_NAMES = {code: name for name, code in reversed(list(fixed.TEAM_CODES.items()))}


@query(f"""WITH g AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_custkey % {len(_TEAMS)} AS h, (o_custkey + 1 + o_orderkey % {len(_TEAMS) - 1}) % {len(_TEAMS)} AS a FROM orders),
s AS (SELECT *, least(h, a) AS x, greatest(h, a) AS y FROM g WHERE h <> a), r AS (SELECT *, d + (id % 4)::INT - 1 AS shown FROM s),
m AS (SELECT r.id, s.id AS game, date_diff('day', r.shown, s.d) AS off, row_number() OVER (PARTITION BY r.id ORDER BY abs(date_diff('day', r.shown, s.d)), date_diff('day', r.shown, s.d), s.id) AS n FROM r JOIN s ON r.x = s.x AND r.y = s.y AND abs(date_diff('day', r.shown, s.d)) <= 1)
SELECT r.id, game AS game_id, off::INT AS day_offset FROM r LEFT JOIN m ON m.id = r.id AND n = 1""")
def matched_games(spark, sf):
    """Games that a second source names by text, a day or two off, matched to the schedule by teams and day."""
    k, n = F.col("o_orderkey"), len(_TEAMS)
    name = lambda at, table: F.element_at(F.array(*[F.lit(x) for x in table]), (at + 1).cast("int"))
    home, away = F.col("o_custkey") % n, (F.col("o_custkey") + 1 + k % (n - 1)) % n
    games = _t(spark, sf, "orders").select(k.alias("gameId"), F.col("o_orderdate").cast("date").alias("gameDate"), home.alias("h"), away.alias("a")).where("h <> a")
    side = lambda at, mark: F.struct(name(F.col(at), _TEAMS).alias("Team"), F.lit(mark).alias("home_or_away"))
    schedule = games.select("gameId", "gameDate", F.inline(F.array(side("h", "home"), side("a", "away"))))
    shown = F.date_add("gameDate", (F.col("gameId") % 4 - 1).cast("int"))
    title = F.concat(F.lit("Game "), F.col("gameId").cast("string"), F.lit(" - "), shown.cast("string"), F.lit(", Final"))
    raw = games.select("gameId", title.alias("Game"), F.explode(F.array(name(F.col("h"), [_NAMES[c] for c in _TEAMS]), name(F.col("a"), [_NAMES[c] for c in _TEAMS]))).alias("Team")).drop("gameId")
    found, rest = seasons.match_games(raw, schedule)
    own = F.regexp_extract("Game", r"Game (\d+)", 1).cast("bigint").alias("id")
    hits = found.select(own, F.col("gameId").alias("game_id"), "day_offset").distinct()
    return hits.unionByName(rest.select(own).distinct(), allowMissingColumns=True)


@query("""WITH s AS (SELECT 'Player ' || l_suppkey AS name, year(l_shipdate) AS season, l_suppkey AS id, l_linenumber AS n, l_orderkey AS seq, l_quantity AS q, l_tax AS t, l_discount AS d, CASE l_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'C' ELSE 'LW' END AS pos FROM lineitem),
t AS (SELECT id, season, min(q) AS lo FROM s GROUP BY ALL)
SELECT s.id, s.season, round(sum(q), 4) AS goals, round(sum(d * q) / sum(q), 6) AS rate, CASE WHEN any_value(pos) = 'D' THEN 'D' ELSE 'F' END AS bucket, CASE WHEN s.id % 5 = 0 THEN s.id + 1000000 WHEN s.id % 5 = 1 THEN s.id + 2000000 END AS found, 'ES' AS situation FROM s GROUP BY s.id, s.season""")
def situation_masters(spark, sf):
    """One row for each player of a season: summed counts, weighted rates, bucket, and the identifier by name and position
    or by name alone."""
    k = F.col("l_suppkey")
    line = _t(spark, sf, "lineitem").select(
        F.concat(F.lit("Player "), k.cast("string")).alias("Player"), F.year("l_shipdate").cast("bigint").alias("season"), F.when(k % 3 == 0, "D").when(k % 3 == 1, "C").otherwise("LW").alias("Position"), F.col("l_returnflag").alias("Team"),
        F.col("l_orderkey").alias("ingest_seq"), F.col("l_quantity").alias("goals"), F.col("l_discount").alias("rate"), F.col("l_quantity").alias("TOI"),
    )
    people = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("player "), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("seq"))
    ids = people.where("id % 5 = 0").withColumns({"PosBucket": F.when(F.col("id") % 3 == 0, "D").otherwise("F"), "id": F.col("id") + 1000000})
    names = people.where("id % 5 <= 1").withColumn("id", F.col("id") + 2000000)
    out = seasons.situation_master(line.drop("rate", "TOI"), line.select("Player", "season", "ingest_seq", "rate", "TOI"), "ES", ids, names)
    return out.select(F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("id"), "season", _r("goals").alias("goals"), _r("rate", 6).alias("rate"), F.col("PosBucket").alias("bucket"), F.col("playerId").alias("found"), F.col("Situation").alias("situation"))


def _game_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(plays, shifts, games, skaters) dealt from line items: an order is a game of one period, its lines are plays, and
    the parts of its lines are skaters who stay on for a while."""
    line, k = _t(spark, sf, "lineitem"), F.col("l_partkey")
    base = line.select(
        F.col("l_orderkey").alias("gameId"), F.lit(1).alias("period"), (k * 37 % 1200).cast("bigint").alias("eventSec"), (F.col("l_linenumber") * 100000 + k).alias("event_seq"), k, F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"),
        F.when(k % 2 == 0, "HOM").otherwise("AWY").alias("teamAbbrev"), (F.col("l_extendedprice") % 89).alias("x"),
    ).distinct()
    base = sinks.cut(base)  # the model, its scores and the shifts all read it
    kind = F.when(F.col("q") > 40, "GOAL").when(F.col("q") > 10, "SHOT-ON-GOAL").when(F.col("q") > 5, "FACEOFF").otherwise("STOPPAGE")
    plays = base.select("gameId", "period", "eventSec", "event_seq", kind.alias("type"), "teamAbbrev", (k % 2 == 0).alias("is_home"), F.col("x").alias("dist"), (F.col("s") % 90).cast("double").alias("angle"), (F.col("q") > 10).alias("isFenwick"), F.when(k % 5 == 0, "PP").otherwise("EV").alias("strengthBucket"), F.lit("N").alias("faceoff_zone_home"))
    shifts = base.groupBy("gameId", "period", F.col("s").alias("playerId")).agg(F.min("teamAbbrev").alias("teamAbbrev"), F.min("eventSec").alias("startSec")).withColumns({"endSec": F.least(F.col("startSec") + 300, F.lit(1200)).cast("bigint"), "shiftNumber": F.lit(1)})
    return plays, shifts, base.select("gameId").distinct().withColumns({"home_team": F.lit("HOM"), "away_team": F.lit("AWY")}), shifts.select("playerId").distinct()


@query()
def shots_on_shifts(spark, sf):
    """Expected goals from the model, attributed to the shifts that were on."""
    plays, shifts, _, _ = _game_tables(spark, sf)
    _, out, _ = seasons.shot_values(plays, shifts)
    return out.select("gameId", "playerId", _r("shift_xGF", 4).alias("xgf"), _r("shift_xGA", 4).alias("xga"), "fenwickF", "fenwickA")


def _scored_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    plays, shifts, games, skaters = _game_tables(spark, sf)
    return seasons.shot_values(plays, shifts)[0], shifts, games, skaters


@query()
def skater_ratings(spark, sf):
    """Stints from plays and shifts, and the ridge rates of skaters over all of them, whatever the numbers on the ice."""
    made = stints.segments(*_scored_tables(spark, sf)).where((F.size("home_") > 0) & (F.size("away_") > 0)).withColumn("strength_key", F.lit("5v5"))
    made = sinks.cut(stints.for_situation(made, "ES"))
    sinks.sweep(spark)
    # a stint is one row while it is stored and moved, and goes once to its fold and place
    folds = sinks.small(models.balanced_folds(made, "gameId"))
    made = sinks.cut(made.join(folds, "gameId").repartitionByRange(spark.sparkContext.defaultParallelism, "gameId", "period", "startSec"))
    del folds
    sinks.sweep(spark)
    alone = stints.sides(made, keep=["fold"]).withColumn("strength_key", F.lit("5v5"))
    out, _ = seasons.skater_rates(alone, "ES")
    return out.select("playerId", _r("off").alias("off"), _r("def").alias("def"), _r("total").alias("total"))
