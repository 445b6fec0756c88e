"""The registered queries over the driver's tables, each by the library's operators, with its SQL.

Suppliers stand for skaters, nations for teams, regions for position groups, line items for stat rows, orders for
contracts, customers for the master of people, events for play by play.  Measures are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import schema as S
from tallyforge.functions import fixed, numeric, text
from tallyforge.operators import comps, joins, models, ranks, stats, stints, value
from tallyforge.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 4):
    return F.round(c, digits)


def _seconds(c):
    """Whole seconds since 2024 of a local timestamp."""
    return F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), c).cast("bigint")


SECONDS = "date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts))"


@query("SELECT l_suppkey, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS rate, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def rate_per_unit(spark, sf):
    sums = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return sums.select("l_suppkey", _r(numeric.ratio(F.col("p"), F.col("q"))).alias("rate"), "n")


@query("""SELECT l_partkey, round(CASE WHEN sum(w) > 0 THEN sum(l_extendedprice * w) / sum(w) ELSE avg(l_extendedprice) END, 6) AS mean
FROM (SELECT l_partkey, l_extendedprice, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END AS w FROM lineitem) GROUP BY l_partkey""")
def weighted_mean_fallback(spark, sf):
    rows = _t(spark, sf, "lineitem").withColumn("w", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0))
    return rows.groupBy("l_partkey").agg(_r(stats.weighted_mean("l_extendedprice", "w"), 6).alias("mean"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS trimmed FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice <= hi GROUP BY l_returnflag""")
def trimmed_weighted_mean(spark, sf):
    out = stats.weighted_trimmed_mean(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", drop_high=0.05)
    return out.select("l_returnflag", _r("trimmed").alias("trimmed"))


def _suppliers(spark, sf) -> DataFrame:
    """Production by supplier with its nation and region."""
    sums = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("prod"), F.sum("l_quantity").alias("toi"), F.count_distinct("l_orderkey").alias("gp"))
    dims = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
    return sums.join(dims, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "n_nationkey", "n_regionkey", "prod", "toi", "gp", (F.col("prod") / F.col("toi")).alias("rate"))


SUPPLIERS = """s AS (SELECT s_suppkey, n_nationkey, n_regionkey, sum(l_extendedprice) AS prod, sum(l_quantity) AS toi, count(DISTINCT l_orderkey) AS gp, sum(l_extendedprice) / sum(l_quantity) AS rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


@query(f"WITH {SUPPLIERS} SELECT s_suppkey, n_nationkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY toi DESC, s_suppkey) AS rank FROM s) WHERE rank > 2 AND gp >= 10 AND toi >= 100")
def replacement_pool(spark, sf):
    ranked = ranks.rank_first(_suppliers(spark, sf), ["n_nationkey"], [F.col("toi").desc(), F.col("s_suppkey")])
    return ranked.where("rank > 2 and gp >= 10 and toi >= 100").select("s_suppkey", "n_nationkey", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SUPPLIERS}, p AS (SELECT n_regionkey, sum(rate * toi) / sum(toi) AS pool FROM s GROUP BY n_regionkey) SELECT s_suppkey, round(toi / (toi + 300) * rate + 300 / (toi + 300) * pool, 4) AS shrunk FROM s JOIN p USING (n_regionkey)")
def shrunk_rate(spark, sf):
    s = _suppliers(spark, sf)
    pool = s.groupBy("n_regionkey").agg(stats.weighted_mean("rate", "toi").alias("pool"))
    w = numeric.shrink(F.col("toi"), 300.0)
    return s.join(F.broadcast(pool), "n_regionkey").select("s_suppkey", _r(w * F.col("rate") + (1 - w) * F.col("pool")).alias("shrunk"))


@query(f"""WITH {SUPPLIERS}, k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY toi DESC, s_suppkey) AS rank FROM s),
pool AS (SELECT * FROM k WHERE rank > 2 AND gp >= 10), q AS (SELECT n_regionkey, quantile_cont(rate, 0.95) AS hi FROM pool GROUP BY n_regionkey),
lv AS (SELECT n_regionkey, sum(rate * toi) / sum(toi) AS level FROM pool JOIN q USING (n_regionkey) WHERE rate <= hi GROUP BY n_regionkey),
v AS (SELECT s_suppkey, n_regionkey, level, toi / (toi + 300) * rate + 300 / (toi + 300) * level AS shr, toi FROM s JOIN lv USING (n_regionkey)),
g AS (SELECT s_suppkey, n_regionkey, round((shr - level) * toi / 60, 4) AS gar FROM v)
SELECT s_suppkey, n_regionkey, gar, round(100.0 * (rank() OVER (PARTITION BY n_regionkey ORDER BY gar) + (count(*) OVER (PARTITION BY n_regionkey, gar) - 1) / 2.0) / count(*) OVER (PARTITION BY n_regionkey), 3) AS pct FROM g""")
def gar_value(spark, sf):
    s = _suppliers(spark, sf)
    pool = ranks.rank_first(s, ["n_nationkey"], [F.col("toi").desc(), F.col("s_suppkey")]).where("rank > 2 and gp >= 10")
    levels = stats.weighted_trimmed_mean(pool, ["n_regionkey"], "rate", "toi", drop_high=0.05, out="level")
    w = numeric.shrink(F.col("toi"), 300.0)
    v = s.join(F.broadcast(levels), "n_regionkey").withColumn("shr", w * F.col("rate") + (1 - w) * F.col("level"))
    g = v.select("s_suppkey", "n_regionkey", _r((F.col("shr") - F.col("level")) * F.col("toi") / 60).alias("gar"))
    return ranks.pct_rank_avg(g, ["n_regionkey"], "gar", "pct", digits=None).select("s_suppkey", "n_regionkey", "gar", _r("pct", 3).alias("pct"))


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 5 THEN p_size END AS x FROM part)
SELECT p_partkey, CASE WHEN x IS NOT NULL THEN round(100.0 * (rank() OVER (PARTITION BY p_brand, x IS NULL ORDER BY x) + (count(x) OVER (PARTITION BY p_brand, x) - 1) / 2.0) / count(x) OVER (PARTITION BY p_brand), 3) END AS pct FROM p""")
def percentile_avg_ties(spark, sf):
    out = ranks.pct_rank_avg(_t(spark, sf, "part"), ["p_brand"], "p_size", "pct", F.col("p_size") > 5, digits=None)
    return out.select("p_partkey", _r("pct", 3).alias("pct"))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
b AS (SELECT a.o_custkey, a.y, a.v, p.v AS v1, q.v AS v2 FROM y a LEFT JOIN y p ON p.o_custkey = a.o_custkey AND p.y = a.y - 1 LEFT JOIN y q ON q.o_custkey = a.o_custkey AND q.y = a.y - 2)
SELECT o_custkey, y, round((0.55 * v + coalesce(0.35 * v1, 0) + coalesce(0.10 * v2, 0)) / (0.55 + CASE WHEN v1 IS NULL THEN 0 ELSE 0.35 END + CASE WHEN v2 IS NULL THEN 0 ELSE 0.10 END), 7) AS blended FROM b""")
def three_period_blend(spark, sf):
    y = _t(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    out = value.season_blend(y, "o_custkey", "y", ["v"])
    return out.select("o_custkey", "y", _r("v", 7).alias("blended"))


@query("""WITH f AS (SELECT nullif(l_suppkey, 1) AS k, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
a AS (SELECT k, q FROM f WHERE f = 'A'), n AS (SELECT k, q FROM f WHERE f = 'N'), r AS (SELECT k, q FROM f WHERE f = 'R' AND q > 5000),
an AS (SELECT coalesce(a.k, n.k) AS k, a.q AS q_A, n.q AS q_N FROM a FULL JOIN n ON a.k IS NOT DISTINCT FROM n.k)
SELECT coalesce(an.k, r.k) AS k, q_A AS "q_A", q_N AS "q_N", r.q AS "q_R" FROM an FULL JOIN r ON an.k IS NOT DISTINCT FROM r.k""")
def situation_outer_merge(spark, sf):
    rows = _t(spark, sf, "lineitem").withColumn("k", F.nullif("l_suppkey", F.lit(1)))
    f = rows.groupBy("k", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    part = lambda x: f.where(F.col("l_returnflag") == x).select("k", "q")
    return joins.outer_facts({"A": part("A"), "N": part("N"), "R": part("R").where("q > 5000")}, ["k"])


@query("""WITH a AS (SELECT nullif(c_custkey % 500, 7) AS k, max(c_acctbal) AS v, count(*) AS n FROM customer WHERE c_custkey % 500 < 400 GROUP BY 1),
b AS (SELECT nullif(c_custkey % 500, 7) AS k, max(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS v FROM customer WHERE c_custkey % 500 >= 300 OR c_custkey % 500 = 7 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, n FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def upsert_coalesce(spark, sf):
    c = _t(spark, sf, "customer").withColumn("m", F.col("c_custkey") % 500).withColumn("k", F.nullif("m", F.lit(7)))
    old = c.where("m < 400").groupBy("k").agg(F.max("c_acctbal").alias("v"), F.count(F.lit(1)).alias("n"))
    new = c.where("m >= 300 or m = 7").groupBy("k").agg(F.max(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("v"))
    return joins.upsert_coalesce(old, new, ["k"]).select("k", "v", "n")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders),
m AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS d FROM o) SELECT o_orderkey, o_custkey, s FROM m WHERE s IS NOT NULL OR d = 0""")
def baseline_row_drop(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return joins.drop_baseline(o, ["o_custkey"], "s")


@query("""WITH a AS (SELECT o_orderkey, o_custkey % 97 AS k, o_orderdate::DATE AS d FROM orders), b AS (SELECT l_orderkey, l_suppkey % 97 AS k, l_shipdate::DATE AS sd, min(l_linenumber) AS ln FROM lineitem GROUP BY ALL),
m AS (SELECT o_orderkey, l_orderkey, sd, date_diff('day', d, sd)::INT AS dist FROM a JOIN b ON a.k = b.k AND abs(date_diff('day', d, sd)) <= 1)
SELECT o_orderkey, l_orderkey, sd::VARCHAR AS ship_date, dist AS day_offset FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(dist), dist, l_orderkey) AS r FROM m) WHERE r = 1""")
def tolerant_date_match(spark, sf):
    a = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("k"), F.to_date("o_orderdate").alias("d"))
    b = _t(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 97).alias("k"), F.to_date("l_shipdate").alias("ship_date")).agg(F.min("l_linenumber").alias("ln"))
    out = joins.tolerant_date_join(a, b, ["k"], "d", "ship_date", ["o_orderkey"], 1, [F.col("l_orderkey")])
    return out.select("o_orderkey", "l_orderkey", F.col("ship_date").cast("string").alias("ship_date"), "day_offset")


@query(f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS view_id, value FROM events WHERE event_type = 'view')
SELECT p.event_id, v.view_id, round(v.value, 4) AS view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_event(spark, sf):
    e = _t(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), "value")
    out = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", ["view_id", "value"], ["view_id"])
    return out.select("event_id", "view_id", _r("value").alias("view_value"))


def _view_intervals(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), _seconds(F.col("ts")).alias("start"))
    stop = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "view_id"))
    return e.withColumn("stop", stop).where("stop is not null")


VIEWS = f"iv AS (SELECT * FROM (SELECT user_id, event_id AS view_id, {SECONDS} AS start, lead({SECONDS}) OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) AS stop FROM events WHERE event_type = 'view') WHERE stop IS NOT NULL)"


@query(f"""WITH {VIEWS}, p AS (SELECT user_id, {SECONDS} AS t, value, event_type FROM events WHERE event_type <> 'view')
SELECT view_id, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS value_for, round(coalesce(sum(value) FILTER (event_type <> 'purchase'), 0), 4) AS value_against, count(*) FILTER (event_type = 'purchase') AS n_for, count(*) FILTER (event_type <> 'purchase') AS n_against
FROM iv LEFT JOIN p ON p.user_id = iv.user_id AND t >= start AND t < stop GROUP BY view_id""")
def interval_point_join(spark, sf):
    points = _t(spark, sf, "events").where("event_type <> 'view'").select("user_id", _seconds(F.col("ts")).alias("t"), "value", F.col("event_type").alias("kind"))
    iv = _view_intervals(spark, sf).withColumn("own", F.lit("purchase"))
    out = joins.attribute_points_to_intervals(iv, points, ["user_id"], ["view_id"], "t", "start", "stop", "value", "own", "kind")
    return out.select("view_id", _r("value_for").alias("value_for"), _r("value_against").alias("value_against"), "n_for", "n_against")


@query(f"""WITH {VIEWS}, p AS (SELECT event_id, {SECONDS} AS t FROM events WHERE event_type = 'purchase')
SELECT event_id, count(DISTINCT user_id) AS n_active, coalesce(bool_or(user_id % 10 = 0), false) AS any_flag FROM p LEFT JOIN iv ON t >= start AND t < stop GROUP BY event_id""")
def onice_counts(spark, sf):
    points = _t(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.lit(1).alias("g"), _seconds(F.col("ts")).alias("t"))
    iv = _view_intervals(spark, sf).withColumn("g", F.lit(1))
    out = joins.active_counts_at(points, iv, ["g"], ["event_id"], "t", "start", "stop", "user_id", F.col("user_id") % 10 == 0, bin_size=21600)
    return out.select("event_id", "n_active", "any_flag")


@query(f"""WITH {VIEWS}, p AS (SELECT user_id, {SECONDS} AS t, value FROM events WHERE event_type = 'click') SELECT view_id, round(coalesce(sum(value), 0), 4) AS total FROM iv LEFT JOIN p ON p.user_id = iv.user_id AND t > start AND t <= stop GROUP BY view_id""")
def range_sum_half_open(spark, sf):
    clicks = _t(spark, sf, "events").where("event_type = 'click'").select("user_id", _seconds(F.col("ts")).alias("t"), "value")
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    run = clicks.select("user_id", "t", F.sum("value").over(w).alias("run")).distinct()
    out = joins.as_of(_view_intervals(spark, sf), run, ["user_id"], "start", "t", ["run"], prefix="s_")
    out = joins.as_of(out, run, ["user_id"], "stop", "t", ["run"], prefix="e_")
    total = F.coalesce("e_run", F.lit(0.0)) - F.coalesce("s_run", F.lit(0.0))
    return out.select("view_id", (_r(total) + F.lit(0.0)).alias("total"))


@query(f"""WITH {VIEWS}, p AS (SELECT event_id, {SECONDS} AS t FROM events WHERE event_type = 'signup') SELECT event_id, coalesce(string_agg(DISTINCT (user_id % 20)::VARCHAR, ',' ORDER BY (user_id % 20)::VARCHAR), '') AS active FROM p LEFT JOIN iv ON t >= start AND t < stop GROUP BY event_id""")
def active_set(spark, sf):
    points = _t(spark, sf, "events").where("event_type = 'signup'").select("event_id", F.lit(1).alias("g"), _seconds(F.col("ts")).alias("t"))
    iv = _view_intervals(spark, sf).select(F.lit(1).alias("g"), "start", "stop", (F.col("user_id") % 20).cast("string").alias("who"))
    out = joins.active_set_at(points, iv, ["g"], ["event_id"], "t", "start", "stop", "who", bin_size=21600)
    return out.select("event_id", F.array_join("active", ",").alias("active"))


@query("SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS score FROM events")
def running_score(spark, sf):
    e = _t(spark, sf, "events")
    return ranks.running_sum(e, ["user_id"], [F.col("ts"), F.col("event_id")], (F.col("event_type") == "purchase").cast("int"), "score").select("event_id", F.col("score").cast("bigint").alias("score"))


@query("""SELECT event_id, next_value FROM (SELECT event_id, event_type, round(first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4) AS next_value FROM events) WHERE event_type = 'error'""")
def next_nonnull(spark, sf):
    out = ranks.next_non_null(_t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "purchase", F.col("value")), "next_value")
    return out.where("event_type = 'error'").select("event_id", _r("next_value").alias("next_value"))


@query("WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events) SELECT user_id, day::VARCHAR AS day, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) = 1 THEN 1 ELSE 0 END AS b2b FROM d")
def back_to_back(spark, sf):
    return ranks.back_to_back(_t(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day").withColumn("day", F.col("day").cast("string"))


@query("""WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR event_type = 'purchase' THEN 1 ELSE 0 END AS c, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, (sum(CASE WHEN r = 1 THEN 0 ELSE c END) OVER (PARTITION BY user_id ORDER BY r))::BIGINT AS island FROM a)
SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_id, round(sum(value), 4) AS total FROM i GROUP BY user_id, island, event_type""")
def stint_islands(spark, sf):
    out = stints.islands(_t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"], F.col("event_type") == "purchase")
    return out.groupBy("user_id", F.col("island").cast("bigint").alias("island"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), _r(F.sum("value")).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def keep_last_dedupe(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ranks.last_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT concat_ws('|', least(a.n_name, b.n_name), greatest(a.n_name, b.n_name)) AS pair, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1""")
def pair_key(spark, sf):
    n = _t(spark, sf, "nation")
    s = _t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("a"))
    c = _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("b"))
    by = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    return by.join(s, "l_suppkey").join(o, "l_orderkey").groupBy(stats.pair_key(F.col("a"), F.col("b")).alias("pair")).agg(F.sum("n").alias("n"))


@query("""SELECT l_suppkey, string_agg(l_returnflag, ',' ORDER BY d, l_returnflag) AS flags, first(l_returnflag ORDER BY d, l_returnflag) AS first_flag FROM (SELECT l_suppkey, l_returnflag, min(l_shipdate) AS d FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def ordered_distinct_list(spark, sf):
    first = _t(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_shipdate").alias("d"))
    return first.groupBy("l_suppkey").agg(stats.ordered_distinct(F.col("d"), "l_returnflag").alias("flags"), F.min_by("l_returnflag", F.struct("d", "l_returnflag")).alias("first_flag"))


@query("""WITH m AS (SELECT median(o_totalprice) AS med FROM orders), o AS (SELECT o_orderstatus, o_orderpriority, abs(o_totalprice - med) AS e FROM orders, m)
SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS group_by, o_orderstatus, o_orderpriority, count(*) AS n, round(avg(e), 3) AS mae, round(median(e), 3) AS median_error
FROM o GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def grouping_sets_errors(spark, sf):
    o = _t(spark, sf, "orders")
    rows = o.crossJoin(F.broadcast(stats.quantile_columns(o, [], "o_totalprice", {"med": 0.5}))).withColumn("e", F.abs(F.col("o_totalprice") - F.col("med")))
    dims = ["o_orderstatus", "o_orderpriority"]
    means = stats.grouping_sets(rows, dims, [F.count(F.lit(1)).alias("n"), _r(F.avg("e"), 3).alias("mae")])
    medians = stats.grouping_set_quantiles(rows, dims, "e", {"median_error": 0.5})
    return joins.null_safe(means, medians, ["group_by", *dims]).withColumn("median_error", _r("median_error", 3))


@query("SELECT least(floor(greatest(0, least(20, l_quantity))), 19)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_clipped(spark, sf):
    return stats.histogram(_t(spark, sf, "lineitem"), "l_quantity", 0, 20, 20)


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]) + ") ORDER BY abs(r) DESC LIMIT 12")
def corr_top_pairs(spark, sf):
    return stats.corr_top_pairs(_t(spark, sf, "lineitem"), _MEASURES).select("a", "b", _r("r", 6).alias("r"))


@query("SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS pct FROM lineitem GROUP BY l_returnflag")
def share_flag(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(_r(stats.share(F.col("l_discount") > 0.05)).alias("pct"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority")
def term_stats(spark, sf):
    o = _t(spark, sf, "orders")
    ends = o.groupBy("o_orderpriority").agg(_r(F.avg("o_totalprice"), 3).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return ends.join(stats.quantile_columns(o, ["o_orderpriority"], "o_totalprice", {"median": 0.5}), "o_orderpriority").withColumn("median", _r("median", 3))


@query("""WITH r AS (SELECT year(o_orderdate) AS y, o_orderstatus AS b, (o_totalprice / 1e6) / c_acctbal AS ratio FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 0),
e AS (SELECT y, 'ALL' AS b, ratio FROM r UNION ALL SELECT * FROM r), q AS (SELECT y, b, count(*) AS n, quantile_cont(ratio, 0.2) AS lo, quantile_cont(ratio, 0.8) AS hi FROM e GROUP BY ALL),
m AS (SELECT y, b, median(ratio) AS own, count(*) AS n FROM e JOIN q USING (y, b) WHERE q.n < 20 OR ratio BETWEEN lo AND hi GROUP BY y, b)
SELECT y, b AS bucket, round(CASE WHEN n >= 15 THEN own ELSE max(CASE WHEN b = 'ALL' THEN own END) OVER (PARTITION BY y) END, 9) AS rate, n FROM m""")
def market_rate_bucket(spark, sf):
    rows = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("b"), (F.col("o_totalprice") / 1e6).alias("share"), "c_acctbal")
    out = value.market_rates(rows, ["y"], "b", "share", "c_acctbal")
    return out.select("y", "bucket", _r("rate", 9).alias("rate"), "n")


@query("""WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS v FROM customer), c AS (SELECT c_custkey, CASE WHEN v > 2 THEN 2 + (v - 2) ** 0.6 WHEN v < -2 THEN -2 - (-v - 2) ** 0.7 ELSE v END AS k FROM x)
SELECT c_custkey, round(greatest(greatest(k, 0) * 0.011 * 88000000, 775000), 2) AS price, round(100 * greatest(greatest(k, 0) * 0.011 * 88000000, 775000) / 88000000, 6) AS cap_pct FROM c""")
def price_compress(spark, sf):
    p = numeric.price(F.col("c_acctbal") / 1000, F.lit(0.011), F.lit(88000000.0), F.lit(775000.0))
    return _t(spark, sf, "customer").select("c_custkey", F.round(p, 2).alias("price"), _r(100 * p / 88000000, 6).alias("cap_pct"))


@query("""WITH m AS (SELECT o_orderpriority AS p, median(o_totalprice) AS med FROM orders GROUP BY 1), e AS (SELECT p, abs(o_totalprice - med) / nullif(abs(o_totalprice), 0) AS ape FROM orders JOIN m ON o_orderpriority = p)
SELECT p AS priority, round(median(ape), 6) AS median_ape, round(quantile_cont(ape, 0.75) - quantile_cont(ape, 0.25), 6) AS iqr_ape FROM e GROUP BY p""")
def ape_iqr(spark, sf):
    o = _t(spark, sf, "orders")
    med = stats.quantile_columns(o, ["o_orderpriority"], "o_totalprice", {"med": 0.5})
    rows = o.join(F.broadcast(med), "o_orderpriority").withColumn("ape", stats.ape(F.col("o_totalprice"), F.col("med")))
    found = stats.quantile_columns(rows, ["o_orderpriority"], "ape", {"median_ape": 0.5, "low": 0.25, "high": 0.75})
    return found.select(F.col("o_orderpriority").alias("priority"), _r("median_ape", 6).alias("median_ape"), _r(F.col("high") - F.col("low"), 6).alias("iqr_ape"))


@query("""WITH b AS (SELECT year(o_orderdate) AS y, o_custkey % 25 AS t, count(*)::DOUBLE AS n, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY ALL),
s AS (SELECT y + a AS target, 3 - a AS w, n AS x, v FROM b, (SELECT unnest([0, 1, 2]) AS a) WHERE y + a IN (SELECT y FROM b))
SELECT target, round(CASE WHEN count(*) >= 3 THEN (sum(w) * sum(w * x * v) - sum(w * x) * sum(w * v)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) END, 4) AS slope FROM s GROUP BY target""")
def wls_slope(spark, sf):
    b = _t(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_custkey") % 25).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("x"), (F.sum("o_totalprice") / 1000).alias("v"))
    return stats.wls_slope_window(b, "y", "x", "v").select("target", _r("slope").alias("slope"))


def _knots_sql() -> str:
    rows = []
    for (source, pos), knots in fixed.AGE_KNOTS.items():
        rows += [f"('{source}', '{pos}', {x0}, {y0}::DOUBLE, {x1}, {y1}::DOUBLE)" for (x0, y0), (x1, y1) in zip(knots[:-1], knots[1:], strict=True)]
    return ", ".join(rows)


@query(f"""WITH k(source, pos, x0, y0, x1, y1) AS (VALUES {_knots_sql()}), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'D' END AS pos, 16 + (c_custkey % 97) / 4.0::DOUBLE AS age FROM customer),
v AS (SELECT c_custkey, source, pos, age, max(CASE WHEN age BETWEEN x0 AND x1 THEN y0 + (y1 - y0) * (age - x0) / (x1 - x0)::DOUBLE END) AS inner_, min_by(y0, x0) AS first_, max_by(y1, x1) AS last_ FROM c JOIN k USING (pos) GROUP BY ALL),
w AS (SELECT *, greatest(0, least(1.05, coalesce(inner_, CASE WHEN age < 18 THEN first_ ELSE last_ END))) AS raw FROM v), p AS (SELECT *, raw / max(raw) OVER (PARTITION BY source, pos) AS v FROM w)
SELECT c_custkey, pos, round(avg(v), 7) AS avg, round(min(v), 7) AS lower, round(max(v), 7) AS upper FROM p GROUP BY c_custkey, pos""")
def age_curve(spark, sf):
    """The three published curves at the age of each customer, each over its peak among them: mean, least and greatest."""
    knots = [(source, pos, [{"x": float(x), "y": y} for x, y in ks]) for (source, pos), ks in fixed.AGE_KNOTS.items()]
    curves = spark.createDataFrame(knots, "source string, pos string, knots array<struct<x double, y double>>")
    people = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("D").alias("pos"), (16 + (F.col("c_custkey") % 97) / 4.0).alias("age"))
    rows = people.join(F.broadcast(curves), "pos").withColumn("raw", numeric.piecewise(F.col("age"), F.col("knots")))
    rows = ranks.over_peak(rows, ["source", "pos"], "raw", "v")
    return rows.groupBy("c_custkey", "pos").agg(_r(F.avg("v"), 7).alias("avg"), _r(F.min("v"), 7).alias("lower"), _r(F.max("v"), 7).alias("upper"))


@query("""WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL), r AS (SELECT *, lead(v) OVER (PARTITION BY p ORDER BY y) / v AS ratio FROM y)
SELECT p, y, round(ratio, 6) AS ratio, round(last_value(ratio IGNORE NULLS) OVER (PARTITION BY p ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS tail_ratio FROM r""")
def adjacent_ratio(spark, sf):
    y = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return ranks.adjacent_ratio(y, ["p"], "y", "v").select("p", "y", _r("ratio", 6).alias("ratio"), _r("tail_ratio", 6).alias("tail_ratio"))


_STEP = "CASE WHEN linear OR v < 0.2 THEN {x} - CASE WHEN linear THEN fall ELSE v / (9 - k) END ELSE {x} * CASE WHEN age < 30 THEN CASE WHEN {r} <= 0 THEN 1 ELSE greatest(0.6, least(1.15, {r})) END ELSE greatest(0.3, least(0.95, {t} ** 1.1)) END END"


@query(f"""WITH RECURSIVE r AS (SELECT c_custkey, 0 AS k, c_acctbal / 1000 AS v, c_acctbal / 1000 AS lo, c_acctbal / 1000 AS hi, round_even(20 + (c_custkey % 37) / 2.0::DOUBLE, 0)::INT AS age, false AS linear, 0::DOUBLE AS fall FROM customer
UNION ALL SELECT c_custkey, k + 1, {_STEP.format(x="v", r="(1.6 - 0.025 * age)", t="0.85::DOUBLE")}, {_STEP.format(x="lo", r="(CASE WHEN age = 25 THEN -0.5 ELSE 1.5 - 0.025 * age END)", t="0.8::DOUBLE")}, {_STEP.format(x="hi", r="(1.7 - 0.025 * age)", t="0.9::DOUBLE")},
  age + 1, linear OR v < 0.2, CASE WHEN NOT linear AND v < 0.2 THEN v / (9 - k) ELSE fall END FROM r WHERE k < 9)
SELECT c_custkey, round(max(CASE WHEN k = 1 THEN v END), 9) AS year1, round(max(CASE WHEN k = 5 THEN v END), 9) + 0.0 AS year5, round(max(CASE WHEN k = 9 THEN v END), 9) + 0.0 AS year9, round(max(CASE WHEN k = 6 THEN lo END), 9) + 0.0 AS low6, round(max(CASE WHEN k = 6 THEN hi END), 9) + 0.0 AS high6,
  round(sum(CASE WHEN k BETWEEN 1 AND 4 THEN v END), 9) + 0.0 AS term4 FROM r GROUP BY c_custkey""")
def projection_9(spark, sf):
    """Nine years ahead for every customer, those that fall from the first step on among them, with the band."""
    at = lambda age: F.struct(F.lit(1.6 - 0.025 * age).alias("m"), F.lit(-0.5 if age == 25 else 1.5 - 0.025 * age).alias("lo"), F.lit(1.7 - 0.025 * age).alias("hi"))
    ratios = F.create_map(*[x for age in range(18, 30) for x in (F.lit(age), at(age))])
    tails = F.struct(F.lit(0.85).alias("m"), F.lit(0.8).alias("lo"), F.lit(0.9).alias("hi"))
    rows = _t(spark, sf, "customer").withColumn("p", numeric.project_bands(F.col("c_acctbal") / 1000, 20 + (F.col("c_custkey") % 37) / 2.0, ratios, tails))
    year = lambda band, k: _r(F.get(f"p.{band}", F.lit(k - 1)), 9) + F.lit(0.0)
    term = F.get(numeric.cumulative(F.col("p.m"), 8), F.lit(3))
    return rows.select("c_custkey", year("m", 1).alias("year1"), year("m", 5).alias("year5"), year("m", 9).alias("year9"), year("lo", 6).alias("low6"), year("hi", 6).alias("high6"), (_r(term, 9) + F.lit(0.0)).alias("term4"))


@query("""WITH t AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS d, count(*)::DOUBLE AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), g AS (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS d FROM orders)
SELECT o_orderkey, round(CASE WHEN t.v IS NULL THEN (SELECT min_by(v, d) FROM t) ELSE t.v * 1.05 ** (g.d - t.d) END, 4) AS cap FROM g ASOF LEFT JOIN t ON g.d >= t.d""")
def cap_locf_growth(spark, sf):
    """For each order the last day that had urgent ones, at or before it: their number, grown by the days since."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = _t(spark, sf, "orders").withColumn("y", day)
    known = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("y").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("cap"))
    return value.locf(o.select("o_orderkey", "y"), known, "y", "day", "cap", growth=0.05).select("o_orderkey", _r("cap").alias("cap"))


def _neighbours(spark, sf, asked: str | None = None, **sizes) -> DataFrame:
    """The five nearest other rows of each row, or of those that are ``asked`` for."""
    pool = _t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return comps.nearest(pool.where(asked) if asked else pool, pool, "vec_id", "vec_id", "label", {"x": comps.euclid}, k=5, but_itself=True, **sizes)


KNN = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
p AS (SELECT t.vec_id AS t_id, t.label AS t_label, c.vec_id AS c_id, c.label AS c_label, list_distance(t.x, c.x) AS dist FROM e t LEFT JOIN n USING (label) JOIN e c ON c.vec_id <> t.vec_id AND (c.label = t.label OR coalesce(n.n, 0) < 5) WHERE t.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY dist, c_id) AS neighbour FROM p QUALIFY neighbour <= 5),
w AS (SELECT *, exp(-0.85 * dist) ** 0.85 / sum(exp(-0.85 * dist) ** 0.85) OVER (PARTITION BY t_id) AS weight FROM k)"""


@query(f"WITH {KNN} SELECT t_id, c_id, neighbour, round(dist, 5) AS dist, round(weight, 5) AS weight FROM w")
def knn_comps(spark, sf):
    return _neighbours(spark, sf, "vec_id % 50 = 0").select(F.col("t_vec_id").alias("t_id"), F.col("c_vec_id").alias("c_id"), F.col("neighbour").cast("bigint").alias("neighbour"), _r("dist", 5).alias("dist"), _r("weight", 5).alias("weight"))


KNN_OF_ALL = KNN.replace(" WHERE t.vec_id % 50 = 0", "")
BLOCK_OF_ALL = 16_000  # rows of a block where every row asks: a row is sent to a block, and with it its vector


@query(f"""WITH {KNN_OF_ALL}, s AS (SELECT t_id, c_id % 3 AS term, count(*) AS n, sum(weight * (c_id % 50)) / sum(weight) AS knn, CASE WHEN count(*) >= 4 THEN quantile_cont(c_id % 50, 0.75) - quantile_cont(c_id % 50, 0.25) END AS iqr, sum(weight) ** 2 / sum(weight * weight) AS eff_n FROM w GROUP BY t_id, c_id % 3)
SELECT t_id, term, n, round(knn, 4) AS knn, round(iqr, 4) AS iqr, round(eff_n, 4) AS eff_n, round(CASE WHEN n < 5 THEN 0.5 ELSE least(0.75, 0.5 + 0.1 * coalesce(iqr, 0) / 0.05) END, 4) AS w_model FROM s""")
def knn_term_stats(spark, sf):
    """Statistics of the neighbours of every row by term."""
    rows = _neighbours(spark, sf, block=BLOCK_OF_ALL).select(F.col("t_vec_id").alias("t_id"), (F.col("c_vec_id") % 3).alias("term"), (F.col("c_vec_id") % 50).cast("double").alias("v"), "weight")
    s = comps.term_statistics(rows, "t_id", "term", "v")
    return s.select("t_id", "term", "n", _r("knn").alias("knn"), _r("iqr").alias("iqr"), _r("eff_n").alias("eff_n"), _r(comps.blend_weight(F.col("n"), F.col("iqr"))).alias("w_model"))


@query("""WITH h AS (SELECT o_orderpriority AS term, median(o_totalprice) AS base FROM orders WHERE year(o_orderdate) < 1999 GROUP BY 1), e AS (SELECT term, abs(o_totalprice - base) AS err FROM orders JOIN h ON o_orderpriority = term WHERE year(o_orderdate) >= 1999),
m AS (SELECT avg(err) AS mae FROM e) SELECT term, count(*) AS n, round(avg(err), 3) AS mae, round(avg((err <= mae1)::INT), 5) AS within_1x, round(avg((err <= 2 * mae1)::INT), 5) AS within_2x FROM e, (SELECT mae AS mae1 FROM m) GROUP BY term""")
def eval_true_term(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("term"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("actual"))
    base = stats.quantile_columns(o.where("y < 1999"), ["term"], "actual", {"base": 0.5})
    e = o.where("y >= 1999").join(F.broadcast(base), "term").withColumn("err", F.abs(F.col("actual") - F.col("base")))
    rates = stats.pass_rates(e, "err", (1, 2), ["term"])
    return e.groupBy("term").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("err"), 3).alias("mae")).join(rates.drop("n"), "term").select("term", "n", "mae", _r("within_1x", 5).alias("within_1x"), _r("within_2x", 5).alias("within_2x"))


def _dirty_names() -> tuple[list[str], str]:
    """The known spellings, each once, and the map as SQL rows."""
    names = list(fixed.NAME_SPELLINGS)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return names, ", ".join(f"({i}, {quoted(n)}, {quoted(fixed.NAME_SPELLINGS[n])})" for i, n in enumerate(names))


@query(f"""WITH m(i, raw, good) AS (VALUES {_dirty_names()[1]}), p AS (SELECT c_custkey, raw, good, c_custkey // {len(_dirty_names()[0])} % 3 AS turn FROM customer JOIN m ON i = c_custkey % {len(_dirty_names()[0])})
SELECT c_custkey, regexp_replace(CASE WHEN turn = 2 AND strpos(raw, ' ') = 0 THEN raw ELSE good END, '(^| )((jr|sr|ii|iii|iv|v)( |$))+$', '') AS name, trim(regexp_replace(regexp_replace(raw, '[^a-z''-]', ' ', 'g'), ' +', ' ', 'g')) AS junior FROM p""")
def canonical_name(spark, sf):
    """Known misspellings as sources write them: in capitals, family name first, with odd blanks, quotes and suffixes."""
    names, _ = _dirty_names()
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    parts = F.split(raw, " ", 2)
    turn = F.floor(k / len(names)) % 3
    given, family = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shouted = F.concat(F.lit("\u00a0 "), F.upper(F.regexp_replace(raw, " ", "  ")), F.lit(" "))
    turned = F.when(family.isNull(), raw).otherwise(F.concat(family, F.lit(", "), given))
    dirty = F.when(turn == 0, shouted).when(turn == 1, F.regexp_replace(raw, "'", "\u2019")).otherwise(F.regexp_replace(turned, "-", "\u2013"))
    junior = F.concat(raw, F.lit(" Jr. III"))  # known spellings are looked up before suffixes go
    return _t(spark, sf, "customer").select("c_custkey", text.canonical_name(dirty).alias("name"), text.canonical_name(junior).alias("junior"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey, EXISTS (SELECT 1 FROM a WHERE k = c_custkey) AS has_pending, c_custkey IN (SELECT c_custkey FROM customer EXCEPT SELECT k FROM a) AS in_except FROM customer""")
def semi_anti(spark, sf):
    c, a = _t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    ids = c.select("c_custkey")
    with_ = ids.intersect(a).join(ids, "c_custkey", "left_semi").withColumn("has_pending", F.lit(True)).withColumn("in_except", F.lit(False))
    return with_.unionByName(ids.subtract(a).withColumn("has_pending", F.lit(False)).withColumn("in_except", F.lit(True)))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_nationkey AS nation FROM supplier")
def union_missing_cols(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, """ + ", ".join(f"max(CASE WHEN k = {i} THEN o_orderkey END) AS comp{i}_o_orderkey, max(CASE WHEN k = {i} THEN o_totalprice END) AS comp{i}_o_totalprice" for i in range(1, 6)) + " FROM r WHERE k <= 5 GROUP BY o_custkey")
def pivot_topk(spark, sf):
    best = ranks.top_k(_t(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5, "comp_rank")
    return comps.wide_comps(best, "o_custkey", ["o_orderkey", "o_totalprice"])


@query("""SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(concat_ws(';', CASE WHEN l_quantity < 2 THEN 'zero_or_nan_TOI' END, CASE WHEN l_quantity < 10 AND abs(l_extendedprice / l_quantity) > 1500 THEN 'small_TOI_high_rate' END, CASE WHEN l_extendedprice / l_quantity > 4500 THEN 'extreme_rate' END), '') AS reasons FROM lineitem) WHERE reasons IS NOT NULL""")
def outlier_reasons(spark, sf):
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    rules = {"zero_or_nan_TOI": F.col("l_quantity") < 2, "small_TOI_high_rate": (F.col("l_quantity") < 10) & (F.abs(rate) > 1500), "extreme_rate": rate > 4500}
    rows = _t(spark, sf, "lineitem").withColumn("reasons", stats.outlier_reasons(rules)).where("reasons is not null")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "reasons")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_constant_cols(spark, sf):
    n = _t(spark, sf, "nation").withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("double"))
    return S.drop_uninformative(n)


@query()
def xg_logit(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", (F.col("l_quantity") / 50).alias("q"), (F.col("l_returnflag") == "R").cast("int").alias("goal"), (F.col("l_quantity") > 25).cast("int").alias("big"))
    model = models.fit_logit(rows, ["l_discount", "l_tax", "q", "big"], "goal")
    return models.score_logit(rows, model, "xG").groupBy("big").agg(_r(F.avg("xG"), 5).alias("mean_xg"), _r(F.avg("goal"), 5).alias("mean_goal"))


@query()
def rapm_ridge(spark, sf):
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("minutes"), (F.sum("l_extendedprice") / 1e5).alias("xGF"), F.array_sort(F.collect_set(F.col("l_suppkey") % 20)).alias("players"), F.array_sort(F.collect_set(F.col("l_partkey") % 20)).alias("opp_players"))
    stints_ = rows.select(F.col("l_orderkey").alias("gameId"), F.lit(1).alias("period"), F.lit(0).alias("startSec"), F.lit(1).alias("is_home"), "minutes", "xGF", "players", "opp_players", (F.col("l_orderkey") % 2).alias("ctx"))
    out, _ = models.rapm(stints_.withColumn("gameId", F.col("gameId") % 200), ["ctx"])
    return out.select("playerId", _r("off", 5).alias("off"), _r("def", 5).alias("def"), _r("total", 5).alias("total"))


from tallyforge.plans import derived, wholes  # noqa: E402, F401  register their queries
