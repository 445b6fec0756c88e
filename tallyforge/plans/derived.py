"""More registered queries, each a library function over values derived from the driver's tables, with its SQL.

Texts as a scraper would meet them (clocks, prices, names, records, seasons) are composed of the tables' numbers, so that
SQL can state what each function must find in them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge import schema as S
from tallyforge.functions import fixed, numeric, rink, text
from tallyforge.operators import comps, joins, models, ranks, stats, stints, value
from tallyforge.plans import seasons
from tallyforge.plans.catalogue import _r, _t, query
from tallyforge.sources import files, sinks


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---- text -----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 0 THEN 3600 ELSE 0 END + 60 * (o_orderkey % 60) + o_custkey % 60 END AS seconds,
CASE WHEN o_orderkey % 7 = 0 THEN o_custkey / 2.0::DOUBLE ELSE (60 * (o_orderkey % 60) + o_custkey % 60)::DOUBLE END AS either FROM orders""")
def clock_times(spark, sf):
    short = F.concat(_s(F.col("o_orderkey") % 60), F.lit(":"), F.lpad(_s(F.col("o_custkey") % 60), 2, "0"))
    clock = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" 1:"), short)).otherwise(short)
    either = F.when(F.col("o_orderkey") % 7 == 0, _s(F.col("o_custkey") / 2)).otherwise(short)
    return _t(spark, sf, "orders").select("o_orderkey", text.clock_seconds(clock).alias("seconds"), text.clock_or_number(either).alias("either"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (60 * (o_custkey % 60) + 30)::DOUBLE END AS as_clock, CASE WHEN o_orderkey % 10 <> 0 THEN 60.0::DOUBLE * o_custkey END AS as_minutes FROM orders""")
def column_time_units(spark, sf):
    clock, number = F.concat(_s(F.col("o_custkey") % 60), F.lit(":30")), _s("o_custkey")
    rows = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, clock).otherwise(number).alias("a"), F.when(F.col("o_orderkey") % 10 == 0, clock).otherwise(number).alias("b"))
    rows = text.column_seconds(text.column_seconds(rows, "a", "as_clock"), "b", "as_minutes")
    return rows.select("o_orderkey", "as_clock", "as_minutes")


@query("SELECT c_custkey, c_name || ' é' AS repaired, c_name || ' e U' AS plain, c_name || ' x y' AS clean FROM customer")
def repaired_text(spark, sf):
    name = F.col("c_name")
    return _t(spark, sf, "customer").select(
        "c_custkey", text.repair_mojibake(F.concat(name, F.lit(" Ã©"))).alias("repaired"), text.strip_accents(F.concat(name, F.lit(" é Ü"))).alias("plain"),
        text.clean_blanks(F.concat(F.lit("  "), name, F.lit("  Âx \t y "))).alias("clean"),
    )


@query("SELECT s_suppkey, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' O''Neil Smith-Jones' AS title, lower(r_name) AS first, 'van der ' || s_suppkey AS last FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def title_names(spark, sf):
    s = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.translate(F.lower("r_name"), " ", "_")
    parts = text.first_last(F.concat(F.lit(" "), one, F.lit("  van  der "), _s("s_suppkey")))
    return s.select("s_suppkey", text.title_name(F.concat(F.lower("r_name"), F.lit(" o'neil  SMITH-jones"))).alias("title"), F.translate(parts["first"], "_", " ").alias("first"), parts["last"].alias("last"))


@query("""SELECT o_orderkey, (o_orderdate::DATE)::VARCHAR AS day, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END) || '-' || (year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END + 1) AS season,
year(o_orderdate) AS start, (year(o_orderdate) - 2) || '-' || (year(o_orderdate) - 1) AS two_before, 'n/a' AS other, year(o_orderdate) || '-' || (year(o_orderdate) + 1) AS label FROM orders""")
def dates_and_seasons(spark, sf):
    year = F.year("o_orderdate")
    label = files.season_label(year)
    return _t(spark, sf, "orders").select(
        "o_orderkey", text.iso_date(F.concat(F.lit("Game of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", late"))).cast("string").alias("day"), text.season_of_date(F.col("o_orderdate")).alias("season"),
        text.start_year(F.concat(F.lit(" "), label)).cast("bigint").alias("start"), text.shift_season(label, -2).alias("two_before"), text.shift_season(F.lit("n/a"), 1).alias("other"), label.alias("label"),
    )


@query(r"""SELECT o_orderkey, o_orderkey + 0.5::DOUBLE AS digits, o_custkey AS first_int, regexp_matches('in ' || (o_custkey % 3000), '(19|20)\d{2}') AS has_year, (trunc(o_totalprice)::BIGINT * 1000 + 0.25)::DOUBLE AS money,
o_custkey % 3 + 5 AS feet, ((o_custkey % 3 + 5) * 12 + o_orderkey % 12)::DOUBLE AS inches, NULL::DOUBLE AS no_height, 'B-' || o_custkey AS code FROM orders""")
def numbers_in_text(spark, sf):
    feet, inch = _s(F.col("o_custkey") % 3 + 5), _s(F.col("o_orderkey") % 12)
    height = F.when(F.col("o_orderkey") % 2 == 0, F.concat(feet, F.lit("' "), inch, F.lit('"'))).otherwise(F.concat(feet, F.lit("-"), inch))
    return _t(spark, sf, "orders").select(
        "o_orderkey", text.digits(F.concat(F.lit("No "), _s("o_orderkey"), F.lit(".5 kg"))).alias("digits"), text.first_int(F.concat(F.lit("of "), _s("o_custkey"), F.lit(" and 7"))).alias("first_int"),
        text.has_year(F.concat(F.lit("in "), _s(F.col("o_custkey") % 3000))).alias("has_year"), text.money(F.concat(F.lit("$ "), _s(F.col("o_totalprice").cast("bigint")), F.lit(",000.25"))).alias("money"),
        (F.col("o_custkey") % 3 + 5).alias("feet"), text.height_inches(height).alias("inches"), text.height_inches(F.lit("tall")).alias("no_height"), text.extract(F.concat(F.lit("x B-"), _s("o_custkey"), F.lit(";")), r"(B-\d+)").alias("code"),
    )


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'D' WHEN 2 THEN 'D' WHEN 3 THEN 'F' END AS pos, CASE p_size % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'NMC' WHEN 2 THEN 'NTC' ELSE 'Other' END AS clause,
CASE WHEN p_size % 2 = 0 THEN 'RFA' ELSE 'UFA' END AS status, CASE WHEN p_size % 3 = 0 THEN 'ELC' WHEN p_size >= 35 THEN '35_PLUS' ELSE 'STD' END AS level,
CASE WHEN p_size <= 21 THEN 'U22' WHEN p_size <= 24 THEN '22-24' WHEN p_size <= 27 THEN '25-27' WHEN p_size <= 30 THEN '28-30' WHEN p_size <= 33 THEN '31-33' WHEN p_size <= 36 THEN '34-36' ELSE '35+' END AS band,
CASE WHEN p_size < 15 THEN 'Other' WHEN p_size % 2 = 0 THEN CASE WHEN p_size / 2.0 <= 15 THEN '3rd Pair' WHEN p_size / 2.0 <= 18 THEN 'Bottom-4' WHEN p_size / 2.0 <= 20 THEN 'Top-4' ELSE '1st Pair' END
  ELSE CASE WHEN p_size / 2.0 <= 9 THEN '4th Line' WHEN p_size / 2.0 <= 12 THEN 'Bottom-6' WHEN p_size / 2.0 <= 15.5 THEN 'Middle-6' WHEN p_size / 2.0 <= 18.5 THEN 'Top-6' ELSE '1st Line' END END AS role,
CASE WHEN p_size < 15 THEN 0 WHEN p_size % 2 = 0 THEN CASE WHEN p_size / 2.0 <= 15 THEN 1 WHEN p_size / 2.0 <= 18 THEN 2 WHEN p_size / 2.0 <= 20 THEN 4 ELSE 5 END
  ELSE CASE WHEN p_size / 2.0 <= 9 THEN 1 WHEN p_size / 2.0 <= 12 THEN 2 WHEN p_size / 2.0 <= 15.5 THEN 3 WHEN p_size / 2.0 <= 18.5 THEN 4 ELSE 5 END END AS tier,
CASE p_size % 4 WHEN 0 THEN 'BOS' WHEN 1 THEN 'TBL' WHEN 2 THEN 'NYR' END AS team FROM part""")
def bucketers(spark, sf):
    size = F.col("p_size")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), size % n)
    side = F.when(size % 2 == 0, "D").otherwise("F")
    rows = _t(spark, sf, "part").withColumn("role", text.role_bucket(side, size, size / 2))
    return rows.select(
        "p_partkey", text.position_bucket(pick(5, "g", " D", "L, D", "C, R", " ")).alias("pos"), text.clause_bucket(pick(4, "  ", "full nmc", "NTC (10)", "odd")).alias("clause"), text.status_group(pick(2, "rfa (1)", "UFA")).alias("status"),
        text.contract_level(F.when(size % 3 == 0, "elc"), _s("p_size")).alias("level"), text.age_band(size).alias("band"), "role", text.role_tier(side, F.col("role")).alias("tier"),
        text.team_code(pick(4, "Boston Bruins", " T.B.", "nyr", "Nowhere")).alias("team"),
    )


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS ids, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY o_custkey")
def id_lists(spark, sf):
    joined = _t(spark, sf, "orders").groupBy("o_custkey").agg(text.join_ids(F.sort_array(F.collect_list("o_orderkey"))).alias("ids"))
    parsed = text.parse_ids(F.concat("ids", F.lit(";x; ")))
    return joined.select("o_custkey", "ids", F.size(parsed).cast("bigint").alias("n"), F.aggregate(parsed, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT c_custkey, c_custkey % 50 AS w, c_custkey % 31 AS l, c_custkey % 7 AS otl, 2 * (c_custkey % 50) + c_custkey % 7 AS pts, c_custkey % 50 + c_custkey % 31 + c_custkey % 7 AS gp FROM customer")
def team_records(spark, sf):
    k = F.col("c_custkey")
    rec = text.record(F.concat(F.lit(" "), _s(k % 50), F.lit(" - "), _s(k % 31), F.lit("-"), _s(k % 7)))
    return _t(spark, sf, "customer").select("c_custkey", *[rec[f].cast("bigint").alias(f) for f in ("w", "l", "otl", "pts", "gp")])


def _caps(table) -> str:
    return ", ".join(f"({k[:4]}, {v})" for k, v in table.items())


@query(f"""WITH cap(y, v) AS (VALUES {_caps(fixed.LEAGUE_CAP)}), least_(y, v) AS (VALUES {_caps(fixed.MIN_SALARY)}), g AS (SELECT o_orderkey, (year(o_orderdate) + 15 + o_custkey % 15)::INT AS year FROM orders)
SELECT o_orderkey, year, CASE WHEN year < 2015 THEN 71400000 WHEN year > 2027 THEN round_even(113500000 * 1.05::DOUBLE ** (year - 2027), 0) ELSE (SELECT v FROM cap WHERE y = year) END::DOUBLE AS cap,
coalesce((SELECT v FROM least_ WHERE y = year), 775000)::DOUBLE AS least FROM g""")
def caps_and_minimums(spark, sf):
    """The cap and the least salary of the season of each order, seasons before and beyond the tables among them."""
    year = (F.year("o_orderdate") + 15 + F.col("o_custkey") % 15).cast("int")
    return _t(spark, sf, "orders").select("o_orderkey", year.alias("year"), value.cap_of(year).alias("cap"), value.min_salary_of(year).alias("least"))


@query(f"""WITH cap(y, v) AS (VALUES {_caps(fixed.LEAGUE_CAP)}), o AS (SELECT o_orderkey, o_orderkey % 4 = 0 AS ext, o_custkey % 2 = 0 AS two, (o_custkey % 8 + 1)::INT AS len, (2015 + o_custkey % 9)::INT AS s, (20 + o_custkey % 15)::INT AS age, o_totalprice * 10 AS hit FROM orders),
t AS (SELECT *, s + CASE WHEN ext OR len = 8 THEN 1 ELSE 0 END AS start_year FROM o)
SELECT o_orderkey, ext AS is_extension, CASE WHEN two THEN '2-way' ELSE '1-way' END AS structure, start_year, start_year + len - 1 AS expiry_year, greatest(0, age - (2025 - s)) AS signing_age, round(100 * hit / v, 0) AS cap_pct FROM t JOIN cap ON y = start_year""")
def contract_terms(spark, sf):
    k = F.col("o_custkey")
    kind = F.concat(F.when(k % 2 == 0, "Two-Way ").otherwise("standard "), F.when(F.col("o_orderkey") % 4 == 0, "(ext)").otherwise(""))
    rows = _t(spark, sf, "orders").select("o_orderkey", kind.alias("type"), (k % 8 + 1).cast("int").alias("len"), (2015 + k % 9).cast("int").alias("s"), (20 + k % 15).cast("int").alias("age"), (F.col("o_totalprice") * 10).alias("hit"))
    out = text.contract_terms(rows, "type", "len", "s", "age", 2025, "s", "hit")
    cap = value.cap_of(F.col("start_year"))
    return out.select("o_orderkey", "is_extension", "structure", "start_year", "expiry_year", "signing_age", F.round(100 * F.col("hit") / cap, 0).alias("cap_pct"))


# ---- rink -----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, (event_id % 5 + 1)::INT AS period, (event_id % 199 - 99)::DOUBLE AS x, (event_id % 83 - 41)::DOUBLE AS y, CASE event_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS side, ['GOAL', 'HIT', 'SHOT-ON-GOAL', 'MISSED-SHOT'][event_id % 4 + 1] AS kind FROM events),
h AS (SELECT *, CASE WHEN side = 1 THEN true WHEN side = 2 THEN false ELSE CASE WHEN period IN (1, 3) THEN x > 0 ELSE x < 0 END END AS home FROM e), r AS (SELECT *, CASE WHEN home THEN period IN (1, 3) ELSE period IN (2, 4, 5) END AS att FROM h)
SELECT event_id, home, att, round(sqrt((89 - CASE WHEN att THEN x ELSE -x END) ** 2 + y * y), 6) AS dist, round(degrees(abs(atan2(-y, 89 - CASE WHEN att THEN x ELSE -x END))), 6) AS angle, kind IN ('SHOT-ON-GOAL', 'MISSED-SHOT', 'GOAL') AS fenwick,
CASE WHEN abs(x) < 25 THEN 'N' WHEN (x > 0) = (period IN (1, 3)) THEN 'O' ELSE 'D' END AS zone FROM r""")
def shot_places(spark, sf):
    k = F.col("event_id")
    rows = _t(spark, sf, "events").select("event_id", (k % 5 + 1).cast("int").alias("period"), (k % 199 - 99).cast("double").alias("x"), (k % 83 - 41).cast("double").alias("y"), F.when(k % 3 > 0, k % 3).alias("side"), F.get(F.array(*[F.lit(x) for x in ("GOAL", "HIT", "SHOT-ON-GOAL", "MISSED-SHOT")]), (k % 4).cast("int")).alias("kind"))
    rows = rows.withColumn("home", rink.shooter_is_home(F.col("side"), F.col("x"), F.col("period"))).withColumn("att", rink.attacks_right(F.col("home"), F.col("period")))
    place = rink.shot_geometry(F.col("x"), F.col("y"), F.col("att"))
    return rows.select("event_id", "home", "att", _r(place["dist"], 6).alias("dist"), _r(place["angle"], 6).alias("angle"), rink.is_fenwick(F.col("kind")).alias("fenwick"), rink.faceoff_zone_home(F.col("x"), F.col("period")).alias("zone"))


@query("""WITH e AS (SELECT event_id, event_id % 2 AS ag, 3 + event_id % 4 AS h, 3 + event_id % 3 AS a, event_id // 2 % 2 AS hg FROM events)
SELECT event_id, h::INT AS home, a::INT AS away, hg = 0 AS pulled_home, ag = 0 AS pulled_away, h || 'v' || a AS manpower, CASE WHEN h = a THEN 'EV' WHEN h > a THEN 'PP' ELSE 'SH' END AS bucket FROM e""")
def manpower(spark, sf):
    k = F.col("event_id")
    code = F.concat(_s(k % 2), _s(3 + k % 4), _s(3 + k % 3), _s(F.floor(k / 2) % 2))
    rows = _t(spark, sf, "events").select("event_id", rink.situation(F.concat(F.lit(" "), code)).alias("s"))
    return rows.select("event_id", *[F.col(f"s.{c}").alias(c) for c in ("home", "away", "pulled_home", "pulled_away", "manpower")], rink.strength_bucket(F.col("s.home"), F.col("s.away")).alias("bucket"))


# ---- schema ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice::BIGINT::VARCHAR AS o_totalprice, NULL::DOUBLE AS absent, 7 AS seven, o_custkey AS who, o_custkey + 1 AS either FROM (SELECT * REPLACE (trunc(o_totalprice) AS o_totalprice) FROM orders)")
def conformed_columns(spark, sf):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    rows = _t(spark, sf, "orders").withColumn("o_totalprice", F.floor("o_totalprice").cast("bigint")).withColumn("x", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 1)).withColumn("y", F.col("o_custkey") + 1)
    wanted = S.conform(rows, StructType().add("o_orderkey", LongType()).add("o_totalprice", StringType()).add("absent", DoubleType()))
    more = S.first_available(S.ensure(rows, {"seven": F.lit(7), "o_orderkey": F.lit(0)}), ["player", "o_custkey"], "who")
    more = S.coalesce_candidates(more, ["gone", "x", "y"], "either")
    return wanted.join(S.present(S.require(more, ["who"]), ["seven", "who", "either", "missing", "o_orderkey"]), "o_orderkey")


@query("""SELECT p_partkey, (p_type = 'ECONOMY')::INT::DOUBLE AS is_ECONOMY, (p_type = 'STANDARD')::INT::DOUBLE AS is_STANDARD, (p_size > 10)::INT AS over_10, (p_size > 40)::INT AS over_40, p_size * 1000.5::DOUBLE AS price,
(SELECT count(DISTINCT p_type) FROM part) AS n_types, (SELECT min(p_type) FROM part) AS first_type FROM part""")
def indicators(spark, sf):
    rows = _t(spark, sf, "part")
    kinds = S.categories(rows, "p_type")
    out = S.one_hot(rows, "p_type", ["ECONOMY", "STANDARD"], "is")
    out = S.indicators(out, "p_size", {"over_10": lambda c: c > 10, "over_40": lambda c: c > 40})
    named = F.concat(F.lit("'$"), _s(F.floor(F.col("p_size") * 1000.5).cast("bigint")), F.when(F.col("p_size") % 2 == 0, "").otherwise(".5"))
    return out.select("p_partkey", *S.with_prefix(out, "is_"), *[c for c in S.with_prefix(out, "over_") if c in S.with_suffix(out, "0")], S.number(named).alias("price"), F.lit(len(kinds)).cast("bigint").alias("n_types"), F.lit(kinds[0]).alias("first_type"))


@query("""SELECT n_nationkey AS "nation key", n_name AS "name", n_regionkey AS "name_2", CASE WHEN n_nationkey <> 3 THEN n_nationkey::DOUBLE END AS "x" FROM nation""")
def tidied_headers(spark, sf):
    n = _t(spark, sf, "nation")
    rows = n.select(F.col("n_nationkey").alias("﻿nation  key"), F.col("n_name").alias(" name"), F.col("n_regionkey").alias("name "), F.when(F.col("n_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("n_nationkey").cast("double")).alias("x"), F.lit(None).cast("string").alias("empty"))
    rows = S.nan_to_null(S.rename(rows, S.tidy_name))
    nothing = spark.createDataFrame([], rows.schema).unionByName(rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
    return S.drop_empty(rows.unionByName(nothing))


# ---- joins ----------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_name, n_name, n_regionkey, c_acctbal, s.bal AS c_acctbal_supplier, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, s.bal) AS filled
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS bal FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey""")
def attached_columns(spark, sf):
    c = _t(spark, sf, "customer").withColumnRenamed("c_nationkey", "k")
    n = _t(spark, sf, "nation").withColumnRenamed("n_nationkey", "k").withColumn("c_name", F.lit("never"))
    s = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("c_acctbal"))
    out = joins.left_join_suffixed(joins.left_join_new_cols(c, n, ["k"]), s, ["k"], "_supplier")
    out = joins.fill_nulls(out.withColumn("filled", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), s.withColumnRenamed("c_acctbal", "filled"), ["k"])
    return out.select("c_custkey", "c_name", "n_name", "n_regionkey", "c_acctbal", "c_acctbal_supplier", "filled")


@query("""SELECT l_orderkey AS g, max(l_suppkey) FILTER (l_returnflag = 'A') AS home_s, max(l_quantity) FILTER (l_returnflag = 'A') AS home_q, max(l_suppkey) FILTER (l_returnflag = 'R') AS away_s, max(l_quantity) FILTER (l_returnflag = 'R') AS away_q
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0""")
def home_and_away(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), "l_returnflag", F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))
    return joins.pair_sides(rows, "g", "l_returnflag", {"home": "A", "away": "R"}, ["s", "q"])


@query("""SELECT o_orderkey, o_custkey % 32 AS team, (o_custkey + 5) % 32 AS opponent, 'home' AS side FROM orders UNION ALL SELECT o_orderkey, (o_custkey + 5) % 32, o_custkey % 32, 'away' FROM orders""")
def schedule_sides(spark, sf):
    games = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 32).alias("h"), ((F.col("o_custkey") + 5) % 32).alias("a"))
    return joins.both_sides(games, {"h": "home", "a": "away"}, mark="side")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders WHERE o_orderstatus <> 'F'")
def exclusion_keeps_nulls(spark, sf):
    return joins.keep_unless(_t(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")), "s", "F")


@query("""WITH a AS (SELECT c_nationkey AS n, c_mktsegment AS m, min(c_custkey) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY ALL), b AS (SELECT c_nationkey AS n, min(c_custkey) AS v FROM customer WHERE c_acctbal > 8000 GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v) AS found FROM customer LEFT JOIN a ON a.n = c_nationkey AND a.m = c_mktsegment LEFT JOIN b ON b.n = c_nationkey""")
def lookup_fallback(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), "c_acctbal")
    table = c.withColumnRenamed("c_custkey", "v")
    steps = [(table.where("c_acctbal > 9000").select("n", "m", "v"), ["n", "m"]), (table.where("c_acctbal > 8000").select("n", "v"), ["n"])]
    return joins.lookup_chain(c.drop("c_acctbal"), steps, "v", ["v"], "found").select("c_custkey", "found")


@query("""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT a.k, a.y, b.y AS py, b.v AS pv, row_number() OVER (PARTITION BY a.k, a.y ORDER BY b.y DESC) AS recency FROM y a JOIN y b ON a.k = b.k AND b.y < a.y)
SELECT k, y, py, round(pv, 2) AS pv, recency FROM p WHERE recency <= 3""")
def last_three_before(spark, sf):
    y = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    out = joins.latest_before(y.select("k", "y"), y.select("k", F.col("y").alias("py"), F.col("v").alias("pv")), "k", "y", "py", 3, ["k", "y"])
    return out.select("k", "y", "py", _r("pv", 2).alias("pv"), F.col("recency").cast("bigint").alias("recency"))


@query("""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT a.k, a.y, round(b.v, 2) AS before FROM y a JOIN y b ON a.k = b.k AND b.y = a.y - 1""")
def season_before(spark, sf):
    y = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    out = joins.latest_before(y.select("k", "y"), y.select("k", F.col("y").alias("py"), "v"), "k", "y", "py", 1, ["k", "y"], exact_lag=1)
    return out.select("k", "y", _r("v", 2).alias("before"))


@query("SELECT least(c_custkey % 9, 5) AS k, max(c_custkey) AS big, count(*) AS n FROM customer GROUP BY 1")
def inline_relation(spark, sf):
    table = files.constants(spark, ["rest", "k"], [(i, min(i, 5)) for i in range(9)], "rest bigint, k bigint")
    rows = _t(spark, sf, "customer").withColumn("rest", F.col("c_custkey") % 9).join(F.broadcast(table), "rest")
    again = files.lookup(F.col("rest"), {i: min(i, 5) for i in range(9)}).cast("bigint")
    return rows.where(again == F.col("k")).groupBy("k").agg(F.max("c_custkey").alias("big"), F.count(F.lit(1)).alias("n"))


# ---- aggregates and windows -------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS total, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) IS NULL AS none, round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS pending FROM orders WHERE o_custkey <> 7 GROUP BY o_custkey""")
def sums_with_empty_groups(spark, sf):
    rows = _t(spark, sf, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("o_custkey"), F.col("o_totalprice").alias("total"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("pending"))
    zero, null = stats.sum_by(rows, ["o_custkey"], ["total", "pending"]), stats.sum_by(rows, ["o_custkey"], ["pending"], empty_zero=False)
    return zero.join(null.select("o_custkey", F.col("pending").isNull().alias("none")), "o_custkey").select("o_custkey", _r("total", 2).alias("total"), "none", _r("pending", 2).alias("pending"))


@query("""SELECT l_suppkey, round(CASE WHEN count(v) = count(*) THEN sum(v * (l_tax + 1e-9)) / sum(l_tax + 1e-9) END, 4) AS strict, round(sum(l_quantity * (l_tax - l_discount) ** 2) / sum(l_quantity), 8) AS mse, bool_or(l_quantity = 50) AS any50, count(*) FILTER (abs(v) < 'inf'::DOUBLE) AS finite
FROM (SELECT *, CASE WHEN l_quantity <> 13 OR l_suppkey % 2 = 0 THEN l_extendedprice END AS v FROM lineitem) GROUP BY l_suppkey""")
def strict_means(spark, sf):
    rows = _t(spark, sf, "lineitem").withColumn("v", F.when((F.col("l_quantity") != 13) | (F.col("l_suppkey") % 2 == 0), F.col("l_extendedprice")))
    odd = F.when(F.col("v").isNotNull(), F.col("v"))
    return rows.groupBy("l_suppkey").agg(_r(stats.weighted_mean_strict("v", "l_tax")).alias("strict"), _r(stats.weighted_mse("l_tax", "l_discount", "l_quantity"), 8).alias("mse"), stats.any_flag(F.col("l_quantity") == 50).alias("any50"), F.count(F.when(stats.is_finite(odd), 1)).alias("finite"))


@query("""WITH c AS (SELECT c_nationkey AS n, c_mktsegment AS m, count(*) AS k FROM customer GROUP BY ALL), f AS (SELECT n, max_by(m, (k, 0)) AS ignore FROM c GROUP BY n), b AS (SELECT n, first(m ORDER BY k DESC, m) AS mode FROM c GROUP BY n),
x AS (SELECT c_nationkey AS n, first(c_mktsegment ORDER BY c_custkey) FILTER (c_mktsegment <> 'MACHINERY') AS first_kind FROM customer GROUP BY 1) SELECT n, mode, first_kind FROM b JOIN x USING (n)""")
def modes_and_firsts(spark, sf):
    c = _t(spark, sf, "customer").withColumnRenamed("c_nationkey", "n")
    mode = stats.mode_stable(c, ["n"], "c_mktsegment", "mode")
    blanked = c.withColumn("m", F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_mktsegment")))
    return mode.join(blanked.groupBy("n").agg(stats.first_non_blank("m", "c_custkey").alias("first_kind")), "n")


@query("SELECT l_orderkey, min(l_returnflag) AS a, max(l_returnflag) AS b FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def exactly_two(spark, sf):
    out = stats.exact_pairs(_t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")
    return out.select("l_orderkey", F.get("pair", F.lit(0)).alias("a"), F.get("pair", F.lit(1)).alias("b"))


@query("SELECT l_suppkey AS member, sum(t) AS total FROM (SELECT l_orderkey, l_suppkey, max(q) OVER (PARTITION BY l_orderkey) AS t FROM (SELECT DISTINCT l_orderkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM lineitem)) GROUP BY 1")
def minutes_of_members(spark, sf):
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("members"), F.sum("l_quantity").alias("q"))
    return stats.minutes_by_member(rows, "members", "q")


@query("SELECT count(o_totalprice) AS o_totalprice_n, round(median(o_totalprice), 1) AS o_totalprice_p50, round(quantile_cont(o_totalprice, 0.95), 1) AS o_totalprice_p95, count(o_custkey) AS o_custkey_n, median(o_custkey)::DOUBLE AS o_custkey_p50, round(quantile_cont(o_custkey::DOUBLE, 0.95), 1) AS o_custkey_p95 FROM orders")
def scalars(spark, sf):
    out = stats.list_scalars(_t(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return out.select(*[_r(c, 1).alias(c) if "_p" in c and not c.endswith("_n") else F.col(c) for c in out.columns])


@query("SELECT max(CASE WHEN o_orderstatus = 'F' THEN v END) AS \"F\", coalesce(max(CASE WHEN o_orderstatus = 'D' THEN v END), max(CASE WHEN o_orderstatus = 'F' THEN v END)) AS \"D\" FROM (SELECT o_orderstatus, max(o_totalprice) AS v FROM orders GROUP BY 1)")
def cross_filled(spark, sf):
    return stats.cross_fill(_t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("v")), "o_orderstatus", "v")


@query("SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_totalprice) OVER w AS prev_o_totalprice, round(sum(o_totalprice) OVER w - o_totalprice, 2) AS before, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS centred, round(least(greatest(o_totalprice, 1e5), 2e5), 2) AS clipped FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ordered_values(spark, sf):
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    out = ranks.previous(_t(spark, sf, "orders"), ["o_custkey"], order, ["o_totalprice"])
    out = ranks.running_sum(out, ["o_custkey"], order, F.col("o_totalprice"), "before", inclusive=False)
    out = ranks.centred(out, "o_totalprice", "centred", ["o_custkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderpriority", "prev_o_totalprice", (_r("before", 2) + F.lit(0.0)).alias("before"), _r("centred", 8).alias("centred"), _r(numeric.clip(F.col("o_totalprice"), 1e5, 2e5), 2).alias("clipped"))


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS usage FROM customer")
def centred_on_all(spark, sf):
    return ranks.centred(_t(spark, sf, "customer"), "c_acctbal", "usage").select("c_custkey", _r("usage").alias("usage"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def composite_dedupe(spark, sf):
    out = ranks.dedupe_by(_t(spark, sf, "orders"), [F.col("o_custkey"), F.col("o_orderpriority"), F.lit(None)], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return out.select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT l_suppkey, round(sum(l_quantity) / (count(*) * 90 / 3600.0), 5) AS per60 FROM lineitem GROUP BY 1")
def per_sixty(spark, sf):
    s = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), (F.count(F.lit(1)) * 90).alias("sec"))
    return s.select("l_suppkey", _r(numeric.per_60(F.col("q"), F.col("sec")), 5).alias("per60"))


# ---- valuation, comparables, evaluation --------------------------------------------------------------------------------


@query("""WITH s AS (SELECT s_suppkey, n_nationkey, CASE WHEN n_regionkey < 3 THEN 'F' ELSE 'D' END AS pos, sum(l_quantity) AS toi, count(*) AS gp, sum(l_extendedprice) / sum(l_quantity) AS rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, pos ORDER BY toi DESC, s_suppkey) AS rank FROM s), p AS (SELECT * FROM k WHERE rank > CASE WHEN pos = 'F' THEN 2 ELSE 1 END AND gp >= 10 AND toi >= 100),
q AS (SELECT pos, quantile_cont(rate, 0.95) AS hi FROM p GROUP BY pos), l AS (SELECT pos, sum(rate * toi) / sum(toi) AS level FROM p JOIN q USING (pos) WHERE rate <= hi GROUP BY pos)
SELECT x.pos, round(coalesce(l.level, (SELECT max(level) FROM l)), 5) AS level FROM (VALUES ('F'), ('D')) x(pos) LEFT JOIN l USING (pos)""")
def replacement_level(spark, sf):
    dims = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("playerId"), F.col("n_nationkey").alias("team"), F.when(F.col("n_regionkey") < 3, "F").otherwise("D").alias("pos"))
    sums = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("playerId")).agg(F.sum("l_quantity").alias("toi"), F.count(F.lit(1)).alias("gp"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("rate"))
    out = value.replacement_levels(sums.join(dims, "playerId"), "team", "pos", "toi", "gp", "rate", {"F": 2, "D": 1}, trim_high=0.05)
    return out.select("pos", _r("level", 5).alias("level"))


@query("""WITH n AS (SELECT o_custkey AS t, o_custkey // 3 * 3 + j AS c, o_totalprice AS w, o_orderkey FROM orders, (SELECT unnest([0, 1, 2]) AS j)),
d AS (SELECT t, c, max(w) AS w FROM n WHERE t <> c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY w DESC, c) AS r FROM d)
SELECT t, max(c) FILTER (r = 1) AS comp1_c, max(w) FILTER (r = 1) AS comp1_weight, max(c) FILTER (r = 2) AS comp2_c, max(w) FILTER (r = 2) AS comp2_weight FROM r WHERE r <= 2 GROUP BY t""")
def best_comparables(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("t"), F.explode(F.array(*[(F.floor(F.col("o_custkey") / 3) * 3 + j).cast("bigint") for j in range(3)])).alias("c"), F.col("o_totalprice").alias("weight"), F.lit(0.0).alias("dist"))
    return comps.wide_comps(comps.top_comps(rows, "t", "c", 2), "t", ["c", "weight"], 2)


@query("""WITH e AS (SELECT o_orderkey, o_orderpriority AS p, o_custkey % 5 + 1 AS term, o_totalprice AS actual, [o_custkey * 10.0, o_custkey * 20.0, o_custkey * 30.0, NULL][(o_custkey % 5 + 1)::INT] AS predicted FROM orders),
v AS (SELECT *, abs(predicted - actual) AS err FROM e WHERE predicted IS NOT NULL) SELECT term, count(*) AS n, round(avg(err), 3) AS mae, round(median(err), 3) AS median_abs_error FROM v GROUP BY term""")
def true_term_errors(spark, sf):
    k = F.col("o_custkey")
    rows = _t(spark, sf, "orders").select((k % 5 + 1).alias("term"), F.col("o_totalprice").alias("actual"), F.array(k * 10.0, k * 20.0, k * 30.0, F.lit(None).cast("double")).alias("by_term"))
    out = comps.errors_by_term(comps.evaluate(rows, "by_term", "term", "actual"), "term")
    return out.select("term", "n", _r("mae", 3).alias("mae"), _r("median_abs_error", 3).alias("median_abs_error"))


@query("""WITH h AS (SELECT o_orderpriority AS term, median(o_totalprice) AS m FROM orders WHERE year(o_orderdate) < 1999 GROUP BY 1) SELECT o_orderpriority AS term, count(m) AS n, round(avg(abs(o_totalprice - m)), 3) AS baseline_mae FROM orders LEFT JOIN h ON term = o_orderpriority WHERE year(o_orderdate) >= 1999 GROUP BY 1""")
def median_baseline(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("term"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("actual"))
    out = comps.baseline_by_term(rows.where("y < 1999"), rows.where("y >= 1999"), "term", "actual")
    return out.select("term", "n", _r("baseline_mae", 3).alias("baseline_mae"))


@query("""WITH s AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b, p_partkey % 50 = 0 AS asked FROM part), m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_samp(a, a) AS caa, covar_samp(a, b) AS cab, covar_samp(b, b) AS cbb FROM s),
c AS (SELECT *, caa / (sa * sa) + 1e-6 AS p, cab / (sa * sb) AS q, cbb / (sb * sb) + 1e-6 AS r FROM m), z AS (SELECT id, asked, (a - ma) / sa AS x, (b - mb) / sb AS y FROM s, m),
d AS (SELECT t.id AS t, k.id AS c, (t.x - k.x) AS dx, (t.y - k.y) AS dy FROM z t, z k WHERE t.asked AND k.id <> t.id),
e AS (SELECT t, c, 2.0::DOUBLE * sqrt(greatest(0, (r * dx * dx - 2 * q * dx * dy + p * dy * dy) / (p * r - q * q))) + 1.2::DOUBLE * sqrt(dx * dx) AS dist FROM d, c) SELECT t, round(min(dist), 5) AS dist FROM e GROUP BY t""")
def block_neighbours(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("all").alias("bucket"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    blocks = comps.fit_blocks(p, {"USAGE": ["a", "b"], "CTX": ["a"]})
    z = comps.with_blocks(p, blocks)
    out = comps.nearest(z.where("id % 50 = 0"), z, "id", "id", "bucket", comps.block_metrics(blocks), k=1, but_itself=True)
    return out.select(F.col("t_id").alias("t"), _r("dist", 5).alias("dist"))


# ---- seasons and dashboard --------------------------------------------------------------------------------------------


def _people(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("playerId"), F.concat(F.lit(" "), F.col("c_name")).alias("Player"), F.lit(2020).alias("start_year"), F.col("c_acctbal").alias("GAR_total"), F.col("c_nationkey").alias("n"))


def _contracts(spark, sf):
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(k.alias("contract_id"), F.col("o_custkey").alias("playerId"), (F.year("o_orderdate") + 20).alias("start_year"), (k % 8 + 1).cast("int").alias("length"), (F.col("o_totalprice") * 10).alias("aav"), F.when(k % 9 == 0, "ELC").otherwise("STD").alias("level"), (20 + k % 15).cast("int").alias("age"), F.when(k % 3 == 0, 70 + k % 9).alias("height"))


CONTRACTS = """k AS (SELECT o_orderkey AS contract_id, o_custkey AS "playerId", (year(o_orderdate) + 20)::INT AS start_year, (o_orderkey % 8 + 1)::INT AS length, o_totalprice * 10 AS aav, CASE WHEN o_orderkey % 9 = 0 THEN 'ELC' ELSE 'STD' END AS level, (20 + o_orderkey % 15)::INT AS age, CASE WHEN o_orderkey % 3 = 0 THEN 70 + o_orderkey % 9 END AS height FROM orders)"""


@query(f"""WITH {CONTRACTS}, l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY "playerId" ORDER BY start_year DESC, contract_id) = 1)
SELECT c_custkey AS "playerId", n_name AS team, contract_id, 2020 AS start_year, l.start_year AS start_year_contract, length FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON "playerId" = c_custkey""")
def dashboard_master(spark, sf):
    people = _people(spark, sf)
    teams = people.select("playerId", "n").join(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("team")), "n").select("playerId", "team")
    return seasons.dashboard_master(people, _contracts(spark, sf), teams).select("playerId", "team", "contract_id", "start_year", "start_year_contract", "length")


@query("SELECT c_custkey AS \"playerId\", c_name AS \"Player\" FROM customer")
def dashboard_players(spark, sf):
    people = _people(spark, sf)
    return seasons.player_list(people.unionByName(people.withColumn("start_year", F.lit(2019)).withColumn("Player", F.lit("older"))).unionByName(people.withColumn("playerId", -F.col("playerId") - 1).withColumn("Player", F.lit("  "))))


@query(f"""WITH cap(y, v) AS (VALUES {_caps(fixed.LEAGUE_CAP)}), h AS (SELECT (year(o_orderdate) + 20)::INT AS year, sum(o_totalprice) AS usd FROM orders WHERE o_custkey = 8 GROUP BY 1) SELECT year, round(100 * usd / v, 6) AS value FROM h JOIN cap ON y = year""")
def dashboard_value_history(spark, sf):
    priced = _contracts(spark, sf).groupBy("playerId", F.col("start_year").alias("year")).agg((F.sum("aav") / 10).alias("usd_SPAR"))
    return seasons.value_history(priced, 8, as_share=True).select("year", _r("value", 6).alias("value"))


@query(f"""WITH {CONTRACTS}, g AS (SELECT k.*, i, [c_acctbal / 100, c_acctbal / 200, c_acctbal / 400][i] AS gar FROM k JOIN customer ON c_custkey = "playerId", (SELECT unnest([1, 2, 3]) AS i)),
v AS (SELECT contract_id, length, aav, i, greatest(750000.0, gar / 2.9245::DOUBLE * 1571475.16::DOUBLE) AS value FROM g) SELECT contract_id, round(sum(value - aav), 1) AS surplus FROM v WHERE i <= length GROUP BY contract_id""")
def dashboard_surplus(spark, sf):
    contracts = _contracts(spark, sf)
    gar = F.col("GAR_total")
    projected = contracts.join(_people(spark, sf).select("playerId", "GAR_total"), "playerId").withColumn("projection", F.array(gar / 100, gar / 200, gar / 400))
    out = seasons.surplus(seasons.projected_values(projected), contracts)
    return out.select("contract_id", F.round("surplus", 1).alias("surplus"))


@query("""SELECT o_orderkey, CASE year(o_orderdate) WHEN 1997 THEN 'S-2' WHEN 1998 THEN 'S-1' ELSE 'S' END AS marker FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999""")
def dashboard_season_markers(spark, sf):
    rows = _t(spark, sf, "orders").withColumn("season", files.season_label(F.year("o_orderdate")))
    return seasons.season_markers(rows, "1999-2000").select("o_orderkey", "marker")


@query(f"""WITH {CONTRACTS}, b AS (SELECT "playerId", start_year, sum(aav) AS gar, count(*) AS toi FROM k GROUP BY ALL)
SELECT contract_id, k.start_year, round(gar, 1) AS gar, coalesce(height, last_value(height IGNORE NULLS) OVER (PARTITION BY k."playerId" ORDER BY k.start_year, contract_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS height
FROM k LEFT JOIN b ON b."playerId" = k."playerId" AND b.start_year + 1 = k.start_year WHERE level <> 'ELC'""")
def training_rows(spark, sf):
    contracts = _contracts(spark, sf)
    bank = contracts.groupBy("playerId", "start_year").agg(F.sum("aav").alias("gar"), F.count(F.lit(1)).alias("TOI_all")).withColumn("Team", F.lit("BOS"))
    bank = bank.unionByName(bank.withColumn("gar", F.lit(-1.0)).withColumn("TOI_all", F.lit(0).cast("bigint")))
    return seasons.training_rows(contracts, bank).select("contract_id", "start_year", _r("gar", 1).alias("gar"), "height")


@query(f"""WITH {CONTRACTS}, e AS (SELECT *, 'E' AS kind FROM k WHERE start_year = 2021), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY "playerId" ORDER BY start_year DESC, contract_id) = 1),
w AS (SELECT contract_id, "playerId", 2022 AS start_year, age + (2022 - start_year) AS age, 'W' AS kind FROM l WHERE "playerId" NOT IN (SELECT "playerId" FROM e)), u AS (SELECT contract_id, "playerId", start_year, age, kind FROM e UNION ALL SELECT * FROM w)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY "playerId" ORDER BY kind, contract_id) = 1""")
def what_if_rows(spark, sf):
    contracts = _contracts(spark, sf)
    return seasons.what_if_rows(contracts, contracts.where("start_year = 2021"), 2022).select("contract_id", "playerId", "start_year", "age", "kind")


@query("""WITH r AS (SELECT o_custkey AS t, year(o_orderdate) AS y, sum(o_totalprice) / 1e6 AS x, count(*) AS n FROM orders GROUP BY ALL), o AS (SELECT t, y, x, n, nullif(concat_ws(';', CASE WHEN n < 2 THEN 'zero_or_nan_TOI' END, CASE WHEN n < 300 AND abs(x) > 0.4 THEN 'small_TOI_high_rate' END, CASE WHEN x > 1.2 THEN 'extreme_xGF60' END), '') AS reasons FROM r)
SELECT t, y, reasons FROM o WHERE reasons IS NOT NULL""")
def season_outliers(spark, sf):
    rows = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("t"), F.year("o_orderdate").cast("bigint").alias("y")).agg((F.sum("o_totalprice") / 1e6).alias("xGF_per60"), F.count(F.lit(1)).alias("n"))
    out = seasons.outliers(rows.withColumn("TOI_seconds", F.when(F.col("n") < 2, 0).otherwise(F.col("n"))), 0.4)
    return out.select("t", "y", F.col("Reasons").alias("reasons"))


@query("""WITH l AS (SELECT s_suppkey AS id, s_name AS nm, CASE WHEN s_suppkey % 3 = 0 THEN 'D' ELSE 'F' END AS pos, n_regionkey AS team, year(l_shipdate) AS y, l_returnflag AS f, l_quantity / 2 AS q, l_extendedprice AS e, l_discount AS d, l_orderkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT id, y, count(DISTINCT l_orderkey)::DOUBLE AS gp FROM l GROUP BY ALL),
t AS (SELECT id, nm, pos, team, y, f, sum(q) AS toi, 60 * (sum(e) / 1e5) / sum(q) AS a, 60 * (sum(d * e) / 1e4) / sum(q) AS b FROM l GROUP BY ALL),
m AS (SELECT t.*, gp, 40 + id % 21 AS oz, u.ms, CASE WHEN ms = 'ES_off' THEN a WHEN ms = 'ES_def' THEN b WHEN ms = 'PP' THEN CASE WHEN id % 7 > 0 THEN a * 5 / 6 END ELSE b * 5 / 6 END AS rate, CASE WHEN ms IN ('ES_off', 'PP') THEN a ELSE b END AS pooled
  FROM t JOIN g USING (id, y) JOIN (VALUES ('N', 'ES_off'), ('N', 'ES_def'), ('A', 'PP'), ('R', 'PK')) u(f, ms) USING (f)),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y, ms, team, pos ORDER BY toi DESC, id) AS r FROM m)
  WHERE r > CASE ms WHEN 'PP' THEN CASE pos WHEN 'D' THEN 2 ELSE 5 END WHEN 'PK' THEN 4 ELSE CASE pos WHEN 'D' THEN 8 ELSE 12 END END AND gp >= 10 AND toi >= 100),
bd AS (SELECT y, ms, pos, quantile_cont(pooled, 0.95) AS hi, quantile_cont(pooled, 0.10) AS lo FROM pl GROUP BY ALL),
lv AS (SELECT y, ms, pos, sum(pooled * toi) / sum(toi) AS v FROM pl JOIN bd USING (y, ms, pos) WHERE CASE WHEN ms IN ('ES_off', 'PP') THEN pooled <= hi ELSE pooled >= lo END GROUP BY ALL),
bs AS (SELECT y, ms, p.pos, coalesce(max(CASE WHEN lv.pos = p.pos THEN v END), max(v)) AS base FROM lv, (VALUES ('F'), ('D')) p(pos) GROUP BY ALL),
sh AS (SELECT m.*, base, toi / (toi + k) AS w, toi / (toi + k) * coalesce(rate, base) + (1 - toi / (toi + k)) * base AS shr
  FROM (SELECT *, CASE WHEN ms = 'PP' THEN 120 WHEN ms = 'PK' THEN 1200 WHEN pos = 'D' THEN 260 ELSE 300 END AS k FROM m) m LEFT JOIN bs USING (y, ms, pos)),
lg AS (SELECT id, ms, y, toi, CASE WHEN ms IN ('PP', 'PK') THEN rate ELSE shr END AS lag FROM sh),
bl AS (SELECT sh.*, CASE WHEN sh.ms IN ('PP', 'PK') THEN w ELSE toi0 / gp / (CASE WHEN pos = 'D' THEN 260 ELSE 300 END / 9.0::DOUBLE) * gp / (gp + 9) END AS w0, coalesce(l1.toi / (l1.toi + pk), 0) AS w1, 0.55 * coalesce(l2.toi / (l2.toi + pk), 0) AS w2, l1.lag AS g1, l2.lag AS g2
  FROM (SELECT *, toi AS toi0, CASE ms WHEN 'PP' THEN 120 WHEN 'PK' THEN 600 ELSE 240 END AS pk FROM sh) sh LEFT JOIN lg l1 ON l1.id = sh.id AND l1.ms = sh.ms AND l1.y = sh.y - 1 LEFT JOIN lg l2 ON l2.id = sh.id AND l2.ms = sh.ms AND l2.y = sh.y - 2),
us AS (SELECT y, avg(100 - oz) AS dz FROM m WHERE ms = 'ES_def' GROUP BY y),
ga AS (SELECT id, nm, pos, team, y, gp, ms, toi, CASE WHEN ms IN ('ES_off', 'PP') THEN b - base ELSE base - b END * CASE WHEN ms = 'ES_def' THEN greatest(0.92, least(1.08, 1 + 0.10 * ((100 - oz) - dz) / 25)) ELSE 1 END * toi / 60 AS gar
  FROM (SELECT * EXCLUDE (b), (w0 * shr + w1 * coalesce(g1, base) + w2 * coalesce(g2, base)) / (w0 + w1 + w2) AS b FROM bl) JOIN us USING (y)),
o AS (SELECT id, pos, y, gp, coalesce(max(CASE WHEN ms = 'ES_off' THEN toi END), 0) AS ev, coalesce(max(CASE WHEN ms = 'PP' THEN toi END), 0) AS pp, coalesce(max(CASE WHEN ms = 'PK' THEN toi END), 0) AS pk, coalesce(max(CASE WHEN ms = 'ES_off' THEN gar END), 0) AS g_off, coalesce(max(CASE WHEN ms = 'ES_def' THEN gar END), 0) AS g_def, coalesce(max(CASE WHEN ms = 'PP' THEN gar END), 0) AS g_pp, coalesce(max(CASE WHEN ms = 'PK' THEN gar END), 0) AS g_pk FROM ga GROUP BY id, nm, pos, team, y, gp),
r AS (SELECT *, g_off + g_def + g_pp + g_pk AS total, (ev + pp + pk) / gp AS tpg, CASE WHEN gp < 15 THEN 'Other' WHEN pos = 'D' THEN CASE WHEN (ev + pp + pk) / gp <= 15 THEN '3rd Pair' WHEN (ev + pp + pk) / gp <= 18 THEN 'Bottom-4' WHEN (ev + pp + pk) / gp <= 20 THEN 'Top-4' ELSE '1st Pair' END
  WHEN (ev + pp + pk) / gp <= 9 THEN '4th Line' WHEN (ev + pp + pk) / gp <= 12 THEN 'Bottom-6' WHEN (ev + pp + pk) / gp <= 15.5 THEN 'Middle-6' WHEN (ev + pp + pk) / gp <= 18.5 THEN 'Top-6' ELSE '1st Line' END AS role FROM o)
SELECT id AS "playerId", y AS start_year, role AS "RoleBucket", round(g_off, 4) + 0.0 AS es_off, round(g_def, 4) + 0.0 AS es_def, round(g_pp, 4) + 0.0 AS pp, round(g_pk, 4) + 0.0 AS pk, round(total, 4) + 0.0 AS gar, round(total / 6, 4) + 0.0 AS war, round(total / 3, 4) + 0.0 AS spar,
  CASE WHEN gp >= 9 AND ev + pp + pk > 0 THEN round(100.0::DOUBLE * (rank() OVER w + (count(*) OVER (PARTITION BY y, pos, role, total) - 1) / 2.0) / count(*) OVER (PARTITION BY y, pos, role), 3) END AS pct
FROM r WINDOW w AS (PARTITION BY y, pos, role ORDER BY total)""")
def gar_war_spar(spark, sf):
    """The whole assembly: three situations of a skater's seasons, shrunk, blended, against replacement, in wins and points."""
    place = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = place.select(F.col("s_suppkey").alias("playerId"), F.col("s_name").alias("Player"), F.when(F.col("s_suppkey") % 3 == 0, "D").otherwise("F").alias("PosBucket"), F.col("n_regionkey").cast("string").alias("Team"))
    line = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("playerId"), F.year("l_shipdate").cast("bigint").alias("start_year"), "l_returnflag", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    sums = line.groupBy("playerId", "start_year", "l_returnflag").agg((F.sum("l_quantity") / 2).alias("TOI"), (F.sum("l_extendedprice") / 1e5).alias("a"), (F.sum(F.col("l_discount") * F.col("l_extendedprice")) / 1e4).alias("b"))
    games = line.groupBy("playerId", "start_year").agg(F.count_distinct("l_orderkey").cast("double").alias("GP"))
    rows = sinks.cut(sums.join(games, ["playerId", "start_year"]).join(place, "playerId"))
    rate = lambda c: 60 * F.col(c) / F.col("TOI")
    part = lambda flag, *names: rows.where(F.col("l_returnflag") == flag).select("playerId", "Player", "PosBucket", "Team", "GP", "start_year", "TOI", *names)
    es = part("N", rate("a").alias("xGF60"), rate("b").alias("xGA60"), (40 + F.col("playerId") % 21).alias("oz"))
    pp = part("A", rate("a").alias("GF60"), F.when(F.col("playerId") % 7 > 0, rate("a") * 5 / 6).alias("xGF60"))
    pk = part("R", rate("b").alias("GA60"), (rate("b") * 5 / 6).alias("xGA60"))
    years = rows.select("start_year").distinct().withColumn("goals_per_win", F.lit(6.0)).withColumn("goals_per_point", F.lit(3.0))
    out = value.gar(es, pp, pk, years)
    # places are ranked again without rounding, as ties of rounded halves differ by language
    out = ranks.pct_rank_avg(out, ["start_year", "PosBucket", "RoleBucket"], "GAR_total", "pct", (F.col("GP") >= 9) & (F.col("TOI_all") > 0), None)
    return out.select("playerId", "start_year", "RoleBucket", *[(_r(c) + F.lit(0.0)).alias(n) for c, n in (("GAR_ES_off", "es_off"), ("GAR_ES_def", "es_def"), ("GAR_PP", "pp"), ("GAR_PK", "pk"), ("GAR_total", "gar"), ("WAR", "war"), ("SPAR", "spar"))], _r("pct", 3).alias("pct"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('17:' || o_orderkey), o_orderkey LIMIT 50")
def hash_sampled(spark, sf):
    return stats.hash_sample(_t(spark, sf, "orders"), "o_orderkey", 50).select("o_orderkey")


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 5 - 2 AS diff, o_orderkey % 4 = 0 AS fo FROM orders), r AS (SELECT *, h, CASE WHEN h THEN diff ELSE -diff END AS own FROM s, (VALUES (true), (false)) v(h))
SELECT h::INT AS is_home, CASE WHEN h THEN 'PP' ELSE 'PK' END AS situation, count(*) AS n, sum(CASE WHEN fo AND h THEN 1 ELSE 0 END)::BIGINT AS zone_off, sum(CASE WHEN fo AND NOT h THEN 1 ELSE 0 END)::BIGINT AS zone_def, sum(CASE WHEN fo THEN 0 ELSE 1 END)::BIGINT AS on_fly, sum(CASE WHEN own = 2 THEN 1 ELSE 0 END)::BIGINT AS plus2, sum(CASE WHEN own = -1 THEN 1 ELSE 0 END)::BIGINT AS minus1 FROM r GROUP BY h""")
def stint_sides(spark, sf):
    """Two rows for each stint, one stint for each order."""
    k = F.col("o_orderkey")
    made = _t(spark, sf, "orders").select(k.alias("gameId"), (k % 3 + 1).alias("period"), (k % 600).alias("startSec"), (k % 600 + 30).alias("endSec"), F.array(k, k + 1).alias("home_"), F.array(k + 5).alias("away_"), (k % 5 - 2).alias("diff"), (k % 4 == 0).alias("fo_start"), F.lit("O").alias("fo_zone"), F.lit("ES").alias("before"), F.lit("PP").alias("strength"), F.lit("BOS").alias("home_team"), F.lit("NYR").alias("away_team"), k.alias("j"), F.lit(0.5).alias("home_xg"), F.lit(0.25).alias("away_xg"))
    count = lambda c: F.sum(F.col(c).cast("int")).cast("bigint")
    rows = stints.sides(made).groupBy(F.col("is_home").cast("int").alias("is_home"), "situation")
    return rows.agg(F.count(F.lit(1)).alias("n"), count("zone_off").alias("zone_off"), count("zone_def").alias("zone_def"), count("pp_started_on_fly").alias("on_fly"), count("score_plus2").alias("plus2"), count("score_minus1").alias("minus1"))


@query("""WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, avg(l_extendedprice / 1e4) AS my FROM lineitem), c AS (SELECT l_quantity - m1 AS x, l_discount - m2 AS y, l_tax - m3 AS z, l_extendedprice / 1e4 - my AS t FROM lineitem, m),
n AS (SELECT sum(x * x) + 2 AS a, sum(x * y) AS b, sum(x * z) AS c, sum(y * y) + 2 AS d, sum(y * z) AS e, sum(z * z) + 2 AS f, sum(x * t) AS p, sum(y * t) AS q, sum(z * t) AS r FROM c),
k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM n),
w AS (SELECT (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS w1, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS w2, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS w3 FROM k),
v AS (SELECT l_extendedprice / 1e4 AS y, my + w1 * (l_quantity - m1) + w2 * (l_discount - m2) + w3 * (l_tax - m3) AS p FROM lineitem, m, w)
SELECT round(corr(p, y), 6) AS r, count(p) AS n, round(avg(p * p), 4) AS square, round(min(p), 4) AS low, round(max(p), 4) AS high FROM v""")
def term_ridge(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1e4).alias("y"))
    model = models.ridge_fit(rows, ["l_quantity", "l_discount", "l_tax"], "y")
    return models.predict_linear(rows, model, "p").agg(_r(F.corr("p", "y"), 6).alias("r"), F.count("p").alias("n"), _r(F.avg(F.col("p") * F.col("p"))).alias("square"), _r(F.min("p")).alias("low"), _r(F.max("p")).alias("high"))
