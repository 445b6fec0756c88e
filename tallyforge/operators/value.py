"""Valuation: replacement levels, shrunk and blended rates, market rates, prices, caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import fixed, numeric, text
from tallyforge.operators import ranges, ranks, stats
from tallyforge.sources import sinks
from tallyforge.sources.files import lookup


def _years(table: Mapping[str, int]) -> dict[int, int]:
    return {int(k[:4]): v for k, v in table.items()}


def cap_of(year: Column, table: Mapping[str, int] = fixed.LEAGUE_CAP, growth: float = fixed.CAP_GROWTH) -> Column:
    """The cap of a start year; grown from the last known one beyond the table, the first before it."""
    known = _years(table)
    first, last = min(known), max(known)
    beyond = F.bround(F.lit(known[last]) * F.pow(F.lit(1 + growth), year - last), 0)
    return F.when(year < first, float(known[first])).when(year > last, beyond).otherwise(lookup(year.cast("int"), known).cast("double"))


def min_salary_of(year: Column, table: Mapping[str, int] = fixed.MIN_SALARY) -> Column:
    """The last known minimum at or before the year; before the first, the last of all."""
    known = _years(table)
    last = max(known)
    return F.when((year < min(known)) | (year > last), float(known[last])).otherwise(lookup(year.cast("int"), known).cast("double"))


def locf(df: DataFrame, table: DataFrame, at: str, table_at: str, value: str, growth: float = 0.0) -> DataFrame:
    """J20, J21 over any table: the latest value at or before, grown by compounding; before the first, or at null, the
    first. Each time that occurs is looked up once and joined back; times and values are carried along one axis that is
    cut by range, so neither side is sent whole to a task."""
    first = table.agg(F.min_by(F.col(value), F.col(table_at)).cast("double").alias("_first"))
    known = F.struct(F.col(table_at).alias("at"), F.col(value).cast("double").alias("value"))
    both = table.select(F.col(table_at).alias("_time"), F.lit(0).alias("_side"), known.alias("_known"))
    asked = df.where(F.col(at).isNotNull()).select(F.col(at).alias("_time"), F.lit(1).alias("_side")).distinct()
    line = ranges.carried(both.unionByName(asked, allowMissingColumns=True), [F.col("_time"), F.col("_side")], "_known", "_last").where("_side = 1").select("_time", "_last")
    rows = df.join(line, df[at] == line["_time"], "left").crossJoin(F.broadcast(first))
    grown = F.col("_last.value") * F.pow(F.lit(1 + growth), F.col(at) - F.col("_last.at"))
    return rows.withColumn(value, F.coalesce(grown, F.col("_first"))).drop("_time", "_last", "_first")


def replacement_levels(players: DataFrame, team: str, pos: str, toi: str, games: str, value: str, cutoff: Mapping[str, int], trim_low: float = 0.0, trim_high: float = 0.0, least_games: int = 10, least_toi: float = 100.0, seq: str = "playerId") -> DataFrame:
    """A4: weighted trimmed mean by position of those below the cutoff rank of their team; F and D stand in for each other."""
    ranked = ranks.rank_first(players, [team, pos], [F.col(toi).desc(), F.col(seq)])
    gate = F.lit(False)
    for p, n in cutoff.items():
        gate = gate | ((F.col(pos) == p) & (F.col("rank") > n))
    pool = ranked.where(gate & (F.col(games) >= least_games) & (F.col(toi) >= least_toi))
    levels = stats.weighted_trimmed_mean(pool, [pos], value, toi, trim_low, trim_high, "level")
    sides = stats.cross_fill(levels, pos, "level")
    return sides.select(F.inline(F.array(F.struct(F.lit("F").alias(pos), F.col("F").alias("level")), F.struct(F.lit("D").alias(pos), F.col("D").alias("level")))))


#: What each measure of a skater's season is: its situation, the table's rate and the rate that its pool is averaged by, and
#: whether more of it is better.
MEASURES = {"ES_off": ("ES", "xGF60", "xGF60", True), "ES_def": ("ES", "xGA60", "xGA60", False), "PP": ("PP", "xGF60", "GF60", True), "PK": ("PK", "xGA60", "GA60", False)}
TRIM_HIGH, TRIM_LOW = 0.05, 0.10  # of a pool's best attacks, and of its best defences


def _by_measure(column: Column, values: Mapping[str, object], default: Column | None = None) -> Column:
    """A value for each measure."""
    out = default
    for name, v in values.items():
        c = v if isinstance(v, Column) else F.lit(v)
        out = F.when(column == name, c) if out is None else F.when(column == name, c).otherwise(out)
    return out


def _measured(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, TOI, oz, measure, rate, pooled): a row for each measure of each row of the situations' tables."""
    out = None
    for situation, table in tables.items():
        own = [F.struct(F.lit(m).alias("measure"), F.col(rate).cast("double").alias("rate"), F.col(pooled).cast("double").alias("pooled")) for m, (s, rate, pooled, _) in MEASURES.items() if s == situation]
        oz = F.col("oz").cast("double") if "oz" in table.columns else F.lit(None).cast("double")
        rows = table.select(*keys, F.coalesce(F.col("TOI").cast("double"), F.lit(0.0)).alias("TOI"), oz.alias("oz"), F.inline(F.array(*own)))
        out = rows if out is None else out.unionByName(rows)
    return out


def replacement_bases(measured: DataFrame, season: str, team: str = "Team", least_games: int = 10, least_toi: float = 100.0) -> DataFrame:
    """(season, measure, PosBucket, base), A4: what those below their team's cutoff give, for all seasons and measures in
    one grouped pass: means weighted by time without the best twentieth of attacks or tenth of defences. Forwards and
    defenders stand in for each other where one group is empty; both null where both are."""
    m = F.col("measure")
    ranked = ranks.rank_first(measured, [season, "measure", team, "PosBucket"], [F.col("TOI").desc(), F.col("playerId")])
    cutoff = lambda p: _by_measure(m, {name: fixed.POOL_CUTOFF[s][p] for name, (s, *_) in MEASURES.items()})
    below = F.col("rank") > F.when(F.col("PosBucket") == "D", cutoff("D")).otherwise(cutoff("F"))
    pool = ranked.where(below & (F.col("GP") >= least_games) & (F.col("TOI") >= least_toi))
    pool = sinks.cut(pool.select(season, "measure", "PosBucket", "TOI", "pooled"))
    better = m.isin([name for name, (*_, up) in MEASURES.items() if up])
    group = [season, "measure", "PosBucket"]
    means = stats.weighted_trimmed_mean(pool.where(better), group, "pooled", "TOI", 0.0, TRIM_HIGH, "level").unionByName(stats.weighted_trimmed_mean(pool.where(~better), group, "pooled", "TOI", TRIM_LOW, 0.0, "level"))
    side = lambda p: F.max(F.when(F.col("PosBucket") == p, F.col("level")))
    wide = means.groupBy(season, "measure").agg(side("F").alias("f"), side("D").alias("d"))
    both = F.array(F.struct(F.lit("F").alias("PosBucket"), F.coalesce("f", "d").alias("base")), F.struct(F.lit("D").alias("PosBucket"), F.coalesce("d", "f").alias("base")))
    return wide.select(season, "measure", F.inline(both))


def _with_lags(rows: DataFrame, season: str) -> DataFrame:
    """With TOI_1, TOI_2, lag_1 and lag_2: time and mean of ``lagged`` in the two seasons before. Rows are replicated to the
    later seasons that they serve and grouped once; a mean over a missing value is missing."""
    ahead = rows.where("playerId is not null").select("playerId", "measure", "TOI", "lagged", F.col(season).alias("_s"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_lag"))
    served = ahead.withColumn(season, F.col("_s") + F.col("_lag"))
    w, aggs = F.col("TOI") + 1e-9, []
    for i in (1, 2):
        on = F.col("_lag") == i
        whole = F.count(F.when(on, F.col("lagged"))) == F.count(F.when(on, 1))
        aggs += [F.sum(F.when(on, F.col("TOI"))).alias(f"TOI_{i}"), F.when(whole, F.sum(F.when(on, F.col("lagged") * w)) / F.sum(F.when(on, w))).alias(f"lag_{i}")]
    return rows.join(served.groupBy("playerId", "measure", season).agg(*aggs), ["playerId", "measure", season], "left")


def gar(es: DataFrame, pp: DataFrame, pk: DataFrame, goals: DataFrame, season: str = "start_year", join_games: bool = True) -> DataFrame:
    """Goals above replacement, wins and points of all seasons at once.

    ``es``: playerId, Player, PosBucket, Team, GP, season, TOI, xGF60, xGA60, oz; ``pp``: .. TOI, GF60 (actual), xGF60;
    ``pk``: .. TOI, GA60, xGA60; ``goals``: season, goals_per_win, goals_per_point. Each rate is shrunk towards its pool's
    by its time, and blended with those of the two seasons before: at even strength with shrunk ones, else with raw ones.
    The situations are stored once, a row for each measure; all later steps group or join these rows. With
    ``join_games`` the key of a skater's row holds games played, as it did originally (Q5); without it one row stays one
    row. A key that repeats within a situation is an error.
    """
    f = fixed
    keys = ["playerId", "Player", "PosBucket", "Team", "GP", season]
    m, toi = F.col("measure"), F.col("TOI")
    rows = sinks.cut(_measured({"ES": es, "PP": pp, "PK": pk}, keys))
    bases = sinks.small(sinks.cut(replacement_bases(rows, season)))
    usage = sinks.small(sinks.cut(rows.where("measure = 'ES_def'").groupBy(season).agg(F.avg(100 - F.coalesce("oz", F.lit(50.0))).alias("mean_dz"))))
    # shrunk towards the pool
    by_pos = F.when(F.col("PosBucket") == "D", f.SHRINK_ES["D"]).otherwise(f.SHRINK_ES["F"])
    k = _by_measure(m, {"PP": f.CURRENT_K["PP"], "PK": f.CURRENT_K["PK"]}, by_pos)
    rows = rows.join(bases, [season, "measure", "PosBucket"], "left").withColumn("_w", numeric.shrink(toi, k))
    rows = rows.withColumn("shrunk", F.col("_w") * F.coalesce("rate", "base") + (1 - F.col("_w")) * F.col("base"))
    rows = rows.withColumn("lagged", F.when(m.isin("PP", "PK"), F.col("rate")).otherwise(F.col("shrunk")))
    rows = _with_lags(sinks.cut(rows), season)
    # blended with the seasons before
    per_game = F.when(F.col("GP") > 0, toi / F.col("GP") / (by_pos / 9) * F.col("GP") / (F.col("GP") + 9)).otherwise(0.0)
    now = F.when(m.isin("PP", "PK"), F.col("_w")).otherwise(F.greatest(F.lit(0.0), per_game))
    prior = _by_measure(m, {name: f.PRIOR_K[s] for name, (s, *_) in MEASURES.items()})
    weights = [now, numeric.shrink(F.coalesce("TOI_1", F.lit(0.0)), prior), f.LAG_DECAY * numeric.shrink(F.coalesce("TOI_2", F.lit(0.0)), prior)]
    rows = rows.withColumns({f"_w{i}": w for i, w in enumerate(weights)})
    total = F.col("_w0") + F.col("_w1") + F.col("_w2")
    parts = F.col("_w0") * F.coalesce("shrunk", "base") + F.col("_w1") * F.coalesce("lag_1", "base") + F.col("_w2") * F.coalesce("lag_2", "base")
    rows = rows.withColumn("blend", parts / F.when(total > 0, total).otherwise(1.0)).join(usage, season, "left")
    # against replacement
    sheltered = numeric.clip(1 + 0.10 * ((100 - F.coalesce("oz", F.lit(50.0))) - F.col("mean_dz")) / 25, 0.92, 1.08)
    better = m.isin([name for name, (*_, up) in MEASURES.items() if up])
    above = F.when(better, F.col("blend") - F.col("base")).otherwise(F.col("base") - F.col("blend"))
    rows = rows.withColumn("gar", above * F.when(m == "ES_def", sheltered).otherwise(1.0) * toi / 60)
    # one row for each skater's season
    row = keys if join_games else [c for c in keys if c != "GP"]
    pick = lambda name, c: F.max(F.when(m == name, F.col(c)))
    once = F.greatest(*[F.count(F.when(m == name, 1)) for name in MEASURES]) <= 1
    guard = lambda c: F.when(once, c).otherwise(F.raise_error(F.lit(f"a key of {', '.join(row)} repeats within a situation")))
    facts = {
        "TOI_EV": ("ES_off", "TOI"), "TOI_PP": ("PP", "TOI"), "TOI_PK": ("PK", "TOI"), "ES_xGF60_shr": ("ES_off", "shrunk"), "ES_xGA60_shr": ("ES_def", "shrunk"), "ES_xGF60_blend": ("ES_off", "blend"), "ES_xGA60_blend": ("ES_def", "blend"),
        "PP_GF60_shr": ("PP", "shrunk"), "PK_GA60_shr": ("PK", "shrunk"), "GAR_ES_off": ("ES_off", "gar"), "GAR_ES_def": ("ES_def", "gar"), "GAR_PP": ("PP", "gar"), "GAR_PK": ("PK", "gar"),
    }
    zero = ("TOI_EV", "TOI_PP", "TOI_PK", "GAR_ES_off", "GAR_ES_def", "GAR_PP", "GAR_PK")
    aggs = [guard(F.coalesce(pick(*at), F.lit(0.0)) if name in zero else pick(*at)).alias(name) for name, at in facts.items()]
    out = rows.groupBy(*row).agg(*aggs, *([] if join_games else [F.max("GP").alias("GP")]))
    out = out.withColumns({"TOI_all": F.col("TOI_EV") + F.col("TOI_PP") + F.col("TOI_PK"), "GAR_off": F.col("GAR_ES_off") + F.col("GAR_PP"), "GAR_def": F.col("GAR_ES_def") + F.col("GAR_PK")})
    out = out.withColumn("GAR_total", F.col("GAR_off") + F.col("GAR_def")).join(sinks.small(goals), season, "left")
    over = lambda c: F.when(F.col(c) > 0, F.col("GAR_total") / F.col(c))
    out = out.withColumns({"WAR": over("goals_per_win"), "SPAR": over("goals_per_point"), "TOI_perG": F.when(F.col("GP") > 0, F.col("TOI_all") / F.col("GP")).otherwise(0.0)})
    out = out.withColumn("RoleBucket", text.role_bucket(F.col("PosBucket"), F.col("GP"), F.col("TOI_perG"))).withColumn("_es", F.col("GAR_ES_off") + F.col("GAR_ES_def"))
    # ranks within position and role: one shuffle serves them all
    out = out.repartition(season, "PosBucket", "RoleBucket")
    played = F.col("GP") >= 9
    masks = {
        "ES": ("_es", played & (F.col("TOI_EV") > 0)), "PP": ("GAR_PP", F.col("TOI_PP") >= 60), "PK": ("GAR_PK", F.col("TOI_PK") >= 60),
        **{name: (f"GAR_{name}", played & (F.col("TOI_all") > 0)) for name in ("off", "def", "total")},
    }
    for name, (value, mask) in masks.items():
        out = ranks.pct_rank_avg(out, [season, "PosBucket", "RoleBucket"], value, f"pct_{name}_pos_role", mask)
    return out.drop("_es")


def season_blend(df: DataFrame, key: str, year: str, columns: Sequence[str], weights: Sequence[float] = fixed.SEASON_BLEND) -> DataFrame:
    """X24 over seasons: this one and the two before, weights renormalised over those that are there. Rows are
    replicated to the seasons they serve and grouped: no self-join. Only seasons that a key has are returned."""
    served = df.withColumn("_lag", F.explode(F.array(*[F.lit(i) for i in range(len(weights))])))
    served = served.withColumn("_year", F.col(year) + F.col("_lag"))
    wide = served.groupBy(key, F.col("_year").alias(year)).agg(F.count(F.when(F.col("_lag") == 0, 1)).alias("_now"), *[F.max(F.when(F.col("_lag") == i, F.col(c))).alias(f"_{c}_{i}") for c in columns for i in range(len(weights))])
    out = wide.where("_now > 0")
    return out.select(key, year, *[numeric.blend([F.col(f"_{c}_{i}") for i in range(len(weights))], weights).alias(c) for c in columns])


def market_rates(contracts: DataFrame, keys: Sequence[str], bucket: str, cap_share: str, metric: str | Sequence[str], trim_from: int = 20, least: int = 15) -> DataFrame:
    """(keys, bucket, rate, n) with a bucket ALL: the median share of the cap for a unit of the metric,
    within the 20-80 percentile band where there are enough; buckets of under ``least`` contracts take ALL's rate. Several
    metrics are placed together, and ``metric`` names them. Quantiles are those of ``stats.quantiles``: no task holds the
    ratios of a group, whatever its size."""
    metrics = [metric] if isinstance(metric, str) else list(metric)
    share = F.col(cap_share)
    once = sinks.cut(contracts.select(*keys, F.col(bucket).alias("_own"), *[F.when((F.col(m) > 0) & (share > 0), share / F.col(m)).alias(m) for m in metrics]))
    ratios = F.array(*[F.struct(F.lit(m).alias("metric"), b.alias("_bucket"), F.col(m).alias("_ratio")) for m in metrics for b in (F.lit("ALL"), F.col("_own"))])
    group = [*keys, "metric", "_bucket"]
    rows = once.select(*keys, F.inline(ratios)).where("_ratio is not null")
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    edges = sinks.small(sinks.cut(counts.join(stats.quantile_columns(rows, group, "_ratio", {"_lo": 0.2, "_hi": 0.8}), group)))
    inside = rows.join(edges, group).where((F.col("_n") < trim_from) | F.col("_ratio").between(F.col("_lo"), F.col("_hi"))).select(*group, "_ratio")
    found = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(stats.quantile_columns(inside, group, "_ratio", {"own_rate": 0.5}), group)
    found = sinks.cut(found)
    out = found.join(found.where("_bucket = 'ALL'").select(*keys, "metric", F.col("own_rate").alias("_all")), [*keys, "metric"])
    out = out.select(*keys, F.col("_bucket").alias("bucket"), F.when(F.col("n") >= least, F.col("own_rate")).otherwise(F.col("_all")).alias("rate"), "n", "metric")
    return out.drop("metric") if isinstance(metric, str) else out


def goal_table(standings: DataFrame, teams: DataFrame, first: int = 2020) -> DataFrame:
    """Goals to a win and to a standing point by season, from three-season weighted slopes, rounded to four digits."""
    rows = standings.join(teams, ["year", "team"]).where(F.col("year") >= first)
    rows = rows.withColumns({"gd": F.col("goal_diff") / F.col("gp"), "w": F.col("wins") / F.col("gp"), "p": F.col("points") / F.col("gp")})
    win = stats.wls_slope_window(rows, "year", "w", "gd", 3, "goals_per_win")
    point = stats.wls_slope_window(rows, "year", "p", "gd", 3, "goals_per_point")
    return win.join(point, "target").select(F.col("target").alias("start_year"), F.bround("goals_per_win", 4).alias("goals_per_win"), F.bround("goals_per_point", 4).alias("goals_per_point"))


def age_curve(spark) -> DataFrame:
    """Mean, least and greatest of the three published curves by age and position, each over its own peak."""
    knots = [(source, pos, [{"x": float(x), "y": y} for x, y in ks]) for (source, pos), ks in fixed.AGE_KNOTS.items()]
    curves = spark.createDataFrame(knots, "source string, pos string, knots array<struct<x double, y double>>")
    rows = curves.crossJoin(spark.range(18, 39).withColumnRenamed("id", "age")).withColumn("raw", numeric.piecewise(F.col("age").cast("double"), F.col("knots")))
    rows = ranks.over_peak(rows, ["source", "pos"], "raw", "v")
    pick = [F.bround(F.max(F.when(F.col("source") == s, F.col("v"))), 3).alias(s) for s in ("Dom", "Tulsky", "EvolvingWild")]
    return rows.groupBy("age", "pos").agg(*pick, F.bround(F.avg("v"), 3).alias("avg"), F.bround(F.min("v"), 3).alias("lower"), F.bround(F.max("v"), 3).alias("upper"))
