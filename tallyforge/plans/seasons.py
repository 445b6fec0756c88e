"""Whole plans over seasons: skater tables, valuation, projection, comparables, dashboard queries (2.11, 2.12, section 3).

Each takes the landed tables of all seasons at once and returns one table; earlier seasons come by lagged joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schema as S
from tallyforge.functions import fixed, numeric, text
from tallyforge.operators import comps, events, joins, models, ranks, stats, stints, value
from tallyforge.sources import sinks

# ---- play by play to rates ------------------------------------------------------------------------------------------


def shot_values(plays: DataFrame, shifts: DataFrame) -> tuple[DataFrame, DataFrame, models.Logit | None]:
    """3.1: (events with expected goals, shifts with them attributed, the model). Model rows are unblocked shots with a place."""
    marked = events.faceoff_winner(events.running_score(plays))
    marked = marked.withColumns({"isGoal": (F.col("type") == "GOAL").cast("int"), "isPP": F.coalesce((F.col("strengthBucket") == "PP").cast("int"), F.lit(0)), "isSH": F.coalesce((F.col("strengthBucket") == "SH").cast("int"), F.lit(0))})
    marked = S.ensure(marked, {"isRebound": F.lit(0), "isRush": F.lit(0)})
    features = ["dist", "angle", "isRebound", "isRush", "isPP", "isSH"]
    model = models.fit_logit(marked.where("isFenwick"), features, "isGoal")
    scored = models.score_logit(marked, model, "xG", F.col("isFenwick"))
    shots = scored.where("isFenwick").select("gameId", "period", "eventSec", F.col("teamAbbrev").alias("shot_team"), "xG")
    # a period is short, so its shots and shifts meet in it whole: bins would only make a shift several rows
    out = joins.attribute_points_to_intervals(shifts, shots, ["gameId", "period"], ["gameId", "playerId", "shiftNumber"], "eventSec", "startSec", "endSec", "xG", "teamAbbrev", "shot_team")
    return scored, out.withColumnsRenamed({"value_for": "shift_xGF", "value_against": "shift_xGA", "n_for": "fenwickF", "n_against": "fenwickA"}), model


CONTEXT = ("is_home", "zone_off", "zone_def", "zone_neu", "PPx", "PKx", "ev_after_pp_on_fly", "pp_started_on_fly", "score_plus1", "score_minus1", "score_plus2", "score_minus2", "score_plus3p", "score_minus3p", "per2", "per3")


def skater_rates(stint_rows: DataFrame, situation: str = "ES", grid: Sequence[float] = models.GRID) -> tuple[DataFrame, dict]:
    """3.1: ridge rates of skaters in a situation."""
    return models.rapm(stints.for_situation(stint_rows, situation), list(CONTEXT), grid)


# ---- names, games, situations ---------------------------------------------------------------------------------------


def match_games(raw: DataFrame, schedule: DataFrame, tol: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of a second source (game text, team, figures) matched to the schedule by pair of teams and day, and the rest."""
    rows = raw.withColumn("date", text.iso_date(F.col("Game"))).withColumn("code", text.team_code(F.col("Team")))
    pairs = rows.groupBy("Game", "date").agg(F.sort_array(F.collect_set("code")).alias("pair")).where(F.size("pair") == 2)
    pairs = pairs.withColumn("pair_key", F.array_join("pair", "|"))
    wide = joins.pair_sides(schedule, "gameId", "home_or_away", {"home": "home", "away": "away"}, ["Team", "gameDate"])
    wide = wide.withColumn("pair_key", stats.pair_key(F.col("home_Team"), F.col("away_Team"))).withColumn("sched_date", F.col("home_gameDate").cast("date"))
    found = joins.tolerant_date_join(pairs, wide.select("gameId", "pair_key", "sched_date"), ["pair_key"], "date", "sched_date", ["Game"], tol, [F.col("gameId")])
    out = rows.join(found.select("Game", "gameId", "day_offset"), "Game")
    return out, rows.join(found.select("Game"), "Game", "left_anti")


def situation_master(counts: DataFrame, rates: DataFrame, label: str, ids: DataFrame, names: DataFrame, keys: Sequence[str] = ("name", "season")) -> DataFrame:
    """3.2: one row for each player of a season: summed counts, rates weighted by time, teams in order, identifiers by
    name and position, then by name."""
    rows = counts.withColumn("name", text.canonical_name(F.col("Player")))
    sums = stats.sum_by(rows, keys, [c for c in S.numeric_columns(rows) if c not in (*keys, "ingest_seq")])
    teams = rows.groupBy(*keys).agg(stats.ordered_distinct(F.col("ingest_seq"), "Team").alias("Teams_List"), F.min_by("Team", "ingest_seq").alias("TeamStd_Primary"), F.min_by("Position", "ingest_seq").alias("Position"))
    weighted = rates.withColumn("name", text.canonical_name(F.col("Player")))
    columns = [c for c in S.numeric_columns(weighted, (*keys, "TOI", "ingest_seq")) if c not in sums.columns]
    means = weighted.groupBy(*keys).agg(*[stats.weighted_mean(c, "TOI").alias(c) for c in columns])
    out = sums.join(teams, list(keys), "left").join(means, list(keys), "left").withColumn("Situation", F.lit(label))
    out = out.withColumn("PosBucket", text.position_bucket(F.col("Position")))
    return joins.lookup_chain(out, [(ids, ["name", "PosBucket"]), (names, ["name"])], "id", ["seq"], "playerId")


def outliers(master: DataFrame, limit: float, compat: bool = False) -> DataFrame:
    """Rows with a reason; ``compat`` names the first reason on every flagged row, as it once was."""
    t, v = F.col("TOI_seconds"), F.col("xGF_per60")
    rules = {"zero_or_nan_TOI": t.isNull() | (t <= 0), "small_TOI_high_rate": (t < 300) & (F.abs(v) > limit), "extreme_xGF60": v > limit * 3}
    out = master.withColumn("Reasons", stats.outlier_reasons(rules)).where("Reasons is not null")
    return out.withColumn("Reasons", F.when(F.col("Reasons").startswith("zero"), F.col("Reasons")).otherwise(F.concat(F.lit("zero_or_nan_TOI;"), F.col("Reasons")))) if compat else out


# ---- market ---------------------------------------------------------------------------------------------------------


def market_and_values(skaters: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """3.2, A5: (rates by contract season and bucket, each skater's prices). Skaters: playerId, Player, PosBucket,
    start_year, WAR, SPAR; contracts: playerId, start_year, level, cap_hit, PosBucket."""
    blended = value.season_blend(skaters, "playerId", "start_year", ["WAR", "SPAR"])
    facts = blended.join(skaters.select("playerId", "Player", "PosBucket", "start_year").dropDuplicates(["playerId", "start_year"]), ["playerId", "start_year"]).withColumn("year", F.col("start_year") + 1)
    cap, least = value.cap_of(F.col("year")), value.min_salary_of(F.col("year"))
    signed = contracts.where(F.col("playerId").isNotNull() & (F.col("cap_hit") > 0) & (F.coalesce("level", F.lit("")) != "ELC")).select("playerId", F.col("start_year").alias("year"), "cap_hit", F.when(F.col("PosBucket") == "D", "D").otherwise("F").alias("bucket"))
    joined = signed.join(facts.select("playerId", "year", "WAR", "SPAR"), ["playerId", "year"]).withColumn("share", F.col("cap_hit") / cap)
    rates = value.market_rates(joined, ["year"], "bucket", "share", ["WAR", "SPAR"])
    priced = facts.withColumn("bucket", F.when(F.col("PosBucket") == "D", "D").otherwise("F")).withColumns({"cap": cap, "least": least})
    for metric in ("WAR", "SPAR"):
        r = rates.where(F.col("metric") == metric)
        own = r.where("bucket <> 'ALL'").select("year", "bucket", F.col("rate").alias(f"rate_{metric}"))
        whole = r.where("bucket = 'ALL'").select("year", F.col("rate").alias("_all"))
        priced = priced.join(F.broadcast(own), ["year", "bucket"], "left").join(F.broadcast(whole), "year", "left").withColumn(f"rate_{metric}", F.coalesce(f"rate_{metric}", "_all")).drop("_all")
        priced = priced.withColumn(f"usd_{metric}", numeric.price(F.col(metric), F.col(f"rate_{metric}"), F.col("cap"), F.col("least"))).withColumn(f"pct_{metric}", 100 * F.col(f"usd_{metric}") / F.col("cap"))
    return rates, priced


# ---- projection and comparables -------------------------------------------------------------------------------------


def project_contracts(contracts: DataFrame, bank: DataFrame, curve: DataFrame, horizon: int = 9) -> DataFrame:
    """3.3, A6: contracts with their base value, the projected values of the years after with their low and high band, and
    sums by term. ``curve``: pos, age, avg, lower, upper."""
    steps = None
    for name, column in zip(numeric.BANDS, ("avg", "lower", "upper"), strict=True):
        one = ranks.adjacent_ratio(curve.where("avg is not null"), ["pos"], "age", column).select("pos", "age", F.col("ratio").alias(name), F.col("tail_ratio").alias(f"tail_{name}"))
        steps = one if steps is None else steps.join(one, ["pos", "age"])
    ratio = F.struct(F.col("age").cast("int").alias("key"), F.struct(*[F.col(b) for b in numeric.BANDS]).alias("value"))
    tails = F.struct(*[F.coalesce(F.max(f"tail_{b}"), F.max("tail_m"), F.lit(1.0)).alias(b) for b in numeric.BANDS])
    tables = steps.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.when(F.col("m").isNotNull(), ratio))).alias("ratios"), tails.alias("tails"))
    last = joins.latest_before(contracts.select("contract_id", "playerId", "start_year"), bank.select("playerId", F.col("start_year").alias("stats_year"), "GAR_total"), "playerId", "start_year", "stats_year", 3, ["contract_id"])
    pick = [F.max(F.when(F.col("recency") == i, F.col("GAR_total"))) for i in (1, 2, 3)]
    base = last.groupBy("contract_id").agg(numeric.blend(pick, fixed.PROJECTION_BLEND).alias("base"))
    out = contracts.join(base, "contract_id", "left").withColumn("pos", F.when(F.col("PosBucket") == "D", "D").otherwise("F")).join(sinks.small(tables), "pos", "left")
    out = out.withColumn("_bands", F.when(F.col("base").isNotNull() & F.col("ratios").isNotNull(), numeric.project_bands(F.col("base"), F.col("age"), F.col("ratios"), F.col("tails"), horizon)))
    out = out.withColumns({"projection": F.col("_bands.m"), "projection_low": F.col("_bands.lo"), "projection_high": F.col("_bands.hi")})
    return out.withColumn("term_values", numeric.cumulative(F.col("projection"), 8)).drop("ratios", "tails", "pos", "_bands")


def predict_terms(train: DataFrame, targets: DataFrame, blocks: Mapping[str, Sequence[str]], features: Sequence[str], k: int = 100, terms: Sequence[int] = tuple(range(1, 9))) -> DataFrame:
    """3.3, A7: for each target and term the neighbours' weighted share of the cap, the ridge model's, and the blend."""
    fitted = comps.fit_blocks(train, blocks)
    pool, asked = comps.with_blocks(train, fitted), comps.with_blocks(targets, fitted)
    near = comps.nearest(asked, pool, "contract_id", "contract_id", "PosBucket", comps.block_metrics(fitted), k)
    rows = near.select(F.col("t_contract_id").alias("contract_id"), F.col("c_length").alias("term"), F.col("c_cap_pct").alias("v"), "weight")
    knn = comps.term_statistics(rows, "contract_id", "term", "v")
    out = None
    for term in terms:
        model = models.ridge_fit(train.where(F.col("length") == term), features, "cap_pct")
        one = models.predict_linear(targets, model, "model").select("contract_id", F.lit(term).alias("term"), "model")
        out = one if out is None else out.unionByName(one)
    both = out.join(knn, ["contract_id", "term"], "left").withColumn("w_model", comps.blend_weight(F.col("n"), F.col("iqr")))
    return both.withColumn("prediction", comps.blended(F.col("knn"), F.col("model"), F.col("w_model")))


def comparables(train: DataFrame, targets: DataFrame, blocks: Mapping[str, Sequence[str]], k: int = 100) -> DataFrame:
    """The five nearest other players of each target, side by side."""
    fitted = comps.fit_blocks(train, blocks)
    near = comps.nearest(comps.with_blocks(targets, fitted), comps.with_blocks(train, fitted), "contract_id", "contract_id", "PosBucket", comps.block_metrics(fitted), k)
    best = comps.top_comps(near, "t_contract_id", "c_playerId", own="t_playerId")
    return comps.wide_comps(best, "t_contract_id", ["c_playerId", "weight", "dist", "sim_pct"])


def error_breakdowns(evaluated: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """G13, R12."""
    means = stats.grouping_sets(evaluated, dimensions, [F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("MAE_cap_pct")])
    medians = stats.grouping_set_quantiles(evaluated, dimensions, "abs_error", {"median_abs_error": 0.5})
    return joins.null_safe(means, medians, ["group_by", *dimensions], "left")


def training_rows(contracts: DataFrame, bank: DataFrame) -> DataFrame:
    """Contracts with the season before's figures (of several rows the one of most time) and demographics
    filled from the player's latest row that has them."""
    lagged = ranks.keep_first(bank, ["playerId", "start_year"], [F.col("TOI_all").desc(), F.col("Team")]).withColumn("start_year", F.col("start_year") + 1)
    out = joins.left_join_new_cols(contracts.where(F.coalesce("level", F.lit("")) != "ELC"), lagged, ["playerId", "start_year"])
    w = Window.partitionBy("playerId").orderBy("start_year", "contract_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumns({c: F.coalesce(c, F.last(c, ignorenulls=True).over(w)) for c in ("height", "weight", "shot_num") if c in out.columns})


def what_if_rows(contracts: DataFrame, expiring: DataFrame, season: int) -> DataFrame:
    """Players without an expiring contract as if they signed now: their latest row, aged to the season; rows
    that do expire come first."""
    latest = ranks.keep_first(contracts, ["playerId"], [F.col("start_year").desc(), F.col("contract_id")])
    asked = latest.join(expiring.select("playerId"), "playerId", "left_anti").withColumn("age", F.col("age") + (season - F.col("start_year"))).withColumn("start_year", F.lit(season))
    both = expiring.withColumn("kind", F.lit("E")).unionByName(asked.withColumn("kind", F.lit("W")), allowMissingColumns=True)
    return ranks.keep_first(both, ["playerId"], [F.col("kind"), F.col("contract_id")])


# ---- dashboard ------------------------------------------------------------------------------------------------------


def dashboard_master(skaters: DataFrame, contracts: DataFrame, teams: DataFrame) -> DataFrame:
    """D1."""
    latest = ranks.keep_first(contracts, ["playerId"], [F.col("start_year").desc(), F.col("contract_id")])
    return joins.left_join_suffixed(joins.left_join_new_cols(skaters, teams, ["playerId"]), latest, ["playerId"], "_contract")


def player_list(master: DataFrame) -> DataFrame:
    """D2."""
    rows = master.withColumn("Player", F.trim("Player")).where("Player <> ''")
    return ranks.keep_first(rows, ["playerId"], [F.col("start_year").desc()]).select("playerId", "Player").orderBy("Player", "playerId")


def player_row(master: DataFrame, player: int) -> DataFrame:
    """D3: a point lookup; the filter reaches the scan."""
    return master.where(F.col("playerId") == player)


def value_history(priced: DataFrame, player: int, metric: str = "SPAR", as_share: bool = False) -> DataFrame:
    """D4."""
    usd = F.col(f"usd_{metric}")
    return player_row(priced, player).select("year", (100 * usd / value.cap_of(F.col("year")) if as_share else usd).alias("value")).orderBy("year")


def projected_values(projected: DataFrame, as_share: bool = False) -> DataFrame:
    """Projected goals to points to dollars, above a floor, by year; growth of the cap is rounded each year."""
    d = fixed.DASHBOARD
    rows = projected.select("contract_id", "playerId", "start_year", F.posexplode("projection").alias("i", "gar"))
    usd = F.greatest(F.lit(d["floor"]), F.col("gar") / d["gar_per_spar"] * d["usd_per_spar"])
    year = F.col("start_year") + F.col("i")
    return rows.select("contract_id", "playerId", (F.col("i") + 1).alias("k"), year.alias("year"), (100 * usd / value.cap_of(year) if as_share else usd).alias("value"))


def surplus(values: DataFrame, contracts: DataFrame) -> DataFrame:
    """D6."""
    rows = values.join(contracts.select("contract_id", "length", "aav"), "contract_id").where(F.col("k") <= F.col("length"))
    return rows.groupBy("contract_id").agg(F.sum(F.col("value") - F.col("aav")).alias("surplus"))


def season_markers(master: DataFrame, label: str) -> DataFrame:
    """Rows of the seasons two before, one before and of the label."""
    wanted: Column = F.array(*[text.shift_season(F.lit(label), -i) for i in (2, 1, 0)])
    return master.withColumn("marker", F.array_position(wanted, F.col("season"))).where("marker > 0").withColumn("marker", F.element_at(F.array(*[F.lit(x) for x in ("S-2", "S-1", "S")]), F.col("marker").cast("int")))
