"""Joins: attach, upsert, tolerance, interval, as-of, lookup chains, lags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import ranks
from tallyforge.sources import sinks


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; keys of both sides become one column."""
    marked = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    out = left.join(marked, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.withColumns({k: F.coalesce(k, f"{k}__r") for k in keys}).drop(*[f"{k}__r" for k in keys])


def left_join_new_cols(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that brings only columns the left side lacks."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), list(keys), "left")


def left_join_suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Left join in which right columns that clash get a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), list(keys), "left")


def pair_sides(df: DataFrame, key: str, side: str, values: Mapping[str, str], columns: Sequence[str], marks: tuple[str, str] = ("home", "away")) -> DataFrame:
    """Home and away rows of a key side by side, by one aggregation and no self-join; keys with one side fall away."""
    picks = [F.max(F.when(F.col(side) == values[m], F.col(c))).alias(f"{m}_{c}") for m in marks for c in columns]
    both = [F.count(F.when(F.col(side) == values[m], 1)).alias(f"_{m}") for m in marks]
    return df.groupBy(key).agg(*picks, *both).where(" and ".join(f"_{m} > 0" for m in marks)).drop(*[f"_{m}" for m in marks])


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on keys that may be null; of columns on both sides the new value if there is one."""
    shared = [c for c in new.columns if c in old.columns and c not in keys]
    fresh = new.withColumnsRenamed({c: f"{c}__new" for c in shared})
    out = null_safe(old, fresh, keys, "full_outer")
    return out.withColumns({c: F.coalesce(f"{c}__new", c) for c in shared}).drop(*[f"{c}__new" for c in shared])


def fill_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fills nulls of the left side's columns from the right side's."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    out = left.join(right.withColumnsRenamed({c: f"{c}__fill" for c in shared}), list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"{c}__fill") for c in shared}).drop(*[f"{c}__fill" for c in shared])


def outer_facts(facts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Several fact tables, full outer, null-safe, their columns marked by name. One grouped union: no chain of
    outer joins, one shuffle. A key that repeats within a table is an error, raised when the first fact is read."""
    parts = []
    names = [f"{c}_{name}" for name, df in facts.items() for c in df.columns if c not in keys]
    for name, df in facts.items():
        own = {c: f"{c}_{name}" for c in df.columns if c not in keys}
        parts.append(df.withColumnsRenamed(own).withColumn("_fact", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    once = F.greatest(*[F.count(F.when(F.col("_fact") == name, 1)) for name in facts], F.lit(0)) <= 1
    first = F.when(once, F.max(names[0])).otherwise(F.raise_error(F.lit(f"a key of {', '.join(keys)} repeats within a table")))
    return out.groupBy(*keys).agg(first.alias(names[0]), *[F.max(n).alias(n) for n in names[1:]])


def tolerant_date_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, row: Sequence[str], tol: int = 1, order: Sequence[Column] = ()) -> DataFrame:
    """For each left row (named by ``row``) the right row of equal keys with the nearest date within ``tol`` days:
    the same day first, then the day before, then the day after. The tolerance is an equi-join on the day. Of the right
    rows that a day's rows could take, only the first in order can be theirs: a day of a key has one row before the
    join, so dense keys pair nothing more than once. ``order`` is of right columns."""
    days = F.explode(F.array(*[F.lit(d) for d in sorted(range(-tol, tol + 1), key=lambda d: (abs(d), d))]))
    dated = right.withColumn("_date", F.col(right_date).cast("date")).where("_date is not null")
    # the first of a date (found in part before the shuffle), then the first of the days that it may serve
    dated = ranks.keep_first(dated, [*keys, "_date"], list(order) or [F.lit(0)])
    served = dated.withColumn("_offset", days).withColumn("_day", F.date_sub(F.col("_date"), F.col("_offset"))).drop("_date")
    served = ranks.keep_first(served, [*keys, "_day"], [F.abs("_offset"), F.col("_offset")])
    out = left.withColumn("_day", F.col(left_date).cast("date")).join(served, [*keys, "_day"])
    out = ranks.keep_first(out, row, [F.abs("_offset"), F.col("_offset"), *order])
    return out.drop("_day").withColumnRenamed("_offset", "day_offset")


def dyadic_nodes(low: Column, high: Column) -> Column:
    """The nodes (level, node) that tile the whole numbers from ``low`` to under ``high``: node n of level l stands for the
    2**l numbers from n·2**l on. There are two for each binary digit of the length at most."""
    start = F.struct(low.cast("long").alias("l"), high.cast("long").alias("h"), F.array().cast("array<struct<level:int,node:long>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        open_ = acc["l"] < acc["h"]
        left, right = open_ & (acc["l"] % 2 != 0), open_ & (acc["h"] % 2 != 0)
        node = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("node")))
        none = F.array().cast("array<struct<level:int,node:long>>")
        up = acc["l"] + F.when(left, 1).otherwise(0)
        more = F.concat(F.when(left, node(acc["l"])).otherwise(none), F.when(right & (up < acc["h"]), node(acc["h"] - 1)).otherwise(none))
        return F.struct(F.shiftright(up, 1).alias("l"), F.shiftright(acc["h"] - F.when(right, 1).otherwise(0), 1).alias("h"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(1)).cast("double"))), F.lit(0)).cast("int") + 1), start, step, lambda acc: acc["out"])


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, stop: str, left_open: bool = False, bin_size: float | None = None, how: str = "inner", unit: float | None = None) -> DataFrame:
    """Points with start <= at < stop, or start < at <= stop; ``keys`` may be empty where there is a
    ``bin_size`` or ``unit``.

    With ``bin_size`` both sides are also joined on a bin of the axis, which keeps long keys from pairing every point with
    every interval; an interval stands for each bin that it crosses. With ``unit`` the axis is cut into steps of that
    size and an interval stands for the dyadic nodes that tile it, two for each binary digit of its length, and a point
    for one node of each level that some interval uses: so lengths of any spread do, and neither side is multiplied by
    more than a logarithm."""
    if unit is not None:
        step = lambda c: F.floor(F.col(c) / unit).cast("long")
        intervals = intervals.where(F.col(start) <= F.col(stop)).withColumn("_node", F.explode(dyadic_nodes(step(start), step(stop) + 1)))
        intervals = sinks.cut(intervals.select("*", F.col("_node.level").alias("_level"), F.col("_node.node").alias("_bin")).drop("_node"))
        levels = sorted(r[0] for r in intervals.select("_level").distinct().collect())  # one for each binary digit
        points = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", F.expr(f"shiftright(cast(floor(`{at}` / {unit!r}D) as bigint), _level)"))
        keys = [*keys, "_level", "_bin"]
    elif bin_size is not None:
        bins = F.sequence(F.floor(F.col(start) / bin_size).cast("long"), F.floor(F.col(stop) / bin_size).cast("long"))
        intervals = intervals.where(F.col(start) <= F.col(stop)).withColumn("_bin", F.explode(bins))
        points = points.withColumn("_bin", F.floor(F.col(at) / bin_size).cast("long"))
        keys = [*keys, "_bin"]
    right = intervals.withColumnsRenamed({k: f"{k}__i" for k in keys})
    on = (F.col(start) < F.col(at)) & (F.col(at) <= F.col(stop)) if left_open else (F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}__i"))
    out = points.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"{k}__i" for k in keys], "_bin", "_level")


def sums_in_intervals(points: DataFrame, intervals: DataFrame, row: Sequence[str], at: str, start: str, stop: str, sums: Mapping[str, str | None], unit: float = 1.0) -> DataFrame:
    """J25 by sums, without keys: for each interval (named by ``row``) the sums over points with start <= at < stop; a sum
    of None counts points. Null where there is none.

    Points are added up by steps of ``unit``, and steps by dyadic nodes of the levels that intervals use. An interval adds
    the nodes that tile its whole steps, two for each binary digit of its length, and meets single points in the two
    steps at its ends alone. So no interval is paired with the points inside it."""
    step = lambda c: F.floor(F.col(c) / unit).cast("long")
    totals = lambda of: [F.sum(F.lit(1) if of[n] is None else F.col(of[n])).alias(n) for n in sums]
    asked = intervals.where(F.col(start) < F.col(stop)).select(*row, F.col(start).alias("_start"), F.col(stop).alias("_stop"))
    asked = asked.withColumns({"_a": step("_start"), "_b": step("_stop")})
    nodes = sinks.cut(asked.where(F.col("_a") + 1 < F.col("_b")).select(*row, F.inline(dyadic_nodes(F.col("_a") + 1, F.col("_b")))))
    levels = sorted(r[0] for r in nodes.select("level").distinct().collect())  # one for each binary digit
    steps = sinks.cut(points.where(F.col(at).isNotNull()).groupBy(step(at).alias("_step")).agg(*totals(sums)))
    held = None
    # a level's nodes are added up from those of the level below that was asked for
    below, depth = steps.withColumnRenamed("_step", "node"), 0
    for level in levels:
        below = sinks.cut(below.groupBy(F.shiftright("node", level - depth).alias("node")).agg(*totals({n: n for n in sums})))
        depth, one = level, below.withColumn("level", F.lit(level))
        held = one if held is None else held.unionByName(one)
    edges = asked.select(*row, "_start", "_stop", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_step"))
    single = points.select(F.col(at).alias("_at"), step(at).alias("_step"), *[(F.lit(1) if c is None else F.col(c)).alias(n) for n, c in sums.items()])
    found = points_in_steps(single, edges, list(sums)).select(*row, *sums)
    if held is not None:
        found = found.unionByName(nodes.join(held, ["level", "node"]).select(*row, *sums))
    return found.groupBy(*row).agg(*[F.sum(n).alias(n) for n in sums])


def points_in_steps(single: DataFrame, edges: DataFrame, sums: Sequence[str]) -> DataFrame:
    """For each edge (its interval's ``_start`` and ``_stop`` and a ``_step``) the sums over points of the step inside, by
    running sums of the step: at the last point before the stop less those before the start."""
    w = Window.partitionBy("_step").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [c for c in edges.columns if c not in ("_start", "_stop", "_step")]
    ends = F.inline(F.array(F.struct(F.col("_start").alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col("_stop").alias("_at"), F.lit(1).alias("_sign"))))
    # an end comes before the points at it: points at the start are inside, those at the stop are not
    line = edges.select("_step", F.struct(*own).alias("_own"), ends).withColumn("_side", F.lit(0))
    line = line.unionByName(single.groupBy("_step", "_at").agg(*[F.sum(n).alias(n) for n in sums]).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    run = line.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in sums}).where("_side = 0")
    return run.groupBy("_own").agg(*[F.sum(F.col(n) * F.col("_sign")).alias(n) for n in sums]).select("_own.*", *sums)


def attribute_points_to_intervals(intervals: DataFrame, points: DataFrame, keys: Sequence[str], row: Sequence[str], at: str, start: str, stop: str, value: str, team: str, point_team: str, bin_size: float | None = None) -> DataFrame:
    """For each interval row the sum and number of values at points inside, for its own team and against it."""
    inside = points_in_intervals(points, intervals, keys, at, start, stop, bin_size=bin_size)
    own = F.col(team) == F.col(point_team)
    # grouped by the keys too, by which the joined rows lie already
    named = list(dict.fromkeys([*keys, *row]))
    sums = inside.groupBy(*named).agg(
        F.coalesce(F.sum(F.when(own, F.col(value))), F.lit(0.0)).alias("value_for"), F.coalesce(F.sum(F.when(~own, F.col(value))), F.lit(0.0)).alias("value_against"),
        F.count(F.when(own, 1)).alias("n_for"), F.count(F.when(~own, 1)).alias("n_against"),
    )
    out = intervals.join(sums, named, "left")
    return out.fillna(0, ["value_for", "value_against", "n_for", "n_against"])


def _merged(intervals: DataFrame, keys: Sequence[str], start: str, stop: str, who: str) -> DataFrame:
    """Each owner's intervals as disjoint ones (keys, start, stop)."""
    w = Window.partitionBy(*keys, who).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.where(F.col(start) < F.col(stop)).withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, who, "_island").agg(F.min(start).alias("_start"), F.max(stop).alias("_stop"))


def active_counts_at(points: DataFrame, intervals: DataFrame, keys: Sequence[str], row: Sequence[str], at: str, start: str, stop: str, who: str, flag: Column | None = None, bin_size: float | None = None) -> DataFrame:
    """For each point the number of distinct owners of intervals that cover it, and whether the flag holds for one.

    Owners' intervals are merged; the count is then the starts up to the point less the stops up to it: running sums, so
    points and intervals are never paired. With ``bin_size`` the sums run within bins of the axis, to which the totals of
    the bins before are added, so that a long key is no single task."""
    def changes(rows: DataFrame, name: str) -> DataFrame:
        ends = F.inline(F.array(F.struct(F.col("_start").alias("_at"), F.lit(1).alias(name)), F.struct(F.col("_stop").alias("_at"), F.lit(-1).alias(name))))
        return _merged(rows, keys, start, stop, who).select(*keys, ends)

    moves = changes(intervals, "_n")
    moves = moves.unionByName(changes(intervals.where(flag), "_flagged"), allowMissingColumns=True) if flag is not None else moves.withColumn("_flagged", F.lit(0))
    moves = moves.groupBy(*keys, "_at").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("_flagged"), F.lit(0)).alias("_flagged"))
    place = lambda c: F.floor(F.col(c) / bin_size).cast("long") if bin_size else F.lit(0).cast("long")
    kind = points.select(F.struct(*points.columns).alias("_row")).schema["_row"].dataType
    asked = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_flagged"), F.struct(*points.columns).alias("_row"), place(at).alias("_bin"))
    both = asked.unionByName(moves.withColumn("_side", F.lit(0)).withColumn("_row", F.lit(None).cast(kind)).withColumn("_bin", place("_at")))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = both.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n0"), F.sum("_flagged").alias("_f0"))
    totals = totals.select(*keys, "_bin", F.coalesce(F.sum("_n0").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_f0").over(before), F.lit(0)).alias("_f0"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumns({"_n": F.sum("_n").over(inside), "_flagged": F.sum("_flagged").over(inside)}).where("_side = 1")
    out = null_safe(run, totals, [*keys, "_bin"], "left")
    return out.select("_row.*", (F.col("_n") + F.col("_n0")).alias("n_active"), (F.col("_flagged") + F.col("_f0") > 0).alias("any_flag"))


def active_set_at(points: DataFrame, intervals: DataFrame, keys: Sequence[str], row: Sequence[str], at: str, start: str, stop: str, who: str, bin_size: float = 1.0) -> DataFrame:
    """For each point the sorted set of owners of intervals that cover it, by a sweep.

    Each owner's intervals are merged. The set at the start of a bin of the axis is found once for each bin that holds a
    point; from there a point's set follows by the starts and stops inside the bin up to it. So points are never paired
    with the intervals that merely go on, and a bin with its changes is one task's work, whatever the key's size."""
    kind = f"array<{dict(intervals.dtypes)[who]}>"
    place = lambda c: F.floor(F.col(c) / bin_size).cast("long")
    merged = sinks.cut(_merged(intervals, keys, start, stop, who))
    asked = points.where(F.col(at).isNotNull()).select(*keys, F.struct(*row).alias("_row"), F.col(at).alias("_at"), place(at).alias("_bin"))
    bins = asked.select(*keys, "_bin").distinct().withColumn("_from", F.col("_bin") * F.lit(float(bin_size)))
    held = points_in_intervals(bins.withColumnRenamed("_bin", "_of"), merged, keys, "_from", "_start", "_stop", unit=float(bin_size))
    snapshots = held.groupBy(*keys, F.col("_of").alias("_bin")).agg(F.collect_set(who).alias("_held"))
    ends = F.inline(F.array(F.struct(F.col("_start").cast("double").alias("_at"), F.lit(1).alias("_d")), F.struct(F.col("_stop").cast("double").alias("_at"), F.lit(-1).alias("_d"))))
    moves = merged.select(*keys, F.col(who).alias("_who"), ends).withColumn("_bin", place("_at"))
    # what happens at the very start of a bin is in its snapshot
    moves = moves.where(F.col("_at") > F.col("_bin") * F.lit(float(bin_size)))
    none = F.lit(None).cast(dict(intervals.dtypes)[who])
    line = asked.select(*keys, "_bin", F.col("_at").cast("double").alias("_at"), F.lit(2).alias("_d"), none.alias("_who"), "_row")
    line = line.unionByName(moves.withColumn("_row", F.lit(None).cast(line.schema["_row"].dataType)))
    w = Window.partitionBy(*keys, "_bin").orderBy("_at", "_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = F.collect_list(F.when(F.col("_d") < 2, F.struct(F.col("_who").alias("o"), F.col("_d").alias("d")))).over(w)
    swept = null_safe(line.withColumn("_past", past).where("_d = 2"), snapshots, [*keys, "_bin"], "left")
    move = lambda acc, x: F.when(x["d"] > 0, F.array_union(acc, F.array(x["o"]))).otherwise(F.array_remove(acc, x["o"]))
    sets = swept.select("_row.*", F.sort_array(F.aggregate("_past", F.coalesce("_held", F.array().cast(kind)), move)).alias("active"))
    return points.join(sets, list(row), "left").withColumn("active", F.coalesce("active", F.array().cast(kind)))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, columns: Sequence[str], tie: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """For each left row the last right row of equal keys at or before it; nulls where there is none.

    One union and one window carry the last values forward: one sort, no pairs. ``tie`` orders right rows of one time."""
    lk = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{right.schema[c].dataType.simpleString()}" for c in columns) + ">").alias("_value"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_t{i}") for i, t in enumerate(tie)])
    rk = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(lk.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_value"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)])
    order = Window.partitionBy(*keys).orderBy("_at", "_side", *[f"_t{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lk.unionByName(rk).withColumn("_last", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_row.*", *[F.col(f"_last.{c}").alias(f"{prefix}{c}") for c in columns])


def keep_unless(df: DataFrame, column: str, excluded: object) -> DataFrame:
    """rows whose value is not the excluded one; null is not it, and stays."""
    return df.where(~F.col(column).eqNullSafe(F.lit(excluded)))


def both_sides(df: DataFrame, sides: Mapping[str, str], other: str = "opponent", own: str = "team", mark: str = "home_or_away") -> DataFrame:
    """A row with two teams as two rows, one seen from each. ``sides`` names the side of each team's column."""
    a, b = sides
    rest = [c for c in df.columns if c not in sides]
    view = lambda x, y: F.struct(F.col(x).alias(own), F.col(y).alias(other), F.lit(sides[x]).alias(mark))
    return df.select(*rest, F.inline(F.array(view(a, b), view(b, a))))


def drop_baseline(df: DataFrame, keys: Sequence[str], detail: str) -> DataFrame:
    """Rows without detail fall away where their key has a row with it."""
    some = F.max(F.col(detail).isNotNull()).over(Window.partitionBy(*keys))
    return df.withColumn("_some", some).where(F.col(detail).isNotNull() | ~F.col("_some")).drop("_some")


def lookup_chain(df: DataFrame, steps: Sequence[tuple[DataFrame, Sequence[str]]], value: str, order: Sequence[str], out: str) -> DataFrame:
    """A value from the first lookup that has one. Each step is (table, keys); of a key's rows the first by ``order`` counts."""
    found = []
    for i, (table, keys) in enumerate(steps):
        first = table.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(f"_v{i}"))
        df = df.join(first, list(keys), "left")
        found.append(f"_v{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def latest_before(left: DataFrame, right: DataFrame, key: str, left_year: str, right_year: str, k: int, row: Sequence[str], tie: Sequence[Column] = (), exact_lag: int | None = None) -> DataFrame:
    """For each left row up to ``k`` right rows of its key from earlier years, latest first, numbered
    ``recency``; with ``exact_lag`` only those of that many years before."""
    dim = right.withColumnRenamed(key, f"{key}__r")
    on = F.col(key) == F.col(f"{key}__r")
    on = on & ((F.col(right_year) == F.col(left_year) - exact_lag) if exact_lag else (F.col(right_year) < F.col(left_year)))
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(F.col(right_year).desc(), *tie))
    return left.join(dim, on).drop(f"{key}__r").withColumn("recency", rank).where(F.col("recency") <= k)
