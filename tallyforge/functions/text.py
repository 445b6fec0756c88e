"""Text functions: clocks, names, blanks, money, heights, labels, records."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyforge.functions import fixed
from tallyforge.sources.files import lookup


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clock_seconds(c: Column) -> Column:
    """Seconds of mm:ss or hh:mm:ss; null where a part is no whole number."""
    parts = F.transform(F.split(F.trim(c.cast("string")), ":"), lambda x: F.trim(x).try_cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x)
    return F.when(F.size(parts).between(2, 3) & ~F.exists(parts, lambda x: x.isNull()), total)


def clock_or_number(c: Column) -> Column:
    """X1, third form: a clock, or a number that is passed through, as a double."""
    text = c.cast("string")
    return F.when(text.contains(":"), clock_seconds(text).cast("double")).otherwise(F.trim(text).try_cast("double"))


def column_seconds(df: DataFrame, column: str, out: str, share: float = 0.3) -> DataFrame:
    """A whole column is clocks where at least ``share`` of its values hold a colon, else minutes. One number is
    aggregated and joined back, as a row."""
    text = F.col(column).cast("string")
    kind = df.agg((F.avg(F.coalesce(text.contains(":"), F.lit(False)).cast("int")) >= share).alias("_clocks"))
    is_clock = F.coalesce("_clocks", F.lit(False))
    return df.crossJoin(F.broadcast(kind)).withColumn(out, F.when(is_clock, clock_seconds(text).cast("double")).otherwise(F.trim(text).try_cast("double") * 60)).drop("_clocks")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that it names several times and that is worked out once: the variable of a lambda, not a copy of
    the expression at each place, which would multiply from step to step."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def repair_mojibake(c: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, set right; other text unchanged."""
    latin = ~c.rlike(r"[^\x00-\xFF]")
    raw = F.when(latin, F.encode(c, "ISO-8859-1"))
    return F.when(latin & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(c)


@F.pandas_udf(StringType())
def _strip(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        return x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))

    return s.map(one)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, in Arrow batches; ASCII text passes as it is. The column
    is named once: Spark sends every row of a batch whatever condition stands around the function."""
    return _strip(c)


def clean_blanks(c: Column) -> Column:
    """No-break spaces and stray Â away, runs of white space to one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ Â]", " "), r"(?U)\s+", " "))


def canonical_name(c: Column, spellings: Mapping[str, str] | None = None) -> Column:
    """One spelling of a person's name: repaired, dashes and quotes plain, "Last, First" turned, accents and other
    punctuation away, lower case, known spellings mapped, suffixes dropped. Null becomes empty."""
    def turned(s: Column) -> Column:
        parts = F.transform(F.split(s, ","), lambda x: F.trim(x))
        both = F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 3, 100), " "))
        return F.when(s.contains(","), F.trim(F.regexp_replace(both, r"\s+", " "))).otherwise(s)

    def plain(s: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s\-']", " "), r"(?U)\s+", " ")))

    s = _once(c, repair_mojibake)
    s = F.regexp_replace(F.regexp_replace(s, "[–—−]", "-"), "[‘’]", "'")
    s = _once(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), turned)
    s = plain(strip_accents(s))
    known = fixed.NAME_SPELLINGS if spellings is None else spellings
    s = _once(s, lambda x: lookup(x, known, x)) if known else s
    ends = "|".join(fixed.NAME_SUFFIXES)
    return F.coalesce(F.regexp_replace(s, rf"(^|\s)(({ends})(\s+|$))+$", ""), F.lit(""))


def title_name(c: Column) -> Column:
    """Capitals after blanks, hyphens and apostrophes."""
    def capital(x: Column) -> Column:
        return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))

    def parts(x: Column, sep: str) -> Column:
        return F.array_join(F.transform(F.split(x, sep), lambda y: parts(y, "'") if sep == "-" else capital(y)), sep)

    return F.array_join(F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: parts(x, "-")), " ")


def first_last(c: Column) -> Column:
    """A struct of the first word and the rest."""
    parts = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ", 2)
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("last"))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def iso_date(c: Column) -> Column:
    """The first yyyy-mm-dd of a text as a date, or null."""
    return F.try_to_date(extract(c, r"(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")


def start_year(c: Column) -> Column:
    """The four digits at the front, else the text as a number."""
    text = F.trim(c.cast("string"))
    return F.coalesce(extract(text, r"^(\d{4})").try_cast("int"), text.try_cast("double").try_cast("int"))


def digits(c: Column) -> Column:
    """A number from the digits and points of a text."""
    return F.regexp_replace(c.cast("string"), "[^0-9.]", "").try_cast("double")


def first_int(c: Column) -> Column:
    """X10."""
    return extract(c.cast("string"), r"(\d+)").try_cast("bigint")


def has_year(c: Column) -> Column:
    """X10."""
    return F.coalesce(c.rlike(r"(19|20)\d{2}"), F.lit(False))


def money(c: Column) -> Column:
    """X11: dollars without sign and thousands marks, or null."""
    return F.regexp_replace(c.cast("string"), r"[$,\s]", "").try_cast("double")


def height_inches(c: Column) -> Column:
    """6'2" or 6-2 in inches, or null."""
    text, pattern = F.trim(c.cast("string")), r"^(\d+)\s*['-]?\s*(\d+)"
    return extract(text, pattern, 1).try_cast("double") * 12 + extract(text, pattern, 2).try_cast("double")


def shift_season(label: Column, by: Column | int) -> Column:
    """A season label ``by`` seasons later; labels of another form are unchanged."""
    year = extract(label, r"^(\d{4})-\d{2,4}$").try_cast("int") + by
    return F.coalesce(F.concat(year.cast("string"), F.lit("-"), (year + 1).cast("string")), label)


def season_of_date(d: Column) -> Column:
    """The season a date lies in; July begins one."""
    year = F.year(d) - (F.month(d) < 7).cast("int")
    return F.concat(year.cast("string"), F.lit("-"), (year + 1).cast("string"))


def position_bucket(c: Column) -> Column:
    """G, D or F from a position or list of positions; null for none."""
    p = F.upper(F.trim(c))
    return F.when(p.isNull() | (p == ""), None).when(p.contains("G"), "G").when(p.contains("D"), "D").otherwise("F")


def team_code(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """A team's three letters: as written, in capitals, or in capitals without dots; else null."""
    table = fixed.TEAM_CODES if table is None else table
    raw = clean_blanks(c)
    up, known = F.upper(raw), sorted(set(table.values()))
    bare = F.replace(up, F.lit("."), F.lit(""))
    return F.coalesce(lookup(raw, table), lookup(up, table), F.when(up.isin(known), up), lookup(bare, table), F.when(bare.isin(known), bare))


def clause_bucket(c: Column) -> Column:
    """X15."""
    t = F.upper(c)
    return F.when(blank_to_null(c).isNull(), "None").when(t.contains("NMC"), "NMC").when(t.contains("NTC"), "NTC").otherwise("Other")


def status_group(c: Column) -> Column:
    """X15."""
    return F.when(F.upper(c).contains("RFA"), "RFA").otherwise("UFA")


def contract_level(level: Column, age: Column) -> Column:
    """X15."""
    t = F.coalesce(F.upper(level), F.lit(""))
    old = F.coalesce(age.try_cast("double") >= 35, F.lit(False))
    return F.when(t.contains("ELC"), "ELC").when(t.contains("35") | old, "35_PLUS").otherwise("STD")


#: Upper ends of the age bands.
AGE_BANDS = ((21, "U22"), (24, "22-24"), (27, "25-27"), (30, "28-30"), (33, "31-33"), (36, "34-36"))


def bands(c: Column, limits, beyond: str, missing: str | None = None) -> Column:
    """The first label whose upper end is not below the value."""
    out = F.when(c.isNull(), F.lit(missing))
    for limit, label in limits:
        out = out.when(c <= limit, label)
    return out.otherwise(beyond)


def age_band(c: Column) -> Column:
    return bands(c, AGE_BANDS, "35+", "NA")


def role_bucket(pos: Column, games: Column, toi_per_game: Column, least_games: int = 15) -> Column:
    """The role by time on ice a game."""
    def of(p: str) -> Column:
        limits = [(limit, label) for label, limit in fixed.ROLE_LIMITS[p]]
        return bands(toi_per_game, limits, limits[-1][1], "Other")

    return F.when(games.isNull() | (games < least_games), "Other").when(pos == "D", of("D")).otherwise(of("F"))


def role_tier(pos: Column, role: Column) -> Column:
    """J19."""
    return F.when(pos == "F", lookup(role, fixed.ROLE_TIERS["F"], F.lit(0))).when(pos == "D", lookup(role, fixed.ROLE_TIERS["D"], F.lit(0))).otherwise(0)


def parse_ids(c: Column, sep: str = ";") -> Column:
    """Whole numbers of a joined list; others fall away."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())


def join_ids(c: Column, sep: str = ";") -> Column:
    """X29."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def record(c: Column) -> Column:
    """Wins, losses, overtime losses, points and games of W-L-OTL."""
    w, l, o = (extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*-\s*(\d+)", i).try_cast("int") for i in (1, 2, 3))
    return F.struct(w.alias("w"), l.alias("l"), o.alias("otl"), (2 * w + o).alias("pts"), (w + l + o).alias("gp"))


def contract_terms(df: DataFrame, kind: str, length: str, start: str, age: str, scrape_year: int, signing_year: str, cap_hit: str) -> DataFrame:
    """Structure, extension, start year (one later for extensions, and for eight years that are none), expiry,
    signing age and the share of the start year's cap."""
    from tallyforge.operators.value import cap_of

    t = F.upper(F.coalesce(F.col(kind), F.lit("")))
    out = df.withColumn("is_extension", t.contains("EXT")).withColumn("structure", F.when(t.contains("2-WAY") | t.contains("TWO"), "2-way").otherwise("1-way"))
    later = F.col("is_extension") | (F.col(length) == 8)
    out = out.withColumn("start_year", F.col(start) + later.cast("int")).withColumn("expiry_year", F.col("start_year") + F.col(length) - 1)
    out = out.withColumn("signing_age", F.greatest(F.lit(0), F.col(age) - (F.lit(scrape_year) - F.col(signing_year))))
    return out.withColumn("cap_pct", F.bround(100 * F.col(cap_hit) / cap_of(F.col("start_year")), 1))
