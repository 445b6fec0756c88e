"""Schemas and columns: conforming, aliasing, selecting, coercing, pruning by data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType


def require(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """The frame itself, if it has the columns."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks {', '.join(absent)}")
    return df


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order: absent ones null, others cast where they can be, else null."""
    have = set(df.columns)
    kind = {f.name: f.dataType for f in schema}
    return df.select(*[(F.col(f"`{n}`").try_cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in kind.items()])


def ensure(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add absent columns with a default."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Those of the wanted columns that are there, in the order asked for."""
    return df.select(*[c for c in wanted if c in df.columns])


def first_available(df: DataFrame, candidates: Iterable[str], alias: str, default: Column | None = None) -> DataFrame:
    """Alias the first candidate that is there; decided when the plan is built."""
    for c in candidates:
        if c in df.columns:
            return df.withColumn(alias, F.col(f"`{c}`"))
    if default is None:
        raise ValueError(f"none of {list(candidates)} for {alias}")
    return df.withColumn(alias, default)


def coalesce_candidates(df: DataFrame, candidates: Iterable[str], alias: str) -> DataFrame:
    """P4, by row: the first candidate that is there and not null."""
    some = [F.col(f"`{c}`") for c in candidates if c in df.columns]
    return df.withColumn(alias, F.coalesce(*some) if some else F.lit(None))


def rename(df: DataFrame, rule: Callable[[str], str] | Mapping[str, str]) -> DataFrame:
    """P5: rename by a function or a map; names that meet are kept apart by a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = rule(c) if callable(rule) else rule.get(c, c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def tidy_name(name: str) -> str:
    """P5: a header without a byte order mark, outer blanks and doubled blanks."""
    return re.sub(r"\s+", " ", name.replace("\ufeff", "").replace("\xa0", " ")).strip()


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """P6."""
    return [c for c in df.columns if c.startswith(prefix)]


def with_suffix(df: DataFrame, suffix: str) -> list[str]:
    """P6."""
    return [c for c in df.columns if c.endswith(suffix)]


def number(c: Column) -> Column:
    """A double from text with thousands marks and quotes; null where it is none, and for NaN."""
    x = F.regexp_replace(F.trim(c.cast("string")), "[',$%\\s]", "").try_cast("double")
    return F.when(~F.isnan(x), x)


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in set(but)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, once, at the scan."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def one_hot(df: DataFrame, column: str, categories: Iterable[object], prefix: str | None = None) -> DataFrame:
    """An indicator for each category, fixed by the caller (from the training rows alone)."""
    p = prefix or column
    return df.withColumns({f"{p}_{v}": (F.col(column).eqNullSafe(F.lit(v))).cast("double") for v in categories})


def categories(train: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct non-null values of a training column, sorted; refuses more than ``most``."""
    got = [r[0] for r in train.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(got)


def indicators(df: DataFrame, value: str, rules: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """P10: one integer flag for each named threshold."""
    return df.withColumns({name: F.coalesce(rule(F.col(value)).cast("int"), F.lit(0)) for name, rule in rules.items()})


def uninformative(df: DataFrame, keep: Iterable[str] = (), constants: bool = True) -> list[str]:
    """Columns that are null throughout, or hold one value; one aggregation over all columns. Minimum and maximum
    tell a constant from others without a distinct count, so nothing is expanded."""
    keep = set(keep)
    names = [f.name for f in df.schema if f.name not in keep and f.dataType.simpleString().split("<")[0] not in ("map", "array", "struct")]
    if not names:
        return []
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)], *[F.min(F.col(f"`{c}`")).eqNullSafe(F.max(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(names)], F.count(F.lit(1)).alias("n")).first()
    return [c for i, c in enumerate(names) if not row[f"n{i}"] or (constants and row[f"s{i}"] and row[f"n{i}"] == row["n"])]


def drop_uninformative(df: DataFrame, keep: Iterable[str] = (), constants: bool = True) -> DataFrame:
    """P14, P15."""
    return df.drop(*uninformative(df, keep, constants))


def drop_empty(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Neither columns nor rows that are null throughout."""
    return drop_uninformative(df, keep, constants=False).na.drop(how="all")
