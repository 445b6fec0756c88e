"""File sources: seasons of CSV or parquet, globs, optional files, landed JSON."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge import schema as S

SEASON = r"(\d{4})-(\d{4})"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header; a schema is asked for where there is one, so that nothing is inferred from data. Headers lose a byte order mark (K7)."""
    reader = spark.read.options(header=True, mode="PERMISSIVE", **options)
    df = (reader.schema(schema) if schema else reader).csv(path if isinstance(path, str) else list(path))
    return S.rename(df, S.tidy_name) if schema is None else df


def with_sequence(df: DataFrame, name: str = "ingest_seq") -> DataFrame:
    """T5: where a row stood in its source: increasing along a file and from file to file; the tie-break of stable sorts."""
    return df.withColumn(name, F.monotonically_increasing_id())


def try_read(spark: SparkSession, path: str, schema: StructType, required: bool = False, format: str = "csv") -> DataFrame:
    """The file, or no rows of the schema where it is absent and not required."""
    try:
        reader = spark.read.format(format).schema(schema)
        return (reader.option("header", True) if format == "csv" else reader).load(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def read_seasons(spark: SparkSession, glob: str, schema: StructType | str | None = None, format: str = "csv", pattern: str = SEASON) -> DataFrame:
    """S3: many files at once, with the season that each one's name gives, or null."""
    reader = spark.read.format(format).option("header", True)
    df = (reader.schema(schema) if schema else reader).load(glob)
    label = F.regexp_extract(F.col("_metadata.file_name"), pattern, 0)
    return df.withColumn("season", F.nullif(label, F.lit("")))


def season_partitions(spark: SparkSession, root: str, first: int, last: int, schema: StructType | str | None = None) -> DataFrame:
    """One read of a table partitioned by ``season``, pruned to those that start in [first, last]."""
    reader = spark.read.schema(schema) if schema else spark.read
    start = F.substring("season", 1, 4).try_cast("int")
    return reader.parquet(root).where(start.between(first, last))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested records to columns with dotted names."""
    def leaves(kind: StructType, path: tuple[str, ...]) -> Iterable[tuple[Column, str]]:
        for f in kind:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                at = (*path, f.name)
                yield F.col(".".join(f"`{p}`" for p in at)), sep.join(at)

    return df.select(*[c.alias(n) for c, n in leaves(df.schema, ())])


def explode_alternatives(df: DataFrame, text: str, paths: Sequence[str], fields: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the first JSON array among ``paths`` that is there; each field is the first of its paths that is
    there and not blank. ``paths`` and the fields' paths are JSON paths ("$.plays", "$.details.x")."""
    arrays = F.coalesce(*[F.get_json_object(F.col(text), p) for p in paths])
    items = F.from_json(arrays, "array<string>", {"mode": "PERMISSIVE"})
    rows = df.select(*keep, F.posexplode(items).alias("item_seq", "item"))
    first = {n: F.coalesce(*[F.nullif(F.trim(F.get_json_object("item", p)), F.lit("")) for p in ps]) for n, ps in fields.items()}
    return rows.select(*keep, "item_seq", *[c.alias(n) for n, c in first.items()])


def variant_fields(df: DataFrame, text: str, fields: Mapping[str, tuple[str, Sequence[str]]], malformed: str = "is_malformed") -> DataFrame:
    """Typed columns from a JSON text that is parsed once, as a VARIANT. A field is (type, alternative paths): the
    first path that is there and not blank and casts to the type. Texts that are no JSON are marked in ``malformed``;
    their fields, and those of null texts, are null."""
    parsed = df.withColumn("_v", F.try_parse_json(F.col(text)))
    own = {n: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("_v", p, "string")), F.lit("")).try_cast(kind) if kind != "variant" else F.try_variant_get("_v", p, kind) for p in paths]) for n, (kind, paths) in fields.items()}
    return parsed.withColumns(own | {malformed: F.col(text).isNotNull() & F.col("_v").isNull()}).drop("_v")


def explode_variant(df: DataFrame, text: str, paths: Sequence[str], fields: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """As ``explode_alternatives``, from a VARIANT: the text is parsed once, and an item's fields are read from it by
    path without parsing the item again. Malformed texts give no rows; ``set_aside`` has them."""
    arrays = F.coalesce(*[F.try_variant_get("_v", p, "array<variant>") for p in paths])
    rows = df.withColumn("_v", F.try_parse_json(F.col(text))).select(*keep, F.posexplode(arrays).alias("item_seq", "_item"))
    first = {n: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("_item", p, "string")), F.lit("")) for p in ps]) for n, ps in fields.items()}
    return rows.select(*keep, "item_seq", *[c.alias(n) for n, c in first.items()])


def set_aside(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """K5: (rows whose text is JSON or null, rows whose text is malformed)."""
    bad = F.col(text).isNotNull() & F.try_parse_json(F.col(text)).isNull()
    return df.where(~bad), df.where(bad)


def pad_ragged(df: DataFrame, cells: str, width: int) -> DataFrame:
    """Rows of scraped cells cut or filled with nulls to a width."""
    nulls = F.array_repeat(F.lit(None).cast("string"), width)
    return df.withColumn(cells, F.slice(F.concat(F.col(cells), nulls), 1, width))


def constants(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence[object]], schema: str | None = None) -> DataFrame:
    """An inline relation."""
    return spark.createDataFrame([tuple(r) for r in rows], schema or list(columns))


def lookup(column: Column, table: Mapping[object, object], default: Column | None = None) -> Column:
    """An inline map; small by construction, so it stays a literal of the plan."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, default)


def series(spark: SparkSession, first: int, last: int, name: str = "k") -> DataFrame:
    """Whole numbers from first to last."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def season_label(year: Column) -> Column:
    """The label of the season that starts in a year."""
    return F.concat_ws("-", year.cast("int"), (year + 1).cast("int"))


def season_of_file(name: str) -> str | None:
    """The season in a file or folder name."""
    found = re.search(SEASON, name)
    return found[0] if found else None
