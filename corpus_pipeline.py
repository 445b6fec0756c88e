"""The corpus pipeline: language, lines, near duplicates, benchmark passages, mix; each stage works on what the last kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import decontaminate, language, line_dedup, mixing, near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


KEYS = 500_000  # so many keys, of 8 bytes each, are sent to every task; more are joined by a shuffle


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text, and the name of its column, which none of theirs has."""
    key = R.unused(docs, "key_")
    return docs.withColumn(key, R.doc_key()), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The documents whose key is not among ``gone``, one column: texts stay where they are while the keys are few."""
    gone = R.cut(gone.toDF(key))
    return docs.join(F.broadcast(gone) if gone.count() <= KEYS else gone, key, "left_anti")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go, null and letterless texts among them.

    Rows equal in id and text share one fate; a null id is an id like others; where no row has a language to learn from,
    every document is rejected; very long texts are read whole and equal probabilities go to the first language by name;
    other columns keep their values, whatever their names; an empty table stays empty."""
    keyed, key = _keyed(docs)
    gone = language.identify(keyed, id_col=key, model=language.fit(keyed)).where("rejected").select(key).distinct()
    return _without(keyed, key, gone).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a similar, earlier line stands for; texts left without a word go. n_chars is renewed.

    Null and empty texts stay; of rows equal in id and text the first stays, as the others have no line of their own;
    a tie between lines goes to the least id and line number; very long texts are cut into lines a task at a time;
    other columns keep their values, whatever their names; an empty table stays empty."""
    out = line_dedup.rewrite(docs, line_dedup.decide(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; of rows equal in id and text one.

    Null and empty texts are one class; of a class the document of the least key of id and text stays, so no order of
    the rows and no tie matters; very long texts are compared whole; other columns keep their values, whatever their names; an empty table stays empty."""
    keyed, key = _keyed(docs)
    classes = R.cut(near_duplicates.classes(keyed, id_col=key).groupBy(key).agg(F.max(F.col("is_kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")))
    left = _without(keyed, key, classes.where("kept = 0").select(key))
    again = R.cut(classes.where("kept = 1 and n > 1").select(key))
    if again.isEmpty():
        return left.select(*docs.columns)
    # rows equal in id and text: only these are brought together
    few = F.broadcast(again) if again.count() <= KEYS else again
    once = left.join(few, key, "left_semi").dropDuplicates([key])
    return left.join(few, key, "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Null and empty texts have no words and stay; rows equal in id and text share one fate; a text of exactly a
    twentieth goes; very long texts are searched whole; other columns keep their values, whatever their names; an empty table of documents or of benchmark items takes nothing away."""
    keyed, key = _keyed(docs)
    found = decontaminate.decontaminate(docs, R.load(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select("key").distinct()
    return _without(keyed, key, gone).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0, a null source is one of its own, repeated rows and ties are rows like others, very
    long texts are counted whole, other columns
    are ignored, and an empty table gives no rows."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: No SQL has the language model, the sampled signatures or the components; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder and read again, and deleted
    once the next is there. What stays is the mix, with ids and numbers and no texts."""
    docs = R.load(spark, sf_dir, "documents")
    with R.Scratch(spark, owns=True) as scratch:
        for name, stage in STAGES[:-1]:
            kept = scratch.stored(stage(spark, docs, sf_dir), f"stage-{name}")
            scratch.drop(docs)
            docs = kept
        return R.stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}", owned=False)
