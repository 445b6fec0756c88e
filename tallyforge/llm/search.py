"""Ranked lexical search: postings as a term-bucketed table, joined with the items' terms, scored in integers, summed by
item and document, the best of each item by a window.

Frequent terms would pair almost every item with almost every document.  Exact bounds spare that: what the rarest terms
give some documents is a score that the last wanted document reaches; terms whose greatest scores together stay below it
cannot lift a document that holds no other term of the item, so postings are joined for the other terms only, and of the
pairs found those that cannot reach it any more are left before their whole score is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

TOP = 10
#: Fixed values of the scoring contract: the scale of a term's weight, of its occurrences' share, and the parts of a document's length.
WEIGHT, SHARE, TIMES, FLAT, SLOPE, FLOOR = 1000, 1_000_000_000, 1000, 8, 90, 100
BLOCK_TERMS = 200_000  # distinct terms of items that are sought in one pass over the documents
BUCKET_ROWS = 20_000  # postings of one term that share a bucket
LEADS = 100  # the rarest terms of an item are looked up first until so many documents for each wanted one hold them
FEW = 500_000  # rows up to which a side is sent to every task

_between = np.ones(256, bool)  # bytes that stand between terms: all of ASCII but digits and letters
_between[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item's whole text. Items of one id are one item."""
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    return items.select(F.col(item_col).alias("item"), F.explode(F.split(lowered, BETWEEN)).alias("term")).where("term <> ''").distinct()


def _forward(vocabulary: pa.Array):
    """Batches (id, text) to (id, n, term numbers, occurrences): the terms of the vocabulary, which is in byte order."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, block in V.blocks(batch.column(1)):
            n = hi - lo
            low = V.Block(_lower[block.data], block.start, block.stop)
            start, stop, doc = low.words(_between)
            edges = np.empty(2 * len(start), np.int32)
            edges[::2], edges[1::2] = start, stop
            pieces = pa.Array.from_buffers(pa.binary(), max(2 * len(start) - 1, 0), [None, pa.py_buffer(edges), pa.py_buffer(low.data)])
            code = np.asarray(pc.fill_null(pc.index_in(pieces, vocabulary), -1))[::2].astype(np.int64)
            known = code >= 0
            key, times = np.unique(doc[known] * len(vocabulary) + code[known], return_counts=True)
            edge = np.searchsorted(key, np.arange(n + 1) * len(vocabulary)).astype(np.int32)
            yield R.record(
                id=batch.column(0).slice(lo, n), n=V.per_doc(doc, n), terms=pa.ListArray.from_arrays(edge, pa.array((key % max(len(vocabulary), 1)).astype(np.int32))),
                times=pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32))),
            )

    return run


def _hint(df: DataFrame) -> DataFrame:
    """Send a counted, small side to every task."""
    return F.broadcast(df) if df.count() <= FEW else df


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that are not negative."""
    return F.call_function("div", a, b)


def share(times: Column, m: Column) -> Column:
    """What a term's occurrences are worth in a document, before its weight."""
    return _div(times.cast("long") * SHARE, times.cast("long") * TIMES + m * FLAT)


class Index:
    """The documents' occurrences of some terms: a row for each document, and postings, a row for each document and term."""

    def __init__(self, scratch: R.Scratch, docs: DataFrame, terms: list[str]):
        spark = docs.sparkSession
        kind = docs.schema["id"].dataType.simpleString()
        found = R.map_arrow(docs, _forward(pa.array([t.encode() for t in terms], pa.binary())), f"id {kind}, n long, terms array<int>, times array<int>")
        rows = scratch.stored(found.withColumn("row", F.monotonically_increasing_id()), "forward")
        self.documents, words = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # the product of a long text and a large corpus may need more than 64 bits
        product = (F.col("n") * SLOPE).cast("decimal(19,0)") * F.lit(self.documents).cast("decimal(19,0)")
        self.rows = rows.where("n > 0").withColumn("m", F.lit(FLOOR - SLOPE) + _div(product, F.lit(max(words, 1)).cast("decimal(19,0)")))
        stats = self.postings(self.rows).groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.max("share").alias("most"))
        weight = F.floor(F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1)) * WEIGHT).cast("long")
        names = spark.createDataFrame(list(enumerate(terms)), "code int, term string")
        #: term, its number, the documents that hold it, its weight, and the greatest score it gives; without those of no weight
        self.terms = R.cut(stats.join(names, "code").withColumn("weight", weight).where("weight > 0").withColumn("most", F.col("weight") * F.col("most")))

    @staticmethod
    def postings(rows: DataFrame) -> DataFrame:
        """(.., code, share): a row for each term of each document."""
        kept = [c for c in rows.columns if c not in ("terms", "times", "n", "m")]
        flat = rows.select(*kept, "m", F.explode(F.arrays_zip("terms", "times")).alias("x"))
        return flat.select(*kept, F.col("x.terms").alias("code"), share(F.col("x.times"), F.col("m")).alias("share"))

    def score(self, wanted: DataFrame) -> DataFrame:
        """(item, row, score): the sums of the terms ``wanted`` (item, code, weight, df) over all documents that hold one.

        Postings are dealt into buckets of one term, or of an equal part of a frequent one, and joined with the items
        that hold the term; an item meets a document once for each term that both hold."""
        sought = wanted.groupBy("code").agg(F.max("df").alias("df"))
        bucketed = self.postings(self.rows.drop("id")).join(_hint(sought), "code")
        part = F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / BUCKET_ROWS)).alias("part")
        bucketed = bucketed.select("code", part, "row", "share").repartition("code", "part")
        met = bucketed.join(_hint(wanted.select("item", "code", "weight")), "code")
        return met.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))

    def whole(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """(item, row, id, score): the whole scores of pairs (item, row) by all terms of the items."""
        met = self.postings(self.rows.join(_hint(pairs.select("item", "row")), "row"))
        met = met.join(_hint(terms.select("item", "code", "weight")), ["item", "code"])
        return met.groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(F.col("weight") * F.col("share")).alias("score"))


def _best(scores: DataFrame, order: list[Column], top: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), *order))).where(F.col("rank") <= top)


def _ranked(scratch: R.Scratch, docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """(item, rank, id, score) for the items of one block."""
    words = sorted((r[0] for r in pairs.select("term").distinct().collect()), key=str.encode)
    index = Index(scratch, docs, words)
    terms = R.cut(pairs.join(index.terms, "term").drop("term"))
    # the rarest terms lead to documents whose whole scores bound the last wanted score from below
    rarest = Window.partitionBy("item").orderBy("df", "code").rowsBetween(Window.unboundedPreceding, -1)
    leads = terms.withColumn("seen", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("seen") < LEADS * top)
    first = R.cut(_best(index.score(leads), [F.col("row")], top))
    bound = index.whole(first, terms).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound"))
    bound = R.cut(bound.select("item", F.when(F.col("n") >= top, F.col("bound")).otherwise(0).alias("bound")))
    # terms that together stay below it: no document can be wanted for them alone
    weakest = Window.partitionBy("item").orderBy("most", "code").rowsBetween(Window.unboundedPreceding, 0)
    rated = R.cut(terms.join(_hint(bound), "item").withColumn("idle", F.sum("most").over(weakest) < F.col("bound")))
    rest = bound.join(rated.where("idle").groupBy("item").agg(F.sum("most").alias("rest")), "item", "left").withColumn("rest", F.coalesce("rest", F.lit(0)))
    able = index.score(rated.where("not idle")).join(_hint(rest), "item").where(F.col("score") + F.col("rest") >= F.col("bound"))
    able = scratch.stored(able.select("item", "row"), "able")
    return _best(index.whole(able, terms), [F.col("id"), F.col("row")], top).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item id, rank, document id, score): the ``top`` documents of each item with a score above 0, ranks from 1, equal
    scores by ascending id, null first, and then in any order.

    Null and empty texts have no terms: such documents count for nothing and such items give no rows, nor does an empty
    table of either kind. Rows of one item id are one item with the terms of all; repeated documents rank one after the
    other. Very long texts are counted in the task that reads them, and only their occurrences of sought terms move.
    Other columns are ignored whatever their names. Items are taken in blocks of some ``BLOCK_TERMS`` terms, each block
    against all documents; frequent terms are dealt over many buckets, and sides are sent to every task when counted.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = []
    with R.Scratch(docs.sparkSession) as scratch:
        pairs = scratch.stored(item_terms(items, item_col, item_text), "items")
        blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
        for k in range(blocks):
            block = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
            found.append(R.stored(_ranked(scratch, rows, block, top), "ranked"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
