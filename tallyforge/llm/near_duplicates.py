"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

A shingle is five words; its weight is its count in the text times the mean inverse document frequency of its words,
idf = 1 + ln((N + 1) / (df + 1)) / ln(N + 1), where df is counted over all documents in a fixed number of word buckets.
Taking idf from words and not from whole shingles keeps the weight of a passage independent of how often it was copied,
so that a large group of copies does not drift apart.

A sample of the weighted set draws (r, c, beta) for each element and takes the element of least
ln c - r (t - beta + 1), t = floor(ln w / r + beta).  Each of the three is drawn by its own bits of the element's hash
for the sample, so elements are independent and weights of any size keep their share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _similar as S
from tallyforge.llm import _vec as V

SHINGLE = 5
SIMILARITY = 0.8
MOST, MOST_BYTES = 256, 4 << 20
BANDS, ROWS = 16, 5
LOG2_WORDS = 18
LOG2_DRAWS = 16


def _words_of(block: V.Block) -> tuple[np.ndarray, np.ndarray]:
    start, stop, doc = block.words()
    return block.hashes(start, stop), doc


def _weighted(block: V.Block, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 52-bit shingle hash, weight), sorted, each shingle of a document once."""
    n = len(block)
    word, doc = _words_of(block)
    key, owner, at = V.shingles(doc, word, SHINGLE, n)
    run = np.zeros(len(word) + 1)
    np.cumsum(idf[word >> V.U(64 - LOG2_WORDS)], out=run[1:])
    last = np.minimum(at + SHINGLE, V.bounds(doc, n)[1][owner]) if len(at) else at
    mean = (run[last] - run[at]) / np.maximum(last - at, 1)
    out: list[tuple] = []
    for lo in range(0, n, 4096):  # the document's number in 12 bits above the hash: one sort for many documents
        part = slice(*np.searchsorted(owner, [lo, lo + 4096]))
        both = ((owner[part] - lo).astype(np.uint64) << V.U(52)) | (key[part] >> V.U(12))
        found, first, count = np.unique(both, return_index=True, return_counts=True)
        out.append(((found >> V.U(52)).astype(np.int64) + lo, found & V.U((1 << 52) - 1), mean[part][first] * count))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))


@functools.cache
def _draws(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of r and of ln c to draw from. Single precision: samples only shape the bands."""
    rng = np.random.default_rng(seed)
    return rng.gamma(2, 1, 1 << LOG2_DRAWS).astype(np.float32), np.log(rng.gamma(2, 1, 1 << LOG2_DRAWS)).astype(np.float32)


def signatures(block: V.Block, idf: np.ndarray, samples: int, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, their samples)."""
    doc, key, weight = _weighted(block, idf)
    some = V.distinct(doc)
    out = np.zeros((len(some), samples), np.uint32)
    if len(some):
        first = np.searchsorted(doc, some)
        ln_w = np.log(weight).astype(np.float32)
        r_of, ln_c_of = _draws(seed)
        once_over_r = 1 / r_of
        lo, hi = ln_c_of.min() - r_of.max() - 24, ln_c_of.max()  # 24: above ln of the weight of any text
        scale, few = np.float32(((1 << 24) - 2) / (hi - lo)), np.uint32((1 << LOG2_DRAWS) - 1)
        turn = np.random.default_rng(seed).integers(0, 2**64, samples, dtype=np.uint64) | V.U(1)
        mixed = V.mix(key)
        for j in range(samples):
            x = mixed * turn[j]
            x ^= x >> V.U(32)
            x = x * V.U(0x9FB21C651E98DF25)
            pick, rest = (x >> V.U(64 - LOG2_DRAWS)).astype(np.intp), (x >> V.U(16)).astype(np.uint32)
            beta = (rest & few).astype(np.float32)
            beta *= np.float32(1 / (1 << LOG2_DRAWS))
            t = ln_w * once_over_r[pick]
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += np.float32(1)
            t *= r_of[pick]
            ln_a = ln_c_of[rest >> np.uint32(16)]
            ln_a -= t
            ln_a -= lo
            ln_a *= scale
            order = ln_a.astype(np.uint32)
            order <<= np.uint32(8)
            order |= (rest >> np.uint32(8)) & np.uint32(0xFF)
            out[:, j] = np.minimum.reduceat(order, first)
    return some, out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """idf of each word bucket, counted over all documents. Pre-aggregated by task; the driver gets a fixed number of rows."""
    R.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << LOG2_WORDS, np.int64)
        total = 0
        for batch in batches:
            for _, _, block in V.blocks(batch.column(0)):
                word, doc = _words_of(block)
                bucket = V.distinct((doc.astype(np.uint64) << V.U(LOG2_WORDS)) | (word >> V.U(64 - LOG2_WORDS))) & V.U((1 << LOG2_WORDS) - 1)
                seen += np.bincount(bucket.astype(np.int64), minlength=len(seen))
                total += len(block)
        some = np.flatnonzero(seen)
        yield R.record(bucket=np.append(some, -1), n=np.append(seen[some], total))

    got = docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(1 << LOG2_WORDS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    total = n[bucket < 0].sum()
    return 1 + np.log((total + 1) / (df + 1)) / np.log(total + 2)


def _node(text) -> F.Column:
    return F.xxhash64(text, F.length(text))


def links(docs: DataFrame, scratch: R.Scratch, text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(node, root) of texts that have a near duplicate; a node is a 64-bit hash of a text, equal texts are one node.

    Texts that share a band meet in groups of at most about ``most`` texts and ``most_bytes`` bytes, and every pair of a
    group is judged by its exact weighted Jaccard similarity."""
    idf = scratch.broadcast(document_frequencies(docs, text_col))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(_node(F.col("text")).alias("node"), "text")

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, seen = batch.column(0).to_numpy(), np.zeros(0, np.int64)
        for lo, hi, block in V.blocks(batch.column(1)):
            fresh = np.sort(np.unique(node[lo:hi], return_index=True)[1])
            fresh = fresh[~np.isin(node[lo:hi][fresh], seen)]
            seen = np.concatenate([seen, node[lo:hi][fresh]])
            block = block.only(fresh)
            some, signed = signatures(block, idf.value, bands * rows)
            if len(some):
                keys = V.signed(S.band_keys(signed, rows))
                yield R.record(node=node[lo:hi][fresh][some], size=(block.stop - block.start)[some].astype(np.int32), bands=R.lists(keys))

    signed = scratch.stored(R.map_arrow(texts, sign, "node long, size int, bands array<long>"), "signed")

    def held(nodes: DataFrame) -> DataFrame:
        bits = scratch.bits(nodes, "node")

        def wanted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            node = batch.column(0).to_numpy()
            ok = np.sort(np.unique(node, return_index=True)[1])
            yield batch.take(pa.array(ok[R.has_bit(bits.value, node[ok].view(np.uint64))]))

        return R.map_arrow(texts, wanted, "node long, text string").groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node", "left_semi")

    def elements(column: pa.Array) -> S.Elements:
        n, owner, element, weight = len(column), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
        for lo, _, block in V.blocks(column):
            doc, key, w = _weighted(block, idf.value)
            owner.append(doc + lo)
            element.append(key)
            weight.append(w)
        return np.searchsorted(np.concatenate(owner), np.arange(n + 1)), np.concatenate(element), np.concatenate(weight)

    return S.linked(signed, held, elements, similarity, scratch, most, most_bytes)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: id, ``class_id`` (the least id of its class), ``class_size`` and ``is_kept``.

    A class is a connected component of documents whose weighted shingle similarity is 0.8 or more; documents of equal
    text are in one class. A text of fewer than five words, but not none, is one shingle; null and empty texts are
    equal texts and have no shingles; rows of one id are rows of their own, a null id sorts after every other, and
    exactly one row of a class is kept (the least id, then by text hash, then any of equal rows). Other columns are
    ignored, whatever their names; an empty table gives an empty result. Texts of any length are read whole. Equal texts
    are one node from the start and links form no list of all pairs, so a class of any size costs in proportion to its
    rows.
    """
    with R.Scratch(docs.sparkSession) as scratch:
        found = links(docs, scratch, text_col, **options)
        rows = docs.select(F.col(id_col).alias("id"), _node(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
        equal = rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("copies")).join(found, "node", "left")
        equal = scratch.stored(equal.withColumn("root", F.coalesce("root", "node")), "rows")
        order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("node").alias("node"))
        sizes = equal.groupBy("root").agg(F.min(order).alias("best"), F.sum("copies").alias("class_size"))
        sizes = scratch.stored(sizes, "classes")  # on its own, so that the join below can split a root that many rows share
        out = equal.join(sizes, "root").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        first = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")) & (F.col("copy") == 1)
        return R.stored(out.select(F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "class_size", first.alias("is_kept"), "node"), "near-classes")
