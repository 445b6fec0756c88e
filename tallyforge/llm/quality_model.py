"""Quality classifier by hierarchical empirical Bayes: document evidence under host and path priors.

The document classifier is a logistic regression on hashed presence features (words, stems, word shapes, repeated words),
chosen by chi-square and fitted on a bounded sample of labelled rows.  Its probabilities, averaged by path and by host,
are shrunk towards the level above with strengths found by the method of moments; the path's posterior is the prior
under which each document's own evidence is read.  Quality and toxicity are two such models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

LOG2 = 18
SHARES = (0.0, 0.1, 0.3)  # a feature counts as present above each of these shares of the words
STEM = 6  # bytes at the front of a longer word that make a feature of their own

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
#: Shape classes: small and capital letters, digits and bytes beyond ASCII fall together, other bytes stay.
_shape = np.arange(256, dtype=np.uint8)
_shape[0x61:0x7B], _shape[0x41:0x5B], _shape[0x30:0x3A], _shape[0x80:] = 1, 2, 3, 1
_mark = np.ones(256, bool)  # what parts plain words: every ASCII byte but letters and digits
_mark[0x61:0x7B] = _mark[0x41:0x5B] = _mark[0x30:0x3A] = _mark[0x80:] = False


def features(block: V.Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of everything present, each once, sorted."""
    n = len(block)
    start, stop, doc = block.words()
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = V.Block(_lower[block.data], block.start, block.stop)
    word = low.hashes(start, stop)
    plain_start, plain_stop, plain_doc = low.words(_mark)
    plain = low.hashes(plain_start, plain_stop)
    long = plain_stop - plain_start > STEM
    stem = low.hashes(plain_start[long], plain_start[long] + STEM) + V.U(3)
    shape = _shape[block.data]
    # a shape is what kinds of bytes a word holds and how it ends
    kinds = np.zeros(len(block.data) + 1, np.uint64)
    kinds[:-1] = V.U(1) << (shape.astype(np.uint64) & V.U(63))
    held = np.bitwise_or.reduceat(kinds, np.stack([start, stop], 1).reshape(-1))[::2]
    form = V.mix(held + shape[stop - 1].astype(np.uint64) * V.U(V.BASE) + V.U(7))
    same = np.zeros(len(word), np.uint64)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    size = np.bincount(doc, minlength=n)
    out = []
    for kind, (owner, key, shares) in enumerate(((plain_doc, plain, SHARES[:1]), (plain_doc[long], stem, SHARES[:1]), (doc, form, SHARES), (doc, V.mix(same + V.U(11)), SHARES))):
        both = (owner.astype(np.uint64) << V.U(44)) | (key >> V.U(20))
        found, count = np.unique(both, return_counts=True)
        d, k = (found >> V.U(44)).astype(np.int64), found & V.U((1 << 44) - 1)
        for level, share in enumerate(shares):
            ok = count > share * size[d]
            out.append((d[ok] << LOG2) | (V.mix(k[ok] * V.U(16) + V.U(kind * 4 + level)) >> V.U(64 - LOG2)).astype(np.int64))
    pairs = V.distinct(np.concatenate(out))
    return pairs >> LOG2, pairs & ((1 << LOG2) - 1)


@dataclass
class Head:
    """Log-odds of a label: ``weights`` by feature (zero for those not chosen), ``bias``, and the sample's rate."""

    weights: np.ndarray
    bias: float
    rate: float

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, chosen: int = 800, l2: float = 0.1) -> Head:
        none = cls(np.zeros(1 << LOG2, np.float32), 0.0, 0.5)
        if not len(y) or y.min() == y.max():
            if len(y):
                none.rate = float((y.sum() + 0.5) / (len(y) + 1))
                none.bias = float(np.log(none.rate / (1 - none.rate)))
            return none
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        feature = np.concatenate(rows)
        seen = np.bincount(feature, minlength=1 << LOG2).astype(float)
        good = np.bincount(feature, y[doc], 1 << LOG2)
        n, rate = len(y), y.mean()
        spread = n * rate * (1 - rate) * seen * np.maximum(n - seen, 1) / (n * n)
        chi = (good - seen * rate) ** 2 / np.maximum(spread, 1e-9)
        pick = np.argsort(-chi, kind="stable")[:chosen]
        pick = pick[chi[pick] > 15]
        column = np.full(1 << LOG2, -1)
        column[pick] = np.arange(len(pick))
        x = np.zeros((n, len(pick) + 1), np.float32)
        x[:, -1] = 1
        on = column[feature] >= 0
        x[doc[on], column[feature[on]]] = 1
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), l2)
        ridge[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        none.weights[pick] = w[:-1]
        return cls(none.weights, float(w[-1]), float((y.sum() + 0.5) / (n + 1)))

    def logit(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[feature], n)[:n] + self.bias


def fit(docs: DataFrame, labels: DataFrame, heads: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", sample: int = 12000, seed: int = 5) -> dict[str, Head]:
    """One head for each label column, from at most ``sample`` labelled rows drawn by a hash of the id.

    Ids of any type do, of documents and labels alike. Rows with a null label, a null id or no document do not count; an
    id labelled twice counts as its least labels, and of documents of one id one counts; hash ties go by id."""
    clean = labels.where(F.col(id_col).isNotNull()).dropna(subset=list(heads)).groupBy(F.col(id_col).alias("label_id")).agg(*[F.min(h).alias(h) for h in heads])
    drawn = clean.orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(sample)
    picked = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "label_id")

    def collect(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, block in V.blocks(batch.column(1)):
            doc, feature = features(block)
            edge = np.searchsorted(doc, np.arange(hi - lo + 1))
            sets = pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets, *(batch.column(2 + i).slice(lo, hi - lo) for i in range(len(heads)))], ["label_id", "features", *heads])

    shown = picked.select("label_id", "text", *[F.col(h).cast("int").alias(h) for h in heads])
    got = R.map_arrow(shown, collect, f"label_id {shown.schema['label_id'].dataType.simpleString()}, features binary, " + ", ".join(f"{h} int" for h in heads))
    # ids may repeat among documents: one row of an id is enough, and keeps the sample within its bound
    got = got.groupBy("label_id").agg(F.min("features").alias("features"), *[F.min(h).alias(h) for h in heads]).orderBy("label_id").toArrow()
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in got.column("features").to_pylist()]
    return {h: Head.fit(rows, got.column(h).to_numpy().astype(float)) for h in heads}


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, head: str, parent: str) -> float:
    """How many documents a prior is worth: noise within over spread between groups, by moments."""
    p, n, mean = F.col(f"sum_{head}") / F.col("n"), F.col("n"), F.col(parent)
    noise, spread, total, count = groups.agg(F.sum(n * mean * (1 - mean)), F.sum(n * (p - mean) * (p - mean)), F.sum(n), F.count(F.lit(1))).first()
    if not total:
        return 1.0
    within = noise / total
    between = max((spread - count * within) / total, 1e-6)
    return float(min(max(within / between, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, heads: dict[str, Head] | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row for each document: id, ``quality``, ``toxic`` (posterior probabilities), ``path_quality`` and ``kept``.

    A path is a host with the value of ``path_col``. Kept is quality at ``threshold`` or above and toxicity below it.
    Null and empty texts have no evidence and take their path's prior; null hosts and paths are hosts and paths of their
    own; without labels every probability is a half and all is kept; repeated rows and null ids give a row each, ties of
    probability change nothing; very long texts are read whole, in the task that meets them; other columns are ignored; an
    empty table gives an empty result. Sums by path and host are pre-aggregated, so a host of
    any size costs a row for each task, and no path or host is held by the driver.
    """
    spark = docs.sparkSession
    heads = heads or fit(docs, labels, id_col=id_col, text_col=text_col)
    names = list(heads)
    shared = spark.sparkContext.broadcast(heads)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, block in V.blocks(batch.column(3)):
            doc, feature = features(block)
            logits = [shared.value[h].logit(doc, feature, hi - lo) for h in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), *map(pa.array, logits)], ["id", "host", "path", *names])

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col, path_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = R.cut(R.map_arrow(rows, score, f"id {kinds[0]}, host {kinds[1]}, path {kinds[2]}, " + ", ".join(f"{h} double" for h in names)))
    chance = {h: 1 / (1 + F.exp(-F.col(h))) for h in names}
    paths = R.cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(chance[h]).alias(f"sum_{h}") for h in names]))
    hosts = R.cut(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{h}").alias(f"sum_{h}") for h in names]))
    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"sum_{h}").alias(h) for h in names]).first()
    for h in names:
        hosts = hosts.withColumn("global", F.lit(whole[h] / whole["n"] if whole["n"] else 0.5))
        k = _strength(hosts, h, "global")
        hosts = hosts.withColumn(f"host_{h}", (F.col(f"sum_{h}") + F.col("global") * k) / (F.col("n") + k))
    sites = paths.join(hosts.select(F.col("host").alias("host_"), *[f"host_{h}" for h in names]), F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    for h in names:
        k = _strength(sites, h, f"host_{h}")
        sites = sites.withColumn(f"path_{h}", (F.col(f"sum_{h}") + F.col(f"host_{h}") * k) / (F.col("n") + k))
    sites = sites.select(F.col("host").alias("h_"), F.col("path").alias("p_"), *[f"path_{h}" for h in names])
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h_")) & F.col("path").eqNullSafe(F.col("p_")), "left")
    for h in names:
        trained = float(np.log(heads[h].rate / (1 - heads[h].rate)))
        out = out.withColumn(f"post_{h}", 1 / (1 + F.exp(-(F.col(h) - trained + _logit(F.col(f"path_{h}"))))))
    kept = (F.col("post_quality") >= threshold) if "quality" in heads else F.lit(True)
    if "toxic" in heads:
        kept = kept & ((F.col("post_toxic") < threshold) if heads["toxic"].weights.any() else F.lit(True))
    return out.select(F.col("id").alias(id_col), *[F.col(f"post_{h}").alias(h) for h in names], *[f"path_{h}" for h in names if h == "quality"], kept.alias("kept"))
