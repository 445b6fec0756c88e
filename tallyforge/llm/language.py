"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Features are byte n-grams of the lower-cased text with every ASCII non-letter turned into a space, hashed into a fixed
number of buckets.  The model is mean(E[bucket]) @ W; because both steps are linear, scoring folds them into one
bucket-by-language table.  Scores are calibrated with a temperature fitted on rows held out of the training sample, and
documents under a calibrated threshold are flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

UNKNOWN = "und"
LOG2_BUCKETS = 16
ORDERS = (2, 3, 4)

_letter = np.zeros(256, np.uint8) + 32
_letter[0x61:0x7B] = np.arange(0x61, 0x7B)
_letter[0x41:0x5B] = np.arange(0x61, 0x7B)
_letter[0x80:] = np.arange(0x80, 0x100)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is a multiple of five; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Model:
    """``table``: buckets by languages; ``temperature`` and ``threshold`` calibrate and reject."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    threshold: float

    def scores(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and calibrated probability for rows of averaged table entries."""
        z = mean / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        return best, z[np.arange(len(z)), best]


def _grams(block: V.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, position) of every n-gram that lies in one document and holds a letter byte."""
    data = _letter[block.data].astype(np.uint32)
    n = len(data)
    letter = data != 32
    edge = np.zeros(n + 1, np.int32)
    inner = block.start[1:]
    np.add.at(edge, inner[inner < n], 1)
    part = np.cumsum(edge[:n], dtype=np.int32)
    for k in ORDERS:
        m = n - k + 1
        if m <= 0:
            continue
        x = np.full(m, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        some = np.zeros(m, bool)
        for i in range(k):
            x = (x ^ data[i : i + m]) * np.uint32(0x01000193)
            some |= letter[i : i + m]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(some & (part[:m] == part[k - 1 :]))
        yield (x[at] >> np.uint32(32 - LOG2_BUCKETS)).astype(np.int64), at


def _has_letters(column: pa.Array, block: V.Block) -> np.ndarray:
    ascii_letter = (_letter[block.data] != 32) & (block.data < 128)
    out = block.count(ascii_letter) > 0
    for i in np.flatnonzero(~out & (block.stop > block.start)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    text = pc.utf8_lower(batch.column(1))
    for lo, hi, block in V.blocks(text):
        parts = [(bucket, block.owner(at)) for bucket, at in _grams(block)]
        key = np.concatenate([(doc << LOG2_BUCKETS) + bucket for bucket, doc in parts] or [np.zeros(0, np.int64)])
        key, number = np.unique(key, return_counts=True)
        edge = np.searchsorted(key, np.arange(hi - lo + 1) << LOG2_BUCKETS)
        ids = [(key[a:b] & ((1 << LOG2_BUCKETS) - 1)).astype(np.uint16).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        share = [(number[a:b] / max(1, number[a:b].sum())).astype(np.float32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield R.record(lang=batch.column(0).slice(lo, hi - lo), u=batch.column(2).slice(lo, hi - lo), ids=pa.array(ids, pa.binary()), share=pa.array(share, pa.binary()))


def _sgd(rows: list[tuple[int, np.ndarray, np.ndarray]], n_lang: int, dim: int, epochs: int, rate: float, seed: int) -> np.ndarray:
    """Train the embedding and the softmax; return their product."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (1 << LOG2_BUCKETS, dim))
    out = np.zeros((dim, n_lang))
    steps, done = epochs * len(rows) * 2, 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, ids, share = rows[i]
            if not len(ids):
                continue
            for few in (False, True):  # the whole text, then a handful of its n-grams, as a short text would have
                if few:
                    pick = np.unique(rng.integers(0, len(ids), 24))
                    on, w = ids[pick], np.full(len(pick), 1 / len(pick))
                else:
                    on, w = ids, share
                hidden = w @ emb[on]
                z = hidden @ out
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                lr = rate * (1 - done / steps)
                back = out @ p
                out -= lr * np.outer(hidden, p)
                emb[on] -= np.outer(20 * lr * w, back)
                done += 1
    return emb @ out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, dim: int = 16, epochs: int = 4, rate: float = 0.5, spare: float = 0.001, seed: int = 17) -> Model:
    """Fit on a bounded sample: at most ``per_language`` rows on average for each language, drawn by a hash of id and
    text among rows that are not held out and have text and a language, and never more than twice that in all.

    Every fifth sampled row calibrates: the temperature minimises the log loss there, and the rejection threshold is
    0.5 or the score under which lie a share ``spare`` of the correctly identified rows, whichever is lower. No labelled
    row: a model of no language, which predicts ``und``.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = known.groupBy(lang_col).count().collect()  # one row for each language, of which the model holds a column
    n_lang = len(sizes)
    if not n_lang:
        return Model([], np.zeros((1 << LOG2_BUCKETS, 1), np.float32), 1.0, 0.0)
    rates = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, per_language / n)])
    drawn = known.select(F.col(lang_col).alias("lang_"), F.col(text_col).alias("text_"), F.xxhash64(F.lit(seed), id_col, text_col).alias("u"))
    drawn = drawn.where(F.pmod("u", F.lit(1 << 40)) < F.try_element_at(rates, F.col("lang_")) * (1 << 40))
    rows = R.map_arrow(drawn.select("lang_", "text_", "u"), _features, "lang string, u long, ids binary, share binary")
    got = rows.orderBy("u", "lang", "ids").limit(2 * per_language * n_lang).toArrow().to_pylist()
    languages = sorted({r["lang"] for r in got})
    code = {name: i for i, name in enumerate(languages)}
    rows = [(code[r["lang"]], np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(np.float64)) for r in got]
    test = [r for i, r in enumerate(rows) if i % 5 == 0] or rows
    table = _sgd([r for i, r in enumerate(rows) if i % 5], len(languages), dim, epochs, rate, seed)
    rng = np.random.default_rng(seed)
    few = [(y, i[pick := np.unique(rng.integers(0, len(i), 24))], np.full(len(pick), 1 / len(pick))) for y, i, _ in test if len(i)]
    test = [*test, *few]  # as in training: whole texts and a handful of n-grams
    z = np.array([s @ table[i] if len(i) else np.zeros(len(languages)) for _, i, s in test]).reshape(len(test), -1)
    y = np.array([r[0] for r in test])

    def loss(t: float) -> float:
        e = z / t
        e = e - e.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.05, 5, 60), key=loss) if len(test) else 1.0
    model = Model(languages, table.astype(np.float32), float(temperature), 0.0)
    best, score = model.scores(z)
    right = score[best == y]
    model.threshold = float(min(0.5, np.quantile(right, spare))) if len(right) else 0.0
    return model


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """One row for each input row: the id, ``held_out``, ``lang_pred``, ``score`` and ``rejected``.

    Null texts, empty texts and texts without letters get ``und``, score 0 and are rejected; other texts get the
    learned language of the highest probability and are rejected under the model's threshold. Whole texts are scored.
    A tie of probabilities goes to the first language by name. Repeated rows give repeated rows, a null id is passed
    through, very long texts are scored whole in the task that reads them, other columns are ignored, whatever their
    names, and an empty table gives an empty result.
    """
    model = model or fit(docs, id_col, text_col, lang_col, **fitting)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        text = pc.utf8_lower(batch.column(2))
        for lo, hi, block in V.blocks(text):
            total = np.zeros((hi - lo, max(1, len(model.languages))))
            number = np.zeros(hi - lo)
            for bucket, at in _grams(block):
                edge = np.searchsorted(at, np.append(block.start, len(block.data)))
                number += np.diff(edge)
                for k in range(len(model.languages)):
                    run = np.zeros(len(at) + 1)
                    np.cumsum(model.table[bucket, k], out=run[1:], dtype=np.float64)
                    total[:, k] += run[edge[1:]] - run[edge[:-1]]
            best, p = model.scores(total / np.maximum(number, 1)[:, None])
            known = _has_letters(text.slice(lo, hi - lo), block) & bool(model.languages)
            names = np.array([*model.languages, UNKNOWN], dtype=object)
            yield R.record(id=batch.column(0).slice(lo, hi - lo), held_out=batch.column(1).slice(lo, hi - lo), lang_pred=pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), score=np.where(known, p, 0.0), rejected=~known | (p < model.threshold))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = R.map_arrow(rows, score, f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
