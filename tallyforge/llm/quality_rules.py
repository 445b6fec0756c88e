"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS.encode())] = True
_lead = np.ones(256, bool)  # bytes that begin a code point
_lead[0x80:0xC0] = False

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _threes(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, first word) of each three neighbouring words of a document; equal numbers are equal words, none is hashed."""
    if len(word) < 3:
        return word[:0], word[:0]
    many = int(word.max()) + 1
    pair = np.unique(word[:-1] * many + word[1:], return_inverse=True)[1]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    return pair[at] * many + word[at + 2], at


def _measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo, hi, block in V.blocks(batch.column(2)):
        n = hi - lo
        start, stop, doc = block.words()
        size = V.per_doc(doc, n)
        key, at = _threes(V.codes(block, start, stop), doc)
        again, _ = V.repeats(doc[at], key)
        covered = np.zeros(len(doc) + 3, bool)
        for i in range(3):
            covered[at[again] + i] = True
        a, b, line_doc = block.lines()
        written = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(~V.SPACE[block.data], out=written[1:])
        full = written[b] > written[a]
        a, b, line_doc = a[full], b[full], line_doc[full]
        _, before = V.repeats(line_doc, V.codes(block, a, b))
        yield R.record(
            id=batch.column(0).slice(lo, hi - lo), host=batch.column(1).slice(lo, hi - lo),
            n_words=size, word_chars=block.count(_lead[block.data] & ~V.SPACE[block.data]), n_symbols=block.count(_symbol[block.data]),
            n_dup_lines=V.per_doc(line_doc, n, before), n_repeat_words=V.per_doc(doc, n, covered[: len(doc)]),
        )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rule measures of whole texts: (id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return R.map_arrow(rows, _measure, f"id {kinds[0]}, host {kinds[1]}, {MEASURES}")


def base_failed() -> Column:
    """Too short, or mostly made of repeated three-word runs."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def host_rules() -> dict[str, Column]:
    """The rules whose failures count for a host; each is total, null-free and false for good prose."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "short_or_repetitive": base_failed(),
        "odd_word_length": (F.col("n_words") > 0) & ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        "symbols": F.col("n_symbols") * 10 > words,
        "repeated_lines": F.col("n_dup_lines") * 10 > words,
    }


def host_verdicts(measures: DataFrame, reject_rate: float = 0.5, confidence_z: float = 2.0) -> DataFrame:
    """One row for each host: documents, failures, the shrunk rate of each rule and ``host_ok``.

    Each rule's prior is a beta distribution whose mean and strength come by the method of moments from the host rates,
    weighted by documents. A host is rejected when, for some rule, its posterior mean less ``confidence_z`` posterior
    deviations exceeds ``reject_rate``. A null host is a host of its own.
    """
    rules = host_rules()
    host = measures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(rule.cast("long")).alias(f"bad_{name}") for name, rule in rules.items()])
    host = R.cut(host)
    moments = host.agg(
        F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        *[F.sum(f"bad_{r}").alias(f"bad_{r}") for r in rules], *[F.sum(F.pow(F.col(f"bad_{r}"), 2) / F.col("n")).alias(f"sq_{r}") for r in rules],
    ).first()
    ok = F.lit(True)
    for r in rules:
        total = moments["docs"] or 1
        mean = ((moments[f"bad_{r}"] or 0) + 0.5) / (total + 1)
        # between-host variance: weighted sum of squares beyond what binomial noise gives
        spread = (moments[f"sq_{r}"] or 0.0) - total * mean * mean - ((moments["hosts"] or 1) - 1) * mean * (1 - mean)
        scale = total - (moments["squares"] or 0) / total - ((moments["hosts"] or 1) - 1)
        between = max(spread / scale if scale > 0 else 0.0, 1e-6)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
        a, b = F.col(f"bad_{r}") + mean * strength, F.col("n") - F.col(f"bad_{r}") + (1 - mean) * strength
        host = host.withColumn(f"rate_{r}", a / (a + b))
        ok = ok & (a / (a + b) - confidence_z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) <= reject_rate)
    return host.withColumn("host_ok", ok)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", reject_rate: float = 0.5) -> DataFrame:
    """One row for each document: measures, ``base_failed`` and ``kept``.

    A document is kept when it passes the base rule and its host is not rejected. Null texts have no words and fail the
    base rule; null hosts count together as one host; repeated rows, hosts of equal rates and null ids give a row or host
    each; very long texts are measured whole, in the task that reads them; words and lines are compared, not hashed; other
    columns are ignored whatever their names; an empty table gives an empty result. Measures are computed once and cut, failures
    are pre-aggregated before they are shuffled, so one host with a third of all rows costs no more than any other.
    """
    found = R.cut(measure(docs, id_col, text_col, host_col))
    hosts = host_verdicts(found, reject_rate).select(F.col("host").alias("host_"), "host_ok")
    out = found.join(hosts, F.col("host").eqNullSafe(F.col("host_")), "left").withColumn("base_failed", base_failed())
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"))
