"""Periodic runs of words: suffix array, longest previous factors, LZ blocks, boundary extensions, bucketed copying.

A run is a stretch of words with a smallest period that no neighbouring word extends.  Each text is looked at whole, in
the task that reads it: equal words get equal numbers, prefix doubling sorts the suffixes, neighbours in that order give
the longest previous factor of each place and with it the LZ blocks.  By Main's lemma a run either touches the beginning
of a block, where it is found by extending two places that lie one period apart, or lies strictly inside a block and is
copied from the block's earlier occurrence.  Nothing is shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

LEAST, POWER = 24, 3  # a run has so many words, and so many periods
PAIRS = 1 << 20  # so many (block, period) pairs are extended at once

RUNS = "array<struct<start:long,length:long,period:long>>"


def doubled(code: np.ndarray, owner: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Prefix doubling over sequences laid end to end, none of whose suffixes goes beyond its own end: (order, rank, slots)
    for stretches of 1, 2, 4 .. words. ``order`` are the places by their stretches, ``rank`` is equal for equal stretches
    only, ``slots`` are the places in the order that share their rank; it ends when none does. Ranks are sorted on only
    where they are shared."""
    n = len(code)
    key = owner * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key, kind="stable")
    fresh = _fresh(key[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    slots = np.flatnonzero(~_alone(fresh))
    span = 1
    yield order, rank, slots
    while len(slots):
        at = order[slots]
        ahead = at + span
        key = rank[at] * np.int64(n + 1) + np.where(ahead < stop[owner[at]], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        by = np.argsort(key, kind="stable")
        at, fresh = at[by], _fresh(key[by])
        order[slots] = at
        rank = rank.copy()
        rank[at] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        slots = slots[~_alone(fresh)]
        span *= 2
        yield order, rank, slots


def _fresh(key: np.ndarray) -> np.ndarray:
    """Which of sorted keys are the first of their value."""
    return np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)


def _alone(fresh: np.ndarray) -> np.ndarray:
    return fresh & np.append(fresh[1:], True)


def repeating(code: np.ndarray, owner: np.ndarray, stop: np.ndarray, words: int) -> np.ndarray:
    """The sequences in which some stretch of so many words, rounded down to a power of two, occurs twice."""
    span = 1
    for order, _, slots in doubled(code, owner, stop):
        if 2 * span > words:
            return np.unique(owner[order[slots]])
        span *= 2
    return np.zeros(0, np.int64)


class Suffixes:
    """The sorted suffixes (``order``) and the ranks of every doubling, from which common stretches are read."""

    def __init__(self, code: np.ndarray, owner: np.ndarray, stop: np.ndarray):
        self.owner, self.stop, self.levels = owner, stop, []
        for self.order, rank, _ in doubled(code, owner, stop):
            self.levels.append(rank)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from places i and j on, i < j of one sequence; j may be its end."""
        out, end = np.zeros(len(i), np.int64), self.stop[self.owner[i]]
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(j + out + (1 << k) <= end)
            same = fits[self.levels[k][(i + out)[fits]] == self.levels[k][(j + out)[fits]]]
            out[same] += 1 << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words are equal before places i and j, i < j of one sequence that begins at ``begin``."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(i - out - (1 << k) >= begin)
            same = fits[self.levels[k][(i - out)[fits] - (1 << k)] == self.levels[k][(j - out)[fits] - (1 << k)]]
            out[same] += 1 << k
        return out


def previous_factors(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch that also begins at an earlier place, and that place (-1: none).

    Places leave the sorted list of suffixes from the last to the first, so that both neighbours of the one that leaves
    are the nearest among earlier places."""
    order = suffixes.order
    n = len(order)
    common = np.zeros(n + 1, np.int64)
    a, b = order[:-1], order[1:]
    near = suffixes.owner[a] == suffixes.owner[b]
    lo, hi = np.minimum(a, b)[near], np.maximum(a, b)[near]
    common[1:n][near] = suffixes.ahead(lo, hi)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    lcp, where, at = array("q", common), array("q", slot), array("q", order)
    before, after = array("q", range(-1, n)), array("q", range(1, n + 2))
    length, source = array("q", bytes(8 * n)), array("q", bytes(8 * n))
    for i in range(n - 1, -1, -1):
        r = where[i]
        p, q = before[r], after[r]
        up, down = lcp[r], lcp[q]
        if up >= down:
            length[i], source[i] = up, at[p] if up else -1
            lcp[q] = down
        else:
            length[i], source[i] = down, at[q]
            lcp[q] = up
        if p >= 0:
            after[p] = q
        before[q] = p
    return np.frombuffer(length, np.int64), np.frombuffer(source, np.int64)


def lz_blocks(length: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The places where blocks begin: a block is the longest previous factor, or one new word."""
    steps, out = np.maximum(length, 1).tolist(), []
    for at, end in zip(begin.tolist(), stop.tolist(), strict=True):
        while at < end:
            out.append(at)
            at += steps[at]
    return np.array(out, np.int64)


def _pairs(at: np.ndarray, most: np.ndarray, seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each place with each period from 1 to its own limit and its sequence, so many at once."""
    some = most > 0
    at, most, seq = at[some], most[some], seq[some]
    total = np.cumsum(most)
    for lo in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        flat = np.arange(lo, min(lo + PAIRS, int(total[-1])))
        which = np.searchsorted(total, flat, side="right")
        yield at[which], flat - (total - most)[which] + 1, seq[which]


def find_runs(code: np.ndarray, owner: np.ndarray, n: int, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start in it, length, period) of the runs of at least ``least`` words and ``power`` periods, two or more,
    in each of ``n`` sequences laid end to end; sorted by sequence, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    # a run repeats a stretch of so many words, whatever its period: other sequences are done
    shortest = -(-least * (power - 1) // power)
    begin, stop = V.bounds(owner, n)
    some = repeating(code, owner, stop, shortest)
    if not len(some):
        return none
    if len(some) < n:
        part = np.flatnonzero(np.isin(owner, some))
        found = find_runs(code[part], np.searchsorted(some, owner[part]), len(some), least, power)
        return some[found[0]], *found[1:]
    suffixes = Suffixes(code, owner, stop)
    length, source = previous_factors(suffixes)
    first = lz_blocks(length, begin, stop)
    doc = owner[first]
    last = np.append(first[1:], len(code))
    size = last - first
    # the block before, of the same sequence; the end of a sequence counts as the beginning of an empty block
    opens = np.append(True, doc[1:] != doc[:-1])
    before = np.where(opens, 0, np.append(0, size[:-1]))
    closes = np.append(opens[1:], True)
    places = np.concatenate([first[~opens], last[closes]])
    left, right = np.concatenate([before[~opens], size[closes]]), np.concatenate([size[~opens], np.zeros(int(closes.sum()), np.int64)])
    held = np.concatenate([doc[~opens], doc[closes]])
    found = []

    def keep(lo: np.ndarray, hi: np.ndarray, period: np.ndarray) -> None:
        good = hi - lo >= np.maximum(least, power * period)
        found.append((lo[good], hi[good], period[good]))

    # periods that lie before the place; those of a run are shorter than half of both blocks
    which = np.flatnonzero(left + right >= shortest)
    most = np.minimum((left + right) // (power - 1), places - begin[held])
    for b, period, seq in _pairs(places[which], most[which], held[which]):
        ahead = suffixes.ahead(b - period, b)
        far = np.flatnonzero(ahead + b - begin[seq] >= np.maximum(least, power * period))
        b, period, seq = b[far], period[far], seq[far]
        keep(b - period - suffixes.behind(b - period, b, begin[seq]), b + ahead[far], period)
    # periods that lie behind the place
    which = np.flatnonzero(size >= shortest)
    most = np.minimum(size // (power - 1), stop[doc] - first - 1)
    for b, period, seq in _pairs(first[which], most[which], doc[which]):
        ahead = suffixes.ahead(b, b + period)
        far = np.flatnonzero(ahead >= (power - 2) * period)
        b, period, seq = b[far], period[far], seq[far]
        keep(b - suffixes.behind(b, b + period, begin[seq]), b + period + ahead[far], period)
    if not found:
        return none
    lo, hi, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # a stretch has one smallest period
    by = np.lexsort((period, hi, lo))
    lo, hi, period = lo[by], hi[by], period[by]
    once = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) if len(lo) else np.zeros(0, bool)
    lo, hi, period = lo[once], hi[once], period[once]
    if not len(lo):
        return none
    lo, hi, period = _copied(lo, hi, period, first, size, source, least)
    seq = owner[lo]
    by = np.lexsort((period, lo))
    return seq[by], (lo - begin[seq])[by], (hi - lo)[by], period[by]


def _copied(lo: np.ndarray, hi: np.ndarray, period: np.ndarray, first: np.ndarray, size: np.ndarray, source: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs and those strictly inside blocks, which are the runs strictly inside the blocks' earlier occurrences."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for a, b, p in zip(lo.tolist(), hi.tolist(), period.tolist(), strict=True):
        bucket.setdefault(a, []).append((b, p))
    starts = sorted(bucket)
    for k in np.flatnonzero(size >= least + 2).tolist():
        b, c = int(first[k]), int(first[k] + size[k])
        shift = b - int(source[first[k]])
        at = bisect_right(starts, b - shift)
        while at < len(starts) and starts[at] < c - shift:  # a block may overlap its source: copies made here are copied on
            a = starts[at]
            inside = [(e + shift, p) for e, p in bucket[a] if e < c - shift]
            if inside:
                if a + shift not in bucket:
                    insort(starts, a + shift)
                    bucket[a + shift] = []
                bucket[a + shift] += [x for x in inside if x not in bucket[a + shift]]
            at += 1
    every = [(a, b, p) for a in starts for b, p in bucket[a]]
    return tuple(np.array(x, np.int64) for x in zip(*every, strict=True))


def _join(block: V.Block, start: np.ndarray, stop: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """Each document's words joined by one space."""
    size = stop - start + 1
    total = np.cumsum(size)
    data = np.append(block.data, np.uint8(32))[np.minimum(np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size), len(block.data))]
    data[total - 1] = 32
    lo, hi = V.bounds(doc, n)
    edge = np.append(0, total)
    raw = data.tobytes()
    return pa.array([raw[edge[a] : max(edge[b] - 1, edge[a])] for a, b in zip(lo, hi, strict=True)], pa.binary()).cast(pa.string())


def _detect(least: int, power: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, block in V.blocks(batch.column(1)):
            n = hi - lo
            start, stop, doc = block.words()
            seq, at, length, period = find_runs(V.codes(block, start, stop), doc, n, least, power)
            first, _ = V.bounds(doc, n)
            gone = np.zeros(len(start) + 1, np.int64)  # a word goes that a run holds after its first period
            np.add.at(gone, first[seq] + at + period, 1)
            np.add.at(gone, first[seq] + at + length, -1)
            kept = np.cumsum(gone)[: len(start)] == 0
            edges = np.append(V.bounds(seq, n)[0], len(seq)).astype(np.int32)
            runs = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(at), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            yield R.record(id=batch.column(0).slice(lo, n), n_words=V.per_doc(doc, n), runs=runs, collapsed=_join(block, start[kept], stop[kept], doc[kept], n))

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """One row for each document: the id, n_words, ``runs`` and ``collapsed``, the text without the words that a run holds
    after its first period, joined by single spaces.

    Runs come by start and period; of a stretch with several periods the smallest counts. Null and empty texts have no
    words, no run and an empty ``collapsed``; null ids and repeated rows give a row each; other columns are ignored
    whatever their names; an empty table gives an empty result. Runs never cross documents, so no row meets another and
    nothing is shuffled. A very long text is one task's work, at some 250 bytes a word where it repeats long stretches
    and 60 where it does not; shorter ones share blocks of a megabyte.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return R.map_arrow(rows, _detect(least, power), f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
