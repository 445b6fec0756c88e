"""Vectorised text primitives over Arrow string columns.

A ``Block`` lays the UTF-8 bytes of several documents end to end in one numpy
buffer and answers questions about words, lines and substrings with array
operations, so that Python runs per block and not per row.  Nothing here knows
about Spark; the operators call it from ``mapInArrow`` functions.

Substring identity uses 64-bit hashes: up to seven bytes are mixed as they are,
and of longer strings all windows of eight bytes are, each by a bijective mixer,
and summed with powers of a base.  Mixing comes before the sum, so that strings
of a regular build, which plain polynomials modulo 2**64 take for each other,
stay apart.  Blocks hold whole documents: about ``BLOCK_BYTES`` each, or one
document when that document alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
WINDOW = 8
_low_bytes = np.array([(1 << (8 * k)) - 1 for k in range(WINDOW)], np.uint64)
_pow = {"fwd": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}

#: ASCII white space of the word rule: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if len(_pow["fwd"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("fwd", BASE), ("inv", BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[name] = np.cumprod(steps, dtype=np.uint64)
    return _pow["fwd"], _pow["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads every input bit."""
    high = x >> U(33)
    x = x ^ high
    x *= U(0xFF51AFD7ED558CCD)
    np.right_shift(x, U(33), out=high)
    x ^= high
    x *= U(0xC4CEB9FE1A85EC53)
    np.right_shift(x, U(33), out=high)
    x ^= high
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by a sort, which long arrays of hashes like better than a hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark keeps."""
    return x.view(np.int64)


class Block:
    """Documents laid end to end. ``data``: bytes; ``start``, ``stop``: each document's bounds."""

    def __init__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.data, self.start, self.stop = data, start.astype(np.int64), stop.astype(np.int64)
        self._prefix: np.ndarray | None = None
        self._windows: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def only(self, some: np.ndarray) -> Block:
        """A block of some of the documents, in ascending order."""
        if len(some) == len(self):
            return self
        size = (self.stop - self.start)[some]
        stop = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.start[some] - (stop - size), size)
        return Block(self.data[at], stop - size, stop)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash for each byte range [start, stop)."""
        n = len(self.data)
        fwd, inv = _powers(n + 1)
        if self._prefix is None:
            padded = np.zeros(n + WINDOW, np.uint8)
            padded[:n] = self.data
            self._windows = np.ndarray(n + 1, "<u8", padded, strides=(1,)).copy()
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(self._windows[:n]) * fwd[:n], out=self._prefix[1:])
        size = stop - start
        out = (self._prefix[np.maximum(stop - (WINDOW - 1), start)] - self._prefix[start]) * inv[start]
        short = np.flatnonzero(size < WINDOW)
        if len(short):
            out[short] = mix(self._windows[start[short]] & _low_bytes[size[short]])
        out += size.astype(np.uint64)
        return mix(out)

    def words(self, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and document number of each maximal run of bytes that are not separators."""
        inside = np.ones(len(self.data) + 2, bool)
        np.logical_not(separator[self.data], out=inside[1:-1])
        inside[0] = inside[-1] = False
        turn = inside[1:] != inside[:-1]
        # neighbouring documents touch in the buffer: a boundary between two word bytes ends one word and begins another
        edges = np.flatnonzero(turn)
        start, stop = edges[::2], edges[1::2]
        cut = self.start[1:]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
        if len(cut):
            cut = np.unique(cut)
            start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
        return start, stop, self.owner(start)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The document that holds each byte; documents without bytes hold none."""
        full = np.flatnonzero(self.stop > self.start)
        return full[np.searchsorted(self.start[full], at, side="right") - 1] if len(full) else np.zeros(0, np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and document number of each piece between newlines, empty ones included."""
        full = np.flatnonzero(self.stop > self.start)
        if not len(full):
            none = np.zeros(0, np.int64)
            return none, none, none
        newline = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.start[full], newline + 1]), kind="stable")
        doc = np.sort(np.concatenate([full, self.owner(newline)]), kind="stable")
        # a newline that closes a document opens an empty last line, which sorts before the next document's first
        stop = np.sort(np.concatenate([newline, self.stop[full]]), kind="stable")
        return start, stop, doc

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document a mask over ``data`` marks."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.stop] - total[self.start]


def codes(block: Block, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each of ascending, disjoint byte ranges, equal for equal bytes only: they are compared, not hashed."""
    if not len(start):
        return np.zeros(0, np.int64)
    edges = np.empty(2 * len(start), np.int32)
    edges[::2], edges[1::2] = start, stop
    pieces = pa.Array.from_buffers(pa.binary(), 2 * len(start) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(block.data))])
    return np.asarray(pieces.dictionary_encode().indices)[::2].astype(np.int64)


def per_doc(doc: np.ndarray, n: int, mask: np.ndarray | None = None) -> np.ndarray:
    """How many entries, or marked entries, each document has."""
    return np.bincount(doc if mask is None else doc[mask], minlength=n).astype(np.int64)


def bounds(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one entry of each document in a sorted owner array."""
    at = np.searchsorted(doc, np.arange(n + 1))
    return at[:-1], at[1:]


def repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (document, key): is there an equal one in the document; is there an equal one before."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    again, before = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    before[order[1:]] = same  # lexsort is stable: the first of equals keeps its place
    return again, before


def shingles(doc: np.ndarray, word: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of each run of k words; a document of fewer words, but not none, has one of all its words."""
    m = len(word)
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m >= k:
        out = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            out *= U(0x9FB21C651E98DF25)
            out += word[i : m - k + 1 + i]
        at = np.flatnonzero(doc[: m - k + 1] == doc[k - 1 :])
        out = mix(out[at])
    first, last = bounds(doc, n)
    short = np.flatnonzero((last > first) & (last - first < k))
    if len(short):
        whole = np.array([int(np.bitwise_xor.reduce(mix(word[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * U(BASE)))) ^ int(b - a) for a, b in zip(first[short], last[short], strict=True)], np.uint64)
        out, at = np.concatenate([out, mix(whole)]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, doc[at] if len(at) else np.zeros(0, np.int64), at


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string or binary array."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n, (_, offsets, data) = len(column), column.buffers()
    offset = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offset, np.asarray(column.is_valid())


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, last row + 1, block) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    data, offset, _ = _buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offset, offset[at] + size, side="right")) - 1)
        to = min(to, n)
        lo, hi = int(offset[at]), int(offset[to])
        yield at, to, Block(data[lo:hi], offset[at:to] - lo, offset[at + 1 : to + 1] - lo)
        at = to


def rows(batch: pa.RecordBatch, at: int, to: int, *names: str) -> list[pa.Array]:
    """Slices of a batch's columns."""
    return [batch.column(batch.schema.get_field_index(n)).slice(at, to - at) for n in names]
