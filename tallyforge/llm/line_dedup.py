"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find, one line of each component stays.

Shingles are runs of eight code points, each counted once a line; lines are similar from a Jaccard similarity of 0.8.
Forty samples in ten bands of four bring a pair at 0.8 together in 995 of 1000 cases and one at 0.9 in all but one of
40,000; every pair that shares a band is judged exactly.  One changed character costs a line up to eight shingles of its
own, so a single change is found in lines of 79 code points or more, and a changed end in lines of 40 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _similar as S
from tallyforge.llm import _vec as V

SHINGLE = 8  # a power of two
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
BLOCK_BYTES = 1 << 18  # of text that is worked on at a time: its arrays of 64-bit numbers stay in a core's cache

_rng = np.random.default_rng(41)
_turn = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_times = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def _written(block: V.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, document, line number) of the lines that have a word; lines are numbered from 0 with the others."""
    start, stop, doc = block.lines()
    number = np.arange(len(doc)) - V.bounds(doc, len(block))[0][doc]
    run = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(~V.SPACE[block.data], out=run[1:])
    full = run[stop] > run[start]
    return start[full], stop[full], doc[full], number[full]


def _shingles(block: V.Block, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the character shingles of byte ranges in order; a range shorter than a shingle is one."""
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    point = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(point) != len(lead):  # bytes that are no UTF-8: each is a character
        lead, point = np.arange(len(block.data)), block.data
    first, last = np.searchsorted(lead, start), np.searchsorted(lead, stop)
    run, base, width = point.astype(np.uint64), V.BASE, 1
    while width < SHINGLE:  # runs of twice as many characters; what leaves the block is never asked for
        ahead = np.zeros_like(run)
        ahead[: max(len(run) - width, 0)] = run[width:]
        run *= V.U(base)
        run += ahead
        base, width = base * base % (1 << 64), 2 * width
    count = last - first - SHINGLE + 1
    short = np.flatnonzero(count < 1)
    count[short] = 1
    begin = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(first - begin, count)
    out = V.mix(run[at])
    if len(short):
        out[begin[short]] = block.hashes(start[short], stop[short])
    return out, np.repeat(np.arange(len(start)), count)


def _elements(lines: pa.Array) -> S.Elements:
    """The distinct shingles of whole lines."""
    data, offset, _ = V._buffers(lines)
    block = V.Block(data[offset[0] : offset[-1]], offset[:-1] - offset[0], offset[1:] - offset[0])
    shingle, line = _shingles(block, block.start, block.stop)
    owner, element = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, len(lines), 4096):  # the line's number in 12 bits above the hash: one sort for many lines
        part = slice(*np.searchsorted(line, [lo, lo + 4096]))
        both = V.distinct(((line[part] - lo).astype(np.uint64) << V.U(52)) | (shingle[part] >> V.U(12)))
        owner.append((both >> V.U(52)).astype(np.int64) + lo)
        element.append(both & V.U((1 << 52) - 1))
    return np.searchsorted(np.concatenate(owner), np.arange(len(lines) + 1)), np.concatenate(element), None


def _signatures(shingle: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((BANDS * ROWS, n), np.uint32)
    if n:
        first = np.searchsorted(line, np.arange(n))
        h = (shingle >> V.U(32)).astype(np.uint32)
        turned = np.empty_like(h)
        for j in range(BANDS * ROWS):
            np.bitwise_xor(h, _turn[j], out=turned)
            np.multiply(turned, _times[j], out=turned)
            np.minimum.reduceat(turned, first, out=out[j])
    return out.T


LINES = "key long, line int, node long, size int, bands array<long>"


def _lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, key, line, node, size, bands) of each written line, with bands at a line's first place in the batch; and a
    row for each document, of line -1 and with the number of its written lines as size."""
    seen = np.zeros(0, np.uint64)
    none = pa.list_(pa.int64())
    for lo, hi, block in V.blocks(batch.column(2), BLOCK_BYTES):
        start, stop, doc, number = _written(block)
        node, size = block.hashes(start, stop), (stop - start).astype(np.int32)
        distinct, one = np.unique(node, return_index=True)
        fresh = ~np.isin(distinct, seen)
        seen = np.concatenate([seen, distinct[fresh]])
        one = np.sort(one[fresh])
        bands = V.signed(S.band_keys(_signatures(*_shingles(block, start[one], stop[one]), len(one)), ROWS))
        other = np.ones(len(node), bool)
        other[one] = False
        for at, marked in ((one, R.lists(bands)), (np.flatnonzero(other), None)):
            place = pa.array(doc[at] + lo)
            marked = marked if marked is not None else pa.nulls(len(at), none)
            yield R.record(id=batch.column(0).take(place), key=batch.column(1).take(place), line=number[at].astype(np.int32), node=V.signed(node[at]), size=size[at], bands=marked)
        n = hi - lo
        counted = V.per_doc(doc, n).astype(np.int32)
        yield R.record(id=batch.column(0).slice(lo, n), key=batch.column(1).slice(lo, n), line=np.full(n, -1, np.int32), node=np.zeros(n, np.int64), size=counted, bands=pa.nulls(n, none))


def _wanted(texts: DataFrame, scratch: R.Scratch):
    """Gives (node, text), each once, for nodes of lines."""

    def held(nodes: DataFrame) -> DataFrame:
        bits = scratch.bits(nodes, "node")

        def wanted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, block in V.blocks(batch.column(0), BLOCK_BYTES):
                start, stop, _, _ = _written(block)
                node, one = np.unique(block.hashes(start, stop), return_index=True)
                ok = np.flatnonzero(R.has_bit(bits.value, node))
                raw = block.data.tobytes()
                yield R.record(node=V.signed(node[ok]), text=pa.array([raw[start[i] : stop[i]] for i in one[ok]], pa.binary()))

        found = R.map_arrow(texts, wanted, "node long, text binary").groupBy("node").agg(F.first("text").alias("text"))
        return found.join(nodes, "node", "left_semi")

    return held


def _links(lines: DataFrame, docs: DataFrame, text_col: str, similarity: float, scratch: R.Scratch) -> DataFrame:
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = lines.where("bands is not null").select("node", "size", "bands")
    return S.linked(signed, _wanted(texts, scratch), _elements, similarity, scratch)


def _numbered(docs: DataFrame, id_col: str, text_col: str, scratch: R.Scratch) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), R.doc_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scratch.stored(R.map_arrow(rows, _lines, f"id {kind}, {LINES}"), "lines")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: id, key, n_lines, n_removed and removed, the numbers of the lines that go, and copy.

    Lines are what stands between newlines; those without a word are never touched and never count, but are numbered.
    Lines joined by a chain of similarities of 0.8 are one component, in which the line of the least (id, key, number)
    stays, wherever its copies are. Null and empty texts have no lines; a null id comes after every other; of rows equal
    in id and text, which are numbered by ``copy``, the first may keep lines and the others lose all; other columns are
    ignored, whatever their names; an empty table gives an empty result. Lines of any length are read whole. A line
    that any number of documents share is counted and its first place found by pre-aggregation.
    """
    with R.Scratch(docs.sparkSession) as scratch:
        lines = _numbered(docs, id_col, text_col, scratch)
        roots = _links(lines, docs, text_col, similarity, scratch)
        written = lines.where("line >= 0")
        place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("key").alias("key"), F.col("line").alias("line"))
        # a line that stands alone has one place and no root; the others are few, and only they are looked at again
        places = written.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("last")).join(roots, "node", "left")
        places = scratch.stored(places.where("root is not null or first <> last").select("node", "first", F.coalesce("root", "node").alias("root")), "places")
        first = scratch.stored(places.groupBy("root").agg(F.min("first").alias("kept")), "first")
        stays = scratch.stored(places.join(first, "root").select("node", "kept"), "stays")
        bits = scratch.bits(stays, "node")

        def repeated(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(R.has_bit(bits.value, batch.column(3).to_numpy().view(np.uint64))))

        kind = docs.schema[id_col].dataType.simpleString()
        some = R.map_arrow(written.select("id", "key", "line", "node"), repeated, f"id {kind}, key long, line int, node long").join(stays, "node")
        is_kept = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("key") == F.col("kept.key")) & (F.col("line") == F.col("kept.line"))
        gone = some.where(~is_kept).groupBy("id", "key").agg(F.sort_array(F.collect_set("line")).alias("removed"))
        docs_ = lines.where("line < 0").groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"), F.max("size").cast("long").alias("n_lines"))
        same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["key"] == y["key"])
        out = scratch.stored(docs_.join(gone, same(docs_, gone), "left").select(docs_["id"], docs_["key"], "copies", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")), "decided")
        again = out.where("copies > 1 and n_lines > 0").select("id", "key")
        every = written.join(again, written["id"].eqNullSafe(again["id"]) & (written["key"] == again["key"]), "left_semi").groupBy("id", "key").agg(F.sort_array(F.collect_set("line")).alias("every"))
        out = out.join(every, same(out, every), "left").select(out["id"], out["key"], "n_lines", "removed", "every", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        out = out.withColumn("removed", F.when(F.col("copy") == 1, F.col("removed")).otherwise(F.coalesce("every", "removed")))
        return R.stored(out.select(F.col("id").alias(id_col), "key", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.col("copy").cast("long").alias("copy")), "line-decisions")


FEW_KEYS = 500_000  # so many keys, of 8 bytes each, are sent to every task; more are joined by a shuffle


def rewrite(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the removed lines cut out of their texts.

    Documents that had text and have no word left go, as do the second and later of rows equal in id and text that had a
    word. Null and empty texts, and texts that lose nothing, stay as they are, blank ones among them; other columns keep
    their values, whatever their names; an empty table gives an empty one.
    """
    key, gone = R.unused(docs, "key_"), R.unused(docs, "removed_")
    cut_ = decisions.where("n_removed > 0 and copy = 1").select(F.col("key").alias(key), F.col("removed").alias(gone)).dropDuplicates([key])
    keyed = docs.withColumn(key, R.doc_key(id_col, text_col))
    again = R.cut(decisions.where("copy > 1 and n_lines > 0").select(F.col("key").alias(key)).distinct())
    if not again.isEmpty():
        few = F.broadcast(again) if again.count() <= FEW_KEYS else again
        keyed = keyed.join(few, key, "left_anti").unionByName(keyed.join(few, key, "left_semi").dropDuplicates([key]))
    joined = keyed.join(cut_, key, "left")
    text = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(text))
    return out.where(F.col(gone).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])
