"""Exact substring removal by bucket refinement: every byte under a 400-byte string that also starts elsewhere goes.

A dense suffix array would carry a bucket for each byte of the corpus.  Here suffixes are taken only at anchors: in each
400-byte window the q-gram of least hash, q = 49, leftmost among equals.  Equal windows have their anchor at the same
place, so windows are equal only within one q-gram bucket, and every window belongs to exactly one anchor; there is about
one anchor for each 176 bytes.  An anchor speaks for a run of windows, told apart by the offset r of the anchor in them.

The q-gram buckets are refined from there.  First by the whole run: anchors whose run, with all its bytes, has an equal
elsewhere are done.  For the others the offsets are split into nodes of 32, 8 and 1; a node's core (the bytes common to
its windows) and cover (the bytes of all of them) give its bucket identifiers at that depth.  A cover that occurs twice
removes the node's windows; a core that occurs once ends the node; the rest is refined again, with the buckets just
found: one member of each resolved bucket stays as a witness for the others.  Depth one is the exact window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

LENGTH = 400
GRAM = 49
DEPTHS = (32, 8, 1)
POSITION_BITS = 32  # an Arrow string ends before


def _runs(block: V.Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, q-gram hash, run hash) in bytes of the block."""
    n, span = len(block.data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(n - gram + 1)
    g = block.hashes(at, at + gram)
    mask = V.U((1 << POSITION_BITS) - 1)
    key = (g & ~mask) | at.astype(np.uint64)
    pad = -len(key) % span
    table = np.concatenate([key, np.full(pad, ~V.U(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & mask).astype(np.int64)
    inside = np.zeros(windows + 1, np.int64)
    long = block.stop - block.start >= length
    np.add.at(inside, block.start[long], 1)
    np.add.at(inside, block.stop[long] - length + 1, -1)
    valid = np.cumsum(inside[:windows]) > 0
    edge = np.ones(windows, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = block.start[long]
    edge[starts] = True
    first = np.flatnonzero(edge & valid)
    stop = np.append(first[1:], windows)
    # the run ends where its document's windows do
    doc = block.owner(first)
    last = np.minimum(stop - 1, block.stop[doc] - length)
    p = anchor[first]
    run = block.hashes(first, last + length) + V.mix((p - first).astype(np.uint64))
    return doc, first, last, p, g[p], run


def _anchors(length: int, gram: int):
    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, block in V.blocks(batch.column(1)):
            doc, first, last, p, g, run = _runs(block, length, gram)
            if len(doc):
                base = block.start[doc]
                yield R.record(key=batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), s0=first - base, s1=last - base, p=p - base, gram=V.signed(g), run=V.signed(run))

    return emit


def _node_keys(length: int, size: int):
    """For rows (key, text, nodes) the identifiers of each node's core and cover; no cover where it leaves the run."""

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes = batch.column(2)
        fields = nodes.flatten()
        edge = nodes.offsets.to_numpy().astype(np.int64)
        edge = edge - edge[0]
        p, a, low, high, done, gram = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(6))
        for lo, hi, block in V.blocks(batch.column(1)):
            some = slice(edge[lo], edge[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1]))
            base, q, node = block.start[row], p[some], a[some]
            tag = V.mix(node.astype(np.uint64) * V.U(V.BASE) + V.U(size))
            core = block.hashes(base + q - node, base + q - node - size + 1 + length) + tag
            whole = (node >= low[some]) & (node + size - 1 <= high[some])
            cover = np.zeros(len(q), np.uint64)
            w = np.flatnonzero(whole)
            cover[w] = block.hashes((base + q - node)[w] - size + 1, (base + q - node)[w] + length) + tag[w]
            yield R.record(
                key=batch.column(0).slice(lo, hi - lo).take(pa.array(row)), gram=gram[some], p=q, a=node, low=low[some], high=high[some], done=done[some],
                core=V.signed(core), cover=pa.array(V.signed(cover), mask=~whole),
            )

    return emit


def repeated_spans(docs: DataFrame, scratch: R.Scratch, length: int = LENGTH, gram: int = GRAM, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(key, start, stop): byte ranges of (key, text) rows, which may overlap, under windows that occur elsewhere too.

    Strings are equal where their 64-bit hashes and those of their anchors' q-grams are."""
    runs = scratch.stored(R.map_arrow(docs.select("key", "text"), _anchors(length, gram), "key long, s0 long, s1 long, p long, gram long, run long"), "anchors")
    repeated = runs.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "p", "s0")).alias("witness")).where("n > 1")
    repeated = scratch.stored(repeated, "repeated")  # on its own, so that the join below can split a run that many documents share
    known = scratch.stored(runs.join(repeated, ["gram", "run"], "left"), "runs")
    scratch.drop(repeated)
    spans = [known.where("n is not null").select("key", F.col("s0").alias("start"), (F.col("s1") + length).alias("stop"))]
    buckets = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    open_ = known.where("n is null").join(buckets, "gram", "left_semi")
    open_ = scratch.stored(open_.select("gram", "key", "p", "s0", "s1"), "open")
    scratch.drop(runs)
    is_witness = (F.col("witness.key") == F.col("key")) & (F.col("witness.p") == F.col("p")) & (F.col("witness.s0") == F.col("s0"))
    witness = known.where(F.col("n").isNotNull() & is_witness).select("gram", "key", "p", "s0", "s1").distinct()
    witness = witness.join(open_.select("gram").distinct(), "gram", "left_semi")
    active = open_.withColumn("done", F.lit(False)).unionByName(witness.withColumn("done", F.lit(True)))
    active = active.select("gram", "key", "p", (F.col("p") - F.col("s1")).alias("low"), (F.col("p") - F.col("s0")).alias("high"), "done")
    size = depths[0]
    first = (F.col("low") - F.col("low") % size).cast("long")
    active = active.withColumn("a", F.explode(F.sequence(first, F.col("high"), F.lit(size).cast("long"))))
    for depth, size in enumerate(depths):
        active = scratch.stored(active.select("key", "gram", "p", "a", "low", "high", "done"), f"nodes-{size}")
        bits = scratch.bits(active, "key")

        def involved(batch: pa.RecordBatch, bits=bits) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(R.has_bit(bits.value, batch.column(0).to_numpy().view(np.uint64))))

        texts = R.map_arrow(docs.select("key", "text"), involved, "key long, text string")
        nodes = active.groupBy("key").agg(F.collect_list(F.struct("p", "a", "low", "high", "done", "gram")).alias("nodes"))
        keyed = scratch.stored(R.map_arrow(texts.join(nodes, "key").select("key", "text", "nodes"), _node_keys(length, size), "key long, gram long, p long, a long, low long, high long, done boolean, core long, cover long"), f"keys-{size}")
        scratch.drop(active)
        covers = keyed.where("cover is not null").groupBy("gram", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "p")).alias("witness")).where("n > 1")
        covers = scratch.stored(covers, f"covers-{size}")
        found = scratch.stored(keyed.join(covers, ["gram", "cover"], "left"), f"found-{size}")
        scratch.drop(keyed, covers)
        hit = found.where("n is not null and not done")
        spans.append(hit.select("key", (F.col("p") - F.col("a") - size + 1).alias("start"), (F.col("p") - F.col("a") + length).alias("stop")))
        if depth + 1 == len(depths):
            break
        left = F.col("n").isNull() & ~F.col("done")
        alive = found.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("m"), F.sum(left.cast("int")).alias("left")).where("m > 1 and left > 0").select("gram", "core")
        alive = scratch.stored(alive, f"alive-{size}")
        stays = left | F.when(F.col("n").isNull(), F.col("done")).otherwise((F.col("witness.key") == F.col("key")) & (F.col("witness.p") == F.col("p")))
        after = found.join(alive, ["gram", "core"], "left_semi").where(stays).select("gram", "key", "p", "low", "high", (~left).alias("done"), "a").distinct()
        step = depths[depth + 1]
        child = F.explode(F.sequence(F.col("a"), F.col("a") + size - 1, F.lit(step).cast("long")))
        active = after.select("gram", "key", "p", "low", "high", "done", child.alias("a")).where((F.col("a") + step > F.col("low")) & (F.col("a") <= F.col("high")))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    begin = np.append(True, starts[1:] > stops[:-1])
    return starts[begin], stops[np.append(begin[1:], True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary) where asked for.

    Every byte of the UTF-8 text under a string of ``length`` bytes that starts at another place of any document too,
    this one included, is removed; strings are judged on the input. Very long texts are laid out whole in the task that
    reads them, and their spans meet in one row. Null and empty texts have no bytes; texts under
    ``length`` bytes keep all; rows equal in id and text are each other's repeats and get a row each; other columns are
    ignored; an empty table gives an empty result. Equal runs are counted by pre-aggregation and one witness stands for
    them afterwards, so copies of any number cost in proportion to their rows.
    """
    with R.Scratch(docs.sparkSession) as scratch:
        return R.stored(_removed(docs, scratch, id_col, text_col, length, with_text), "repeats")


def _removed(docs: DataFrame, scratch: R.Scratch, id_col: str, text_col: str, length: int, with_text: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), R.doc_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gram = max(1, min(GRAM, length // 2))
    spans = scratch.stored(repeated_spans(rows, scratch, length, gram), "spans")
    bits = scratch.bits(spans, "key")
    extra = ", kept binary" if with_text else ""
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}"

    def split(touched: bool):
        def choose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            may = R.has_bit(bits.value, batch.column(1).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(may == touched))

        return R.map_arrow(rows, choose, f"id {kind}, key long, text string")

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, data = [], batch.column(2).cast(pa.binary())
        edge = np.zeros(batch.num_rows + 1, np.int64)
        if batch.num_columns > 3:
            spans = batch.column(3).fill_null([])
            edge[1:] = np.cumsum(np.diff(spans.offsets.to_numpy()))
            first, last = (spans.flatten().field(i).to_numpy() for i in (0, 1))
        for i in range(batch.num_rows):
            text = data[i].as_py()
            starts = stops = np.zeros(0, np.int64)
            if edge[i] < edge[i + 1]:
                starts, stops = _merged(first[edge[i] : edge[i + 1]], last[edge[i] : edge[i + 1]])
            kept = b"".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True))
            found.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        columns = list(zip(*found, strict=True)) or [[]] * (4 + with_text)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    by_doc = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    touched = R.map_arrow(split(True).join(by_doc, "key", "left").select("id", "key", "text", "spans"), finish, schema)
    return touched.unionByName(R.map_arrow(split(False), finish, schema)).withColumnRenamed("id", id_col)
