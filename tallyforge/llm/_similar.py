"""Linking similar things: bands, groups of bounded size in which every pair is judged, distributed union-find.

Things meet where their signatures share a band.  A band of up to ``most`` things is one group; a larger one is dealt by
hash into parts, each a group, and where its things are not all in one component afterwards, the parts meet pairwise.
Where those would be many, as in a crowd of one template in which little is linked, the things of the band meet by their
rarest elements instead: two things can only be similar if they share one of the rarest elements that make up more than
either may lack (a prefix filter by classes of weight), which loses no pair and forms few groups where the template's
elements are common.
A group goes to one task with the elements (shingles) of its things, which judges every pair by its exact similarity and
returns the links of a spanning forest only.  So every pair that shares a band and is similar ends up in one component,
whatever the partitioning, and no list of pairs is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import _vec as V

MOST, MOST_BYTES = 1000, 2 << 20
SKETCH_BITS = 4096
CROWD = 8  # parts of a band's unlinked things beyond which they meet by their rarest elements
CLASS = 1.05  # how much weights of one class differ at most
LOG2_RARITY = 20  # elements are counted in so many buckets, to put rare ones first
TASK_EDGES = 1 << 20  # links of 16 bytes that a task joins at once

#: What a function that finds elements returns: first element of each thing and the end, elements (52 bits, ascending and
#: distinct within a thing), their weights or None where each weighs 1.
Elements = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` samples: (things, bands)."""
    n, samples = signature.shape
    bands = samples // rows
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * V.U(V.BASE), (n, 1))
    for i in range(rows):
        out *= V.U(0x9FB21C651E98DF25)
        out += signature[:, i : bands * rows : rows]
    return V.mix(out)


def meetings(signed: DataFrame, scratch: R.Scratch, most: int = MOST, most_bytes: int = MOST_BYTES, apart: str = "node") -> DataFrame:
    """(band, node, size, parts) of the bands that hold two values of ``apart`` or more; of bands with the same nodes only
    one.

    ``signed`` has rows (node, size, bands), of which some may repeat. Bands are found by a pre-aggregated least and
    greatest node, so a node that every task holds is no hot spot; bits of the bands found then spare all other rows the
    join. ``parts`` is how many groups a band is dealt into, by its nodes and by their bytes.
    """
    ends = signed.select(F.explode("bands").alias("band"), F.col(apart).alias("a")).groupBy("band").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    shared = scratch.stored(ends.where("lo <> hi").select("band"), "bands")
    bits = scratch.bits(shared, "band")

    def likely(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        band, edge = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(edge))
        ok = np.flatnonzero(R.has_bit(bits.value, band.to_numpy().view(np.uint64)))
        at = pa.array(row[ok])
        yield R.record(band=band.take(pa.array(ok)), node=batch.column(0).take(at), size=batch.column(1).take(at))

    met = R.map_arrow(signed.select("node", "size", "bands"), likely, "band long, node long, size int").groupBy("band", "node").agg(F.max("size").alias("size"))
    met = scratch.stored(met.join(shared, "band", "left_semi"), "members")
    same = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"x{i}") for i in (1, 2)]
    sets = met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *same)
    kept = sets.groupBy("n", "x1", "x2").agg(F.min("band").alias("band"), F.max("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("bytes") / most_bytes))
    kept = scratch.stored(kept.select("band", parts.cast("int").alias("parts")), "kept-bands")
    out = scratch.stored(met.join(kept, "band"), "meetings")
    scratch.drop(shared, met, kept)
    return out


def groups(met: DataFrame) -> DataFrame:
    """(gid, node, root): each band's parts, in which each node is its own root."""
    part = F.pmod(F.xxhash64("node", "band"), F.col("parts"))
    return met.select(F.xxhash64("band", part).alias("gid"), "node", F.col("node").alias("root"))


def crossing(met: DataFrame, roots: DataFrame, scratch: R.Scratch, most: int = MOST, most_bytes: int = MOST_BYTES, crowd: int | None = CROWD) -> tuple[DataFrame | None, DataFrame | None]:
    """Groups (gid, node, root) in which the pairs of larger bands meet that ``groups`` did not bring together and whose
    ends are in different components, and the nodes (node, root, size) of crowds; None where there are none.

    A component that could fill a part has parts of its own, which need not meet each other; the rest of a band is pooled.
    Of one large component and a few strays only the strays' pairs are so looked at. A band whose pool has more than
    ``crowd`` parts is a crowd: its nodes are returned and not paired here.
    """
    large = met.where("parts > 1")
    if large.isEmpty():
        return None, None
    ends = large.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    open_ = ends.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    ends = scratch.stored(ends.join(open_, "band", "left_semi"), "open")
    if ends.isEmpty():
        return None, None
    need = F.greatest(F.col("n") * 2 / most, F.col("bytes") * 2 / most_bytes)
    by_root = ends.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).withColumn("need", need)
    crowded = None
    if crowd is not None:
        wide = scratch.stored(by_root.where("need < 1").groupBy("band").agg(F.sum("need").alias("parts")).where(F.col("parts") > crowd).select("band"), "crowds")
        if not wide.isEmpty():
            crowded = scratch.stored(ends.join(wide, "band", "left_semi").select("node", "root", "size").distinct(), "crowded")
            ends, by_root = ends.join(wide, "band", "left_anti"), by_root.join(wide, "band", "left_anti")
    own = by_root.where("need >= 1").select("band", F.col("root").alias("own"), F.ceil("need").cast("int").alias("parts"))
    own = scratch.stored(own, "own")
    pool = by_root.where("need < 1").groupBy("band").agg(F.ceil(F.sum("need")).cast("int").alias("parts")).select("band", F.lit(None).cast("long").alias("own"), "parts")
    pool = scratch.stored(pool, "pool")
    parts = own.unionByName(pool).select("band", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    parts = parts.withColumn("i", F.row_number().over(Window.partitionBy("band").orderBy("own", "k")))
    x, y = (parts.select("band", F.col("own").alias(f"own_{s}"), F.col("k").alias(f"k_{s}"), F.col("i").alias(f"i_{s}")) for s in "xy")
    apart = F.col("own_x").isNull() | F.col("own_y").isNull() | (F.col("own_x") != F.col("own_y"))
    pairs = x.join(y, "band").where((F.col("i_x") <= F.col("i_y")) & apart).withColumn("gid", F.xxhash64("band", "i_x", "i_y", F.lit(2)))
    pairs = scratch.stored(pairs, "part-pairs")
    seats = pairs.select("band", "gid", F.col("own_x").alias("own"), F.col("k_x").alias("k")).unionByName(
        pairs.where("i_x < i_y").select("band", "gid", F.col("own_y").alias("own"), F.col("k_y").alias("k"))
    )
    placed = ends.join(own.select("band", F.col("own").alias("root"), "own", F.col("parts").alias("own_parts")), ["band", "root"], "left")
    placed = placed.join(pool.select("band", F.col("parts").alias("pool_parts")), "band", "left")
    placed = placed.withColumn("k", F.pmod(F.xxhash64("node", "band"), F.coalesce("own_parts", "pool_parts")).cast("int")).withColumn("own", F.coalesce("own", F.lit(0)))
    return placed.join(seats.withColumn("own", F.coalesce("own", F.lit(0))), ["band", "own", "k"]).select("gid", "node", "root"), crowded


def rarest(elements: Elements, seen: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(first of each thing and the end, keys): two things can only be similar if they share a key.

    A key is an element and the classes of weight, a factor of ``CLASS`` wide, of its thing and of the other. What is
    common to similar things weighs ``s / (1 + s)`` of both at least. In the order of ``seen``, counts by bucket, and then
    of the elements themselves, the first common element has all of that behind it; so of each thing only the first
    elements are taken, rare ones, that have enough behind them for the least weight of the other's class."""
    start, element, weight = elements
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    order = np.lexsort((element, seen[element & V.U(len(seen) - 1)], owner))
    w = (np.ones(len(element)) if weight is None else weight)[order]
    run = np.append(0.0, np.cumsum(w))
    total = np.maximum(run[start[1:]] - run[start[:-1]], 1e-9)
    rest = (run[start[1:]][owner] - run[:-1]) * (1 + 1e-9) + 1e-9
    mine = np.floor(np.log(total) / np.log(CLASS)).astype(np.int64)
    reach = int(np.ceil(np.log(1 / similarity) / np.log(CLASS))) + 1
    keys, things = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in range(-reach, reach + 1):
        other = mine + step
        low, high = CLASS ** other.astype(float) * (1 - 1e-9), CLASS ** (other + 1.0) * (1 + 1e-9)
        fits = (high >= similarity * total) & (low <= total / similarity)
        need = similarity / (1 + similarity) * (total + np.maximum(low, similarity * total * (1 - 1e-9)))
        some = np.flatnonzero(fits[owner] & (rest >= need[owner]))
        pair = np.minimum(mine, other) * 4096 + np.abs(step)
        keys.append(V.mix(element[order][some] * V.U(V.BASE) + pair[owner[some]].astype(np.uint64)))
        things.append(owner[some])
    thing, key = np.concatenate(things), np.concatenate(keys)
    by = np.argsort(thing, kind="stable")
    return np.searchsorted(thing[by], np.arange(n + 1)), key[by]


def by_rarest(crowded: DataFrame, held: DataFrame, elements: Callable[[pa.Array], Elements], similarity: float, scratch: R.Scratch) -> DataFrame:
    """(node, root, size, bands): the nodes with their rarest elements as bands. Rarity is counted over all of them, in a
    fixed number of buckets, which shapes the groups and never the result."""
    some = scratch.stored(crowded.join(held, "node").select("node", "root", "size", "text"), "crowd")
    mask = V.U((1 << LOG2_RARITY) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << LOG2_RARITY, np.int64)
        for batch in batches:
            for lo, hi, _ in V.blocks(batch.column(0)):
                seen += np.bincount((elements(batch.column(0).slice(lo, hi - lo))[1] & mask).astype(np.int64), minlength=len(seen))
        bucket = np.flatnonzero(seen)
        yield R.record(bucket=bucket, n=seen[bucket])

    got = some.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(1 << LOG2_RARITY, np.int64)
    seen[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    sent = scratch.broadcast(seen)

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _ in V.blocks(batch.column(3)):
            node, root, size, text = (batch.column(i).slice(lo, hi - lo) for i in range(4))
            edge, element = rarest(elements(text), sent.value, similarity)
            yield R.record(node=node, root=root, size=size, bands=pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(V.signed(element))))

    return scratch.stored(R.map_arrow(some, sign, "node long, root long, size int, bands array<long>"), "rarest")


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, end to end, and where each range begins among them."""
    size = stop - start
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - first, size), first


def _two_by_two(first: np.ndarray, elements: Elements, total: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the things ``first`` are similar to the one that follows each."""
    start, element, weight = elements
    out = np.zeros(len(first), bool)
    for lo in range(0, len(first), 4096):  # the pair's number in 12 bits above the element: one sort for many pairs
        a = first[lo : lo + 4096]
        at, _ = _ranges(start[a], start[a + 2])
        pair = np.repeat(np.arange(len(a), dtype=np.uint64), start[a + 2] - start[a])
        key = (pair << V.U(52)) | element[at]
        if weight is None:
            key.sort()
            twice = key[1:][key[1:] == key[:-1]]
            common = np.bincount((twice >> V.U(52)).astype(np.int64), minlength=len(a)).astype(float)
        else:
            order = np.argsort(key, kind="stable")
            key, w = key[order], weight[at][order]
            twice = np.flatnonzero(key[1:] == key[:-1])
            common = np.bincount((key[twice] >> V.U(52)).astype(np.int64), np.minimum(w[twice], w[twice + 1]), len(a))
        out[lo : lo + 4096] = common >= similarity * (total[a] + total[a + 1] - common)
    return out


def _within(lo: int, hi: int, root: np.ndarray, elements: Elements, total: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs among things lo to hi that are in different components.

    Before a pair is counted, the parity of its elements by hash cell is compared (an odd sketch): no more cells can
    differ than elements do, so pairs with too many are surely too far apart, and no other is left out."""
    start, element, weight = elements
    base, m = start[lo], hi - lo
    some = element[base : start[hi]]
    w = np.ones(len(some)) if weight is None else weight[base : start[hi]]
    begin, end, mine = start[lo:hi] - base, start[lo + 1 : hi + 1] - base, total[lo:hi]
    vocabulary, word = np.unique(some, return_inverse=True)
    bits = min(SKETCH_BITS, max(64, 1 << int((end - begin).max() - 1).bit_length()))
    cell = np.repeat(np.arange(m) * bits, end - begin) + (some & V.U(bits - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=m * bits) & 1).astype(bool).reshape(m, bits)
    sketch = np.packbits(odd, axis=1).view(np.uint64)
    least = w.min() * (1 + similarity) / (1 - similarity)
    label = np.unique(root[lo:hi], return_inverse=True)[1]
    mark, joined = np.zeros(len(vocabulary)), np.zeros(m, bool)
    for i in range(m - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(other):
            continue
        differ = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        other = other[differ * least <= (mine[i] + mine[other]) * (1 + 1e-9)]
        if not len(other):
            continue
        own = slice(begin[i], end[i])
        mark[word[own]] = w[own]
        at, first = _ranges(begin[other], end[other])
        common = np.add.reduceat(np.minimum(mark[word[at]], w[at]), first)
        mark[word[own]] = 0
        other = other[common >= similarity * (mine[i] + mine[other] - common)]
        if not len(other):
            continue
        labels, one = np.unique(label[other], return_index=True)
        for j in other[one].tolist():
            yield lo + i, lo + j
        joined[labels] = True
        label[joined[label]] = label[i]
        joined[labels] = False


def forest(group: np.ndarray, root: np.ndarray, elements: Elements, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (one thing, other thing) that join what is similar within groups of equal, adjacent ``group``. Every pair of
    a group whose roots differ is judged by exact (weighted) Jaccard similarity, but for those already joined."""
    start, element, weight = elements
    n = len(group)
    total = np.diff(start).astype(float) if weight is None else np.add.reduceat(weight, start[:-1]) if n else np.zeros(0)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    stop = np.append(edge[1:], n)
    two = edge[stop - edge == 2]
    two = two[root[two] != root[two + 1]]
    two = two[_two_by_two(two, elements, total, similarity)]
    found = [(int(a), int(a) + 1) for a in two]
    for lo, hi in zip(edge.tolist(), stop.tolist()):
        if hi - lo > 2:
            found += _within(lo, hi, root, elements, total, similarity)
    a, b = zip(*found) if found else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then the stars are the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").count() == 0


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least of its component, of one task's links; the least nodes have none."""
    nodes, end = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = end[: len(u)], end[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Stars in place of the links of each of ``parts`` parts, which join the same nodes. A link's part is a hash of both
    its ends, so a node with any number of links is spread, and a link that occurs twice comes together. A part is a
    group, so that what is joined does not depend on how many partitions the session makes."""

    def joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        u, v = _stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield R.record(u=u, v=v)

    dealt = edges.select("u", "v", F.pmod(F.xxhash64("u", "v"), F.lit(parts).cast("long")).alias("part"))
    return R.map_groups(dealt, "part", joined, "u long, v long")


def components(edges: DataFrame, scratch: R.Scratch, most_rounds: int = 40, most_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): the least node of each connected component of (a, b) edges, for every node that has an edge.

    Each round deals the links to parts of some ``most_edges``, puts stars in their place, and then, unless one part had
    all of them, runs a large-star and a small-star until every edge leads to a centre. Each round is stored in the
    shared folder, and the driver sees two numbers a round. Minima are pre-aggregated, so a node with any number of links
    is no hot spot.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(most_rounds):
        parts = edges.count() // most_edges + 1
        after = scratch.stored(_contracted(edges, parts), "edges")
        scratch.drop(edges)
        edges = after
        if parts == 1 or _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.unionByName(roots)


def linked(signed: DataFrame, texts: Callable[[DataFrame], DataFrame], elements: Callable[[pa.Array], Elements], similarity: float, scratch: R.Scratch, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(node, root) of the nodes that are linked to another; ``texts`` gives (node, text) for a frame of wanted nodes, each
    once, and ``elements`` the elements of texts."""
    met = meetings(signed, scratch, most, most_bytes)
    held = scratch.stored(texts(met.select("node").distinct()), "texts")

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node = batch.column(1).to_numpy()
        a, b = forest(batch.column(0).to_numpy(), batch.column(2).to_numpy(), elements(batch.column(3)), similarity)
        yield R.record(a=node[a], b=node[b])

    def verified(some: DataFrame) -> DataFrame:
        return R.map_groups(some.join(held, "node").select("gid", "node", "root", "text"), "gid", judge, "a long, b long")

    edges = scratch.stored(verified(groups(met)), "links")
    roots = scratch.stored(components(edges, scratch), "roots")
    pairs, crowded = crossing(met, roots, scratch, most, most_bytes)
    if crowded is not None:
        met = meetings(by_rarest(crowded, held, elements, similarity, scratch), scratch, most, most_bytes, "root")
        once = groups(met).drop("root").join(crowded.select("node", "root").distinct(), "node")
        pairs = once if pairs is None else pairs.unionByName(once)
    for again in (crowded is not None, False):
        if pairs is None:
            return roots
        more = scratch.stored(verified(pairs), "links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = scratch.stored(components(edges, scratch), "roots")
        if not again:
            return roots
        # what still shares a rare element with many others, and is in no component with them
        pairs, _ = crossing(met, roots, scratch, most, most_bytes, None)
    return roots
