"""Periodic runs, sharding and ranked search against brute force, and on awkward input."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import periodic, queries, search, sharding
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_runs(w, least, power):
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def words_of(rng, n, letters):
    w = rng.integers(0, letters, n)
    if n and rng.random() < 0.5:
        w = np.tile(rng.integers(0, letters, int(rng.integers(1, 12))), n)[:n]
        w[rng.integers(0, n, int(rng.integers(0, 3)))] = 7
    return np.concatenate([w, rng.integers(0, letters, 3), w]) if rng.random() < 0.4 else w


@pytest.mark.parametrize(("least", "power"), [(24, 3), (2, 2), (3, 3), (6, 3), (5, 2), (8, 4)])
def test_runs_against_brute_force(least, power):
    rng = np.random.default_rng(least * 10 + power)
    for _ in range(150):
        docs = [words_of(rng, int(rng.integers(0, 70)), int(rng.integers(1, 4))) for _ in range(int(rng.integers(1, 5)))]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        found = collections.defaultdict(list)
        for d, *run in zip(*periodic.find_runs(np.concatenate(docs).astype(np.int64), owner, len(docs), least, power), strict=True):
            found[int(d)].append(tuple(int(x) for x in run))
        for d, w in enumerate(docs):
            assert found[d] == brute_runs(w.tolist(), least, power)


def test_runs_whose_words_or_texts_touch(spark):
    chorus = "la di da " * 20
    texts = [chorus, chorus, "x " * 30, "x " * 23, "ab" * 500, chorus + "end " + chorus, "né " * 24]
    out = {r.doc_id: r for r in periodic.detect(frame(spark, texts, list(range(7)))).collect()}
    assert [[tuple(x) for x in out[i].runs] for i in range(7)] == [[(0, 60, 3)], [(0, 60, 3)], [(0, 30, 1)], [], [], [(0, 60, 3), (61, 60, 3)], [(0, 24, 1)]]
    assert [out[i].collapsed for i in (0, 2, 4, 5, 6)] == ["la di da", "x", "ab" * 500, "la di da end la di da", "né"]


def test_long_text_of_runs_within_runs(spark):
    rng = np.random.default_rng(4)
    verse = " ".join([f"w{x}" for x in rng.integers(0, 50, 40)] + ["hey"] * 30)
    text = "\n".join([verse] * 6_000)  # over a block of a megabyte
    (row,) = periodic.detect(frame(spark, [text])).collect()
    assert row.n_words == 420_000 and (0, 420_000, 70) in {tuple(r) for r in row.runs}
    assert sum(tuple(r)[1:] == (30, 1) for r in row.runs) == 6_000


def test_runs_odd(spark, odd):
    out = periodic.detect(odd).toPandas()
    assert len(out) == odd.count() and out.n_words.sum() > 0
    for row in out.itertuples():
        assert row.collapsed is not None and len(row.runs) == (row.n_words == 27_000)
    assert periodic.detect(odd.limit(0)).count() == 0 and periodic.detect(odd.withColumn("doc_id", F.lit("x"))).count() == odd.count()


def test_periodic_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = [None, "", "a"] + [" ".join(map(str, words_of(rng, int(rng.integers(1, 400)), 9))) for _ in range(120)]
    frame(spark, texts, list(range(len(texts)))).write.parquet(f"{tmp_path}/documents.parquet")
    turned = 0
    for row in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        w = WORD.findall(texts[row.doc_id] or "")
        h = zlib.crc32(str(row.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            turned += 1
        runs = brute_runs(w, 24, 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best and row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert turned > 5


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    good, bad, drawn, n = 7, 11, 6, 40_000
    seen = collections.Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    for k in range(drawn + 1):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(seen[k] - n * p) < 5 * math.sqrt(n * p) + 1
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 3, 2, 5) == 3


def test_hypergeometric_of_many_rows():
    rng = np.random.default_rng(1)
    good, total, drawn = 10**9, 24 * 10**9, 5 * 10**6
    draws = np.array([sharding.hypergeometric(rng, good, total - good, drawn) for _ in range(400)])
    mean = drawn * good / total
    sd = math.sqrt(mean * (1 - good / total) * (total - drawn) / (total - 1))
    assert abs(draws.mean() - mean) < 5 * sd / 20 and 0.85 < draws.std() / sd < 1.15


def test_matrix_sums():
    sizes = sharding.shard_sizes(1003, 24)
    drawn = sharding.matrix([500, 0, 3, 400, 100], sizes, 3)
    assert [sum(r) for r in drawn] == [500, 0, 3, 400, 100] and [sum(c) for c in zip(*drawn, strict=True)] == sizes
    assert max(sizes) - min(sizes) == 1


@pytest.mark.parametrize("rows", [1, 5, 1003])
def test_shards_are_exact(spark, rows):
    out = sharding.shuffle(spark.range(rows).repartition(7), 24, seed=2).toPandas()
    assert sorted(out.id) == list(range(rows))
    counts = out.groupby("shard").size().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, some in out.groupby("shard"):
        assert sorted(some.slot) == list(range(len(some)))


def test_shuffle_is_uniform(spark):
    rows, seeds = 12, 240
    where = np.zeros((rows, 4))
    together, order = 0, 0
    tables = [sharding.shuffle(spark.range(rows).repartition(3), 4, seed=s).select("id", "shard", "slot") for s in range(0, seeds, 10)]
    for df in tables:
        out = {r.id: (r.shard, r.slot) for r in df.collect()}
        for i, (shard, _) in out.items():
            where[i, shard] += 1
        together += sum(out[a][0] == out[b][0] for a, b in itertools.combinations(range(rows), 2))
        order += sum(out[a] < out[b] for a, b in itertools.combinations(range(rows), 2))
    n, pairs = len(tables), math.comb(rows, 2)
    assert ((where - n / 4) ** 2 / (n / 4)).sum() < 80  # chi square, about 33 degrees of freedom
    assert abs(together / (n * pairs) - 2 / 11) < 0.06 and abs(order / (n * pairs) - 0.5) < 0.08


def test_shards_odd(spark, odd):
    out = sharding.assign(odd).toPandas()
    assert len(out) == odd.count() and sorted(out["size"])[:2] == [8, 8] and out.grown_shard.isna().all()
    texts = {(t or "") for (t,) in odd.select("text").collect()}
    assert {(r.size, r.text_crc32) for r in out[["size", "text_crc32"]].itertuples()} == {(8 + len(t.encode()), zlib.crc32(t.encode())) for t in texts}
    assert sharding.assign(odd.limit(0)).count() == 0
    clash = odd.withColumns({c: F.lit("mine") for c in ("part_", "rank_", "home_", "at_")})
    both = sharding.shuffle(clash, 3)
    assert both.columns == [*clash.columns, "shard", "slot"] and both.where("key_ = 'z' and part_ = 'mine' and at_ = 'mine'").count() == odd.count()


def test_shards_have_no_python_on_their_way(spark):
    plan = sharding.assign(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    back = sharding.write(spark.range(500), f"{tmp_path}/shards", 5)
    assert back.count() == 500 and [r["count"] for r in back.groupBy("shard").count().collect()] == [100] * 5


# ---- search ----------------------------------------------------------------------------------------------------------


def terms_of(text):
    return [m.translate(str.maketrans(search.UPPER, search.LOWER)) for m in TERM.findall(text or "")]


def brute_search(docs, items, top=10):
    bags = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    by_item = collections.defaultdict(set)
    for i, t in items:
        by_item[i] |= set(terms_of(t))
    out = []
    for item, terms in by_item.items():
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            scores.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    zipf = lambda n: " ".join(f"{'T' if x % 3 else 't'}{x}" for x in np.minimum(rng.zipf(1.3, n), 400))
    docs = [(int(i), zipf(int(rng.integers(0, 60)))) for i in range(400)]
    docs += docs[:30]  # repeated rows, so ties
    items = [(k, zipf(int(rng.integers(0, 15)))) for k in range(25)]
    df, it = frame(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id int, text string")
    got = sorted((tuple(r) for r in search.search(df, it, top=4).collect()), key=str)
    assert got == brute_search(docs, items, 4)


def test_search_in_blocks_and_small_buckets(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    monkeypatch.setattr(search, "BLOCK_TERMS", 120)
    monkeypatch.setattr(search, "BUCKET_ROWS", 7)
    monkeypatch.setattr(search, "FEW", 0)
    out = search.search(spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_search(docs, items)


def test_search_odd(spark, odd):
    items = [("a", "ONE same words"), ("a", "a b"), ("b", None), ("c", " .,;"), ("d", "nowhere"), ("e", "ünïcode WöRTER")]
    it = spark.createDataFrame(items, "item_id string, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in search.search(odd, it).collect()), key=str)
    assert got == brute_search(docs, items) and {r[0] for r in got} == {"a", "e"}
    assert search.search(odd.limit(0), it).count() == 0 and search.search(odd, it.limit(0)).count() == 0


def test_search_counts_a_long_text_whole(spark):
    docs = [(1, "needle " + "hay " * 400_000 + "needle"), (2, "needle " + "straw " * 10), (3, "straw")]
    got = [tuple(r) for r in search.search(frame(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame([(0, "needle")], "item_id int, text string")).collect()]
    assert sorted(got) == brute_search(docs, [(0, "needle")])
