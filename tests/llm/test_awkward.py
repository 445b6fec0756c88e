"""Cases that every corpus operator shares: very long texts, hashes of regular strings, ids of any type, files left behind."""

import gc
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import _run as R
from tallyforge.llm import _similar, _vec, decontaminate, language, licenses, line_dedup, mixing, near_duplicates, periodic, quality_model, quality_rules, queries, search, sharding, substring_dedup, warc
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n: int, letters: str = "ab") -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_strings_keep_their_hashes_apart(n):
    pairs = [thue_morse(n), thue_morse(n, "ba"), *(thue_morse(n).replace("a", x).replace("b", y) for x, y in (("xyz", "pqr"), ("word ", "more ")))]
    block = next(_vec.blocks(pa.array(pairs), size=1 << 24))[2]
    assert len(set(block.hashes(block.start, block.stop).tolist())) == len(pairs)


def test_hashes_are_those_of_the_bytes_alone():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(0, 30, 300)]
    block = next(_vec.blocks(pa.array(texts), size=1 << 24))[2]
    hashes = block.hashes(block.start, block.stop).tolist()
    assert len(set(hashes)) == len(set(texts)) == len(set(zip(texts, hashes)))


def test_lines_that_differ_are_not_repeated_lines(spark):
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    docs = frame(spark, ["\n".join([a, b]), "\n".join([a, b, a])])
    assert [r.n_dup_lines for r in quality_rules.apply_rules(docs).orderBy("doc_id").collect()] == [0, 1]
    kept = {r.doc_id: r.removed for r in line_dedup.decide(docs).collect()}
    assert 0 in kept and len(kept[0]) <= 1  # alike by shingles or not, but never one and the same line


def test_quality_model_with_ids_of_text(spark):
    docs = frame(spark, ["good words here", "bad ###", None, "tie", "tie"]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([("d0", 1, 0), ("d1", 0, 0), ("d1", 0, 1)], "doc_id string, quality int, toxic int")
    out = quality_model.classify(docs, labels).toPandas()
    assert sorted(out.doc_id) == ["d0", "d1", "d2", "d3", "d4"] and out.quality.between(0, 1).all()


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(30_000)])
    return "\n".join(" ".join(words[rng.integers(0, len(words), 12)]) for _ in range(18_000))  # 1.4 MB, over one block


def test_texts_longer_than_a_block(spark, long_text):
    tail = " ".join(f"x{i}" for i in range(60))
    docs = frame(spark, [long_text + "\n" + tail, tail, long_text, "short one"], sources=["a", "a", "b", "b"])
    n = [len(WORD.findall(t)) for t in (long_text + "\n" + tail, tail, long_text, "short one")]
    rules = quality_rules.apply_rules(docs).orderBy("doc_id").toPandas()
    assert rules.n_words.tolist() == n
    removed = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed[2].n_removed == len(long_text.encode()) and removed[3].n_removed == 0
    assert [r["size"] for r in mixing.mix(docs).orderBy("doc_id").collect()] == n
    classes = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert classes == {0: 0, 2: 0, 1: 1, 3: 3}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_model.classify(docs, labels).count() == 4
    grant = licenses.SENTENCES["mit-grant"]
    last = "\n".join([long_text, grant, licenses.SENTENCES["mit-keep"], licenses.SENTENCES["mit-as-is"]])
    assert [r.matches for r in licenses.scan(frame(spark, [last])).collect()] == [["MIT"]]
    items = spark.createDataFrame([("t", tail)], "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert [found[i].n_hit for i in range(4)] == [60, 60, 0, 0] and found[1].contaminated and not found[0].contaminated
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert language.identify(docs, model=model).count() == 4


def test_long_pages_come_back(spark, long_text, tmp_path):
    pages = spark.createDataFrame([(1, "u", long_text), (2, "v", long_text), (3, "w", None), (4, "x", "")], "page_id long, url string, html string")
    folder = f"{tmp_path}/warc"
    out = {r.page_id: r for r in warc.read(spark, folder, warc.write(pages, folder)).collect()}
    assert out[2].payload_bytes == len(long_text.encode()) and out[1].refers_to == 2 and out[3].payload_digest == out[4].payload_digest


def test_ties_of_languages(spark):
    docs = frame(spark, ["aaa bbb"] * 40, langs=["x", "y"] * 20)
    out = language.identify(docs).toPandas()
    assert out.lang_pred.nunique() == 1 and len(out) == 40


@pytest.mark.parametrize("most", [12, 40])
def test_crowds_meet_by_their_rarest_elements(spark, most):
    rng = np.random.default_rng(11)
    base, texts = [f"t{i}" for i in range(300)], []
    for i in range(260):  # one template; words of their own, some shared by pairs, some by tens
        mine = [f"o{i}x{j}" for j in range(30)]
        mine[:14] = [f"p{i // 2}x{j}" for j in range(14)] if i < 60 else mine[:14]
        mine[20:25] = [f"q{i % 10}x{j}" for j in range(5)]
        texts.append(" ".join(base + mine))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    docs = frame(spark, texts)
    plain = near_duplicates.classes(docs).toPandas()
    dealt = near_duplicates.classes(docs, most=most).toPandas()
    sets = lambda df: {frozenset(g) for g in df.groupby("class_id").doc_id.apply(set)}
    assert sets(plain) == sets(dealt) and max(len(g) for g in sets(plain)) >= 2


@pytest.mark.parametrize("weighted", [False, True])
def test_similar_things_share_a_rarest_element(weighted):
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.choice(2**40, 60, replace=False).astype(np.uint64)
        sets = [np.sort(rng.choice(pool, int(rng.integers(1, 40)), replace=False)) for _ in range(6)]
        start = np.append(0, np.cumsum([len(s) for s in sets]))
        weights = [rng.integers(1, 9, len(s)).astype(float) for s in sets]
        elements = (start, np.concatenate(sets), np.concatenate(weights) if weighted else None)
        edge, some = _similar.rarest(elements, rng.integers(0, 9, 1 << 10), 0.6)
        for a in range(6):
            for b in range(a):
                x, y = (dict(zip(sets[i].tolist(), weights[i] if weighted else np.ones(len(sets[i])))) for i in (a, b))
                common = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
                if common >= 0.6 * (sum(x.values()) + sum(y.values()) - common):
                    assert set(some[edge[a] : edge[a + 1]].tolist()) & set(some[edge[b] : edge[b + 1]].tolist())


def tables(folder: str) -> set[str]:
    """Tables and checkpoints that have files, by name."""
    found = set()
    for d, _, names in os.walk(folder):
        if names:
            parts = os.path.relpath(d, folder).split(os.sep)
            found.add("/".join(parts[:2]) if len(parts) > 1 and parts[1].startswith("rdd-") else parts[0])
    return found


RESULT = {
    "op1_quality_rules": set(), "op2_substring_dedup": {"repeats"}, "op3_mix_sources": set(), "op4_near_duplicates": {"near-classes"}, "op5_quality_model": set(), "op7_line_dedup": {"line-decisions"},
    "op8_decontaminate": set(), "op10_warc": {"warc"}, "op11_periodic_runs": set(), "op12_shard": {"sharded"}, "op13_search": {"ranked"}, "pipeline": {"stage-mix"},
}


@pytest.mark.parametrize("name", sorted(RESULT))
def test_only_the_result_stays(spark, name):
    folder = R.shared_dir(spark).removeprefix("file:")
    before = tables(folder)
    out = ({"pipeline": corpus_pipeline.run} | queries.QUERIES)[name](spark, SF)
    assert out.count() > 0
    assert {re.sub(r"-[0-9a-f]{32}$", "", x) for x in tables(folder) - before if "/rdd-" not in x} == RESULT[name]
    del out
    for _ in range(60):  # Spark deletes a checkpoint when the JVM finds that nothing refers to it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        left = {x for x in tables(folder) - before if "/rdd-" in x}
        if not left:
            return
        time.sleep(0.25)
    assert not left, left
