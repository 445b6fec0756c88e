"""The pipeline's stages by their rules, on the smallest tables."""

import re

import corpus_pipeline
from tests.compare import duck

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= left, name
        left = now
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    lines = [line for t in texts for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    assert len(set(lines)) == len(lines)
    con = duck(SF)
    windows = set()
    for (t,) in con.sql("SELECT text FROM benchmark").fetchall():
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))}
    for t in texts:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hit = set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        assert 20 * len(hit) < len(w) or not hit
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(out) == left and (out.taken <= 2 * out["size"]).all()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_and_repeats(spark):
    good = " ".join(f"word{i} runs along" for i in range(40))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, None, None, None, None), (None, good + " and on it goes", "en", None, 2), (3, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert 1 <= docs.count() <= 2


def test_clashing_names_ties_and_long_texts(spark):
    """Columns that stages might use themselves keep their values; copies go one by one; a long text comes through whole."""
    words = [f"word{i} runs" for i in range(60)]
    long = "\n".join(f"line number {i} says {i * i} and {i * 7} of it" for i in range(40_000))
    texts = [" ".join(words), " ".join(words), " ".join(f"tree{i} grows" for i in range(60)), long]
    names = ["key_", "removed_", "copy", "id", "node", "class_id", "rejected", "contaminated", "n_words", "part_", "root"]
    kinds = ", ".join(f"{n} string" for n in names)
    rows = [(i, t, "en", "a", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        for r in docs.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], name
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {0, 2, 3} and left[0].text == texts[0]  # of equal lines the first stays
    assert left[3].n_chars == len(left[3].text) > 0


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
