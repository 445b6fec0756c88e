"""Sources, sinks and streams."""

import io
import json
import urllib.error

from pyspark.sql import functions as F

from tallyforge.sources import files, rest, sinks
from tallyforge.streaming import running


def test_seasons_by_file_name_and_partition(spark, tmp_path):
    for y in (2022, 2023):
        (tmp_path / f"table {y}-{y + 1}.csv").write_text(f"﻿a,b\n{y},x\n")
    df = files.read_seasons(spark, str(tmp_path / "*.csv"), "a int, b string")
    assert sorted(tuple(r) for r in df.select("a", "season").collect()) == [(2022, "2022-2023"), (2023, "2023-2024")]
    assert files.read_csv(spark, str(tmp_path / "table 2022-2023.csv")).columns == ["a", "b"]
    sinks.overwrite(df, str(tmp_path / "t"))
    sinks.overwrite(df.where("a = 2023").withColumn("a", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [9, 2022]
    assert [r.a for r in files.season_partitions(spark, str(tmp_path / "t"), 2023, 2030).collect()] == [9]
    assert files.try_read(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_quarantine_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, k string")
    assert [r.i for r in sinks.quarantine(df, df.where("k is null"), ["k"]).collect()] == [2]
    path = sinks.new_version(df, str(tmp_path / "v"))
    assert spark.read.parquet(path).count() == 2
    assert sinks.reused(spark, str(tmp_path / "r"), lambda: df).count() == 2
    assert sinks.reused(spark, str(tmp_path / "r"), lambda: df.limit(0)).count() == 2


def test_flatten_and_ragged(spark):
    df = spark.createDataFrame([(1, (2, ("x",)))], "a int, b struct<c int, d struct<e string>>")
    assert files.flatten(df).columns == ["a", "b.c", "b.d.e"]
    rag = spark.createDataFrame([(["a"],), (["a", "b", "c"],)], "cells array<string>")
    assert [r.cells for r in files.pad_ragged(rag, "cells", 2).collect()] == [["a", None], ["a", "b"]]


def test_rest_pages_and_retries():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, io.BytesIO())
        return json.dumps({"ok": 1}).encode()

    assert rest.fetch("u", open_url=flaky, sleep=waits.append) == {"ok": 1} and waits == [0.8, 1.6]
    data = [{"i": i} for i in range(25)]

    def ask(start, limit):
        if limit > 10:
            raise urllib.error.HTTPError("u", 400, "too large", {}, io.BytesIO())
        return {"data": data[start : start + limit], "total": 25}

    assert list(rest.pages(ask, limit=20, least=5)) == data


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:00", i % 2, i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "i bigint, at string, k bigint, hit boolean").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running.windowed_sums(stream, "at", "k", "i").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sums").agg(F.sum("n")).first()[0] == 20
    q = running.running_score(stream, "k", "i", "hit").writeStream.outputMode("append").format("memory").queryName("score").start()
    q.processAllAvailable()
    q.stop()
    got = {r.i: r.score for r in spark.table("score").collect()}
    for k in (0, 1):
        n = 0
        for i in range(20):
            if i % 2 == k:
                n += i % 3 == 0
                assert got[i] == n
