"""The REST source against a server inside the test, VARIANT texts, point lookups by row group, shots and ratings by brute force."""

import http.server
import json
import threading
import urllib.parse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import joins
from tallyforge.plans import seasons, wholes
from tallyforge.sources import files, rest, sinks

SF = "/root/testdata/sf0.001"


class Server(http.server.BaseHTTPRequestHandler):
    """Items by team and season; the first request of each address is refused with 429, large pages fail, and one team's
    address fails for good and has to be asked of the fallback."""

    items = {("BOS", "2020"): 37, ("NYR", "2020"): 25, ("BOS", "2021"): 12, ("NYR", "2021"): 0}
    asked: list = []
    seen: set = set()

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        key, start, limit = (q["team"], q["season"]), int(q["start"]), int(q["limit"])
        type(self).asked.append((url.path, *key, start, limit))
        status = 429 if self.path not in self.seen else 400 if limit > 10 else 404 if url.path == "/main" and key == ("NYR", "2020") else 200
        self.seen.add(self.path)
        body = json.dumps({"data": [{"i": i, "by": url.path} for i in range(start, min(start + limit, self.items[key]))], "total": self.items[key]}).encode()
        self.send_response(status)
        self.end_headers()
        if status == 200:
            self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def address():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.asked, Server.seen, Server.items = [], set(), dict(Server.items)
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def options(reader, address):
    return reader.options(url=f"{address}/main", fallback=f"{address}/spare", teams="BOS,NYR", seasons="2020,2021", limit="20", least="4", factor="0.01")


def test_rest_source_reads_pages_retries_and_falls_back(spark, address):
    rest.register(spark)
    rows = options(spark.read.format("paged_rest"), address).load().collect()
    got = {}
    for r in rows:
        got.setdefault((r.team, r.season), []).append(json.loads(r.item))
    assert {k: [x["i"] for x in v] for k, v in got.items()} == {k: list(range(n)) for k, n in Server.items.items() if n}
    assert {x["by"] for x in got["NYR", "2020"]} == {"/spare"} and {x["by"] for x in got["BOS", "2020"]} == {"/main"}


def test_rest_filters_leave_out_partitions(spark, address):
    rest.register(spark)
    df = options(spark.read.format("paged_rest"), address).load()
    assert df.where("team = 'BOS' and season in ('2021', '2019') and item like '%1%'").count() == len([i for i in range(12) if "1" in json.dumps({"i": i})])
    assert {x[1:3] for x in Server.asked} == {("BOS", "2021")}


def test_rest_stream_goes_on_after_the_last_page(spark, address, tmp_path):
    rest.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = options(spark.readStream.format("paged_rest"), address).option("limit", "10").load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(out)
        for _ in range(240):
            q.awaitTermination(0.5)
            done = len([p for p in q.recentProgress if p["numInputRows"] == 0]) > 0 and sum(p["numInputRows"] for p in q.recentProgress) > 0
            if done:
                break
        q.stop()
        return spark.read.parquet(out).count()

    assert run() == sum(Server.items.values())
    before = len(Server.asked)
    Server.items["NYR", "2021"] = 3
    Server.items["BOS", "2020"] += 5
    assert run() == sum(Server.items.values())
    later = {x[1:4] for x in Server.asked[before:]}
    assert all(start >= {("BOS", "2020"): 27, ("NYR", "2020"): 15, ("BOS", "2021"): 2}.get((t, s), 0) for t, s, start in later)
    Server.items["NYR", "2021"], Server.items["BOS", "2020"] = 0, 37


def test_variants_set_malformed_texts_aside(spark):
    texts = ['{"plays": [{"a": {"b": 1}, "t": " "}, {"x": "7", "t": "go"}]}', '{"items": [{"x": null, "a": {"b": 2.5}}]}', '{"plays": [', None, "[]", '{"plays": "none"}']
    df = spark.createDataFrame(list(enumerate(texts)), "g int, json string")
    good, bad = files.set_aside(df, "json")
    assert [r.g for r in bad.collect()] == [2] and good.count() == 5
    fields = {"n": ("$.a.b", "$.x"), "t": ("$.t",)}
    paths = ["$.plays", "$.items"]
    rows = sorted((r.g, r.item_seq, r.n, r.t) for r in files.explode_variant(df, "json", paths, fields, ["g"]).collect())
    assert [(g, i, float(n) if n else None, t) for g, i, n, t in rows] == [(0, 0, 1.0, None), (0, 1, 7.0, "go"), (1, 0, 2.5, None)]
    plain = sorted((r.g, r.item_seq, r.n, r.t) for r in files.explode_alternatives(good.where("g < 2"), "json", paths, fields, ["g"]).collect())
    assert [(g, i, float(n), t) for g, i, n, t in plain] == [(g, i, float(n), t) for g, i, n, t in rows]


def test_point_lookups_read_one_row_group(spark, tmp_path):
    path = str(tmp_path / "sorted")
    df = spark.range(60_000).select((F.col("id") * 2).alias("key"), F.concat(F.lit("value of some length "), F.sha2(F.col("id").cast("string"), 256)).alias("v"))
    sinks.sorted_for_lookup(df, path, "key", 3, 256 << 10)
    groups = [(f, g) for f in sorted((tmp_path / "sorted").glob("*.parquet")) for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 6

    def holding(key):
        """Row groups that neither bounds nor the Bloom filter rule out, by what Spark reports to have read."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        out = seasons.player_row(spark.read.parquet(path).withColumnRenamed("key", "playerId"), key)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        metrics = plan.collectLeaves().head().metrics()
        return len(rows), metrics.get("numOutputRows").get().value()

    found, read = holding(50_000)
    assert found == 1 and read < 60_000 / 6  # one group of one file, not the table
    found, read = holding(50_001)  # within the bounds of a group, but the Bloom filter says no
    assert (found, read) == (0, 0)
    columns = [pq.ParquetFile(f).metadata.row_group(g).column(0) for f, g in groups]
    assert all(c.statistics.has_min_max for c in columns)


def test_shots_on_shifts_against_brute_force(spark):
    plays, shifts, _, _ = wholes._game_tables(spark, SF)
    scored, out, model = seasons.shot_values(plays, shifts)
    assert model is not None and len(model.coefficients) == 6
    shots = scored.where("isFenwick").select("gameId", "period", "eventSec", "teamAbbrev", "xG").toPandas()
    assert ((shots.xG > 0) & (shots.xG < 1)).all() and scored.where("not isFenwick and xG <> 0").count() == 0
    got = out.toPandas()
    assert len(got) == shifts.count()
    by_game = dict(list(shots.groupby("gameId")))
    for r in got.sample(300, random_state=1).itertuples():
        s = by_game.get(r.gameId)
        on = s[(s.eventSec >= r.startSec) & (s.eventSec < r.endSec)] if s is not None else shots.head(0)
        own, other = on[on.teamAbbrev == r.teamAbbrev], on[on.teamAbbrev != r.teamAbbrev]
        assert (r.fenwickF, r.fenwickA) == (len(own), len(other))
        assert r.shift_xGF == pytest.approx(own.xG.sum()) and r.shift_xGA == pytest.approx(other.xG.sum())


def test_active_counts_agree_with_sweeps(spark):
    rng = np.random.default_rng(0)
    spans = spark.createDataFrame([(1, int(w), int(a), int(a + n)) for w, a, n in zip(rng.integers(0, 9, 40), rng.integers(0, 200, 40), rng.integers(1, 60, 40))], "g int, who int, a long, b long")
    points = spark.createDataFrame([(1, i, int(t)) for i, t in enumerate(rng.integers(0, 260, 50))], "g int, i int, t long")
    counts = {r.i: r.n_active for r in joins.active_counts_at(points, spans, ["g"], ["i"], "t", "a", "b", "who").collect()}
    sets = {r.i: len(r.active) for r in joins.active_set_at(points, spans, ["g"], ["i"], "t", "a", "b", "who", 30.0).collect()}
    assert counts == sets
