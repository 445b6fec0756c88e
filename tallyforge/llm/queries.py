"""The corpus queries: thin wrappers that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _run as R
from tallyforge.llm import decontaminate, language, licenses, line_dedup, mixing, near_duplicates, periodic, quality_model, quality_rules, search, sharding, substring_dedup, warc


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(R.load(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(R.load(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(R.load(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(R.load(spark, sf_dir, "documents")).drop("node")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(R.load(spark, sf_dir, "documents"), R.load(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(R.load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decide(R.load(spark, sf_dir, "documents")).drop("key")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(R.load(spark, sf_dir, "documents"), R.load(spark, sf_dir, "benchmark")).drop("key")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(R.load(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{R.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(R.load(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, manifest).drop("target_uri")


def cycled(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the contract of operator 11 has every tenth document, by the checksum of its id, repeat a stretch of
    its words; the others, and those of null id, keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n = F.size(w)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    whole = F.concat(F.slice(w, 1, a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))))
    text = F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.slice(whole, 1, n), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(cycled(R.load(spark, sf_dir, "documents")))
    # the greatest exact quotient; the first of equals, as runs come by start and period
    best = F.reduce("runs", F.element_at("runs", 1), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(R.load(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(R.load(spark, sf_dir, "documents"), R.load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_model": op5_quality_model,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_shard": op12_shard,
    "op13_search": op13_search,
}

WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM ws)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, l, count(*) - 1 AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY rid, l),
dup AS (SELECT rid, sum(n)::BIGINT AS n FROM ln GROUP BY rid),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN ws USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT source, unnest([(1, base_failed), (2, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)),
        (3, n_symbols * 10 > greatest(n_words, 1)), (4, n_dup_lines * 10 > greatest(n_words, 1))]) AS r FROM b),
h AS (SELECT source, r[1] AS rule, count(*)::DOUBLE AS n, sum(r[2]::INT)::DOUBLE AS bad FROM f GROUP BY ALL),
g AS (SELECT rule, sum(n) AS docs, count(*)::DOUBLE AS hosts, sum(n * n) AS squares, sum(bad) AS bad, sum(bad * bad / n) AS sq, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS mean FROM h GROUP BY rule),
k AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(CASE WHEN docs - squares / docs - (hosts - 1) > 0
        THEN (sq - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / (docs - squares / docs - (hosts - 1)) ELSE 0 END, 1e-6) - 1, 1), 1e6) AS s FROM g),
ab AS (SELECT source, bad + mean * s AS a, n - bad + (1 - mean) * s AS b FROM h JOIN k USING (rule)),
ok AS (SELECT source, bool_and(a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) <= 0.5) AS host_ok FROM ab GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM b JOIN ok ON b.source IS NOT DISTINCT FROM ok.source""",
    "op3_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
c AS (SELECT source, source_size, (2 * source_size)::DOUBLE AS cap, ([5, 2, 1])[rk % 3 + 1]::DOUBLE AS weight FROM s),
p AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight, 1.5::DOUBLE * sum(source_size) OVER () AS wanted
      FROM c WINDOW w AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT min((wanted - capped) / open_weight) AS level FROM (SELECT * FROM p WHERE weight * ((wanted - capped) / open_weight) <= cap ORDER BY cap / weight, source LIMIT 1)),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM c, lv)
SELECT doc_id, size, source_size, target,
  (floor(floor(target) / greatest(source_size, 1)) * size + greatest(0, least(size, floor(target) - floor(floor(target) / greatest(source_size, 1)) * source_size - before)))::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
    "op8_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
t AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g))),
m AS (SELECT rid, item, t.k, t.n FROM t JOIN g ON t.g = g.g AND t.n = g.n),
hit AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM m)) GROUP BY rid),
it AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS chosen FROM pages),
x AS (SELECT *, sha1(h) AS s FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[((('0x' || substr(s, 5 * j + 1, 5))::INT >> b) & 31)::INT + 1]), '')), '') AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN chosen END AS refers_to
FROM x""",
    "op2_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT rid, s, md5(substr(h, 2 * s + 1, 800)) AS m FROM (SELECT rid, h, unnest(range(0, n - 399)) AS s FROM d)),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
e AS (SELECT rid, s, s > lag(s) OVER (PARTITION BY rid ORDER BY s) + 400 AS gap FROM r),
i AS (SELECT rid, min(s) AS a, max(s) + 400 AS b FROM (SELECT rid, s, count(CASE WHEN gap THEN 1 END) OVER (PARTITION BY rid ORDER BY s) AS k FROM e) GROUP BY rid, k),
g AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM i),
k AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS stop, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE kept || substr(h, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)""",
    "op11_periodic_runs": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS v,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b:
    list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END + 0 * i))), 4294967295) AS h FROM documents),
a AS (SELECT *, len(v) AS n, h % 10 = 0 AND len(v) > 0 AS turns, (h // 10) % greatest(len(v), 1) AS a, 3 + (h // 10) % 8 AS f FROM d),
w AS (SELECT rid, doc_id, n, i, v[CASE WHEN turns AND i >= a THEN a + (i - a) % (1 + (n - a) // f) ELSE i END + 1] AS word
      FROM (SELECT rid, doc_id, v, n, turns, a, f, unnest(range(n)) AS i FROM a)),
g AS (SELECT rid, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS m FROM w),
-- a run of 24 words and 3 periods repeats 16 words after one period; every place and period of such a repeat
e AS (SELECT x.rid, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.rid = y.rid AND x.m = y.m AND y.i > x.i AND 3 * (y.i - x.i) <= x.n AND y.i <= y.n - 16 AND x.i <= x.n - 16),
s AS (SELECT rid, q, min(i) AS s, max(i) - min(i) + 16 + q AS len FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM e) GROUP BY rid, q, k),
r AS (SELECT rid, s, len, min(q) AS q FROM s WHERE len >= greatest(24, 3 * q) GROUP BY rid, s, len),
u AS (SELECT rid, count(*)::BIGINT AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
        first([s, len, q, 1000 * len // q]::BIGINT[] ORDER BY len / q DESC, s, q) AS best FROM r GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = w.rid AND w.i >= r.s + r.q AND w.i < r.s + r.len) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, best[4] AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN u USING (rid) LEFT JOIN k USING (rid)""",
    "op13_search": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT rid, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
x AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, c),
m AS (SELECT rid, doc_id, 10 + (90 * n * nn) // ll AS m FROM d, c),
s AS (SELECT item_id, rid, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM p JOIN q USING (term) JOIN x USING (term) JOIN m USING (rid) GROUP BY item_id, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s JOIN m USING (rid) WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
}
