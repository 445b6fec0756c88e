"""A deterministic sharded WARC writer and its reader.

Records are cut into shards by ranges of their id, so that every shard holds about the same bytes; each shard is sorted
and streamed through one task, which rolls to a new file when the compressed size passes a limit.  Files are written
under temporary names of the task's own; the commit renames those that the finished job reports and then writes the
manifest, so a lost executor or a second attempt leaves nothing visible.  Nothing in a file depends on the run.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _run as R

NAMESPACE = uuid.UUID("8c0f5b3e-53a5-4b44-9c39-2f7a1c0d6e11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BINS = 4096
RECORD_BYTES = 600  # about what a record takes besides its payload
FEW_GROUPS = 200_000  # so many groups of equal payloads, of some 100 bytes each, are sent to every task
MOVERS, FEW_FILES = 16, 1000


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}|{digest}|{copy}')}>"


def encode_record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, copy: int, date: str, level: int, digest: str | None = None, size: int | None = None) -> bytes:
    """One gzip member with one record; a revisit has no payload but the digest and length of the full one, which must
    be given where ``payload`` is not that payload."""
    digest = digest or base32_sha1(payload)
    size = len(payload) if size is None else size
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:unknown"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {size}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


STEP = 1 << 14  # bytes given to a member's decompressor at once; what follows the member is handed back


def decode_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; raises where a length or a digest does not agree."""
    rest, at = memoryview(data), 0
    while at < len(rest):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof and at < len(rest):
            parts.append(inflate.decompress(rest[at : at + STEP]))
            at += STEP
        if not inflate.eof:
            raise ValueError("an archive ends inside a record")
        at = min(at, len(rest)) - len(inflate.unused_data)
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = body[:size]
        if lines[0] != "WARC/1.1" or body[size:] != b"\r\n\r\n" or len(block) != size or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
        yield fields, block


def _binned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin_", F.expr("cast((cast(id as decimal(38,0)) - from_) div width_ as long)"))


def _shards(narrow: DataFrame, shard_bytes: int) -> tuple[list[DataFrame], int, int, int]:
    """Tables that lead an id to its shard, the least id, the first table's width of a bin, and the number of shards.

    Ids are counted in equal-width bins, at most BINS of them; a bin of more than a shard is cut into bins again, until it
    holds one id. So ids may lie as they like, and the driver holds a row for each bin that has records."""
    spark = narrow.sparkSession
    low, high = narrow.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    width = -(-(high - low + 1) // BINS)
    state = narrow.where("id is not null").select("id", "size", F.lit(low).cast("long").alias("from_"), F.lit(width).cast("long").alias("width_"))
    spans, levels, leaves = {low: (high, width)}, [], []
    while spans:
        counted = _binned(state).groupBy("from_", "bin_").agg(F.sum(F.col("size") + RECORD_BYTES).alias("bytes")).collect()
        spans_next, level = {}, []
        heavy = max(1, sum(r.bytes > shard_bytes for r in counted))
        for a, k, size in counted:
            start, stop = a + k * spans[a][1], min(spans[a][0], a + (k + 1) * spans[a][1] - 1)
            again = size > shard_bytes and start < stop
            level.append((a, k, start, again))
            if again:
                spans_next[start] = stop, -(-(stop - start + 1) // max(2, BINS // heavy))
            else:
                leaves.append((start, size))
        levels.append(level)
        spans = spans_next
        if spans:
            onward = [(a, k, start, spans[start][1]) for a, k, start, again in level if again]
            state = _binned(state).join(F.broadcast(spark.createDataFrame(onward, "from_ long, bin_ long, next_ long, then_ long")), ["from_", "bin_"])
            state = state.select("id", "size", F.col("next_").alias("from_"), F.col("then_").alias("width_"))
        levels[-1] = [(a, k, start, spans[start][1] if again else None) for a, k, start, again in level]
    total, shard, at = 0, -1, {}
    for start, size in sorted(leaves):
        if shard < 0 or total + size > shard_bytes:
            shard, total = shard + 1, 0
        at[start] = shard
        total += size
    tables = [spark.createDataFrame([(a, k, None if wide else at[start], start, wide) for a, k, start, wide in level], "from_ long, bin_ long, at_ int, next_ long, then_ long") for level in levels]
    return tables, low, width, max(1, shard + 1)


def _placed(rows: DataFrame, tables: list[DataFrame], low: int, width: int) -> DataFrame:
    """With the shard of each row; null ids are in the first."""
    rows = rows.withColumn("from_", F.lit(low).cast("long")).withColumn("width_", F.lit(width).cast("long")).withColumn("shard", F.lit(None).cast("int"))
    for table in tables:
        rows = _binned(rows).join(F.broadcast(table), ["from_", "bin_"], "left").withColumn("shard", F.coalesce("shard", "at_"))
        rows = rows.drop("from_", "bin_", "width_", "at_").withColumnsRenamed({"next_": "from_", "then_": "width_"})
    return rows.withColumn("shard", F.coalesce("shard", F.lit(0))).drop("from_", "width_")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> list[dict]:
    """Write the archives and return their manifest: file, shard, records, bytes, sha256, in order.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the
    others revisit it; of equal ids with equal payloads the first by url is the response. Null payloads are empty, null
    ids are smaller than any other, null urls become ``urn:unknown``, other columns are ignored, whatever their names,
    and an empty table gives an empty manifest. Ids are whole numbers; records of one id, however many, are one shard.
    A payload is held whole in memory, one at a time.

    Groups of equal payloads are met by digest alone, pre-aggregated. The records are shuffled once, each shard to a task
    of its own; while the groups are few enough to be sent to every task, revisits leave their payloads behind.
    """
    with R.Scratch(pages.sparkSession) as scratch:
        return _write(pages, scratch, folder, id_col, url_col, html_col, min_bytes, shard_bytes, roll_bytes, date, level)


def _write(pages: DataFrame, scratch: R.Scratch, folder: str, id_col: str, url_col: str, html_col: str, min_bytes: int, shard_bytes: int, roll_bytes: int, date: str, level: int) -> list[dict]:
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    narrow = scratch.stored(pages.select("id", "digest", "size"), "records")
    groups = narrow.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = scratch.stored(groups.select("digest", "size", F.struct("chosen").alias("group")), "groups")
    few = groups.count() <= FEW_GROUPS
    no_group = F.lit(None).cast("struct<chosen: bigint>")
    if few:
        rows = pages.join(F.broadcast(groups), ["digest", "size"], "left")
        leaves = F.col("group").isNull() | F.col("group.chosen").eqNullSafe(F.col("id"))
        rows = rows.select("id", F.lit(1).alias("kind"), "digest", "size", "url", F.when(leaves, F.col("html")).alias("html"), "group")
    else:  # a row ahead of an id's records says which of their digests are in a group
        hints = narrow.join(groups, ["digest", "size"]).select("id", "digest", "size", "group").distinct()
        rows = hints.select("id", F.lit(0).alias("kind"), "digest", "size", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "group")
        rows = rows.unionByName(pages.select("id", F.lit(1).alias("kind"), "digest", "size", "url", "html", no_group.alias("group")))
    tables, low, width, n = _shards(narrow, shard_bytes)
    rows = _placed(rows, tables, low, width).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "kind", "digest", "url")
    run = uuid.uuid4().hex
    store, base = _store(folder)
    store.create_dir(f"{base}/_tmp-{run}", recursive=True)

    def shard_writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        attempt, done = uuid.uuid4().hex, []
        shard = out = seal = None
        part = size = records = copy = 0
        hints: dict[str, dict] = {}
        before: tuple | None = None
        temp = ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"part-{shard:06d}-{part:04d}.warc.gz", temp, int(shard), records, size, seal.hexdigest()))
            out = None

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if row["shard"] != shard:
                    close()
                    shard, part, before = row["shard"], -1, None
                if before is None or row["id"] != before[0]:
                    hints = {}
                if not row["kind"]:
                    hints[row["digest"]] = row["group"]
                    before = (row["id"], "")
                    continue
                copy = copy + 1 if before == (row["id"], row["digest"]) else 0
                before = (row["id"], row["digest"])
                group = row["group"] or hints.get(row["digest"])
                target = group["chosen"] if group else None
                revisit = group is not None and (target != row["id"] or copy > 0)
                if out is None or size >= roll_bytes:
                    close()
                    part, size, records, seal = part + 1, 0, 0, hashlib.sha256()
                    temp = f"{base}/_tmp-{run}/{shard:06d}-{part:04d}-{attempt}"
                    out = store.open_output_stream(temp)
                text = lambda x: None if x is None else str(x)
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                data = encode_record(text(row["id"]), row["url"], row["html"] or b"", text(target), revisit, copy, date, level, digest, row["size"])
                out.write(data)
                seal.update(data)
                size, records = size + len(data), records + 1
        close()
        columns = list(zip(*done, strict=True)) or [[] for _ in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "temp", "shard", "records", "bytes", "sha256"])

    R.ship(spark)
    written = rows.mapInArrow(shard_writer, "file string, temp string, shard long, records long, bytes long, sha256 string").collect()
    return _commit(folder, run, sorted(written))


def _commit(folder: str, run: str, written: list) -> list[dict]:
    """Rename what the job reported, then publish the manifest, itself by a rename, and drop what attempts left behind."""
    store, base = _store(folder)
    with ThreadPoolExecutor(MOVERS) as movers:
        list(movers.map(lambda w: store.move(w[1], f"{base}/{w[0]}"), written))
    manifest = [{"file": file, "shard": shard, "records": records, "bytes": size, "sha256": sha} for file, _, shard, records, size, sha in written]
    with store.open_output_stream(f"{base}/_tmp-{run}/manifest") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    store.move(f"{base}/_tmp-{run}/manifest", f"{base}/manifest.json")
    store.delete_dir(f"{base}/_tmp-{run}")
    return manifest


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """One row for each record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Every block's digest and length are checked, and for responses the payload's too. An empty manifest gives no rows;
    repeated records give a row each; a file, of ``roll_bytes`` and one record at most, is held whole in memory."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    if not manifest:
        return spark.createDataFrame([], schema)
    base = folder.rstrip("/")
    if len(manifest) <= FEW_FILES:
        files = spark.read.format("binaryFile").load([f"{base}/{m['file']}" for m in manifest]).select("content")
    else:  # the folder is listed once, by Spark; the manifest says which of its files count
        named = spark.createDataFrame([(m["file"],) for m in manifest], "file string")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(base)
        files = files.join(F.broadcast(named), F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi").select("content")

    def parse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column(0):
            found = []
            for fields, block in decode_records(content.as_py()):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2]
                if fields["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than it says")
                number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                found.append((number("X-Page-ID"), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number("X-Refers-To-Page"), fields["WARC-Target-URI"]))
            columns = list(zip(*found, strict=True)) or [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    return R.map_arrow(files, parse, schema)
