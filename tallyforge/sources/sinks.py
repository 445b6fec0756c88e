"""Sinks: season partitions, appends, versioned tables, quarantine, reuse by content, cut lineage (K1-K7)."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ("season",)) -> None:
    """K1: replace the partitions that the frame holds, and no others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*[c for c in partition_by if c in df.columns]).parquet(path)


def sorted_for_lookup(df: DataFrame, path: str, key: str, files: int | None = None, row_group_bytes: int = 8 << 20) -> None:
    """D3: a layout for point lookups: cut by range of the key into files, sorted in each, in small row groups that carry
    the least and greatest key and a Bloom filter of the keys. A filter on the key reads the one group that may hold it."""
    dealt = df.repartitionByRange(files, F.col(key)) if files else df.repartitionByRange(F.col(key))
    writer = dealt.sortWithinPartitions(key).write.option("parquet.block.size", row_group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("parquet.page.row.count.limit", 1000).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """K2."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str, **options) -> None:
    """K1 at a CSV boundary: arrays become text joined by semicolons (X29), and a header goes first."""
    text = [F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*text).write.mode("overwrite").options(header=True, **options).csv(path)


def new_version(df: DataFrame, root: str) -> str:
    """K3, K4: a new version beside the ones that the frame may be read from; returns its path. The commit protocol
    makes a version visible whole or not at all."""
    path = f"{root.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


# ---- files of any store ---------------------------------------------------------------------------------------------


class _Store:
    """The file system of a path, as Hadoop knows it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Create a file with its whole content, unless there is one: of several that try, one gets it. Local files are
        linked into place, which fails where the name is taken; elsewhere a rename does."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.fs.getScheme() == "file":
            local = [re.sub(r"^file:(//)?", "", x) for x in (draft, name)]
            with open(local[0], "w") as file:
                file.write(text)
            try:
                os.link(*local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(local[0])
        self.write(draft, text)
        if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(draft), self.path(name)):
            self.fs.delete(self.path(draft), False)
            return False
        return True


# ---- versioned tables -----------------------------------------------------------------------------------------------


class VersionConflict(RuntimeError):
    """Someone else committed the version that was to be committed."""


class VersionedTable:
    """K3, K4: a table whose versions are manifests, ``<root>/_versions/<number>.json``, that name the folders of their
    rows. A commit writes the rows beside the others and then claims the next number; of two writers that started from
    one version the second to claim fails and its rows belong to no version. A reader holds to the version that it began
    with, so it never sees a mixture, and a table may be rewritten from itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._store = _Store(spark, self.root)
        self._store.fs.mkdirs(self._store.path(f"{self.root}/_versions"))

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_versions/{version:020d}.json"

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        numbers = [int(n[:20]) for n in self._store.names(f"{self.root}/_versions") if re.fullmatch(r"\d{20}\.json", n)]
        return max(numbers, default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless one is named."""
        version = self.version() if version is None else version
        if not version:
            raise AnalysisException(f"{self.root} has no version yet")
        found = json.loads(self._store.read(self._manifest(version)))
        return self.spark.read.schema(found["schema"]).parquet(*[f"{self.root}/{d}" for d in found["folders"]])

    def commit(self, df: DataFrame, base: int, mode: str = "overwrite") -> int:
        """Make ``df`` the rows of version ``base`` + 1, or with ``append`` add them to those of ``base``."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        before = json.loads(self._store.read(self._manifest(base)))["folders"] if mode == "append" and base else []
        text = json.dumps({"folders": [*before, folder], "schema": ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)})
        if not self._store.claim(self._manifest(base + 1), text):
            self._store.fs.delete(self._store.path(f"{self.root}/{folder}"), True)
            raise VersionConflict(f"version {base + 1} of {self.root} is there already")
        return base + 1


def quarantine(df: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K5: the rows that have no accepted partner, null keys meeting null keys."""
    marked = accepted.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(marked, on, "left_anti")


# ---- reuse ----------------------------------------------------------------------------------------------------------


def reused(spark: SparkSession, path: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """K6: the table if it was written before, else built, written and read."""
    if not again:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(df: DataFrame) -> str:
    """A key of what a frame computes and from what: its plan, and name, size and time of each input file."""
    spark = df.sparkSession
    limit = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 1_000_000)  # names of columns are not to be left out
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.set(limit, before)
    digest = hashlib.sha256(f"{plan}\n{df.semanticHash()}\n{df.schema.json()}".encode())
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    files = set(df.inputFiles())
    for folder in folders:
        store = _Store(spark, folder)
        for s in store.fs.listStatus(store.path(folder)):
            name = f"{folder}/{s.getPath().getName()}"
            if name in files:
                digest.update(f"{name} {s.getLen()} {s.getModificationTime()}\n".encode())
    return digest.hexdigest()


def reused_by_content(df: DataFrame, root: str | None = None) -> DataFrame:
    """K6: the rows of ``df`` from a table that was written for the same plan over the same files, else written now. A
    changed file or plan has another key and so another table. Written beside and renamed into place, so that a reader
    finds it whole or not at all. ``root`` is the shared folder unless named."""
    spark = df.sparkSession
    root = (root or f"{shared_dir(spark).rstrip('/')}/reuse").rstrip("/")
    path = f"{root}/{content_key(df)}"
    store = _Store(spark, root)
    if not store.fs.exists(store.path(path)):
        draft = f"{root}/.draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        if store.fs.exists(store.path(path)) or not store.fs.rename(store.path(draft), store.path(path)):
            store.fs.delete(store.path(draft), True)
    return spark.read.schema(df.schema).parquet(path)


# ---- cut lineage ----------------------------------------------------------------------------------------------------

CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one serves a driver that is its
    own executor, and on a cluster its absence is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyforge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder, without lineage; for what several steps read. Spark deletes the
    files once no frame refers to them any more."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and cut rows that no frame refers to any more; it learns of them when the driver
    collects its garbage, which on a large heap may be after the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A counted frame, to be sent to every task where it has up to ``most`` rows, and else to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
