"""What the corpus operators share when they run on Spark: table reading, cut lineage, shared folders, bounded filters."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
DEFAULT_BATCH, BATCH_ROWS = 10_000, 2_000  # rows of whole texts that go to Python at once, where the session says nothing else
_shipped: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package when it may not be on their path. Once a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    with tempfile.NamedTemporaryFile(suffix=".zip", delete=False) as file:
        path = Path(file.name).with_name(f"{PACKAGE.name}-{uuid.uuid4().hex[:8]}.zip")
    Path(file.name).unlink()
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one of our own serves a driver that
    is its own executor; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyforge-")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder, without lineage. Spark deletes the files once no table refers to
    them any more, unless the session says that it shall not."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, owned: bool = True) -> DataFrame:
    """The same rows as a compressed columnar table in the shared folder; for rows that are wide or read more than once.
    Where a run owns what its operators store, the table goes with it, unless ``owned`` is off."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    out = _written(df, path)
    if _owners and owned:
        _owners[-1]._tables.append((out, path))
    return out


_owners: list[Scratch] = []  # runs that delete also what the operators they call return


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables and broadcasts of one operator's run; leaving the block deletes them, so what the operator returns must
    have been stored outside. With ``owns`` the tables that operators return inside the block are deleted too."""

    def __init__(self, spark: SparkSession, owns: bool = False):
        self.spark, self.owns = spark, owns
        self._tables: list[tuple[DataFrame, str]] = []
        self._broadcasts: list = []

    def __enter__(self) -> Scratch:
        tidy(self.spark)
        if self.owns:
            _owners.append(self)
        return self

    def __exit__(self, *failure) -> None:
        if self.owns:
            _owners.remove(self)
        self.drop(*(df for df, _ in self._tables))
        for sent in self._broadcasts:
            sent.destroy()
        self._broadcasts = []
        tidy(self.spark)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        out = _written(df, path)
        self._tables.append((out, path))
        return out

    def broadcast(self, value):
        sent = self.spark.sparkContext.broadcast(value)
        self._broadcasts.append(sent)
        return sent

    def bits(self, df: DataFrame, key: str):
        """A broadcast of ``hash_bits``."""
        return self.broadcast(hash_bits(df, key))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        gone = [path for df, path in self._tables if any(df is x for x in tables)]
        self._tables = [(df, path) for df, path in self._tables if path not in gone]
        context = self.spark.sparkContext
        for name in gone:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and plans that nothing refers to any more, of which it learns when the
    driver collects its garbage, and give the C library's free memory back to the system, where the JVM can: the
    hundreds of threads that run stages leave it in pieces."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # other C libraries have no such command
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = [bean, "systemTrimNativeHeap", None, None]
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        values = gateway.new_array(jvm.Object, len(given))
        for i, value in enumerate(given):
            values[i] = value
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    """A batch from numpy arrays, lists or arrow arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def lists(rows: np.ndarray) -> pa.ListArray:
    """A list column from the rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.reshape(-1))


def map_groups(df: DataFrame, key: str, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, size: int = 1 << 20) -> DataFrame:
    """mapInArrow over batches of whole groups of equal ``key``, a long, sorted by it and of about ``size`` bytes, or one
    larger group. Groups must be bounded."""
    ship(df.sparkSession)
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for batch in batches:
            while batch.num_rows:  # a batch may be much larger than what is wanted
                step = max(1, min(batch.num_rows, int(batch.num_rows * size / max(batch.nbytes, 1))))
                part, batch = batch.slice(0, step), batch.slice(step)
                held.append(part)
                bytes_held += part.nbytes
                if bytes_held >= size:
                    table = pa.Table.from_batches(held)
                    keys = table.column(at).to_numpy()
                    whole = int(np.searchsorted(keys, keys[-1]))
                    if whole:
                        yield from function(_one(table.slice(0, whole)))
                    held = table.slice(whole).to_batches()
                    bytes_held = sum(x.nbytes for x in held) if whole else 0  # a group that goes on is looked at again after as much more
        if held and sum(x.num_rows for x in held):
            yield from function(_one(pa.Table.from_batches(held)))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _one(table: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], table.column_names)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


LEAST_BITS, MOST_BITS = 20, 26


def hash_bits(df: DataFrame, key: str) -> np.ndarray:
    """A bit array with the bits of the keys set, as 64-bit words; about 32 bits a key, between 2**20 and 2**26 in all.

    Its size is bounded whatever the number of keys, so it may be broadcast; a test against it has no false negatives
    and, as keys grow beyond some 30 million, more false positives, so it only ever saves work before an exact join."""
    log2 = min(MOST_BITS, max(LEAST_BITS, (32 * df.count()).bit_length()))
    words = (
        df.select(F.pmod(F.col(key), F.lit(1 << log2)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    )
    out = np.zeros(1 << (log2 - 6), np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def has_bit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which unsigned keys may be in the set."""
    bit = key & np.uint64(len(bits) * 64 - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Rows of one id and one text get one key; other rows differ."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(text_col))
