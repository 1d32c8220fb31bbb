"""Shared folders, tables written to cut lineage, and Arrow helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one is set only where none is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: recovery from there needs no earlier stage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Words of 64 bits in the bit set of ``split_by_bits``.
BIT_WORDS = 1 << 19


def split_by_bits(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` that may have one of ``ids``, those that have none), without a shuffle of ``df``.

    ``ids`` (one long column, as ``column`` is) become a bit set of at most ``BIT_WORDS`` words, so its broadcast is
    bounded; the more ids, the more other rows are among the first, which only an exact join tells apart.
    """
    name = ids.columns[0]
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BIT_WORDS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{c}`), 40), 64) as int))")
    bits = ids.select(place(name).alias("__bits_at"), bit(name).alias("__bit")).groupBy("__bits_at").agg(F.bit_or("__bit").alias("__bits"))
    told = df.join(F.broadcast(written(bits, "bits")), place(column) == F.col("__bits_at"), "left")
    may = F.coalesce(F.col("__bits").bitwiseAND(bit(column)) != 0, F.lit(False))
    return tuple(told.where(x).select(*[df[c] for c in df.columns]) for x in (may, ~may))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 100):
    """Arrow batches of few rows while a job with large rows runs; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


#: What tasks keep in their worker process for later tasks of their kind, by operator.
kept: dict[str, dict] = {}


def lean(run, keeps: bool = False):
    """``run`` for mapInArrow, in a worker process that gives memory back: first what tasks of other kinds kept there, in
    the end all free pages. Workers live on from task to task, so each would else hold the most that any task took.
    """

    def task(batches):
        from tessera.llm import common  # the module's own, not a copy that came with the task

        if not keeps:
            common.kept.clear()
        try:
            yield from run(batches)
        finally:
            common.give_back()

    return task


def give_back() -> None:
    """Return free pages of Arrow and of the C library to the system, where the latter can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Utf8:
    """A string column as offsets into one byte array, without a Python object for each text; null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        n = len(column)
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.offsets = at
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.rows = n
        if column.null_count and n:  # a null may keep bytes in theory
            lengths = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
            if (lengths != np.diff(at)).any():
                self.__init__(column.fill_null(""))

    def __len__(self) -> int:
        return self.rows

    def slices(self, budget: int = 1 << 20):
        """Row ranges (start, stop) of at most ``budget`` bytes; a longer text is a range of its own."""
        start = 0
        while start < self.rows:
            stop = int(np.searchsorted(self.offsets, self.offsets[start] + budget, side="right")) - 1
            stop = min(self.rows, max(stop, start + 1))
            yield start, stop
            start = stop


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
