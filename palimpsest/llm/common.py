"""Shared plumbing: the shared folder, written tables, Arrow batches.

Every intermediate result goes to the folder the cluster names in
``spark.checkpoint.dir``, so that any executor can read it again after
another one is lost.  Once it is there, the shuffle files it was made from go.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shared import shared_dir

#: Rows the JVM hands to Python at once; long texts make such a batch large.
BATCH_ROWS = 1000
#: Bits of the table that tells wanted ids from most others: so many for each id, within these bounds, and in a part of it.
MARKS_EACH, LEAST_MARKS, MOST_MARKS, MARKS_PART = 16, 1 << 16, 1 << 27, 1 << 16


#: Whether Spark deletes the shuffle files of a query when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """The rows of ``df``, stored in the shared folder and read again, and where they are, for ``release``."""
    spark = df.sparkSession
    path = workspace(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # else they stay until the driver happens to collect its garbage
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, stored in the shared folder and read again: this cuts the lineage."""
    return stored(df, name)[0]


def release(spark: SparkSession, path: str) -> None:
    """Delete a workspace that no DataFrame in use reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Tables:
    """Stored intermediate tables that go together, and where they are."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix, self.paths = spark, prefix, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, f"{self.prefix}-{name}")
        self.paths.append(path)
        return df

    def take(self, other: Tables) -> None:
        """The tables of ``other`` go with these."""
        self.paths += other.paths
        other.paths = []

    def release(self) -> None:
        for path in self.paths:
            release(self.spark, path)
        self.paths = []


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """An object that later tasks of this Python process use again.

    There is one at a time: a worker that turns to another operator, or to
    another model of the same one, drops what it kept before.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
        give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return freed memory of this process to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: whole documents are wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (string or binary) has about ``max_bytes`` in each; one long value stands alone."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        first = size = 0
        for row, length in enumerate(lengths):
            if row > first and size + length > max_bytes:
                yield batch.slice(first, row - first)
                first, size = row, 0
            size += length
        if first < batch.num_rows:
            yield batch.slice(first)
    give_back()


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, id and text, under fixed names: other columns and their names do not matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_marks(ids: DataFrame) -> np.ndarray:
    """A bit for each remainder that the ids of ``ids`` (doc_id long) leave when divided by the number of bits; MOST_MARKS bits at most reach the driver."""
    marks = min(MOST_MARKS, max(LEAST_MARKS, 1 << (MARKS_EACH * ids.count()).bit_length()))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column("bit").to_numpy()
            for part in np.unique(bits // MARKS_PART).tolist():
                own = np.zeros(MARKS_PART, bool)
                own[bits[bits // MARKS_PART == part] % MARKS_PART] = True
                parts[part] = parts.get(part, 0) | np.packbits(own, bitorder="little")
        for part, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])

    bits = ids.select(F.pmod("doc_id", F.lit(marks)).alias("bit"))
    bits = bits.repartition(F.floor(F.col("bit") / MARKS_PART)).sortWithinPartitions("bit")
    out = np.zeros((marks // MARKS_PART, MARKS_PART // 8), np.uint8)
    for row in bits.mapInArrow(add, "part int, bits binary").collect():
        out[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def marked(docs: DataFrame, id_col: str, marks: np.ndarray) -> DataFrame:
    """The rows whose id has its mark: all wanted ones, and some that share a remainder."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf("boolean")
    def has_mark(ids: pa.Array) -> pa.Array:
        bits = shared.value
        rest = ids.fill_null(0).to_numpy() % (8 * len(bits))
        return pa.array((bits[rest >> 3] >> (rest & 7).astype(np.uint8) & 1).astype(bool))

    return docs.where(has_mark(F.col(id_col)))


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for files that executors write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
