"""What the operators of this package share: scratch folders, cut lineage, tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one in local mode; a cluster must name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver ends (or by `clear`)."""
    own = f"{shared_folder(spark)}/pagemill/{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        fs, path = _file_system(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWNED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_OWNED: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def clear(spark: SparkSession) -> None:
    """Removes what this application's operators have written so far; results that were not stored elsewhere end with it."""
    for own in [o for o in _OWNED if o.endswith(spark.sparkContext.applicationId)]:
        fs, path = _file_system(spark, own)
        fs.delete(path, True)
        _OWNED.discard(own)


def remove(spark: SparkSession, path: str) -> None:
    """A scratch table that is not needed any more goes."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


#: Where the tables of `written` stand.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs here go when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read back: executors that are lost later cost nothing, and no shuffle of df stays."""
    path = scratch(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Tables of `written` that nothing reads any more go."""
    for t in tables:
        remove(t.sparkSession, _PATHS.pop(t))


#: Rows of an Arrow batch of texts: with Spark's default of 10,000 a batch of long texts and its copies take hundreds of MB.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of documents or the like; a session that has Spark's default batch size gets a smaller one."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: A key is hot if it holds this share of all rows, or more: so there are no more hot keys than its inverse.
HOT_SHARE = 1 / 1000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined to groups, which has one row a key and, in count, the number of the key's rows.

    Hot keys, at most 1 / HOT_SHARE of them, are broadcast, so their rows stay
    where they are; the others meet in a shuffle. how: "inner" or "left".
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot, cold = groups.where(F.col(count) >= total * HOT_SHARE), groups.where(F.col(count) < total * HOT_SHARE)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def few_large_tasks(df: DataFrame, rounds: int) -> DataFrame:
    """df in fewer partitions, for tasks that each send a table of fixed size: so many rounds of all cores, or 16 splits a task."""
    n = df.rdd.getNumPartitions()
    return df.coalesce(max(rounds * df.sparkSession.sparkContext.defaultParallelism, n // 16, 1))


def merged_tables(parts: DataFrame, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], pieces: int) -> DataFrame:
    """Tables of fixed size in pieces (piece, content), summed by merge as a tree: 32 tasks' pieces first, then all."""
    for fan in (32, 1024):
        if parts.rdd.getNumPartitions() > fan:
            near = parts.withColumn("_part", F.floor(F.spark_partition_id() / fan))
            parts = near.repartition("piece", "_part").drop("_part").mapInArrow(merge, parts.schema)
            break
    return parts.repartition(pieces, "piece").mapInArrow(merge, parts.schema)


def trim() -> None:
    """Gives freed memory back to the system at the end of a task: a worker that waits for the next stage stays small."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def bits_of(words: list, n_bits: int) -> np.ndarray:
    """A packed bit set from rows (number of a 32-bit word, its bits)."""
    filled = np.zeros(n_bits // 32, "<u4")
    for word, bits in words:
        filled[word] = bits
    return filled.view(np.uint8)


def has_bits(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
