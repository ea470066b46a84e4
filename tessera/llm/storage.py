"""Shared scratch storage: tables and files that every executor and the driver can read."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4MB"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; in local mode one is made where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``codec`` none suits many small tables of hashes: they hardly shrink, and a codec's buffers lie outside the heap, where they
    stay until a collection comes by.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Remove the scratch table behind a materialised frame whose readers are all done."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in path:
            drop_path(df.sparkSession, path)


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session, unless it has a bound of its own: ten thousand texts may be anything."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def trim() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        return


def tidy(kernel: Kernel) -> Kernel:
    """``kernel`` on batches of bounded bytes, its freed memory given back at the end of a partition: workers wait in little of it."""
    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        trim()

    return run


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended before the interpreter did: nothing can be removed any more
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
