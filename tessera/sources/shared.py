"""A table in the folder that all executors share: cuts lineage, survives lost executors, and is computed once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4MB"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode a folder is made where none is named, on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before the interpreter did: nothing can be removed any more
            return


def cached(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` written once for each ``key`` (a fingerprint of its inputs) below the shared folder, and read from then on."""
    path = f"{shared_root(spark)}/tessera-cache/{name}-{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row) in this session, unless it has a bound of its own: ten thousand packed blocks would be gigabytes."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
