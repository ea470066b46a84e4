"""An incremental cache of file hashes: only files that are new or have changed are read.

The cache is a Parquet folder of (path, length, modified, hash) with one subfolder a run.  A file whose hash is null could
not be decoded: it stays in the cache as corrupt and is not tried again until it changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists

KEY = ["path", "length", "modified"]


def stored(spark: SparkSession, cache: str, hash_type: str = "array<bigint>") -> DataFrame:
    """(path, length, modified, hash, run) of all runs."""
    schema = f"path string, length bigint, modified bigint, hash {hash_type}, run string"
    return spark.read.schema(schema).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], schema)


def refresh(files: DataFrame, cache: str, hashes: Callable[[DataFrame], DataFrame], hash_type: str = "array<bigint>") -> DataFrame:
    """(path, length, modified, hash, fresh) of every distinct row of ``files`` (path, length, modified); ``fresh``: computed now.

    ``hashes`` takes the rows of new files and returns (path, hash); files it leaves out are corrupt.  A run that fails leaves
    no rows; a file that two runs computed counts once.  A missing length or time counts as -1.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(c)
    listed = files.where("path is not null").select("path", number("length"), number("modified")).distinct()
    new = listed.join(stored(spark, cache, hash_type).select(*KEY), KEY, "left_anti")
    computed = hashes(new).groupBy("path").agg(F.max("hash").alias("hash"))
    new.join(computed, "path", "left").select(*KEY, F.col("hash").cast(hash_type).alias("hash")).write.parquet(f"{cache}/run={run}")
    known = stored(spark, cache, hash_type).groupBy(*KEY).agg(F.max("hash").alias("hash"), F.bool_and(F.col("run") == run).alias("fresh"))
    return listed.join(known, KEY)


def corrupt(cached: DataFrame) -> DataFrame:
    """Rows of files without a hash."""
    return cached.where(F.col("hash").isNull())


def clear(spark: SparkSession, cache: str) -> None:
    """Forget all runs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
