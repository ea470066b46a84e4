"""Structured Streaming twins (an extension): idempotent append log and smoothing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import scratch


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream; event time is a real timestamp."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if not path.endswith(".parquet") else path + "*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else rows


def unseen(rows: DataFrame, key: str, event_time: str = "ts", late: str = "30 days") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def window_counts(rows: DataFrame, event_time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    return rows.withWatermark(event_time, late).groupBy(F.window(event_time, width)).count()


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """Append each batch to a JSON log; a replayed batch overwrites its own folder, so the log is idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def smooth(rows: DataFrame, key: str, order: str, value: str, factor: float = 0.98) -> DataFrame:
    """(key, n, ema) after each batch, with the mean kept as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            mean = float(x) if n == 0 else factor * mean + (1 - factor) * float(x)
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [mean]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, ema double", "n bigint, ema double", "update", GroupStateTimeout.NoTimeout)


def stop_early(rows: DataFrame, key: str, order: str, value: str, patience: int = 5, least: float = 0.001, factor: float = 0.98) -> DataFrame:
    """(key, seen, best, stale, stopped) after each batch: the early stop of a training log, with its state kept between batches."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, best, stale, seen = state.get if state.exists else (None, float("inf"), 0, 0)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            if stale >= patience:
                break
            mean = float(x) if mean is None else factor * mean + (1 - factor) * float(x)
            stale = 0 if best - mean > least else stale + 1
            best = mean if stale == 0 else best
            seen += 1
        state.update((mean, best, stale, seen))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "best": [best], "stale": [stale], "stopped": [stale >= patience]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seen bigint, best double, stale int, stopped boolean", "mean double, best double, stale int, seen bigint", "update", GroupStateTimeout.NoTimeout)


def drain(rows: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into the shared folder (or memory in complete mode) and read it back."""
    name = scratch(spark, "stream")
    rows.writeStream.format("parquet").outputMode(mode).option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{name}/out")
