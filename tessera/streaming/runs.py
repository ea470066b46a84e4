"""Training runs as streams: the smoothed mean and the early stop of every run, in event-time order, across restarts.

Rows of a run may come late and out of order.  They wait in the state until the watermark has passed them; then they are folded,
in order, into the settled mean: when the next rows come, or by an event-time timer where none come.  What a batch reports is the
settled fold continued over the waiting rows, so the last report of a run is the fold of all its rows.  State is kept by RocksDB
below the query's checkpoint: a query that stops, or loses an executor, goes on from its last batch.  A row older than the
watermark is dropped, as nothing settled can be undone; the state of a run is its fold and the rows of one watermark delay.

A call of the processor and of its state costs milliseconds, and a run has few rows a batch.  Runs therefore share pages by a hash
of their key: one page is one group, one value of state and at most one timer, and a batch rewrites only the pages of its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER_KEY, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = "runs array<struct<run: string, n: bigint, mean: double, best: double, stale: bigint, seen: bigint>>, waiting binary"
WAITING = np.dtype([("run", "<i4"), ("at", "<i8"), ("tie", "<i8"), ("value", "<f8")])
LAST_TIE = 2**63 - 1
START = (0, 0.0, float("inf"), 0, 0)


def step(s: tuple, x: float, factor: float, patience: int, least: float) -> tuple:
    """One value more: the mean goes on for good, the stop counts until it stops."""
    n, mean, best, stale, seen = s
    mean = x if n == 0 else factor * mean + (1 - factor) * x
    if stale < patience:
        stale = 0 if best - mean > least else stale + 1
        best, seen = mean if stale == 0 else best, seen + 1
    return n + 1, mean, best, stale, seen


class RunFold(StatefulProcessor):
    """State of a page: its runs with their settled folds, and the rows (place of the run in the page, event time in microseconds, tie breaker, value) that wait."""

    def __init__(self, factor: float, patience: int, least: float) -> None:
        self.factor, self.patience, self.least = factor, patience, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", PAGE)

    def _load(self) -> tuple[list, list[tuple], np.ndarray]:
        runs, waiting = self.page.get() or ([], b"")
        return [r[0] for r in runs], [tuple(r[1:]) for r in runs], np.frombuffer(waiting, WAITING)

    def _fold(self, folds: list[tuple], rows: np.ndarray) -> None:
        rows = rows[np.lexsort((rows["value"], rows["tie"], rows["at"], rows["run"]))]
        for run, x in zip(rows["run"].tolist(), rows["value"].tolist()):
            folds[run] = step(folds[run], x, self.factor, self.patience, self.least)

    def _settle(self, runs: list, folds: list[tuple], rows: np.ndarray, mark: int) -> np.ndarray:
        """Fold what the watermark has passed, and store the page; the rows that go on waiting."""
        past = rows["at"] < mark
        self._fold(folds, rows[past])
        rest = rows[~past]
        self.page.update(([(run, *fold) for run, fold in zip(runs, folds)], rest.tobytes()))
        return rest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = max(timerValues.getCurrentWatermarkInMs() * 1000, 0) or -LAST_TIE
        runs, folds, waiting = self._load()
        place, parts = {run: i for i, run in enumerate(runs)}, []
        for part in rows:
            new = np.empty(len(part), WAITING)
            new["run"] = [place.setdefault(run, len(place)) for run in part["run"].tolist()]
            new["at"], new["tie"], new["value"] = part["at_us"], part["tie"], part["amount"]
            parts.append(new)
        new = np.concatenate(parts)
        touched = np.unique(new["run"])
        runs, folds = list(place), folds + [START] * (len(place) - len(folds))
        rest = self._settle(runs, folds, np.concatenate([waiting, new[new["at"] >= mark]]), mark)
        due, was = (int(w["at"].max()) // 1000 + 1 if len(w) else None for w in (rest, waiting))
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        self._fold(folds, rest[np.isin(rest["run"], touched)])
        found = [(runs[i], *folds[i], folds[i][3] >= self.patience) for i in touched.tolist()]
        yield pd.DataFrame(found, columns=["run", "n", "ema", "best", "stale", "seen", "stopped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(*self._load(), timerValues.getCurrentWatermarkInMs() * 1000)
        yield from ()

    def close(self) -> None:
        return


def with_rocksdb(spark: SparkSession) -> None:
    """This session's streams keep their state in RocksDB, unless they are told otherwise."""
    if "RocksDB" not in spark.conf.get(PROVIDER_KEY, ""):
        spark.conf.set(PROVIDER_KEY, ROCKSDB)


def fold_stream(rows: DataFrame, key: str, at: str, tie: str, value: str, late: str = "1 day", factor: float = 0.98, patience: int = 5, least: float = 0.001, pages: int = 4096) -> DataFrame:
    """(key, n, ema, best, stale, seen, stopped) of every run that a batch touched; ``at`` is a timestamp, ``tie`` an integer.

    Rows without a time or a value are no steps of a run and are left out; rows without a tie breaker come last of their time.
    Keys travel as text.  ``pages`` belongs to the checkpoint, like the number of shuffle partitions: a restart has to name it again.
    """
    with_rocksdb(rows.sparkSession)
    kind, run = dict(rows.dtypes)[key], F.col(key).cast("string")
    slim = rows.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(
        F.pmod(F.hash(run), F.lit(pages)).alias("page"), run.alias("run"), F.col(at).alias("event_time"), F.unix_micros(at).alias("at_us"), F.coalesce(F.col(tie).cast("bigint"), F.lit(LAST_TIE)).alias("tie"), F.col(value).cast("double").alias("amount")
    )
    out = StructType.fromDDL("run string, n bigint, ema double, best double, stale bigint, seen bigint, stopped boolean")
    found = slim.withWatermark("event_time", late).groupBy("page").transformWithStateInPandas(statefulProcessor=RunFold(factor, patience, least), outputStructType=out, outputMode="Update", timeMode="eventTime")
    return found.select(F.col("run").cast(kind).alias(key), *out.names[1:])


def run_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Fold what is there now, then stop; a later call goes on from the checkpoint.  A batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last report of every run."""
    reports = spark.read.parquet(path)
    last = F.max_by(F.struct(*(c for c in reports.columns if c not in (key, "batch"))), "batch")
    return reports.groupBy(key).agg(last.alias("r")).select(key, "r.*")
