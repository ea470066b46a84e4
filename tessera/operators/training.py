"""Training logs: smoothing, early stop, accumulation, schedules.

Column forms fold an ordered array, for runs of a bounded length.  ``fold_runs`` walks sorted rows with a state instead, for
runs of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def fold_runs(df: DataFrame, key: str, order: list[str], value: str, start: Callable[[], object], step: Callable, finish: Callable[[object], tuple], schema: str) -> DataFrame:
    """(key, *finish(state)) of every run: ``state = step(state, value)`` over its rows in order.

    Rows are sorted within the partition of their key and read batch by batch; a task holds one state, however long a run is.
    """
    kind = dict(df.dtypes)[key]
    names = [key, *(x.split()[0] for x in schema.split(", "))]
    types = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        run, state, open_run, key_type = None, None, False, None

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = [key_type, *(types[x.split()[1]] for x in schema.split(", "))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not open_run or k != run:
                    if open_run:
                        out.append((run, *finish(state)))
                    run, state, open_run = k, start(), True
                state = step(state, v)
            if len(out) >= 10_000:
                yield emit()
        if open_run:
            out.append((run, *finish(state)))
        if out:
            yield emit()

    rows = df.select(key, F.col(value).cast("double").alias("_v"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    rows = rows.repartition(key).sortWithinPartitions(key, *(f"_o{i}" for i in range(len(order)))).select(key, "_v")
    return rows.mapInArrow(walk, f"`{key}` {kind}, {schema}")


def ema_runs(df: DataFrame, key: str, order: list[str], value: str, factor: float = 0.98) -> DataFrame:
    """(key, n, ema) of every run; null values are no steps.

    The mean is an affine recurrence: m values turn a mean e into factor^m e plus a sum of the values by their distance from
    the last.  Rows are range-partitioned by run and order, each partition sums up its segments, and a run's few segments are
    chained; the first one starts from its first value.  So a run with most of the rows is spread over many tasks.
    """
    steps = [f"_o{i}" for i in range(len(order))]
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"), *(F.col(o).alias(s) for o, s in zip(order, steps)))
    spread = settled(rows.repartitionByRange(key, *steps).withColumn("_part", F.spark_partition_id()), "runs")
    segment = Window.partitionBy("_part", key)
    placed = spread.withColumn("_k", F.row_number().over(segment.orderBy(*steps))).withColumn("_m", F.count(F.lit(1)).over(segment))
    weight = (1 - factor) * F.pow(F.lit(factor), F.col("_m") - F.col("_k"))
    sums = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("m"), F.sum(weight * F.col("_v")).alias("shift"), F.max(F.when(F.col("_k") == 1, F.col("_v"))).alias("first"))
    chained = sums.groupBy(key).agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.struct("_part", "m", "shift", "first"))).alias("_s"))  # one a partition at most
    mean = F.aggregate("_s", F.get("_s", F.lit(0))["first"], lambda e, s: F.pow(F.lit(factor), s["m"]) * e + s["shift"])
    return chained.select(key, "n", mean.alias("ema"))


def early_stop_runs(df: DataFrame, key: str, order: list[str], value: str, patience: int = 5, least: float = 0.001, factor: float = 0.98) -> DataFrame:
    """(key, best, stale, stopped_at, seen) of every run, as ``early_stop`` gives them."""

    def step(s: tuple, v: float) -> tuple:
        mean, best, stale, stopped, seen = s
        if stopped is not None:
            return s
        mean = v if mean is None else mean * factor + v * (1 - factor)
        stale = 0 if best - mean > least else stale + 1
        return mean, mean if stale == 0 else best, stale, seen if stale >= patience else None, seen + 1

    return fold_runs(df, key, order, value, lambda: (None, float("inf"), 0, None, 0), step, lambda s: s[1:], "best double, stale int, stopped_at int, seen int")


def ordered(value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v")))), lambda x: x["v"])


def ema(values: Column, factor: float = 0.98) -> Column:
    """Exponential mean of the whole sequence: the first value, then factor * mean + (1 - factor) * value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(s * factor + x * (1 - factor)))


def ema_series(values: Column, factor: float = 0.98) -> Column:
    """The mean after each value: every place folds what is before it, so for short runs."""
    return F.transform(values, lambda _, i: ema(F.slice(values, 1, i + 1), factor))


def early_stop(values: Column, patience: int = 5, least: float = 0.001, factor: float = 0.98) -> Column:
    """struct(best, stale, stopped_at, seen): an improvement must exceed ``least``; counting ends where it stops (0-based, null if never)."""
    start = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(None).cast("int").alias("stopped_at"), F.lit(0).alias("seen"))

    def step(s: Column, x: Column) -> Column:
        e = F.when(s["ema"].isNull(), x).otherwise(s["ema"] * factor + x * (1 - factor))
        better = s["best"] - e > least
        stale = F.when(better, F.lit(0)).otherwise(s["stale"] + 1)
        new = F.struct(e.alias("ema"), F.when(better, e).otherwise(s["best"]).alias("best"), stale.alias("stale"), F.when(stale >= patience, s["seen"]).alias("stopped_at"), (s["seen"] + 1).alias("seen"))
        return F.when(s["stopped_at"].isNotNull(), s).otherwise(new)

    return F.aggregate(values, start, step, lambda s: F.struct(s["best"].alias("best"), s["stale"].alias("stale"), s["stopped_at"].alias("stopped_at"), s["seen"].alias("seen")))


def accumulate(df: DataFrame, index: str, value: str, every: int, by: list[str] | None = None, keep_tail: bool = True, last_only: bool = False) -> DataFrame:
    """Mean (or last) of consecutive ``every`` values by 0-based index; a short tail is kept or dropped."""
    by = by or []
    made = F.max_by(value, index) if last_only else F.avg(value)
    g = df.groupBy(*by, F.floor(F.col(index) / every).alias("step")).agg(F.count(F.lit(1)).alias("n"), made.alias("loss"))
    return g if keep_tail else g.where(F.col("n") == every)


def every_n(df: DataFrame, step: str, n: int) -> DataFrame:
    return df.where(F.col(step) % n == 0)


def resume_point(step: int, steps_per_epoch: int, accumulate: int) -> tuple[int, int]:
    """(epoch to start in, micro-batches of it to skip)."""
    return step // steps_per_epoch, (step % steps_per_epoch) * accumulate


def best_so_far(values: Column, start_after: int = 0) -> Column:
    """Positions (0-based, beyond ``start_after``) at which a strictly smaller value appears."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        hit = (x < s["best"]) & (s["i"] >= start_after)
        return F.struct(F.when(hit, x).otherwise(s["best"]).alias("best"), F.when(hit, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    return F.aggregate(values, start, step, lambda s: s["at"])
