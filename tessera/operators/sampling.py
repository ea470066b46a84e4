"""Seeded sampling: hash ranks take the place of a generator's sequence, so results do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import PRIME, arithmetic_rank, hashed

#: Target mix of the pool's sources, and the weight of any other.
TARGET_MIX = {"visual7w": 0.35, "gqa": 0.30, "vqav2": 0.15, "vcr": 0.10, "aokvqa": 0.10}
OTHER_WEIGHT = 0.1
#: Training family of each region source.
FAMILIES = {"coco": "coco", "refcoco": "refcoco", "refcocog": "refcoco", "refcoco+": "refcoco", "visual_genome": "vg", "grit": "grit"}


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of least hash: a bounded top-n, not a sort of the table."""
    return df.orderBy(arithmetic_rank(F.col(key), seed), key).limit(n)


def per_group_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(group).orderBy(arithmetic_rank(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


#: The modulus, multiplier and rounds of the keyed permutation, small enough for exact 64-bit products.
FEISTEL_PRIME, FEISTEL_FACTOR, FEISTEL_ROUNDS = 2147483647, 48271, 6


def _mixed(half: Column, seed: int, turn: Column) -> Column:
    """A keyed function of half a place, below FEISTEL_PRIME; squares stay below 2^62."""
    prime = F.lit(FEISTEL_PRIME)
    keyed = F.pmod(half + F.pmod(turn * F.lit(7_919) + F.lit((seed * 1_000_003 + 12_345) % FEISTEL_PRIME), prime), prime)
    return F.pmod(F.pmod(keyed * keyed, prime) * F.lit(FEISTEL_FACTOR) + half, prime)


def _feistel(x: Column, rows: int, columns: int, seed: int, back: bool) -> Column:
    """One pass over 0 .. rows * columns - 1: rounds add a keyed function of one coordinate to the other, each undone by subtraction."""
    start = F.struct(F.floor(x / columns).cast("bigint").alias("h"), F.pmod(x, F.lit(columns)).cast("bigint").alias("l"))
    sign = -1 if back else 1

    def step(s: Column, turn: Column) -> Column:
        first = F.struct(F.pmod(s["h"] + sign * _mixed(s["l"], seed, turn), F.lit(rows)).alias("h"), s["l"].alias("l"))
        second = F.struct(s["h"].alias("h"), F.pmod(s["l"] + sign * _mixed(s["h"], seed, turn), F.lit(columns)).alias("l"))
        return F.when(turn % 2 == 0, first).otherwise(second)

    ends = (FEISTEL_ROUNDS - 1, 0, -1) if back else (0, FEISTEL_ROUNDS - 1, 1)
    turns = F.sequence(*(F.lit(k).cast("bigint") for k in ends))
    return F.aggregate(turns, start, step, lambda s: s["h"] * columns + s["l"])


def permuted(place: Column, n: int, seed: int = 42, epoch: int = 0, back: bool = False) -> Column:
    """The item at ``place`` of a seeded order of 0 .. n - 1; ``back`` gives the place of an item.  Null outside of 0 .. n - 1.

    A keyed Feistel permutation: an epoch's order needs no sort, and a resumed run starts at any place.  The domain is the
    least grid of about root n by root n that holds n; a value beyond n is sent through again until it is below, which ends
    after at most as many passes as there are values beyond (a permutation's path back to itself), nearly always one.
    """
    if n <= 0:
        return F.lit(None).cast("bigint")
    columns = math.isqrt(n - 1) + 1 if n > 1 else 1
    rows = -(-n // columns)
    key, x = (seed * 31 + epoch * 1_009) % FEISTEL_PRIME, place.cast("bigint")
    once = _feistel(x, rows, columns, key, back)
    spare = rows * columns - n
    if spare:
        again = lambda s, _: F.when(s < n, s).otherwise(_feistel(s, rows, columns, key, back))
        once = F.aggregate(F.array(F.lit(0)), once, lambda s, _: F.when(s < n, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(spare)), s, again)))
    return F.when((x >= 0) & (x < n), once)


def epoch_slice(spark: SparkSession, n: int, start: int = 0, end: int | None = None, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(place, item) of an epoch from ``start`` on: what a run that stopped there has still to do."""
    return spark.range(start, n if end is None else min(end, n)).select(F.col("id").alias("place"), permuted(F.col("id"), n, seed, epoch).alias("item"))


def mix_weight(source: Column, mix: dict[str, float] = TARGET_MIX) -> Column:
    table = F.create_map(*(F.lit(x) for kv in mix.items() for x in kv))
    return F.coalesce(table[source], F.lit(OTHER_WEIGHT))


def place_in_group(df: DataFrame, group: str, order: Column, name: str, shards: int = 64) -> DataFrame:
    """``df`` with its 0-based place in its group by a 64-bit hash ``order``.

    A group is numbered in ``shards`` ranges of the hash side by side, so a hot one is no single task; one count a group and
    range gives the places before it.
    """
    split = df.withColumn("_h", order).withColumn("_s", F.floor((F.col("_h") / 2.0**64 + 0.5) * shards).cast("int"))
    inside = F.row_number().over(Window.partitionBy(group, "_s").orderBy("_h")) - 1
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = split.groupBy(group, "_s").count().withColumn("_o", before).select(F.col(group).alias("_g"), F.col("_s").alias("_t"), "_o")
    numbered = split.withColumn("_r", inside).join(offset, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    return numbered.withColumn(name, F.col("_o") + F.col("_r")).drop("_h", "_s", "_r", "_g", "_t", "_o")


def weighted_draws(df: DataFrame, source: str, key: str, draws: int, weights: dict[str, float], seed: int = 42, by_share: bool = False) -> DataFrame:
    """``draws`` rows with replacement, each with odds of its weight; ``by_share`` divides a source's weight by its count.

    A draw picks a source by its total weight (few sources), then a row number in it.
    """
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).withColumn("w", mix_weight(F.col(source), weights) * (F.lit(1.0) if by_share else F.col("n")))
    order = Window.orderBy(source)
    bounds = counts.withColumn("hi", F.sum("w").over(order)).withColumn("lo", F.col("hi") - F.col("w")).withColumn("all", F.sum("w").over(Window.partitionBy()))
    unit = lambda s: hashed(F.col("draw"), 2 * seed + s) / F.lit(float(PRIME))
    asked = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("u", unit(0)).withColumn("v", unit(1))
    picked = asked.join(F.broadcast(bounds), (F.col("u") * F.col("all") >= F.col("lo")) & (F.col("u") * F.col("all") < F.col("hi"))).select("draw", source, F.floor(F.col("v") * F.col("n")).alias("_k"))
    return picked.join(place_in_group(df, source, spread_rank(df, key, seed), "_k"), [source, "_k"]).drop("_k")


def spread_rank(df: DataFrame, key: str, seed: int) -> Column:
    """A seeded order of ``key`` over 64 bits: arithmetic for whole numbers, so that any engine can repeat it, else by hash."""
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        return (arithmetic_rank(F.col(key), seed) - F.lit(1 << 31)) * F.lit(1 << 32)
    return F.xxhash64(key, F.lit(seed))


def family_of(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    return F.coalesce(table[source], F.lit("other"))


#: Batches that one row lays out.
BATCH_RANGE = 4_096


def balanced_slots(families: DataFrame, batches: int, batch_size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(batch, family, quota, start): equal shares, spare slots to the first families of a per-batch seeded order.

    ``start`` is how many rows the family gave to earlier batches; member number is (start + slot) mod family size.
    families: (family, n), a handful of rows.
    """
    held = families.select("family", "n", F.count(F.lit(1)).over(Window.partitionBy()).alias("f"))
    # A family's batches are laid out range by range, so that a few families still fill many tasks.
    ranges = held.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(max(0, (batches - 1) // BATCH_RANGE))))).repartition("_range", "family")
    last = F.least((F.col("_range") + 1) * BATCH_RANGE, F.lit(batches)).cast("bigint") - 1
    grid = ranges.select("family", "n", "f", F.explode(F.sequence((F.col("_range") * BATCH_RANGE).cast("bigint"), last)).alias("batch")) if batches > 0 else ranges.select("family", "n", "f", F.lit(0).cast("bigint").alias("batch")).where("false")
    ranked = grid.withColumn("_o", F.row_number().over(Window.partitionBy("batch").orderBy(F.xxhash64("batch", "family", F.lit(seed + epoch)), "family")))
    quota = F.floor(F.lit(batch_size) / F.col("f")) + (F.col("_o") <= F.lit(batch_size) % F.col("f")).cast("bigint")
    slots = ranked.withColumn("quota", quota)
    return running_sum(slots, "family", "batch", "quota", "start").select("batch", "family", "n", "quota", "start")


def running_sum(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = 4_096) -> DataFrame:
    """``rows`` with the sum of ``value`` before each row of its group, by a whole-number ``order``.

    Ranges of ``width`` are summed side by side and then over one row a range, so a group with many rows is no single task.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    totals = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    offsets = totals.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.withColumn("_inside", inside).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_g", "_r", "_offset")


def balanced_batches(df: DataFrame, family: str, key: str, batch_size: int, batches: int | None = None, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(batch, family, key): every batch has near-equal shares of all families; small families repeat in new orders."""
    total = df.count()
    batches = total // batch_size if batches is None else batches
    counts = df.groupBy(family).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(family, "family")
    slots = balanced_slots(counts, batches, batch_size, seed, epoch)
    drawn = slots.where("quota > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)).alias("slot")).withColumn("_k", F.col("start") + F.col("slot"))
    # The k-th draw of a family is member k mod n of its pass k div n.  A member's place in a pass is a seeded shift of
    # its place by hash, so a pass holds each member once.
    members = place_in_group(df.select(F.col(family).alias("family"), F.col(key).alias(key)), "family", F.xxhash64(key, F.lit(seed + epoch)), "_m")
    turn = F.pmod(F.xxhash64(F.col("family"), F.floor(F.col("_k") / F.col("n")), F.lit(seed + epoch)), F.col("n"))
    drawn = drawn.withColumn("_m", F.pmod(F.col("_k") + turn, F.col("n")))
    return drawn.join(members, ["family", "_m"]).select("batch", "family", "slot", key)
