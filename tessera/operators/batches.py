"""Training batches of ragged rows, and contrastive logits over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import place_in_group, spread_rank


def length_bucket(length: Column, edges: tuple[int, ...]) -> Column:
    """The least edge that holds a length; beyond the last one the next multiple of it."""
    last = F.lit(edges[-1])
    beyond = F.ceil(length / last).cast("int") * last
    inside = [F.when(length <= e, F.lit(e)) for e in sorted(edges)]
    return F.coalesce(*inside, beyond)


def ragged_batches(rows: DataFrame, key: str, values: str, batch_size: int, edges: tuple[int, ...] = (16, 64, 256, 1024), pad: int = 0, seed: int = 42) -> DataFrame:
    """(bucket, batch, slot, key, length, padded, mask, values): rows of like length in batches, in a seeded order.

    A row is padded to its bucket, not to the longest of all; its own list stays beside the mask.  Rows of a bucket are
    numbered in ranges of their order side by side, so a bucket that holds most rows is no single task.  ``key`` tells rows apart
    (whole numbers below 2^32, or text); a null list is empty.
    """
    list_type = dict(rows.dtypes)[values]
    held = F.coalesce(F.col(values), F.array().cast(list_type))
    sized = rows.select(F.col(key).alias(key), held.alias(values)).withColumn("length", F.size(values)).withColumn("bucket", length_bucket(F.col("length"), edges))
    placed = place_in_group(sized, "bucket", spread_rank(sized, key, seed), "_place")
    spare = F.col("bucket") - F.col("length")
    item = list_type.removeprefix("array<").removesuffix(">")
    padded = F.concat(values, F.array_repeat(F.lit(pad).cast(item), spare))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("length")), F.array_repeat(F.lit(0), spare))
    return placed.select("bucket", F.floor(F.col("_place") / batch_size).alias("batch"), F.pmod("_place", F.lit(batch_size)).alias("slot"), key, "length", padded.alias("padded"), mask.alias("mask"), values)


def collate(batches: DataFrame, key: str, values: str) -> DataFrame:
    """(bucket, batch, keys, padded, mask, values): one row a batch, at most ``batch_size`` members in slot order."""
    member = F.struct("slot", key, "padded", "mask", values)
    grouped = batches.groupBy("bucket", "batch").agg(F.array_sort(F.collect_list(member)).alias("m"))
    take = lambda c: F.transform("m", lambda x: x[c])
    return grouped.select("bucket", "batch", take(key).alias("keys"), take("padded").alias("padded"), take("mask").alias("mask"), take(values).alias(values))


def first_batches(batches: DataFrame, n: int) -> DataFrame:
    """Batches 0 .. n - 1 of every bucket: a dry run over the head of an epoch."""
    return batches.where(F.col("batch") < n)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is not 0, by place; none gives zeros of the first vector's length."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m != 0, v)), lambda v: v.isNotNull())
    zero = F.transform(F.coalesce(F.get(vectors, F.lit(0)), F.array().cast("array<double>")), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a vector of length 0 stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def contrastive_losses(pairs: DataFrame, batch: str, key: str, left: str, right: str, temperature: float = 0.07, block: int = 64) -> DataFrame:
    """(batch, key, logit, loss) of every pair: the cross-entropy of its own right vector among all of its batch.

    The right side of a batch is cut into blocks of ``block`` vectors.  A left vector meets one block at a time and keeps the
    block's largest logit and the sum of exponentials below it; the partial sums of its blocks are then merged, scaled to
    the largest of them.  No row holds more than a block.  ``key`` tells the pairs of a batch apart; vectors are normalised.
    """
    rows = pairs.select(batch, key, unit(F.col(left)).alias("_l"), unit(F.col(right)).alias("_r"))
    # Blocks by hash: about ``block`` vectors each, however large a batch is.
    sizes = rows.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    placed = rows.join(sizes, batch).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    blocks = placed.groupBy(batch, F.col("_b").alias("_block")).agg(F.collect_list("_r").alias("_others"))
    asked = placed.select(batch, key, "_l", dot(F.col("_l"), F.col("_r")).alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    met = asked.join(blocks, [batch, "_block"]).withColumn("_logits", F.transform("_others", lambda o: dot(F.col("_l"), o) / temperature))
    partial = met.select(batch, key, "_own", F.array_max("_logits").alias("_m"), F.aggregate("_logits", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("_logits"))).alias("_s"))
    # exp(m - 1/temperature) cannot overflow: logits of unit vectors are at most 1/temperature.
    top = F.lit(1.0 / temperature)
    merged = partial.groupBy(batch, key).agg(F.max("_own").alias("_own"), F.max("_m").alias("_m"), F.sum(F.col("_s") * F.exp(F.col("_m") - top)).alias("_s"))
    logit = F.col("_own") / temperature
    return merged.select(batch, key, logit.alias("logit"), (F.ln("_s") + top - logit).alias("loss"))
