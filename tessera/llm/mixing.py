"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get targets by weight, none above ``max_repeat`` times its own size.  The mix is cut into blocks of ``block_tokens``
words; the blocks go to sources, and a source's blocks to its shards, by highest quotients v/(2s+1).  A source whose target
is below SMALL blocks gets its target to the word instead, so no source vanishes for being small.  A shard's documents, in
seeded order, form one line of words; whole passes over it are taken first and the rest as seeded blocks, which are shorter
in a source of few words so that every source has a choice of blocks.  Nothing here depends on the size of the corpus.

Defined results: null or empty text has size 0 and gets nothing; a null source is a source of its own, ordered last; null
ids and repeated rows are kept and mixed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import count
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: A source has a shard for so many documents, and at most so many shards; shards only spread the work.
SHARD_DOCS, MAX_SHARDS = 2_000, 4_096
#: Sources with targets below so many blocks are apportioned by words.
SMALL = 4


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats per vote by highest quotients v/(2s+1), none above its cap.  Ties go to the earlier entry.

    Rounding v/divisor is itself such an allocation, so it starts there and adds or takes single seats.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [min(c, int(seats * v / total + 0.5)) for v, c in zip(votes, caps)]
    over = sum(got) - seats
    if over > 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, got)) if s]
        heapq.heapify(heap)
        for _ in range(over):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    else:
        heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, got, caps)) if s < c and v > 0]
        heapq.heapify(heap)
        for _ in range(-over):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def source_targets(sizes: list[int], weights: list[float], max_repeat: float) -> list[float]:
    """Targets that share sum(sizes) by weight; what is above max_repeat * size is shared out again by weight."""
    total = float(sum(sizes))
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free} if free else {}
        above = [i for i in free if share[i] > max_repeat * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: float(max_repeat * sizes[i]) for i in above}


def source_words(sizes: list[int], goals: list[float], block: int, max_repeat: int) -> list[int]:
    """Words that each source gives to the mix."""
    words = [min(int(g + 0.5), max_repeat * n) if g < SMALL * block else -1 for n, g in zip(sizes, goals)]
    large = [i for i, w in enumerate(words) if w < 0]
    seats = round((sum(sizes) - sum(w for w in words if w > 0)) / block)
    quotas = sainte_lague([goals[i] for i in large], seats, [-(-max_repeat * sizes[i] // block) for i in large])
    for i, q in zip(large, quotas):
        words[i] = min(q * block, max_repeat * sizes[i])
    return words


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its dense 0-based place in the order; only one count a range partition is summed over all."""
    spread = materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mixing-ranges")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    before = spread.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.withColumn("_r", inside).join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, F.col("_b") + F.col("_r")).drop("_p", "_b", "_r")


def plan_many(totals: DataFrame, weights: tuple[float, ...], max_repeat: int, block: int) -> DataFrame:
    """``source_targets`` and ``source_words`` as aggregates, for more sources than the driver should hold.

    The shared level and the least quotient that still gets a block are found by passes over the table of sources.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_i") % len(weights)).cast("int") + 1)
    ranked = materialise(numbered(totals.withColumn("_last", F.col("_source").isNull()), ["_last", "_source"], "_i").withColumn("_w", w).withColumn("_most", max_repeat * F.col("n")).drop("_last"), "mixing-sources")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    level = 0.0
    while True:  # rises until the sources above their cap are the same as before
        above = F.lit(level) * F.col("_w") > F.col("_most")
        got = ranked.agg(F.sum(F.when(above, F.col("_most")).otherwise(0)), F.sum(F.when(~above, F.col("_w")).otherwise(0.0))).first()
        new = (total - got[0]) / got[1] if got[1] else level
        if new <= level:
            break
        level = new
    goal = F.least(F.lit(float(level)) * F.col("_w"), F.col("_most").cast("double"))
    small = F.col("goal") < SMALL * block
    goals = ranked.withColumn("goal", goal).withColumn("_words", F.when(small, F.least(F.floor(F.col("goal") + 0.5), F.col("_most"))))
    goals = materialise(goals, "mixing-goals")
    seats = round((total - (goals.agg(F.sum("_words")).first()[0] or 0)) / block)
    large = goals.where("_words is null").withColumn("_cap", F.ceil(F.col("_most") / block))
    held = lambda q: F.least(F.col("_cap"), F.floor((F.col("goal") / q + 1) / 2))
    low, high = block / 8, block * 8.0
    for _ in range(7):
        cuts = [low + (high - low) * k / 64 for k in range(1, 64)]
        seen = [x or 0 for x in large.agg(*(F.sum(held(q)) for q in cuts)).first()]
        low, high = max([low, *(q for q, c in zip(cuts, seen) if c >= seats)]), min([high, *(q for q, c in zip(cuts, seen) if c < seats)])
    sure = large.withColumn("_got", held(high)).withColumn("_next", F.when(F.col("_got") < F.col("_cap"), F.col("goal") / (2 * F.col("_got") + 1)))
    sure = materialise(sure, "mixing-seats")
    rest = seats - (sure.agg(F.sum("_got")).first()[0] or 0)
    more = numbered(sure.where(F.col("_next") >= low * (1 - 1e-9)).select("_i", "_next"), [F.col("_next").desc(), F.col("_i")], "_place").where(F.col("_place") < rest)
    words = sure.join(more.select("_i", F.lit(1).alias("_one")), "_i", "left").select("_i", F.least((F.col("_got") + F.coalesce("_one", F.lit(0))) * block, F.col("_most")).alias("_got"))
    return goals.join(words, "_i", "left").select("_source", "n", "docs", "goal", F.coalesce("_words", "_got").cast("bigint").alias("words"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, block_tokens: int = 16, seed: int = 11, driver_sources: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted).

    Only ids and sizes are shuffled.  A hot source is spread over its shards.  Up to ``driver_sources`` sources are planned by
    the driver and sent to every task; more are planned by aggregates and joined, to the same quotas.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
    )
    sized = materialise(sized, "mixing-sizes")  # the words are counted once
    totals = sized.groupBy("_source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    rows = totals.limit(max(0, driver_sources) + 1).collect()
    if len(rows) <= driver_sources:
        rows.sort(key=lambda r: (r._source is None, r._source or ""))
        sizes = [r.n for r in rows]
        goals = source_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], max_repeat)
        words = source_words(sizes, goals, block_tokens, max_repeat)
        plan = spark.createDataFrame([(r._source, r.n, r.docs, g, w) for r, g, w in zip(rows, goals, words)], "_source string, n bigint, docs bigint, goal double, words bigint")
        send = F.broadcast
    else:
        plan, send = plan_many(materialise(totals, "mixing-totals"), weights, max_repeat, block_tokens), lambda x: x
    n, unit = F.col("n"), F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(F.col("n") / 64)))
    passes = F.when(n > 0, F.least(F.floor(F.col("words") / n), F.lit(max_repeat))).otherwise(0)
    plan = plan.select("_source", n.alias("source_size"), F.col("goal").alias("target"), passes.alias("_passes"), unit.alias("_unit"), F.round((F.col("words") - passes * n) / unit).cast("bigint").alias("_blocks"), F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("docs") / SHARD_DOCS))).alias("_shards"))
    placed = (
        sized.withColumnRenamed("_source", "_s").join(send(plan), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")
        .withColumn("_order", F.xxhash64(F.lit(seed), "_id", "size")).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_id", "size"), "_shards"))
    )

    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("_shard")
        caps = (-(-shards._words // shards._unit)).astype(int).tolist()
        shards["_quota"] = sainte_lague(shards._words.astype(float).tolist(), int(shards._blocks.iloc[0]), caps)
        shards["_n"] = [max(1, c) for c in caps]
        shards["_step"] = [next(s for s in count(max(1, int(n * 0.6180339887498949))) if gcd(s, n) == 1) for n in shards._n]
        return shards[["_source", "_shard", "_quota", "_n", "_step"]]

    shards = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"), F.first("_unit").alias("_unit"))
    shards = shards.groupBy("_source").applyInPandas(quotas, "_source string, _shard bigint, _quota bigint, _n bigint, _step bigint")
    line = Window.partitionBy("_source", "_shard").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("_at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    s = shards.select(F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_quota", "_n", "_step")
    cut = lined.join(s, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
    # Block j of a shard with n blocks is taken if its seeded place (step * j + shift) mod n is below the quota; step is
    # the first of n/phi, n/phi + 1, ... without a factor in common with n.
    cut = cut.withColumn("_shift", F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), "_n"))
    end, unit = F.col("_at") + F.col("size"), F.col("_unit")
    # Blocks of a shard lie at equal distances on its line, so a document meets (its size / unit) + 2 of them at most.
    ids = F.sequence(F.floor(F.col("_at") / unit), F.floor((end - 1) / unit))
    held = F.when((F.col("size") > 0) & (F.col("_quota") > 0), ids).otherwise(F.array().cast("array<bigint>"))
    part = F.aggregate(
        held, F.lit(0).cast("bigint"),
        lambda acc, j: acc + F.when(F.pmod(j * F.col("_step") + F.col("_shift"), F.col("_n")) < F.col("_quota"), F.least(end, (j + 1) * unit) - F.greatest(F.col("_at"), j * unit)).otherwise(F.lit(0)),
    )
    return cut.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", (F.col("_passes") * F.col("size") + part).cast("bigint").alias("taken"))

