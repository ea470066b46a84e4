"""Interaction audit of text filters: what each removes in every order, and its Shapley share by the multilinear extension.

A part of the corpus is known by how many documents fail each set of filters (its mask counts).  With x_i the chance that
filter i is applied, the expected number of removals is the polynomial

    R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)),

kept by its coefficients a(S) = (-1)^(|S|+1) * sum of count(m) over m that contain S.  R at a corner is what a set of
filters removes, which gives every step of every order; the Shapley value of i is the integral of dR/dx_i along the
diagonal, the sum of a(S)/|S| over S that contain i.  Scaled by 5! each 1/|S| is an integer, so all arithmetic is exact.

Documents are read once.  A filter on the text alone is a bit of its mask; equal texts are grouped by digest before they
meet, so a text with many copies is few rows.

Defined results: a null text is empty; a null part is the empty string; a null id has no label, fails no filter for
repeated texts and makes no other text fail it; of labels that repeat an id one with the value suffices; rows that repeat the
least id of a text all keep it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "ABCDE"
FULL = 1 << len(LETTERS)
MEASURES = ("n", "good", "toxic")


def failed_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: short, repetitive, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (
        count < 200,
        100 * distinct.cast("bigint") < 50 * count.cast("bigint"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text).cast("bigint"),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")
    slim = docs.select(F.col("doc_id").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), part, failed_mask(text).alias("mask"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    group = ["digest", "part", "mask", "good", "toxic"]
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    # How many rows share an id is counted where the join has put them; rows without one skip the join, where they would meet in one task.
    named = slim.where("id is not null").join(known, "id", "left").select("id", "digest", "part", "mask", *flag)
    named = named.groupBy("id", *group).agg(F.count("*").alias("rows")).groupBy(*group).agg(F.sum("rows").alias("n"), F.min(F.struct("id", "rows")).alias("least"))
    nameless = slim.where("id is null").groupBy("digest", "part", "mask").agg(F.count("*").alias("n"))
    nameless = nameless.select("digest", "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n", F.lit(None).cast(named.schema["least"].dataType).alias("least"))
    groups = named.unionByName(nameless).withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    kept = F.when(F.col("least").isNull(), F.col("n")).when(F.col("least.id") == F.col("first"), F.col("least.rows")).otherwise(0)
    repeat = 1 << LETTERS.index("E")
    split = groups.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - kept).alias("n")))))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _at(index: Column, values: str) -> Column:
    return F.get(values, index)


def coefficients(counts: str) -> Column:
    """Array a(S), S from 0 to 31, of a removal polynomial, from the array of its mask counts."""
    every = F.sequence(F.lit(0), F.lit(FULL - 1))

    def of(s: Column) -> Column:
        holds = F.aggregate(every, F.lit(0).cast("bigint"), lambda acc, m: acc + F.when(m.bitwiseAND(s) == s, _at(m, counts)).otherwise(0))
        return F.when(s == 0, F.lit(0).cast("bigint")).when(F.bit_count(s) % 2 == 1, holds).otherwise(-holds)

    return F.transform(every, of)


def corners(poly: str) -> Column:
    """Array R(T), T from 0 to 31: the polynomial with x_i = 1 for the filters of T and 0 for the others."""
    every = F.sequence(F.lit(0), F.lit(FULL - 1))
    return F.transform(every, lambda t: F.aggregate(every, F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(s.bitwiseAND(t) == s, _at(s, poly)).otherwise(0)))


def diagonal_integral(poly: str, bit: Column) -> Column:
    """5! times the integral of dR/dx_i over x_1 = ... = x_5 = t: each a(S) t^(|S|-1) gives a(S)/|S|."""
    every = F.sequence(F.lit(0), F.lit(FULL - 1))
    whole = factorial(len(LETTERS))
    share = F.create_map(*(F.lit(x) for k in range(1, len(LETTERS) + 1) for x in (k, whole // k)))
    return F.aggregate(every, F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(s.bitwiseAND(bit) == bit, _at(s, poly) * share[F.bit_count(s)]).otherwise(0))


def filter_interactions(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(docs, labels, part_col)
    per_part = counts.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(FULL))).alias(f"{c}_masks") for c in MEASURES))
    per_part = per_part.withColumns({f"{c}_poly": coefficients(f"{c}_masks") for c in MEASURES})
    per_part = per_part.withColumns({f"{c}_gone": corners(f"{c}_poly") for c in MEASURES})
    bits = [1 << i for i in range(len(LETTERS))]
    per_part = per_part.withColumn("shares", F.array(*(diagonal_integral("n_poly", F.lit(b)) for b in bits)))
    orders = per_part.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(o)) for o in permutations(LETTERS)))))
    rows = orders.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))

    def bits_of(letters: Column) -> Column:
        return sum((F.when(letters.contains(x), b).otherwise(0) for x, b in zip(LETTERS, bits)), F.lit(0))

    bit, before = bits_of(F.col("letter")), bits_of(F.substring("filter_order", F.lit(1), F.col("at")))
    after = before + bit
    gone = {c: _at(after, f"{c}_gone") - _at(before, f"{c}_gone") for c in MEASURES}
    total = F.aggregate("n_masks", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    alone = _at(F.lit(FULL - 1), "n_gone") - _at(FULL - 1 - bit, "n_gone")
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), (total - _at(after, "n_gone")).alias("kept"), gone["n"].alias("removed"), (_at(bit, "n_gone") - gone["n"]).alias("redundant"), alone.alias("unique_fails"),
        gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), F.get("shares", F.ascii("letter") - ord(LETTERS[0])).alias("shapley"),
    )
