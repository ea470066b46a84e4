"""Pool building: unions, validation, exclusion with reasons, caps and ordinals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def union_pool(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of samples; source_order and ordinal already carry the order."""
    return reduce(DataFrame.unionByName, frames)


def number_rows(df: DataFrame, order: list[str], name: str = "train_idx", partitions: int | None = None) -> DataFrame:
    """Dense 0-based index in the given order.

    Rows are range-partitioned by the order and numbered within their partition; only one count a partition is summed
    over all of them, so no task holds the whole table.  The partitions are settled first: their borders come from a
    sample, and the counts must be of the same partitions as the numbers.
    """
    spread = settled(df.repartitionByRange(*([partitions] if partitions else []), *order).withColumn("__part", F.spark_partition_id()), "numbered")
    inside = spread.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    before = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__part", "__row", "__before")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregate, so repeats of a hot key combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def sample_errors(image: Column, boxes: Column, question: Column, answer: Column, source: Column, question_id: Column, image_id: Column) -> Column:
    """Array of error texts in a fixed order; empty if the sample is fine."""
    named = {"image_path": image, "boxes": boxes, "question": question, "answer": answer, "source": source, "question_id": question_id, "image_id": image_id}
    checks = [F.when(c.isNull(), F.lit(f"missing key: {k}")) for k, c in named.items()]
    for k, c in (("question", question), ("answer", answer)):
        checks.append(F.when(~F.coalesce(c, F.lit("")).rlike(r"(?U)\S"), F.lit(f"empty {k}")))
    checks.append(F.when(F.coalesce(F.size(boxes), F.lit(0)) <= 0, F.lit("no boxes")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def box_errors(boxes: Column) -> Column:
    """For boxes still held as plain arrays: those without four numbers."""
    return F.transform(F.filter(boxes, lambda b: F.size(b) != 4), lambda b: F.concat(F.lit("invalid box length: "), F.to_json(b)))


def fail_on_errors(df: DataFrame, errors: str) -> DataFrame:
    return df.where(F.when(F.size(errors) == 0, F.lit(True)).otherwise(F.raise_error(F.array_join(errors, "|")).cast("boolean")))


#: Which ids exclude samples of each source, in the order in which reasons are tried; whole numbers compare as numbers.
EXCLUSIONS = (("gqa", "question"), ("visual7w", "question"), ("vqav2", "question"), ("vqav2", "image"), ("vcr", "question"), ("aokvqa", "question"))
NUMERIC = ("vqav2",)


def _id_key(source: Column, value: Column) -> Column:
    number = F.when(value.rlike(r"^\d+$"), F.regexp_replace(value, r"^0+(?=\d)", ""))
    return F.when(source.isin(*NUMERIC), number).otherwise(value)


def exclusion_reason(samples: DataFrame, excluded: DataFrame) -> DataFrame:
    """samples (source, question_id, image_id, ...) with ``reason`` such as gqa_question, null if clean.

    excluded: (source, id_kind, id).  One left join for each kind of id; keys are distinct, so no row multiplies.
    """
    ids = excluded.select(F.col("source").alias("_s"), "id_kind", _id_key(F.col("source"), F.col("id")).alias("_i")).distinct()
    out = samples
    for kind in ("question", "image"):
        side = ids.where(F.col("id_kind") == kind).select(F.col("_s"), F.col("_i"), F.lit(True).alias(f"_{kind}"))
        out = out.join(side, (F.col("source") == F.col("_s")) & (_id_key(F.col("source"), F.col(f"{kind}_id")) == F.col("_i")), "left").drop("_s", "_i")
    whens = [F.when((F.col("source") == s) & F.col(f"_{k}"), F.lit(f"{s}_{k}")) for s, k in EXCLUSIONS]
    return out.withColumn("reason", F.coalesce(*whens)).drop("_question", "_image")


def summary(pool: DataFrame, image: str, source: str) -> DataFrame:
    """One row: total_rows, unique_images, by_source map."""
    by = pool.groupBy(F.coalesce(source, F.lit("unknown")).alias("s")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "count")))).alias("by_source"))
    return pool.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct(image).alias("unique_images")).crossJoin(by)


def removal_table(removed: DataFrame, pool: DataFrame, by: str) -> DataFrame:
    """by, total, removed, remaining, percent; ``removed`` has a flag column of the same rows as ``pool``."""
    total = pool.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    gone = removed.groupBy(by).agg(F.count(F.lit(1)).alias("removed"))
    n = F.coalesce("removed", F.lit(0))
    return total.join(gone, by, "left").select(by, "total", n.alias("removed"), (F.col("total") - n).alias("remaining"), F.round(100.0 * n / F.col("total"), 6).alias("pct"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps no more than k of a group in a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def cap_rows(df: DataFrame, group: list[str], size: Column, place: Column, k: int) -> DataFrame:
    """Row form of the box cap: groups of more than k rows keep their k largest, others all."""
    g = Window.partitionBy(*group)
    ranked = df.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_r", F.row_number().over(g.orderBy(size.desc(), place)))
    return ranked.where((F.col("_n") <= k) | (F.col("_r") <= k)).drop("_n", "_r")


def overshoot(groups: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """Whole groups in order until ``most`` rows are reached; the group that reaches it is still taken.

    Sizes are summed within blocks of the order first and only the block sums are summed over all.
    """
    block = settled(groups.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "overshoot")
    sums = block.groupBy("_p").agg(F.sum(size).alias("s")).withColumn("_b", F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.coalesce(F.sum(size).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("_run", run).join(F.broadcast(sums.select("_p", "_b")), "_p").where(F.col("_run") + F.col("_b") < most).drop("_run", "_b", "_p")


def unlike_boxes(df: DataFrame, group: str, boxes: str) -> DataFrame:
    """Groups whose rows disagree on their boxes."""
    return df.groupBy(group).agg(F.countDistinct(F.to_json(boxes)).alias("n")).where("n > 1")


def box_audit(df: DataFrame, boxes: str, most: int, width: str, height: str) -> DataFrame:
    """Counts, at-cap share and boxes that are improper or leave the image."""
    n = F.size(boxes)
    bad = lambda f: F.sum(F.size(F.filter(boxes, f)))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(n).alias("min_boxes"), F.max(n).alias("max_boxes"), F.avg(n).alias("mean_boxes"), (100 * F.avg((n == most).cast("int"))).alias("at_cap_pct"),
        F.count_if(n == 0).alias("no_boxes"), bad(lambda b: (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"])).alias("improper"), bad(lambda b: (b["x1"] < 0) | (b["y1"] < 0)).alias("negative"),
        bad(lambda b: (b["x2"] > F.col(width)) | (b["y2"] > F.col(height))).alias("outside"),
    )


def path_counts(ids: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """One row: unique ids, how many have a file (columns of ``files``: key, path), and how many are missing."""
    have = files.select(F.col(key).alias("_k")).distinct().withColumn("_there", F.lit(1))
    j = ids.select(key).distinct().join(have, F.col(key) == F.col("_k"), "left")
    return j.agg(F.count(F.lit(1)).alias("unique_ids"), F.count("_there").alias("matched"), F.count_if(F.col("_there").isNull()).alias("missing"))


def reference_union(frames: dict[str, DataFrame], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(distinct paths of all benchmarks, rows of each benchmark and of their union as ``union_unique``)."""
    every = reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("benchmark"), path) for k, f in frames.items()))
    unique = every.select(path).distinct()
    counts = every.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n")).unionByName(unique.agg(F.count(F.lit(1)).alias("n")).select(F.lit("union_unique").alias("benchmark"), "n"))
    return unique, counts


def pool_issues(rows: DataFrame, questions: DataFrame, coco: DataFrame, files: DataFrame) -> DataFrame:
    """(issue, n) of the audit of a pool against the data it came from; a row stops at the first missing thing.

    rows: question_id, image_id, image_path, boxes; questions: question_id, image_id; coco: image_id, file_name, width, height,
    boxes; files: path, width, height of the images that exist.
    """
    q = questions.select(F.col("question_id").alias("_q"), F.col("image_id").alias("_qi"))
    f = files.select(F.col("path").alias("_p"), F.col("width").alias("_fw"), F.col("height").alias("_fh"))
    c = coco.select(F.col("image_id").alias("_c"), "file_name", F.col("width").alias("_cw"), F.col("height").alias("_ch"), F.col("boxes").alias("_live"))
    j = rows.join(q, F.col("question_id") == F.col("_q"), "left").join(f, F.col("image_path") == F.col("_p"), "left").join(c, F.col("image_id") == F.col("_c"), "left")
    asked, there, known = F.col("_q").isNotNull(), F.col("_p").isNotNull(), F.col("_c").isNotNull()
    whole = asked & there & known
    inside = lambda b: (b["x1"] >= 0) & (b["x1"] < b["x2"]) & (b["x2"] <= F.col("_fw")) & (b["y1"] >= 0) & (b["y1"] < b["y2"]) & (b["y2"] <= F.col("_fh"))
    # Names of the issues.
    issues = {
        "missing_vqav2_question": ~asked, "question_image_id_mismatch": asked & (F.col("_qi") != F.col("image_id")), "missing_image_file": asked & ~there, "missing_coco_index": asked & there & ~known,
        "filename_mismatch": whole & (F.element_at(F.split("image_path", "/"), -1) != F.col("file_name")), "size_mismatch_coco_json": whole & ((F.col("_fw") != F.col("_cw")) | (F.col("_fh") != F.col("_ch"))),
        "boxes_differ_from_live_coco": whole & ~F.col("boxes").eqNullSafe(F.col("_live")), "box_out_of_bounds": whole & F.exists("boxes", lambda b: ~inside(b)),
    }
    counted = j.agg(*(F.count_if(v).alias(k) for k, v in issues.items()))
    unlike = unlike_boxes(rows, "image_id", "boxes").agg(F.count(F.lit(1)).alias("inconsistent_boxes_same_image"))
    wide = counted.crossJoin(unlike)  # one row each
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in wide.columns))).alias("r")).select("r.*")


def union_ids(frames: list[DataFrame]) -> DataFrame:
    """Distinct ids of several lists (each with its ids in the first column, whatever its name), as text; nulls are no ids."""
    ids = [f.select(F.col(f.columns[0]).cast("string").alias("id")).where("id is not null").distinct() for f in frames]
    return reduce(DataFrame.unionByName, ids).distinct()


def without_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is not listed; a null key stays."""
    return rows.join(ids.select(F.col("id").alias("_listed")), F.col(key).cast("string") == F.col("_listed"), "left_anti")


def resolve_pointers(images: DataFrame, key: str, value: str, short: int = 64) -> DataFrame:
    """(key, resolved, hops): values of at most ``short`` characters name another key.  Missing targets and cycles give null.

    Chains of any length: each round every open row jumps to where its target has jumped already, so a chain of n is done in
    about log2(n) rounds; a row whose jumps add up to more than there are pointers walks a cycle.  Of values that repeat a
    key the greatest counts.  Only keys and jump lengths travel; payloads are joined once at the end.
    """
    base = images.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.trim(F.col(value).cast("string")).alias("v"))
    base = settled(base.groupBy("k").agg(F.max("v").alias("v")), "pointer-values")
    is_pointer = F.length("v") <= short
    state = settled(base.where(is_pointer).select("k", F.col("v").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.lit(True).alias("open")), "pointers")
    limit = state.count()
    while True:
        # A target that is no pointer (payload or missing) ends the chain.
        ahead = state.select(F.col("k").alias("_k"), F.col("at").alias("_at"), F.col("hops").alias("_hops"))
        jumped = state.where("open").join(ahead, F.col("at") == F.col("_k"), "left")
        more = F.col("_k").isNotNull() & (F.col("hops") + F.coalesce("_hops", F.lit(0)) <= limit)
        moved = jumped.select("k", F.coalesce("_at", "at").alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), more.alias("open"))
        state = settled(state.where(~F.col("open")).unionByName(moved), "pointers")
        if not state.where("open").limit(1).count():
            break
    full = base.where(~is_pointer).select(F.col("k").alias("at"), F.col("v").alias("resolved"))
    followed = state.join(full, "at", "left").select("k", "resolved", F.when(F.col("hops") <= limit, F.col("hops")).alias("hops"))
    return followed.unionByName(base.where(~is_pointer).select("k", F.col("v").alias("resolved"), F.lit(0).cast("bigint").alias("hops")))
