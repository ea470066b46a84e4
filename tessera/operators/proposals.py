"""Region proposals: best per tag, merged, deduplicated and cut to the best of the image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from .suppression import suppress_rows

SCHEMA = "struct<score:double,box:struct<x1:double,y1:double,x2:double,y2:double>,label:string>"


def merge_tag_proposals(images: DataFrame, found: DataFrame, per_tag: int = 1, most: int = 20, limit: float = 0.95, contained: bool = False) -> DataFrame:
    """(image_id, proposals): the ``per_tag`` best of each tag, then suppression and the ``most`` best of the image.

    images: (image_id); found: (image_id, tag, pos, score, box, phrase), an empty phrase means the tag.  An image with
    nothing found gets the whole image with score 0.  No image is gathered before its ``most`` best are left.
    """
    rank = F.row_number().over(Window.partitionBy("image_id", "tag").orderBy(F.col("score").desc(), "pos"))
    best = found.where(X.strip(F.col("tag")) != "").withColumn("_r", rank).where(F.col("_r") <= per_tag)
    label = F.coalesce(F.nullif(F.col("phrase"), F.lit("")), F.col("tag"))
    rows = best.select("image_id", F.col("score").cast("double").alias("score"), F.col("box").cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("box"), label.alias("label"), "pos", "_r")
    kept = suppress_rows(rows, "image_id", ["pos", "_r"], limit, contained, most)
    item = F.struct("score", "box", "label")
    lists = kept.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("p")))), lambda x: x["p"]).alias("l"))  # at most ``most`` each
    tried = rows.select("image_id").distinct().withColumn("_tried", F.lit(True))
    props = F.when(F.col("_tried"), F.coalesce("l", F.array().cast(f"array<{SCHEMA}>"))).otherwise(G.whole_image())
    return images.join(tried, "image_id", "left").join(lists, "image_id", "left").select("image_id", props.alias("proposals"))
