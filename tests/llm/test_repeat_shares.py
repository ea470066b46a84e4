"""Which stage finds a repeated byte: equal snippets by their hashes, or the merge of transforms."""

from pyspark.sql import functions as F


def removed_by_stage(spark, docs):
    """(bytes that equal snippets cover, bytes that only the merge finds) of documents with distinct ids."""
    from tessera.llm import repeats as R

    flat = docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("th"), "text")
    found = flat.mapInArrow(R.find_occurrences, R.OCCURRENCE_SCHEMA).repartition(F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("id", "s")))
    settled = found.mapInArrow(lambda x: R.settle_occurrences(x, R.MANY, R.HOLD), R.OCCURRENCE_SCHEMA)
    ranges = settled.where("kind = 1").select("id", F.col("s").alias("a"), (F.col("s") + F.col("n") + R.WINDOW - 1).alias("b")).orderBy("id", "a").collect()
    covered, last, end = 0, None, 0
    for r in ranges:
        begin = max(r.a, end) if r.id == last else r.a
        end = max(r.b, end) if r.id == last else r.b
        covered, last = covered + max(0, end - begin), r.id
    total = R.remove_repeats(docs).agg(F.sum("n_removed")).first()[0]
    return covered, total - covered


def test_both_stages_decide(spark):
    """Whole copies are equal snippets; a passage in different surroundings meets in the merge."""
    sentence = "the {} river runs past the old mill and the stone bridge of the town where {} people meet on market days in summer "
    texts = [sentence.format(i, i * 7) * 3 for i in range(30)]
    passage = "a passage of more than one hundred bytes that several documents share, although what stands before and after it differs each time."
    texts += texts[:10] + [f"{i} begins so {i * i} {passage} and ends {i * 31} so" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    equal, merged = removed_by_stage(spark, docs)
    assert equal > 0 and merged > 0
