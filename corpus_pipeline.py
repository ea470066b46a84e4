"""The corpus pipeline: language, near-duplicates, benchmark leaks, personal data, source weights.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents; the
last adds size, source_size, target and taken, in place of input columns of these names.

Defined results: a null, empty or letterless text has no language and goes with the first stage; a null id is a document of
its own; of rows that repeat id and text one stays, also of texts without words; a null source is a source of its own; of
equal near-duplicates the one with the smallest id stays; an empty table gives an empty table at every stage; other columns,
whatever their names, are carried through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import tile_benchmark
from tessera.llm.langid import UND, fit, predict_languages
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_sources
from tessera.llm.pii import mask_pii
from tessera.llm.storage import materialise, read_table

#: A document goes if no language was found, or if its best one does not rise above chance (1 of the languages) by this part of the rest.
LEAST_ABOVE_CHANCE = 0.1
#: The language model is fitted on at most so many labelled documents of at most so many bytes each.
TRAIN_DOCS, TRAIN_TEXT_BYTES = 1_600, 1 << 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those in no known language; without labels to learn from, none."""
    model = fit(docs, F.lit(True), TRAIN_DOCS, TRAIN_TEXT_BYTES, "doc_id", "text", "lang")
    if not model.labels:
        return docs
    # The operator sees the row as one column, so its own columns meet no others.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    known = predict_languages(docs.select(row, F.col("text").alias("text")), model, keep=("_row",))
    chance = 1 / len(model.labels)
    known = known.where((F.col("lang_pred") != UND) & (F.col("score") >= chance + LEAST_ABOVE_CHANCE * (1 - chance)))
    return known.select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of at least 0.8) stays."""
    # Of rows that repeat id and text one is chosen with its class; a null id meets only itself.
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    slim = docs.select("doc_id", "text")
    gone = near_duplicates(slim, width=5, percent=80).where(~F.col("chosen")).select(F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).alias("__pipeline_gone")).distinct()
    kept = docs.withColumn("__pipeline_key", key).join(gone, F.col("__pipeline_key").eqNullSafe(F.col("__pipeline_gone")), "left_anti").drop("__pipeline_key")
    if slim.groupBy("doc_id").count().where("count > 1").limit(1).count():  # rows that repeat id and text
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover a benchmark item go."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    tiled = tile_benchmark(docs.select(row, F.col("text").alias("text")), read_table(spark, sf_dir, "benchmark"), keep=("_row",))
    return tiled.where(~F.col("contaminated")).select("_row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind; n_chars follows the text."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words it takes of each, repeats counted."""
    added = ("size", "source_size", "target", "taken")
    docs = docs.drop(*added)
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    slim = docs.select(key.alias("__pipeline_key"), F.col("text").alias("text"), F.col("source").alias("source"))
    mixed = mix_sources(slim, id_col="__pipeline_key").where("taken > 0").groupBy("__pipeline_key").agg(*(F.max(c).alias(c) for c in added))
    return docs.withColumn("__pipeline_key", key).join(mixed.withColumnRenamed("__pipeline_key", "__pipeline_taken"), F.col("__pipeline_key").eqNullSafe(F.col("__pipeline_taken"))).drop("__pipeline_key", "__pipeline_taken")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("mixing", mix_to_weights),
]

#: Language model and sketches have no SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
