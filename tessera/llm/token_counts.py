"""Token counts with a digest cache.

A text is keyed by the digest of its normalised content together with the digest of the tokenizer file.  Keys are
joined to a stored table of counts; only distinct misses are encoded, and their counts are appended to the table.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are encoded once and keep their own rows;
an empty table gives no rows; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import scratch_path, tidy
from .textvec import slices
from .words import SLICE_BYTES, word_ids

CACHE_SCHEMA = "digest binary, n_tokens bigint"


def piece_counts(path: str, texts: list[bytes]) -> list[int]:
    """Counts by a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(x) for x in model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]


def count_tokens(path: str, texts: list[bytes]) -> list[int]:
    """Tokens of each text, a few MB of texts at a time."""
    if path.endswith(".model"):
        return piece_counts(path, texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    out: list[int] = []
    for lo, hi in slices(starts, SLICE_BYTES):
        out += word_ids(path).counts(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]).tolist()
    return out


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another vocabulary never meets this one's counts."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def content_digest(text: Column, version: str) -> Column:
    """Digest of (tokenizer version, normalised content); normalising is null -> empty, which changes no count."""
    body = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    return F.unhex(F.sha2(F.concat(F.lit(version + "\0").cast("binary"), body), 256))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``cache`` is a Parquet folder of earlier counts (made if missing); without it a fresh one is used for this call.
    Each input partition sends a content once, compressed; the partition of its digest encodes it once.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_version(tokenizer)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = hashlib.sha256((version + "\0").encode())
        squeeze, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            digests, bodies = [], []
            for body in batch.column(0).cast(pa.large_binary()).fill_null(b"").to_pylist():
                h = prefix.copy()
                h.update(body)
                if (d := h.digest()) not in seen:
                    seen.add(d)
                    digests.append(d)
                    bodies.append(squeeze(body))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, seen = zstandard.ZstdDecompressor().decompress, set()
        for batch in batches:
            new = {d: b for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d not in seen}
            seen.update(new)
            counts = count_tokens(tokenizer, [expand(b) for b in new.values()])
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    contents = docs.select(F.col(text_col).alias("_text")).mapInArrow(tidy(pack), "digest binary, body binary").repartition("digest")
    misses = contents.join(stored().select("digest"), "digest", "left_anti")
    misses.mapInArrow(tidy(encode), CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = stored().groupBy("digest").agg(F.max("n_tokens").alias("_n"))
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), content_digest(F.col(text_col), version).alias("_digest"))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return rows.join(known, F.col("_digest") == F.col("digest"), "left").select(id_col, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
