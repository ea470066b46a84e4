"""Decontamination: whole items inside texts, and what goes for which reason; ``neighbours`` has the similarity joins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Benchmark items of up to so many bytes go to every task at once; shorter ones of more go in blocks of this size, one pass each.
ITEM_BYTES = 8 << 20


def in_blocks(rows: DataFrame, key: str, size: int, limit: int, scan: Callable[[list], DataFrame]) -> DataFrame:
    """The union of ``scan(block)`` over blocks of ``rows`` of about ``limit`` bytes each; ``size`` is what all take."""
    n = max(1, -(-size // limit))
    if n == 1:
        return scan(rows.collect())
    blocks = (rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == b).collect() for b in range(n))
    return reduce(DataFrame.unionByName, [scan(b) for b in blocks])


_searchers: dict[bytes, object] = {}


def _searcher(items: list[str]):
    """An automaton over all items, made once a worker."""
    import ahocorasick

    name = hashlib.blake2b("\0".join(items).encode(), digest_size=16).digest()
    if name not in _searchers:
        _searchers.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for x in items:
            found.add_word(x)
        found.make_automaton()
        _searchers[name] = found
    return _searchers[name]


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _pair_hashes(words: Column) -> Column:
    """Hashes of neighbouring words."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda x, y: F.xxhash64(x, y))


def _bitmap(keys: DataFrame, most_bits: int) -> tuple[Column, int]:
    """(array of 64-bit words as a literal, number of bits): a bit is set for each key's lowest bits; at least 16 bits a key up to ``most_bits``."""
    bits = 1 << 12
    n = keys.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    at = F.pmod("_pair", F.lit(bits))
    found = keys.groupBy(F.floor(at / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(_pair, 64) as int))")).alias("b")).collect()  # at most bits / 64 numbers
    held = dict(map(tuple, found))
    # A literal of many numbers in one expression: parsed once, when the plan is made.
    return F.from_json(F.lit(str([held.get(w, 0) for w in range(bits // 64)])), "array<bigint>"), bits


#: Bits of the filter of item pairs that every task gets: 128 kB.  More items than it can tell apart let more pairs through; the join decides.
FILTER_BITS = 1 << 20


def holding(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, limit: int = ITEM_BYTES) -> DataFrame:
    """Distinct keys of the texts that hold some whole item.

    An item of four or more words is met by the longest pair of its neighbouring inner words, which stands whole in any text
    that holds it.  The pairs of all items set bits of a small filter; a text's pairs are hashed and filtered where the text
    is read, so that only likely hits are exploded and joined, and a text is fetched once for each item it may hold.  Shorter
    items are few different words and go to every task, in blocks of ``limit`` bytes, as one automaton that reads a text once.
    """
    items = items.select(F.col(item).alias("_item")).where(F.length(F.trim("_item")) > 0).distinct()
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = texts.schema["_key"].dataType.simpleString()

    def search(block: list) -> DataFrame:
        wanted = sorted(r[0] for r in block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _searcher(wanted) if wanted else None
            for batch in batches:
                hit = [found is not None and t is not None and next(found.iter(t), None) is not None for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["_key"])

        return texts.mapInArrow(scan, f"_key {kind}")

    words = _words(F.col("_item"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    rest = F.greatest(F.size(inner) - 1, F.lit(0))
    longest = F.array_min(F.zip_with(F.slice(inner, 1, rest), F.slice(inner, 2, rest), lambda x, y: F.struct((-F.length(x) - F.length(y)).alias("l"), F.xxhash64(x, y).alias("h"))))["h"]
    keyed = items.where(F.size(words) >= 4).select("_item", longest.alias("_pair"))
    hits = []
    bitmap, bits = _bitmap(keyed.select("_pair").distinct(), FILTER_BITS)

    def likely(filter_words: Column, hashes: Column) -> Column:
        return F.filter(hashes, lambda h: F.getbit(F.get(filter_words, F.floor(F.pmod(h, F.lit(bits)) / 64).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1)

    grams = texts.select("_key", F.explode(F.array_distinct(likely(bitmap, _pair_hashes(_words(F.col("_text")))))).alias("_pair"))
    may = grams.join(keyed, "_pair").select("_key", "_item").distinct()
    hits.append(may.join(texts, "_key").where(F.contains("_text", "_item")).select("_key"))
    short = items.where(F.size(words) < 4)
    size = short.agg(F.sum(F.octet_length("_item") + 64)).first()[0]
    if size:
        hits.append(in_blocks(short, "_item", size, limit, search))
    return reduce(DataFrame.unionByName, hits).distinct()


def knn_columns(train: DataFrame, refs: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Exact neighbours by expressions over all pairs: the form that others are tested against, for small tables."""
    pairs = train.join(refs).select("train_id", "ref_id", F.round(V.inner_product(F.col("train_vec"), F.col("ref_vec")), digits).alias("similarity"))
    w = Window.partitionBy("train_id").orderBy(F.col("similarity").desc(), "ref_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def removed_rows(corrupt: DataFrame, hashes: DataFrame, neighbours: DataFrame, least: float = 0.75) -> DataFrame:
    """train_id with flags corrupt, hash, cosine for every removed row: a full outer union of the three reasons."""
    a = corrupt.select("train_id", F.lit(1).alias("corrupt"), F.lit(0).alias("hash"), F.lit(0).alias("cosine"))
    b = hashes.select("train_id", F.lit(0).alias("corrupt"), F.lit(1).alias("hash"), F.lit(0).alias("cosine"))
    c = neighbours.where((F.col("rank") == 1) & (F.col("similarity") >= least)).select("train_id", F.lit(0).alias("corrupt"), F.lit(0).alias("hash"), F.lit(1).alias("cosine"))
    return a.unionByName(b).unionByName(c).groupBy("train_id").agg(*(F.max(x).cast("boolean").alias(x) for x in ("corrupt", "hash", "cosine")))


def filter_summary(pool: DataFrame, corrupt: DataFrame, hashes: DataFrame, neighbours: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: original, hash_matches (match rows, not images), cosine_breaches, corrupt, removed (unique rows), clean."""
    first = neighbours.where((F.col("rank") == 1) & (F.col("similarity") >= least))
    gone = removed_rows(corrupt, hashes, neighbours, least)
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    parts = [one(pool, "original"), one(hashes, "hash_matches"), one(first, "cosine_breaches"), one(corrupt, "corrupt"), one(gone, "removed")]
    row = reduce(DataFrame.crossJoin, parts)  # one row each
    return row.withColumn("clean", F.col("original") - F.col("removed"))


def split_counts(rows: DataFrame, split: str, name: str) -> DataFrame:
    """Rows with a name in each split, and (split null) the distinct names of all."""
    named = rows.where(F.coalesce(F.col(name), F.lit("")) != "")
    whole = named.agg(F.countDistinct(name).alias("n")).select(F.lit(None).cast("string").alias(split), "n")
    return named.groupBy(split).agg(F.count(F.lit(1)).alias("n")).unionByName(whole)


def read_decontamination_log(spark, path: str) -> DataFrame:
    """A log written by ``write_decontamination_log``, one row a training row."""
    return spark.read.schema("train_id bigint, hash_matches array<struct<ref_id:bigint,distance:int>>, neighbours array<struct<rank:int,ref_id:bigint,similarity:double>>, corrupt boolean").json(path)


def write_decontamination_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def distance_histogram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def threshold_counts(neighbours: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """How many rows have their best neighbour at or above each threshold."""
    best = neighbours.where(F.col("rank") == 1)
    wide = best.agg(*(F.count_if(F.col("similarity") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)))).alias("r")).select("r.*")


def decontamination_log(matches: DataFrame, neighbours: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Per training row its matches and ranked neighbours as nested arrays, for a nested JSON sink."""
    m = matches.groupBy("train_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "distance"))).alias("hash_matches"))
    n = neighbours.groupBy("train_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "similarity"))).alias("neighbours"))
    return m.join(n, "train_id", "full").join(corrupt.select("train_id", F.lit(True).alias("corrupt")), "train_id", "full")
