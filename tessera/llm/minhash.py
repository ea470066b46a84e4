"""MinHash near-duplicate detection with odd sketches.

A document's MinHash samples give band keys, and fold into an odd sketch: sample k with value v flips bit h(k, v) of a
parity bitmap.  The bits set in the XOR of two sketches estimate how many samples differ, most precisely at high
similarity.  Documents that share a band key are candidates; pairs whose sketches rule the similarity out are dropped; the
rest are confirmed on their full shingle sets.

Documents with equal sets are one class, found by a digest of the set.  Links join class representatives.  In each of a
few rounds a representative proposes its nearest bucket leader by sketch, so proposals are linear in the documents however
large a bucket is; confirmed proposals merge components.  Then only buckets that still hold several components are left.
There every pair of texts of different components is tried that the sketches allow, so no link that matters to a component is
missed.  Besides the samples' sketch a text has the parity bitmap of its whole set: differing bits never outnumber differing
shingles, so that bound drops no link and, on sets up to a few thousand shingles, hardly leaves a pair that is none.

Chances: 24 bands of 5 samples miss a pair at similarity 0.85 once in 1.3 million, and less above; the sketch bound is
``SKETCH_SLACK`` samples wide.

Defined results: null, empty and wordless texts have 0 shingles, no link and themselves as component; texts of fewer words
than a shingle have one shingle, the whole sequence; null ids are kept, belong to no component and are never kept copies of
others; rows that repeat an id are documents of their own, named by that id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Components
from .storage import discard, tidy
from .storage import materialise as _materialise
from .textvec import batch_slices, mix, powers, shingle_sets

materialise = partial(_materialise, codec="none")
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: Words of the parity bitmap of a whole set.
SET_WORDS = 16
#: Samples by which the differing count of a pair at the threshold may exceed its mean and still pass (5 deviations).
SKETCH_SLACK = 20
#: Linear rounds at most; they end early when one of them finds no link.
ROUNDS = 3
#: Texts of a bucket that the last round compares with the whole bucket in one task.
CELL = 256


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES smallest hash values (rows) of each non-empty set (columns)."""
    flat, begin = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    salts = powers(0xC2B2AE3D27D4EB4F, SAMPLES + 1)
    out = np.empty((SAMPLES, len(sets)), np.uint64)
    for k in range(SAMPLES):
        v = (flat ^ (flat >> np.uint64(31 - k % 7))) * salts[k + 1]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum.reduceat(v, begin, out=out[k])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, one row of SKETCH_WORDS words for each set."""
    n = samples.shape[1]
    salts = powers(0xD6E8FEB86659FD95, SAMPLES + 1)[1:, None]
    bit = (mix(samples * salts) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    counts = np.bincount((bit + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(">u8").astype(np.uint64)


def set_sketch(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Parity bitmaps of whole sets.  An XOR never has more bits than the sets have differing shingles."""
    n, bits = len(begin), 64 * SET_WORDS
    owner = np.zeros(len(flat), np.int64)
    owner[begin[1:]] = 1
    bit = (mix(flat * np.uint64(0xD6E8FEB86659FD95)) >> np.uint64(40)).astype(np.int64) % bits
    counts = np.bincount(bit + np.cumsum(owner) * bits, minlength=n * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, bits), axis=1).view(">u8").astype(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    weight = powers(0xA0761D6478BD642F, ROWS + 2)
    out = np.empty((BANDS, samples.shape[1]), np.uint64)
    for b in range(BANDS):
        key = np.full(samples.shape[1], b, np.uint64)
        for r in range(ROWS):
            key += mix(samples[b * ROWS + r]) * weight[r + 1]
        out[b] = mix(key)
    return out


def most_sketch_bits(threshold: float) -> int:
    """Set bits of the XOR that pairs at the threshold exceed with a chance below one in a million."""
    differing = 2 * (SAMPLES * (1 - threshold) + SKETCH_SLACK)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)) + 12


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, text hash, n_shingles, two digest words of the set, band keys and sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for _, _, data, starts in batch_slices(batch.column(1)):
                sets = shingle_sets(data, starts, width)
                n = len(sets)
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                keys, words, d = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_WORDS + SET_WORDS), np.uint64), np.zeros((n, 2), np.uint64)
                if len(some):
                    full = [sets[i] for i in some]
                    samples = minhash(full)
                    flat, begin = np.concatenate(full), np.concatenate(([0], np.cumsum(size[some])))[:-1]
                    keys[some], words[some] = band_keys(samples).T, np.hstack((odd_sketch(samples), set_sketch(flat, begin)))
                    d[some, 0], d[some, 1] = np.add.reduceat(mix(flat), begin), np.add.reduceat(mix(flat + np.uint64(0x9E3779B97F4A7C15)), begin)
                sizes.append(size), digests.append(d), bands.append(keys), sketches.append(words)
            if not sizes:
                continue
            listed = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, w), pa.int32()), pa.array(x.ravel().view(np.int64)))
            d = np.concatenate(digests).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), listed(np.concatenate(bands), BANDS), listed(np.concatenate(sketches), SKETCH_WORDS + SET_WORDS)],
                ["id", "h", "n_shingles", "d0", "d1", "bands", "sketch"],
            )

    schema = f"id {dict(docs.dtypes)[id_col]}, h bigint, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>, sketch array<bigint>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h")).mapInArrow(tidy(scan), schema)


def packed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            bodies = [squeeze(t) for t in batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["id", "body"])

    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    return docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(pack), f"id {_node(docs, id_col)}, body binary")


def _node(docs: DataFrame, id_col: str) -> str:
    """A class is named by the id and text hash of its first row: ids alone may repeat with other texts."""
    return f"struct<id:{dict(docs.dtypes)[id_col]},h:bigint>"


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (a, b) the pairs with 100 * intersection >= percent * union of their full sets."""
    kind = dict(pairs.dtypes)["a"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sides = []
                for c in (2, 3):
                    texts = pa.array([expand(x) for x in part.column(c).to_pylist()], pa.large_binary())
                    sides.append([s for _, _, data, starts in batch_slices(texts) for s in shingle_sets(data, starts, width)])
                keep = []
                for x, y in zip(*sides):
                    both = np.sort(np.concatenate((x, y)))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common) and common > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep))], ["a", "b"])

    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(tidy(check), f"a {kind}, b {kind}")


def _differ(x: str, y: str, first: int, words: int):
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(first + 1, first + words)), F.bit_count(F.col(x)[first].bitwiseXOR(F.col(y)[first])))


def _close(x: str, y: str, n: str, m: str, most: int, percent: int):
    """What both bitmaps allow: the samples' up to their slack, the sets' for certain."""
    apart = F.col(n) + F.col(m)  # 100 * common >= percent * union, so (100 + percent) * differing <= (100 - percent) * both sizes
    return ((100 + percent) * _differ(x, y, SKETCH_WORDS, SET_WORDS) <= (100 - percent) * apart) & (_differ(x, y, 0, SKETCH_WORDS) <= most)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, text_hash and chosen.

    ``kept`` compares ids; ``chosen`` is true only for the one text (id and xxhash64) that stands for its component, and
    for rows without shingles or id.
    """
    most = most_sketch_bits(percent / 100)
    signed = materialise(signatures(docs, width, id_col, text_col), "minhash")
    classes = signed.where("n_shingles > 0 and id is not null").groupBy("d0", "d1", "n_shingles").agg(F.min(F.struct("id", "h")).alias("rep"))
    classes = materialise(classes, "minhash-classes")
    # One row of each class carries its bands and sketch on.
    heads = classes.select(F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    reps = signed.join(heads, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select(F.struct("id", "h").alias("id"), "n_shingles", "bands", "sketch")
    member = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialise(member.join(shared, "bucket"), "minhash-members")
    sketches = materialise(reps.select("id", "n_shingles", "sketch", "bands").join(members.select("id").distinct(), "id", "left_semi"), "minhash-sketches")
    bodies = packed_texts(docs, id_col, text_col).join(sketches.select("id"), "id", "left_semi")
    bodies = materialise(bodies.dropDuplicates(["id"]), "minhash-texts")
    kind, spark = _node(docs, id_col), docs.sparkSession
    groups = Components()
    tried = spark.createDataFrame([], f"a {kind}, b {kind}")

    def labelled(frame: DataFrame) -> DataFrame:
        if groups.labels is None:
            return frame.withColumn("label", F.col("id"))
        return frame.join(groups.labels.withColumnsRenamed({"node": "id", "label": "_l"}), "id", "left").withColumn("label", F.coalesce("_l", "id")).drop("_l")

    k, linear = 0, True
    while True:
        now = labelled(members)
        # Each bucket has a leader of its own in every round, so a document meets many different ones.
        first = F.struct(F.xxhash64(F.lit(k), "bucket", "id"), F.col("id"))
        heads = now.groupBy("bucket").agg(F.min_by(F.struct("id", "label"), first).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
        heads = materialise(heads.select("bucket", F.col("h.id").alias("head"), F.col("h.label").alias("head_label"), "size"), "minhash-heads")
        if heads.isEmpty():
            break
        if linear:
            asked = now.join(heads, "bucket").where("label <> head_label").select("id", "head").repartition("id").distinct()  # dealt as the next join needs it
            x = sketches.select("id", F.col("sketch").alias("s"), F.col("n_shingles").alias("n"))
            y = sketches.select(F.col("id").alias("head"), F.col("sketch").alias("t"), F.col("n_shingles").alias("m"))
            near = asked.join(x, "id").join(y, "head").where(_close("s", "t", "n", "m", most, percent)).withColumn("bits", _differ("s", "t", 0, SKETCH_WORDS + SET_WORDS))
            # A document proposes to its nearest leader; all documents of other labels do so side by side.
            pairs = near.groupBy("id").agg(F.min_by("head", F.struct("bits", "head")).alias("head"))
        else:
            # A large bucket is split: one side is dealt over its cells, the other is sent to each of them.
            cells = F.ceil(F.col("size") / CELL).cast("int")
            left = now.join(heads.select("bucket", cells.alias("cells")), "bucket")
            left = left.join(sketches, "id").select("bucket", "band", "id", "label", "sketch", "bands", "n_shingles", "cells")
            x = left.select("bucket", F.pmod(F.xxhash64("id"), "cells").cast("int").alias("cell"), "band", F.col("id").alias("a"), F.col("label").alias("la"), F.col("sketch").alias("s"), F.col("bands").alias("p"), F.col("n_shingles").alias("n"))
            y = left.select("bucket", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("id").alias("b"), F.col("label").alias("lb"), F.col("sketch").alias("t"), F.col("bands").alias("q"), F.col("n_shingles").alias("m"))
            once = F.array_position(F.zip_with("p", "q", lambda u, v: u == v), F.lit(True)) == F.col("band") + 1
            pairs = x.join(y, ["bucket", "cell"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _close("s", "t", "n", "m", most, percent) & once)
            pairs = pairs.select(F.col("a").alias("id"), F.col("b").alias("head"))
        pairs = pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "minhash-pairs")
        tried = tried.union(pairs)
        links = materialise(confirm(pairs, bodies, width, percent), "minhash-links")
        found = not links.isEmpty()
        if found:  # exact only at the end: labels that lag behind only leave a pair more to try
            groups.add(links, rounds=2 if linear else None)
        if not linear:
            break
        k += 1
        linear = found and k < ROUNDS
    discard(bodies)
    if groups.open is not None:
        groups.add(spark.createDataFrame([], f"a {kind}, b {kind}"), rounds=None)
    labels = groups.labels
    rows = signed.select("id", "h", "n_shingles", "d0", "d1").join(classes, ["d0", "d1", "n_shingles"], "left")
    root = F.col("rep")
    if labels is not None:
        rows = rows.join(labels.withColumnsRenamed({"node": "_n", "label": "_l"}), F.col("rep") == F.col("_n"), "left")
        root = F.coalesce("_l", "rep")
    own = F.col("id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(own, F.col("id")).otherwise(root["id"])
    return rows.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        F.col("h").alias("text_hash"), (own | F.coalesce((root["id"] == F.col("id")) & (root["h"] == F.col("h")), F.lit(False))).alias("chosen"),
    )
