"""SpotSigs document fingerprints.

A signature is a common word (the anchor) with the chain of up to CHAIN content words that follow it.  A text is known by the
set of its signatures.  Its printed fingerprint is the whole set, as 64-bit hashes, so the likeness of two texts can be
worked out from their fingerprints alone.

Likeness is the Jaccard measure, compared by length partition and pruning: with a least likeness of interest, sets whose
lengths lie in partitions too far apart to reach it are 0 at once, and the walk over two sets stops with 0 where the
signatures left cannot lift it there any more.  The report asks for every likeness (least 0), so only what proves 0 is
skipped; near-duplicate search compares only sets in the same or the next length partition.

Defined results: ids are integers, and -2^63 counts as null; null and empty texts have an empty set and are like each other only; a text without signatures is known by its
words, one without words by its bytes; ties in the id order go by a hash of the text; null ids come first; the next document of
the last row is the first; a single row is its own next document; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, tidy
from .textvec import LOWER, mix, powers, prefix_hash, row_counts, slices, span_hash, word_spans

# Common words that serve as anchors (English, French, German, Spanish).
ANCHORS = (
    "the of and to in a is that for it as was with on be at by are from this or an have not which but had his her they you were their has been one all we can there if would who will no "
    "le la les de des du un une et en est que qui dans pour sur au aux par ne pas ce il elle avec sont plus se son sa ou mais comme nous vous "
    "der die das und ist ein eine den von zu mit sich auf für nicht im dem auch es an als werden aus er hat dass sie nach bei um am sind noch wie einem über "
    "el los las y una con por para del lo su al como más pero sus ya o este sí porque esta entre cuando muy sin sobre ser"
).split()
CHAIN = 3
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _anchor_hashes() -> np.ndarray:
    raw = [w.encode() for w in dict.fromkeys(ANCHORS)]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw])
    return np.sort(span_hash(prefix_hash(data), np.concatenate(([0], ends[:-1])), ends))


_anchors: np.ndarray | None = None


def signature_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit signature hashes of each text."""
    global _anchors
    if _anchors is None:
        _anchors = _anchor_hashes()
    n = len(starts) - 1
    raw, data = data, LOWER[data]
    first, last, row = word_spans(data, starts)
    out: list[np.ndarray] = []
    if len(first):
        # The word without leading and trailing marks such as commas and full stops.
        solid = np.flatnonzero(_LETTER[data])
        a = np.searchsorted(solid, first, "left")
        b = np.searchsorted(solid, last, "left")
        bare = b > a
        f, e = np.where(bare, solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else first, first), np.where(bare, solid[np.maximum(b - 1, 0)] + 1 if len(solid) else last, last)
        words = span_hash(prefix_hash(data), f, e)
        place = np.searchsorted(_anchors, words)
        is_anchor = _anchors[np.minimum(place, len(_anchors) - 1)] == words
        content = np.flatnonzero(~is_anchor & bare)
        spots = np.flatnonzero(is_anchor)
        at = np.searchsorted(content, spots)
        weight = powers(0xA0761D6478BD642F, CHAIN + 2)
        sig, length = words[spots] * weight[1], np.zeros(len(spots), np.uint64)
        for k in range(CHAIN):  # the chain ends with the text
            j = content[np.minimum(at + k, max(len(content) - 1, 0))] if len(content) else spots
            has = (at + k < len(content)) & (row[j] == row[spots])
            sig += np.where(has, words[j] * weight[k + 2], np.uint64(0))
            length += has
        spots, sig = spots[length > 0], sig[length > 0] + length[length > 0]
        sig, single = mix(sig), mix(words + np.uint64(1))
        sig_begin = np.concatenate(([0], np.cumsum(row_counts(row[spots], n))))
        word_begin = np.concatenate(([0], np.cumsum(row_counts(row, n))))
    for i in range(n):
        if len(first) and word_begin[i + 1] > word_begin[i]:
            mine = sig[sig_begin[i] : sig_begin[i + 1]]
            out.append(np.unique(mine if len(mine) else single[word_begin[i] : word_begin[i + 1]]))
        elif starts[i + 1] > starts[i]:
            out.append(np.frombuffer(hashlib.sha256(raw[starts[i] : starts[i + 1]].tobytes()).digest()[:8], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return [s for lo, hi in slices(starts) for s in signature_sets(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])]


def fingerprint(found: np.ndarray) -> str:
    """``length:base64`` of the set, ascending, 8 bytes each, highest first."""
    return f"{len(found)}:{base64.b64encode(found.astype('>u8').tobytes()).decode()}"


def parse_fingerprint(text: str) -> np.ndarray:
    """The set behind a fingerprint."""
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), ">u8").astype(np.uint64)


def length_partition(n: int, least: float) -> int:
    """Partitions are so wide that sets that can reach ``least`` lie in the same or in neighbouring ones."""
    return int(np.floor(np.log(n) / -np.log(least) + 1e-12))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0, step: int = 256) -> float:
    """Jaccard measure of two sorted sets, 0 if it is below ``least``.

    The sets are walked in hash order, ``step`` signatures of the first at a time.  What is left of each set bounds the
    common signatures still to come; the walk ends when even all of them would not do.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    if least > 0 and (abs(length_partition(n, least) - length_partition(m, least)) > 1 or min(n, m) < least * max(n, m)):
        return 0.0
    need = least / (1 + least) * (n + m) - 1e-9  # common / (n + m - common) >= least
    common = j = 0
    for i in range(0, n, step):
        if common + min(n - i, m - j) < need:
            return 0.0
        part = a[i : i + step]
        k = m if i + step >= n else int(np.searchsorted(b, part[-1], "right"))
        common += len(np.intersect1d(part, b[j:k], assume_unique=True))
        j = k
    found = common / (n + m - common)
    return found if found >= least else 0.0


def edited_text(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by as many first ones of the next text, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likeness to the edited and to the next text.

    ``id_col`` is an integer.  Ranges of ids are cut at ids of the table, so the first row of a range is known by its id
    and is sent to the range before it as well; texts cross the one shuffle compressed.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(low))
    asked = [k / parts for k in range(1, parts)] or [0.5]
    got = docs.select(key.alias("k")).agg(F.min("k").alias("least"), F.percentile_approx("k", asked, F.lit(max(10_000, 20 * parts))).alias("cuts")).first()
    least = low if got.least is None else got.least
    cuts = np.array(sorted({c for c in got.cuts or () if c > least}), np.int64)
    flat = docs.select(key.alias("k"), F.col(text_col).alias("t"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column(0).to_numpy()
            pids = np.searchsorted(cuts, keys, "right")
            ks, ps, roles, hashes, bodies = [], [], [], [], []
            for k, p, raw in zip(keys.tolist(), pids.tolist(), batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()):
                mark, body = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True), squeeze(raw)
                places = [(p, 0)]
                if p and cuts[p - 1] == k:
                    places.append((p - 1, 1))
                if k == least:
                    places.append((len(cuts), 1))
                for where, role in places:
                    ks.append(k), ps.append(where), roles.append(role), hashes.append(mark), bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(roles, pa.int32()), pa.array(ks, pa.int64()), pa.array(hashes, pa.int64()), pa.array(bodies, pa.binary())], ["pid", "role", "k", "h", "body"])

    def work(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        """Rows but the last, each with the row after it."""
        sets = text_sets([t.encode("utf-8", "surrogatepass") for _, t in rows])
        edits = [edited_text(t, u).encode("utf-8", "surrogatepass") for (_, t), (_, u) in zip(rows, rows[1:])]
        edited = text_sets(edits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if k == low else k for k, _ in rows[:-1]], pa.int64()), pa.array([len(t) for _, t in rows[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits]), pa.array([fingerprint(s) for s in sets[:-1]]), pa.array([fingerprint(s) for s in edited]),
                pa.array([likeness(a, b) for a, b in zip(sets, edited)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(sets, sets[1:])], pa.float64()),
            ],
            ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int, str]] = []
        pid, closed, size = None, False, 0
        for batch in batches:
            for p, role, k, body in zip(*(batch.column(c).to_pylist() for c in ("pid", "role", "k", "body"))):
                if p != pid:
                    pid, closed, held, size = p, False, [], 0
                if closed:
                    continue
                text = expand(body).decode("utf-8", "surrogatepass")
                held.append((k, text))
                size += len(text)
                closed = role == 1
                if len(held) > 1 and (closed or size > 2_000_000):
                    yield work(held)
                    held, size = held[-1:], len(text)

    schema = "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    moved = flat.mapInArrow(tidy(pack), "pid int, role int, k bigint, h bigint, body binary").repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", "role", "k", "h")
    return moved.mapInArrow(tidy(pair), schema).withColumnRenamed("k", id_col)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives with likeness >= threshold over full signature sets, membership of every row).

    For corpora without a signature that very many different texts have among their first: pairs meet there.

    Texts with equal sets are one class.  Two sets can only reach the threshold if they share a hash among the first
    n - ceil(threshold * n) + 1 of each and lie in the same or neighbouring length partitions.
    """
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, ceil(bounds[-1] / threshold)))
    edges = np.array(bounds)
    id_type = dict(docs.dtypes)[id_col]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_sets(batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["id", "sigs"])

    rows = materialise(docs.select(id_col, text_col).mapInArrow(sets, f"id {id_type}, sigs array<bigint>").withColumn("class", F.sha2(F.to_json(F.col("sigs")), 256)), "spot-sets")
    classes = rows.groupBy("class").agg(F.min("id").alias("rep"), F.any_value("sigs").alias("sigs"))
    n = F.size("sigs")
    part = F.expr(f"size(filter(array({','.join(f'{b}L' for b in edges)}), b -> b <= size(sigs)))")
    # Postings carry no sets: those are fetched once for each candidate pair.
    index = classes.where(n > 0).select("rep", n.alias("n"), part.alias("part"), F.explode(F.slice("sigs", 1, n - F.ceil(n * threshold).cast("int") + 1)).alias("sig"))
    left = index.select(F.col("rep").alias("a"), F.col("n").alias("na"), "part", "sig")
    right = index.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "sig")
    near = (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = materialise(left.join(right, ["part", "sig"]).where(near).select("a", "b").distinct(), "spot-pairs")
    pairs = pairs.join(classes.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.withColumn("likeness", both / (F.size("sa") + F.size("sb") - both)).where(F.col("likeness") >= threshold).select("a", "b", "likeness")
    return pairs, rows.join(classes.select("class", "rep"), "class").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"))
