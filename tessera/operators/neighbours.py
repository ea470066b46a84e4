"""Similarity joins of training rows with references: Hamming distance within a radius, and the k most similar by inner product.

Neither side passes through the driver.  Selective radii use an exact index of wide bands; other radii, and the vector
products that bounds cannot rule out, are numpy products of packed blocks, which are rows of tables and meet by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import bounded_batches, settled

#: The index is used if it brings at most this share of all pairs together, with at most so many probes a band and reference.
INDEX_SHARE, MOST_PROBES = 0.02, 400
#: Rows of a packed block.
TRAIN_BLOCK, REF_BLOCK = 4_096, 4_096
#: Rows of a batch that a task sends on: a training row may go to every cell.
SENT_ROWS = 8_192
#: Cells of references for the vector bounds; their centres and radii are what every task gets (at most so many vectors).
PIVOTS = 64
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def probe_plan(bits: int, limit: int) -> tuple[int, list[int], float]:
    """(bands, radius of each band, share of random pairs that meet) of the best index for a radius.

    With limit = m * r + a, two hashes within ``limit`` differ by at most r bits in one of the first a + 1 of m bands, or by
    at most r - 1 in one of the others: if not, they differ by more than ``limit`` in all.
    """
    best = (0, [], 1.0)
    for m in range(1, min(max(limit + 1, 4), bits) + 1):
        width = -(-bits // m)
        r, a = divmod(limit, m)
        radii = [r if k <= a else r - 1 for k in range(m)]
        probes = [sum(comb(width, i) for i in range(x + 1)) for x in radii]
        share = sum(p * 2.0 ** -(bits // m) for p in probes)
        if width <= 62 and max(probes) <= MOST_PROBES and share < best[2]:
            best = (m, radii, share)
    return best


def band_values(words: Column, bits: int, count: int) -> Column:
    """The bits in ``count`` disjoint runs, as numbers."""
    return F.transform(V.bands(words, bits, count), lambda b: F.conv(b, 2, 10).cast("bigint"))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def hamming_indexed(train: DataFrame, refs: DataFrame, limit: int, words: int, bits: int) -> DataFrame:
    """(train_id, ref_id, distance) within ``limit``, by probing wide bands.

    Distinct hashes meet, not rows, so a hash that many images share is one key; a reference's band is sent under every key
    within the band's radius, a training row's under its own.  A pair is kept in the first band that brings it together.
    """
    count, radii, _ = probe_plan(bits, limit)
    if not count:
        raise ValueError(f"no index of at most {MOST_PROBES} probes for radius {limit} of {bits} bits")
    size, extra = divmod(bits, count)
    widths = [size + (k >= count - extra) for k in range(count)]
    used = [k for k in range(count) if radii[k] >= 0]
    t = train.where("train_words is not null").select(F.col("train_words").alias("tw")).distinct().withColumn("tb", band_values(F.col("tw"), bits, count))
    r = refs.where("ref_words is not null").select(F.col("ref_words").alias("rw")).distinct().withColumn("rb", band_values(F.col("rw"), bits, count))
    own = t.select("tw", "tb", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col("tb")[k].alias("key")) for k in used))).alias("e")).select("tw", "tb", "e.*")
    probes = [_probes(k, widths[k], radii[k]) for k in used]
    sent = r.select("rw", "rb", F.explode(F.concat(*probes)).alias("e")).select("rw", "rb", "e.*")
    near = F.array(*(F.bit_count(F.col("tb")[k].bitwiseXOR(F.col("rb")[k])) <= radii[k] for k in used))
    first = F.array(*(F.lit(k) for k in used))[F.array_position(near, F.lit(True)).cast("int") - 1]
    apart = V.hamming(F.col("tw"), F.col("rw"), words)
    pairs = own.join(sent, ["band", "key"]).where((first == F.col("band")) & (apart <= limit)).select("tw", "rw", apart.alias("distance"))
    return _rows_of(pairs, train, refs)


def _probes(k: int, width: int, radius: int) -> Column:
    def probe(m: Column) -> Column:
        return F.struct(F.lit(k).alias("band"), F.col("rb")[k].bitwiseXOR(m).alias("key"))

    return F.transform(F.array(*(F.lit(m).cast("bigint") for m in _masks(width, radius))), probe)


def _rows_of(pairs: DataFrame, train: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs of hashes as pairs of the rows that have them."""
    with_train = pairs.join(train.select("train_id", F.col("train_words").alias("tw")), "tw")
    return with_train.join(refs.select("ref_id", F.col("ref_words").alias("rw")), "rw").select("train_id", "ref_id", F.col("distance").cast("int").alias("distance"))


def _packed(rows: DataFrame, size: int, key: str, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Blocks of about ``size`` rows by a hash of ``key``: (by, block, keys, values)."""
    by = by or []
    counted = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_n"))
    held = rows.join(counted, by) if by else rows.withColumn("_n", F.lit(counted.first()._n or 1))
    blocked = held.withColumn(name, F.pmod(F.xxhash64(key, F.lit(7)), F.col("_n")))
    return blocked.groupBy(*by, name).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias(f"{name}s")).select(*by, name, F.transform(f"{name}s", lambda x: x["k"]).alias(f"{name}_keys"), F.transform(f"{name}s", lambda x: x["v"]).alias(f"{name}_values"))


def _matrix(batch: pa.RecordBatch, column: str, i: int, dtype: type) -> np.ndarray:
    """The rows of one packed block as a matrix, without a Python value a number."""
    block = batch.column(column)[i].values
    return np.asarray(block.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(block), -1)


def hamming_cells(train: DataFrame, refs: DataFrame, limit: int, words: int) -> DataFrame:
    """(train_id, ref_id, distance) within ``limit`` for radii that no index narrows down: every block of training hashes meets every block of references.

    That is the work such a radius asks for.  Both sides are distinct hashes in packed blocks; a block is sent once for each
    block of the other side, and a task holds two blocks at a time.
    """
    t = settled(_packed(train.where("train_words is not null").select(F.col("train_words").alias("w"), F.col("train_words").alias("v")).distinct(), TRAIN_BLOCK, "w", "v", "t").select("t", "t_values"), "hamming-train")
    r = settled(_packed(refs.where("ref_words is not null").select(F.col("ref_words").alias("w"), F.col("ref_words").alias("v")).distinct(), REF_BLOCK, "w", "v", "r").select("r", "r_values"), "hamming-refs")
    count = lambda d: max(1, d.count())
    cells = t.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count(r) - 1).cast("bigint")))).join(r, "r")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_matrix(batch, c, i, np.int64) for c in ("t_values", "r_values"))
                mine, other = a.view(np.uint64), b.view(np.uint64)
                step = max(1, 4_000_000 // max(1, len(other)))
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    apart = sum(np.bitwise_count(part[:, None, k] ^ other[None, :, k]).astype(np.int32) for k in range(words))
                    x, y = np.nonzero(apart <= limit)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) * words + 1, words), pa.int32()), pa.array(m[z].ravel(), pa.int64())) for m, z in ((a[at : at + step], x), (b, y))]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array(apart[x, y], pa.int32())], ["tw", "rw", "distance"])

    bounded_batches(cells.sparkSession)
    pairs = cells.select("t_values", "r_values").mapInArrow(scan, "tw array<bigint>, rw array<bigint>, distance int")
    return _rows_of(pairs, train, refs)


def hamming_join(train: DataFrame, refs: DataFrame, limit: int, words: int, bits: int) -> DataFrame:
    """(train_id, ref_id, distance) of all pairs within ``limit``; rows without a hash match nothing."""
    return hamming_indexed(train, refs, limit, words, bits) if probe_plan(bits, limit)[2] <= INDEX_SHARE else hamming_cells(train, refs, limit, words)


def _best_of(cells: DataFrame, k: int, digits: int, left: str, right: str) -> DataFrame:
    """(train_id, ref_id, similarity): for each training row the best k of each block of references it meets, not below its floor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column("t_values")[i].values
                names, ids = batch.column("t_keys")[i].values, np.array(batch.column("r_keys")[i].as_py())
                floors = np.asarray(asked.field("floor"), float)
                vecs = np.asarray(asked.field("vec").flatten(), float).reshape(len(asked), -1)
                matrix = _matrix(batch, "r_values", i, float)
                top, found = min(k, len(ids)), []
                step = max(1, 1_000_000 // len(ids))
                for at in range(0, len(vecs), step):
                    s, least = np.round(vecs[at : at + step] @ matrix.T, digits), floors[at : at + step]
                    if not np.isfinite(least).all():  # without a floor the k-th best of the block is one
                        least = np.maximum(least, np.partition(s, len(ids) - top, axis=1)[:, len(ids) - top])
                    x, y = np.nonzero(s >= least[:, None])  # all ties of the last place, so ids can decide
                    order = np.lexsort((ids[y], -s[x, y], x))
                    x, y = x[order], y[order]
                    first = np.arange(len(x)) - np.searchsorted(x, x) < top
                    found.append((x[first] + at, y[first], s[x[first], y[first]]))
                rows, cols, sims = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), pa.array(ids[cols].tolist(), TYPES[right]), pa.array(sims, pa.float64())], ["train_id", "ref_id", "similarity"])

    bounded_batches(cells.sparkSession)
    return cells.select("t_keys", "t_values", "r_keys", "r_values").mapInArrow(scan, f"train_id {left}, ref_id {right}, similarity double")


def nearest(train: DataFrame, refs: DataFrame, k: int, digits: int = 9, pivots: int = PIVOTS) -> DataFrame:
    """(train_id, ref_id, similarity, rank): the exact k references of greatest inner product, ties by id.

    References lie in cells around at most ``pivots`` of them.  With c a cell's centre and R its radius, q.x is at most
    q.c + |q| R for any x in it.  A training row first meets the cell of its greatest bound; its k-th best there is a floor,
    and only cells whose bound reaches it follow.  Rows without a vector have no neighbours.
    """
    left, right = dict(train.dtypes)["train_id"], dict(refs.dtypes)["ref_id"]
    refs, train = refs.where("ref_vec is not null").select("ref_id", "ref_vec"), train.where("train_vec is not null").select("train_id", "train_vec")
    chosen = refs.select("ref_id", "ref_vec").orderBy(F.xxhash64("ref_id"), "ref_id").limit(pivots).collect()  # at most ``pivots`` vectors
    if not chosen:
        return train.sparkSession.createDataFrame([], f"train_id {left}, ref_id {right}, similarity double, rank int")
    centres = np.array([r.ref_vec for r in chosen], float)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = np.asarray(batch.column("ref_vec").flatten(), float).reshape(batch.num_rows, -1)
                apart = ((vecs**2).sum(1)[:, None] - 2 * vecs @ centres.T + (centres**2).sum(1)[None]).clip(0)
                cell = apart.argmin(1)
                exact = np.sqrt(((vecs - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(exact, pa.float64())], ["ref_id", "ref_vec", "cell", "apart"])

    placed = settled(refs.mapInArrow(to_cells, f"ref_id {right}, ref_vec array<double>, cell int, apart double"), "reference-cells")
    radius = np.full(len(centres), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("apart").alias("r")).collect():  # one number a pivot
        radius[r.cell] = r.r
    blocks = settled(_packed(placed.select("cell", "ref_id", "ref_vec"), REF_BLOCK, "ref_id", "ref_vec", "r", ["cell"]), "reference-blocks")

    def bounds(vecs: np.ndarray) -> np.ndarray:
        return vecs @ centres.T + np.sqrt((vecs**2).sum(1))[:, None] * np.where(np.isfinite(radius), radius, 0) + np.where(np.isfinite(radius), 1e-9, -np.inf)

    def to_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = np.asarray(batch.column("train_vec").flatten(), float).reshape(batch.num_rows, -1)
                home = bounds(vecs).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, -np.inf)), pa.array(home, pa.int32())], ["train_id", "train_vec", "floor", "cell"])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = np.asarray(batch.column("train_vec").flatten(), float).reshape(batch.num_rows, -1)
                all_bounds, floors = bounds(vecs), np.asarray(batch.column("floor"), float)
                open_ = all_bounds >= floors[:, None] - 10.0**-digits
                open_[np.arange(len(vecs)), all_bounds.argmax(1)] = False
                rows, others = np.nonzero(open_ & np.isfinite(radius)[None])
                for k in range(0, len(rows), SENT_ROWS):
                    at, c = pa.array(rows[k : k + SENT_ROWS]), others[k : k + SENT_ROWS]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(c, pa.int32())], ["train_id", "train_vec", "floor", "cell"])

    schema = f"train_id {left}, train_vec array<double>, floor double, cell int"

    def met(rows: DataFrame) -> DataFrame:
        asked = rows.select("train_id", "cell", F.struct("floor", F.col("train_vec").alias("vec")).alias("q"))
        return _best_of(_packed(asked, TRAIN_BLOCK, "train_id", "q", "t", ["cell"]).join(blocks, "cell"), k, digits, left, right)

    w = Window.partitionBy("train_id").orderBy(F.col("similarity").desc(), "ref_id")
    best = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    at_home = settled(best(met(train.mapInArrow(to_home, schema))), "home-neighbours")
    floors = at_home.where(F.col("rank") == k).select("train_id", F.col("similarity").alias("floor"))
    rest = train.join(floors, "train_id", "left").select("train_id", "train_vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    elsewhere = met(rest.mapInArrow(to_others, schema))
    return best(at_home.drop("rank").unionByName(elsewhere))
