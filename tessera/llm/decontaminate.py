"""Benchmark decontamination by greedy string tiling.

Token ``width``-grams shared with a test item seed the comparison.  Runs of seeds on one diagonal are the maximal matches;
the longest is marked again and again, matches that meet marked tokens are cut to what is left, and tiles shorter than
``width`` tokens are dropped.  The share of the item's tokens under tiles is its coverage, whatever order the tiles have in
the document, so reordered passages count in full.

Tokens are A-Z lower-cased words without leading and trailing marks.  Rolling polynomial hashes of token runs
(Karp-Rabin) find the seeds; tiles are confirmed token by token.

Defined results: null, empty and wordless documents are clean with coverage 0 and no item; wordless or null items are
never matched; an item shorter than ``width`` tokens must occur whole; equal coverages name the smallest item id; an empty
benchmark leaves all documents clean; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, tidy
from .textvec import LOWER, batch_slices, mix, powers, prefix_hash, row_counts, span_hash, word_spans

#: A benchmark of up to so many bytes of text goes to every task whole; a larger one is joined by its seeds.
BROADCAST_BYTES = 8 << 20
#: Seeds of one document and item above which tiles are found without listing them.
SEEDS = 1 << 20
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, begin of each text's tokens)."""
    n = len(starts) - 1
    data = LOWER[data]
    first, last, row = word_spans(data, starts)
    solid = np.flatnonzero(_SOLID[data])
    if not len(first) or not len(solid):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    a, b = np.searchsorted(solid, first, "left"), np.searchsorted(solid, last, "left")
    bare = b > a
    a, b, row = a[bare], b[bare], row[bare]
    return span_hash(prefix_hash(data), solid[a], solid[b - 1] + 1), np.concatenate(([0], np.cumsum(row_counts(row, n))))


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` tokens from each position (whatever text they are in)."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    weight = powers(0xA0761D6478BD642F, width + 2)
    out = np.zeros(m, np.uint64)
    for j in range(width):
        out += words[j : j + m] * weight[j + 1]
    return mix(out + np.uint64(width))


def tile(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) from seed positions."""
    order = np.lexsort((at_item, at_doc - at_item))
    i, d = at_item[order], at_doc[order]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(d) != 1)) + 1
    heads, tails = np.concatenate(([0], cut)), np.concatenate((cut, [len(i)])) - 1
    heap = [(-(int(i[b] - i[a]) + width), int(i[a]), int(d[a])) for a, b in zip(heads, tails)]
    heapq.heapify(heap)
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    out = []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        free = item_free[a : a + size] & doc_free[b : b + size] & (item[a : a + size] == doc[b : b + size])
        if free.all():
            out.append((a, b, size))
            item_free[a : a + size] = doc_free[b : b + size] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= width:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return out


def tile_rows(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The same tiles in the memory of one document: for texts that repeat a gram so often that their seeds are too many.

    Row by row of the item, the lengths of the free matches that end at each token of the document; the longest match of all
    rows is the next tile, of equal ones the first in the item, then in the document.
    """
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    out = []
    while True:
        best, runs = (0, 0, 0), np.zeros(len(doc) + 1, np.int32)
        for i, word in enumerate(item):
            same = (doc == word) & doc_free if item_free[i] else np.zeros(len(doc), bool)
            runs[1:] = np.where(same, runs[:-1] + 1, 0)
            if (size := int(runs.max(initial=0))) > best[0]:
                best = (size, i + 1 - size, int(runs.argmax()) - size)
        size, a, b = best
        if size < width:
            return out
        out.append((a, b, size))
        item_free[a : a + size] = doc_free[b : b + size] = False


@dataclass
class Benchmark:
    """Items with tokens, grouped by seed width: (width, sorted seed hashes, item index, position, presence table)."""

    ids: list
    words: list[np.ndarray]
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, ids: list, texts: list[bytes], width: int) -> Benchmark:
        data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        words, begin = tokens(data, starts)
        each = [words[a:b] for a, b in zip(begin, begin[1:])]
        groups = []
        for w in sorted({min(width, len(x)) for x in each if len(x)}):
            mine = [k for k, x in enumerate(each) if min(width, len(x)) == w]
            hashes = [gram_hashes(each[k], w) for k in mine]
            h = np.concatenate(hashes)
            item = np.repeat(mine, [len(x) for x in hashes])
            at = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << 20, bool)
            table[h & np.uint64((1 << 20) - 1)] = True
            groups.append((w, h[order], item[order], at[order], table))
        return cls(ids, each, groups)

    def coverages(self, words: np.ndarray, begin: np.ndarray, threshold: float, most: int = SEEDS) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, coverage, tiles).  Tiles lie within seeds, so seeds that cover too little need no tiling.

        Seeds are listed only for one text and item at a time, and not at all where there are more than ``most``.
        """
        size = np.array([len(x) for x in self.words])
        for w, seeds, item, at, table in self.groups:
            grams = gram_hashes(words, w)
            near = np.flatnonzero(table[grams & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(seeds, grams[near], "left"), np.searchsorted(seeds, grams[near], "right")
            near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(begin, near, "right") - 1
            inside = near + w <= begin[text + 1]
            near, lo, hi, text = near[inside], lo[inside], hi[inside], text[inside]
            edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
            for a, b in zip(edge, edge[1:]):
                k = int(text[a])
                gram, first, times = np.unique(lo[a:b], return_index=True, return_counts=True)
                span = hi[a:b][first] - gram
                which = np.repeat(gram - (np.cumsum(span) - span), span) + np.arange(span.sum())
                order = np.lexsort((at[which], item[which]))
                which, times = which[order], np.repeat(times, span)[order]
                items, spots = item[which], at[which]
                head = np.flatnonzero(np.diff(items, prepend=-1))
                # Places of an item that seeds cover: each seed's width, less what the next one covers too.
                reach = np.minimum(w, np.where(np.diff(items, append=-1) == 0, np.diff(spots, append=0), w))
                enough = np.add.reduceat(reach, head) >= threshold * size[items[head]]
                total = np.add.reduceat(times, head)
                ends = np.append(head[1:], len(items))
                mine = words[begin[k] : begin[k + 1]]
                for h in np.flatnonzero(enough):
                    i, target = int(items[head[h]]), self.words[int(items[head[h]])]
                    if total[h] > most:
                        tiles = tile_rows(target, mine, w)
                    else:
                        own = np.sort(which[head[h] : ends[h]])  # and so in the order of the seeds
                        here = grams[near[a:b]]
                        left = np.searchsorted(seeds[own], here, "left")
                        n = np.searchsorted(seeds[own], here, "right") - left
                        pick = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        tiles = tile(target, mine, at[own[pick]], np.repeat(near[a:b] - begin[k], n), w)
                    yield k, i, sum(t[2] for t in tiles) / len(target), len(tiles)


def _verdicts(found: Iterator[tuple[int, int, float, int]], ids: list, n: int, threshold: float) -> tuple[list, list, list, list]:
    """Per text: best item, its coverage, its tiles, and how many items reach the threshold."""
    best, count = [(0.0, None, 0)] * n, [0] * n
    for text, item, cover, tiles in found:
        count[text] += cover >= threshold
        if cover > best[text][0] or cover == best[text][0] and best[text][1] is not None and ids[item] < best[text][1]:
            best[text] = (cover, ids[item], tiles)
    return [b[1] for b in best], [b[0] for b in best], [b[2] for b in best], count


def tile_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (the id), item_id, coverage, n_tiles, n_items and contaminated for every document.

    The item named is the best covered of those whose seeds cover ``threshold`` of it.  A benchmark within
    BROADCAST_BYTES is sent to the tasks and nothing is shuffled; a larger one is joined to the documents by seed hashes.
    """
    keep = keep or (id_col,)
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return _by_seed_join(docs, items, width, threshold, text_col, keep)
    rows = sorted(items.collect(), key=lambda r: r.item)
    bench = Benchmark.build([r.item for r in rows], [r.text.encode() for r in rows], width)
    inner = docs.select(*keep, F.col(text_col).alias("_tile_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]]
    item_type = dict(items.dtypes)["item"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for _, _, data, starts in batch_slices(batch.columns[-1]):
                for c, new in zip(cols, _verdicts(bench.coverages(*tokens(data, starts), threshold), bench.ids, len(starts) - 1, threshold)):
                    c += new
            yield _result(batch, cols, threshold, item_type)

    return inner.mapInArrow(tidy(scan), ", ".join([*fields, f"item_id {item_type}", "coverage double", "n_tiles int", "n_items int", "contaminated boolean"]))


def _result(batch: pa.RecordBatch, cols: list[list], threshold: float, item_type: str) -> pa.RecordBatch:
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(item_type, pa.string())
    out = [pa.array(cols[0], kind), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array([c > 0 for c in cols[3]], pa.bool_())]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "item_id", "coverage", "n_tiles", "n_items", "contaminated"])


def _by_seed_join(docs: DataFrame, items: DataFrame, width: int, threshold: float, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet by hash, pairs that share enough are tiled."""
    # Only the kept columns and the text go on, under names of their own.
    kept = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)]
    numbered = materialise(docs.select(*kept, F.col(text_col).cast("string").alias("_tile_text")).withColumn("_no", F.monotonically_increasing_id()), "decontaminate-docs")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, starts in batch_slices(batch.column(1)):
                words, begin = tokens(data, starts)
                owner, hashes = [], []
                for w in widths:
                    grams = gram_hashes(words, w)
                    text = np.searchsorted(begin, np.arange(len(grams)), "right") - 1
                    fit = np.arange(len(grams)) + w <= begin[text + 1]
                    owner.append(text[fit] + lo), hashes.append(grams[fit])
                if not owner:
                    continue
                pairs = np.unique(np.stack([np.concatenate(owner).astype(np.uint64), np.concatenate(hashes)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0].astype(np.int64))), pa.array(pairs[:, 1].view(np.int64))], ["no", "seed"])

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            for i, t in zip(ids, texts):
                words = Benchmark.build([i], [t], width).words[0]
                grams, times = np.unique(gram_hashes(words, min(width, len(words))), return_counts=True) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(grams), batch.schema.field(0).type), pa.array(grams.view(np.int64)), pa.array(times, pa.int64()), pa.array([len(words)] * len(grams), pa.int32())], ["item", "seed", "times", "n"])

    item_type = dict(items.dtypes)["item"]
    right = materialise(items.mapInArrow(item_seeds, f"item {item_type}, seed bigint, times bigint, n int"), "decontaminate-seeds")
    widths = sorted(r[0] for r in right.select(F.least("n", F.lit(width))).distinct().collect())  # ``width`` of them at most
    left = numbered.select("_no", "_tile_text").mapInArrow(seeds, "no bigint, seed bigint")
    # A place of a seed in the item covers at most width of its n tokens; a seed that the item repeats has several places.
    close = left.join(right, "seed").groupBy("no", "item").agg(F.sum("times").alias("k"), F.first("n").alias("n")).where(F.col("k") * width >= F.col("n") * threshold)
    pairs = close.join(items, "item").join(numbered.select(F.col("_no").alias("no"), F.col("_tile_text").alias("doc")), "no").select("no", "item", "text", "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers, tiles = [], []
            for i, text, doc in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                raw = np.frombuffer(doc.encode(), np.uint8)
                got = list(Benchmark.build([i], [text.encode()], width).coverages(*tokens(raw, np.array([0, len(raw)])), threshold))
                covers.append(got[0][2] if got else 0.0), tiles.append(got[0][3] if got else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covers, pa.float64()), pa.array(tiles, pa.int32())], ["no", "item", "coverage", "tiles"])

    tiled = pairs.mapInArrow(compare, f"no bigint, item {item_type}, coverage double, tiles int").where("coverage > 0")
    rank = F.struct(-F.col("coverage"), F.col("item"))
    best = tiled.groupBy("no").agg(F.min_by(F.struct("item", "coverage", "tiles"), rank).alias("b"), F.count_if(F.col("coverage") >= threshold).alias("c"))
    n = F.coalesce("c", F.lit(0)).cast("int")
    return numbered.join(best, F.col("_no") == F.col("no"), "left").select(
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("b.item").alias("item_id"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("b.tiles", F.lit(0)).alias("n_tiles"), n.alias("n_items"), (n > 0).alias("contaminated"),
    )
