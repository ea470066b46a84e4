"""Exact removal of repeated byte strings: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte is removed if some ``WINDOW``-byte string over it also starts earlier (smaller document, or same document and
earlier start).  The work is split by content so that no task sees more than its share:

1. Anchors.  Each WINDOW-byte window picks the k-gram of least hash inside it (the leftmost on ties), so equal windows pick
   equal k-grams at equal offsets.  The windows that pick one k-gram occurrence are contiguous; the bytes they span are its
   snippet.  Occurrences are keyed by the k-gram's hash and a digest of the snippet, and copies within one input partition
   are settled there: only the first goes on, so a passage that fills a third of the corpus is no hot key.
2. Equal snippets.  Of occurrences with equal keys all but the first are repeats in full.  A k-gram with a single snippet
   needs no more work.
3. Different snippets around one k-gram may share some of their windows.  Their bytes are fetched, cut into shards, and
   each shard is turned into a Burrows-Wheeler transform.  The transforms are merged: the interleave of their rows, at
   first in shard order, is stably reordered by the transforms' symbols WINDOW times.  After k rounds rows are in order of
   their first k bytes, and the block borders that appear in round k are the places where the common prefix is k - 1.  Blocks
   left after WINDOW rounds are the repeated intervals: rows whose windows are equal.  No suffix is compared or sorted again.
   A round here takes two symbols, and snippets go that share neither side of their k-gram with another.
   A k-gram with more than MANY different snippets is split by content first, see ``split_snippets``: the windows with half
   of what they lack of the known bytes to their left go by those bytes, the others by the bytes to the right.  Equal windows
   stay together, and splits are repeated until a part is small enough to merge; at the last a part is one window.
4. Covered ranges meet their documents and the remaining bytes are digested.

Defined results: ids are integers, and -2^63 counts as null; null and empty texts have 0 bytes; documents order by id, null ids first, equal ids by a hash of the text
and rows that repeat id and text are one document with one result; texts shorter than WINDOW lose nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, tidy
from .textvec import batch_slices, column_bytes, prefix_hash, span_hash

WINDOW, GRAM = 100, 28
#: Longer texts are cut into pieces of so many windows; positions fit the 24 bits that ``anchors`` leaves for them.
PIECE = 1 << 23
#: Bytes of a shard whose transform is built by itself, and shards that one merge takes together.
SHARD_BYTES, MERGE_SHARDS = 1 << 18, 8
#: Bytes of text that the anchor kernel takes at once.
SLICE = 1 << 20
#: Different snippets of one k-gram above which it is split by the bytes beside the k-gram.
MANY = 4_096
#: Occurrences that a task of stage 2 holds before it keeps only the first of each, and bytes of snippets filtered at once.
HOLD, FILTER_BYTES = 2_000_000, 12 << 20
#: An occurrence's windows and the k-gram's place in its snippet, both below 128, share a number.
PLACE_BITS = 7


def anchors(data: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, windows and place, k-gram hash, snippet digest) of every anchor; windows are relative to their text."""
    n = len(data) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    # Leftmost least k-gram of each window by the upper 40 bits; the position rides in the rest and breaks ties.
    bits = np.uint64(24)
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span, width = window - gram + 1, 1
    low = key
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    pick = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(starts, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= starts[row + 1]
    new = np.ones(n, bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    edge = np.flatnonzero(new | ~inside)
    last = np.concatenate((edge, [n]))[np.searchsorted(edge, first, "right")]
    count = last - first
    p = pick[first]
    digest = span_hash(prefix_hash(data, 1), first, last - 1 + window, 1) + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row[first], first - starts[row[first]], count | (p - first) << PLACE_BITS, grams[p], digest


def text_pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, starts, offset of the bytes in their text) over a column; only a lone long text is cut."""
    for lo, _, data, starts in batch_slices(column, SLICE):
        if len(data) <= PIECE + WINDOW:
            yield lo, data, starts, 0
        else:
            for at in range(0, len(data) - WINDOW + 1, PIECE):
                part = data[at : at + PIECE + WINDOW - 1]
                yield lo, part, np.array([0, len(part)]), at


def merge_ranges(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [start, end) ranges per owner, sorted."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    base = owner.astype(np.int64) * np.int64(1 << 40)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(owner), bool)
    new[1:] = (base + start)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(owner)])) - 1
    return owner[head], start[head], reach[tail] - base[tail]


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in suffix order, their preceding symbols = the transform, row of the preceding position) of a shard.

    ``text`` holds symbols 1..256 and 0 after each snippet; rows are in order of their first WINDOW symbols.
    """
    n = len(text)
    packed = np.concatenate((text, text[: WINDOW + 16] if n > WINDOW + 16 else np.resize(text, WINDOW + 16))).astype(np.uint64)
    key = packed[: n + WINDOW + 8].copy()
    for j in range(1, 7):
        key = (key[: n + WINDOW + 8 - j] << np.uint64(9)) | packed[j : n + WINDOW + 8]
    rows = np.argsort(key[:n], kind="stable")
    k = key[rows]
    group = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
    tied = np.arange(n)
    for depth in range(7, WINDOW, 7):
        g = group[tied]
        same = np.zeros(len(tied), bool)
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:]
        tied = tied[same]
        if not len(tied):
            break
        g, k = group[tied], key[rows[tied] + depth]
        order = np.lexsort((k, g))
        rows[tied] = rows[tied][order]
        k = k[order]
        cut = np.ones(len(tied), bool)
        cut[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(cut, np.arange(len(tied)), 0))]
    place = np.empty(n, np.int64)
    place[rows] = np.arange(n)
    return rows, text[rows - 1], place[rows - 1]


def repeated_intervals(shards: list[np.ndarray], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position, interval) of all rows whose first ``depth`` symbols occur more than once, over all shards.

    The transforms are merged by refining the interleave of their rows.  A row that is alone in its block stays alone, and
    so do all rows that extend it to the left, so only rows of larger blocks are carried into the next round.
    """
    made = [shard_transform(s) for s in shards]
    offset = np.concatenate(([0], np.cumsum([len(s) for s in shards])))
    symbol = np.concatenate([m[1] for m in made])
    before = np.concatenate([m[2] + o for m, o in zip(made, offset)]).astype(np.int32)
    # Two symbols a round: the transform's symbol and the one before it.  Text has few enough of them for 16 bits.
    base = int(symbol.max()) + 1
    pair = symbol[before].astype(np.uint32) * base + symbol
    pair, twice = pair.astype(np.uint16) if base * base <= 1 << 16 else pair, before[before]
    rows = np.arange(offset[-1], dtype=np.int32)  # the interleave: row numbers of the shards' transforms in merged order
    block = np.zeros(len(rows), np.int32)
    for _ in range(depth // 2):
        c = pair[rows]
        order = np.argsort(c, kind="stable").astype(np.int32)
        c, b = c[order], block[order]
        rows = twice[rows[order]]
        cut = np.ones(len(rows), bool)  # a common prefix ends here, within the symbols of this round
        cut[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        alone = cut & np.append(cut[1:], True)
        rows, block = rows[~alone], (np.cumsum(cut, dtype=np.int32) - 1)[~alone]
        if not len(rows):
            break
    shard = np.searchsorted(offset, rows, "right") - 1
    position = np.concatenate([m[0] for m in made])[rows] if len(rows) else rows
    return shard, position, block


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + 100_000])) for c in columns], names)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row above in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


OCCURRENCE = ["kind", "h", "d", "id", "th", "s", "n"]
OCCURRENCE_SCHEMA = "kind int, h bigint, d bigint, id bigint, th bigint, s bigint, n int"


def find_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 1, over one input partition: kind 0 are first occurrences here, kind 1 are repeats already settled here."""
    got: list[list[np.ndarray]] = [[] for _ in range(6)]
    for batch in batches:
        ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, data, starts, offset in text_pieces(batch.column(2)):
            row, s, n, h, d = anchors(data, starts)
            for have, new in zip(got, (h.view(np.int64), d.view(np.int64), ids[lo + row], ths[lo + row], s + offset, n.astype(np.int32))):
                have.append(new)
    h, d, i, t, s, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
    order = np.lexsort((s, t, i, d, h))
    h, d, i, t, s, n = (x[order] for x in (h, d, i, t, s, n))
    first = _changes(h, d)
    zero = np.zeros(len(h), np.int32)
    yield from _batches(OCCURRENCE, zero[first], h[first], d[first], i[first], t[first], s[first], n[first])
    i, t, s, n = (x[~first] for x in (i, t, s, n))
    n = windows_of(n)
    if len(i):
        order = np.lexsort((t, i))
        i, t, s, n = (x[order] for x in (i, t, s, n))
        new = _changes(i, t)
        head = np.flatnonzero(new)
        owner, a, b = merge_ranges(np.cumsum(new) - 1, s, s + n + WINDOW - 1)
        one, blank = np.ones(len(owner), np.int32), np.zeros(len(owner), np.int64)
        yield from _batches(OCCURRENCE, one, blank, blank, i[head][owner], t[head][owner], a, (b - a - WINDOW + 1).astype(np.int32))


def windows_of(n):
    return n & ((1 << PLACE_BITS) - 1)


def settle_occurrences(batches: Iterator[pa.RecordBatch], many: int = MANY, hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    """Stage 2, over the k-grams of one partition: kind 1 are repeats, kind 2 snippets to compare, kind 3 those to split first.

    Whenever ``hold`` rows have gathered only the first of equal snippets is kept.  A k-gram that still has more than ``many`` goes on
    at once, and so do its later rows, so no k-gram is held whole; what is equal among them is settled with the splits.
    """
    held = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.int32)]
    fresh: list[list[np.ndarray]] = []
    size, hot = 0, np.zeros(0, np.int64)

    def rows(kind: int, x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(len(x[0]), np.int64)
        if len(zero):
            yield from _batches(OCCURRENCE, np.full(len(zero), kind, np.int32), zero if kind == 1 else x[0], zero, x[2], x[3], x[4], windows_of(x[5]) if kind == 1 else x[5])

    def compact() -> Iterator[pa.RecordBatch]:
        nonlocal held, fresh, size, hot
        x = [np.concatenate(c) for c in zip(held, *fresh)]
        order = np.lexsort((x[4], x[3], x[2], x[1], x[0]))
        x = [c[order] for c in x]
        first = _changes(x[0], x[1])
        yield from rows(1, [c[~first] for c in x])
        x = [c[first] for c in x]
        over = _group_sizes(x[0]) > many
        hot = np.union1d(hot, x[0][over])
        yield from rows(3, [c[over] for c in x])
        held, fresh, size = [c[~over] for c in x], [], 0

    for batch in batches:
        c = [batch.column(k).to_numpy() for k in OCCURRENCE]
        done = c[0] == 1
        if done.any():
            yield batch.filter(pa.array(done))
        c = [v[~done] for v in c[1:]]
        if len(hot):
            late = np.isin(c[0], hot)
            yield from rows(3, [v[late] for v in c])
            c = [v[~late] for v in c]
        fresh.append(c)
        size += len(c[0])
        if size > hold:
            yield from compact()
    yield from compact()
    several = _group_sizes(held[0]) > 1
    yield from rows(2, [c[several] for c in held])


def _group_sizes(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, how many each one has."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = _changes(keys)
    return np.diff(np.append(np.flatnonzero(new), len(keys)))[np.cumsum(new) - 1]


SNIPPET = ["kind", "h", "id", "th", "s", "n", "bytes"]
PART, PART_SCHEMA = SNIPPET[1:], "h bigint, id bigint, th bigint, s bigint, n int, bytes binary"
COVER = ["id", "th", "s", "n"]


def fetch_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[list] = [[] for _ in SNIPPET]
        for i, t, body, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "body", "asked"))):
            raw = expand(body)
            for a in asked:
                for c, v in zip(out, (a["kind"], a["h"], i, t, a["s"], a["n"], raw[a["s"] : a["s"] + windows_of(a["n"]) + WINDOW - 1])):
                    c.append(v)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], SNIPPET)


def compare_snippets(batches: Iterator[pa.RecordBatch], at_once: int = FILTER_BYTES) -> Iterator[pa.RecordBatch]:
    """Stage 3, over whole groups of snippets: repeated windows other than the first of each interval."""
    parts: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        parts.append(batch.select(SNIPPET[1:]))
        size += batch.column("bytes").nbytes
        if size > at_once:
            table = pa.Table.from_batches(parts).combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # equal windows have equal k-grams, so whole k-grams suffice
            yield from _compare_table(table.slice(0, cut))
            parts = table.slice(cut).to_batches()
            size = sum(x.column("bytes").nbytes for x in parts)
    if parts:
        yield from _compare_table(pa.Table.from_batches(parts).combine_chunks())


def _compare_table(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Merges of about MERGE_SHARDS shards each over the snippets that can have a partner."""
    if table.num_rows < 2:
        return
    data, begin = column_bytes(table.column("bytes"))
    keep = with_partner(table.column("h").to_numpy().view(np.uint64), data, begin, table.column("n").to_numpy() >> PLACE_BITS)
    items = list(zip(*(c.to_pylist() for c in table.filter(pa.array(keep)).columns)))
    pending: list[tuple] = []
    size = 0
    for k, item in enumerate(items):
        if size > MERGE_SHARDS * SHARD_BYTES and item[0] != items[k - 1][0]:
            yield from _compare(pending)
            pending, size = [], 0
        pending.append(item)
        size += len(item[5])
    yield from _compare(pending)


def with_partner(grams: np.ndarray, data: np.ndarray, begin: np.ndarray, place: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Which snippets can share a window with another of their k-gram, which starts ``place`` bytes into the snippet.

    A window holds, besides the k-gram, (window - gram) / 2 bytes just before or just after it.  A snippet that has neither
    in common with another one of its k-gram has no window in common with any.
    """
    half = (window - gram) // 2
    prefix, at = prefix_hash(data), begin[:-1] + place
    keep = np.zeros(len(place), bool)
    for low, high in ((at - half, at), (at + gram, at + gram + half)):
        some = np.flatnonzero((low >= begin[:-1]) & (high <= begin[1:]))
        side = span_hash(prefix, low[some], high[some])
        order = np.lexsort((side, grams[some]))
        g, s = grams[some][order], side[order]
        same = np.zeros(len(some), bool)
        same[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
        same[:-1] |= same[1:]
        keep[some[order[same]]] = True
    return keep


def split_snippets(batches: Iterator[pa.RecordBatch], known: int) -> Iterator[pa.RecordBatch]:
    """Each snippet in two, by the bytes beside the ``known`` ones that all of its windows hold.

    A window lacks WINDOW - known bytes, and has them left or right of the known ones.  With at least half of them to the
    left it goes by that half, else by the bytes to the right, which are then half and one at least.  Parts are keyed by the
    old key and these bytes; equal windows have equal bytes around equal places, and so get equal keys.
    """
    lack = WINDOW - known
    left, right = -(-lack // 2), lack // 2 + 1
    for batch in batches:
        out: list[list] = [[] for _ in PART]
        for h, i, t, s, n, raw in zip(*(batch.column(c).to_pylist() for c in SNIPPET[1:])):
            count, at = windows_of(n), n >> PLACE_BITS
            cut = max(0, min(count, at - left + 1))  # windows before the cut go left
            for a, b, side, more in ((0, cut, b"l", raw[at - left : at] if cut else b""), (cut, count, b"r", raw[at + known : at + known + right])):
                if a < b:
                    key = hashlib.blake2b(side + more, digest_size=8, key=h.to_bytes(8, "little", signed=True)).digest()
                    place = at - a if side == b"r" else at - left
                    for c, v in zip(out, (int.from_bytes(key, "little", signed=True), i, t, s + a, b - a | place << PLACE_BITS, raw[a : b + WINDOW - 1])):
                        c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], PART)


def _compare(items: list[tuple]) -> Iterator[pa.RecordBatch]:
    if len(items) < 2:
        return
    order = sorted(range(len(items)), key=lambda k: items[k][1:4])
    rank = np.empty(len(items), np.int64)
    rank[order] = np.arange(len(items))
    length = np.array([len(x[5]) + 1 for x in items])
    begin = np.concatenate(([0], np.cumsum(length)))
    text = np.frombuffer(b"\0".join([*(x[5] for x in items), b""]), np.uint8).astype(np.uint16) + 1
    text[begin[1:] - 1] = 0
    cuts = [0]
    while cuts[-1] < len(items):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + SHARD_BYTES, "right")) - 1))
    shards = [text[begin[a] : begin[b]] for a, b in zip(cuts, cuts[1:])]
    shard, position, interval = repeated_intervals(shards)
    position = position + begin[np.array(cuts[:-1])][shard]
    snippet = np.searchsorted(begin, position, "right") - 1
    start = position - begin[snippet]
    window = start + WINDOW < length[snippet]  # others run over the end of their snippet
    snippet, start, interval = snippet[window], start[window], interval[window]
    if not len(snippet):
        return
    order = np.lexsort((start, rank[snippet], interval))
    snippet, start, interval = snippet[order], start[order], interval[order]
    later = ~_changes(interval)
    owner, a, b = merge_ranges(snippet[later], start[later], start[later] + WINDOW)
    if len(owner):
        i, t, s = (np.array([x[k] for x in items], np.int64) for k in (1, 2, 3))
        yield from _batches(COVER, i[owner], t[owner], s[owner] + a, (b - a - WINDOW + 1).astype(np.int32))


def strip_ranges(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for i, t, body, covers in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "body", "covers"))):
            raw = expand(body)
            a, b = np.array([c["s"] for c in covers or ()], np.int64), np.array([c["s"] + c["n"] + WINDOW - 1 for c in covers or ()], np.int64)
            _, a, b = merge_ranges(np.zeros(len(a), np.int64), a, b)
            kept, at = [], 0
            for x, y in zip(a.tolist(), b.tolist()):
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            rest = b"".join(kept)
            for c, v in zip(out, (i, len(raw), int((b - a).sum()), len(a), hashlib.sha256(rest).hexdigest(), rest if with_bytes else None)):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _split_many(hot: DataFrame, many: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(parts small enough to merge, covers of equal parts) of the snippets of k-grams with too many of them.

    Every round a part's windows have half fewer unknown bytes, so there are seven rounds at most, of which the last leaves
    parts of one window, equal or alone.
    """
    few = equal = None
    known = GRAM
    while known < WINDOW and hot.limit(1).count():
        parts = materialise(hot.mapInArrow(lambda x, known=known: split_snippets(x, known), PART_SCHEMA), "repeat-parts")
        known += -(-(WINDOW - known) // 2)  # the right side knows one more at times, which is not made use of
        # Equal parts: the first one stays; others are repeats in full.
        me, whole = F.struct("id", "th", "s"), ["h", "n", "bytes"]
        firsts = materialise(parts.groupBy(*whole).agg(F.min(me).alias("f"), F.count(F.lit(1)).alias("c")), "repeat-firsts")
        again = parts.join(firsts.where("c > 1"), whole).where(me != F.col("f")).select("id", "th", "s", F.expr(f"n & {(1 << PLACE_BITS) - 1}").alias("n"))
        sizes = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        kept = materialise(firsts.join(sizes, "h").select("h", "f.id", "f.th", "f.s", "n", "bytes", (F.col("_n") > many).alias("many")), "repeat-kept")
        small = kept.where("not many").select(*PART)
        few, equal = few.unionByName(small) if few else small, equal.unionByName(again) if equal else again
        hot = kept.where("many").select(*PART)
    return few, equal


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, many: int = MANY, hold: int = HOLD, at_once: int = FILTER_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document.  Ids are integers.

    ``many``, ``hold`` and ``at_once`` only bound what a task holds: results are the same for all of their values.
    """
    low = -(1 << 63)
    flat = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(low)).alias("id"), F.col(text_col).cast("string").alias("text"))
    twice = flat.groupBy("id").count().where("count > 1").limit(1).count()
    # Where ids are unique the text's hash is not needed to name a document, and a constant costs no shuffle bytes.
    flat = flat.select("id", (F.xxhash64("text") if twice else F.lit(0).cast("bigint")).alias("th"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bodies = [squeeze(x) for x in batch.column(2).cast(pa.large_binary()).fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bodies, pa.binary())], ["id", "th", "body"])

    bodies = flat.mapInArrow(pack, "id bigint, th bigint, body binary")
    # A row that repeats id and text is the same document: its windows are found once, and its covers go to every copy.
    found = (flat.dropDuplicates(["id", "th"]) if twice else flat).mapInArrow(tidy(find_occurrences), OCCURRENCE_SCHEMA).repartition(F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("id", "s")))
    settled = materialise(found.mapInArrow(tidy(lambda x: settle_occurrences(x, many, hold)), OCCURRENCE_SCHEMA), "repeat-occurrences")
    asked = settled.where("kind >= 2").groupBy("id", "th").agg(F.collect_list(F.struct("kind", "h", "s", "n")).alias("asked"))
    fetched = bodies.dropDuplicates(["id", "th"]) if twice else bodies
    snippet_schema = "kind int, h bigint, id bigint, th bigint, s bigint, n int, bytes binary"
    snippets = materialise(fetched.join(asked, ["id", "th"]).mapInArrow(fetch_snippets, snippet_schema), "repeat-snippets")
    cover_schema = "id bigint, th bigint, s bigint, n int"
    few, equal = _split_many(snippets.where("kind = 3").select(*PART), many)
    few = snippets.where("kind = 2").select(*PART).unionByName(few) if few else snippets.where("kind = 2").select(*PART)
    merged = few.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(lambda x: compare_snippets(x, at_once)), cover_schema)
    covers = settled.where("kind = 1").select(*COVER).unionByName(merged)
    covers = covers.unionByName(equal) if equal else covers
    covers = covers.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n")).alias("covers"))
    out = bodies.join(covers, ["id", "th"], "left").mapInArrow(lambda x: strip_ranges(x, with_bytes), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    real = F.when(F.col("id") == low, F.lit(None)).otherwise(F.col("id")).cast("bigint")
    return out.select(real.alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else []))
