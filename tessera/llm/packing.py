"""Order-preserving packing of documents into training sequences by dynamic programming.

The documents of an input partition, in its order, form one stream of token ids, each document closed by a separator.  Cuts
may fall at document ends, at sentence ends and line breaks, and inside runs without either; the windows between chosen
cuts are the sequences.  With W the window and L a sequence's length, the costs are W - L for padding (nothing where L is a
power of two, which is not padded), a penalty for a cut inside a document, a larger one inside a sentence, and a constant a
sequence.  cost(j) = penalty(j) + W - pos(j) + min over i in the window of (cost(i) + pos(i)) is a sliding minimum, kept in
a monotone queue; lengths that are powers of two are further transitions.

Nothing is shuffled: a partition is packed by one task in blocks of bounded size, what lies behind a block's last settled
cut goes on into the next, and sequence ids are the partition's number and a count.  The same splits of the same table give
the same sequences, also when a task is run again.

Defined results: a null or empty text is its separator alone; repeated rows are packed each by themselves; an empty table
gives no rows; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidy
from .textvec import batch_slices
from .words import SLICE_BYTES, WordIds, word_ids

WINDOW, SEPARATOR = 2048, 1
#: Costs in tokens of padding: a cut at a sentence end or line break, one inside a sentence, and a sequence as such.
SENTENCE_CUT, INNER_CUT, SEQUENCE_COST = 8, 32, 16
#: A stretch without a sentence end may be cut every so many tokens.
STRETCH = 256
#: Tokens that are packed at once (a longer document is a block of its own), and sequences at a block's end that wait for the next.
BLOCK_TOKENS, UNSETTLED = 1 << 21, 8

def candidates(ends: np.ndarray, docs: np.ndarray, last: bool, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where a stream may be cut: ``docs`` are its document ends, ``ends`` its sentence ends.

    Long stretches get inner cuts.  If the stream ends here, its last window may be cut anywhere, so that what would be
    padded can be split into lengths that are not.
    """
    total = int(docs[-1])
    fixed = np.unique(np.concatenate(([0], ends, docs)))
    gaps = np.diff(fixed)
    step = min(STRETCH, window)
    more = (gaps - 1) // step
    inner = np.repeat(fixed[:-1], more) + step * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
    free = np.arange(max(1, total - window), total) if last else np.zeros(0, np.int64)
    pos = np.unique(np.concatenate((fixed, inner, free)))
    penalty = np.full(len(pos), INNER_CUT)
    penalty[np.searchsorted(pos, ends)] = SENTENCE_CUT
    penalty[np.searchsorted(pos, docs)] = 0
    penalty[0] = 0
    return pos, penalty


def best_cuts(pos: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Indices into ``pos`` of the cheapest cuts, first and last included, and their cost."""
    n = len(pos)
    # Transitions to a power of two, by their later end.
    froms, tos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(window.bit_length()):
        if (1 << k) <= window:
            i = np.searchsorted(pos, pos - (1 << k))
            hit = np.flatnonzero(pos[np.minimum(i, n - 1)] == pos - (1 << k))
            froms.append(i[hit])
            tos.append(hit)
    tos_, froms_ = np.concatenate(tos), np.concatenate(froms)
    order = np.argsort(tos_, kind="stable")
    exact, starts = froms_[order].tolist(), np.searchsorted(tos_[order], np.arange(n + 1)).tolist()
    at, extra = pos.tolist(), (penalty + SEQUENCE_COST).tolist()
    cost, came = [0] * n, [0] * n
    key = [at[0]] + [0] * (n - 1)
    queue, head = [0], 0
    for j in range(1, n):
        p = at[j]
        while at[queue[head]] < p - window:
            head += 1
        i = queue[head]
        best = key[i] + window - p
        for x in exact[starts[j] : starts[j + 1]]:
            if cost[x] < best:
                best, i = cost[x], x
        best += extra[j]
        cost[j], came[j] = best, i
        key[j] = best + p
        while len(queue) > head and key[queue[-1]] >= best + p:
            queue.pop()
        queue.append(j)
        if head > 4096:
            del queue[:head]
            head = 0
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return np.array(cuts[::-1]), cost[-1]


class Packer:
    """The stream of one partition: documents come in, settled pieces go out."""

    def __init__(self, partition: int, window: int) -> None:
        self.window, self.next = window, partition << 33
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.names: list = []
        self.starts, self.stops = np.zeros(0, np.int64), np.zeros(0, np.int64)  # documents; the first may have begun before the stream

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> None:
        base, bounds = len(self.ids), np.concatenate(([0], np.cumsum(sizes)))
        closed = np.insert(ids, bounds[1:], SEPARATOR) if len(sizes) else ids
        rank = np.searchsorted(bounds[1:], ends, "left")  # separators before a sentence end
        stops = base + bounds[1:] + np.arange(1, len(sizes) + 1)
        self.ends = np.concatenate((self.ends, base + ends + rank))
        self.starts = np.concatenate((self.starts, stops - sizes - 1))
        self.stops = np.concatenate((self.stops, stops))
        self.names += names
        self.ids = np.concatenate((self.ids, closed.astype(np.uint32)))

    def take(self, last: bool) -> dict | None:
        """Pieces of the settled sequences; all of them if the stream ends here."""
        if not len(self.ids):
            return None
        pos, penalty = candidates(self.ends[self.ends > 0], self.stops, last, self.window)
        cuts = pos[best_cuts(pos, penalty, self.window)[0]]
        if not last:
            cuts = cuts[: max(1, len(cuts) - UNSETTLED)]
        done = int(cuts[-1])
        if not done:
            return None
        edge = np.unique(np.concatenate((cuts, self.starts[(self.starts > 0) & (self.starts < done)])))
        a, b = edge[:-1], edge[1:]
        doc, seq = np.searchsorted(self.stops, a, "right"), np.searchsorted(cuts, a, "right") - 1
        data = memoryview(self.ids.astype("<u4")).cast("B")
        out = {
            "name": [self.names[i] for i in doc.tolist()], "start": a - self.starts[doc], "length": b - a,
            "ids_crc32": [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())],
            "doc_tokens": (self.stops - self.starts)[doc], "sequence_id": self.next + seq, "offset": a - cuts[seq],
        }
        self.next += len(cuts) - 1
        keep = int(np.searchsorted(self.stops, done, "right"))
        self.ids, self.names = self.ids[done:].copy(), self.names[keep:]
        self.starts, self.stops, self.ends = self.starts[keep:] - done, self.stops[keep:] - done, self.ends[self.ends > done] - done
        return out


def pack_sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", coder: Callable[[str], WordIds] = word_ids, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, id_type = coder(tokenizer), Packer(TaskContext.get().partitionId(), window), None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            if pieces := packer.take(last):
                columns = [pa.array(v, id_type if c == "name" else pa.int64()) for c, v in pieces.items()]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *list(pieces)[1:]])

        for batch in batches:
            id_type, names = batch.schema.field(0).type, batch.column(0)
            for lo, hi, data, starts in batch_slices(batch.column(1), SLICE_BYTES):
                packer.add(names.slice(lo, hi - lo).to_pylist(), *ids_of.encode(data, starts))
                if len(packer.ids) >= block_tokens:
                    yield from out(False)
        yield from out(True)

    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(tidy(pack), schema)
