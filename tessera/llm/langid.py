"""Language identification by a linear-chain conditional random field over words.

Each word has hashed affix and character n-gram features, and lexicon features: the label that has nearly all of the word's
training occurrences, if there is one.  Labels of neighbouring words are tied by learned transitions.  Forward-backward gives each word's label probabilities, so code-switched text is labelled word by word; a
document's language is the one with the largest mean probability over its words that hold a letter.

The chain runs over segments of at most ``SEGMENT`` consecutive words of a text; segments of one text are independent
given the model, which lets numpy advance all segments of a slice by one word at a time.

Training takes a sample of labelled rows whose bound is ``train_docs`` rows, or one a label if there are more labels, of at
most ``train_text_bytes`` bytes each; every label is learned, and the table of hashed features shrinks with their number so
that the model keeps its size.  Prediction covers every whole text.  Spliced segments of several languages teach the transitions.

Defined results: null or letterless texts give ``und`` with score 0; rows without label are predicted like all others;
without any usable label every row is ``und``; repeated rows, null ids and other columns do no harm; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import tidy, trim
from .textvec import LOWER, batch_slices, powers, prefix_hash, row_counts, span_hash, word_spans

SEGMENT, TRAIN_SEGMENT = 1_024, 64
#: Hashed features at most, and weights (features x labels) of a model at most.
FEATURE_BITS, MODEL_BITS = 17, 23
#: A lexicon word has been seen so often in training, with this share under one label.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
UND = "und"
_AFFIXES = (1, 2, 3, 4)
_LETTERISH = np.zeros(256, bool)
_LETTERISH[65:91] = _LETTERISH[97:123] = _LETTERISH[128:] = True


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # feature x label
    start: np.ndarray
    step: np.ndarray  # label before x label after
    lexicon: tuple[np.ndarray, np.ndarray]  # sorted word hashes, index of the label of each

    @property
    def bits(self) -> int:
        return feature_bits(len(self.labels))

    @classmethod
    def blank(cls, labels: list[str], lexicon: tuple[np.ndarray, np.ndarray] | None = None) -> Crf:
        n = len(labels)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return cls(labels, np.zeros(((1 << feature_bits(n)) + n + 1, n), np.float32), np.zeros(n), np.zeros((n, n)), lexicon or none)


def feature_bits(labels: int) -> int:
    return max(10, min(FEATURE_BITS, MODEL_BITS - (max(1, labels) - 1).bit_length()))


def lexicon_of(words: np.ndarray, gold: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that nearly always have one label, and that label."""
    uniq, which = np.unique(words, return_inverse=True)
    best, most, total = np.zeros(len(uniq), np.int64), np.zeros(len(uniq)), np.bincount(which, minlength=len(uniq))
    for k in range(labels):
        seen = np.bincount(which[gold == k], minlength=len(uniq))
        best[seen > most] = k
        most = np.maximum(most, seen)
    sure = (total >= LEXICON_COUNT) & (most >= LEXICON_SHARE * total)
    return uniq[sure], best[sure]


def word_features(model: Crf, data: np.ndarray, prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, begin of each word's ids): lexicon, the whole word, prefixes, suffixes and byte trigrams."""
    salts = powers(0xC2B2AE3D27D4EB4F, 16)
    shift = np.uint64(64 - model.bits)
    whole = span_hash(prefix, first, last)
    listed = np.full(len(first), len(model.labels))
    if len(model.lexicon[0]):
        place = np.minimum(np.searchsorted(model.lexicon[0], whole), len(model.lexicon[0]) - 1)
        listed = np.where(model.lexicon[0][place] == whole, model.lexicon[1][place], listed)
    fixed = [(1 << model.bits) + listed, (whole * salts[1]) >> shift]
    for k in _AFFIXES:
        fixed.append((span_hash(prefix, first, np.minimum(first + k, last)) * salts[1 + k]) >> shift)
        fixed.append((span_hash(prefix, np.maximum(last - k, first), last) * salts[6 + k]) >> shift)
    width, grams = len(fixed), np.maximum(last - first - 2, 0)
    begin = np.concatenate(([0], np.cumsum(grams + width)))
    ids = np.empty(begin[-1], np.int32)
    for j, f in enumerate(fixed):
        ids[begin[:-1] + j] = f
    if (total := int(grams.sum())) > 0:
        word = np.repeat(np.arange(len(first)), grams)
        inner = np.arange(total) - np.repeat(np.cumsum(grams) - grams, grams)
        at = first[word] + inner
        tri = data[at].astype(np.uint64) | (data[at + 1].astype(np.uint64) << np.uint64(8)) | (data[at + 2].astype(np.uint64) << np.uint64(16))
        ids[begin[word] + width + inner] = (tri * np.uint64(0x9E3779B97F4A7C15) * salts[12]) >> shift
    return ids, begin


def _distinct(model: Crf, data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Distinct words: (feature ids, begins, index of each word into them)."""
    prefix = prefix_hash(data)
    _, where, inverse = np.unique(span_hash(prefix, first, last), return_index=True, return_inverse=True)
    return *word_features(model, data, prefix, first[where], last[where]), inverse


def _segments(count: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the segments of consecutive words, given the word count of each text."""
    pieces = -(-count // size)
    total = int(pieces.sum())
    text = np.repeat(np.arange(len(count)), pieces)
    k = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(count) - count)[text] + k * size
    return begin, np.minimum(size, count[text] - k * size)


def forward_backward(model: Crf, emission: np.ndarray, begin: np.ndarray, length: np.ndarray, want_pairs: bool = False):
    """Label probabilities of every word (rows of ``emission``), and the expected transitions if asked for."""
    n, labels = len(begin), len(model.labels)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    steps = int(length[0]) if n else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # segments longer than t
    score = np.exp(emission - emission.max(1, keepdims=True))
    step, start = np.exp(model.step), np.exp(model.start)
    alpha = np.empty_like(score)
    now = np.tile(start, (n, 1))
    for t in range(steps):
        at = begin[: alive[t]] + t
        now = (now[: alive[t]] @ step if t else now[: alive[t]]) * score[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    out, pairs = np.empty_like(score), np.zeros((labels, labels))
    back = np.ones((n, labels))
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        if t + 1 < steps and (k := alive[t + 1]):
            seen = back[:k] * score[at[:k] + 1]
            if want_pairs:
                joint = alpha[at[:k], :, None] * step * seen[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back[:k] = seen @ step.T
            back[:k] /= back[:k].sum(1, keepdims=True)
        both = alpha[at] * back[:m]
        out[at] = both / both.sum(1, keepdims=True)
    return out, pairs


def train_crf(texts: list[bytes], langs: list[str], epochs: int = 4, batch: int = 256, rate: float = 0.15, seed: int = 5) -> Crf:
    """Adagrad on the conditional likelihood of spliced segments."""
    labels = sorted(set(langs))
    size, rng = len(labels), np.random.Generator(np.random.PCG64(seed))
    model = Crf.blank(labels)
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = LOWER[data]
    first, last, row = word_spans(data, starts)
    if size < 2 or not len(first):
        return model
    gold = np.searchsorted(labels, langs)[row]
    model.lexicon = lexicon_of(span_hash(prefix_hash(data), first, last), gold, size)
    ids, begins, word = _distinct(model, data, first, last)
    # Pieces of 8..TRAIN_SEGMENT words; a training segment is one to four pieces of any languages.
    cuts = [np.zeros(1, np.int64)]
    while cuts[-1][-1] < len(word):
        cuts.append(cuts[-1][-1] + np.cumsum(rng.choice([8, 16, 32, TRAIN_SEGMENT], 4096)))
    edges = np.union1d(np.minimum(np.concatenate(cuts), len(word)), np.flatnonzero(np.diff(row, prepend=-1)))
    edges = np.union1d(edges, [len(word)])
    pieces = np.stack([edges[:-1], edges[1:]], 1)
    g_w, g_s, g_t = np.full(model.weights.shape, 1e-6, np.float32), np.full(size, 1e-6), np.full((size, size), 1e-6)
    for _ in range(epochs):
        line = np.concatenate([np.arange(a, b) for a, b in pieces[rng.permutation(len(pieces))]])
        for at in range(0, len(line), batch * TRAIN_SEGMENT):
            mine = line[at : at + batch * TRAIN_SEGMENT]
            seg, length = _segments(np.array([len(mine)]), TRAIN_SEGMENT)
            uniq, local = np.unique(word[mine], return_inverse=True)
            span = begins[uniq + 1] - begins[uniq]
            feature = ids[np.repeat(begins[uniq] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
            heads = np.cumsum(span) - span
            emission = np.add.reduceat(model.weights[feature], heads, axis=0)[local]
            prob, pairs = forward_backward(model, emission.astype(float), seg, length, True)
            y = gold[mine]
            rest = prob.copy()
            rest[np.arange(len(y)), y] -= 1
            inside = np.ones(len(y), bool)
            inside[seg] = False
            pairs -= np.bincount((y[:-1] * size + y[1:])[inside[1:]], minlength=size * size).reshape(size, size)
            for k in range(size):
                by_word = np.bincount(local, rest[:, k], len(uniq))
                grad = np.bincount(feature, np.repeat(by_word, span), len(g_w)) / len(mine) * 50
                g_w[:, k] += grad**2
                model.weights[:, k] -= rate * grad / np.sqrt(g_w[:, k])
            for value, grad, seen in ((model.step, pairs / len(mine) * 50, g_t), (model.start, rest[seg].sum(0) / len(mine) * 50, g_s)):
                seen += grad**2
                value -= rate * grad / np.sqrt(seen)
    return model


def label_slice(model: Crf, data: np.ndarray, starts: np.ndarray):
    """(row of each word, whether it holds a letter, its label probabilities)."""
    data = LOWER[data]
    first, last, row = word_spans(data, starts)
    if not len(first):
        return row, np.zeros(0, bool), np.zeros((0, len(model.labels)))
    ids, begins, word = _distinct(model, data, first, last)
    emission = np.add.reduceat(model.weights[ids], begins[:-1], axis=0).astype(float)[word]
    lettered = np.add.reduceat(_LETTERISH[data], np.stack([first, np.minimum(last, len(data) - 1)], 1).ravel())[::2] > 0
    if last[-1] == len(data):  # the last range of reduceat ends with the data
        lettered[-1] = _LETTERISH[data[first[-1] :]].any()
    emission[~lettered] = 0
    seg, length = _segments(row_counts(row, len(starts) - 1))
    return row, lettered, forward_backward(model, emission, seg, length)[0]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, usable: Column, train_docs: int, train_text_bytes: int, id_col: str, text_col: str, lang_col: str) -> Crf:
    """A model of at most ``train_docs`` labelled rows, drawn evenly over languages by a hash of the id; each label has one at least."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= train_text_bytes))
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)).alias("d"))
    per = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # one row a language
    if not per:
        return Crf.blank([])
    quota = max(1, train_docs // len(per))
    # About twice the quota of each language is drawn; of a language with few rows, all.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in per.items() for x in (k, int(min(1.0, max(2 * quota, 20) / n) * (1 << 30))))), F.col("l"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("d", F.xxhash64("t")))
    got = rows.where(F.col("d") < share).withColumn("r", place).where(F.col("r") <= quota).orderBy("l", "r").collect()
    model = train_crf([g.t.encode() for g in got], [g.l for g in got])
    del got
    trim()  # the driver goes on with the model alone
    return model


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict_languages(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score for every whole text."""
    inner = docs.select(*(F.col(c) for c in keep), F.col(text_col).alias("_crf_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in inner.schema.fields[:-1]) + "lang_pred string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, _, data, starts in batch_slices(batch.columns[-1]):
                n = len(starts) - 1
                if not model.labels:
                    langs, scores = langs + [UND] * n, scores + [0.0] * n
                    continue
                row, lettered, prob = label_slice(model, data, starts)
                mine = row[lettered]
                total = np.stack([np.bincount(mine, prob[lettered, k], n) for k in range(len(model.labels))], 1)
                count = row_counts(mine, n)
                best = total.argmax(1)
                for i in range(n):
                    sure = count[i] > 0 and _has_letter(data[starts[i] : min(starts[i + 1], starts[i] + 64)].tobytes())
                    if count[i] and not sure:
                        sure = _has_letter(data[starts[i] : starts[i + 1]].tobytes())
                    langs.append(model.labels[best[i]] if sure else UND)
                    scores.append(float(min(1.0, total[i, best[i]] / count[i])) if sure else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return inner.mapInArrow(tidy(scan), schema)


def identify_languages(docs: DataFrame, train_docs: int = 1_600, train_text_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score for every row; learned from labelled rows that are not held out."""
    model = fit(docs, ~held_out(F.col(id_col)), train_docs, train_text_bytes, id_col, text_col, lang_col)
    out = predict_languages(docs, model, id_col, text_col, (id_col,))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def language_runs(model: Crf, text: str) -> list[tuple[int, int, str]]:
    """Maximal runs of equally labelled words, as (first word, end word, language)."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, prob = label_slice(model, data, np.array([0, len(data)]))
    best = prob.argmax(1)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(best)) + 1, [len(best)])) if len(best) else np.zeros(1, int)
    return [(int(a), int(b), model.labels[best[a]]) for a, b in zip(edges[:-1], edges[1:])]
