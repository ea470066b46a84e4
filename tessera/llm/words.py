"""Token ids and counts of texts by their words, for tokenizers whose pretokens hold no white space."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers; the memo is emptied when it is full.
MEMO_WORDS = 1_000_000
#: Texts are encoded in slices of about so many bytes: the larger, the fewer distinct words come up anew.
SLICE_BYTES = 4 << 20
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)\]]*(?=\s|$)|\n")
_ENDERS, _QUOTES = ".!?。！？…", "\"'”’»)]"
#: Blank kinds become a space; a line feed stays, as it may end a sentence.  The second table lower-cases A-Z besides.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[9, 11, 12, 13]] = 32
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK[ord("'")] = False


class WordIds:
    """Token ids of texts and the sentence ends among them, each distinct word encoded once.

    Where the tokenizer file shows that pretokens hold no white space, the ids of a text are those of its blank-delimited words
    in a row.  If it also lower-cases, and a letter and a mark never share a pretoken, words are lower-cased and cut before a
    mark first, which leaves far fewer of them.  Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(Path(path).read_text())
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and not any(
            t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]
        )
        self.specials = [t["content"].lower().encode() for t in spec["added_tokens"]]
        same = [("Ab", "ab"), ("É", "é"), ("a,", "a ,"), ("ab.)", "ab .)"), ("a#$", "a #$"), ("a-b", "a -b")]
        self.folds = self.by_word and all(self._ids(x) == self._ids(y) for x, y in same)
        self.word_end = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _store(self, words: list[str], ids: np.ndarray, size: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at = np.concatenate((self.at, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ends = np.concatenate((self.ends, ends))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        # Words of letters only are one pretoken each, which its last token shows: they are encoded in one go.
        plain = [w for w in words if w.isalpha()] if self.folds else []
        if plain:
            ids = np.array(self._ids(" ".join(plain)), np.uint32)
            stops = np.flatnonzero(self.word_end[ids]) + 1
            if len(stops) == len(plain):
                self._store(plain, ids, np.diff(stops, prepend=0), np.zeros(len(plain), bool))
            else:  # not one pretoken each after all
                plain = []
        rest = [w for w in words if not w.isalpha()] if plain else words
        if rest:
            ids = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
            size = np.array([len(x) for x in ids], np.int64)
            ends = np.array([w == "\n" or w.rstrip(_QUOTES)[-1:] in _ENDERS and w != "" for w in rest], bool)
            self._store(rest, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum())), size, ends)

    def _words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each text's words begin, the number of every word in the memo)."""
        raw = data.tobytes().lower()
        if self.folds and not any(x in raw for x in self.specials):
            data = _LOWER[data]
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
            cut[starts] = False
            at = np.flatnonzero(cut)
            data, starts = np.insert(data, at, 32), starts + np.searchsorted(at, starts, "left")
        else:
            data = _PLAIN[data]
        lists = pc.split_pattern(pc.replace_substring(_strings(data, starts), "\n", " \n "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = list(map(self.known.get, words))
        missing = [w for w, c in zip(words, codes) if c is None]
        if len(self.known) + len(missing) > MEMO_WORDS:
            self.forget()
            missing = words
        if missing:
            self._learn(missing)
            codes = list(map(self.known.__getitem__, words))
        word = np.array(codes, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        return lists.offsets.to_numpy(), word

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, tokens of each text, positions in ids after which a sentence ends)."""
        if not self.by_word:
            return self._whole(_strings(data, starts))
        offsets, word = self._words(data, starts)
        size = self.size[word]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(self.at[word] - (after - size), size) + np.arange(total)]
        bounds = np.concatenate(([0], after))[offsets]
        return ids, np.diff(bounds), np.unique(after[self.ends[word]])

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if not self.by_word:
            codes = self.tok.encode_batch_fast(_strings(data, starts).to_pylist(), add_special_tokens=False)
            return np.array([len(c.ids) for c in codes], np.int64)
        offsets, word = self._words(data, starts)
        return np.diff(np.concatenate(([0], np.cumsum(self.size[word])))[offsets])

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, ends, at = [], [], [], 0
        for text in column.to_pylist():
            code = self.tok.encode(text, add_special_tokens=False)
            stops = np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64)
            last = np.array([b for _, b in code.offsets], np.int64)
            ends.append(at + np.searchsorted(last, stops, "right"))
            ids.append(np.array(code.ids, np.uint32))
            sizes.append(len(code.ids))
            at += len(code.ids)
        none = np.zeros(0, np.uint32)
        return np.concatenate([none, *ids]), np.array(sizes, np.int64), np.unique(np.concatenate([np.zeros(0, np.int64), *ends]))


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One a worker and tokenizer file: its memo serves all of the worker's tasks."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
