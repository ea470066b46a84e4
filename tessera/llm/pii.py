"""Personal data with offset-preserving deobfuscation.

Plain identifiers are matched in the text itself.  Disguises go through a chain of transducers: the first writes ASCII for
look-alike characters and leaves out invisible ones, the second writes digits for spelled ones, the third signs for spelled,
bracketed or set-off at signs and dots.  Each reads what the one before it wrote and keeps the source range of every piece it
writes, so identifiers found in the last text are mapped back through the chain.  They are added unless they lie within a
plain one of their kind.

Defined results: null and empty texts have no spans; null ids, repeated rows and other columns, whatever their names, pass
unharmed; an empty table gives no rows.  Offsets are code points of the source text, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import tidy

Span = tuple[str, int, int]
Edit = tuple[int, int, str]
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_TAIL = re.compile(r"[^A-Za-z0-9._%+-]")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Found from each '@' outwards, which takes linear time on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield "email", start, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[Span]:
    """Dotted chains of digit runs, four runs at a time from the left."""
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7 or "." not in m.group():
            continue
        runs, at = m.group().split("."), m.start()
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield "ip", at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                yield "phone", m.start(), m.end()


def plain_spans(text: str) -> list[Span]:
    """Base identifiers by kind, then start."""
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


# Characters that look like the ASCII character they map to.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ⅼ": "l", "﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # fullwidth forms
LOOKALIKES |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
#: Characters that show nothing and are left out.
INVISIBLE = "​‌‍⁠﻿­"
#: Digit words (English, French, German, Spanish) and the spoken plus sign.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "plus": "+", "más": "+",
}
#: Spoken or bracketed at signs and dots.
AT_WORDS, DOT_WORDS = ("at", "arobase", "arroba", "ät"), ("dot", "point", "punkt", "punto")
#: Endings that count where no sign but a bare "at" shows a disguise, or after "at ... point", which prose uses too.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "info", "io", "co", "eu", "de", "fr", "es", "uk", "us", "biz", "dev", "app")
#: Words after a bare "at" that are no domain.
NO_DOMAINS = "the a an this that these those my our your his her its their each any some no all noon night home work least most last first once".split()
#: Words before a bare "at" and a plainly written site that are no local part ("visit us at example.com").
NO_LOCALS = "us me him her them it is are was were be look looking looked found find available online site website page pages visit more hosted live read see here up out and or by".split()

_ODD = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "]")
_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_GAP = rf"(?:[ ,.-]{{1,2}}|\s++(?:{_dot})\s++)"
_SPELLED = re.compile(rf"(?<!\w)(?:{_digit}|[0-9]+)(?:{_GAP}(?:{_digit}|[0-9]+)){{6,}}(?!\w)")
_SPELLED_HINT = re.compile(rf"(?:{_digit}){_GAP}(?:{_digit}|[0-9])")
_DIGIT_WORD = re.compile(rf"(?:{_digit})(?!\w)")
_DOT_WORD = re.compile(rf"\s++(?:{_dot})\s++")
#: Four numbers with spelled dots between them.
_QUAD = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\s++(?:{_dot})\s++|\.)[0-9]{{1,3}}){{3}}(?!\w|\.[0-9])")
_SIGN = re.compile(rf"[ ]*[\[({{<][ ]*(?:(?P<at>{_at}|@)|(?P<dot>{_dot}|\.))[ ]*[\])}}>][ ]*")
_B, _C = r"\s", r"[a-z0-9-]"
_FRAME = rf"{_B}*+[\[({{<]{_B}*+(?:%s){_B}*+[\])}}>]{_B}*+"
_DOT = re.compile(rf"(?P<plain>\.)|(?P<framed>{_FRAME % (_dot + "|[.]")})|{_B}++(?P<word>{_dot}){_B}++|{_B}++(?P<apart>\.){_B}++")
_DOT_SIGN = re.sub(r"\?P<\w+>", "?:", _DOT.pattern)
#: An at sign of any form with a domain whose dots have any form.  Signs start at the first of their blanks, which keeps this linear.
_ADDRESS = re.compile(
    rf"(?<!{_B})(?:(?P<framed>{_FRAME % f'{_at}|@'}|[\[({{<][aä][\])}}>])|(?P<at>{_B}++(?P<word>{_at}){_B}++|{_B}*+@{_B}*+))"
    rf"(?P<domain>{_C}++(?:(?:{_DOT_SIGN}){_C}++)++)"
)
_DOMAIN_WORD = re.compile(rf"{_C}++")
_LOCAL_LOW = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _dot_before(low: str, end: int, floor: int) -> int:
    """Where a dot word or a bracketed dot that ends at ``end`` starts, with its blanks; -1 if there is none."""

    def blanks(k: int) -> int:
        while k > floor and low[k - 1].isspace():
            k -= 1
        return k

    k = blanks(end)
    framed = k > floor and low[k - 1] in "])}>"
    if not framed and k == end:
        return -1
    k = blanks(k - 1) if framed else k
    word = next((w for w in (*DOT_WORDS, *((".",) if framed else ())) if low.endswith(w, floor, k)), "")
    start = blanks(k - len(word))
    if not word or not framed and start == k - len(word):
        return -1
    if framed:
        if start <= floor or low[start - 1] not in "[({<":
            return -1
        start = blanks(start - 1)
    return start if start > floor and low[start - 1] in _LOCAL_LOW else -1


def address_edits(low: str) -> Iterator[tuple[int, int, str]]:
    """At signs and dots of addresses with at least one of them as a word, in brackets or set off by blanks.

    Each sign may have its own form.  The longest domain with a fitting ending counts: after an explicit dot any of two
    letters or more; after a dot between blanks, or where only a bare "at" shows the disguise, one of ENDINGS.  A plain
    address is not carried on over a dot word after it.
    """
    floor = 0
    for m in _ADDRESS.finditer(low):
        at, end = m.start(), m.start("domain")
        before = low[at - 1] if at > floor else ""
        if before not in _LOCAL_LOW or before in ("", "."):
            continue
        bare = m.group("word") is not None or m.group("at") not in (None, "@")
        first = _DOMAIN_WORD.match(low, end)
        if bare and first.group() in NO_DOMAINS and low[first.end()].isspace():
            continue
        dots, chosen, explicit = [], [], not bare and m.group("framed") is not None
        pos = first.end()
        whole = m.group("at") == "@"
        while pos < m.end():
            d = _DOT.match(low, pos)
            word = _DOMAIN_WORD.match(low, d.end())
            if whole and dots and not d.group("plain") and all(x.group("plain") for x in dots):
                break
            dots.append(d)
            explicit = explicit or not d.group("plain")
            ending = word.group()
            prose = d.group("apart") or bare and m.group("word") in (None, "at") and (d.group("word") not in (None, "dot") or not explicit)
            if len(ending) >= 2 and ending.isalpha() and (ending in ENDINGS if prose else explicit or bare):
                chosen = list(dots)
            pos = word.end()
        start = at
        while start > floor and low[start - 1] in _LOCAL_LOW:
            start -= 1
        if not chosen or bare and all(d.group("plain") for d in chosen) and low[start:at] in NO_LOCALS:
            continue
        if m.group("at") != "@":
            yield at, end, "@"
        for d in chosen:
            if not d.group("plain"):
                yield d.start(), d.end(), "."
        while start > floor:
            k = _dot_before(low, start, floor)
            if k < 0:
                break
            yield k, start, "."
            start = k
            while start > floor and low[start - 1] in _LOCAL_LOW:
                start -= 1
        floor = m.end()


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # a character that lower-cases to several: keep offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def look_alikes(text: str) -> list[Edit]:
    """ASCII for characters that look like it; invisible ones go."""
    return [] if text.isascii() else [(m.start(), m.end(), LOOKALIKES.get(m.group(), "")) for m in _ODD.finditer(text)]


def spelled_digits(text: str) -> list[Edit]:
    """Digits for runs of at least seven numbers of which three are words; dot words between them are dots."""
    low, found = _lower(text), []
    words = low.replace("-", " ").replace(",", " ").replace(".", " ").split(" ")
    if sum(map(DIGIT_WORDS.__contains__, words)) < 3 or not _SPELLED_HINT.search(low):
        return found
    for m in _SPELLED.finditer(low):
        spelled = list(_DIGIT_WORD.finditer(low, m.start(), m.end()))
        if len(spelled) < 3:
            continue
        at = m.start()
        for w in spelled:
            gap = low[at : w.start()]
            if gap and (dotted := _DOT_WORD.fullmatch(gap)) or gap and not any(map(str.isdigit, gap)):
                found.append((at, w.start(), "." if dotted else ""))  # blanks and commas between digits
            found.append((w.start(), w.end(), DIGIT_WORDS[w.group()]))
            at = w.end()
    return found


def signs(text: str) -> list[Edit]:
    """At signs and dots that are words, stand in brackets or between blanks."""
    low, found = _lower(text), []
    if any(c in low for c in "[({<"):
        for m in _SIGN.finditer(low):
            if m.group("at") or m.group("dot"):
                found.append((m.start(), m.end(), "@" if m.group("at") else "."))
    found.extend(address_edits(low))
    if any(w in low for w in DOT_WORDS):
        for m in _QUAD.finditer(low):
            found.extend((d.start(), d.end(), ".") for d in _DOT_WORD.finditer(low, m.start(), m.end()))
    return found


TRANSDUCERS = (look_alikes, spelled_digits, signs)


class Transduction:
    """A text after edits, and the way back: where each piece starts, its source range, and whether it is a copy of it."""

    def __init__(self, text: str, changes: list[Edit]) -> None:
        parts, self.begins, self.pieces, size, at = [], [], [], 0, 0
        for a, b, new in [*sorted(changes, key=lambda e: (e[0], -e[1])), (len(text), len(text), "")]:
            if a < at:  # within an edit that is already made
                continue
            for piece, src, same in ((text[at:a], (at, a), True), (new, (a, b), False)):
                if piece:
                    parts.append(piece)
                    self.begins.append(size)
                    self.pieces.append((*src, same))
                    size += len(piece)
            at = b
        self.text = "".join(parts)

    def source(self, s: int, e: int) -> tuple[int, int]:
        i, j = bisect_right(self.begins, s) - 1, bisect_right(self.begins, e - 1) - 1
        (a, _, copied), (c, d, copied_end) = self.pieces[i], self.pieces[j]
        return a + s - self.begins[i] if copied else a, c + e - self.begins[j] if copied_end else d


def hidden_spans(text: str) -> list[Span]:
    """Identifiers that show only in the normalised text, as source ranges."""
    chain: list[Transduction] = []
    now = text
    for write in TRANSDUCERS:
        if changes := write(now):
            chain.append(Transduction(now, changes))
            now = chain[-1].text
    out = []
    for kind, s, e in plain_spans(now) if chain else ():
        a, b = s, e
        for t in reversed(chain):
            a, b = t.source(a, b)
        if text[a:b] != now[s:e]:
            out.append((kind, a, b))
    return out


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by kind and start."""
    base = plain_spans(text)
    added = [s for s in hidden_spans(text) if not any(k == s[0] and a <= s[1] and s[2] <= b for k, a, b in base)]
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans make one mask."""
    base, added = find_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all), n_added."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base, added = find_spans(text or "")
                every = sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base
                for c, k in zip(cols, KINDS):
                    c.append(sum(s[0] == k for s in base))
                cols[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
                cols[5].append(_join(every))
                cols[6].append(len(added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(cols))], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(id_col, text_col).mapInArrow(tidy(scan), schema)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` masked; other columns and null texts as they are."""
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(tidy(scan), docs.schema)
