"""Main text of web pages: nearest-URL page differencing over lines of text, with markup in support.

Pages of a host with equal lines are one page: they get one verdict.  Distinct pages are ordered by URL path; each is
compared with the neighbour whose path is nearest.  Of neighbours that share at least NEAR_COPY of the text bytes the later
is a copy of the earlier; a run of copies is passed over whole, up to the next other page.  The text lines (blocks) of both,
menus and adverts included, are aligned by their longest common subsequence, and shared lines are deleted.  A page keeps its
lines inside an explicit content element (article, main): two pages may carry the same article, and an advert may quote one.

Markup decides only where differencing cannot.  Lines that no neighbour shares go if their markup is that of a menu, header,
footer, sidebar, notice, advert, form or reader comment; and on a page without another page to difference with, lines outside
its content elements go if it has such elements.  Class, id and role words count only where a whole name consists of them, so
``has-sidebar`` and ``ad-free`` mean nothing; names of layout (``sidebar``, ``promo``) on an element around a content element
mean nothing either, and nor does a form around it.  Scripts, styles, and the text of form controls are never lines.

Defined results: null html gives an empty text and 0 characters; a null or odd URL puts the page on the empty host; pages
alone on their host, or with copies only, keep all lines that markup leaves; repeated rows get equal results; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, tidy

#: Pages at partition ends that are sent to every task, in bytes of their lines.
MOST_SENT = 64 << 20
#: Neighbours that share at least this part of the longer one's text bytes are copies: what they share is no furniture.
NEAR_COPY = 0.9

# Element names by what they mean for text, and class, id or role words of page furniture.
RAW = frozenset("script style textarea title noscript template svg iframe object select button xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
FURNITURE = frozenset("nav footer aside menu dialog".split())
FORM = frozenset("form fieldset".split())
#: Names of what is never part of an article, and of places in a layout, which may also hold the article.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox sponsor sponsored nav navbar navigation menu menubar footer masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr popup newsletter "
    "subscribe signup login share sharing social related recommended comment comments reply replies respond disqus pagination pager copyright contentinfo search skip".split()
)
LAYOUT_WORDS = frozenset("banner promo promotion sidebar aside rail foot notice notices alert modal overlay widget complementary".split())
#: Words that name no content by themselves and may stand beside one that does.
PLAIN_WORDS = frozenset("site page main top bottom left right primary secondary inner outer first second box block container wrapper wrap list item items links link bar area section unit slot text form thread".split())
CONTENT = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
#: A comment or declaration that nothing closes.
_UNCLOSED = re.compile(r"<!--.*|<[!?].*", re.S)
_DECIMAL = re.compile(r"&#([0-9]{8,});?")
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
#: How a line is marked: no furniture, furniture that a content element inside lifts, furniture.
FREE, LOOSE, FIRM = 0, 1, 2


def _marked(tag: str, attrs: str, content: bool) -> int:
    """What an element says of itself."""
    if tag in FURNITURE or tag == "header" and not content:
        return FIRM
    mark = LOOSE if tag in FORM else FREE
    if not attrs:
        return mark
    if _HIDDEN.search(attrs):
        return FIRM
    if tag in ("html", "body"):
        return mark
    for m in _ATTR.finditer(attrs):
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(m.groups(""))).lower().split():
            words = set(_WORD.findall(name))
            if words <= FURNITURE_WORDS | LAYOUT_WORDS | PLAIN_WORDS and (known := words - PLAIN_WORDS):
                mark = max(mark, LOOSE if known <= LAYOUT_WORDS else FIRM)
    return mark


def _number(m: re.Match) -> str:
    """A decimal reference as it stands without leading zeros; one beyond all code points is the replacement character."""
    digits = m[1].lstrip("0") or "0"
    return f"&#{digits};" if len(digits) <= 7 else "\ufffd"


def clean(raw: str) -> str:
    if "&" in raw:
        raw = html.unescape(_DECIMAL.sub(_number, raw))
    return " ".join(raw.split())


class _Open:
    """The open elements: each with its mark and whether it lies in a content element, and the places of each name.

    Places are looked up by name, so an end tag that closes nothing costs the same however many elements are open.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else -1

    def push(self, tag: str, mark: int, content: bool) -> None:
        k = len(self.stack)
        self.stack.append((tag, mark, content))
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> bool:
        """The nearest open element of this name goes with all in it; a stray inline end tag closes no block."""
        k = self.last(tag)
        if k < 0 or tag not in BLOCK and self.blocks and k < self.blocks[-1]:
            return False
        self.cut(k)
        return True

    def make_room(self, tag: str) -> bool:
        """A block ends the paragraph that is open in the nearest block; a list item also the one before it in its list."""
        if tag == "li":
            k = max(self.last("p"), self.last("li"))
            if k < 0 or k < max(self.last("ul"), self.last("ol")):
                return False
        else:
            k = self.blocks[-1] if self.blocks else -1
            if k < 0 or self.stack[k][0] != "p":
                return False
        self.cut(k)
        return True

    def state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (FREE, False)


def page_blocks(page: str) -> list[tuple[bool, bool, str]]:
    """(inside a content element, marked as furniture, raw text) of every block with text, in page order; in linear time."""
    out: list[tuple[bool, bool, str]] = []
    parts: list[str] = []
    aside: list[str] = []  # text of furniture inside the open block
    opened = _Open()
    skip, content = FREE, False
    low = ""
    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends beyond

    def flush() -> None:
        for marked, text in ((False, parts), (True, aside)):
            if text:
                raw = "".join(text)
                if raw and not raw.isspace():
                    out.append((content, marked, raw))
                text.clear()

    while at < end:
        # Beyond the last > only comments and declarations mean anything, and they go on to the end.
        m = _TOKEN.search(page, at, last) if at < last else _UNCLOSED.search(page, at)
        if m is None and at < last:
            m = _UNCLOSED.search(page, last)
        if (stop := m.start() if m else end) > at:
            (aside if skip else parts).append(page[at:stop])
        if not m:
            break
        at = m.end() if not (m[0].startswith("<!--") and not m[0].endswith("-->")) else end
        if m.re is _UNCLOSED:
            break
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            (aside if skip else parts).append(" ")
        if closing:
            if opened.close(tag):
                skip, content = opened.state()
            continue
        if tag in RAW:
            low = low or page.lower()
            if len(low) != end:
                low = re.sub("[A-Z]", lambda c: c[0].lower(), page)
            shut = low.find("</" + tag, at)
            at = end if shut < 0 else (page.find(">", shut) + 1 or end)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and opened.make_room(tag):
            skip, content = opened.state()
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in CONTENT and not content and skip == LOOSE:
            skip = FREE
        skip, content = max(skip, _marked(tag, attrs, content)), content or tag in CONTENT and skip == FREE
        opened.push(tag, skip, content)
    flush()
    return out


def line_key(content: bool, text: str) -> int:
    """64 bits of a line; the lowest bit says whether it lies in a content element."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 << 1 | content


#: Edits up to which two pages are aligned step by step from both ends of what differs; beyond that by rows of bits.
FEW_EDITS = 64
#: Bits of all rows that may be held at once (8 MB); a larger table is halved first.
HELD_BITS = 1 << 26


def _few_edits(a: list[int], b: list[int], most: int = FEW_EDITS) -> list[tuple[int, int]] | None:
    """A longest common subsequence of lists that differ in few places, by furthest reaching paths; none if they differ in more."""
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(most + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach.get(k + 1, 0) if k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1) else reach.get(k - 1, -1) + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                pairs = []
                for e in range(d, -1, -1):
                    before, k = trail[e], x - y
                    back = k + 1 if k == -e or k != e and before.get(k - 1, -1) < before.get(k + 1, -1) else k - 1
                    px = before.get(back, 0)
                    py = px - back
                    while x > px and y > py and e or not e and x and y:
                        x, y = x - 1, y - 1
                        pairs.append((x, y))
                    if e:
                        x, y = px, py
                return pairs[::-1]
    return None


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Rows of the table of common lengths as bits: bit j of row i is 0 where the length of a[:i], b[:j + 1] exceeds that of b[:j]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        if match := places.get(x, 0):
            u = row & match
            row = (row + u | row - u) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(row: int, m: int) -> np.ndarray:
    """Common lengths with b[:0] .. b[:m] from a row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _by_bits(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence in len(a) * len(b) / 64 steps and bounded memory: halves are aligned one after the other."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n * m > HELD_BITS and n > 1:
        half = n // 2
        ahead, behind = _lengths(_rows(a[:half], b, False)[0], m), _lengths(_rows(a[half:][::-1], b[::-1], False)[0], m)
        k = int(np.argmax(ahead + behind[::-1]))
        return _by_bits(a[:half], b[:k]) + [(i + half, j + k) for i, j in _by_bits(a[half:], b[k:])]
    rows = [r.to_bytes(m // 8 + 1, "little") for r in _rows(a, b, True)]
    pairs, i, j = [], n, m
    while i and j:
        at, bit = j - 1 >> 3, 1 << (j - 1 & 7)
        if rows[i][at] & bit:
            j -= 1
        else:
            i -= 1
            if rows[i][at] & bit:  # the length grows here only
                j -= 1
                pairs.append((i, j))
    return pairs[::-1]


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Common ends are matched first and lines that only one side has are left out.  Pages that differ in few places are aligned
    in time about proportional to their length, others by rows of bits; both give a longest one.
    """
    head, tail = 0, 0
    most = min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = range(head, len(a) - tail), range(head, len(b) - tail)
    both = {a[i] for i in x} & {b[j] for j in y}
    x, y = [i for i in x if a[i] in both], [j for j in y if b[j] in both]
    left, right = [a[i] for i in x], [b[j] for j in y]
    middle = _few_edits(left, right) if left and right else []
    if middle is None:
        middle = _by_bits(left, right)
    n, m = len(a), len(b)
    return [(i, i) for i in range(head)] + [(x[i], y[j]) for i, j in middle] + [(n - t, m - t) for t in range(tail, 0, -1)]


def shared_lines(mine: np.ndarray, other: np.ndarray) -> list[int]:
    """Indices of my lines that the aligned page shares, without those inside a content element of mine."""
    pairs = common_lines((mine >> np.uint64(1)).tolist(), (other >> np.uint64(1)).tolist())
    return [i for i, _ in pairs if not int(mine[i]) & 1]


def near_copy(a: bytes, a_sizes: bytes, b: bytes, b_sizes: bytes) -> bool:
    """Whether two pages (line keys and the lines' byte counts) share NEAR_COPY of their text."""
    if a == b:
        return True
    x, y = np.frombuffer(a, np.uint64) >> np.uint64(1), np.frombuffer(b, np.uint64) >> np.uint64(1)
    m, n = np.frombuffer(a_sizes, np.uint32).astype(np.int64), np.frombuffer(b_sizes, np.uint32).astype(np.int64)
    most = max(m.sum(), n.sum())
    if min(m.sum(), n.sum()) < NEAR_COPY * most:
        return False
    return bool(min(m[np.isin(x, y)].sum(), n[np.isin(y, x)].sum()) >= NEAR_COPY * most)


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def path_nearness(a: str, b: str) -> tuple[int, int]:
    """Shared leading path parts, then shared leading characters."""
    x, y = a.split("/"), b.split("/")
    parts = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return parts, next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def main_text(blocks: list[tuple[int, bool, str]], dropped: set[int] | None) -> str:
    """The free blocks (number, content, text) that differencing did not drop; if there was nothing to difference with, those in content elements if any."""
    if dropped is None:
        inside = any(c and clean(t) for _, c, t in blocks)
        return "\n\n".join(filter(None, (clean(t) for _, c, t in blocks if c or not inside)))
    return "\n\n".join(filter(None, (clean(t) for i, _, t in blocks if i not in dropped)))


def sent_whole(rows: DataFrame, size: Column, name: str) -> DataFrame:
    """``rows`` written, and marked for sending to every task if they take at most MOST_SENT bytes; else they are joined by shuffling."""
    held = materialise(rows, name)
    return F.broadcast(held) if (held.agg(F.sum(size)).first()[0] or 0) <= MOST_SENT else held


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page.

    Line keys and sizes (12 bytes a line) of distinct pages are sorted by (host, path) over range partitions, so a hot host
    spreads over many tasks; what lies beyond a partition's ends comes from a table of one row a partition.
    """
    id_type = dict(pages.dtypes)[id_col]
    base = pages.select(F.col(id_col).alias("_id"), F.xxhash64(url_col, html_col).alias("_row"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))

    def to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [page_blocks(h or "") for h in batch.column(3).to_pylist()]
            lines = [np.array([line_key(c, t) for c, _, t in x], np.uint64).tobytes() for x in blocks]
            # Furniture by markup has no weight: what makes two pages copies is the rest.
            sizes = [np.array([0 if f else len(t.encode("utf-8", "surrogatepass")) for _, f, t in x], np.uint32).tobytes() for x in blocks]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in lines]
            hosts, paths = zip(*map(split_url, batch.column(2).to_pylist())) if batch.num_rows else ((), ())
            texts, raws = (pa.array(x, pa.string()) for x in (hosts, paths)), (pa.array(x, pa.binary()) for x in (digests, lines, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *texts, *raws], ["_id", "_row", "host", "path", "digest", "lines", "sizes"])

    # Written first: the range boundaries come from a sample job, which would parse every page once more.
    keyed = materialise(base.mapInArrow(tidy(to_lines), f"_id {id_type}, _row bigint, host string, path string, digest binary, lines binary, sizes binary"), "page-keys")
    order = ["path", "_id", "_row"]
    distinct = keyed.where(F.octet_length("lines") > 0).groupBy("host", "digest").agg(F.min(F.struct(*order)).alias("m"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    distinct = distinct.select("host", "m.*", "digest", "lines", "sizes")
    order = ["host", *order]
    ranged = materialise(distinct.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "page-lines")
    page, place = F.struct("host", "path", "lines", "sizes"), F.struct(*order)
    within = Window.partitionBy("pid").orderBy(*order)
    onward, backward = (Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.col("pid"), F.col("pid").desc()))  # one row a partition
    weight = lambda *pages: sum((F.coalesce(F.octet_length(f"{p}.lines") + F.octet_length(f"{p}.sizes"), F.lit(0)) for p in pages), F.lit(0))
    ends = ranged.groupBy("pid").agg(F.max_by(page, place).alias("end")).select("pid", F.last("end").over(onward).alias("outer"))
    beside = ranged.withColumn("p", F.lag(page).over(within)).join(sent_whole(ends, weight("outer"), "page-ends"), "pid").withColumn("p", F.coalesce("p", "outer")).drop("outer")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [
                p is None or p["host"] != host or not near_copy(lines, sizes, p["lines"], p["sizes"])
                for host, lines, sizes, p in zip(*(batch.column(c).to_pylist() for c in ("host", "lines", "sizes", "p")))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.bool_())], [*batch.schema.names, "head"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in beside.schema.fields)
    runs = materialise(beside.mapInArrow(mark, f"{fields}, head boolean"), "page-runs")
    # A run's pages meet the last page of the run before it and the first page of the run after it.
    runs = runs.withColumn("last", F.when(F.col("head"), F.col("p"))).withColumn("first", F.when(F.col("head"), page)).drop("p")
    carried = runs.groupBy("pid").agg(F.max_by("last", F.when(F.col("head"), place)).alias("l"), F.min_by("first", F.when(F.col("head"), place)).alias("f"))
    carried = carried.select("pid", F.last("l", True).over(onward).alias("outer_last"), F.last("f", True).over(backward).alias("outer_first"))
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = Window.partitionBy("pid").orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    near = (
        runs.withColumn("p", F.last("last", True).over(so_far)).withColumn("n", F.last("first", True).over(to_come))
        .join(sent_whole(carried, weight("outer_last", "outer_first"), "page-carried"), "pid")
        .select("host", "digest", "path", "lines", "sizes", F.coalesce("p", "outer_last").alias("p"), F.coalesce("n", "outer_first").alias("n"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = []
            for host, path, lines, sizes, p, n in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "lines", "sizes", "p", "n"))):
                others = [x for x in (p, n) if x and x["host"] == host and not near_copy(lines, sizes, x["lines"], x["sizes"])]
                other = max(others, key=lambda x: path_nearness(path, x["path"]), default=None)
                drops.append(np.array(shared_lines(np.frombuffer(lines, np.uint64), np.frombuffer(other["lines"], np.uint64)), np.int32).tobytes() if other else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drops, pa.binary())], ["host", "digest", "drops"])

    verdicts = near.mapInArrow(compare, "host string, digest binary, drops binary").where("drops is not null")
    drops = keyed.select(F.col("_id").alias("_i"), F.col("_row").alias("_r"), "host", "digest").join(verdicts, ["host", "digest"]).select("_i", "_r", "drops").dropDuplicates(["_i", "_r"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            free = ([(i, c, t) for i, (c, f, t) in enumerate(page_blocks(h or "")) if not f] for h in batch.column(3).to_pylist())
            packed = [squeeze(json.dumps(x, ensure_ascii=False).encode("utf-8", "surrogatepass")) for x in free]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["_id", "_row", "_url", "packed"])

    packed = base.mapInArrow(tidy(pack), f"_id {id_type}, _row bigint, _url string, packed binary")
    joined = packed.join(drops, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left").select("_id", "_url", "packed", "drops")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [
                main_text(json.loads(expand(b).decode("utf-8", "surrogatepass")), None if d is None else set(np.frombuffer(d, np.int32).tolist())).encode("utf-8", "replace").decode()
                for b, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(tidy(unpack), f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint")
