"""Large JSON documents, read in parallel.

A document of one array, of one object, or of an object with a large member (``annotations``) is cut at its elements into
byte ranges, and each range is a task.  That takes a structural index first: a range cannot know whether it starts inside a
string, or how deep.  One job summarises every range for both cases (start outside a string, start inside), the driver
chains the summaries, a few numbers a range, and a second job emits the elements that start in each range, reading on past
its end for the last one.  Python only cuts bytes; elements are parsed by ``from_json`` in the JVM.

Files are opened through ``pyarrow.fs``, which knows local and mounted paths, HDFS and the object stores.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 8 << 20
#: Bytes looked at together; ranges are longer where a document has more than so many of them, as the driver chains them all.
BLOCK, MOST_RANGES = 1 << 20, 512
_QUOTE, _ESCAPE, _COMMA, _COLON = ord('"'), ord("\\"), ord(","), ord(":")
_DELTA = np.zeros(256, np.int8)
_DELTA[[ord("{"), ord("[")]] = 1
_DELTA[[ord("}"), ord("]")]] = -1
_MARK = _DELTA != 0
_MARK[[_QUOTE, _COMMA, _COLON]] = True
_BLANK = b" \t\r\n"
_KEY = re.compile(rb'[ \t\r\n]*("(?:[^"\\]|\\.)*")[ \t\r\n]*:', re.S)


class MalformedDocument(ValueError):
    """The document's brackets, strings or separators do not close."""


def open_file(path: str) -> tuple[pa.NativeFile, int]:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def _escaped_before(file: pa.NativeFile, at: int) -> bool:
    """Whether the byte at ``at`` is escaped: an odd number of backslashes stands before it."""
    run, end = 0, at
    while end > 0:
        begin = max(0, end - 4096)
        part = file.read_at(end - begin, begin)
        solid = len(part.rstrip(b"\\"))
        run += len(part) - solid
        if solid:
            break
        end = begin
    return run % 2 == 1


def structure(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of unescaped quotes, and of brackets, commas and colons."""
    places = np.flatnonzero(_MARK[data])
    slashes = np.flatnonzero(data == _ESCAPE)
    hidden = np.zeros(0, np.int64)
    if len(slashes):
        # A run of backslashes escapes what follows it if its length is odd.
        first = np.flatnonzero(np.concatenate(([True], np.diff(slashes) > 1)))
        lengths = np.diff(np.append(first, len(slashes)))
        after, odd = slashes[first] + lengths, lengths % 2 == 1
        if escaped and slashes[0] == 0:
            odd[0] = not odd[0]
        hidden = after[odd & (after < len(data))]
    if escaped and len(data):
        hidden = np.append(0, hidden)
    hidden = hidden[data[hidden] == _QUOTE]
    if len(hidden):
        places = np.delete(places, np.searchsorted(places, hidden))
    return places, data[places]


class _Range(InputPartition):
    def __init__(self, begin: int, end: int, inside: bool = False, depth: int = 0) -> None:
        self.begin, self.end, self.inside, self.depth = begin, end, inside, depth


def _ranges(path: str, chunk: int) -> list[tuple[int, int]]:
    size = open_file(path)[1]
    chunk = max(chunk, -(-size // MOST_RANGES))
    return [(a, min(size, a + chunk)) for a in range(0, size, chunk)]


class _PlannedReader(DataSourceReader):
    """A reader whose tasks get their own range: the list of all ranges stays with the planner."""

    states: list = []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "states"}


class JsonIndex(DataSource):
    """One row a range: quotes, and the depth it adds and the least depth (from its start) if it starts outside or inside a string."""

    @classmethod
    def name(cls) -> str:
        return "json_index"

    def schema(self) -> str:
        return "begin bigint, end bigint, quotes bigint, outside bigint, inside bigint, low_outside bigint, low_inside bigint"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options)


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, b) for a, b in _ranges(self.path, self.chunk)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        file, _ = open_file(self.path)
        quotes, depths, lows = 0, [0, 0], [0, 0]
        for at in range(part.begin, part.end, BLOCK):
            data = np.frombuffer(file.read_at(min(BLOCK, part.end - at), at), np.uint8)
            _, kinds = structure(data, _escaped_before(file, at))
            passed = np.cumsum(kinds == _QUOTE)
            delta = _DELTA[kinds]
            brackets = np.flatnonzero(delta)
            odd, delta = (passed[brackets] + quotes) % 2, delta[brackets]
            for inside in (0, 1):
                if len(steps := np.cumsum(delta[odd == inside], dtype=np.int64)):
                    lows[inside] = min(lows[inside], depths[inside] + int(steps.min()))
                    depths[inside] += int(steps[-1])
            quotes += int(passed[-1]) if len(passed) else 0
        yield part.begin, part.end, quotes, *depths, *lows


class JsonElements(DataSource):
    """(offset, key, value): elements of an array (key null) or members of an object, as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "offset bigint, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ElementReader(self.options)


class _Walk:
    """Bytes of a file from a place whose state is known, block by block, with quote and depth state at every byte."""

    def __init__(self, file: pa.NativeFile, size: int, at: int, inside: bool, depth: int) -> None:
        self.file, self.size, self.at, self.inside, self.depth = file, size, at, inside, depth

    def block(self, most: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(bytes, and of its structural bytes: places, kinds, depth after each, outside strings) of the next block; none at the end of the file."""
        n = min(most, self.size - self.at)
        if n <= 0:
            return None
        raw = self.file.read_at(n, self.at)
        places, kinds = structure(np.frombuffer(raw, np.uint8), _escaped_before(self.file, self.at))
        quotes = kinds == _QUOTE
        passed = np.cumsum(quotes) + self.inside
        outside = (passed - quotes) % 2 == 0
        depth = self.depth + np.cumsum(np.where(outside, _DELTA[kinds], 0), dtype=np.int64)
        self.at += n
        if len(places):
            self.inside, self.depth = bool(passed[-1] % 2), int(depth[-1])
        return raw, places, kinds, depth, outside


class _ElementReader(_PlannedReader):
    def __init__(self, options: dict) -> None:
        self.path, self.states = options["path"], json.loads(options["states"])
        self.level, self.begin, self.end = int(options["level"]), int(options["begin"]), int(options["end"])
        self.keyed = options["keyed"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Range(*s) for s in self.states] or [_Range(0, 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        """Elements whose separator (the container's opening bracket or a comma) lies in the range."""
        file, size = open_file(self.path)
        walk = _Walk(file, size, part.begin, part.inside, part.depth)
        held: list[bytes] = []  # of the element that is open
        start = None
        out: list[tuple[int, bytes]] = []
        done = part.end <= part.begin
        while not done:
            at = walk.at
            got = walk.block(min(BLOCK, part.end - at) if at < part.end else BLOCK)
            if got is None:
                raise MalformedDocument(f"{self.path}: the document ends inside an element at byte {start}")
            raw, places, kinds, depth, outside = got
            delta = _DELTA[kinds]
            closes = outside & (delta == -1) & (depth == self.level - 1)
            marks = closes | (outside & (depth == self.level) & ((kinds == _COMMA) | (delta == 1)))
            marks &= (places + at >= self.begin) & (places + at <= self.end)
            last = 0
            for m, closed in zip(places[marks].tolist(), closes[marks].tolist()):
                if start is not None:
                    body = b"".join(held) + raw[last:m]
                    out.append((start, body))
                    held, start = [], None
                if closed and m + at != self.end:
                    raise MalformedDocument(f"{self.path}: closed at byte {m + at}")
                if m + at == self.end or m + at >= part.end:
                    done = True
                    break
                start, last = m + at + 1, m + 1
            if not done:
                if start is None and walk.at >= part.end:
                    done = True
                elif start is not None:
                    held.append(raw[last:])
            if len(out) >= 20_000:
                yield self._batch(out)
                out = []
        if out:
            yield self._batch(out)

    def _batch(self, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        offsets, keys, values = [], [], []
        for at, body in found:
            body, key = body.strip(_BLANK), None
            if not body:
                # Only an empty container has an empty element.
                if at == self.begin + 1 and self._only(at):
                    continue
                raise MalformedDocument(f"{self.path}: an empty element at byte {at}")
            if self.keyed:
                m = _KEY.match(body)
                if not m:
                    raise MalformedDocument(f"{self.path}: a member without a name at byte {at}")
                key, body = json.loads(m[1]), body[m.end() :].strip(_BLANK)
            offsets.append(at), keys.append(key), values.append(body.decode("utf-8"))
        return pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(keys, pa.string()), pa.array(values, pa.string())], ["offset", "key", "value"])

    def _only(self, at: int) -> bool:
        file, _ = open_file(self.path)
        return not file.read_at(self.end - at, at).strip(_BLANK)


class JsonMembers(DataSource):
    """For members of a top-level object: where their values start and what ends them, as seen by each range that comes up to that level."""

    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> str:
        return "begin bigint, field string, at bigint, stop bigint"

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options)


class _MemberReader(_PlannedReader):
    def __init__(self, options: dict) -> None:
        self.path, self.states, self.fields = options["path"], json.loads(options["states"]), json.loads(options["fields"])

    def partitions(self) -> list[InputPartition]:
        return [_Range(*s) for s in self.states] or [_Range(0, 0)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        """(range, member, place of the colon after its name, first comma or close after it); without member and colon: the first of the range."""
        if part.end <= part.begin:
            return
        file, size = open_file(self.path)
        walk = _Walk(file, size, part.begin, part.inside, part.depth)
        stops, colons = [], []
        while walk.at < part.end:
            at = walk.at
            _, places, kinds, depth, outside = walk.block(min(BLOCK, part.end - at))
            top = outside & (depth == 1)
            stops.append(places[(top & (kinds == _COMMA)) | (outside & (depth == 0) & (_DELTA[kinds] == -1))] + at)
            colons.append(places[top & (kinds == _COLON)] + at)
        stops = np.concatenate(stops)
        names = {name: field for field in self.fields for name in (json.dumps(field).encode(), json.dumps(field, ensure_ascii=False).encode())}
        longest = max(map(len, names))
        yield part.begin, None, None, int(stops[0]) if len(stops) else None
        for c in np.concatenate(colons).tolist():
            before = file.read_at(min(c, 4096 + longest), max(0, c - 4096 - longest)).rstrip(_BLANK)
            for field in {field for name, field in names.items() if before.endswith(name)}:
                later = np.searchsorted(stops, c)
                yield part.begin, field, c, int(stops[later]) if later < len(stops) else None


def _first_solid(path: str, at: int, size: int) -> tuple[int, int]:
    """Place and value of the first byte from ``at`` on that is not blank (nor a byte order mark)."""
    file, _ = open_file(path)
    while at < size:
        part = file.read_at(min(4096, size - at), at)
        if at == 0 and part.startswith(b"\xef\xbb\xbf"):
            part, at = part[3:], 3
        if body := part.lstrip(_BLANK):
            return at + len(part) - len(body), body[0]
        at += len(part)
    raise MalformedDocument(f"{path}: no value")


def _last_solid(path: str, size: int) -> tuple[int, int]:
    file, _ = open_file(path)
    end = size
    while end > 0:
        begin = max(0, end - 4096)
        if body := file.read_at(end - begin, begin).rstrip(_BLANK):
            return begin + len(body) - 1, body[-1]
        end = begin
    raise MalformedDocument(f"{path}: no value")


def read_elements(spark: SparkSession, path: str, field: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(offset, key, value) of a JSON file's top-level container, or of the container under the top-level member ``field``.

    ``offset`` orders the elements as in the file.  Of members that repeat ``field`` the last counts; an absent or null one
    gives no rows.  Unclosed strings or brackets, trailing text and empty elements raise; what is inside an element is the
    parser's to judge.
    """
    return read_containers(spark, path, [field], chunk)[field]


def read_containers(spark: SparkSession, path: str, fields: list[str | None], chunk: int = CHUNK) -> dict[str | None, DataFrame]:
    """``read_elements`` of each of ``fields``: the document is indexed once, and only ranges that come up to its top level are searched for members."""
    for source in (JsonIndex, JsonElements, JsonMembers):
        spark.dataSource.register(source)
    size = open_file(path)[1]
    begin, opening = _first_solid(path, 0, size)
    end, closing = _last_solid(path, size)
    states, tops, inside, depth = [], [], False, 0
    index = spark.read.format("json_index").option("chunk", chunk).load(path).collect()  # a few numbers a range
    for r in sorted(index, key=lambda r: r.begin):
        states.append((r.begin, r.end, inside, depth))
        if depth + (r.low_inside if inside else r.low_outside) <= 1:
            tops.append(states[-1])
        depth += r.inside if inside else r.outside
        inside ^= bool(r.quotes % 2)
        if depth < 0 or depth == 0 and not inside and begin < r.end <= end:
            raise MalformedDocument(f"{path}: closed before byte {r.end}")
    if inside or depth or (opening, closing) not in ((ord("["), ord("]")), (ord("{"), ord("}"))):
        raise MalformedDocument(f"{path}: strings or brackets do not close")
    named = [f for f in fields if f is not None]
    if named and opening != ord("{"):
        raise MalformedDocument(f"{path}: not an object")
    seen = spark.read.format("json_members").options(states=json.dumps(tops), fields=json.dumps(named)).load(path).collect() if named else []  # one row a range and hit
    found: dict[str | None, DataFrame] = {}
    for field in fields:
        span = (1, begin, end, opening == ord("{")) if field is None else _member_span(path, size, field, seen)
        if span is None:
            found[field] = spark.createDataFrame([], JsonElements({}).schema())
            continue
        level, first, last, keyed = span
        own = [s for s in states if s[1] > first and s[0] <= last]
        options = {"states": json.dumps(own), "level": level, "begin": first, "end": last, "keyed": str(keyed).lower()}
        found[field] = spark.read.format("json_elements").options(**options).load(path)
    return found


def _member_span(path: str, size: int, field: str, seen: list) -> tuple[int, int, int, bool] | None:
    """(level, opening bracket, closing bracket, whether an object) of a member's container; none if it is absent or null."""
    hits = sorted((r for r in seen if r["field"] == field), key=lambda r: r["at"])
    if not hits:
        return None
    at, stop = hits[-1]["at"], hits[-1]["stop"]
    if stop is None:
        stop = min(r["stop"] for r in seen if r["field"] is None and r["stop"] is not None and r["begin"] > at)
    begin, opening = _first_solid(path, at + 1, size)
    file, _ = open_file(path)
    if opening not in b"[{":
        if file.read_at(stop - at - 1, at + 1).strip(_BLANK) == b"null":
            return None
        raise MalformedDocument(f"{path}: {field} holds no array or object")
    keyed, end = opening == ord("{"), stop - 1
    while file.read_at(1, end) in (b" ", b"\t", b"\r", b"\n"):
        end -= 1
    if file.read_at(1, end) != (b"}" if keyed else b"]"):
        raise MalformedDocument(f"{path}: {field} does not close")
    return 2, begin, end, keyed


def parsed(elements: DataFrame, schema: str) -> DataFrame:
    """(offset, key, value) with ``value`` parsed; a malformed element raises."""
    return elements.withColumn("value", F.from_json("value", schema, {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)}))
