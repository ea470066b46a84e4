"""Greedy suppression by row: boxes of an image by score, each against the kept boxes of touching cells only.

Rows are sorted within the partition of their image and walked batch by batch, so an image is never a group in memory: a
task holds what it has kept.  Kept boxes lie in a hash of cells by size class (powers of two of width and height) and place:
two boxes overlap beyond a limit only if their sizes differ by less than the limit's inverse and their centres by less than
their mean size, which leaves a few cells to look into however many boxes an image has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def _class(size: float) -> int:
    return math.frexp(size)[1] if size > 0 else -1100


def overlap(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


class KeptBoxes:
    """Boxes by size class and cell; ``near`` yields those whose centre may lie within a reach of a box's centre."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], dict[tuple[int, int], list[Box]]] = {}

    def add(self, b: Box) -> None:
        w, h = b[2] - b[0], b[3] - b[1]
        kind = _class(w), _class(h)
        x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        cell = math.floor(math.ldexp(x, -kind[0])), math.floor(math.ldexp(y, -kind[1]))
        self.cells.setdefault(kind, {}).setdefault(cell, []).append(b)

    def near(self, b: Box, least_ratio: float = 0.0, around_centre: bool = False) -> Iterator[Box]:
        """``least_ratio`` bounds how much smaller one side may be than the other's; ``around_centre``: only boxes over b's centre."""
        w, h = b[2] - b[0], b[3] - b[1]
        x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        for (kw, kh), cells in self.cells.items():
            top_w, top_h = math.ldexp(1.0, kw), math.ldexp(1.0, kh)  # sizes of a class are at least half of these
            if top_w < least_ratio * w or top_h < least_ratio * h or w < least_ratio * top_w / 2 or h < least_ratio * top_h / 2:
                continue
            rx, ry = (top_w / 2, top_h / 2) if around_centre else ((w + top_w) / 2, (h + top_h) / 2)
            x0, x1 = math.floor((x - rx) / top_w), math.floor((x + rx) / top_w)
            y0, y1 = math.floor((y - ry) / top_h), math.floor((y + ry) / top_h)
            if (x1 - x0 + 1) * (y1 - y0 + 1) > len(cells):
                for (i, j), held in cells.items():
                    if x0 <= i <= x1 and y0 <= j <= y1:
                        yield from held
            else:
                for i in range(x0, x1 + 1):
                    for j in range(y0, y1 + 1):
                        yield from cells.get((i, j), ())


class Walk:
    """One image: what is kept by suppression, and by containment where that is asked for."""

    def __init__(self, limit: float, contained: bool, most: int | None) -> None:
        self.limit, self.contained, self.most = limit, contained, most
        self.kept, self.outer, self.found = KeptBoxes(), KeptBoxes(), 0

    def take(self, b: Box) -> bool:
        """Whether the next box by score stays."""
        if self.most is not None and self.found >= self.most:
            return False
        mine, proper = area(b), b[2] > b[0] and b[3] > b[1]
        if proper:
            for k in self.kept.near(b, max(0.0, self.limit)):
                inter = overlap(k, b)
                if inter / (area(k) + mine - inter) > self.limit:
                    return False
            self.kept.add(b)
        if self.contained:
            if mine <= 0:
                return False
            for k in self.outer.near(b, around_centre=True):
                other = area(k)
                if overlap(k, b) / mine >= 0.85 and mine < other and mine / other <= 0.5:
                    return False
            self.outer.add(b)
        self.found += 1
        return True


def suppress_rows(rows: DataFrame, key: str, order: list[str], limit: float = 0.95, contained: bool = False, most: int | None = None) -> DataFrame:
    """The kept rows of ``rows`` (key, score, box, ...) with ``place``, their 0-based rank in the image.

    Boxes go by descending score, then by ``order``, which tells an image's boxes apart.  A box goes if its IoU with a kept
    one exceeds ``limit``; with ``contained`` empty boxes go too, and those mostly inside a kept box of at least twice their
    area.  At most ``most`` stay.  A box with a null corner or not a number for one goes; a null key is an image of its own.
    """
    fields = [f for f in rows.schema.fields]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", place bigint"
    key_at = names.index(key)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, state = None, None
        for batch in batches:
            corners = [batch.column(names.index("box")).field(c).to_pylist() for c in ("x1", "y1", "x2", "y2")]
            whole = batch.column(names.index("box")).is_valid().to_pylist()
            stays, places = [], []
            for i, (k, valid, *b) in enumerate(zip(batch.column(key_at).to_pylist(), whole, *corners)):
                if state is None or k != image:
                    image, state = k, Walk(limit, contained, most)
                if valid and all(c is not None and c == c for c in b) and state.take(tuple(b)):
                    stays.append(i)
                    places.append(state.found - 1)
            if stays:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(stays)).columns, pa.array(places, pa.int64())], [*names, "place"])

    ordered = rows.repartition(key).sortWithinPartitions(key, F.desc("score"), *order)
    return ordered.mapInArrow(walk, schema)
