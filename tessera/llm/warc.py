"""WARC archives as seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames, each holding a group of WARC records, closed by the seekable-format
seek table in a skippable frame.  An index maps every record identifier to its bundle, frame and offset in the frame.
Equal payloads are stored once: the others become revisit records that refer to the stored one.

Defined results: ids are integers; a null payload is empty; equal payloads are compared by SHA-1 and length; of rows that
repeat the largest id all are responses; null ids are written and never referred to while another id has the payload; an empty
table writes no bundle and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, scratch_path

#: Uncompressed bytes of a frame, and frames of a bundle.  A larger record has a frame of its own.
FRAME_BYTES, BUNDLE_FRAMES = 1 << 20, 64
#: Payloads below this many bytes are always stored.
LEAST_SHARED = 1_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = "record_id string, bundle string, frame int, at bigint, length bigint"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+:", uri) else f"file://{os.path.abspath(uri)}")


def warc_record(kind: str, record_id: str, url: str, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record.  A revisit carries no payload, but its digest and length."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record length mismatch")
    return fields, rest[:length]


class BundleWriter:
    """Writes one bundle; ``index`` gets (record id, frame, offset in the frame, length)."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.squeeze = out, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.parts and self.size + len(record) > FRAME_BYTES:
            self.flush()
        self.index.append((record_id, len(self.frames), self.size, len(record)))
        self.parts.append(record)
        self.size += len(record)

    def flush(self) -> None:
        if self.parts:
            frame = self.squeeze(b"".join(self.parts))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from the footer alone."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    source.seek(size - 9 - count * entry)
    table, at, out = source.read(count * entry), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(source, entry: tuple[int, int, int]) -> bytes:
    source.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(source.read(entry[1]), max_output_size=entry[2])


def record_urn(page_id: Column, row: Column) -> Column:
    """A stable identifier: the id is readable, the row hash tells repeated ids apart."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(row)))


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per row, without payloads: id, row hash, kind, and what a revisit refers to."""
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.xxhash64(url_col, html_col).alias("_row"), F.sha1(body).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    same = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest", "size").agg(F.max(F.struct("_id", "_row")).alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # Few digests have copies, but one may have most rows: the join is on narrow rows and adaptive execution splits it.
    first = F.col("_id").eqNullSafe(F.col("best._id"))
    return rows.join(same, ["digest", "size"]).where(~first).select("_id", "_row", F.col("best._id").alias("_to"), F.col("best._row").alias("_to_row"))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record; returns the index.

    A task writes bundles under names of its own, so a repeated attempt leaves an unlisted file and never a broken one.
    """
    revisits = plan_records(pages, id_col, url_col, html_col)
    revisits = revisits.groupBy("_id", "_row").agg(F.min("_to").alias("_to"), F.min("_to_row").alias("_to_row")).withColumnsRenamed({"_id": "_i", "_row": "_r"})
    rows = pages.select(F.col(id_col).alias("_id"), F.xxhash64(url_col, html_col).alias("_row"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.join(revisits, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    rows = rows.select(
        record_urn(F.col("_id"), F.col("_row")).alias("record_id"), F.when(F.col("_r").isNotNull(), record_urn(F.col("_to"), F.col("_to_row"))).alias("refers_to"),
        "url", "html",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        writer = out = None
        name = ""

        def finish() -> pa.RecordBatch:
            writer.close()
            out.close()
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            ids, frames, at, length = zip(*writer.index)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64())], ["record_id", "bundle", "frame", "at", "length"])

        for batch in batches:
            for record_id, refers_to, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/{name}.part")
                    writer = BundleWriter(out)
                payload = (page or "").encode("utf-8", "surrogatepass")
                kind = "revisit" if refers_to else "response"
                writer.add(record_id, warc_record(kind, record_id, url or "", hashlib.sha1(payload).hexdigest(), len(payload), payload, refers_to))
                if len(writer.frames) >= BUNDLE_FRAMES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return materialise(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, folder: str, schema: str, convert) -> DataFrame:
    """``convert(fields, payload)`` of every indexed record, read back by seeking to its frame.

    Work is dealt by bundle and frame, so each frame is read and decompressed once.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        types = None
        source, table, opened, frame, held = None, [], None, None, b""
        for batch in batches:
            out = []
            for bundle, k, at, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "length"))):
                if bundle != opened:
                    path = f"{root}/{bundle}"
                    source, opened, frame = store.open_input_file(path), bundle, None
                    table = seek_table(source, source.size())
                if k != frame:
                    frame, held = k, read_frame(source, table[k])
                out.append(convert(*parse_record(held[at : at + length])))
            types = types or pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[x.split()[1]]) for n, x in zip(names, schema.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * len(names), types)], schema=types)

    frames = index.select("bundle", "frame", "at", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return frames.mapInArrow(read, schema)


def lookup(index: DataFrame, folder: str, record_ids: DataFrame) -> DataFrame:
    """record_id and payload of the asked records (column ``record_id``); revisits give an empty payload."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    return read_records(wanted, folder, "record_id string, payload string", lambda f, p: (f["WARC-Record-ID"][1:-1], p.decode("utf-8", "surrogatepass")))


def _page_row(fields: dict[str, str], payload: bytes) -> tuple:
    def page(urn: str) -> int | None:
        part = urn.strip("<>").split(":")[2]
        return None if part == "null" else int(part)

    kind = fields["WARC-Type"]
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    else:
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    return page(fields["WARC-Record-ID"]), size, digest, kind, page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives, then page_id, payload_bytes, payload_digest, record_type, refers_to as read back from them."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_bundles(pages, folder, id_col, url_col, html_col)
    return read_records(index, folder, f"{id_col} bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", _page_row)
