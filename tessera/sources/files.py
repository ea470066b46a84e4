"""File scans, inventories and sinks.  All file access goes through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_elements import CHUNK, parsed, read_containers, read_elements


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_document(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """One row of a whole JSON file; a missing file gives no row, or an error."""
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_keyed_object(spark: SparkSession, path: str, value_schema: str, chunk: int = CHUNK) -> DataFrame:
    """{id: struct, ...} -> (id, value), read by ranges of ``chunk`` bytes; a missing file gives no rows, a malformed one raises."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"id string, value struct<{value_schema}>")
    found = parsed(read_elements(spark, path, chunk=chunk), f"struct<{value_schema}>")
    return found.select(F.col("key").alias("id"), "value")


def read_member(spark: SparkSession, path: str, field: str, schema: str, missing_ok: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(pos, the columns of ``schema``) of the array under ``field`` of a JSON file, read by ranges of ``chunk`` bytes."""
    return read_members(spark, path, {field: schema}, missing_ok, chunk)[field]


def read_members(spark: SparkSession, path: str, schemas: dict[str, str], missing_ok: bool = True, chunk: int = CHUNK) -> dict[str, DataFrame]:
    """``read_member`` of several fields, by one index of the document."""
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return {field: spark.createDataFrame([], f"pos bigint, {schema}") for field, schema in schemas.items()}
    found = read_containers(spark, path, list(schemas), chunk)
    return {field: parsed(found[field], f"struct<{schema}>").select(F.col("offset").alias("pos"), "value.*") for field, schema in schemas.items()}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, malformed ones raise, a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(row.alias("r")).select("r.*")


#: Quotes in quoted fields are doubled, and blanks at a field's ends are its own.
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_QUOTING).option("sep", "\t").option("header", True).option("multiLine", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; also takes the place of serialised in-memory pools."""
    return spark.read.parquet(path)


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, length) of the files below a folder, without their bytes."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def sidecars(metadata: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of ``metadata`` (stem, status, ...) with an image of the same stem; status is missing or success."""
    fine = metadata.where(F.col("status").isNull() | (F.col("status") == "success"))
    return fine.join(images.select("stem", "path"), "stem")


def resolve_first(candidates: DataFrame, files: DataFrame, key: str, path: str = "path", priority: str = "priority") -> DataFrame:
    """For each key the existing candidate of least priority number."""
    there = candidates.join(files.select(F.col("path").alias("_p")).distinct(), F.col(path) == F.col("_p"), "left_semi")
    return there.groupBy(key).agg(F.min_by(path, priority).alias(path))


def folder_report(expected: DataFrame, files: DataFrame) -> DataFrame:
    """name, exists and number of files of each expected folder (columns name, prefix); a prefix ends with a slash.

    A path meets the folders above it by equality: it is exploded into its parents, as many as it has slashes.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    counts = files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    hit = expected.join(counts, "prefix", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))
    return hit.select("name", (F.col("n_files") > 0).alias("exists"), "n_files")


def image_id_of(name: Column, prefix: str = "COCO_test2015_") -> Column:
    """The number in '<prefix><digits>.jpg' in any case, else null."""
    return F.nullif(F.regexp_extract(name, rf"(?i)^{prefix}(\d+)\.jpg$", 1), F.lit("")).cast("bigint")


def image_name_of(image_id: Column, prefix: str = "COCO_test2015_") -> Column:
    return F.concat(F.lit(prefix), F.lpad(image_id.cast("string"), 12, "0"), F.lit(".jpg"))


def decode_image(raw: Column) -> Column:
    """Base64, with or without a data: prefix and padding, to bytes."""
    body = F.regexp_replace(raw, r"^data:[^,]*,", "")
    return F.unbase64(F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int"))))


def fingerprint(files: DataFrame, columns: tuple[str, ...] = ("path", "length")) -> str:
    """A digest of a multiset of rows: another listing gives another one, their order none.

    Row digests are added up lane by lane (eight of 32 bits), so any number of rows is a few numbers a task.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(8)]
    total = files.agg(F.count(F.lit(1)).alias("n"), *lanes)
    return total.select(F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in total.columns)), 256)).first()[0]


def local_or_none(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of several Parquet sources that is there, local copies first; none gives None, and nothing is fetched."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.parquet(there[0]) if there else None


def needs_download(length: Column, least: int = 1_000_000) -> Column:
    """A listed file shorter than ``least`` bytes counts as broken."""
    return length.isNull() | (length < least)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def write_document(row: DataFrame, path: str) -> None:
    """A one-row summary or manifest as one JSON file."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_joined(parts: list[tuple[str, DataFrame | str]], path: str) -> list[str]:
    """One text file of literal texts and of ordered frames (one column of text led by a comma), each written by range-ordered tasks.

    A frame's part files lie below a folder of this attempt.  Their manifest (name and length in order) is written there
    first; the pieces are streamed through a buffer into a file beside it, without the first comma of a frame; and one rename
    that replaces what was there makes it visible.  An attempt that fails leaves the earlier file.
    """
    spark = next(x for _, x in parts if isinstance(x, DataFrame)).sparkSession
    jvm, work = spark.sparkContext._jvm, f"{path.rpartition('/')[0] or '.'}/_attempt-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    hadoop = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pieces: list = []
    leads: list[int] = []  # the piece that begins with the first comma of a frame
    for name, part in parts:
        if isinstance(part, str):
            made = hadoop(f"{work}/{name}")
            out = system.create(made, True)
            out.write(part.encode())
            out.close()
            pieces.append(made)
        else:
            part.write.text(f"{work}/{name}")
            listed = [x.getPath() for x in system.listStatus(hadoop(f"{work}/{name}")) if x.getPath().getName().startswith("part-")]
            listed = [x for x in sorted(listed, key=lambda x: x.getName()) if system.getFileStatus(x).getLen()]
            leads += [len(pieces)] if listed else []
            pieces += listed
    manifest = [f"{x.getName()} {system.getFileStatus(x).getLen()}" for x in pieces]
    note = system.create(hadoop(f"{work}/_manifest"), True)
    note.write("\n".join(manifest).encode())
    note.close()
    whole = hadoop(f"{work}/whole")
    out = system.create(whole, True)
    try:
        for i, piece in enumerate(pieces):
            source = system.open(piece)
            if i in leads:
                source.seek(1)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        out.close()
    if target.getParent() is not None:
        system.mkdirs(target.getParent())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.java.net.URI("file:///"), conf).rename(whole, target, options)
    system.delete(hadoop(work), True)
    return manifest


def json_parts(rows: DataFrame, order: list[str], name: str = "rows", key: str | None = None, fields: list[str] | None = None) -> list[tuple[str, DataFrame | str]]:
    """Pieces of one JSON array of all rows in order (``order`` tells all rows apart), for ``write_joined``; with ``key`` of one object by it.

    Elements have ``fields``, or all columns but ``key``.

    Rows are range-partitioned by ``order`` and each is led by a comma, so no task needs to know the first or the last one.
    """
    item = F.to_json(F.struct(*(fields or (c for c in rows.columns if c != key))), {"ignoreNullFields": "false"})
    if key:
        item = F.concat(F.substring(F.to_json(F.array(F.col(key).cast("string"))), F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(":"), item)
    ranged = rows.select(F.struct(*order).alias("_o"), item.alias("_item")).repartitionByRange("_o").sortWithinPartitions("_o")
    lines = ranged.select(F.concat(F.lit(","), "_item").alias("value"))
    marks = "{}" if key else "[]"
    return [(f"{name}-0-open", marks[0]), (f"{name}-1-rows", lines), (f"{name}-2-close", marks[1])]


def write_json_array(rows: DataFrame, order: str | list[str], path: str) -> list[str]:
    """One file below ``path`` with one JSON array of all rows in order, as evaluation servers take it; repeated attempts leave one valid array."""
    return write_joined(json_parts(rows, [order] if isinstance(order, str) else order), f"{path}/part-00000.json")


def write_keyed_object(rows: DataFrame, key: str, path: str) -> list[str]:
    """One file with one JSON object: ``key`` names each row's member."""
    return write_joined(json_parts(rows, [key], key=key), path)


def write_json_object(members: dict[str, tuple], path: str) -> list[str]:
    """One file with one JSON object whose members are arrays of (rows, order[, fields]), see ``json_parts``."""
    parts: list[tuple[str, DataFrame | str]] = []
    for i, (name, (rows, order, *fields)) in enumerate(members.items()):
        parts.append((f"m{i}-name", ("{" if i == 0 else ",") + json.dumps(name) + ":"))
        parts += json_parts(rows, order, f"m{i}", None, *fields)
    return write_joined([*parts, ("end", "}")], path)


#: Columns of the audit files.
MATCH_AUDIT = ("train_idx", "source", "question_id", "image_id", "train_image", "reference_image", "hamming_distance")
POOL_AUDIT = ("train_idx", "train_image", "reference_image", "hamming_distance", "train_source")


def write_audit(rows: DataFrame, path: str, layout: tuple[str, ...] = MATCH_AUDIT) -> None:
    """An audit file of a fixed layout; columns that ``rows`` lacks are empty."""
    write_csv(rows.select(*((F.col(c).cast("string") if c in rows.columns else F.lit("")).alias(c) for c in layout)), path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").options(**_QUOTING).option("header", True).option("sep", sep).csv(path)


def manifest(frame: DataFrame, name: str, value: str) -> DataFrame:
    """name -> sorted distinct values, for exclusion and reference manifests."""
    return frame.groupBy(name).agg(F.array_sort(F.collect_set(value)).alias("values"))


