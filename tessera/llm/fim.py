"""Fill-in-middle transformation by relational units.

A document's lines become rows (``posexplode``), a window sums their lengths, each document's two cut requests meet the
units by ordinal, and the aggregated offsets cut the text.  Lines travel as a key, an ordinal and a length; a text crosses
the network once, in the join with its offsets.

Defined results: a null or empty text has no units and is plain; a null id is hashed as the empty string; rows that repeat
id and text get the same result, each its own row; an empty table gives no rows; of the other columns only those named in
``keep`` are carried along, and they must not be called like a result column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
_KEY = ["_k1", "_k2"]


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit draws from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def unit_count(text: Column) -> Column:
    """Units of a text: its line ends, and one more for a last line without one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("bigint")


def assemble(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form: a text that holds a mark was left plain, so each mark occurs once."""
    n = len(MIDDLE)
    last = F.locate(MIDDLE, output)
    tail = F.substring(output, last + n, F.length(output))

    def parts(second: str) -> tuple[Column, Column]:
        mid = F.locate(second, output)
        return F.substring(output, F.lit(n + 1), mid - n - 1), F.substring(output, mid + n, last - mid - n)

    before, after = parts(SUFFIX)
    late, early = parts(PREFIX)
    return F.when(form == "psm", F.concat(before, tail, after)).when(form == "spm", F.concat(early, tail, late)).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are transformed, ``spm_percent`` of those suffix first.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col("_id"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_kept")] if keep else []))
    # Rows of one key are equal: 128 bits of id and text, without nulls, so that units, requests and texts share a partitioning.
    rows = rows.withColumns({"_k1": F.xxhash64("_id", "_text"), "_k2": F.xxhash64(F.lit(seed), "_text", "_id")})

    n = unit_count(F.col("_text"))
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    form = F.when((F.col("_text") == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    requests = (
        rows.select(*_KEY, n.alias("_n"), (h1 % (n + 1)).alias("_a"), (h2 % (n + 1)).alias("_b")).groupBy(*_KEY)
        .agg(F.count("*").alias("_copies"), F.max(F.least("_a", "_b")).alias("_from"), F.max(F.greatest("_a", "_b")).alias("_to"))
    )

    units = rows.select(*_KEY, F.posexplode(F.transform(F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)), F.length)).alias("_at", "_length"))
    # Equal rows are peers of the window's range, so a sum counts each unit once a copy.
    ends = units.withColumn("_sum", F.sum(F.col("_length").cast("bigint")).over(Window.partitionBy(*_KEY).orderBy("_at")))
    end = F.expr("_sum div _copies")
    cuts = (
        ends.join(requests, _KEY).where((F.col("_at") + 1 == F.col("_from")) | (F.col("_at") + 1 == F.col("_to"))).groupBy(*_KEY)
        .agg(F.max(F.when(F.col("_at") + 1 == F.col("_from"), end)).alias("_p"), F.max(F.when(F.col("_at") + 1 == F.col("_to"), end)).alias("_q"))
    )

    # A cut before the first unit meets no row.
    p, q = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("_p", "_q"))
    cut = rows.join(cuts, _KEY, "left").withColumns({"_form": form, "_p": p, "_q": q})
    body = F.col("_text")
    output = assemble(F.col("_form"), F.substring(body, F.lit(1), F.col("_p")), F.substring(body, F.col("_p") + 1, F.col("_q") - F.col("_p")), F.substring(body, F.col("_q") + 1, F.length(body)), body)
    moved = F.col("_form") != "plain"
    return cut.select(
        F.col("_id").alias(id_col), *(F.col(f"_kept.`{c}`") for c in keep), n.alias("n"), F.col("_form").alias("form"),
        F.when(moved, F.col("_p").cast("bigint")).alias("prefix_chars"), F.when(moved, (F.col("_q") - F.col("_p")).cast("bigint")).alias("middle_chars"), output.alias("output"),
    )


def transform_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with the digests of its output and of the text rebuilt from output and form."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
