"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .storage import read_table

TOKENIZER = "word_bpe_49k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_hash", "chosen")


def op2_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import tile_benchmark

    return tile_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(read_table(spark, sf_dir, "documents"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_spans

    return pii_spans(read_table(spark, sf_dir, "documents"))


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import fingerprint_with_next

    return fingerprint_with_next(read_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).drop("source")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import transform_digests

    return transform_digests(read_table(spark, sf_dir, "documents"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_sequences

    return pack_sequences(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_interactions

    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP5_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), m as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as best from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> best then best end as refers_to
from m
"""


OP1_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), g as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), n as (
  select doc_id, count(*) as n from g group by 1
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), link as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), edge as (
  select a, b from link union all select b, a from link
), reach as (
  select doc_id, doc_id as root from documents union select e.b, r.root from reach r join edge e on e.a = r.doc_id
), least_root as (
  select doc_id, min(root) as component_id from reach group by 1
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_root left join n using (doc_id)
"""


OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
  select *, case when text = '' then [] when suffix(text, chr(10)) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as units,
    cast('0x' || h[1:8] as ubigint) as h1, cast('0x' || h[9:16] as ubigint) as h2, cast('0x' || h[17:24] as ubigint) as h3, cast('0x' || h[25:32] as ubigint) as h4
  from d
), k as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u
), c as (
  select *, cast(least(length(text), coalesce(list_sum(list_transform(units[1:a], lambda x: length(x) + 1)), 0)) as bigint) as p, cast(least(length(text), coalesce(list_sum(list_transform(units[1:b], lambda x: length(x) + 1)), 0)) as bigint) as q,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from k
), o as (
  select *, text[1:p] as pre, substring(text, p + 1, q - p) as mid, substring(text, q + 1) as suf from c
)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then p end as bigint) as prefix_chars, cast(case when form <> 'plain' then q - p end as bigint) as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else text end) as output_sha256, sha256(text) as restored_sha256
from o
"""


OP13_SQL = """
with recursive d as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, min(doc_id) over (partition by coalesce(text, '')) as first from documents
), w as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d
), l as (
  select doc_id, max(quality) as good, max(toxic) as toxic from labels group by 1
), f as (
  select part, coalesce(good, 0) as good, coalesce(l.toxic, 0) as toxic,
    case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when coalesce(w.doc_id > first, false) then 'E' else '' end as fails
  from w left join l on l.doc_id = w.doc_id
), g as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2
), orders as (
  select '' as filter_order union all select filter_order || x from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where not contains(filter_order, x)
), steps as (
  select filter_order, step, filter_order[step] as letter, filter_order[1:step - 1] as earlier, filter_order[1:step] as so_far from orders, (select unnest(range(1, 6)) as step) where length(filter_order) = 5
), r as (
  select part, filter_order, step, letter,
    sum(n) filter (where regexp_replace(fails, '[' || so_far || ']', '') = fails) as kept,
    sum(n) filter (where contains(fails, letter) and translate(fails, earlier, '') = fails) as removed,
    sum(n) filter (where contains(fails, letter) and translate(fails, earlier, '') <> fails) as redundant,
    sum(n) filter (where fails = letter) as unique_fails,
    sum(good) filter (where contains(fails, letter) and translate(fails, earlier, '') = fails) as good_lost,
    sum(toxic) filter (where contains(fails, letter) and translate(fails, earlier, '') = fails) as toxic_lost
  from g, steps group by 1, 2, 3, 4
)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
  cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, letter) as bigint) as shapley
from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op5_warc_bundles": OP5_SQL, "op11_fill_in_middle": OP11_SQL, "op13_filter_shapley": OP13_SQL}
