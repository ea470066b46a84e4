"""name -> DataFrame builder and, where SQL can say it, the same in ANSI SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as S
from ..functions import text as X
from ..functions import vectors as V
from ..operators import decontam as D
from ..operators import evaluate as E
from ..operators import neighbours as N
from ..operators import pool as P
from ..operators import sampling as M
from ..operators import significance as Z
from ..operators import training as R
from ..streaming import events as streams

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six places; a negative number that rounds to zero keeps its sign, as in SQL's second engine (Spark's own round drops it)."""
    rounded = F.round(c, 6)
    return F.when((rounded == 0) & (c < 0), -rounded).when(c == 0, c).otherwise(rounded)


# ---- decontamination of documents by id and by content -------------------------------------------------------------


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ``reason``: listed as toxic, else holding a whole benchmark item."""
    docs, labels, bench = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    hit = D.holding(docs, bench, "doc_id", "text", "text").select(F.col("_key").alias("doc_id")).withColumn("leak", F.lit(True))
    out = docs.select("doc_id", "source", "lang").join(toxic, "doc_id", "left").join(hit, "doc_id", "left")
    return out.withColumn("reason", F.when(F.col("toxic"), F.lit("toxic_id")).when(F.col("leak"), F.lit("benchmark"))).drop("toxic", "leak")


_REASONS_SQL = """
reasons as (
  select d.doc_id, d.source, d.lang, case when t.doc_id is not null then 'toxic_id' when b.doc_id is not null then 'benchmark' end as reason
  from documents d
  left join (select distinct doc_id from labels where toxic = 1) t on d.doc_id = t.doc_id
  left join (select distinct d2.doc_id from documents d2 join benchmark i on contains(d2.text, i.text)) b on d.doc_id = b.doc_id
)
"""


@query(f"with {_REASONS_SQL} select coalesce(reason, 'clean') as reason, count(*) as n from reasons group by 1")
def hard_id_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_REASONS_SQL} select doc_id, row_number() over (order by doc_id) - 1 as train_idx from reasons where reason is null")
def clean_pool(spark, sf_dir):
    return P.number_rows(_reasons(spark, sf_dir).where("reason is null").select("doc_id"), ["doc_id"]).select("doc_id", F.col("train_idx").cast("bigint").alias("train_idx"))


@query(f"""with {_REASONS_SQL} select (select count(*) from reasons where reason is null and doc_id in (select doc_id from labels where toxic = 1)) as leaked,
  (select count(*) from reasons) = (select count(*) from reasons where reason is null) + (select count(*) from reasons where reason is not null) as balanced""")
def leakage_check(spark, sf_dir):
    r = _reasons(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("t", F.lit(1))
    j = r.join(toxic, "doc_id", "left")
    return j.agg(F.count_if(F.col("reason").isNull() & F.col("t").isNotNull()).alias("leaked"), (F.count(F.lit(1)) == F.count_if(F.col("reason").isNull()) + F.count("reason")).alias("balanced"))


@query("""select doc_id, concat_ws('|', case when text is null or not regexp_matches(text, '\\S') then 'blank text' end, case when n_chars <> length(text) then 'n_chars mismatch' end, case when n_chars < 50 then 'short' end) as errors
  from documents where text is null or not regexp_matches(text, '\\S') or n_chars <> length(text) or n_chars < 50""")
def validate_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    checks = F.array(F.when(F.col("text").isNull() | ~F.col("text").rlike(r"\S"), F.lit("blank text")), F.when(F.col("n_chars") != F.length("text"), F.lit("n_chars mismatch")), F.when(F.col("n_chars") < 50, F.lit("short")))
    return d.select("doc_id", F.filter(checks, lambda e: e.isNotNull()).alias("e")).where(F.size("e") > 0).select("doc_id", F.array_join("e", "|").alias("errors"))


@query("select min(doc_id) as first_id, count(*) as copies from documents group by text having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    g = d.groupBy(F.sha2("text", 256).alias("k"), F.length("text").alias("l")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1").select("first_id", "copies")


@query("select source, (select count(*) from documents) as total_rows, (select count(distinct text) from documents) as unique_texts, count(*) as n from documents group by source")
def pool_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("k"))
    whole = d.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct("k").alias("unique_texts"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole)).select("source", "total_rows", "unique_texts", "n")


@query(f"with {_REASONS_SQL} select source, count(*) as total, count(reason) as removed, count(*) - count(reason) as remaining, round(100.0::double * count(reason) / count(*), 6) as pct from reasons group by source")
def removed_by_source(spark, sf_dir):
    r = _reasons(spark, sf_dir)
    out = P.removal_table(r.where("reason is not null"), r, "source")
    return out.withColumn("pct", F.col("pct").cast("double"))


# ---- hashes and vectors ----------------------------------------------------------------------------------------------

_BITS, _LIMIT = 64, 22
_HASH_SQL = """
h as (select vec_id, label, embedding::double[] as v, list_transform(embedding::double[], lambda x: case when x > list_aggregate(embedding::double[], 'median') then 1 else 0 end) as bits from embeddings),
t as (select vec_id as train_id, label as train_label, v as tv, bits as tb from h where vec_id % 2 = 0),
r as (select vec_id as ref_id, label as ref_label, v as rv, bits as rb from h where vec_id % 2 = 1),
matches as (select train_id, ref_id, train_label, ref_label, d as distance from (select *, list_sum(list_transform(list_zip(tb, rb), lambda p: case when p[1] <> p[2] then 1 else 0 end)) as d from t, r) s where d <= 22),
sims as (select train_id, ref_id, ref_label, round(list_inner_product(tv, rv), 9) as similarity from t, r),
knn as (select * from (select *, row_number() over (partition by train_id order by similarity desc, ref_id) as rank from sims) s where rank <= 5)
"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    even, odd = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    t = even.select(F.col("vec_id").alias("train_id"), F.col("label").alias("train_label"), V.sign_words(F.col("embedding"), _BITS).alias("train_words"), v.alias("train_vec"))
    r = odd.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("ref_label"), V.sign_words(F.col("embedding"), _BITS).alias("ref_words"), v.alias("ref_vec"))
    return t, r


def _matches(spark, sf_dir):
    t, r = _split(spark, sf_dir)
    return N.hamming_join(t.select("train_id", "train_words"), r.select("ref_id", "ref_words"), _LIMIT, 1, _BITS)


def _neighbours(spark, sf_dir):
    t, r = _split(spark, sf_dir)
    return N.nearest(t.select("train_id", "train_vec"), r.select("ref_id", "ref_vec"), 5)


@query(f"with {_HASH_SQL} select train_id, ref_id, cast(distance as bigint) as distance from matches")
def hamming_matches(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("distance", F.col("distance").cast("bigint"))


@query(ORACLE["hamming_matches"])
def hamming_banded(spark, sf_dir):
    """The same by packed blocks in any case: bands of two bits, which this radius leaves, bring nearly all pairs together."""
    t, r = _split(spark, sf_dir)
    return N.hamming_cells(t.select("train_id", "train_words"), r.select("ref_id", "ref_words"), _LIMIT, 1).withColumn("distance", F.col("distance").cast("bigint"))


@query("""with v as (select vec_id, embedding::double[] as a, list_transform(embedding::double[], lambda x, i: case when i <= 8 then -x else x end) as b from embeddings),
h as (select vec_id, list_transform(a, lambda x: case when x > list_aggregate(a, 'median') then 1 else 0 end) as x, list_transform(b, lambda x: case when x > list_aggregate(b, 'median') then 1 else 0 end) as y from v),
p as (select s.vec_id as train_id, t.vec_id as ref_id, list_sum(list_transform(list_zip(s.x, t.y), lambda p: case when p[1] <> p[2] then 1 else 0 end)) as d from h s, h t where t.vec_id % 3 = 1)
select train_id, ref_id, cast(d as bigint) as distance from p where d <= 10""")
def hamming_near(spark, sf_dir):
    """A radius that an index of wide bands narrows down; every third vector, eight components turned round, is a reference."""
    e = table(spark, sf_dir, "embeddings")
    turned = F.transform("embedding", lambda x, i: F.when(i < 8, -x).otherwise(x))
    train = e.select(F.col("vec_id").alias("train_id"), V.sign_words(F.col("embedding"), _BITS).alias("train_words"))
    refs = e.where("vec_id % 3 = 1").select(F.col("vec_id").alias("ref_id"), V.sign_words(turned, _BITS).alias("ref_words"))
    near = N.hamming_indexed(train, refs, 10, 1, _BITS)
    return near.select("train_id", "ref_id", F.col("distance").cast("bigint").alias("distance"))


@query(f"with {_HASH_SQL} select cast(distance as bigint) as distance, count(*) as n from matches group by 1")
def hamming_histogram(spark, sf_dir):
    return D.distance_histogram(_matches(spark, sf_dir)).select(F.col("distance").cast("bigint").alias("distance"), "n")


@query(f"with {_HASH_SQL} select train_id, ref_id, round(similarity, 6) as similarity, rank from knn")
def knn_top5(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("train_id", "ref_id", r6(F.col("similarity")).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(f"with {_HASH_SQL} select t as threshold, (select count(*) from knn where rank = 1 and similarity >= t) as n from (values (0.5::double), (0.45::double), (0.4::double), (0.35::double), (0.3::double), (0.25::double)) x(t)")
def sim_threshold_counts(spark, sf_dir):
    return D.threshold_counts(_neighbours(spark, sf_dir), (0.5, 0.45, 0.4, 0.35, 0.3, 0.25))


@query(f"""with {_HASH_SQL}, a as (select distinct train_id from matches), b as (select train_id from knn where rank = 1 and similarity >= 0.4)
select case when a.train_id is not null and b.train_id is not null then 'both' when a.train_id is not null then 'hash_only' else 'cosine_only' end as flag, count(*) as n from a full join b on a.train_id = b.train_id group by 1""")
def flag_partition(spark, sf_dir):
    flags = D.removed_rows(spark.createDataFrame([], "train_id bigint"), _matches(spark, sf_dir), _neighbours(spark, sf_dir), 0.4)
    flag = F.when(F.col("hash") & F.col("cosine"), F.lit("both")).when(F.col("hash"), F.lit("hash_only")).otherwise(F.lit("cosine_only"))
    return flags.groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_HASH_SQL} select train_id, ref_id, train_label, ref_label, cast(distance as bigint) as distance from matches")
def match_audit(spark, sf_dir):
    t, r = _split(spark, sf_dir)
    m = _matches(spark, sf_dir).join(t.select("train_id", "train_label"), "train_id").join(r.select("ref_id", "ref_label"), "ref_id")
    return m.select("train_id", "ref_id", "train_label", "ref_label", F.col("distance").cast("bigint").alias("distance"))


@query(f"with {_HASH_SQL} select ref_label, count(*) as refs, count_if(ref_id in (select ref_id from matches))::bigint as hit from r group by 1")
def reference_hits(spark, sf_dir):
    _, r = _split(spark, sf_dir)
    hit = _matches(spark, sf_dir).select("ref_id").distinct().withColumn("h", F.lit(1))
    return r.select("ref_id", "ref_label").join(hit, "ref_id", "left").groupBy("ref_label").agg(F.count(F.lit(1)).alias("refs"), F.count("h").alias("hit"))


# ---- pool building ---------------------------------------------------------------------------------------------------


@query("""select user_id, event_type as answer, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as r from events group by 1, 2) s where r = 1""")
def majority_event(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("p"))
    best = c.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", (-F.col("p")).alias("p"))).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("answer"), F.col("b.n").alias("n"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 6) as price from (select *, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) as r from lineitem) s where n <= 3 or r <= 3""")
def topk_lines_per_order(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = P.cap_rows(li, ["l_orderkey"], F.col("l_extendedprice"), F.struct("l_linenumber", "l_partkey", "l_suppkey"), 3)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("l_extendedprice")).alias("price"))


@query("""select l_orderkey, l_linenumber, l_partkey, rank from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rank from lineitem where l_quantity >= 10) s where rank <= 2""")
def first_n_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 10")
    return P.top_per_group(li, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 2).select("l_orderkey", "l_linenumber", "l_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("""select l_orderkey, n from (select l_orderkey, n, coalesce(sum(n) over (order by l_orderkey rows between unbounded preceding and 1 preceding), 0) as before from (select l_orderkey, count(*) as n from lineitem group by 1) g) s where before < 1000""")
def overshoot_cap(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return P.overshoot(g, "l_orderkey", "n", 1000).select("l_orderkey", "n")


@query("select l_orderkey, l_linenumber, o_custkey, p_name from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_quantity >= 45")
def pool_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_partkey")
    o, p = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "o_custkey", "p_name")


@query("select o_orderkey, coalesce(n, 0) as n_lines, coalesce(round(q, 6), -1) as quantity from orders left join (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) l on o_orderkey = l_orderkey")
def left_default(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce(r6(F.col("q")), F.lit(-1.0)).alias("quantity"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_resume(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return E.to_predict(table(spark, sf_dir, "orders").select("o_orderkey"), log, "o_orderkey")


@query("""select (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber > 1)) as missing,
  (select count(distinct l_orderkey) from lineitem where l_linenumber > 1 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')) as extra""")
def submission_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("answer"), "l_linenumber")
    _, missing, _ = E.submission(o.select(F.col("o_orderkey").alias("question_id")), log, "l_linenumber")
    _, _, extra = E.submission(o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("question_id")), log, "l_linenumber")
    return missing.agg(F.count(F.lit(1)).alias("missing")).crossJoin(extra.agg(F.count(F.lit(1)).alias("extra")))


@query("select kind, nationkey, count(*) as n from (select 'customer' as kind, cast(c_nationkey as bigint) as nationkey from customer union all select 'supplier', cast(s_nationkey as bigint) from supplier) s group by 1, 2")
def source_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").cast("bigint").alias("nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("bigint").alias("nationkey"))
    return P.union_pool([c, s]).groupBy("kind", "nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(o_custkey as varchar) as id from orders where o_orderstatus = 'F' union select cast(c_custkey as varchar) from customer where c_acctbal > 5000 union select cast(s_suppkey as varchar) from supplier")
def id_union(spark, sf_dir):
    ids = [table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"), table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey")]
    return P.union_ids(ids)


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def id_except(spark, sf_dir):
    returned = P.union_ids([table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")])
    owing = P.union_ids([table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return P.without_ids(P.without_ids(o, "o_orderkey", returned), "o_custkey", owing)


@query("select c_custkey as id from customer intersect select o_custkey from orders")
def id_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("""select doc_id, i, w as phrase from (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents) s where length(regexp_replace(w, '^\\s+|\\s+$', '', 'g')) >= 3 and regexp_replace(w, '^\\s+|\\s+$', '', 'g') = w""")
def grit_spans(spark, sf_dir):
    """The spans of every word of a text."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    # A word is its own character span of the text; cutting it out by offset would make long texts quadratic.
    phrase = X.span_text(F.col("w"), F.lit(0), F.length("w"))
    return w.select("doc_id", (F.col("p") + 1).cast("bigint").alias("i"), phrase.alias("phrase"), "w").where((F.length("phrase") >= 3) & (F.length("phrase") == F.length("w"))).drop("w")


# ---- text functions --------------------------------------------------------------------------------------------------


def _sql_map(table: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in table.items()) + "}"


def _sql_normalise(x: str) -> str:
    """The answer normaliser as an SQL expression (nested, one level for each mark)."""
    text = f"trim(translate({x}, chr(10) || chr(9), '  '))"
    out = "t"
    for p in X.PUNCTUATION:
        q = p.replace("'", "''")
        out = f"replace({out}, '{q}', case when regexp_matches(t, '\\d,\\d') or contains(t, '{q} ') or contains(t, ' {q}') then '' else ' ' end)"
    out = f"replace(replace(regexp_replace({out}, '\\.(\\d)', chr(1) || '\\1', 'g'), '.', ''), chr(1), '.')"
    words = f"list_filter(regexp_split_to_array(lower({out}), '\\s+'), lambda w: w <> '')"
    numbered = f"list_transform({words}, lambda w: coalesce({_sql_map(X.NUMBER_WORDS)}[w], w))"
    kept = f"list_filter({numbered}, lambda w: w not in ('a', 'an', 'the'))"
    return f"(select array_to_string(list_transform({kept}, lambda w: coalesce({_sql_map(X.CONTRACTIONS)}[w], w)), ' ') from (select {text} as t) q)"


@query(f"select conv_id, turn, {_sql_normalise('text')} as normalised from conversations")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalise_answer(F.col("text")).alias("normalised"))


@query("""with p as (select event_type as top from events group by 1 order by count(*) desc, min(event_id) limit 1),
g as (select user_id, count_if(event_type = top) as m, count(*) as n from events, p where event_type is not null group by 1)
select user_id, round((m * least((m - 1) / 3.0::double, 1) + (n - m) * least(m / 3.0::double, 1)) / n, 6) as score from g""")
def soft_score(spark, sf_dir):
    """Over all events of a user, as sums of counts: no user's events are gathered."""
    e = table(spark, sf_dir, "events")
    top = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("p")).agg(F.max_by("event_type", F.struct("n", (-F.col("p")).alias("q"))).alias("top"))
    # One row a user and type: the matches of X.vqa_soft_score are sums of counts.
    types = e.where("event_type is not null").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(top))
    plain, pred = X.plain_blanks(F.col("event_type")), X.plain_blanks(F.col("top"))
    same = X.normalise_answer(F.col("event_type")) == X.normalise_answer(F.col("top"))
    hits = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0)).cast("double")
    g = types.groupBy("user_id").agg(F.sum("c").cast("double").alias("n"), hits(plain == pred).alias("equal"), hits(same).alias("alike"), (F.min(plain) != F.max(plain)).alias("differ"))
    m, n, one = F.when(F.col("differ"), F.col("alike")).otherwise(F.col("equal")), F.col("n"), F.lit(1.0)
    return g.select("user_id", r6((m * F.least((m - 1) / 3, one) + (n - m) * F.least(m / 3, one)) / n).alias("score"))


@query("""select l_orderkey, round((m * least((m - 1) / 3.0::double, 1) + (n - m) * least(m / 3.0::double, 1)) / n, 6) as score from (select l_orderkey, count_if(l_returnflag = 'N') as m, count(*) as n from lineitem group by 1) g""")
def soft_score_of_orders(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return E.soft_scores(li, "l_orderkey", "l_returnflag", "N").select("l_orderkey", r6(F.col("score")).alias("score"))


@query(r"""select doc_id, nullif(regexp_extract(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ', ' (yes|no) ', 1), '') as answer from documents""")
def yes_no(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract(F.lower("text"), r"(?U)(?<![\p{L}\p{N}_])(yes|no)(?![\p{L}\p{N}_])", 1), F.lit("")).alias("answer"))


@query(r"""select conv_id, turn, nullif(regexp_extract(' ' || regexp_replace(upper(text), '[^\p{L}\p{N}_]+', '  ', 'g') || ' ', ' ([A-D]) ', 1), '') as letter from conversations""")
def option_letter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    options = X.option_map(*(F.lit(f"choice {x}") for x in "wxyz"), keep_all=True)
    return c.select("conv_id", "turn", X.option_letter(F.col("text"), options).alias("letter"))


@query("""select p_partkey, concat_ws(chr(10), 'Which brand?', array_to_string(list_filter(['A. ' || p_name, 'B. ' || p_brand, 'C. ' || p_type, case when p_size % 5 = 0 then null else 'D. ' || p_size end], lambda x: x is not null), chr(10))) as prompt from part""")
def mcq_prompt(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fourth = F.when(F.col("p_size") % 5 == 0, F.lit("nan")).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", X.mcq_prompt(F.lit("Which brand?"), X.option_map(F.col("p_name"), F.col("p_brand"), F.col("p_type"), fourth), F.lit("None")).alias("prompt"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.OBJECT_STOPWORDS) + ")"


@query(f"""with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) as i from documents),
l as (select doc_id, i, lower(w) as w from w where length(w) > 1 and lower(w) not in {_STOP_SQL}),
s as (select doc_id, i, case when length(w) > 4 and w like '%ies' then w[:-4] || 'y' when length(w) > 3 and w like '%s' and w not like '%ss' then w[:-2] else w end as tag from l),
f as (select doc_id, tag, min(i) as i from s group by 1, 2)
select doc_id, count(*) as n_tags, md5(string_agg(tag, ' . ' order by i)) as prompt_md5 from f group by 1""")
def tag_merge(spark, sf_dir):
    # Tags are made and told apart inside the row that holds the text (array_distinct hashes them and keeps first places): nothing is shuffled.
    def tag(w):
        ies, plural = (F.length(w) > 4) & w.endswith("ies"), (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
        return F.when(ies, F.concat(F.left(w, F.length(w) - 3), F.lit("y"))).when(plural, F.left(w, F.length(w) - 1)).otherwise(w)

    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), F.lower)
    tags = F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*X.OBJECT_STOPWORDS)), tag))
    d = table(spark, sf_dir, "documents").select("doc_id", tags.alias("tags")).where(F.size("tags") > 0)
    return d.select("doc_id", F.size("tags").cast("bigint").alias("n_tags"), F.md5(F.array_join("tags", " . ").cast("binary")).alias("prompt_md5"))


@query("select p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'object') as slug from part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("select event_id, coalesce(cast(props->>'$.k' as varchar), '') as key from events")
def json_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.index_key(F.get_json_object("props", "$.k").cast("double").cast("string")).alias("key"))


@query("""with recursive walk as (select p_partkey as origin, p_partkey as place, 0 as hops from part union all select origin, cast(floor(place / 2) as bigint), hops + 1 from walk where place >= 4 and hops < 30)
select origin as p_partkey, arg_max(place, hops) as root, cast(max(hops) as bigint) as hops from walk group by 1""")
def pointer_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    value = F.when(F.col("k") >= 4, F.floor(F.col("k") / 2).cast("string")).otherwise(F.concat(F.repeat(F.lit("x"), 80), F.col("k").cast("string")))
    out = P.resolve_pointers(p.select("k", value.alias("v")), "k", "v")
    return out.select(F.col("k").cast("bigint").alias("p_partkey"), F.regexp_extract("resolved", r"(\d+)$", 1).cast("bigint").alias("root"), F.col("hops").cast("bigint").alias("hops"))


@query("select page_id, cast(nullif(regexp_extract(url, '/(\\d+)(?:\\D|$)', 1), '') as bigint) as id from pages")
def url_id_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"/(\d+)(?:\D|$)", 1), F.lit("")).try_cast("bigint").alias("id"))


# ---- evaluation ------------------------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "lang", (F.col("n_chars") >= 2000).cast("int").alias("p1"), (F.col("n_chars") % 3 != 0).cast("int").alias("p2"), "quality")


_JUDGED_SQL = "j as (select d.doc_id, lang, case when n_chars >= 2000 then 1 else 0 end as p1, case when n_chars % 3 <> 0 then 1 else 0 end as p2, quality from documents d join labels l on d.doc_id = l.doc_id)"


@query(f"with {_JUDGED_SQL} select lang, count(*) as n, round(100 * avg((p1 = quality)::int), 6) as accuracy_pct, cast(grouping(lang) as bigint) as overall from j group by grouping sets ((lang), ())")
def accuracy_by_group(spark, sf_dir):
    out = E.accuracy(_judged(spark, sf_dir), F.col("p1") == F.col("quality"), "lang")
    return out.select("lang", "n", r6(F.col("accuracy_pct")).alias("accuracy_pct"), F.col("overall").cast("bigint").alias("overall"))


_CONFUSION_SQL = f"""with {_JUDGED_SQL}, c as (select lang, count(*) as n, count_if(quality = 1 and p1 = 1)::bigint as tp, count_if(quality = 0 and p1 = 0)::bigint as tn, count_if(quality = 0 and p1 = 1)::bigint as fp, count_if(quality = 1 and p1 = 0)::bigint as fn from j group by 1),
p as (select *, tp / greatest(1, tp + fp)::double as pr, tp / greatest(1, tp + fn)::double as re from c),
m as (select lang, n, tp, tn, fp, fn, round(100.0::double * (tp + tn) / greatest(1, n), 6) as accuracy_pct, round(100 * pr, 6) as precision_pct, round(100 * re, 6) as recall_pct, round(100 * 2 * pr * re / greatest(1e-12::double, pr + re), 6) as f1_pct from p)"""


def _confusion(spark, sf_dir):
    j = _judged(spark, sf_dir)
    word = lambda c: F.when(F.col(c) == 1, F.lit("yes")).otherwise(F.lit("no"))
    m = E.confusion(j.select("lang", word("quality").alias("label"), word("p1").alias("prediction")), ["lang"])
    return m.select("lang", "n", *(F.col(c).cast("bigint").alias(c) for c in ("tp", "tn", "fp", "fn")), *(r6(F.col(c)).alias(c) for c in ("accuracy_pct", "precision_pct", "recall_pct", "f1_pct")))


@query(f"{_CONFUSION_SQL} select * from m")
def confusion_metrics(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"{_CONFUSION_SQL} select round(avg(accuracy_pct), 4) as macro_accuracy_pct, round(avg(f1_pct), 4) as macro_f1_pct from m")
def macro_metrics(spark, sf_dir):
    return E.macro(_confusion(spark, sf_dir), ["accuracy_pct", "f1_pct"]).select(*(F.round(c, 4).alias(c) for c in ("macro_accuracy_pct", "macro_f1_pct")))


def _pairs(spark, sf_dir):
    j = _judged(spark, sf_dir)
    score = lambda p: Z.scores_by_key(j, F.col("doc_id"), (F.col(p) == F.col("quality")).cast("double"), "doc_id")
    both = Z.merge_paired(score("p1"), score("p2"))
    return both.withColumn("benchmark", F.when(F.col("key").cast("bigint") % 20 == 0, F.lit("tiny")).otherwise(F.lit("main")))


_PAIR_SQL = f"""{_JUDGED_SQL}, s as (select case when doc_id % 20 = 0 then 'tiny' else 'main' end as benchmark, (p1 = quality)::int::double as b, (p2 = quality)::int::double as f from j),
g as (select benchmark, count(*) as n, avg(f - b) as md, stddev_samp(f - b) / sqrt(count(*)) as sem, count_if(b = 1 and f = 1)::bigint as both_ok, count_if(b = 1 and f = 0)::bigint as ok_fail, count_if(b = 0 and f = 1)::bigint as fail_ok, count_if(b = 0 and f = 0)::bigint as both_fail, avg(b) as mb, avg(f) as mf from s group by 1)"""


@query(f"""with {_PAIR_SQL} select benchmark, n, both_ok, ok_fail, fail_ok, both_fail, round(100 * mb, 6) as baseline_acc_pct, round(100 * mf, 6) as final_acc_pct, round(100 * md, 6) as delta_pp,
round((abs(ok_fail - fail_ok) - 1) * (abs(ok_fail - fail_ok) - 1) / (ok_fail + fail_ok)::double, 6) as mcnemar_chi2,
round(100.0::double * (fail_ok - ok_fail) / n - 1.959963984540054::double * 100 * sqrt(ok_fail + fail_ok) / n, 6) as ci_low, round(100.0::double * (fail_ok - ok_fail) / n + 1.959963984540054::double * 100 * sqrt(ok_fail + fail_ok) / n, 6) as ci_high from g""")
def paired_cells(spark, sf_dir):
    m = Z.paired_moments(_pairs(spark, sf_dir), ["benchmark"])
    low, high = S.mcnemar_interval(F.col("ok_fail"), F.col("fail_ok"), F.col("n"))
    return m.select("benchmark", "n", "both_ok", "ok_fail", "fail_ok", "both_fail", *(r6(F.col(c)).alias(c) for c in ("baseline_acc_pct", "final_acc_pct")), r6(100 * F.col("mean_delta")).alias("delta_pp"), r6(S.mcnemar_chi2(F.col("ok_fail"), F.col("fail_ok"))).alias("mcnemar_chi2"), r6(low).alias("ci_low"), r6(high).alias("ci_high"))


@query("""with c as (select user_id, count_if(event_type = 'error')::bigint as b, count_if(event_type = 'purchase')::bigint as c from events group by 1)
select user_id, b, c, round(least(1, 2 * (select sum(exp(lgamma(b + c + 1.0::double) - lgamma(k + 1.0::double) - lgamma(b + c - k + 1.0::double) - (b + c) * ln(2.0::double))) from range(0, 400) z(k) where k <= least(b, c))), 6) as p from c""")
def mcnemar_exact(spark, sf_dir):
    cells = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("b"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    return cells.select("user_id", "b", "c", F.round(S.mcnemar_exact_p(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"with {_PAIR_SQL} select benchmark, n, n - 1 as df, round(md / sem, 6) as t_stat from g")
def paired_ttest(spark, sf_dir):
    return Z.paired_result(_pairs(spark, sf_dir), ["benchmark"]).select("benchmark", "n", F.col("df").cast("bigint").alias("df"), r6(F.col("t_stat")).alias("t_stat"))


def _tail_sql(t: str, df: str, n: int = 4000) -> str:
    """Two-sided p of Student's t by Simpson's rule over the angle."""
    a, h = f"atan(({t}) / sqrt({df}))", f"((pi() / 2 - atan(({t}) / sqrt({df}))) / {n})"
    terms = f"list_sum(list_transform(range(0, {n + 1}), lambda i: (case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end) * pow(greatest(cos({a} + i * {h}), 0::double), {df} - 1)))"
    return f"(2 * exp(lgamma(({df} + 1) / 2.0::double) - lgamma({df} / 2.0::double)) / sqrt(pi()) * {h} / 3 * {terms})"


_NORMAL_SQL = """(1 - sqrt(2 / pi()) * z / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda i: (case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-(i * z / 4000) * (i * z / 4000) / 2))))"""
_EXACT_SQL = "least(1, 2 * (select sum(exp(lgamma(b + c + 1.0::double) - lgamma(k + 1.0::double) - lgamma(b + c - k + 1.0::double) - (b + c) * ln(2.0::double))) from range(0, 100) q(k) where k <= least(b, c)))"


@query(f"""with recursive {_PAIR_SQL}, q as (select benchmark, n - 1.0::double as df, 0.0::double as low, 1000.0::double as high, 0 as turn from g
  union all select benchmark, df, case when {_tail_sql("(low + high) / 2", "df", 1000)} / 2 > 0.025 then (low + high) / 2 else low end, case when {_tail_sql("(low + high) / 2", "df", 1000)} / 2 > 0.025 then high else (low + high) / 2 end, turn + 1 from q where turn < 45),
v as (select g.*, md / sem as t, ok_fail as b, fail_ok as c, (abs(ok_fail - fail_ok) - 1) * (abs(ok_fail - fail_ok) - 1) / (ok_fail + fail_ok)::double as chi2, (low + high) / 2 * sem as half from g join q on q.benchmark = g.benchmark and turn = 45),
w as (select *, sqrt(chi2) as z, case when b + c < {S.EXACT_BELOW} then {_EXACT_SQL} end as exact_p, {_tail_sql("abs(t)", "(n - 1)")} as p from v), x as (select *, case when b + c < {S.EXACT_BELOW} then exact_p else {_NORMAL_SQL} end as mp, 1.959963984540054::double * 100 * sqrt(b + c) / n as reach from w)
select benchmark, n, round(100 * mb, 6) as baseline_acc_pct, round(100 * mf, 6) as final_acc_pct, round(100 * md, 6) as delta_pp, round(100 * (md - half), 6) as ci_low_pp, round(100 * (md + half), 6) as ci_high_pp, round(t, 6) as t_stat, n - 1 as df,
  round(p, 6) as p_value, p < 0.05 as significant, round(chi2, 6) as mcnemar_chi2, round(mp, 6) as mcnemar_p, mp < 0.05 as mcnemar_significant, round(100.0::double * (c - b) / n - reach, 6) as mcnemar_ci_low_pp, round(100.0::double * (c - b) / n + reach, 6) as mcnemar_ci_high_pp,
  b + c between 1 and {S.EXACT_BELOW - 1} as mcnemar_exact, both_ok, ok_fail, fail_ok, both_fail, '' as notes from x""")
def paired_result(spark, sf_dir):
    r = Z.paired_result(_pairs(spark, sf_dir), ["benchmark"])
    return r.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


# ---- geometry --------------------------------------------------------------------------------------------------------

_PROPOSAL = "struct<score:double,box:struct<x1:double,y1:double,x2:double,y2:double>,label:string>"
_BOX_SQL = """b as (select l_orderkey as o, l_linenumber as i, l_partkey as k, l_discount as s, l_quantity::double as x1, l_tax * 100 as y1, l_quantity + 20.0::double as x2, l_tax * 100 + 5 + l_linenumber::double as y2 from lineitem),
pairs as (select a.o, a.i as i, c.i as j, (greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))) as inter, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (c.x2 - c.x1) * (c.y2 - c.y1) as ca from b a join b c on a.o = c.o and (a.i < c.i or a.i = c.i and a.k < c.k))"""


def _proposals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    b = G.box(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_quantity") + 20.0, F.col("l_tax") * 100 + 5 + F.col("l_linenumber"))
    p = F.struct(F.col("l_discount").cast("double").alias("score"), b.alias("box"), F.col("l_linenumber").cast("string").alias("label"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("k"), p.alias("p")))).alias("l")).select("l_orderkey", F.transform("l", lambda x: x["p"]).alias("props"))


@query(f"with {_BOX_SQL} select o as l_orderkey, count(*) as pairs, round(max(inter / (aa + ca - inter)), 6) as best_iou from pairs group by 1")
def iou_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    b = G.box(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_quantity") + 20.0, F.col("l_tax") * 100 + 5 + F.col("l_linenumber"))
    rows = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("i"), b.alias("b"))
    other = rows.select(F.col("l_orderkey").alias("o2"), F.col("i").alias("j"), F.col("b").alias("c"))
    pairs = rows.join(other, (F.col("l_orderkey") == F.col("o2")) & (F.col("i") < F.col("j")))
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), r6(F.max(G.iou(F.col("b"), F.col("c")))).alias("best_iou"))


_RANKED_SQL = """p as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber, l_partkey) as r, {'l': cast(l_linenumber as varchar), 'x1': l_quantity::double, 'y1': l_tax * 100,
  'x2': l_quantity + 20.0::double, 'y2': l_tax * 100 + 5 + l_linenumber::double} as b from lineitem)"""
_INTER = "greatest(0, least(k.x2, p.b.x2) - greatest(k.x1, p.b.x1)) * greatest(0, least(k.y2, p.b.y2) - greatest(k.y1, p.b.y1))"
_AREA_K, _AREA_P = "((k.x2 - k.x1) * (k.y2 - k.y1))", "((p.b.x2 - p.b.x1) * (p.b.y2 - p.b.y1))"


def _greedy_sql(name: str, test: str) -> str:
    """A walk over each order's proposals by score that keeps those for which no kept one passes the test."""
    return f"""{name}(o, r, kept) as (select distinct o, 0::bigint, (select list(b) from p where false) from p union all
  select w.o, w.r + 1, case when len(list_filter(coalesce(w.kept, []), lambda k: {test})) > 0 then w.kept else list_append(coalesce(w.kept, []), p.b) end from {name} w join p on p.o = w.o and p.r = w.r + 1)"""


@query(f"""with recursive {_RANKED_SQL}, {_greedy_sql("walk", f"{_INTER} / ({_AREA_K} + {_AREA_P} - {_INTER}) > 0.5")}
select o as l_orderkey, max(r)::int as n, list_transform(arg_max(kept, r), lambda k: k.l) as kept from walk group by 1""")
def nms_keep(spark, sf_dir):
    p = _proposals(spark, sf_dir)
    kept = G.suppress(F.col("props"), _PROPOSAL, 0.5)
    return p.select("l_orderkey", F.size("props").alias("n"), F.transform(kept, lambda k: k["label"]).alias("kept"))


@query(f"""with recursive {_RANKED_SQL}, {_greedy_sql("walk", f"{_INTER} / {_AREA_P} >= 0.85 and {_AREA_P} < {_AREA_K} and {_AREA_P} / {_AREA_K} <= 0.5")},
{_greedy_sql("nms", f"{_INTER} / ({_AREA_K} + {_AREA_P} - {_INTER}) > 0.95")},
c as (select o, max(r) as n, len(arg_max(kept, r)) as kept from walk group by 1), f as (select o, least(len(arg_max(kept, r)), 3) as final from nms group by 1)
select o as l_orderkey, n::int as n, kept::int as kept, final::int as final from c join f using (o)""")
def containment(spark, sf_dir):
    p = _proposals(spark, sf_dir)
    return p.select("l_orderkey", F.size("props").alias("n"), F.size(G.drop_contained(F.col("props"), _PROPOSAL)).alias("kept"), F.size(G.finish_proposals(F.col("props"), _PROPOSAL, 3)).alias("final"))


@query("""with b as (select l_orderkey, l_linenumber, l_partkey, l_quantity - 5.0::double as x1, l_tax * 1000 as y1, l_quantity + 12.0::double as x2, l_tax * 1000 + 3 as y2 from lineitem),
c as (select *, greatest(0, least(x1, 39)) as a1, greatest(0, least(y1, 29)) as c1 from b)
select l_orderkey, l_linenumber, l_partkey, round(a1 * 336 / 40, 6) as x1, round(c1 * 336 / 30, 6) as y1, round(greatest(a1 + 1, least(x2, 40)) * 336 / 40, 6) as x2, round(greatest(c1 + 1, least(y2, 30)) * 336 / 30, 6) as y2 from c""")
def box_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    b = G.clamp_scale(G.box(F.col("l_quantity") - 5.0, F.col("l_tax") * 1000, F.col("l_quantity") + 12.0, F.col("l_tax") * 1000 + 3), F.lit(40.0), F.lit(30.0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", b.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", *(r6(F.col(f"b.{c}")).alias(c) for c in G.CORNERS))


# ---- training logs and sampling --------------------------------------------------------------------------------------


@query("""with recursive o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r from events),
s as (select user_id, r, value::double as ema from o where r = 1 union all select o.user_id, o.r, s.ema * 0.98::double + o.value * 0.02::double from s join o on o.user_id = s.user_id and o.r = s.r + 1)
select user_id, max(r) as n, round(arg_max(ema, r), 6) as ema from s group by 1""")
def ema_by_user(spark, sf_dir):
    return R.ema_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "n", r6(F.col("ema")).alias("ema"))


@query("""with recursive o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r from events),
s as (select user_id, r, value::double as ema, value::double as best, 0 as stale from o where r = 1
 union all select user_id, r, ema, case when best - ema > 0.001 then ema else best end, case when best - ema > 0.001 then 0 else stale + 1 end from (
   select o.user_id, o.r, s.ema * 0.98::double + o.value * (1 - 0.98::double) as ema, s.best, s.stale from s join o on o.user_id = s.user_id and o.r = s.r + 1 where s.stale < 5) x)
select user_id, round(arg_max(best, r), 6) as best, cast(arg_max(stale, r) as bigint) as stale, cast(max(r) as bigint) as seen from s group by 1""")
def early_stop(spark, sf_dir):
    s = R.early_stop_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return s.select("user_id", r6(F.col("best")).alias("best"), F.col("stale").cast("bigint").alias("stale"), F.col("seen").cast("bigint").alias("seen"))


@query("""select user_id, step, n, round(loss, 6) as loss from (select user_id, (r - 1) // 16 as step, count(*) as n, avg(value) as loss from (select user_id, value, row_number() over (partition by user_id order by event_id) as r from events) s group by 1, 2) g where n = 16""")
def grad_accum(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return R.accumulate(e, "i", "value", 16, ["user_id"], keep_tail=False).select("user_id", F.col("step").cast("bigint").alias("step"), "n", r6(F.col("loss")).alias("loss"))


@query("""with n as (select count(*) as n, floor((count(*) + 15) // 16 * 4 * 0.03::double) as warm, (count(*) + 15) // 16 * 4 as total from documents)
select doc_id, round(2e-4::double * case when doc_id < warm then doc_id / greatest(1, warm)::double else greatest(0, 0.5::double * (1 + cos(pi() * (doc_id - warm) / greatest(1, total - warm)::double))) end, 12) as lr from documents, n where doc_id <= total""")
def lr_schedule(spark, sf_dir):
    """The rate at each step of four epochs over the documents, 16 micro-batches a step; a document's id is its step."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    total, warm = S.optimiser_steps(d.count(), 16, 4, 0.03)
    return d.where(F.col("doc_id") <= total).select("doc_id", F.round(S.cosine_rate(F.col("doc_id"), total, warm, 2e-4), 12).alias("lr"))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r from events) s where r % 10 = 0")
def log_every_n(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return R.every_n(e, "r", 10).select("user_id", "event_id")


@query("select doc_id from documents order by (doc_id * 2654435761 + 42) % 4294967296, doc_id limit 50")
def hash_sample(spark, sf_dir):
    return M.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


def _hashed_sql(x: str, seed: int) -> str:
    """``order.hashed`` in integer arithmetic."""
    from ..functions.order import FACTOR, PRIME

    sql = f"(({x} + {(seed * 7919 + 12345) % PRIME}) % {PRIME})"
    for turn in (1, 2):
        sql = f"((({sql} * {sql}) % {PRIME} * {FACTOR} + {sql} + {turn * 1000003}) % {PRIME})"
    return sql


@query(f"""with c as (select source, count(*) as n, count(*) * case source when 'src0' then 0.5::double when 'src1' then 0.3::double else 0.1::double end as w from documents group by 1),
b as (select *, sum(w) over (order by source) as hi, sum(w) over () as total from c),
d as (select range as draw, {_hashed_sql("range", 84)} / 2147483647.0::double as u, {_hashed_sql("range", 85)} / 2147483647.0::double as v from range(0, 1000)),
k as (select draw, source, cast(floor(v * n) as bigint) as k from d join b on u * total >= hi - w and u * total < hi),
p as (select doc_id, source, row_number() over (partition by source order by (doc_id * 2654435761 + 42) % 4294967296) - 1 as k from documents)
select draw, source, doc_id from k join p using (source, k)""")
def weighted_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return M.weighted_draws(d, "source", "doc_id", 1000, {"src0": 0.5, "src1": 0.3}).select("draw", "source", "doc_id")


@query("""with f as (select source as family, count(*) as n from documents group by 1), b as (select count(*) as f, (select count(*) from documents) // 64 as batches from f)
select 'all' as scope, batches, batches * 64 as rows, 64 // f as least, 64 // f + case when 64 % f > 0 then 1 else 0 end as most from b""")
def balanced_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    drawn = M.balanced_batches(d, "source", "doc_id", 64)
    q = drawn.groupBy("batch", "family").count()
    return q.agg(F.countDistinct("batch").alias("batches"), F.sum("count").alias("rows"), F.min("count").alias("least"), F.max("count").alias("most")).select(F.lit("all").alias("scope"), "batches", "rows", "least", "most")


# ---- streaming (an extension) ----------------------------------------------------------------------------------------


@query("select event_id, user_id, event_type from events")
def stream_dedup(spark, sf_dir):
    rows = streams.stream_table(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    return streams.drain(streams.unseen(rows, "event_id", late="3650 days").drop("ts"), spark)


from . import formats  # noqa: E402, F401, I001  registers its queries
from . import documents  # noqa: E402, F401
