"""Queries over documents and logs that Spark writes from the driver's tables and reads back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import batches as B
from ..operators import decontam as D
from ..operators import evaluate as E
from ..operators import sampling as M
from ..operators.proposals import merge_tag_proposals
from ..sources import annotations as A
from ..sources import files as L
from ..sources import hash_cache as H
from ..sources.json_elements import parsed, read_elements
from ..sources.shared import scratch, settled
from ..streaming import runs as streams
from .catalog import _AREA_K, _AREA_P, _HASH_SQL, _INTER, ORACLE, _greedy_sql, _matches, _neighbours, _split, query, r6, table
from .formats import _LINES_SQL, _area  # its queries are registered first

#: Smaller than the default, so that a document of some MB is several ranges.
CHUNK = 2 << 20


@query(f"with {_LINES_SQL} select o as image_id, n::bigint as n, area from boxes")
def coco_document_boxes(spark, sf_dir):
    """One instances document of all orders and lines, written as one file and read by ranges of bytes."""
    li, path = table(spark, sf_dir, "lineitem"), f"{scratch(spark, 'instances')}/instances.json"
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(60).alias("width"), F.lit(40).alias("height"), F.concat(F.col("o_orderkey").cast("string"), F.lit('"}],{.jpg')).alias("file_name"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    bbox = F.array(F.lit(1.0), F.lit(2.0), F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 200)
    notes = li.select(*order, F.col("l_orderkey").alias("image_id"), F.lit(1).alias("category_id"), bbox.alias("bbox"))
    L.write_json_object({"images": (images, ["id"]), "annotations": (notes, order, ["image_id", "category_id", "bbox"]), "categories": (images.where("id < 0"), ["id"])}, path)
    read = L.read_members(spark, path, {"images": A.COCO_IMAGE, "annotations": A.COCO_ANNOTATION}, chunk=CHUNK)
    b = A.boxes_of(read["images"], read["annotations"], most=3)
    return b.select("image_id", F.size("boxes").cast("bigint").alias("n"), _area(F.col("boxes")).alias("area"))


@query("select cast(o_orderkey as varchar) as question_id, o_orderpriority || ' \"{' || chr(92) || ',' as question, case when o_orderkey % 2 = 0 then 'yes' else 'no' end as answer from orders")
def keyed_document_rows(spark, sf_dir):
    """One object of all orders by key, written as one file and read by ranges of bytes."""
    o, path = table(spark, sf_dir, "orders"), f"{scratch(spark, 'questions')}/questions.json"
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("i").alias("imageId"), F.concat("o_orderpriority", F.lit(' "{\\,')).alias("question"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("answer"))
    L.write_keyed_object(rows, "id", path)
    found = L.read_keyed_object(spark, path, A.GQA_QUESTION, chunk=CHUNK)
    return found.select(F.col("id").alias("question_id"), "value.question", "value.answer")


# ---- proposals by row ------------------------------------------------------------------------------------------------

_TAGGED_SQL = """t as (select l_suppkey as o, l_returnflag || l_linenumber as tag, l_extendedprice::double as s, l_orderkey as a, l_linenumber as i, l_partkey as k, l_quantity::double as x1, l_linenumber * 5.0::double as y1,
  l_quantity + 20.0::double as x2, l_linenumber * 5 + 10.0::double + round(l_discount * 100) as y2 from lineitem where l_suppkey % 7 <> 0),
p as (select o, row_number() over (partition by o order by s desc, a, i, k) as r, {'l': tag, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} as b
  from (select *, row_number() over (partition by o, tag order by s desc, a, i, k) as n from t) z where n <= 4)"""


@query(f"""with recursive {_TAGGED_SQL}, {_greedy_sql("walk", f"{_INTER} / ({_AREA_K} + {_AREA_P} - {_INTER}) > 0.3")}
select s_suppkey as image_id, coalesce(list_transform(kept[1:10], lambda k: k.l), ['[fallback: whole image]']) as labels from supplier left join (select o, arg_max(kept, r) as kept from walk group by 1) w on o = s_suppkey""")
def tag_proposals(spark, sf_dir):
    """A supplier is an image, flags and line numbers are tags, lines are boxes; every seventh image has nothing found."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 0")
    q, y = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 5.0
    found = li.select(F.col("l_suppkey").alias("image_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("tag"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"), F.col("l_extendedprice").cast("double").alias("score"), G.box(q, y, q + 20.0, y + 10.0 + F.round(F.col("l_discount").cast("double") * 100)).alias("box"), F.lit("").alias("phrase"))
    merged = merge_tag_proposals(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")), found, per_tag=4, most=10, limit=0.3)
    return merged.select("image_id", F.transform("proposals", lambda p: p["label"]).alias("labels"))


# ---- seeded order, batches -------------------------------------------------------------------------------------------


def _pass_sql(source: str, key: int) -> str:
    """One pass of the keyed permutation in integer arithmetic; source has place, x and the scalars r (rows), c (columns)."""
    m, f, base = M.FEISTEL_PRIME, M.FEISTEL_FACTOR, (key * 1_000_003 + 12_345) % M.FEISTEL_PRIME
    sql = f"select place, n, r, c, x // c as h, x % c as l from {source}"
    for turn in range(M.FEISTEL_ROUNDS):
        half, other, size = ("l", "h", "r") if turn % 2 == 0 else ("h", "l", "c")
        v = f"(({half} + {(turn * 7919 + base) % m}) % {m})"
        sql = f"select place, n, r, c, {half}, ({other} + (({v} * {v}) % {m} * {f} + {half}) % {m}) % {size} as {other} from ({sql}) q{turn}"
    return f"select place, n, r, c, h * c + l as x from ({sql}) e"


@query(f"""with recursive z as (select count(*) as n, cast(floor(sqrt(count(*) - 1)) as bigint) + 1 as c from documents), y as (select n, c, (n + c - 1) // c as r from z),
w as (select * from ({_pass_sql("(select range as place, n, r, c, range as x from y, range(0, (select n from z)))", 42 * 31 + 1009)}) a union all select * from ({_pass_sql("(select * from w where x >= n)", 42 * 31 + 1009)}) b)
select place, x as doc_id, n_chars from w join documents on doc_id = x where x < n and place >= 100""")
def epoch_order(spark, sf_dir):
    """What a run that stopped after 100 documents of its second epoch has still to read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return M.epoch_slice(spark, d.count(), start=100, epoch=1).join(d, F.col("item") == F.col("doc_id")).select("place", "doc_id", "n_chars")


@query("""with l as (select doc_id, len(string_split(trim(coalesce(text, '')), ' ')) as n from documents), b as (select *, case when n <= 64 then 64 when n <= 256 then 256 when n <= 1024 then 1024 else cast(ceil(n / 1024.0) * 1024 as int) end as bucket from l),
p as (select *, (row_number() over (partition by bucket order by (doc_id * 2654435761 + 42) % 4294967296) - 1) // 32 as batch from b)
select bucket, batch, count(*) as n, cast(sum(bucket - n) as bigint) as pads, cast(sum(n) as bigint) as ones, list(doc_id order by (doc_id * 2654435761 + 42) % 4294967296) as keys from p where batch < 20 group by 1, 2""")
def length_batches(spark, sf_dir):
    words = F.transform(F.split(F.trim(F.coalesce("text", F.lit(""))), " "), F.length)
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    batches = B.collate(B.first_batches(B.ragged_batches(rows, "doc_id", "words", 32, edges=(64, 256, 1024), pad=-1), 20), "doc_id", "words")
    pads = F.aggregate("padded", F.lit(0).cast("bigint"), lambda s, p: s + F.size(F.filter(p, lambda x: x == -1)))
    ones = F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, m: s + F.size(F.filter(m, lambda x: x == 1)))
    return batches.select("bucket", "batch", F.size("keys").cast("bigint").alias("n"), pads.alias("pads"), ones.alias("ones"), "keys")


@query("""with e as (select vec_id, vec_id // 128 as batch, list_transform(embedding, lambda x: x::double) as a, list_transform(embedding, lambda x, i: case when i % 2 = 0 then x::double else x::double / 2 end) as b from embeddings),
u as (select vec_id, batch, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) as a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) as b from e),
l as (select p.vec_id, list_dot_product(p.a, p.b) / 0.07::double as own, ln(sum(exp(list_dot_product(p.a, q.b) / 0.07::double))) as lse from u p join u q on p.batch = q.batch group by 1, 2)
select vec_id, round(own, 6) as logit, round(lse - own, 6) as loss from l""")
def contrastive_loss(spark, sf_dir):
    """An embedding and its image with every other component halved are a pair; 128 rows are a batch."""
    e = table(spark, sf_dir, "embeddings")
    halved = F.transform("embedding", lambda x, i: F.when(i % 2 == 1, x.cast("double")).otherwise(x.cast("double") / 2))
    pairs = e.select("vec_id", F.floor(F.col("vec_id") / 128).alias("batch"), "embedding", halved.alias("other"))
    return B.contrastive_losses(pairs, "batch", "vec_id", "embedding", "other").select("vec_id", r6(F.col("logit")).alias("logit"), r6(F.col("loss")).alias("loss"))


@query("""with g as (select vec_id // 8 as g, vec_id % 3 <> 0 as m, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
s as (select g, i, coalesce(avg(x) filter (m), 0) as x from g group by 1, 2) select g, list(round(x, 6) order by i) as mean from s group by 1""")
def masked_means(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    mean = B.masked_mean(F.transform("v", lambda x: x["embedding"]), F.transform("v", lambda x: F.when(x["vec_id"] % 3 != 0, 1).otherwise(0)))
    return e.select("g", F.transform(mean, r6).alias("mean"))


# ---- caches and streams ----------------------------------------------------------------------------------------------


@query("""select 1 as round, count(*) as files, count(*) as computed, count_if(n_chars < 300)::bigint as corrupt from documents where doc_id % 3 <> 0
union all select 2, count(*), count_if(doc_id % 3 = 0)::bigint, count_if(n_chars < 300)::bigint from documents""")
def hash_cache_counts(spark, sf_dir):
    """Documents stand for image files, short ones for files that cannot be decoded; the second round brings new ones."""
    docs, cache = table(spark, sf_dir, "documents"), scratch(spark, "hashes")
    listed = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"), F.lit(0).alias("modified"), "doc_id")
    texts = docs.where("n_chars >= 300").select(F.col("doc_id").cast("string").alias("path"), F.array(F.xxhash64("text")).alias("hash"))
    rounds = []
    for i, part in enumerate((listed.where("doc_id % 3 <> 0"), listed), 1):
        found = H.refresh(part, cache, lambda new: texts.join(new.select("path"), "path", "left_semi"))
        rounds.append(found.agg(F.count(F.lit(1)).alias("files"), F.count_if("fresh").alias("computed"), F.count_if(F.col("hash").isNull()).alias("corrupt")).select(F.lit(i).alias("round"), "files", "computed", "corrupt"))
        rounds[-1] = settled(rounds[-1], "hash-round")
    return rounds[0].unionByName(rounds[1])


@query(f"select * from ({ORACLE['ema_by_user']}) e join ({ORACLE['early_stop']}) s using (user_id)")
def streamed_runs(spark, sf_dir):
    """Events in four sets of files, read as a stream in two queries of one checkpoint: the second goes on where the first has stopped."""
    home = scratch(spark, "runs")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first, last = e.select(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    late = F.unix_micros("ts") > F.lit(None if first is None else (first + last) // 2)
    # The halves lie within one delay of the watermark, so nothing is dropped; the first half is settled during the second.
    delay = f"{0 if first is None else (last - first) // 2_000_000 + 86_400} seconds"
    for half, rows in enumerate((e.where(~late | F.col("ts").isNull()), e.where(late))):
        files = 1
        for k in (0, 1):  # out of order between the sets of a half
            rows.where(F.coalesce(F.pmod("event_id", F.lit(2)), F.lit(0)) == k).write.parquet(f"{home}/in/{half}{k}")
            files = max(files, len(spark.read.parquet(f"{home}/in/{half}{k}").inputFiles()))
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/in/*")
        streams.run_stream(streams.fold_stream(source, "user_id", "ts", "event_id", "value", late=delay), f"{home}/out", f"{home}/state")
    return streams.latest(spark, f"{home}/out", "user_id").select("user_id", "n", r6(F.col("ema")).alias("ema"), r6(F.col("best")).alias("best"), "stale", "seen")


# ---- documents of other layouts --------------------------------------------------------------------------------------

_WORDS3 = "array_to_string(string_split(text, ' ')[1:3], ' ')"


@query(f"""select conv_id || '/' || turn as id, case when turn % 2 = 0 then '{X.PERSON_NAMES[0]} said ' || {_WORDS3} else 'Is {X.PERSON_NAMES[0]} near dog?' end as question,
  case turn % 3 when 0 then 'dog barks ' || role when 1 then role || ' dog' else role end as answer, 10.0::double + turn as x2 from conversations""")
def vcr_document_rows(spark, sf_dir):
    """A conversation is a document, its turns are questions, in three layouts; boxes lie as many objects deep as the turn's number and twelve."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    ids = F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    first = F.slice(F.split("text", " "), 1, 3)
    words = F.to_json(first)
    tokens = F.concat(F.lit('[[0],"said",'), F.substring(words, F.lit(2), F.length(words)))
    named = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    question = F.when(turn % 2 == 0, named("question", tokens)).otherwise(F.lit('"question_orig":"Is 1 near 2?","question":"other"'))
    answer = F.when(turn % 3 == 0, F.concat(F.lit('"answer_choices":[["no"],[[1],"barks",'), quoted(F.col("role")), F.lit(']],"answer_label":1'))).when(turn % 3 == 1, named("answer_orig", quoted(F.concat("role", F.lit(" 2"))))).otherwise(named("answer", quoted(F.col("role"))))
    deep = (turn + 12).cast("int")
    box = F.concat(F.repeat(F.lit('{"bbox":{"box":'), deep), F.concat(F.lit("[1,2,"), (turn + 10).cast("string"), F.lit(",9,0.5]")), F.repeat(F.lit("}}"), deep))
    id_name = F.when(turn % 3 == 0, F.lit("annot_id")).when(turn % 3 == 1, F.lit("qid")).otherwise(F.lit("id"))
    row = F.concat(F.lit('{"'), id_name, F.lit('":'), quoted(ids), F.lit(',"img_fn":"a.jpg","metadata_fn":"m","objects":["person","Dog"],'), question, F.lit(","), answer, F.lit(',"region":'), box, F.lit("}"))
    rows = c.select("conv_id", "turn", row.alias("r")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]).alias("l"))
    listed = F.concat(F.lit("["), F.array_join("l", ","), F.lit("]"))
    members = F.concat(F.lit("{"), F.array_join(F.transform("l", lambda r, i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":'), r)), ","), F.lit("}"))
    k = F.col("conv_id") % 3
    text = rows.select(F.when(k == 0, listed).when(k == 1, F.concat(F.lit('{"info":1,"questions":'), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"data":'), members, F.lit("}"))).alias("value"))
    documents = A.vcr_documents(text)
    found = A.vcr_rows(documents).select("id", A.vcr_question().alias("question"), A.vcr_answer().alias("answer"))
    boxes = documents.select(F.parse_json("value").alias("v")).select(F.coalesce(*(F.try_variant_get("v", f"$.{n}", "string") for n in ("annot_id", "qid", "id"))).alias("id"), A.bbox_of(F.try_variant_get("v", "$.region", "variant"))["x2"].alias("x2"))
    return found.join(boxes, "id")


@query("""select 'q' || o_orderkey as question_id, case when o_custkey % 2 = 1 and o_orderkey % 5 = 0 then null else o_orderkey || '.jpg' end as filename, coalesce(o_orderpriority, '') as answer from orders where o_custkey % 2 = 1 or o_orderkey % 3 <> 0""")
def visual7w_document_rows(spark, sf_dir):
    """A customer's orders are one document: flat for every other customer, where pairs name their image and every fifth is not
    listed, else nested, where an image holds its pairs and every third image is of another split."""
    o, key, none = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    qa = "struct<qa_id:string,question_id:string,id:string,type:string,qa_type:string,answer:string,box_xywh:array<double>,question:string,qp:string,multiple_choice_answer:string,image_id:string,image_path:string>"
    img = f"struct<split:string,filename:string,image_path:string,width:double,height:double,image_id:string,qa_pairs:array<{qa}>>"
    flat = F.col("o_custkey") % 2 == 1
    pair = F.struct(F.concat(F.lit("q"), key), none, none, F.lit("which"), none, F.col("o_orderpriority"), F.lit(None).cast("array<double>"), F.lit("?"), none, none, key, none).cast(qa)
    split = F.when(~flat & (F.col("o_orderkey") % 3 == 0), F.lit("val")).otherwise(F.lit("train"))
    image = F.struct(split, F.concat(key, F.lit(".jpg")), none, F.lit(60.0), F.lit(40.0), key, F.when(~flat, F.array(pair))).cast(img)
    listed = F.when(~flat | (F.col("o_orderkey") % 5 != 0), image)
    documents = o.groupBy("o_custkey").agg(F.collect_list(listed).alias("images"), F.collect_list(F.when(flat, pair)).alias("train"))
    found = A.visual7w_pairs(documents)
    return found.select(F.col("qa.qa_id").alias("question_id"), F.col("img.filename").alias("filename"), F.col("qa.answer").alias("answer"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 4 = 3 then 1 else 2 end as n, case l_linenumber % 4 when 0 then l_quantity::double + 1 when 1 then l_quantity::double + 2 when 2 then 3 + l_quantity::double else 4 + l_quantity::double end as x2 from lineitem""")
def metadata_box_rows(spark, sf_dir):
    """Boxes as lists or in objects; where none parses, regions by corners or by place and size."""
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("double").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    k = F.col("l_linenumber") % 4
    plus = lambda n: (F.col("l_quantity").cast("double") + n).cast("string")
    boxes = F.when(k == 0, text("[[0,0,", plus(1), ',5,0.9],"x",{"bbox":{"box":[0,0,1,1]}},[5,5,1,1]]')).when(k == 1, text('[{"box":[0,0,', plus(2), ',5]},[1,2,3,4]]')).otherwise(F.lit('["none",[1,2]]'))
    regions = F.when(k == 2, text('[{"bbox":[0,0,', plus(3), ',9]},{"box":[1,1,0,5]},{"box":[1,1,2,2]}]')).when(k == 3, text('[{"bbox_xywh":[4,1,', q, ',2]},{"bbox":[9,9,1,1]}]')).otherwise(F.lit('[{"bbox":[0,0,1,1]}]'))
    lists = [F.try_variant_get(F.parse_json(c), "$", "array<variant>") for c in (boxes, regions)]
    found = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.metadata_boxes(*lists).alias("b"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("b").alias("n"), F.col("b")[0]["x2"].alias("x2"))


@query("""with v as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i from lineitem),
g as (select *, row_number() over (partition by l_orderkey order by ((l_orderkey * 1000 + i) * 2654435761 + 42) % 4294967296, i) as r from v),
u as (select 0 as stage, 'refcoco' as source, l_quantity::double as w from lineitem where l_quantity >= 10 union all select 1, 'visual_genome', l_quantity::double from g where r <= 3 and l_quantity >= 10 and l_linenumber % 3 <> 0)
select stage, source, count(*) as n, round(sum(w), 4) as width from u group by 1, 2""")
def curriculum_regions(spark, sf_dir):
    """Referring expressions first, then at most three sampled regions of each image, filtered after the sample."""
    li, order = table(spark, sf_dir, "lineitem"), ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    refs = li.select(F.col("l_orderkey").alias("ordinal"), F.col("l_orderkey").cast("string").alias("image_path"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity").cast("double"), F.lit(30.0)).alias("bbox"), F.array(F.lit("left dog")).alias("sentences"), F.lit("train").alias("split"))
    region = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").cast("double").alias("width"), F.lit(20.0).alias("height"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(" a ")).otherwise(F.lit("red dog")).alias("phrase"))
    images = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, region.alias("r")))).alias("l")).select(F.col("l_orderkey").alias("ordinal"), F.col("l_orderkey").alias("id"), F.transform("l", lambda x: x["r"]).alias("regions"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("stem"), F.lit("/i").alias("path"))
    rows = A.curriculum([("words", [A.refcoco_regions(refs)]), ("regions", [A.genome_regions(images, files, per_image=3)])])
    return rows.groupBy("stage", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("box.x2"), 4).alias("width"))


@query("select doc_id, source from documents where n_chars % 100 >= 30 and source <> 'src1' order by doc_id limit 150")
def grit_head_rows(spark, sf_dir):
    """The first 150 captions (the operator's own limit) that are close to their image and name something."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", ((F.col("n_chars") % 100) / 100).alias("clip_similarity_vitl14"), F.when(F.col("source") == "src1", F.array().cast("array<string>")).otherwise(F.array("source")).alias("noun_chunks"))
    return A.grit_rows(rows, 150, "doc_id").select("doc_id", "source")


@query("select key, row_number() over (order by key) as place from (select distinct 'metric_' || (c_custkey % 120) as key from customer) k")
def metric_key_order(spark, sf_dir):
    """Metric keys in text order, as their report lists them: 10 before 2."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("metric_"), (F.col("c_custkey") % 120).cast("string")).alias("key")).distinct()
    return E.text_order(keys, "key").select("key", F.col("place").cast("bigint").alias("place"))


# ---- files written and read back -------------------------------------------------------------------------------------


@query(ORACLE["submission_rows"])
def submission_file_rows(spark, sf_dir):
    """The submission as one JSON array in id order, written by ranges and read back by ranges of bytes."""
    from .formats import submission_rows

    path = scratch(spark, "submission")
    L.write_json_array(submission_rows(spark, sf_dir), "question_id", path)
    found = read_elements(spark, f"{path}/part-00000.json", chunk=CHUNK)
    order = Window.partitionBy(F.spark_partition_id()).orderBy("offset")
    rows = parsed(found, "question_id bigint, answer string").select("offset", "value.*")
    # Ids rise along the file: a row that does not exceed the one before it in its range would get no id.
    rising = F.coalesce(F.col("question_id") > F.lag("question_id").over(order), F.lit(True))
    return rows.withColumn("ok", rising).select(F.when(F.col("ok"), F.col("question_id")).alias("question_id"), "answer")


@query(f"""with {_HASH_SQL}, m as (select train_id, count(*) as n, min(distance) as least from matches group by 1), b as (select train_id, ref_id as best, round(similarity, 6) as similarity from knn where rank = 1)
select train_id, coalesce(n, 0) as n, cast(least as bigint) as least, best, similarity, train_id % 10 = 0 as corrupt from t left join m using (train_id) left join b using (train_id)""")
def decontamination_log_file(spark, sf_dir):
    """The nested log of all training rows as one JSON object by id, written by ranges and read back by ranges of bytes."""
    path = f"{scratch(spark, 'nested-log')}/log.json"
    t, _ = _split(spark, sf_dir)
    log = D.decontamination_log(_matches(spark, sf_dir), _neighbours(spark, sf_dir), t.where("train_id % 10 = 0"))
    L.write_keyed_object(log.withColumn("key", F.col("train_id").cast("string")), "key", path)
    back = L.read_keyed_object(spark, path, "train_id bigint, hash_matches array<struct<ref_id:bigint,distance:int>>, neighbours array<struct<rank:int,ref_id:bigint,similarity:double>>, corrupt boolean", chunk=CHUNK).select("id", "value.*")
    matches, best = F.coalesce("hash_matches", F.array().cast("array<struct<ref_id:bigint,distance:int>>")), F.get("neighbours", F.lit(0))
    return back.select(
        F.col("id").cast("bigint").alias("train_id"), F.size(matches).cast("bigint").alias("n"), F.array_min(F.transform(matches, lambda x: x["distance"])).cast("bigint").alias("least"), best["ref_id"].alias("best"),
        r6(best["similarity"]).alias("similarity"), F.coalesce("corrupt", F.lit(False)).alias("corrupt"),
    )


@query("select p_partkey, p_name || chr(9) || '\"' || p_type || chr(10) || ' x ' as said, case when p_size % 3 = 0 then null else p_brand end as brand from part")
def tsv_rows(spark, sf_dir):
    """Fields with tabs, quotes, line feeds and blanks at their ends, as a TSV file and back."""
    path = scratch(spark, "tsv")
    p = table(spark, sf_dir, "part")
    L.write_csv(p.select("p_partkey", F.concat("p_name", F.lit('\t"'), "p_type", F.lit("\n x ")).alias("said"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand")), path, sep="\t")
    return L.read_tsv(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "said", "brand")


@query("select doc_id, coalesce(octet_length(encode(text)), 0) as n_bytes, md5(coalesce(text, '')) as digest from documents")
def decoded_images(spark, sf_dir):
    """Texts stand for image bytes: base64 with and without padding and a data prefix."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    packed = F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "utf-8")), r"[\r\n]", "")
    raw = F.when(k == 0, packed).when(k == 1, F.concat(F.lit("data:image/png;base64,"), packed)).otherwise(F.regexp_replace(packed, "=+$", ""))
    image = L.decode_image(raw)
    return d.select("doc_id", F.coalesce(F.octet_length(image), F.lit(0)).cast("bigint").alias("n_bytes"), F.md5(image).alias("digest"))


@query(f"with {_HASH_SQL} select train_id as train_idx, 'r' || ref_id as reference_image, cast(distance as bigint) as hamming_distance from matches where distance <= 20")
def audit_file_rows(spark, sf_dir):
    """An audit of matches as a CSV file of the pool's layout, and back."""
    path = scratch(spark, "audit")
    m = _matches(spark, sf_dir).where("distance <= 20").select(F.col("train_id").alias("train_idx"), F.concat(F.lit("r"), F.col("ref_id").cast("string")).alias("reference_image"), F.col("distance").alias("hamming_distance"))
    L.write_audit(m, path, L.POOL_AUDIT)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("train_idx").cast("bigint").alias("train_idx"), "reference_image", F.col("hamming_distance").cast("bigint").alias("hamming_distance"))


@query("select count(*) as total, count(distinct source) as sources, max(n_chars) as longest from documents")
def summary_file(spark, sf_dir):
    """A summary as one JSON document, found as the first of the places that hold one, and read back."""
    path, d = scratch(spark, "summary"), table(spark, sf_dir, "documents")
    L.write_document(d.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("source").alias("sources"), F.max("n_chars").alias("longest")), path)
    return L.read_json_document(spark, path, "total bigint, sources bigint, longest bigint", missing_ok=False)


@query("select c_custkey, c_nationkey from customer where c_acctbal > 9000")
def local_first_rows(spark, sf_dir):
    """Of several places for a table the first that is there is read."""
    path = scratch(spark, "local")
    table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", "c_nationkey").write.parquet(f"{path}/second")
    table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.parquet(f"{path}/third")
    return L.local_or_none(spark, [f"{path}/first", f"{path}/second", f"{path}/third"])
