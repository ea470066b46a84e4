"""Annotation formats -> question samples and region samples.

Sample: source_order, ordinal, image, boxes, question, answer, source, question_id, image_id, format_prompt.
Region: ordinal, image, box, description, source.  ``ordinal`` is the place in the file: it decides every "first".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.order import arithmetic_rank

# Prompts and the order of the pool's sources.
PROMPT = "Answer the question using a single word or phrase."
MCQ_PROMPT = "Answer with the best option letter (A, B, C, or D) only."
MOST_BOXES, LEAST_SIDE = 20, 10.0
#: Order of the pool's sources; with the ordinal it makes the training index.
SOURCES = ("gqa", "visual7w", "vqav2", "vcr", "aokvqa")
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"

COCO_SCHEMA = "images array<struct<id:bigint,width:int,height:int,file_name:string>>, annotations array<struct<image_id:bigint,category_id:int,bbox:array<double>>>, categories array<struct<id:int,name:string>>"
GQA_QUESTION = "imageId string, question string, answer string, types struct<semantic:string>, width double, height double"
SCENE_GRAPH = "width double, height double, objects map<string,struct<x:double,y:double,w:double,h:double>>"
VQA_QUESTIONS = "questions array<struct<question_id:bigint,image_id:bigint,question:string>>"
VQA_ANNOTATIONS = "annotations array<struct<question_id:bigint,image_id:bigint,answers:array<struct<answer:string>>>>"


def sample(image: Column, boxes: Column, question: Column, answer: Column, source: str, question_id: Column, image_id: Column, ordinal: Column, prompt: str = PROMPT) -> list[Column]:
    return [
        F.lit(SOURCES.index(source)).alias("source_order"), ordinal.cast("bigint").alias("ordinal"), image.alias("image"), boxes.alias("boxes"), X.strip(question).alias("question"),
        X.strip(answer).alias("answer"), F.lit(source).alias("source"), question_id.cast("string").alias("question_id"), image_id.cast("string").alias("image_id"), F.lit(prompt).alias("format_prompt"),
    ]


# Members of an instances document, for ``files.read_member``.
COCO_IMAGE = "id bigint, width int, height int, file_name string"
COCO_ANNOTATION = "image_id bigint, category_id int, bbox array<double>"


def boxes_of(images: DataFrame, annotations: DataFrame, least: float = LEAST_SIDE, most: int | None = MOST_BOXES) -> DataFrame:
    """image_id, boxes, width, height, file_name from rows of images and of annotations (with ``pos``, their place in the file)."""
    images = images.select(F.col("id").alias("image_id"), "width", "height", "file_name")
    b = F.col("bbox")
    fine = annotations.where(G.big_enough(b[2], b[3], least))
    found = fine.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", G.from_xywh(b[0], b[1], b[2], b[3]).alias("b")))).alias("l"))
    boxes = F.coalesce(F.transform("l", lambda x: x["b"]), F.array().cast(f"array<{BOX}>"))
    full = F.when(F.size(boxes) == 0, G.full_frame(F.col("width"), F.col("height"))).otherwise(G.cap_boxes(boxes, most))
    return images.join(found, "image_id", "left").select("image_id", full.alias("boxes"), "width", "height", "file_name")


def coco_boxes(document: DataFrame, least: float = LEAST_SIDE, most: int | None = MOST_BOXES, with_name: bool = True) -> DataFrame:
    """image_id, boxes, width, height (and file_name): boxes in annotation order, capped; none -> the full frame."""
    images = document.select(F.explode("images").alias("i")).select("i.*")
    annotations = document.select(F.posexplode("annotations").alias("pos", "a")).select("pos", "a.*")
    out = boxes_of(images, annotations, least, most)
    return out if with_name else out.drop("file_name")


def gqa_samples(questions: DataFrame, graphs: DataFrame, files: DataFrame, excluded: DataFrame, least: float = LEAST_SIDE, most: int = MOST_BOXES) -> DataFrame:
    """questions, graphs: (id, value); files: (stem, path); excluded: (id)."""
    q = questions.join(excluded.select("id"), "id", "left_anti").select("id", "value.*")
    g = graphs.select(F.col("id").alias("imageId"), F.struct("value.*").alias("g"))
    w, h = F.coalesce(F.col("g.width"), F.col("width"), F.lit(0.0)), F.coalesce(F.col("g.height"), F.col("height"), F.lit(0.0))
    objects = F.filter(F.map_values(F.coalesce(F.col("g.objects"), F.create_map().cast("map<string,struct<x:double,y:double,w:double,h:double>>"))), lambda o: (o["w"] > 0) & (o["h"] > 0))
    boxes = F.transform(objects, lambda o: G.to_pixels(o["x"], o["y"], o["w"], o["h"], w, h, need_size=False))
    boxes = F.filter(boxes, lambda b: G.big_enough(b["x2"] - b["x1"], b["y2"] - b["y1"], least))
    joined = q.join(g, "imageId", "left").join(files.select(F.col("stem").alias("imageId"), "path"), "imageId")
    full = G.or_full_frame(G.cap_boxes(boxes, most), w, h)
    order = F.xxhash64("id")  # an object's keys have no order of their own
    return joined.select(*sample(F.col("path"), full, F.col("question"), F.col("answer"), "gqa", F.col("id"), F.col("imageId"), order)).where(F.size("boxes") > 0)


def visual7w_pairs(document: DataFrame, split: str = "train") -> DataFrame:
    """(ordinal, qa, img) from the layout with pairs inside images, or the flat one with pairs by split.

    ``document`` has images (with or without qa_pairs) and train, val, test arrays of pairs; absent ones are null.
    """
    nested = document.select(F.posexplode("images").alias("i", "img")).where((F.col("img.split") == split) & F.col("img.qa_pairs").isNotNull())
    nested = nested.select("i", "img", F.posexplode("img.qa_pairs").alias("j", "qa")).select((F.col("i") * F.lit(1_000_000).cast("bigint") + F.col("j")).alias("ordinal"), "qa", "img")
    images = document.select(F.explode("images").alias("img"))
    pairs = document.where(~F.exists("images", lambda x: x["qa_pairs"].isNotNull())).select(F.posexplode(split).alias("ordinal", "qa"))
    flat = pairs.join(images, F.col("qa.image_id") == F.col("img.image_id"), "left").select(F.col("ordinal").cast("bigint").alias("ordinal"), "qa", "img")
    return nested.unionByName(flat)


def visual7w_samples(pairs: DataFrame, boxes: DataFrame, files: DataFrame, excluded: DataFrame, most: int = MOST_BOXES) -> DataFrame:
    """pairs: (ordinal, qa, img); boxes: (box_id, x, y, width, height, name); files: (name, path); excluded: (id)."""
    qa, img = (lambda n: F.col(f"qa.{n}")), (lambda n: F.col(f"img.{n}"))
    qid = F.coalesce(qa("qa_id"), qa("question_id"), qa("id"), F.col("ordinal").cast("string"))
    kind = F.lower(F.coalesce(qa("type"), qa("qa_type"), F.lit("")))
    named = pairs.withColumn("qid", qid).where((kind == "") | kind.isin("which", "where"))
    named = named.join(excluded.select(F.col("id").alias("qid")), "qid", "left_anti")
    b = boxes.select(F.col("box_id").cast("bigint").cast("string").alias("_id"), F.struct("x", "y", "width", "height", "name").alias("b"))
    # An answer that is no number gets a key of its own that no box has: nulls would all meet in one task.
    named = named.withColumn("_key", F.coalesce(qa("answer").try_cast("bigint").cast("string"), F.concat(F.lit("no box: "), F.coalesce("qid", F.lit("")))))
    joined = named.join(b, F.col("_key") == F.col("_id"), "left")
    path = F.coalesce(img("filename"), img("image_path"), qa("image_path"))
    joined = joined.withColumn("fname", F.element_at(F.split(path, "/"), -1)).join(files.select(F.col("name").alias("fname"), "path"), "fname")
    w, h = F.coalesce(img("width"), F.lit(0.0)), F.coalesce(img("height"), F.lit(0.0))
    v = qa("box_xywh")
    inline = F.when(F.size(v) == 4, F.array(G.to_pixels(v[0], v[1], v[2], v[3], w, h)))
    answer_box = F.array(G.from_xywh(F.col("b.x"), F.col("b.y"), F.col("b.width"), F.col("b.height")))
    found = F.when(F.col("b").isNotNull(), answer_box).otherwise(F.coalesce(inline, F.array().cast(f"array<{BOX}>")))
    answer = F.when(F.col("b").isNotNull(), F.coalesce(F.col("b.name"), qa("answer"))).otherwise(F.coalesce(qa("answer"), qa("multiple_choice_answer"), F.lit("")))
    full = G.cap_boxes(G.or_full_frame(found, w, h), most)
    return joined.select(*sample(F.col("path"), full, F.coalesce(qa("question"), qa("qp"), F.lit("")), answer, "visual7w", F.col("qid"), F.coalesce(qa("image_id"), img("image_id")), F.col("ordinal"))).where(F.size("boxes") > 0)


def majority(answers: Column) -> Column:
    """Most frequent non-empty string; the first seen wins ties."""
    kept = F.filter(F.transform(answers, X.strip), lambda a: a != "")
    counted = F.transform(F.array_distinct(kept), lambda a: F.struct((-F.size(F.filter(kept, lambda b: b == a))).alias("n"), F.array_position(kept, a).alias("p"), a.alias("a")))
    return F.array_min(counted)["a"]


def vqa_samples(questions: DataFrame, annotations: DataFrame, boxes: DataFrame, files: DataFrame, excluded_questions: DataFrame, excluded_images: DataFrame) -> DataFrame:
    """Inner joins of annotation, question and image; of repeated questions the last counts."""
    a = annotations.select(F.posexplode("annotations").alias("ordinal", "a")).select("ordinal", "a.question_id", "a.image_id", majority(F.transform("a.answers", lambda x: x["answer"])).alias("answer")).where(F.col("answer").isNotNull())
    q = questions.select(F.posexplode("questions").alias("p", "q")).groupBy(F.col("q.question_id").alias("question_id")).agg(F.max_by("q.question", "p").alias("question")).where("question <> ''")
    # What is joined by question goes before what is joined by image, so that rows cross once for each.
    a = a.join(excluded_questions.select(F.col("id").cast("bigint").alias("question_id")), "question_id", "left_anti").join(q, "question_id")
    a = a.join(excluded_images.select(F.col("id").cast("bigint").alias("image_id")), "image_id", "left_anti")
    out = a.join(boxes, "image_id").join(files.select(F.col("name").alias("file_name"), "path"), "file_name")
    return out.select(*sample(F.col("path"), F.col("boxes"), F.col("question"), F.col("answer"), "vqav2", F.col("question_id"), F.col("image_id"), F.col("ordinal")))


def aokvqa_samples(rows: DataFrame, boxes: DataFrame, files: DataFrame, excluded: DataFrame) -> DataFrame:
    """rows: ordinal, question_id, image_id, question, choices, correct_choice_idx, direct_answers (or answers).  Choices make an option question."""
    direct = F.coalesce(*(F.try_element_at(c, F.lit(1)) for c in ("direct_answers", "answers") if c in rows.columns))
    kept = rows.join(excluded.select(F.col("id").alias("question_id")), "question_id", "left_anti").join(boxes, "image_id").join(files.select(F.col("name").alias("file_name"), "path"), "file_name")
    mcq = (F.size("choices") > 0) & F.col("correct_choice_idx").isNotNull()
    question = F.when(mcq, X.choices_prompt(X.strip(F.col("question")), F.col("choices"))).otherwise(F.col("question"))
    answer = F.when(mcq, X.choices_answer(F.col("choices"), F.col("correct_choice_idx"))).otherwise(direct)
    out = kept.select(*sample(F.col("path"), F.col("boxes"), question, answer, "aokvqa", F.col("question_id"), F.col("image_id"), F.col("ordinal")), mcq.alias("_mcq"))
    return out.where(F.coalesce(F.col("answer"), F.lit("")) != "").withColumn("format_prompt", F.when(F.col("_mcq"), F.lit(MCQ_PROMPT)).otherwise(F.lit(PROMPT))).drop("_mcq")


def bbox_of(v: Column) -> Column:
    """[x1, y1, x2, y2, ...] (variant; or an object holding bbox or box, to any depth) as a proper box, else null.

    Each level of nesting is an opening brace of the value's JSON, so their number bounds the steps.
    """
    depth = F.coalesce(F.regexp_count(F.to_json(v), F.lit(r"\{")), F.lit(0))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    flat = F.aggregate(steps, v, lambda held, _: F.coalesce(F.try_variant_get(held, "$.bbox", "variant"), F.try_variant_get(held, "$.box", "variant"), held))

    def proper(inner: Column) -> Column:
        b = G.box(*(F.try_element_at(inner, F.lit(k)) for k in (1, 2, 3, 4)))
        return F.when((F.size(inner) >= 4) & G.proper(b), b)

    # Most values are lists as they stand; only others are unwrapped.
    listed = lambda x: F.try_variant_get(x, "$", "array<double>")
    return X.bind(F.coalesce(listed(v), listed(flat)), proper)


def metadata_boxes(boxes: Column, regions: Column) -> Column:
    """Boxes that parse; without any, regions by bbox, else by box as xywh."""
    first = F.filter(F.transform(boxes, lambda b: bbox_of(b)), lambda b: b.isNotNull())

    def region(r: Column) -> Column:
        v = F.coalesce(F.try_variant_get(r, "$.box", "array<double>"), F.try_variant_get(r, "$.bbox_xywh", "array<double>"))

        def placed(held: Column) -> Column:
            e = [F.try_element_at(held, F.lit(k)) for k in (1, 2, 3, 4)]
            return F.when((F.size(held) >= 4) & (e[2] > 0) & (e[3] > 0), G.from_xywh(*e))

        direct = F.try_variant_get(r, "$.bbox", "variant")
        return F.coalesce(bbox_of(direct), X.bind(v, placed))

    second = F.filter(F.transform(regions, region), lambda b: b.isNotNull())
    empty = F.array().cast(f"array<{BOX}>")
    # The second choice is only worked out where the first, worked out once, is empty.
    return X.bind(F.coalesce(first, empty), lambda found: F.when(F.size(found) > 0, found).otherwise(F.coalesce(second, empty)))


def vcr_documents(text: DataFrame) -> DataFrame:
    """(ordinal, value) of the rows of whole JSON documents (column value).

    Rows are the array under ``questions``, else under ``data``, else the document itself; an object gives its values.
    """
    v = F.parse_json("value")
    held = F.coalesce(F.try_variant_get(v, "$.questions", "variant"), F.try_variant_get(v, "$.data", "variant"), v)
    rows = F.coalesce(F.try_variant_get(held, "$", "array<variant>"), F.map_values(F.try_variant_get(held, "$", "map<string,variant>")))
    return text.select(F.posexplode(rows).alias("ordinal", "v")).select("ordinal", F.to_json("v").alias("value"))


def semantic_type(types: Column) -> Column:
    return F.coalesce(types["semantic"], F.lit("unknown"))


def vcr_rows(text: DataFrame) -> DataFrame:
    """JSON rows (column value, ordinal) -> fields; of id names the first present counts."""
    v = F.parse_json("value")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return text.select(
        "ordinal", F.coalesce(*(get(f"$.{k}", "string") for k in ("annot_id", "question_id", "qid", "id")), F.lit("")).alias("id"), get("$.img_fn", "string").alias("img_fn"),
        get("$.metadata_fn", "string").alias("metadata_fn"), F.coalesce(get("$.objects", "array<string>"), F.array().cast("array<string>")).alias("objects"),
        get("$.question_text", "string").alias("question_text"), get("$.question_orig", "string").alias("question_orig"), get("$.question", "variant").alias("question"),
        F.coalesce(get("$.answer_choice_texts", "array<variant>"), get("$.answer_choices", "array<variant>")).alias("choices"), get("$.answer_label", "int").alias("label"),
        get("$.answer_orig", "string").alias("answer_orig"), F.coalesce(get("$.answer", "variant"), get("$.label", "variant")).alias("answer"),
    )


def _vcr_text(v: Column, objects: Column) -> Column:
    tokens = F.try_variant_get(v, "$", "array<variant>")
    plain = F.try_variant_get(v, "$", "string")
    return F.when(tokens.isNotNull(), X.tokens_text(tokens, objects)).otherwise(X.resolve_detections(plain, objects))


def vcr_question() -> Column:
    o = F.col("objects")
    given = F.coalesce(F.nullif(F.col("question_text"), F.lit("")), F.nullif(F.col("question_orig"), F.lit("")))
    return F.coalesce(F.when(given.isNotNull(), X.resolve_detections(given, o)).otherwise(_vcr_text(F.col("question"), o)), F.lit(""))


def vcr_answer() -> Column:
    o = F.col("objects")
    choice = F.when(F.col("label") >= 0, F.try_element_at("choices", F.col("label") + 1)).otherwise(F.try_element_at("choices", F.col("label")))
    given = F.nullif(F.col("answer_orig"), F.lit(""))
    return F.coalesce(F.when(given.isNotNull(), X.resolve_detections(given, o)).when(choice.isNotNull(), _vcr_text(choice, o)).otherwise(_vcr_text(F.col("answer"), o)), F.lit(""))


def vcr_samples(rows: DataFrame, boxes: DataFrame, files: DataFrame, excluded: DataFrame, most: int = MOST_BOXES) -> DataFrame:
    """rows: vcr_rows(); boxes: (metadata_fn, boxes, width, height)."""
    kept = rows.join(excluded.select("id"), "id", "left_anti").withColumn("fname", F.element_at(F.split("img_fn", "/"), -1)).join(files.select(F.col("name").alias("fname"), "path"), "fname")
    joined = kept.join(boxes, "metadata_fn", "left")
    found = G.cap_boxes(F.coalesce(F.col("boxes"), F.array().cast(f"array<{BOX}>")), most)
    full = G.or_full_frame(found, F.coalesce(F.col("width"), F.lit(0.0)), F.coalesce(F.col("height"), F.lit(0.0)))
    out = joined.select(*sample(F.col("path"), full, vcr_question(), vcr_answer(), "vcr", F.col("id"), F.col("img_fn"), F.col("ordinal")))
    return out.where((F.col("question") != "") & (F.col("answer") != "") & (F.size("boxes") > 0))


def region(image: Column, b: Column, description: Column, source: Column, ordinal: Column) -> list[Column]:
    return [ordinal.cast("bigint").alias("ordinal"), image.alias("image"), b.alias("box"), X.strip(description).alias("description"), source.alias("source")]


def coco_regions(document: DataFrame, files: DataFrame, least: float = LEAST_SIDE) -> DataFrame:
    """One region an annotation, described by its category."""
    a = document.select(F.posexplode("annotations").alias("o", "a"))
    images = document.select(F.explode("images").alias("i")).select(F.col("i.id").alias("iid"), F.col("i.file_name").alias("name"))
    names = document.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("cid"), F.col("c.name").alias("category")).distinct()
    b = F.col("a.bbox")
    rows = a.where(G.big_enough(b[2], b[3], least)).join(images, F.col("a.image_id") == F.col("iid")).join(names, F.col("a.category_id") == F.col("cid")).join(files.select("name", "path"), "name")
    return rows.select(*region(F.col("path"), G.from_xywh(b[0], b[1], b[2], b[3]), F.col("category"), F.lit("coco"), F.col("o")))


def refcoco_regions(rows: DataFrame, source: str = "refcoco", split: str = "train", least: float = LEAST_SIDE) -> DataFrame:
    """rows: ordinal, image_path, bbox [x1,y1,x2,y2], sentences (raw, sent; or plain strings), split.  One region a sentence."""
    b = F.col("bbox")
    kept = rows.where((F.col("split") == split) & G.big_enough(b[2] - b[0], b[3] - b[1], least)).select("*", F.posexplode("sentences").alias("j", "s"))
    plain = dict(rows.dtypes)["sentences"] == "array<string>"
    said = F.coalesce(F.col("s"), F.lit("")) if plain else F.coalesce(F.col("s.raw"), F.col("s.sent"), F.lit(""))
    out = kept.select(*region(F.col("image_path"), G.box(b[0], b[1], b[2], b[3]), said, F.lit(source), F.col("ordinal") * 1_000 + F.col("j")))
    return out.where("description <> ''")


def genome_regions(rows: DataFrame, files: DataFrame, seed: int = 42, per_image: int = 15, least: float = LEAST_SIDE) -> DataFrame:
    """rows: ordinal, id, regions.  A seeded sample of the regions of each image, then the size and phrase filters."""
    keyed = F.array_sort(F.transform("regions", lambda r, i: F.struct(arithmetic_rank(F.col("ordinal") * 1_000 + i, seed).alias("h"), i.alias("i"), r.alias("r"))))
    one = rows.select("ordinal", "id", F.explode(F.slice(keyed, 1, per_image)).alias("k")).select("ordinal", "id", F.col("k.i").alias("i"), "k.r.*")
    kept = one.where(G.big_enough(F.col("width"), F.col("height"), least) & (F.length(X.strip(F.col("phrase"))) >= 3)).join(files.select(F.col("stem").alias("_s"), "path"), F.col("id").cast("string") == F.col("_s"))
    b = G.from_xywh(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return kept.select(*region(F.col("path"), b, F.col("phrase"), F.lit("visual_genome"), F.col("ordinal") * 1_000 + F.col("i")))


def grit_rows(table: DataFrame, most: int, order: str, least_similarity: float = 0.30) -> DataFrame:
    """Captions close to their image that name something; the first ``most``."""
    fine = table.where((F.col("clip_similarity_vitl14") >= least_similarity) & (F.size("noun_chunks") > 0))
    return fine.orderBy(order).limit(most)


def grit_regions(rows: DataFrame, per_image: int = 16, least: float = 0.05) -> DataFrame:
    """rows: ordinal, path, caption, width, height, ref_exps [[start, end, x1, y1, x2, y2, score]]; the first passing ones."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    spans = F.transform("ref_exps", lambda e, i: F.struct(i.alias("i"), X.span_text(F.col("caption"), e[0].cast("int"), e[1].cast("int")).alias("t"), G.box(e[2] * w, e[3] * h, e[4] * w, e[5] * h).alias("b"), (e[4] - e[2]).alias("fw"), (e[5] - e[3]).alias("fh")))
    passing = F.slice(F.filter(spans, lambda s: (s["fw"] >= least) & (s["fh"] >= least) & (F.length(s["t"]) >= 3)), 1, per_image)
    return rows.select("ordinal", "path", F.explode(passing).alias("s")).select(*region(F.col("path"), F.col("s.b"), F.col("s.t"), F.lit("grit"), F.col("ordinal") * 1_000 + F.col("s.i")))


def pope_rows(rows: DataFrame, split: str) -> DataFrame:
    return rows.select(F.concat_ws("/", F.lit(split), F.col("question_id").cast("string")).alias("key"), "image", "text", F.lower("label").alias("label"), F.lit(split).alias("split"))


def seed_rows(document: DataFrame) -> DataFrame:
    """Image questions of types 1..9; a type that is no number drops the row."""
    kind = F.col("question_type_id").cast("string").try_cast("int")
    return document.select(F.posexplode("questions").alias("ordinal", "q")).select("ordinal", "q.*").where((F.col("data_type") == "image") & kind.between(1, 9))


def curriculum(stages: list[tuple[str, list[DataFrame]]]) -> DataFrame:
    """Region pools of the stages of a curriculum, one under the other: (stage, stage_name, the columns of a region)."""
    parts = [pool.select(F.lit(i).alias("stage"), F.lit(name).alias("stage_name"), "ordinal", "image", "box", "description", "source") for i, (name, pools) in enumerate(stages) for pool in pools]
    return reduce(DataFrame.unionByName, parts)
