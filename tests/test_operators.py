import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import evaluate as E
from tessera.operators import pool as P
from tessera.operators import sampling as M
from tessera.operators import significance as Z
from tessera.operators import training as R
from tessera.sources import annotations as A
from tessera.sources import files as S


def test_exclusion_reasons(spark):
    s = spark.createDataFrame([("gqa", "q1", "i"), ("vqav2", "007", "5"), ("vqav2", "9", "05"), ("vqav2", "x", "6"), ("vcr", "7", "i")], "source string, question_id string, image_id string")
    e = spark.createDataFrame([("gqa", "question", "q1"), ("vqav2", "question", "7"), ("vqav2", "image", "5"), ("vcr", "question", "8"), ("gqa", "question", "q1")], "source string, id_kind string, id string")
    got = {(r.source, r.question_id): r.reason for r in P.exclusion_reason(s, e).collect()}
    assert got == {("gqa", "q1"): "gqa_question", ("vqav2", "007"): "vqav2_question", ("vqav2", "9"): "vqav2_image", ("vqav2", "x"): None, ("vcr", "7"): None}


def test_sample_errors(spark):
    df = spark.createDataFrame([("p", [1], " ", "a", "s", "q", None)], "i string, b array<int>, q string, a string, s string, qi string, ii string")
    assert df.select(P.sample_errors(*(F.col(c) for c in df.columns)).alias("e")).first().e == ["missing key: image_id", "empty question"]
    bad = spark.createDataFrame([([[1.0, 2.0, 3.0]],)], "b array<array<double>>")
    assert bad.select(P.box_errors(F.col("b")).alias("e")).first().e == ["invalid box length: [1.0,2.0,3.0]"]


def test_numbering_is_dense(spark):
    df = spark.range(0, 1000, 3).withColumn("k", -F.col("id"))
    got = [r.train_idx for r in P.number_rows(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(334))


def test_pointers_stop_on_cycles(spark):
    df = spark.createDataFrame([("1", "2"), ("2", "1"), ("3", "4"), ("4", "x" * 90), ("5", "9")], "k string, v string")
    got = {r.k: (r.resolved or "")[:1] for r in P.resolve_pointers(df, "k", "v").collect()}
    assert got == {"1": "", "2": "", "3": "x", "4": "x", "5": ""}


def test_majority_first_seen(spark):
    df = spark.createDataFrame([(["b", "a", "", " a", "b"],), (["", " "],)], "l array<string>")
    assert [r.v for r in df.select(A.majority(F.col("l")).alias("v")).collect()] == ["b", None]


def test_coco_boxes(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 100, "height": 50, "file_name": "a.jpg"}, {"id": 2, "width": 10, "height": 20, "file_name": "b.jpg"}],
           "annotations": [{"image_id": 1, "category_id": 3, "bbox": [0, 0, 10, 10]}, {"image_id": 1, "category_id": 3, "bbox": [5, 5, 30, 20]}, {"image_id": 2, "category_id": 3, "bbox": [1, 1, 9, 30]}],
           "categories": [{"id": 3, "name": " cat "}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    d = S.read_json_document(spark, str(tmp_path / "c.json"), A.COCO_SCHEMA)
    got = {r.image_id: [tuple(b) for b in r.boxes] for r in A.coco_boxes(d, most=1).collect()}
    assert got == {1: [(5, 5, 35, 25)], 2: [(0, 0, 10, 20)]}
    files = spark.createDataFrame([("a.jpg", "a", "/x/a.jpg")], "name string, stem string, path string")
    assert [(r.image, r.description) for r in A.coco_regions(d, files).orderBy("ordinal").collect()] == [("/x/a.jpg", "cat")] * 2
    assert S.read_json_document(spark, str(tmp_path / "none.json"), A.COCO_SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_json_document(spark, str(tmp_path / "none.json"), A.COCO_SCHEMA, missing_ok=False)
    q = spark.createDataFrame([([Row(question_id=7, image_id=1, question=" what? ")],)], A.VQA_QUESTIONS)
    a = spark.createDataFrame([([Row(question_id=7, image_id=1, answers=[Row(answer="x"), Row(answer="y"), Row(answer="y")])],)], A.VQA_ANNOTATIONS)
    ids = spark.createDataFrame([], "id string")
    rows = A.vqa_samples(q, a, A.coco_boxes(d), files, ids, ids).collect()
    assert [(r.question, r.answer, r.question_id, r.train if "train" in r else r.source) for r in rows] == [("what?", "y", "7", "vqav2")]


def test_gqa_samples(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"q1": {"imageId": "i1", "question": "Is it?", "answer": "yes", "types": {"semantic": "obj"}}, "q2": {"imageId": "i2", "question": "b", "answer": "no", "width": 30, "height": 40}}))
    (tmp_path / "g.json").write_text(json.dumps({"i1": {"width": 200, "height": 100, "objects": {"1": {"x": 0, "y": 0, "w": 20, "h": 20}, "2": {"x": 0.1, "y": 0.1, "w": 0.5, "h": 0.5}, "3": {"x": 1, "y": 1, "w": 0, "h": 9}, "4": {"x": 1, "y": 1, "w": 5, "h": 50}}}}))
    q, g = S.read_keyed_object(spark, str(tmp_path / "q.json"), A.GQA_QUESTION), S.read_keyed_object(spark, str(tmp_path / "g.json"), A.SCENE_GRAPH)
    files = spark.createDataFrame([("i1", "/i1.jpg"), ("i2", "/i2.jpg")], "stem string, path string")
    got = {r.question_id: {tuple(b) for b in r.boxes} for r in A.gqa_samples(q, g, files, spark.createDataFrame([], "id string")).collect()}
    assert got == {"q1": {(0, 0, 20, 20), (20, 10, 120, 60)}, "q2": {(0, 0, 30, 40)}}


def test_vcr_rows(spark):
    rows = [{"annot_id": "a", "img_fn": "x/1.jpg", "metadata_fn": "m", "objects": ["person", "dog"], "question": ["Is", [0], "?"], "answer_choices": [["no"], [[1], "barks"]], "answer_label": 1}, {"id": 5, "img_fn": "2.jpg", "metadata_fn": "m", "objects": ["cat"], "question_orig": "Why 1?", "answer_orig": "1 is 2"}]
    text = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ordinal int, value string")
    got = A.vcr_rows(text).select("id", A.vcr_question().alias("q"), A.vcr_answer().alias("a")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("a", "Is Casey ?", "dog barks"), ("5", "Why cat?", "cat is 2")]
    meta = spark.createDataFrame([(["[0,0,5,5,0.9]", "[5,5,1,1]"], ["{}"]), (["[1]"], ['{"bbox": [1,1,2,2]}', '{"box": [1,1,2,2]}', '{"box": [1,1,0,2]}'])], "b array<string>, r array<string>")
    parse = lambda c: F.transform(c, F.parse_json)
    got = [[tuple(b) for b in r.v] for r in meta.select(A.metadata_boxes(parse("b"), parse("r")).alias("v")).collect()]
    assert got == [[(0, 0, 5, 5)], [(1, 1, 2, 2), (1, 1, 3, 3)]]


def test_grit_and_refcoco(spark):
    rows = spark.createDataFrame([(0, "/a", "a red dog", 100, 50, [[2.0, 9.0, 0.1, 0.1, 0.5, 0.5, 0.9], [0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.9], [2.0, 5.0, 0.1, 0.1, 0.12, 0.9, 0.9]])], "ordinal int, path string, caption string, width int, height int, ref_exps array<array<double>>")
    assert [(r.description, tuple(r.box)) for r in A.grit_regions(rows).collect()] == [("red dog", (10, 5, 50, 25))]
    ref = spark.createDataFrame([(0, "/a", [0.0, 0.0, 20.0, 20.0], [Row(raw=None, sent=" left dog "), Row(raw="", sent="x")], "train")], "ordinal int, image_path string, bbox array<double>, sentences array<struct<raw:string,sent:string>>, split string")
    assert [r.description for r in A.refcoco_regions(ref).collect()] == ["left dog"]


def test_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in S.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a bigint").collect()) == [1, 2]
    assert S.read_jsonl(spark, str(tmp_path / "no.jsonl"), "a bigint").count() == 0
    (tmp_path / "bad.jsonl").write_text("{a\n")
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a bigint").collect()
    inv = S.inventory(spark, str(tmp_path), "*.jsonl")
    assert {r.stem for r in inv.collect()} == {"l", "bad"}
    cand = spark.createDataFrame([("k", 1, "/no"), ("k", 2, inv.first().path)], "key string, priority int, path string")
    assert S.resolve_first(cand, inv, "key").first().path == inv.first().path
    assert spark.range(1).select(S.image_id_of(F.lit("coco_TEST2015_000000000042.JPG")).alias("v")).first().v == 42
    assert spark.range(1).select(S.image_name_of(F.lit(42)).alias("v")).first().v == "COCO_test2015_000000000042.jpg"
    assert bytes(spark.range(1).select(S.decode_image(F.lit("data:image/png;base64,aGk")).alias("v")).first().v) == b"hi"
    S.append_jsonl(spark.range(2), str(tmp_path / "log"))
    S.append_jsonl(spark.range(2, 3), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_resume_and_submission(spark):
    samples = spark.createDataFrame([(1,), (2,), (10,)], "question_id bigint")
    log = spark.createDataFrame([("2", "a.", 0), ("2", " b.\nx", 1), ("99", "z", 2)], "question_id string, answer string, o int")
    assert sorted(r.question_id for r in E.to_predict(samples, log, "question_id").collect()) == [1, 10]
    ok, missing, extra = E.submission(samples, log, "o")
    assert [(r.question_id, r.answer) for r in ok.collect()] == [(2, "b")]
    assert {r[0] for r in missing.collect()} == {1, 10} and {r[0] for r in extra.collect()} == {99}
    with pytest.raises(ValueError, match="first missing"):
        E.check_submission(samples, log, "o")
    with pytest.raises(ValueError):
        E.eval_rows(samples, "question_id", 0)
    done = E.predict(samples.withColumn("prompt", F.lit("ab")), "prompt")
    assert {r.raw_prediction for r in done.collect()} == {"yes"}


def test_confusion_with_invalid(spark):
    log = spark.createDataFrame([("yes", "yes"), ("no", "yes"), ("no", None), ("yes", "no")], "label string, prediction string")
    r = E.confusion(log, []).first()
    assert (r.n, r.tp, r.fp, r.fn, r.tn, r.invalid, r.accuracy_pct, r.f1_pct) == (4, 1, 1, 1, 0, 1, 25.0, 50.0)


def test_paired(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i % 2), float(i % 3 > 0), i) for i in range(40)], "k string, b double, f double, o int")
    pairs = Z.merge_paired(Z.scores_by_key(rows, F.col("k"), F.col("b"), "o"), Z.scores_by_key(rows, F.col("k"), F.col("f"), "o")).withColumn("bench", F.lit("x"))
    r = Z.paired_result(pairs, ["bench"]).first()
    assert r.n == 40 and r.mcnemar_exact and 0 < r.p_value < 1 and r.ci_low_pp < r.delta_pp < r.ci_high_pp
    assert Z.paired_result(pairs.limit(1), ["bench"]).first().notes.startswith("Insufficient")


def test_sampling(spark):
    df = spark.createDataFrame([(i, "coco" if i % 10 else "grit") for i in range(200)], "id bigint, source string").withColumn("fam", M.family_of(F.col("source")))
    q = M.balanced_batches(df, "fam", "id", 9, batches=20)
    per = q.groupBy("batch", "family").count().collect()
    assert len(per) == 40 and {r["count"] for r in per} == {4, 5}
    small = q.where("family = 'grit'").groupBy("id").count().agg(F.min("count"), F.max("count")).first()
    assert small[1] - small[0] <= 1  # a small family repeats evenly
    w = M.weighted_draws(df, "source", "id", 400, {"coco": 1.0, "grit": 1.0}, by_share=True)
    assert w.count() == 400 and 140 < w.where("source = 'grit'").count() < 260


def test_training_folds(spark):
    df = spark.createDataFrame([([4.0, 2.0, 3.0, 1.0],)], "v array<double>")
    r = df.select(R.ema(F.col("v"), 0.5).alias("e"), R.ema_series(F.col("v"), 0.5).alias("s"), R.best_so_far(F.col("v")).alias("b"), R.early_stop(F.col("v"), 1, 0.6, 0.0).alias("x")).first()
    assert r.e == 2.0 and r.s == [4.0, 3.0, 3.0, 2.0] and r.b == [0, 1, 3] and (r.x.stopped_at, r.x.best) == (2, 2.0)
    assert R.resume_point(25, 10, 4) == (2, 20)


def test_streaming(spark, tmp_path):
    from tessera.streaming import events as V

    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path).groupBy("user_id").count()
    out = V.smooth(V.stream_table(spark, path), "user_id", "event_id", "value")
    name = "smooth_test"
    out.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.table(name).groupBy("user_id").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in batch.collect()}
    V.append_log(V.stream_table(spark, path).select("event_id"), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 1000


def test_export(spark):
    t = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "index double, x string")
    log = spark.createDataFrame([("1", "A")], "index string, prediction string")
    assert {(r.x, r.prediction) for r in E.export_with_predictions(t, log, "index").collect()} == {("a", "A"), ("b", "")}
    assert X.any_of(F.lit(True), F.lit(False)) is not None


def test_tag_proposals(spark):
    from tessera.operators.proposals import merge_tag_proposals

    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    found = spark.createDataFrame(
        [(1, "dog", 0, 0.5, (0.0, 0.0, 10.0, 10.0), ""), (1, "dog", 1, 0.9, (0.0, 0.0, 10.0, 10.0), "big dog"), (1, "cat", 2, 0.8, (0.0, 0.0, 10.0, 10.0), "cat"), (1, "sky", 3, 0.1, (50.0, 0.0, 90.0, 10.0), None), (1, " ", 4, 0.99, (0.0, 0.0, 1.0, 1.0), "")],
        f"image_id int, tag string, pos int, score double, box {box}, phrase string",
    )
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    got = {r.image_id: [(p.label, p.score) for p in r.proposals] for r in merge_tag_proposals(images, found).collect()}
    assert got == {1: [("big dog", 0.9), ("sky", 0.1)], 2: [("[fallback: whole image]", 0.0)]}


def test_vcr_documents(spark):
    rows = [{"annot_id": "a", "question": "Is 1 in?", "objects": ["person"], "answer": "yes"}, {"qid": 5, "question": "Why?", "answer": "no"}]
    for doc in (rows, {"questions": rows}, {"data": rows}, {"questions": {"x": rows[0], "y": rows[1]}}):
        text = spark.createDataFrame([(json.dumps(doc),)], "value string")
        got = A.vcr_rows(A.vcr_documents(text)).select("id", A.vcr_question().alias("q")).collect()
        assert sorted(map(tuple, got)) == [("5", "Why?"), ("a", "Is Casey in?")]
    v = spark.createDataFrame([('{"box": {"bbox": {"box": [0, 1, 5, 6, 0.9]}}}',), ('{"bbox": null}',), ('"dog"',), ("[3, 3, 1, 1]",)], "j string").select(A.bbox_of(F.parse_json("j")).alias("b")).collect()
    assert [tuple(r.b) if r.b else None for r in v] == [(0, 1, 5, 6), None, None, None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(10, "b"), (2, "a"), (7, "c")], "question_id bigint, answer string")
    S.write_json_array(rows, "question_id", str(tmp_path / "sub"))
    (part,) = (tmp_path / "sub").glob("part-*")
    assert json.loads(part.read_text()) == [{"question_id": 2, "answer": "a"}, {"question_id": 7, "answer": "c"}, {"question_id": 10, "answer": "b"}]
    S.write_audit(spark.createDataFrame([(1, "x", 3)], "train_idx int, train_image string, hamming_distance int").coalesce(1), str(tmp_path / "audit"))
    (part,) = (tmp_path / "audit").glob("part-*")
    assert part.read_text().split("\n")[0].split(",") == list(S.MATCH_AUDIT)
    from tessera.operators import decontam as D

    one = lambda schema, *r: spark.createDataFrame(list(r), schema)
    log = D.decontamination_log(one("train_id bigint, ref_id bigint, distance int", (1, 5, 2), (1, 4, 3)), one("train_id bigint, rank int, ref_id bigint, similarity double", (1, 1, 9, 0.5), (2, 1, 8, 0.9)), one("train_id bigint", (3,)))
    D.write_decontamination_log(log, str(tmp_path / "log"))
    back = {r.train_id: r for r in D.read_decontamination_log(spark, str(tmp_path / "log")).collect()}
    assert [m.ref_id for m in back[1].hash_matches] == [4, 5] and back[2].neighbours[0].similarity == 0.9 and back[3].corrupt


def test_cache_is_keyed_by_its_inputs(spark, tmp_path):
    from tessera.sources.shared import cached

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    (tmp_path / "a.bin").write_bytes(b"1")
    key = S.fingerprint(S.inventory(spark, str(tmp_path)))
    assert cached(spark, "hash", key, make).count() == cached(spark, "hash", key, make).count() == 3 and made == [1]
    (tmp_path / "b.bin").write_bytes(b"22")
    assert S.fingerprint(S.inventory(spark, str(tmp_path))) != key
    assert S.local_or_none(spark, [str(tmp_path / "none"), str(tmp_path / "no")]) is None


def test_holding_is_the_same_by_pairs(spark):
    from tessera.operators import decontam as D

    texts = ["a b c d e", "x alpha beta gamma delta y", "alphabeta", "", None, "one two", "the long beta gamma delta here", "zalpha beta gamma deltaz"]
    items = ["alpha beta gamma delta", "b c", " ", "one two", "none of these here", "long beta gamma delta her"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    found = spark.createDataFrame([(x,) for x in items], "item string")
    want = {i for i, t in enumerate(texts) if t and any(x in t for x in items if x.strip())}
    for limit in (1 << 20, 0, 90):
        assert {r[0] for r in D.holding(docs, found, "id", "t", "item", limit=max(1, limit)).collect()} == want


def test_folds_equal_columns(spark):
    df = spark.createDataFrame([(k, i, float((i * 7 + k) % 11)) for k in range(4) for i in range(25)], "k bigint, i bigint, v double")
    arrays = df.groupBy("k").agg(R.ordered(F.col("v"), F.col("i")).alias("v"))
    want = {r.k: (r.e, r.s) for r in arrays.select("k", R.ema(F.col("v")).alias("e"), R.early_stop(F.col("v"), 3).alias("s")).collect()}
    emas = {r.k: r for r in R.ema_runs(df, "k", ["i"], "v").collect()}
    stops = {r.k: r for r in R.early_stop_runs(df, "k", ["i"], "v", 3).collect()}
    for k, (e, s) in want.items():
        assert emas[k].n == 25 and abs(emas[k].ema - e) < 1e-12
        assert (stops[k].best, stops[k].stale, stops[k].stopped_at, stops[k].seen) == tuple(s)


def test_stops_beyond_the_cap(spark):
    from tessera.functions import text as X

    t = spark.createDataFrame([("a." * 40 + "1.5",)], "t string")
    r = t.select(X.drop_stops(F.col("t")).alias("a"), X.drop_stops(F.col("t"), 32).alias("b"), X.drop_stops(F.col("t"), 50).alias("c")).first()
    assert r.a == r.c == "a" * 40 + ".1.5" and r.b == "a" * 32 + "a." * 8 + "1.5"


def test_pointers_of_any_length(spark):
    long = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("n300", "x" * 70)]
    cycle = [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("t", "c0")]
    df = spark.createDataFrame([*long, *cycle, ("m", "gone"), ("r", "n0"), ("r", "a"), ("s", "s"), (None, "q"), ("q", None)], "k string, v string")
    got = {r.k: (r.resolved, r.hops) for r in P.resolve_pointers(df, "k", "v").collect()}
    assert got == {f"n{i}": ("x" * 70, 300 - i) for i in range(301)} | {c: (None, None) for c in ("c0", "c1", "c2", "t", "s")} | {"m": (None, 1), "r": ("x" * 70, 301)}
    assert P.resolve_pointers(df.limit(0), "k", "v").count() == 0


def test_ties_have_one_answer(spark):
    rows = [("1", a, o, 0) for a in ("b", "c", "a") for o in (1, 2)] + [("2", None, 5, 0), ("2", "x", 4, 0)]
    samples = spark.createDataFrame([(1,), (2,)], "question_id bigint")
    for k in range(6):
        log = spark.createDataFrame(rows[k:] + rows[:k], "question_id string, answer string, o int, z int").repartition(k + 1)
        assert {(r.question_id, r.answer) for r in E.submission(samples, log, ["o", "z"])[0].collect()} == {(1, "c"), (2, None)}
    t = spark.createDataFrame([(1,)], "index int")
    log = spark.createDataFrame([("1", "p", 1), ("1.0", "q", 2), ("1", "r", 2), ("1", "z", 0)], "index string, prediction string, o int")
    assert E.export_with_predictions(t, log, "index", "o").first().prediction == "r"


def test_folder_report_meets_by_parents(spark):
    paths = ["/a/b/x.jpg", "/a/b/c/y.jpg", "/a/bc/z.jpg", "/d", "plain", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = spark.createDataFrame([("ab", "/a/b/"), ("a", "/a/"), ("none", "/q/"), ("two", "/a/b/c/"), ("two", "/a/bc/"), ("root", "/")], "name string, prefix string")
    assert {tuple(r) for r in S.folder_report(asked, files).collect()} == {("ab", True, 2), ("a", True, 3), ("none", False, 0), ("two", True, 2), ("root", True, 4)}


def test_fingerprint_is_of_a_multiset(spark):
    rows = [("a", 1), ("b", 2), ("b", 2), (None, 3), ("c", None)]
    frame = lambda r, n: spark.createDataFrame(r, "path string, length bigint").repartition(n)
    same = {S.fingerprint(frame(rows, 1)), S.fingerprint(frame(rows[::-1], 3))}
    others = {S.fingerprint(frame(r, 2)) for r in (rows[1:], [*rows, rows[0]], [("a", 2), *rows[1:]], rows[:0], [("a1", None), *rows[1:]])}
    assert len(same) == 1 and len(others) == 5 and not same & others


def test_hash_cache_computes_only_what_is_new(spark, tmp_path):
    from tessera.sources import hash_cache as H

    asked, cache = [], str(tmp_path / "hashes")

    def hashes(new):
        asked.append(sorted(r.path for r in new.collect()))
        return new.where("path not like 'bad%'").select("path", F.array(F.length("path").cast("bigint")).alias("hash"))

    files = lambda *rows: spark.createDataFrame(rows, "path string, length bigint, modified bigint")
    one, two, bad = ("a", 1, 5), ("bb", 2, 5), ("bad", 3, None)
    first = H.refresh(files(one, two, bad, bad, (None, 1, 1)), cache, hashes)
    assert {(r.path, tuple(r.hash) if r.hash else None, r.fresh) for r in first.collect()} == {("a", (1,), True), ("bb", (2,), True), ("bad", None, True)}
    second = H.refresh(files(one, two, bad, ("ccc", 1, 5)), cache, hashes)
    assert {(r.path, r.fresh) for r in second.collect()} == {("a", False), ("bb", False), ("bad", False), ("ccc", True)} and asked == [["a", "bad", "bb"], ["ccc"]]
    assert [r.path for r in H.corrupt(second).collect()] == ["bad"]
    H.refresh(files(("a", 1, 6)), cache, hashes)
    assert asked[-1] == ["a"]
    H.clear(spark, cache)
    assert {r.fresh for r in H.refresh(files(one), cache, hashes).collect()} == {True}


def test_permutation(spark):
    for n in (1, 2, 3, 5, 10, 16, 17, 100, 997, 5000):
        rows = spark.range(n).select("id", M.permuted(F.col("id"), n, seed=3).alias("item")).withColumn("back", M.permuted(F.col("item"), n, seed=3, back=True)).collect()
        assert sorted(r.item for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    order = lambda **k: [r.item for r in M.epoch_slice(spark, 1000, **k).orderBy("place").collect()]
    whole = order()
    assert whole[357:] == order(start=357) and whole[10:20] == order(start=10, end=20) and whole != order(epoch=1) != order(seed=1)
    moved = sum(a != b for a, b in zip(whole, range(1000)))
    assert moved > 980 and abs(sum(whole[:500]) / 500 - 500) < 50
    assert spark.range(1).select(M.permuted(F.lit(7), 7).alias("v")).first().v is None


def test_suppression_by_row_equals_the_list_form(spark):
    import random

    from tessera.functions import geometry as G
    from tessera.operators.proposals import SCHEMA, merge_tag_proposals
    from tessera.operators.suppression import suppress_rows

    rng, rows = random.Random(4), []
    for image in range(12):
        for pos in range(60):
            x, y, w, h = (rng.choice([0, 1, 2, 5, 30, 31, 100]) for _ in range(4))
            rows.append((image, f"t{pos % 7}", pos, rng.choice([0.1, 0.2, 0.5, 0.9]), (x * 1.0, y * 1.0, x + w * 1.0 - 1, y + h * 1.0), rng.choice(["", None, "p"])))
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    found = spark.createDataFrame(rows, f"image_id int, tag string, pos int, score double, box {box}, phrase string")
    images = spark.range(14).select(F.col("id").cast("int").alias("image_id"))
    for limit, contained, most, per_tag in ((0.5, False, 20, 3), (0.3, True, 50, 60), (0.95, True, 4, 2), (0.0, False, 60, 60)):
        got = {r.image_id: r.proposals for r in merge_tag_proposals(images, found, per_tag, most, limit, contained).collect()}
        for image in range(14):
            mine = [r for r in rows if r[0] == image]
            kept = []
            for tag in {r[1] for r in mine}:
                kept += sorted((r for r in mine if r[1] == tag), key=lambda r: (-r[3], r[2]))[:per_tag]
            props = [(r[3], r[4], r[5] or r[1]) for r in sorted(kept, key=lambda r: r[2])]
            df = spark.createDataFrame([(props,)], f"p array<{SCHEMA}>")
            if image in (0, 5, 13):
                assert got[image] == df.select(G.finish_proposals(F.col("p"), SCHEMA, most, limit, contained).alias("v")).first().v
    many = spark.range(50_000).select(F.lit(1).alias("image_id"), (F.col("id") % 997 / 997.0).alias("score"), F.struct(*((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2000)) / 2.0 + (10.0 if k > 1 else 0.0)).alias(c) for k, c in enumerate(("x1", "y1"))), ).alias("corner"), "id")
    many = many.select("image_id", "score", "id", F.struct(F.col("corner.x1").alias("x1"), F.col("corner.y1").alias("y1"), (F.col("corner.x1") + 30).alias("x2"), (F.col("corner.y1") + 20).alias("y2")).alias("box"))
    kept = suppress_rows(many.union(many.withColumn("id", F.col("id") + 50_000)), "image_id", ["id"], 0.4).collect()
    assert sorted(r.place for r in kept) == list(range(len(kept))) and 1000 < len(kept) < 20_000


def test_running_sum_by_ranges(spark):
    rows = [(g, i, (i * 7 + g) % 5) for g in (0, 1) for i in range(60)] + [(None, 3, 2), (None, 70, 4)]
    got = M.running_sum(spark.createDataFrame(rows, "g int, i bigint, v int"), "g", "i", "v", "before", width=16)
    want = {(g, i): sum(v for h, j, v in rows if h == g and j < i) for g, i, _ in rows}
    assert {(r.g, r.i): r.before for r in got.collect()} == want


def test_means_of_runs_that_span_partitions(spark):
    rows = [(1, i, float((i * 37) % 101)) for i in range(4000)] + [(2, 0, 5.0), (3, 1, None), (3, 0, 1.0), (3, 2, 2.0), (None, 0, 7.0), (None, 1, 9.0)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got = {r.k: (r.n, r.ema) for r in R.ema_runs(df, "k", ["i"], "v", 0.9).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in (1, 2, 3, None):
        mine = [v for q, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) if v is not None]
        e = mine[0]
        for v in mine[1:]:
            e = 0.9 * e + 0.1 * v
        assert got[k][0] == len(mine) and abs(got[k][1] - e) < 1e-9
    assert R.ema_runs(df.limit(0), "k", ["i"], "v").count() == 0


def test_holding_random_texts(spark):
    import random

    from tessera.operators import decontam as D

    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    items = [t[a : a + rng.randint(3, 40)] for t in texts[:30] for a in [rng.randint(0, max(0, len(t) - 3))]] + ["", "  ", "zz zz zz zz zz"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, None])], "id string, t string")
    found = spark.createDataFrame([(x,) for x in [*items, None]], "item string")
    want = {str(i) for i, t in enumerate(texts) if any(x in t for x in items if x.strip())}
    for bits in (1 << 12, 1 << 6):
        old, D.FILTER_BITS = D.FILTER_BITS, bits
        assert {r[0] for r in D.holding(docs, found, "id", "t", "item", limit=200).collect()} == want
        D.FILTER_BITS = old
    assert D.holding(docs, found.limit(0), "id", "t", "item").count() == 0


def test_positive_arguments():
    E.positive(limit=None, epochs=1, rate=1e-9)
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError, match="epochs must be positive"):
            E.positive(limit=3, epochs=bad)
