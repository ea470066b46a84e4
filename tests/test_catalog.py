"""Every query of the catalogue against its SQL on a second engine."""

import math

import duckdb
import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(f"select * from ({catalog.ORACLE[name]}) q")
    cols = sorted(d[0] for d in got.description)
    assert cols == sorted(df.columns)
    at = [[d[0] for d in got.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    assert have == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_spans_of_all_words(spark, tmp_path):
    texts = {1: "one two three four five six seven eight", 2: "a  bc\tdef ghi\n jkl", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((d, i + 1, w) for d, t in texts.items() for i, w in enumerate((t or "").split(" ")) if len(w) >= 3 and w.strip() == w)
    assert sorted(map(tuple, catalog.QUERIES["grit_spans"](spark, tmp_path).collect())) == want
    assert (1, 8, "eight") in want


def test_soft_score_of_all_events(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.functions import text as X

    types = {1: ["view"] * 10 + ["buy"] * 30, 2: ["buy"] * 12 + ["view"] * 2, 3: ["buy"], 4: ["The buy!", "buy", "view", None], 5: ["view"] * 12}
    rows = [(100 * u + k, u, t) for u, ts in types.items() for k, t in enumerate(ts)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    gts = spark.createDataFrame([(u, [t for t in ts if t]) for u, ts in types.items()], "u bigint, gts array<string>")
    want = {r.u: round(r.s, 6) for r in gts.select("u", X.vqa_soft_score(F.lit("buy"), F.col("gts")).alias("s")).collect()}
    assert {r.user_id: r.score for r in catalog.QUERIES["soft_score"](spark, tmp_path).collect()} == want
    assert want[1] == 1.0


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    rows = [(1, [-4e-7, 4e-7, -0.25]), (2, [-4e-7, 0.0, -0.5])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.execute(catalog.ORACLE["masked_means"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    (got,) = catalog.QUERIES["masked_means"](spark, tmp_path).collect()
    assert repr([(got.g, list(got["mean"]))]) == repr(want) and repr(got["mean"][0]) == "-0.0"


def test_soft_score_of_orders_counts_rows_without_a_flag(spark, tmp_path):
    flags = {1: ["N"] * 4 + ["R"], 2: [None, None], 3: ["N", None], 4: ["N"] * 3, 5: ["The N!", "n", "N", "R"]}
    spark.createDataFrame([(o, f) for o, fs in flags.items() for f in fs], "l_orderkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.score for r in catalog.QUERIES["soft_score_of_orders"](spark, tmp_path).collect()}
    want = dict(duckdb.execute(catalog.ORACLE["soft_score_of_orders"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall())
    assert {o: got[o] for o in (1, 2, 3, 4)} == {o: want[o] for o in (1, 2, 3, 4)} and got[3] == 0.166667
    assert got[5] == 0.75  # normalised, since they differ: three of four agree


def test_tags_are_made_without_a_shuffle(spark):
    assert "Exchange" not in catalog.QUERIES["tag_merge"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["vqa_rows", "aokvqa_rows", "coco_box_lists", "coco_region_rows"])
def test_documents_are_not_gathered_by_customer(spark, name):
    assert "o_custkey" not in catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_answers_without_a_box_have_keys_of_their_own(spark):
    """No null keys, which would all meet in one task."""
    assert "no box: " in catalog.QUERIES["visual7w_rows"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_nms_equals_a_plain_loop(spark):
    from tessera.functions import geometry as G

    def iou(a, b):
        w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
        inter = max(0.0, w) * max(0.0, h)
        union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter
        return inter / union if union > 0 else 0.0

    rows = catalog._proposals(spark, DATA).limit(200)
    kept = {r.l_orderkey: r.k for r in rows.select("l_orderkey", G.suppress(rows.props, catalog._PROPOSAL, 0.5).alias("k")).collect()}
    for r in rows.collect():
        want = []
        for p in sorted(r.props, key=lambda p: -p.score):
            if not any(iou(k.box, p.box) > 0.5 for k in want):
                want.append(p)
        assert [p.label for p in want] == [p.label for p in kept[r.l_orderkey]]


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.reason for r in e.entry(spark).collect()} == {"clean", "toxic_id", "benchmark"}
