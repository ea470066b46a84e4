import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import stats as S
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import decontam as D
from tessera.operators import neighbours as N


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [
    ("The dog.", "dog"), ("Two, three", "2 3"), ("dont know", "don't know"), ("3,000", "3000"), ("1.5 m.", "1.5 m"), ("a/b", "b"), ("none", "0"), ("x-y", "x y"), ("x- y", "x y"), ("\tAn\napple ", "apple"), ("", ""),
])
def test_normalise(spark, raw, want):
    assert one(spark, X.normalise_answer(F.col("t")), t=raw) == want


@pytest.mark.parametrize("p, gts, want", [("yes", ["yes"] * 10, 1.0), ("cat", ["cat"] + ["dog"] * 9, 0.3), ("cat", ["cat"] * 3 + ["dog"] * 7, 0.9), ("a cat", ["cat"] * 4 + ["dog"] * 6, 1.0), ("A cat", ["cat"] * 10, 0.0)])
def test_soft_score(spark, p, gts, want):
    assert one(spark, X.vqa_soft_score(F.col("p"), F.col("g")), p=p, g=gts) == pytest.approx(want)


@given(st.integers(0, 12), st.integers(1, 12))
@settings(max_examples=30, deadline=None)
def test_leave_one_out_closed_form(m, n):
    m = min(m, n)
    loop = sum(min((m - (i < m)) / 3, 1.0) for i in range(n)) / n
    assert (m * min((m - 1) / 3, 1) + (n - m) * min(m / 3, 1)) / n == pytest.approx(loop)


def test_detections(spark):
    people = ["person", "person", "car"]
    assert one(spark, X.resolve_detections(F.col("t"), F.col("o")), t="Why is 1 smiling at 2?", o=people) == "Why is Casey smiling at Riley?"
    assert one(spark, X.resolve_detections(F.col("t"), F.col("o")), t="2 has spinach in her teeth.", o=people) == "Riley has spinach in her teeth."
    assert one(spark, X.resolve_detections(F.col("t"), F.col("o")), t="4 and a1 and 3rd 03 3", o=people) == "4 and a1 and 3rd car car"
    tokens = F.transform(F.col("t"), F.parse_json)
    assert one(spark, X.tokens_text(tokens, F.col("o")), t=['"Does"', "[2]", '"feel"', '"comfortable"', '"?"'], o=["person"] * 3 + ["car"]) == "Does Jessie feel comfortable ?"


def test_short_answers(spark):
    assert one(spark, X.truncate_short_answer(F.col("t")), t=" A dog. It runs.\nmore") == "A dog"
    assert one(spark, X.truncate_short_answer(F.col("t")), t="a; b. c") == "a; b"
    assert one(spark, X.submission_answer(F.col("t")), t=" .. \nx") == "unknown"
    assert one(spark, X.drop_final_dots(F.col("t")), t="") == ""
    assert one(spark, X.drop_final_dot(F.col("t")), t="a..") == "a."
    assert one(spark, X.yes_no(F.col("t")), t="Well, no. Yes") == "no"


def test_option_letter(spark):
    def letter(t):
        return one(spark, X.option_letter(F.col("t"), X.option_map(*(F.lit(x) for x in ("red", "green", "nan", "the red")))), t=t)

    assert letter("(B) it is") == "B"
    assert letter("a dog") == "A"
    assert letter("C.") is None
    assert letter("green") == "B"
    assert letter("red") is None  # two options are the same once normalised


def test_tags(spark):
    assert one(spark, X.merge_tags(F.col("a"), F.col("b")), a=["Dog", " cat "], b=["dog", "", "Bird"]) == ["Dog", "cat", "Bird"]
    assert one(spark, X.select_tags(F.col("r"), F.col("t")), r="Dogs . red car | sky", t=["dog", "Car"]) == ["dog", "Car"]
    assert one(spark, X.question_nouns(F.col("q")), q="How many cities and buses has the glass dog?") == ["city", "buse", "glass", "dog"]
    assert one(spark, X.grounding_prompt(F.col("q"), F.col("t")), q="is it?", t=[""]) == "object"
    assert one(spark, X.prompt_tags(F.col("q")), q="a . b .  . c") == ["a", "b", "c"]


def test_keys_and_slugs(spark):
    assert [one(spark, X.index_key(F.col("t")), t=t) for t in ("3.0", " x ", "nan", "2.5")] == ["3", "x", "", "2.5"]
    assert one(spark, X.slug(F.col("t")), t=" A, b! ") == "a-b"
    assert one(spark, X.slug(F.col("t"), "benchmark"), t="--") == "benchmark"
    assert one(spark, X.span_text(F.col("t"), F.lit(2), F.lit(6)), t="a big dog") == "big"
    assert one(spark, X.choices_prompt(F.lit("q"), F.col("c")), c=["x", "y"]) == "q\nOptions:\nA) x\nB) y"
    assert [tuple(b) for b in one(spark, X.parse_boxes(F.col("t")), t="1,2,3,4; 5,6,7,8;")] == [(1, 2, 3, 4), (5, 6, 7, 8)]
    with pytest.raises(Exception, match="4 values"):
        one(spark, X.parse_boxes(F.col("t")), t="1,2,3")


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=8), st.integers(1, 4))
@settings(max_examples=8, deadline=None)
def test_cap_is_stable(spark, sides, k):
    boxes = [(float(i), 0.0, float(i + w), float(h)) for i, (w, h) in enumerate(sides)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = [tuple(x) for x in df.select(G.cap_boxes(F.col("b"), k).alias("v")).first().v]
    want = boxes if len(boxes) <= k else sorted(boxes, key=lambda b: (b[2] - b[0]) * (b[3] - b[1]), reverse=True)[:k]
    assert got == want


def test_clamp(spark):
    b = G.clamp_scale(G.box(F.lit(50.0), F.lit(-3.0), F.lit(60.0), F.lit(10.0)), F.lit(40.0), F.lit(20.0))
    assert tuple(one(spark, b)) == pytest.approx((39 * 8.4, 0, 40 * 8.4, 10 * 16.8))


def test_tails_against_tables(spark):
    number = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert number(S.t_p_value(F.lit(2.228138852), F.lit(10.0))) == pytest.approx(0.05, abs=1e-8)
    assert number(S.t_p_value(F.lit(12.7062047362), F.lit(1.0))) == pytest.approx(0.05, abs=1e-8)
    for df, t in ((1.0, 12.7062047362), (2.0, 4.3026527297), (3.0, 3.1824463053), (30.0, 2.0422724563), (50_000.0, 1.9600114)):
        assert number(S.t_critical(0.975, F.lit(df))) == pytest.approx(t, abs=1e-6)
    assert number(S.t_critical(0.9995, F.lit(3.0))) == pytest.approx(12.92397864, abs=1e-6)
    assert number(S.chi2_p_value(F.lit(3.841458821))) == pytest.approx(0.05, abs=1e-8)
    assert math.isnan(number(S.t_p_value(F.lit(float("nan")), F.lit(4.0))))


def test_tails_against_integrals(spark):
    """Student's t by Simpson's rule over the angle, erfc and log gamma by the standard library."""

    def tail(t, df, n=40_000):
        a, b = math.atan(t / math.sqrt(df)), math.pi / 2
        f = lambda x: max(0.0, math.cos(x)) ** (df - 1)
        s = f(a) + (f(b) if df > 1 else 1.0) + sum((4 if i % 2 else 2) * f(a + i * (b - a) / n) for i in range(1, n))
        return 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * s * (b - a) / n / 3

    cases = [(t, df) for t in (0.01, 1.0, 1.96, 3.0, 12.0) for df in (1.0, 2.0, 7.0, 250.0, 19_999.0, 20_001.0)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", S.t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(r.p == pytest.approx(tail(r.t, r.df), rel=1e-6, abs=1e-9) for r in got)
    assert number_of(spark, S.t_p_value(F.lit(float("-inf")), F.lit(4.0))) == 0
    xs = [(v,) for v in (0.0, 1e-9, 0.3, 1.0, 2.499, 2.5, 4.0, 9.0, 25.0, 60.0)]
    for r in spark.createDataFrame(xs, "x double").select("x", S.erfc(F.col("x")).alias("e"), S.log_gamma(F.col("x") + 0.5).alias("g")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-15) and r.g == pytest.approx(math.lgamma(r.x + 0.5), abs=1e-11)


def number_of(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@given(st.integers(0, 11), st.integers(0, 11))
@settings(max_examples=10, deadline=None)
def test_mcnemar_is_symmetric(spark, b, c):
    p = lambda x, y: one(spark, S.mcnemar_exact_p(F.lit(x).cast("bigint"), F.lit(y).cast("bigint")))
    want = 1.0 if b + c == 0 else min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    assert p(b, c) == pytest.approx(want) == pytest.approx(p(c, b))


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=4, max_size=4), st.lists(st.lists(st.integers(0, 255), max_size=6), min_size=1, max_size=6))
@settings(max_examples=5, deadline=None)
def test_bands_equal_nested_loops(spark, words, flips):
    def flip(bits):
        out = [w & (2**64 - 1) for w in words]
        for b in bits:
            out[b // 64] ^= 1 << (b % 64)
        return [w - 2**64 if w >= 2**63 else w for w in out]

    t = spark.createDataFrame([(i, flip(f)) for i, f in enumerate(flips)], "train_id bigint, train_words array<bigint>")
    r = spark.createDataFrame([(0, words), (1, flip([0, 1, 2, 3, 4, 5, 6]))], "ref_id bigint, ref_words array<bigint>")
    near = lambda x, y: sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y))
    want = sorted((i, j, d) for i, f in enumerate(flips) for j, w in enumerate((words, flip([0, 1, 2, 3, 4, 5, 6]))) if (d := near(flip(f), w)) <= 4)
    # Rows without a hash match nothing; rows with equal hashes are rows of their own.
    t, r = t.union(spark.createDataFrame([(99, None)], t.schema)), r.union(spark.createDataFrame([(7, words), (8, None)], r.schema))
    want = sorted(want + [(i, 7, d) for i, j, d in want if j == 0])
    for join in (lambda: N.hamming_indexed(t, r, 4, 4, 256), lambda: N.hamming_cells(t, r, 4, 4), lambda: N.hamming_join(t, r, 4, 4, 256)):
        assert sorted(tuple(x) for x in join().collect()) == want


def test_probe_plans_lose_nothing(spark, monkeypatch):
    import random

    from tessera.operators import neighbours as N

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 14))) for b in base for _ in range(8)]
    t = spark.createDataFrame([(i, [signed(v)]) for i, v in enumerate(rows)], "train_id int, train_words array<bigint>")
    r = spark.createDataFrame([(str(i), [signed(v)]) for i, v in enumerate(base)], "ref_id string, ref_words array<bigint>")
    monkeypatch.setattr(N, "TRAIN_BLOCK", 7)
    monkeypatch.setattr(N, "REF_BLOCK", 5)
    for limit in (0, 1, 3, 7, 10, 12):
        want = sorted((i, str(j), (v ^ b).bit_count()) for i, v in enumerate(rows) for j, b in enumerate(base) if (v ^ b).bit_count() <= limit)
        assert sorted(map(tuple, N.hamming_indexed(t, r, limit, 1, 64).collect())) == want
        assert limit != 10 or sorted(map(tuple, N.hamming_cells(t, r, limit, 1).collect())) == want
    assert N.probe_plan(64, 22)[2] == 1.0 and N.hamming_cells(t.limit(0), r, 3, 1).count() == 0 and N.hamming_indexed(t, r.limit(0), 3, 1, 64).count() == 0


def test_knn_forms_agree(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(120)
    v = F.transform("embedding", lambda x: x.cast("double"))
    t = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("train_id"), v.alias("train_vec"))
    r = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("ref_id"), v.alias("ref_vec"))
    rows = lambda d: sorted((x.train_id, x["rank"], x.ref_id) for x in d.collect())
    want = rows(D.knn_columns(t, r, 5))
    for pivots in (1, 3, 64):
        assert rows(N.nearest(t, r, 5, pivots=pivots)) == want
    assert N.nearest(t, r.limit(2), 5).groupBy("train_id").count().agg(F.max("count")).first()[0] == 2  # no padding
    assert N.nearest(t, r.limit(0), 5).count() == 0 == N.nearest(t.limit(0), r, 5).count()
    # Equal vectors tie by id; clusters of their own are skipped by their bounds; rows without a vector have no neighbours.
    far = [(i, [float(10 * (i % 4 == k)) + 0.001 * (i // 8) for k in range(4)]) for i in range(64)] + [(100, [0.0] * 4), (101, None)]
    q, p = spark.createDataFrame(far, "train_id int, train_vec array<double>"), spark.createDataFrame(far[:64] + [(200 - i, v) for i, v in far[:20]], "ref_id int, ref_vec array<double>")
    assert rows(N.nearest(q, p, 3, pivots=8)) == rows(D.knn_columns(q.where("train_vec is not null"), p, 3))


def test_median_bits(spark):
    got = one(spark, V.sign_words(F.col("v"), 4), v=[1.0, 4.0, 2.0, 3.0])
    assert got == [0b0101]


def test_arithmetic_rank_of_any_key(spark):
    """Keys whose product with the multiplier passes 64 bits, as those of nine million orders do."""
    from tessera.functions.order import arithmetic_rank

    keys = [0, 1, 149_999_006, 8_999_999_006, 2**32 + 7, 2**63 - 1, -3, -(2**63)]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert {r.k: r.h for r in rows.select("k", arithmetic_rank(F.col("k"), 42).alias("h")).collect()} == {k: (k * 2654435761 + 42) % 2**32 for k in keys}


def test_block_scans_take_small_batches(spark):
    """Packed blocks are megabytes a row: the session gets a bound on batches, also a scan that meets many cells."""
    from tessera.sources.shared import BATCH_BYTES, BATCH_DEFAULT, BATCH_KEY

    before = spark.conf.get(BATCH_KEY, BATCH_DEFAULT)
    spark.conf.set(BATCH_KEY, BATCH_DEFAULT)
    rows = [(i, [float((i * p) % 7) for p in (1, 2, 3)]) for i in range(40)]
    t, r = spark.createDataFrame(rows, "train_id bigint, train_vec array<double>"), spark.createDataFrame(rows, "ref_id bigint, ref_vec array<double>")
    got = sorted((x.train_id, x["rank"], x.ref_id) for x in N.nearest(t, r, 4, pivots=5).collect())
    assert spark.conf.get(BATCH_KEY) == BATCH_BYTES
    assert got == sorted((x.train_id, x["rank"], x.ref_id) for x in D.knn_columns(t, r, 4).collect())
    spark.conf.set(BATCH_KEY, before)


def test_median_is_sorted_once_a_vector(spark):
    rows = spark.createDataFrame([([1.0, 4.0, 2.0, 3.0],)], "v array<double>").select(V.sign_words(F.col("v"), 64).alias("w"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1
