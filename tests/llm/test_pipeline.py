"""The pipeline's stages against what each must drop and keep."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_operators import components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "123 ...", "en", None, 7), (90_003, "The of and to in that is a.", None, None, 26)], docs.schema)
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    now, names = docs.unionByName(odd), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, DATA)
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        gone = set(before) - set(after)
        assert len(rows) == len(after) and set(after) <= set(before)
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "language_id":
            assert gone == {90_001, 90_002}
        if name == "near_dedup":
            ids = sorted(before)
            _, roots = components([before[i].text for i in ids], 5, 80)
            assert set(after) == {ids[r] for r in roots}
        if name == "decontamination":
            assert gone and all(any(b in before[i].text for b in bench) for i in gone)
            assert not any(b in r.text for r in rows for b in bench)
        if name == "pii":
            assert not gone and not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "mixing":
            assert all(0 < r.taken <= 3 * r.size for r in rows)
            total = sum(r.taken for r in rows)
            assert abs(total - sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before.values())) < 0.02 * total
        now = spark.createDataFrame(rows, out.schema)


def test_odd_rows_and_clashing_columns(spark):
    """Every stage carries columns of any name through, and handles nulls and repeated rows."""
    texts = {1: "the quick brown fox jumps over the lazy dog and runs far away from here", 2: "el perro corre por la casa y duerme en el jardín de la abuela", 5: "", 6: None, 7: "1 2 3 . ,"}
    clash = "score coverage size taken target source_size label id h bands kept lang_pred n_tiles item_id _id _row _i _key".split()
    rows = [(k, t, "en", "a", len(t or ""), *(f"{c}{k}" for c in clash)) for k, t in [*texts.items(), (1, texts[1]), (None, texts[2] + " hoy"), (None, texts[2] + " hoy"), (9, texts[1])]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(*r[:3], None if r[0] == 2 else r[3], *r[4:]) for r in rows], schema)
    want = {"language_id": [(None, 2), (1, 2), (2, 1), (9, 1)], "near_dedup": [(None, 1), (1, 1), (2, 1)], "decontamination": [(None, 1), (1, 1), (2, 1)], "pii": [(None, 1), (1, 1), (2, 1)]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if name in want:
            assert out.columns == docs.columns
            counts = {}
            for r in rows:
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            assert sorted(counts.items(), key=str) == sorted(want[name], key=str), name
        else:
            assert set(out.columns) == set(docs.columns) and all(isinstance(r.taken, int) for r in rows)
        assert all(r.score == f"score{r.doc_id or 9}" or r.doc_id is None for r in rows)
        docs = spark.createDataFrame(rows, out.schema)


def test_run_equals_stages(spark):
    a = corpus_pipeline.run(spark, DATA)
    assert a.count() > 100 and a.agg(F.countDistinct("doc_id")).first()[0] == a.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_queries_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
