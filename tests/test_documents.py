"""JSON documents by byte ranges, ordered sinks."""

import json
import pickle
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import json_elements as J
from tessera.sources.json_elements import MalformedDocument, read_elements

WORDS = ["", "a", '"', "\\", '\\"', "{", "}]", ",", ":", "é漢😀", '","x":[', "\\\\", "\n\t", "null"]


def value(rng, deep=0):
    k = rng.randint(0, 5 if deep < 3 else 3)
    if k <= 1:
        return "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
    if k == 2:
        return rng.choice([None, True, 1.5, -3])
    if k == 3:
        return rng.randint(0, 10**6)
    return [value(rng, deep + 1) for _ in range(rng.randint(0, 4))] if k == 4 else {rng.choice(WORDS) + str(i): value(rng, deep + 1) for i in range(rng.randint(0, 4))}


def elements(spark, path, text, field=None, chunk=37):
    path.write_text(text, encoding="utf-8")
    rows = sorted(read_elements(spark, str(path), field, chunk).collect(), key=lambda r: r.offset)
    return [(r.key, json.loads(r.value)) for r in rows]


def test_elements_of_random_documents(spark, tmp_path):
    rng = random.Random(7)
    for i in range(6):
        indent, ascii_only = rng.choice([None, 1]), rng.random() < 0.5
        items = [value(rng) for _ in range(rng.randint(0, 30))]
        text = json.dumps(items, indent=indent, ensure_ascii=ascii_only)
        chunk = rng.choice([5, 16, 64, 1 << 20])
        assert elements(spark, tmp_path / "d.json", text, chunk=chunk) == [(None, x) for x in items]
        members = {rng.choice(WORDS) + str(k): x for k, x in enumerate(items)}
        assert elements(spark, tmp_path / "d.json", " \n" + json.dumps(members, indent=indent, ensure_ascii=ascii_only) + "\n", chunk=chunk) == list(members.items())
        doc = {"info": value(rng), "rows": items, 'ro"ws': ["x"], "x": {"rows": [1]}, "zz": members}
        text = json.dumps(doc, indent=indent, ensure_ascii=ascii_only)
        assert elements(spark, tmp_path / "d.json", text, "rows", chunk) == [(None, x) for x in items]
        if i < 2:
            assert elements(spark, tmp_path / "d.json", text, "zz", chunk) == list(members.items())
            assert elements(spark, tmp_path / "d.json", text, 'ro"ws', chunk) == [(None, "x")]
            assert elements(spark, tmp_path / "d.json", text, "none", chunk) == []


def test_odd_documents(spark, tmp_path):
    for text, want in [("[]", []), (" [ ] ", []), ("{}", []), ("[[]]", [(None, [])]), ("[1]", [(None, 1)]), ("﻿[1, 2]", [(None, 1), (None, 2)])]:
        for chunk in (1, 2, 100):
            assert elements(spark, tmp_path / "o.json", text, chunk=chunk) == want, (text, chunk)
    for text, want in [('{"a": null}', []), ('{"a": [], "b": 1}', []), ('{"a":[1],"a":[2,3]}', [(None, 2), (None, 3)]), ('{"b":{"a":[9]},"a" : [ {"a":[1]} ] }', [(None, {"a": [1]})])]:
        for chunk in (3, 100):
            assert elements(spark, tmp_path / "o.json", text, "a", chunk) == want, (text, chunk)


@pytest.mark.parametrize("text", ["", "   ", "[1, 2", "[1]]", "[1] [2]", '["a]', '{"a": 1', "[1,,2]", "[1,]", "[,1]", '{"a":1,}', "{1}", "7", '[1}', '{"a":[1}'])
def test_malformed_documents_raise(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    for chunk in (2, 100):
        with pytest.raises(Exception, match="(?i)malformed|MalformedDocument"):
            read_elements(spark, str(tmp_path / "m.json"), chunk=chunk).collect()


def test_missing_and_wrong_members(spark, tmp_path):
    assert S.read_member(spark, str(tmp_path / "no.json"), "a", "x int").count() == 0
    assert S.read_keyed_object(spark, str(tmp_path / "no.json"), "x int").count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_member(spark, str(tmp_path / "no.json"), "a", "x int", missing_ok=False)
    (tmp_path / "w.json").write_text('{"a": 5, "b": [{"x": 1}, {"x": "y"}]}')
    with pytest.raises(MalformedDocument):
        S.read_member(spark, str(tmp_path / "w.json"), "a", "x int")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_member(spark, str(tmp_path / "w.json"), "b", "x int").collect()


def test_large_document_is_many_tasks(spark, tmp_path):
    """64 MB, read by at least 8 tasks, equal to the parser's view of the whole; an element larger than a range too."""
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write('{"info": {"annotations": 1}, "annotations": [')
        n = 0
        while f.tell() < 64 << 20:
            f.write(("," if n else "") + json.dumps({"image_id": n, "bbox": [n % 7, 1, 2, 3], "note": 'x"],[{' * 200}))
            n += 1
        f.write(',{"image_id": -1, "note": "' + "y" * (20 << 20) + '"}], "images": []}')
    rows = S.read_member(spark, str(path), "annotations", "image_id bigint, bbox array<double>, note string")
    assert rows.rdd.getNumPartitions() >= 8
    got = rows.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("image_id").alias("s"), F.sum(F.col("bbox")[0]).alias("b"), F.max(F.length("note")).alias("longest"), F.countDistinct("task").alias("tasks")).first()
    assert (got.n, got.s, got.b, got.longest) == (n + 1, n * (n - 1) // 2 - 1, sum(k % 7 for k in range(n)), 20 << 20) and got.tasks >= 8
    order = [r.image_id for r in rows.orderBy("pos").select("image_id").collect()]
    assert order == [*range(n), -1]


def test_ranges_do_not_carry_each_other(spark, tmp_path):
    """A task gets its own range, not the list of all; a large document has a bounded number of ranges."""
    reader = lambda n: J._ElementReader({"path": "p", "states": json.dumps([(i, i + 1, False, 1) for i in range(n)]), "level": 1, "begin": 0, "end": n, "keyed": "false"})
    assert len(pickle.dumps(reader(5000))) == len(pickle.dumps(reader(4999))) and len(reader(5000).partitions()) == 5000
    with (tmp_path / "sparse").open("wb") as f:
        f.truncate(40 << 30)
    found = J._ranges(str(tmp_path / "sparse"), 2 << 20)
    assert len(found) <= J.MOST_RANGES and found[-1][1] == 40 << 30


def test_two_members_by_one_index(spark, tmp_path, monkeypatch):
    """Blocks of a few bytes inside ranges, escapes and brackets in strings; only ranges at the top level are searched."""
    monkeypatch.setattr(J, "BLOCK", 7)
    rng, path = random.Random(3), tmp_path / "two.json"
    for chunk in (5, 30, 1000):
        doc = {"a": [value(rng) for _ in range(20)], "x": {"b": [1], "a": 2}, "b": [value(rng) for _ in range(20)], "c": [[i] for i in range(30)]}
        path.write_text(json.dumps(doc), encoding="utf-8")
        index = J._IndexReader({"path": str(path), "chunk": str(chunk)})
        states, tops, inside, depth = [], [], False, 0
        for begin, end, quotes, *depths, low, low_inside in (r for p in index.partitions() for r in index.read(p)):
            states.append((begin, end, inside, depth))
            tops += [begin] if depth + (low_inside if inside else low) <= 1 else []
            depth, inside = depth + depths[inside], inside ^ (quotes % 2 == 1)
        assert depth == 0 and not inside and (chunk > 30 or len(tops) < len(states) / 2)
        first, last = path.read_text().index("[", path.read_text().index('"c": ')), len(path.read_text()) - 2
        read = J._ElementReader({"path": str(path), "states": json.dumps(states), "level": 2, "begin": first, "end": last, "keyed": "false"})
        assert [json.loads(v) for p in read.partitions() for b in read.read(p) for v in b.column("value").to_pylist()] == doc["c"]
        found = J.read_containers(spark, str(path), ["a", "b", "none"], chunk)
        for field in ("a", "b"):
            assert [json.loads(r.value) for r in sorted(found[field].collect(), key=lambda r: r.offset)] == doc[field]
        assert found["none"].count() == 0


def test_ordered_sinks(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.concat(F.lit('"a,\n'), F.col("id").cast("string")).alias("answer"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    want = [{"k": r.k, "answer": r.answer, "n": r.n} for r in rows.orderBy("k").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    for _ in range(2):  # a second attempt leaves one valid array
        manifest = S.write_json_array(rows, "k", str(tmp_path / "out"))
        (file,) = [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
        assert json.loads(file.read_text()) == want and len(manifest) > 3
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(Exception, match="boom"):
        S.write_json_array(rows.withColumn("n", F.raise_error(F.lit("boom"))), "k", str(tmp_path / "out"))
    assert json.loads(file.read_text()) == want
    S.write_json_array(rows.limit(0), "k", str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / "part-00000.json").read_text()) == []
    S.write_keyed_object(rows.select(F.concat(F.lit('q"'), F.col("k").cast("string")).alias("k"), "n"), "k", str(tmp_path / "keyed.json"))
    assert json.loads((tmp_path / "keyed.json").read_text()) == {f'q"{r["k"]}': {"n": r["n"]} for r in want}
    back = S.read_keyed_object(spark, str(tmp_path / "keyed.json"), "n bigint", chunk=1000)
    assert {(r.id, r.value.n) for r in back.collect()} == {(f'q"{r["k"]}', r["n"]) for r in want}
