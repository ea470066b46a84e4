"""Hostile pages and line alignment."""

import random
import time

import pytest

from tessera.llm import html_text as H

MB = 1_000_000
HOSTILE = {
    "end tags of elements that are not open": "<b>" * (MB // 7) + "</i>" * (MB // 9),
    "end tags of an element outside the block": "<i><div>" + "<b>" * (MB // 7) + "</i>" * (MB // 9),
    "sections that are not open": "<div>" * (MB // 12) + "</section>" * (MB // 17),
    "unclosed tags": "<a " * (MB // 3),
    "unclosed tags with quotes": '<a "' * (MB // 4),
    "unclosed tags after a closed one": "<p>x</p>" + "<a " * (MB // 3),
    "list items in inline elements": "<li><b>" * (MB // 7),
    "paragraphs": "<p>" * (MB // 3),
    "open comments": "<!--" * (MB // 4),
    "broken comments": "<!-" * (MB // 3),
    "many class attributes": "<a " + "class= " * (MB // 7) + ">",
    "a long character reference": "&#" + "9" * MB,
    "ampersands": "&" * MB,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_page_takes_linear_time(name):
    began = time.process_time()
    for _, _, raw in H.page_blocks(HOSTILE[name]):
        H.clean(raw)
    assert time.process_time() - began < 3


def test_alternating_lines_take_little_time():
    began = time.process_time()
    assert len(H.common_lines([1, 2] * (MB // 8), [2, 1] * (MB // 8))) == MB // 4 - 1
    rng = random.Random(2)
    a, b = ([rng.randint(0, 1) for _ in range(20_000)] for _ in range(2))
    assert len(H.common_lines(a, b)) > 14_000
    assert time.process_time() - began < 3


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignments_are_longest(monkeypatch):
    rng = random.Random(1)
    for few, held in ((64, 1 << 26), (0, 1 << 26), (0, 40), (2, 40)):
        monkeypatch.setattr(H, "HELD_BITS", held)
        monkeypatch.setattr(H, "FEW_EDITS", few)
        monkeypatch.setattr(H._few_edits, "__defaults__", (few,))
        for _ in range(400):
            k = rng.randint(1, 6)
            a, b = ([rng.randint(0, k) for _ in range(rng.randint(0, 14))] for _ in range(2))
            pairs = H.common_lines(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            assert len(pairs) == longest(a, b)


def test_odd_markup():
    text = lambda page: [H.clean(t) for _, _, t in H.page_blocks(page)]
    assert text("<p>a<li>b<p>c</b>d</i></p>e<!-- x > y") == ["a", "b", "cd", "e"]
    assert text("a <b>c</p> d <a href='>'>e</a> <!-- > --> f <a ") == ["a c", "d e f <a"]
    assert text("x<!doctype y") == ["x"] and text("x < y > z") == ["x < y > z"]
    assert text("&#0000000000065; &#99999999999999999999; &#x41;") == ["A � A"]


def test_pages_of_hostile_lines(spark):
    lines = "".join(f"<p>{'ab'[i % 2]}" for i in range(60_000))
    rows = [(1, "http://h/a/1", lines), (2, "http://h/a/2", "<p>b" + lines), (3, "http://h/a/3", HOSTILE["unclosed tags with quotes"]), (4, "http://h/a/4", HOSTILE["sections that are not open"] + "<p>end")]
    got = {r.page_id: r.n_chars for r in H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] > 0 and got[4] >= 3


def test_page_ends_that_are_not_sent(spark, monkeypatch):
    """The same texts whether the pages at partition ends are sent to every task or joined by shuffling."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(120)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    want = sorted(map(tuple, H.extract_main_text(pages).collect()))
    monkeypatch.setattr(H, "MOST_SENT", -1)
    assert sorted(map(tuple, H.extract_main_text(pages).collect())) == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
