"""Fill-in-middle, packing and filter audit against brute force, with the odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from .test_operators import ODD, docs_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prose(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(120).collect()]


# ---- fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def fim_digests(doc_id, text):
    *rest, out = plain_fim(doc_id, text)
    return (doc_id, *rest, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_fill_in_middle(spark, prose):
    from tessera.llm.fim import transform_digests

    lines = ["\n", "\n\n", "a\n", "a\nb", "\na\n\nb\n", "é\n漢字\n😀 x\n", "<\n", "x <S>\ny", "<P", "a<S\nb", "z\r\n w\n", "\n".join("line %d" % i for i in range(50))]
    texts = ODD + lines * 4 + prose
    got = sorted(tuple(r) for r in transform_digests(docs_of(spark, texts)).collect())
    assert got == [fim_digests(i, t) for i, t in enumerate(texts)]
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd_tables(spark):
    from tessera.llm.fim import fill_in_middle, transform_digests

    assert transform_digests(docs_of(spark, [])).count() == 0
    rows = [(None, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (5, "a\nb\nc"), (5, "a\nb\nc"), (5, "a\nb\nc"), (5, "other\nlines\n"), (6, None)]
    docs = spark.createDataFrame([(*r, i, "x", i) for i, r in enumerate(rows)], "doc_id bigint, text string, n bigint, form string, _p int")
    assert Counter(tuple(r) for r in transform_digests(docs).collect()) == Counter(fim_digests(*r) for r in rows)
    kept = fill_in_middle(docs, keep=("_p",)).collect()
    assert sorted((r["_p"], r.output) for r in kept) == [(i, plain_fim(*r)[-1]) for i, r in enumerate(rows)]
    assert all(r.form == "plain" and r.output == (r.text or "") for r in fill_in_middle(docs.select("doc_id", "text"), percent=0).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id = 6").collect())


def test_fill_in_middle_long_texts(spark):
    from tessera.llm.fim import transform_digests

    texts = ["one line " * 100_000, "\n" * 60_000, "".join(f"{i}\n" for i in range(60_000))]
    assert sorted(tuple(r) for r in transform_digests(docs_of(spark, texts)).collect()) == [fim_digests(i, t) for i, t in enumerate(texts)]


# ---- packing


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, docs, window=2048):
    """Every id lies in exactly one piece, sequences are gapless and short enough; returns the share of padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc_id, len(ids), tuple(ids)] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for (doc_id, n, ids), copies in want.items():
        if sum(c for (d, _, _), c in want.items() if d == doc_id) != copies:
            continue
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        if copies == 1:
            assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()]
        assert sum(p[1] for p in pieces) == n * copies
        data = np.array(ids, "<u4")
        assert all(p[3] == n and p[2] == zlib.crc32(data[p[0] : p[0] + p[1]].tobytes()) for p in pieces)
    padded = total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()] and size <= window and all(r.length > 0 for r in pieces)
        total += size
        padded += 0 if size & (size - 1) == 0 else window - size
    return padded / max(1, total + padded)


def test_pack_sequences(spark, prose):
    from tessera.llm.packing import pack_sequences

    odd = ["word " * 9000, "x" * 30_000, "it's I'VE 12,3 a-b É,é Ｗ。次", "tab\tvt\x0bnb sp em.\r\nnext", "A<|endoftext|>b, <|ENDOFTEXT|>.", "…\n\n.", "café É.", "ÀÉ,;:\"quoted.\" (yes!)"]
    texts = [*ODD, *odd, *prose]
    docs = docs_of(spark, texts).repartition(3)
    rows = pack_sequences(docs, tokenizer_path()).collect()
    assert check_pieces(rows, list(enumerate(texts))) < 0.02
    small = pack_sequences(docs, tokenizer_path(), block_tokens=4096).collect()
    assert check_pieces(small, list(enumerate(texts))) < 0.02
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(r.doc_id, r.doc_tokens) for r in small}


def test_pack_odd_tables(spark):
    from tessera.llm.packing import pack_sequences

    assert pack_sequences(docs_of(spark, []), tokenizer_path()).count() == 0
    rows = [(None, "a b"), (None, None), (3, "same text."), (3, "same text."), (4, "")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id int, text string, start int, name string")
    got = pack_sequences(docs, tokenizer_path())
    assert got.schema["doc_id"].dataType.simpleString() == "int" and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = got.collect()
    check_pieces(found, rows)
    assert sum(r.length for r in found) == 3 + 1 + 4 + 4 + 1


def test_whole_text_tokenizer_agrees(spark, prose):
    """The path for tokenizers that are not made of words gives the same ids and nearly the same sentence ends."""
    import pyarrow as pa

    from tessera.llm import words
    from tessera.llm.textvec import column_bytes

    coder = words.WordIds(tokenizer_path())
    data, starts = column_bytes(pa.array([*ODD, *prose]))
    a, b = coder.encode(data, starts), coder._whole(words._strings(data, starts))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert len(set(a[2]) ^ set(b[2])) < 0.02 * len(a[2])


def test_best_cuts_are_best():
    from tessera.llm.packing import SEQUENCE_COST, best_cuts

    rng = random.Random(3)
    for _ in range(300):
        window = rng.choice([8, 16, 21])
        pos = np.cumsum([0] + [rng.randint(1, window) for _ in range(rng.randint(1, 40))])
        penalty = np.array([0] + [rng.choice([0, 3, 9]) for _ in pos[1:]])
        best = [0] + [None] * (len(pos) - 1)
        for j in range(1, len(pos)):
            costs = []
            for i in range(j):
                n = int(pos[j] - pos[i])
                if n <= window:
                    costs.append(best[i] + (0 if n & (n - 1) == 0 else window - n) + int(penalty[j]) + SEQUENCE_COST)
            best[j] = min(costs)
        cuts, cost = best_cuts(pos, penalty, window)
        assert cost == best[-1] and cuts[0] == 0 and cuts[-1] == len(pos) - 1
        sizes = np.diff(pos[cuts])
        assert sizes.max() <= window and cost == sum(0 if n & (n - 1) == 0 else window - n for n in sizes.tolist()) + penalty[cuts[1:]].sum() + SEQUENCE_COST * len(sizes)


# ---- filter audit


def plain_audit(rows, labels):
    texts = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            texts[text or ""].append(doc_id)
    failing = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > min(texts[t])}
        good, toxic = (any(x[0] == doc_id and x[k] == 1 for x in labels) for k in (1, 2))
        failing.append((lang or "", f, good and doc_id is not None, toxic and doc_id is not None))
    out = {}
    for part in {x[0] for x in failing}:
        share = Counter()
        steps = {}
        for order in itertools.permutations("ABCDE"):
            left = [x for x in failing if x[0] == part]
            for k, letter in enumerate(order):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                fails = sum(x[1][letter] for x in failing if x[0] == part)
                only = sum(x[1][letter] and sum(x[1].values()) == 1 for x in failing if x[0] == part)
                share[letter] += len(gone)
                steps["".join(order), k + 1] = (letter, len(left), len(gone), fails - len(gone), only, sum(x[2] for x in gone), sum(x[3] for x in gone))
        out |= {(part, *k): (*v[1:], share[v[0]]) for k, v in steps.items()}
    return out


def audit(spark, rows, labels):
    from tessera.llm.filter_audit import filter_interactions

    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, lang string, part string, n int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_interactions(docs, lab).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    return found


def test_filter_interactions(spark, prose):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [*ODD, *prose[:40], " ".join(words), " ".join(words[:100] * 3), " ".join(words).upper(), " ".join(words) + " $", "A" * 500, *([" ".join(words)] * 7), *(["x #"] * 5)]
    rows = [(i if rng.random() > 0.05 else None, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(3, "x #", "en"), (3, "x #", "en"), (3, "x #", "de"), (0, None, None)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audit(spark, rows, labels) == plain_audit(rows, labels)


def test_filter_audit_odd_tables(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    clean = " ".join(f"w{i}" for i in range(300))
    rows = [(1, clean, "en"), (2, clean + " x", None)]
    assert audit(spark, rows, []) == plain_audit(rows, [])
    assert set(audit(spark, rows, []).values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_long_texts_audit(spark):
    rows = [(1, "word " * 200_000, "en"), (2, "Ab#" * 300_000, "en"), (3, " ".join(map(str, range(100_000))), "en")]
    assert audit(spark, rows, []) == plain_audit(rows, [])


def test_integral_is_the_average_over_orders(spark):
    """5! times the integral equals the exact rational one, for random mask counts."""
    from pyspark.sql import functions as F

    from tessera.llm.filter_audit import FULL, coefficients, corners, diagonal_integral

    rng = random.Random(8)
    masks = [[rng.randint(0, 50) for _ in range(FULL)] for _ in range(5)]
    df = spark.createDataFrame([(m,) for m in masks], "m array<bigint>").withColumn("p", coefficients("m")).withColumn("r", corners("p"))
    for row in df.select("m", "r", F.array(*(diagonal_integral("p", F.lit(1 << i)) for i in range(5))).alias("s")).collect():
        assert row.r == [sum(c for m, c in enumerate(row.m) if m & t) for t in range(FULL)]
        assert row.s == [sum(Fraction(120 * c, m.bit_count()) for m, c in enumerate(row.m) if m >> i & 1) for i in range(5)]
