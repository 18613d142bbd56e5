import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.components import components

from .conftest import prose


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 40))] for _ in "ab")
        assert near_dedup.common(a, b, 50) == lcs(a, b)
        c = list(range(60))
        d = [x for x in c if r.random() > 0.1]
        assert near_dedup._by_blocks(c, d, 60) == len(d)
        p, q = np.array(c, np.uint64), np.array(d, np.uint64)
        s = len(d) / len(c)
        assert abs(near_dedup.aligned(p, q) - (s if s >= near_dedup.SIMILARITY else 0)) < 1e-9 or s < near_dedup.SIMILARITY


def banded(a, b, band):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + 1 if x == y and abs(i - j) <= band else 0)
    return t[-1][-1]


def test_alignment_of_long_and_repeated_texts(monkeypatch):
    r = random.Random(4)
    body = [r.randrange(10**9) for _ in range(6000)]
    for a in (body + body, [r.randrange(40) for _ in range(9000)]):
        b = list(a)
        for i in range(500, len(b), 1500):
            b[i] = -i - 1
        p, q = (np.array(x, np.int64).astype(np.uint64) for x in (a, b))
        k = len(a) - len(range(500, len(b), 1500))  # the changed ones are nowhere in the other
        assert abs(near_dedup.aligned(p, q) - k / (2 * len(a) - k)) < 1e-9
    monkeypatch.setattr(near_dedup, "LONG", 0)
    monkeypatch.setattr(near_dedup, "NARROW", 3)
    for _ in range(150):
        a, b = ([r.randrange(9) for _ in range(r.randrange(1, 260))] for _ in "ab")
        for band in (0, 2, 40, 300):
            assert near_dedup.common(a, b, band) == banded(a, b, band)
        assert near_dedup._common(a, b, 300) == lcs(a, b)


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(texts):
    """Components of all pairs with aligned similarity of 0.8 and of equal texts."""
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    grams = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in map(words, texts)]
    for i in range(len(texts)):
        for j in range(i):
            n, m = len(grams[i]), len(grams[j])
            same = (texts[i] or "").strip() == (texts[j] or "").strip()
            if not same and n and m and min(n, m) >= 0.8 * max(n, m):
                k = lcs(grams[i], grams[j])
                same = k / (n + m - k) >= 0.8
            if same:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def family(r, n):
    """A text and copies with one word in 60 changed: each like the first, not all like each other."""
    base = prose(r, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return [*out[: n // 2], " ".join(base), *out[n // 2 :]]


def test_classes_equal_brute_force(docs_of, odd_texts):
    r = random.Random(11)
    texts = [*[t for t in odd_texts if t is None or len(t) < 5000], *family(r, 12), *family(r, 5), *[prose(r, 100) for _ in range(25)]]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_split_buckets_give_the_same(docs_of):
    r = random.Random(12)
    docs = docs_of([*family(r, 30), *[prose(r, 60) for _ in range(10)]])
    want = sorted(map(tuple, near_dedup.near_classes(docs).collect()))
    old, near_dedup.BUCKET = near_dedup.BUCKET, 6
    try:
        assert sorted(map(tuple, near_dedup.near_classes(docs).collect())) == want
    finally:
        near_dedup.BUCKET = old


def licensed(r, pairs, others):
    """Texts that share a passage, each 0.7 to 0.79 like any other, and pairs of 0.8 and more among them."""
    shared = [f"licence{i}" for i in range(175)]
    own = lambda n: [f"own{r.randrange(10**9)}" for _ in range(n)]
    out = [" ".join(shared + own(23)) for _ in range(others)]
    for _ in range(pairs):
        more = own(3)
        out += [" ".join(shared + more + own(20)) for _ in "ab"]
    return r.sample(out, len(out))


def all_pairs(texts):
    """Classes by aligning all pairs."""
    grams = [near_dedup.shingles(near_dedup.pa.array([t]))[1] for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and near_dedup.aligned(grams[i], grams[j]) >= near_dedup.SIMILARITY:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    return up


def test_pairs_among_texts_of_one_passage(docs_of):
    r = random.Random(5)
    texts = [*licensed(r, 24, 90), *family(r, 4)]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(docs_of(texts)).collect()}
    want = all_pairs(texts)
    assert len(set(want)) == 24 + 90 + 1
    assert [got[i] for i in range(len(texts))] == want


def test_pairs_in_different_parts_of_a_bucket(docs_of, monkeypatch):
    r = random.Random(6)
    texts = [*licensed(r, 24, 60), *family(r, 20)]
    monkeypatch.setattr(near_dedup, "BUCKET", 6)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == all_pairs(texts)


def test_odd_input(docs_of, odd_texts):
    docs = docs_of(odd_texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got[1] == got[2] == got[0] == 0 and got[4] == 3 and got[8] == 7 and len(got) == len(odd_texts)
    assert near_dedup.near_classes(docs.union(docs)).count() == 2 * len(odd_texts)
    assert near_dedup.near_classes(docs.limit(0)).count() == 0
    nameless = docs.selectExpr("if(doc_id in (7, 13), null, doc_id) as doc_id", "text", "1 as rep", "2 as key", "3 as _id")
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.near_classes(nameless).collect())
    assert ("None", "8") in got and ("8", "8") in got and ("None", "None") in got
    assert near_dedup.one_of_each(docs.union(docs)).count() == len(set(map(str, near_dedup.near_classes(docs).select("class_id").collect())))


def test_ids_of_any_kind(docs_of):
    """String ids, null ids with near copies, and different texts under one id."""
    r = random.Random(8)
    texts = [*family(r, 3), *[prose(r, 80) for _ in range(4)]]
    names = ["b", "a", None, None, "c", "c", None, "d"]
    docs = docs_of([]).sparkSession.createDataFrame(list(zip(names, texts, strict=True)), "doc_id string, text string")
    got = sorted((tuple(x) for x in near_dedup.near_classes(docs).collect()), key=str)
    assert got == sorted(((n, "a" if i < 4 else n) for i, n in enumerate(names)), key=str)
    kept = near_dedup.one_of_each(docs).collect()
    assert sorted(map(str, (k["doc_id"] for k in kept))) == ["None", "a", "c", "c", "d"]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
