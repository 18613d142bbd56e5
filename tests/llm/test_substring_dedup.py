import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import substring_dedup

from .conftest import prose


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        out.append((len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep) if y).decode()))
    return out


@pytest.mark.parametrize("window,anchor", [(35, 8), (10, 3), (6, 6)])
def test_equals_brute_force(docs_of, odd_texts, window, anchor):
    r = random.Random(window)
    passage, line = prose(r, 60), prose(r, window)
    texts = [*odd_texts[:7], *odd_texts[9:], passage, f"{prose(r, 30)} {passage} {prose(r, 40)}", f"{passage} {passage}", line, line + " x", "y " + line, prose(r, 300), " ".join(["a b"] * 60), " ".join(["a"] * window)]
    got = substring_dedup.remove(docs_of(texts), window=window, anchor=anchor).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, window)


def test_longer_prefixes_for_frequent_anchors(docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 2)
    r = random.Random(3)
    passage = prose(r, 20)
    texts = [f"{prose(r, 9)} {passage} {prose(r, r.randrange(20))}" for _ in range(12)] + ["a b c d " * 9]
    got = substring_dedup.remove(docs_of(texts), window=12, anchor=4).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in got] == brute(texts, 12)


def test_null_and_shared_ids(docs_of):
    """Rows without an id are compared, and so are different texts under one id, of any type."""
    r = random.Random(13)
    a, b, c = (prose(r, 50) for _ in "abc")
    rows = [(None, f"x {a}"), ("8", f"{a} y z"), (None, prose(r, 90)), ("7", f"{b} one"), ("7", f"{prose(r, 120)} {b} two {c}"), ("9", c), (None, None), (None, "")]
    docs = docs_of([]).sparkSession.createDataFrame(rows, "doc_id string, text string")
    got = collections.Counter(tuple(x)[1:] for x in substring_dedup.remove(docs).collect())
    assert got == collections.Counter(brute([t for _, t in rows], 35))


def test_words_alike_in_32_bits(docs_of):
    """Two words whose low 32 bits agree make windows that aren't equal."""
    words = [f"id{i}" for i in range(260_000)]
    h = substring_dedup._words(substring_dedup.pa.array([" ".join(words)]))[1] & np.uint64(0xFFFFFFFF)
    order = np.argsort(h, kind="stable")
    k = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    assert len(k)
    one, two = words[order[k[0]]], words[order[k[0] + 1]]
    r = random.Random(14)
    shared = prose(r, 34).split()
    texts = []
    for at in (0, 5, 17, 34):
        texts += [" ".join([f"u{at}{w}" for w in shared[:at]] + [w] + [f"u{at}{w}" for w in shared[at:]]) for w in (one, two)]
    texts += [f"{one} {prose(r, 40)}", f"{two} {prose(r, 40)}"]
    got = substring_dedup.remove(docs_of(texts)).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in got] == brute(texts, 35) and not any(x["n_removed"] for x in got)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(2, 7))
def test_deepest_nodes(rows, window):
    symbols = np.array([x for row in rows for x in row], np.uint32)
    left = np.array([len(row) - i for row in rows for i in range(len(row))])
    paths = [tuple(row[i : i + window]) if len(row) - i >= window else None for row in rows for i in range(len(row))]
    seen = collections.Counter(p for p in paths if p)
    want = [p is not None and seen[p] > 1 for p in paths]
    assert substring_dedup.deepest(symbols, left, window).tolist() == want
    # a symbol that stands for two words: labels tell the windows apart
    labels = np.array([0 if p is None else hash(p) & 0xFFFFFFFF for p in paths], np.uint64)
    assert substring_dedup.deepest(symbols // 2, left, window, labels).tolist() == want


def test_long_repeated_and_empty(docs_of, odd_texts):
    docs = docs_of(odd_texts)
    got = {r["doc_id"]: r for r in substring_dedup.remove(docs).collect()}
    assert got[7]["n_removed"] == got[8]["n_removed"] == got[7]["n_words"] == 60_000
    twice = substring_dedup.remove(docs.union(docs)).filter("doc_id = 13").collect()
    assert len(twice) == 2 and all(r["n_removed"] == r["n_words"] == 200 for r in twice)
    assert substring_dedup.remove(docs.limit(0)).count() == 0


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r["text"] for r in docs], 35)
    got = substring_dedup.query(spark, data).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(d["doc_id"], n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, want)]


@pytest.mark.parametrize("one_id", [None, 7])
def test_a_hundred_thousand_equal_rows(spark, one_id):
    """In linear time; another document that shares a window with them loses it, and short equal rows keep their words."""
    import time

    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(45)]
    rows = [(1, " ".join(words[:40] + ["x"] * 5)), (2, " ".join(f"v{i}" for i in range(50)))]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.range(150_000).select(F.lit(one_id).cast("long").alias("doc_id"), F.when(F.col("id") < 100_000, " ".join(words)).otherwise("too short").alias("text"))
    began = time.time()
    got = {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in substring_dedup.remove(few.unionByName(many)).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert got == {(one_id, 45, 45): 100_000, (one_id, 2, 0): 50_000, (1, 45, 40): 1, (2, 50, 0): 1}
    assert time.time() - began < 120


def test_rows_repeated_less_often(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(300))
    many = spark.range(900).select(F.lit(3).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(5)
    got = substring_dedup.remove(many.unionByName(spark.createDataFrame([(3, "other " + text), (4, "short")], "doc_id long, text string"))).groupBy("n_words", "n_removed").count().collect()
    assert {(r.n_words, r.n_removed): r["count"] for r in got} == {(300, 300): 900, (301, 300): 1, (1, 0): 1}
