import random

import numpy as np

from tidemark.llm import decontaminate

from .conftest import prose


def smith_waterman(x, y):
    h, best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)], 0
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    r = random.Random(1)
    make = lambda n: np.array([r.randrange(5) * 4 + 100 for _ in range(n)], np.uint64)
    q, p = [make(r.randrange(1, 20)) for _ in range(200)], [make(r.randrange(1, 40)) for _ in range(200)]
    assert decontaminate.align(q, p)[0].tolist() == [smith_waterman(list(a), list(b)) for a, b in zip(q, p)]


def test_pairs_equal_brute_force(spark, data):
    """Every document against every item of the test table by whole alignment: nearly all pairs are found, and none else."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()
    r = random.Random(12)
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    for i, (d, b) in enumerate(zip(list(texts)[:160], items * 20)):  # more copies, from whole to less than half
        w = (b["text"] or "").split()
        w = [x if r.random() > 0.06 * (i % 7) else f"changed{r.randrange(999)}" for x in w]
        texts[d] += " " + " ".join(w) + " and so on"
    split = {k: decontaminate.words(decontaminate.pa.array([t]))[1] for k, t in texts.items()}
    want = {}
    for b in items:
        q = decontaminate.words(decontaminate.pa.array([b["text"] or ""]))[1]
        if len(q) >= decontaminate.MIN_WORDS:
            score, _ = decontaminate.align([q] * len(split), list(split.values()))
            want.update({(d, b["item_id"]): s / (2 * len(q)) for d, s in zip(split, score) if s / (2 * len(q)) >= 0.5})
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(b["item_id"], b["text"]) for b in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(frame, bench).collect()}
    assert set(got) <= set(want) and len(want) > 50
    assert len(got) >= 0.97 * len(want)
    assert all(got[k] <= want[k] + 1e-9 for k in got) and sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.97 * len(got)


def test_short_items_are_phrases(docs_of, spark):
    r = random.Random(10)
    texts = [f"{prose(r, 20)} Zanzibar-Quux, {prose(r, 20)}", f"{prose(r, 10)} one two three four five {prose(r, 10)}", f"{prose(r, 9)} one two three four {prose(r, 9)}", "quux zanzibar 日本語テスト", *[f"{prose(r, 30)} of the" for _ in range(120)]]
    bench = spark.createDataFrame([("a", "zanzibar quux"), ("b", "One two three four five"), ("c", "of the"), (None, "日本語テスト"), ("d", "two three four")], "item_id string, text string")
    got = {(x["doc_id"], x["item_id"], x["score"]) for x in decontaminate.contaminated(docs_of(texts), bench).collect()}
    assert got == {(0, "a", 1.0), (1, "b", 1.0), (1, "d", 1.0), (2, "d", 1.0), (3, None, 1.0)}


def fresh(r, n):
    return [f"w{r.randrange(10**7)}" for _ in range(n)]


def test_copies_are_found_and_clean_documents_are_not(docs_of, spark, odd_texts):
    r = random.Random(6)
    items = [fresh(r, 30) for _ in range(20)]
    texts, want = list(odd_texts), set()
    for i, item in enumerate(items):
        w = list(item)
        if i % 3 == 1:  # every sixth word replaced
            w = [x if k % 6 else "changed" for k, x in enumerate(w)]
        if i % 3 == 2:  # words dropped and put in, other case and signs
            w = [x.upper() + "," for k, x in enumerate(w) if k % 9] + ["more"]
        want.add((len(texts), i))
        texts.append(f"{prose(r, 50)} {' '.join(w)} {prose(r, 300)}")
        texts.append(f"{prose(r, 50)} {' '.join(item[:6])} {prose(r, 60)}")  # a fifth of an item
    bench = spark.createDataFrame([*[(i, " ".join(w), "x") for i, w in enumerate(items)], (90, None, "x"), (91, "", "x"), (92, "the garden of", "x"), (93, "...", "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, score string")
    docs = docs_of(texts)
    got = decontaminate.contaminated(docs, bench).collect()
    got = [x for x in got if x["item_id"] != 92]  # a short item is a phrase
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    assert all(0.5 <= x["score"] <= 1 for x in got)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.union(docs), bench.filter("item_id <> 92")).count() == 2 * len(want)


def test_common_passages_keep_seeds(docs_of, spark):
    """An item that is in every document is still found in all of them, and groups of items give the same."""
    r = random.Random(8)
    item, other = fresh(r, 25), fresh(r, 40)
    docs = docs_of([f"{prose(r, 20)} {' '.join(item)} {prose(r, 20)}" for _ in range(40)] + [" ".join(other)])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert len(want) == 41
    old, decontaminate.MAX_ITEM_WORDS = decontaminate.MAX_ITEM_WORDS, 100
    try:
        assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want
    finally:
        decontaminate.MAX_ITEM_WORDS = old


def test_edited_copies_beside_whole_ones(docs_of, spark):
    """The n-grams that an edit spares are more frequent than those it breaks; they must be seeds all the same."""
    r = random.Random(9)
    item = fresh(r, 30)
    edited = [x if k % 5 else "changed" for k, x in enumerate(item)]
    docs = docs_of([f"{prose(r, 20)} {' '.join(w)} {prose(r, 20)}" for w in [item, *[edited] * 12]])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 13
