"""Quality ranking and toxicity: held-out accuracy, calibration, odd input."""

import random

import numpy as np
import pytest

from tidemark.llm import quality_ranking, toxicity

from .conftest import prose


def auc(y, p):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def corpus(docs_of, spark, bad, n=240):
    r = random.Random(2)
    y = [i % 3 == 0 for i in range(n)]
    texts = [bad(r, prose(r, 40)) if k else prose(r, 40) for k in y]
    return docs_of(texts), spark.createDataFrame([(i, int(not k), int(k)) for i, k in enumerate(y)], "doc_id long, quality int, toxic int"), np.array(y)


def held_out(got, y):
    got = got.toPandas().set_index("doc_id")["score"]
    at = [i for i in range(len(y)) if i >= 160]
    return y[at].astype(int), got[at].to_numpy()


def test_quality_held_out(docs_of, spark):
    docs, labels, bad = corpus(docs_of, spark, lambda r, t: t.upper().replace(" ", "!! "))
    y, p = held_out(quality_ranking.rank(docs, labels.filter("doc_id < 160")), ~bad)
    assert auc(y, p) > 0.99 and ((p >= quality_ranking.AT_THRESHOLD) == (y == 1)).mean() > 0.97


def test_toxicity_held_out(docs_of, spark):
    docs, labels, bad = corpus(docs_of, spark, lambda r, t: t + " you " + r.choice(["idiot", "1diot", "moron", "grobnik"]))
    y, p = held_out(toxicity.detect(docs, labels.filter("doc_id < 160")), bad)
    assert auc(y, p) > 0.97 and ((p >= 0.5) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("run,label", [(quality_ranking.rank, "quality"), (toxicity.detect, "toxic")])
def test_odd_input(run, label, docs_of, odd_texts, spark):
    docs = docs_of(odd_texts)
    rows = [(i, i % 2, i % 2) for i in range(len(odd_texts))] + [(3, None, None), (None, 1, 1), (5, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for own in (labels, labels.filter("quality = 1"), labels.limit(0)):
        got = run(docs, own, keep=("doc_id", "label"))
        assert got.count() == len(odd_texts) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert run(docs.limit(0), labels).count() == 0


def test_isotonic_and_trees():
    m = np.array([0.0, 1, 2, 3, 4, 5])
    knots, values = toxicity.isotonic(m, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(values) > 0).all() and values[0] == 0 and values[-1] == 1 and abs(values[1] - 1 / 3) < 1e-9
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert auc(y, toxicity.grow(x, y).margin(x)) > 0.98


def test_best_split_equals_brute_force(monkeypatch):
    """The first split of a tree is the one of most gain among all features and bin edges."""
    monkeypatch.setattr(toxicity, "TREES", 1)
    rng = np.random.default_rng(3)
    for _ in range(10):
        x, y = rng.integers(0, 9, (120, 4)).astype(float), (rng.random(120) < 0.4).astype(float)
        trees = toxicity.grow(x, y)
        p = y.mean()
        g, h = y - p, np.full(len(y), p * (1 - p))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + toxicity.L2)
        best = 0.0
        for f in range(4):
            for edge in trees.edges[f]:
                left = x[:, f] <= edge
                if left.sum() >= toxicity.LEAST and (~left).sum() >= toxicity.LEAST:
                    best = max(best, score(left) + score(~left) - score(left | True))
        f, cut = trees.feature[0, 0], trees.cut[0, 0]
        left = np.searchsorted(trees.edges[f], x[:, f], "left") <= cut
        assert abs(score(left) + score(~left) - score(left | True) - best) < 1e-9


def test_words_are_learned_without_their_fold(docs_of, spark):
    """A word in toxic rows of one fold alone is learned for the other folds and not for that one."""
    keys = spark.range(400).select("id", toxicity.fold_of("id").alias("f")).collect()
    own = [r["id"] for r in keys if r["f"] == 2][:12]
    r = random.Random(1)
    docs = docs_of([prose(r, 20) + (" grobnik" if i in own else "") for i in range(400)])
    labels = spark.createDataFrame([(i, int(i in own or i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    word = toxicity._hashes(["grobnik"])[0]
    found = [word in x for x in toxicity.lexicons(docs, labels, "doc_id", "text", "toxic", 1000)]
    assert found == [True, True, False, True, True]


def test_long_obfuscated_words():
    text = "a " + "x" * 60 + " " + "i.d.i.o.t"
    long = ".".join("moron") + "." * 60 + "s"
    x = toxicity._obfuscated(toxicity._features.Slice(toxicity.pa.array([text, long, ""])))
    assert x[1].tolist() == [1, 1, 0]


def test_gradient_vanishes_at_the_optimum():
    """The fitted weights are where the penalised likelihood of the pairs is flat, by an independent sum over pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(float)
    model = quality_ranking.fit(x, y)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    good, bad = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
    r = np.random.default_rng(5)
    n = min(quality_ranking.MAX_PAIRS, 40 * max(len(good), len(bad)))
    total = np.zeros(3)
    for a, b in zip(r.choice(good, n), r.choice(bad, n), strict=True):
        d = z[a] - z[b]
        total += d / (1 + np.exp(d @ model.weights)) / n
    assert np.abs(total - quality_ranking.RIDGE * model.weights).max() < 1e-6


def test_ids_of_any_type_and_repeated_rows(docs_of, spark):
    r = random.Random(4)
    docs = docs_of([prose(r, 30) for _ in range(40)]).selectExpr("concat('d', doc_id % 20) as doc_id", "text")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(20)], "doc_id string, quality int, toxic int")
    assert len(quality_ranking.labelled(docs, labels, "quality", quality_ranking.features)[1]) == 20
    for run in (quality_ranking.rank, toxicity.detect):
        got = run(docs, labels)
        assert got.count() == 40 and got.schema["doc_id"].dataType.typeName() == "string"


def test_pairs_recover_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x @ np.array([2.0, -1, 0, 0]) > 0).astype(float)
    model = quality_ranking.fit(x, y)
    assert auc(y, model.score(x)) > 0.99 and abs(model.weights[2]) < 0.2 * abs(model.weights[0])


def test_queries(spark, data):
    from tidemark.llm import queries

    for name, kinds in (("op2_quality_ranking", 4), ("op3_toxicity", 5)):
        got = queries.queries()[name](spark, data)
        assert got.count() == 200 and {"doc_id", "held_out", "score", "predicted"} <= set(got.columns)
