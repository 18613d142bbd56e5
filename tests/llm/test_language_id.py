import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id

from .conftest import prose


def test_held_out_accuracy(docs_of):
    r = random.Random(3)
    langs = [r.choice(["en", "de"]) for _ in range(120)]
    docs = docs_of([prose(r, 40, k) for k in langs], langs)
    got = language_id.identify(docs.filter("doc_id >= 80"), language_id.learn(docs.filter("doc_id < 80")), keep=("doc_id", "lang", "source"))
    assert got.filter("lang <> lang_pred").count() == 0
    assert got.filter("score < 0.5 or score > 1").count() == 0


def test_odd_texts(docs_of, odd_texts, spark):
    docs = docs_of(odd_texts, [None] + ["en"] * (len(odd_texts) - 2) + ["de"])
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert len(got) == len(odd_texts)
    assert [i for i in got if got[i]["lang_pred"] == "und"] == [i for i, t in sorted((i, odd_texts[i]) for i in got if not any(c.isalpha() for c in odd_texts[i] or ""))] or {i for i in got if got[i]["lang_pred"] == "und"} == {i for i, t in enumerate(odd_texts) if not any(c.isalpha() for c in t or "")}
    assert all(got[i]["score"] == 0 for i in got if got[i]["lang_pred"] == "und")
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.learn(empty)).collect()} == {"und"}


def naive(text):
    """The bundle of a text, one trigram of symbols after the other."""
    letters = language_id._letters().astype(int)
    table = language_id._symbols()
    sym = [0]
    for c in f" {text.lower()} ":
        s = int(table[ord(c)])
        if s or sym[-1]:
            sym.append(s)
    out = np.zeros(language_id.DIMENSIONS, int)
    for a, b, c in zip(sym, sym[1:], sym[2:]):
        for_a, for_b = np.concatenate([letters[a][-2:], letters[a][:-2]]), np.concatenate([letters[b][-1:], letters[b][:-1]])
        out += for_a * for_b * letters[c]
    return out


def test_vectors_equal_naive_bundling(docs_of):
    texts = ["The house, and a river!", "der Fluß im Garten", "x", "ab 12 cd", "日本語 текст"]
    profiles = np.eye(language_id.DIMENSIONS, dtype=np.float32)
    got, letters = language_id.cosines(language_id.pa.array(texts), profiles)
    for own, t in zip(got, texts):
        want = naive(t)
        assert np.abs(own - want / np.linalg.norm(want)).max() < 1e-5
    names, vectors = language_id.learn(docs_of(texts[:2], ["en", "de"]))
    assert names == ["de", "en"]
    for own, t in zip(vectors, (texts[1], texts[0])):
        want = naive(t)
        assert np.abs(own - want / np.linalg.norm(want)).max() < 1e-4


def test_long_training_text(docs_of):
    r = random.Random(5)
    long = prose(r, 2000) + " "
    docs = docs_of([long * 80, prose(r, 60, "de")], ["en", "de"])
    assert len(language_id.trigrams(language_id.pa.array([long * 80]))[1]) > 1_000_000
    names, vectors = language_id.learn(docs)
    assert names == ["de", "en"]
    once = language_id.learn(docs_of([long], ["en"]))[1]
    assert vectors[1] @ once[0] > 0.999


def test_query(spark, data):
    got = language_id.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.9 and got.count() == 200
