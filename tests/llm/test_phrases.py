import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases as ph

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    around = {}
    for (lang, ws), a in f.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                key = (lang, ws[i : i + k])
                around[key] = max(around.get(key, 0), a)
    made = {}
    for (lang, ws), a in f.items():
        if len(ws) < 2 or 100 * around.get((lang, ws), 0) >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, l, r = min(cuts)
        made.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in made.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def text_of(rng, n, words):
    return "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ", ", ".", "\n", "? ", "-"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    import random

    rng = random.Random(5)
    words = ["the", "The", "of", "über", "a", "日本", "x-y", "river", "bank", " ", "'s"]
    rows = [(rng.choice(["en", "en", "de", None]), text_of(rng, rng.randrange(90), words[: rng.randrange(1, 12)])) for _ in range(160)]
    return [*rows, ("fr", None), (None, ""), ("en", " \t\n"), ("en", "only one"), ("en", "the the the the the " * 40), ("en", "the the the the the " * 40), ("fr", "zz")]


@pytest.mark.parametrize("settings", [{}, {"dense": 0}, {"hot": 40}, {"dense": 0, "hot": 20, "buckets": 1}, {"hot": 5, "top": 7}])
def test_equals_brute_force(spark, corpus, settings, monkeypatch):
    monkeypatch.setattr(ph, "SHARE", 10**9 if "hot" in settings else ph.SHARE)
    docs = spark.createDataFrame([(i, a, b, 1, 2) for i, (a, b) in enumerate(corpus)], "doc_id long, lang string, text string, h1 int, f int").repartition(6)
    got = ph.mine(docs, least=6, **settings).collect()
    assert sorted(tuple(r) for r in got) == brute(corpus, 6, settings.get("top", ph.TOP))
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_counts_past_64_bits_of_products(spark):
    a = 7 * 10**12  # 2,000,000 times this passes 64 bits
    phrases = spark.createDataFrame([(1, 2, 0, 0, "en", a), (1, 2, 3, 0, "en", a * 8 // 10 - 1)], "h1 long, h2 long, h3 long, h4 long, lang string, f long")
    words = spark.createDataFrame([(1, 3 * a), (2, 2 * a), (3, 9 * a)], "h long, count long")
    got = {r.h3: (r.a, r.l, r.r, r.score) for r in ph.scored(phrases, words, words.limit(0)).filter("h3 = 0").collect()}
    assert got == {0: (a, 3 * a, 2 * a, 2_000_000 * a // (5 * a))}


def test_growth_enters_frequent_prefixes_only():
    cells = [np.array(x, np.uint32) for x in ([1, 1, 1, 2, 2], [3, 3, 4, 5, 5], [0, 6, 0, 7, 7], [0, 0, 0, 0, 8])]
    first, length, n = ph.grow(cells, np.array([2, 1, 1, 1, 1]), lambda s: np.zeros(len(s), bool), 2)
    assert sorted(zip(first.tolist(), length.tolist(), n.tolist(), strict=True)) == [(0, 2, 3), (3, 2, 2), (3, 3, 2)]
    first, length, n = ph.grow(cells, np.array([2, 1, 1, 1, 1]), lambda s: s == 1, 99)
    assert not len(first) or set(length.tolist()) == {2}


@pytest.mark.parametrize("buckets", [1, 40])
def test_each_phrase_leaves_one_task(spark, corpus, buckets):
    """Hot words alone: their phrases' pointers go to many tasks, but one of them tells the phrase, with all its occurrences."""
    docs = spark.createDataFrame(corpus, "lang string, text string").repartition(6)
    texts = ph._texts(docs, "text", "lang")
    counts = ph.word_counts(texts).groupBy("lang", "word").sum("count").filter("word is not null").collect()
    seeds, h = {}, {}
    for lang, word, n in counts:
        if n >= 6:
            part = docs.sparkSession.createDataFrame([(lang, word)], "lang string, text string").toArrow().to_batches()[0]
            h[lang, word] = ph._words(part, seeds)[1][0]
    table = np.sort(np.array(list(h.values()), np.uint64))
    symbols = spark.sparkContext.broadcast(ph._Symbols(table, table[::2]))
    got = [tuple(r)[1:] for r in ph.frequent_phrases(texts, symbols, buckets, 6).collect()]
    assert len(got) == len({r[:4] for r in got}) and min(r[4] for r in got) >= 6
    name = {int(v.view(np.int64)): k[1] for k, v in h.items()}
    f = Counter()
    for lang, text in corpus:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", *ws[i : i + k]) for k in range(2, 5) for i in range(len(ws) - k + 1))
    of = {int(v.view(np.int64)): k[0] for k, v in h.items()}
    assert {(of[r[0]], *(name[x] for x in r[:4] if x)): r[4] for r in got} == {k: n for k, n in f.items() if n >= 6}


def test_pieces_and_infrequent_words_end_a_pointer():
    cells = ph.followers(np.array([1, 2, 0, 3, 4, 5], np.uint32), np.array([True, True, True, False, True]))
    assert [c.tolist() for c in cells] == [[1, 2, 0, 3, 4, 5], [2, 0, 0, 0, 5, 0], [0] * 6, [0] * 6]


def test_empty_table_and_odd_texts(spark, docs_of, odd_texts):
    assert ph.mine(docs_of([])).count() == 0
    got = sorted(tuple(r) for r in ph.mine(docs_of(odd_texts), least=25).collect())
    assert got == brute([("en", t) for t in odd_texts], 25, ph.TOP)


def test_equals_sql(same):
    same(ph.query, ph.oracle())
