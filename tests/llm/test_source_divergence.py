import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import source_divergence as sd

UPPER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top):
    rows = [tuple("" if v is None else v for v in r) for r in rows]
    docs, count, groups = Counter(), Counter(), {}
    for lang, source, text in rows:
        groups.setdefault(lang, set()).add(source)
        terms = TERM.findall(text.translate(UPPER))
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        per = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 5) // (per[s] + 5 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 5) // (sum(per.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((q[t] - p[s, t], t.encode()) for t in kept if count[lang, s, t] and p[s, t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", over)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    import random

    rng = random.Random(3)
    words = ["the", "The", "of", "über", "ÜBER", "a", "日本", "x-y", "river", "don't", "B2B", "ß_ß"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", "é", None]), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(300)]
    return [*rows, ("fr", "a", None), ("fr", "b", "x y"), ("fr", None, "123 !"), ("xx", "only", "one"), ("en", "empty", ""), ("en", "a", rows[0][2]), ("en", "a", "river " * 5_000)]


@pytest.mark.parametrize("settings", [{}, {"cells": 1, "least": 1}, {"cells": 12, "least": 2, "top": 3}, {"min_docs": 1}, {"min_docs": 10**6}])
def test_equals_brute_force(spark, corpus, settings, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 500)
    docs = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in corpus], "lang string, source string, text string, term int, block int").repartition(5)
    args = {"min_docs": 8} | settings
    got = sd.divergence(docs, **args).collect()
    assert sorted(tuple(r) for r in got) == brute(corpus, args["min_docs"], args.get("top", sd.TOP))


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 3, 10**12, 8 * 10**15], np.int64)
    total = 9 * 10**15 - 10
    assert sd.shares(counts, total, 2).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 10) for c in counts]


def test_pair_sums():
    p = np.array([[1, 5], [4, 1], [0, 0]], np.int64)
    assert sd.pair_sums(p).tolist() == [[0, 7, 6], [7, 0, 5], [6, 5, 0]]


def test_empty_table_and_odd_texts(spark, docs_of, odd_texts):
    assert sd.divergence(docs_of([])).count() == 0
    sources = ["s", "t"] * len(odd_texts)
    rows = [("en", sources[i], t) for i, t in enumerate(odd_texts)]
    got = sd.divergence(docs_of(odd_texts, sources=sources), min_docs=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2, sd.TOP)


def test_equals_sql(same):
    same(sd.query, sd.oracle())
