import collections
import random
import re

from tidemark.llm import quality_rules

from .conftest import prose

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    w = re.findall(SPACE, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = collections.Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit.update(range(i, i + 8))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_counts(docs_of, odd_texts):
    r = random.Random(9)
    p = prose(r, 12)
    texts = [*odd_texts, f"{p} {prose(r, 5)} {p} {p}", "a " * 8, "a " * 9, "a b " * 40, "x # * $ % & | < > y", "q\n\nq\n q\nq\n", "\x0b\x0c a\x1cb\u00a0c", "\U0001f600 é" * 10, f"{p}\n{p}\n{prose(r, 80)}"]
    got = quality_rules.quality_rules(docs_of(texts), keep=("doc_id", "label")).orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(x[n] for n in names) for x in got] == [brute(t) for t in texts]
    assert not any(x["kept"] for x in got if x["base_failed"])
    assert quality_rules.quality_rules(docs_of(["a"]).limit(0)).count() == 0


def test_verdicts(docs_of):
    r = random.Random(10)
    good = [prose(r, 60), prose(r, 60, "de")]
    bad = [good[0].upper(), re.sub(" ", "%%% ", good[0]), " ".join("x%d" % i for i in range(50))]
    got = [x["kept"] for x in quality_rules.quality_rules(docs_of(good + bad)).orderBy("doc_id").collect()]
    assert got == [True, True, False, False, False]


def test_sql(same):
    same(quality_rules.query, quality_rules.oracle())


def test_one_native_stage(spark, data):
    plan = quality_rules.query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Exchange"))
