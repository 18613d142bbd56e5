import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, score double, keys string, label int"
WORDS = {
    "en": "the of and to house river stone window garden winter morning letter story answer question".split(),
    "de": "der die und nicht straße fluss garten fenster winter morgen brief geschichte über größe".split(),
}


def prose(r, n, lang="en"):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "s", "ly", "heit"]) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with those that operators make."""

    def make(texts, langs=None, sources=None, first=0):
        n = len(texts)
        rows = [(first + i, t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], 0.5, "x", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, very long and wide texts."""
    r = random.Random(1)
    long = prose(r, 60_000)
    return [None, "", " \n\t ", "a", "a", "...", "one two three", long, long, "x" * 50_000, "über größe straße " * 20, "日本語 " * 30, "line\nline\nline\n", prose(r, 200), prose(r, 200, "de")]


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)
