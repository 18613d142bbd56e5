"""Quality ranking learns from every labelled row and every pair."""

import numpy as np
import pytest

from tidemark.llm import quality_ranking


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    return x, (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.4).astype(float)


def table(spark, x, y):
    return spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "_y double, _x array<double>").repartition(5)


def test_gradient_of_all_pairs_vanishes(spark, rows):
    x, y = rows
    model = quality_ranking.learn(table(spark, x, y), 3)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    d = (z[y > 0.5][:, None] - z[y <= 0.5][None]).reshape(-1, 3)
    total = (d / (1 + np.exp(d @ model.weights))[:, None]).mean(axis=0)
    assert np.abs(total - quality_ranking.RIDGE * model.weights).max() < 2e-4
    raw = model.raw(x)
    assert abs(model.threshold - np.quantile(raw, (y <= 0.5).mean())) < 1e-9
    assert abs(model.slope - 4 / (np.median(raw[y > 0.5]) - np.median(raw[y <= 0.5]))) < 1e-9


def test_every_labelled_row_counts(spark, docs_of, monkeypatch):
    """The mean of the features is that of all rows, where a bound on rows once stood."""
    monkeypatch.setattr(quality_ranking, "MAX_LABELLED", 5)
    texts = ["word " * (k % 17 + 1) + "!" * (k % 3) for k in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = {}

    def learn(rows, d, own=quality_ranking.learn):
        seen["n"] = rows.count()
        seen["model"] = own(rows, d)
        return seen["model"]

    monkeypatch.setattr(quality_ranking, "learn", learn)
    assert quality_ranking.rank(docs_of(texts), labels).count() == 60
    want = quality_ranking.features(quality_ranking.pa.array(texts)).mean(axis=0)
    assert seen["n"] == 60 and np.abs(seen["model"].mean - want).max() < 1e-9
