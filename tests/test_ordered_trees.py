"""Ordered boosting against plain Python: statistics of categories, splits, leaf values, scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.trees import ordered, passes


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        a, b, c = r.gauss(0, 1), r.choice([None, float("nan"), 1.0, 2.0, 3.0]), r.choice(["x", "y", "z", None, "only" + str(i)])
        y = int(r.random() < 1 / (1 + math.exp(-(2 * a + (b == 3.0) * 2 + (c == "x") * 1.5 - 1))))
        rows.append((i, a, b, c, float(y)))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, label double").repartition(3).cache()


def test_totals_are_exact_for_any_partitioning(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("short").alias("k"))

    def fn(batch):
        out = np.zeros((3, 2000), np.int64)
        np.add.at(out[1], batch["k"].astype(int), batch["id"] << 40)
        out[2, 1999] += len(batch["id"])
        return out

    for parts in (1, 5):
        got = passes.totals(df.repartition(parts), ["id", "k"], fn, (3, 2000))
        assert got[2, 1999] == 1000 and got[0].sum() == 0
        assert got[1, :7].tolist() == [sum(i for i in range(1000) if i % 7 == k) << 40 for k in range(7)]
    assert passes.totals(df.limit(0), ["id", "k"], fn, (3, 2000)).sum() == 0


def test_histogram_is_exact():
    leaf, cells = np.array([0, 1, 1, -1]), np.array([[0, 2], [1, 1], [1, 2], [0, 0]], np.int16)
    big = np.array([2**60 + 1, -(2**60) - 3, 5, 9], np.int64)
    got = passes.histogram(leaf, cells, 2, 3, [big])
    assert got[0, 0, 0, 0] == big[0] and got[1, 0, 1, 0] == big[1] + 5 and got[1, 1, 1, 0] == big[1] and got.sum() == 2 * big[:3].sum()


def test_statistics_are_of_strictly_earlier_rows(spark, table):
    place = F.xxhash64("id", F.lit(7))
    got = ordered.target_statistics(table.select("id", "c", "label", place.alias("p")), ["c"], "label", "p", 0.3, 2.0).collect()
    before = {}
    for r in sorted(got, key=lambda r: r.p):
        s, n = before.get(r.c, (0.0, 0))
        assert abs(r["__ts0"] - (s + 0.6) / (n + 2)) < 1e-12
        before[r.c] = (s + r.label, n + 1)


def brute_fit(rows, J, trees, depth, rate, l2, borders):
    """The same model row by row: ``rows`` has block, label and bins."""
    raw = [[0.0] * J for _ in rows]
    p = lambda z: 1 / (1 + math.exp(-z))
    out = []
    for _ in range(trees):
        g = [y - p(raw[i][b - 1] if b else 0.0) for i, (b, y, _) in enumerate(rows)]
        splits = []

        def score(splits, g=g):
            cells = {}
            for (_, _, x), v in zip(rows, g, strict=True):
                k = tuple(x[f] > b for f, b in splits)
                s, n = cells.get(k, (0.0, 0))
                cells[k] = (s + v, n + 1)
            return sum(s * s / (n + l2) for s, n in cells.values())

        for _ in range(depth):
            base = score(splits)
            best = max(((score([*splits, (f, b)]) - base, -f, -b) for f, own in enumerate(borders) for b in range(len(own) + 1)), default=None)
            if best[0] <= 1e-12:
                break
            splits.append((-best[1], -best[2]))
        values = []
        for j in range(J):
            sums = {}
            for i, (b, y, x) in enumerate(rows):
                if b <= j:
                    k = sum((x[f] > s) << n for n, (f, s) in enumerate(splits))
                    q = p(raw[i][j])
                    s, h = sums.get(k, (0.0, 0.0))
                    sums[k] = (s + y - q, h + q * (1 - q))
            values.append({k: rate * s / (h + l2) for k, (s, h) in sums.items()})
        for i, (_, _, x) in enumerate(rows):
            k = sum((x[f] > s) << n for n, (f, s) in enumerate(splits))
            for j in range(J):
                raw[i][j] += values[j].get(k, 0.0)
        out.append((splits, values[-1]))
    return out, [r[-1] for r in raw]


def test_equals_brute_force(spark, table):
    args = {"trees": 10, "depth": 3, "rate": 0.3, "l2": 2.0, "bins": 8, "prefixes": 4, "seed": 3}
    learner = ordered.OrderedBoosting(["a", "b"], key=["id"], **args)
    _, rows, _ = learner._rows(table)
    borders = passes.borders_of(rows, ["n0", "n1"], 8)
    cells = passes.binned(rows.withColumn("id", F.lit(0)), ["n0", "n1"], borders, ["y", "b"]).collect()
    want, _ = brute_fit([(r.b, r.y, list(r.x)) for r in cells], 4, 10, 3, 0.3, 2.0, borders)
    model = learner.fit(table)
    assert len(model.trees) == 10
    for (_, splits, leaf), (own, values) in zip(model.trees, want, strict=True):
        assert splits == own
        assert all(abs(leaf[k] - v) < 1e-6 for k, v in values.items())


def test_blocks_halve_and_scores_follow_the_trees(spark, table):
    learner = ordered.OrderedBoosting(["a", "b"], ["c"], ["id"], trees=5, depth=2, prefixes=3)
    _, rows, _ = learner._rows(table)
    sizes = {r["b"]: r["count"] for r in rows.groupBy("b").count().collect()}
    assert sizes[2] > sizes[1] > sizes[0] > 0 and abs(sizes[2] / 400 - 0.5) < 0.1
    model = learner.fit(table)
    stats = {r.category: r["mean"] for r in model.statistics[0][2].collect()}
    borders = learner._borders
    for r in model.transform(table).collect():
        v = [r.a, r.b, stats[r.c or ordered.NONE]]
        bins = [0 if x is None or math.isnan(x) else int(np.searchsorted(b, x, "left")) + 1 for x, b in zip(v, borders, strict=True)]
        raw = sum(leaf[sum((bins[f] > b) << i for i, (f, b) in enumerate(splits))] for _, splits, leaf in model.trees)
        assert abs(r.rawPrediction - raw) < 1e-9 and abs(r.probability[1] - 1 / (1 + math.exp(-raw))) < 1e-9


def test_same_model_for_any_partitioning_and_new_categories(spark, table):
    fit = lambda df: ordered.OrderedBoosting(["a", "b"], ["c"], ["id"], trees=4, depth=3).fit(df)
    one, two = fit(table.coalesce(1)), fit(table.repartition(7, "a"))
    assert one.raw == two.raw
    new = one.transform(table.withColumn("c", F.lit("never seen")))
    assert new.count() == 400 and new.columns == [*table.columns, "rawPrediction", "probability", "prediction"]
    ap = metrics.average_precision(one.transform(table), "label", "rawPrediction").first()["average_precision"]
    base = metrics.average_precision(table.withColumn("r", F.lit(1.0)), "label", "r").first()["average_precision"]
    assert ap > base + 0.2


def test_numbers_as_labels_and_constant_cases(spark, table):
    model = ordered.OrderedBoosting(["a"], key=["id"], loss="squared", trees=25, depth=3, rate=0.3).fit(table.withColumn("label", F.col("a") * 10 + 3))
    worst = model.transform(table).agg(F.avg(F.abs(F.col("prediction") - F.col("a") * 10 - 3)), F.avg(F.abs(F.col("a") * 10))).first()
    assert worst[0] < 0.25 * worst[1]
    for df in (table.limit(0), table.withColumn("label", F.lit(0.0)), table.withColumn("label", F.lit(None).cast("double"))):
        p = [r.probability[1] for r in ordered.OrderedBoosting(["a"], ["c"], ["id"], trees=2).fit(df).transform(table.limit(5)).collect()]
        assert len(p) == 5 and all(0 <= x <= 0.5 for x in p)
    with pytest.raises(ValueError):
        ordered.OrderedBoosting(["a"], key=["id"]).fit(table.withColumn("label", F.col("a")))
    with pytest.raises(ValueError):
        ordered.OrderedBoosting(["a"])
