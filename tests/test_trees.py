"""Leaf-wise and second-order boosting and extra trees, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.trees import extra, leafwise, newton, passes


@pytest.fixture(scope="module")
def rows():
    r = random.Random(23)
    out = []
    for i in range(500):
        a, b, kind = round(r.gauss(0, 1), 2), r.choice([None, 0.0, 1.0, 2.0, 3.0]), r.randrange(6)
        y = int(r.random() < 1 / (1 + math.exp(-(1.5 * a + (b is None) * 2 + (kind == 2) * 2 - 1))))
        out.append((i, a, b, *[float(kind == k) for k in range(4)], float(y)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, k0 double, k1 double, k2 double, k3 double, label double").repartition(4).cache()


COLS = ["a", "b", "k0", "k1", "k2", "k3"]


def bins_of(values, borders):
    return [0 if v is None else int(np.searchsorted(b, v, "left")) + 1 for v, b in zip(values, borders, strict=True)]


def same(one, two):
    assert len(one.trees) == len(two.trees) > 0
    for s, t in zip(one.trees, two.trees, strict=True):
        assert (s.feature, s.border, s.left, s.right, s.null_right) == (t.feature, t.border, t.left, t.right, t.null_right) and s.value == t.value


# --- leaf-wise -----------------------------------------------------------------------


def best_first(data, trees, leaves, rate, l2, least, widths, start):
    """Growth from a queue, every histogram made anew from the rows."""
    raw, out = [start] * len(data), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-z)) for z in raw]
        g, h = [y - q for (y, _), q in zip(data, p, strict=True)], [q * (1 - q) for q in p]

        def best(own, g=g, h=h):
            value = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + l2)
            options = []
            for f, w in enumerate(widths):
                for b in range(w - 1):
                    right = [i for i in own if data[i][1][f] > b]
                    if least <= len(right) <= len(own) - least:
                        left = [i for i in own if data[i][1][f] <= b]
                        options.append((value(left) + value(right) - value(own), -f, -b))
            return max(options, default=(-1.0, 0, 0))

        open_ = {0: list(range(len(data)))}
        gains, splits, made = {0: best(open_[0])}, {}, 1
        while len(open_) < leaves:
            leaf = max((x for x in open_ if gains[x][0] > 1e-12), key=lambda x: (gains[x][0], -x), default=None)
            if leaf is None:
                break
            _, f, b = gains[leaf]
            own = open_.pop(leaf)
            splits[leaf] = (-f, -b, made, made + 1)
            for child, part in ((made, [i for i in own if data[i][1][-f] <= -b]), (made + 1, [i for i in own if data[i][1][-f] > -b])):
                open_[child], gains[child] = part, best(part)
            made += 2
        values = {x: rate * sum(g[i] for i in s) / (sum(h[i] for i in s) + l2) for x, s in open_.items()}
        for x, s in open_.items():
            for i in s:
                raw[i] += values[x]
        out.append((splits, values))
    return out, raw


def test_leafwise_equals_brute_force(spark, table, rows):
    args = {"trees": 3, "leaves": 6, "rate": 0.4, "l2": 1.0, "least": 8, "bins": 12}
    model = leafwise.LeafwiseBoosting(COLS, **args).fit(table)
    own, n, start, _ = passes.prepared(table, COLS, (), "label", "logistic", 42)
    borders = passes.borders_of(own, [f"n{i}" for i in range(len(COLS))], 12)
    data = [(r[-1], bins_of(r[1:-1], borders)) for r in rows]
    want, raw = best_first(data, 3, 6, 0.4, 1.0, 8, [len(b) + 2 for b in borders], start)
    for tree, (splits, values) in zip(model.trees, want, strict=True):
        assert {i: (tree.feature[i], tree.border[i], tree.left[i], tree.right[i]) for i in splits} == splits
        assert all(abs(tree.value[i] - v) < 1e-6 for i, v in values.items())
    got = {r.id: r.rawPrediction for r in model.transform(table).collect()}
    assert max(abs(got[r[0]] - z) for r, z in zip(rows, raw, strict=True)) < 1e-6


def test_subtraction_bundles_and_lookahead_change_nothing(spark, table):
    fit = lambda **a: leafwise.LeafwiseBoosting(COLS, **({"trees": 2, "leaves": 7, "least": 5} | a)).fit(table)
    base = fit()
    for other in ({"subtract": False}, {"bundle": False}, {"ahead": 1}):
        same(base, fit(**other))
    same(base, leafwise.LeafwiseBoosting(COLS, trees=2, leaves=7, least=5).fit(table.repartition(9, "a")))


def test_exclusive_features_share_a_column():
    widths, usual = [3, 3, 3, 5], [1, 1, 1, 2]
    off, both = np.array([10, 20, 30, 90]), np.array([[10, 0, 0, 5], [0, 20, 2, 9], [0, 2, 30, 9], [5, 9, 9, 90]])
    assert leafwise.bundled(off, both, widths, 0) == [[3], [2, 0], [1]]
    assert leafwise.bundled(off, both, widths, 2) == [[3], [2, 1, 0]]
    bundles = leafwise.Bundles([[3], [2, 0], [1]], widths, usual)
    cells = np.array([[1, 1, 1, 2], [2, 1, 1, 4], [1, 0, 2, 0], [0, 1, 1, 3]], np.int16)
    packed = bundles.packed(cells)
    assert packed.shape == (4, 3) and packed.max() < bundles.bins
    of = bundles.bin_of(packed)
    assert [of(np.full(4, f)).tolist() for f in range(4)] == cells.T.tolist()
    w = np.array([1, 10, 100, 1000], np.int64)
    made = passes.histogram(np.zeros(4, np.int64), packed, 1, bundles.bins, [w])[0]
    assert (bundles.unpacked(made, 5) == passes.histogram(np.zeros(4, np.int64), cells, 1, 5, [w])[0]).all()


def test_one_sided_sampling_keeps_large_gradients(spark, table):
    learner = leafwise.LeafwiseBoosting(COLS, ["id"], trees=4, leaves=6, top=0.2, other=0.3, least=5)
    model = learner.fit(table)
    same(model, leafwise.LeafwiseBoosting(COLS, ["id"], trees=4, leaves=6, top=0.2, other=0.3, least=5).fit(table.coalesce(1)))
    own, n, start, learner._largest = passes.prepared(table, COLS, ["id"], "label", "logistic", 42)
    own = own.withColumn("raw", F.lit(start))
    limit, chance, weight = learner._weights(own, ["y", "u", "raw"], lambda b: b["raw"], n, 0)
    p = 1 / (1 + math.exp(-start))
    full = own.filter(F.abs(F.col("y") - p) >= limit).count()
    assert full >= 0.2 * n and abs(chance * (n - full) - 0.3 * n) < 1 and abs(weight * chance - 1) < 1e-12
    with pytest.raises(ValueError):
        leafwise.LeafwiseBoosting(COLS, top=0.2, other=0.1)


# --- second order ----------------------------------------------------------------------


@pytest.mark.parametrize("size", [16, 64])
def test_rank_errors_of_the_sketch_are_bounded(spark, size, monkeypatch):
    monkeypatch.setattr(newton, "HELD", 300)
    rng = np.random.default_rng(4)
    v, w = np.round(rng.lognormal(size=20_000), 3), rng.integers(1, 1000, 20_000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w, strict=True)], "v double, w long").repartition(7).withColumn("v", F.array("v", F.lit(float("nan"))))
    one, none = newton.sketch(df, ["v", "w"], lambda b: (b["v"], b["w"]), 2, size)
    assert len(none.v) == 0 and one.total == w.sum() and len(one.v) <= size + 3
    order = np.argsort(v)
    for x, lo, hi in zip(one.v, one.lo, one.hi, strict=True):
        below, upto = w[v < x].sum(), w[v <= x].sum()
        assert lo <= below and upto <= hi
    levels = math.ceil(math.log2(20_000 / 7 / 300)) + 3
    assert one.error() <= 2 * levels / size
    borders = newton.proposed(one, 8)
    rank = np.array([w[v <= b].sum() for b in borders]) / w.sum()
    assert len(borders) == 7 and np.abs(rank - np.arange(1, 8) / 8).max() <= one.error() + 0.01 and order.size


def test_small_summaries_are_exact():
    a = newton.Summary.of(np.array([1.0, 2.0, 2.0, 5.0]), np.array([1, 2, 3, 4]))
    b = newton.Summary.of(np.array([0.0, 2.0, 9.0]), np.array([7, 1, 1]))
    m = a.merged(b)
    assert m.v.tolist() == [0, 1, 2, 5, 9] and m.lo.tolist() == [0, 7, 8, 14, 18] and m.hi.tolist() == [7, 8, 14, 18, 19] and m.error() == 0


def newton_brute(data, trees, depth, rate, l2, least, borders, start):
    """Each tree by recursion; ``data`` has label and values, null for none."""
    raw, out = [start] * len(data), []
    for t in range(trees):
        p = [1 / (1 + math.exp(-z)) for z in raw]
        g, h = [y - q for (y, _), q in zip(data, p, strict=True)], [q * (1 - q) for q in p]

        def grow(own, level, g=g, h=h, t=t):
            sg, sh = sum(g[i] for i in own), sum(h[i] for i in own)
            best = (1e-12, None)
            for null_right in (False, True):
                for f, bs in enumerate(borders[t]):
                    for b in [*bs, math.inf] if level < depth else ():
                        right = [i for i in own if (null_right if data[i][1][f] is None else data[i][1][f] > b)]
                        rg, rh = sum(g[i] for i in right), sum(h[i] for i in right)
                        if min(rh, sh - rh) < least:
                            continue
                        gain = (rg**2 / (rh + l2) + (sg - rg) ** 2 / (sh - rh + l2) - sg**2 / (sh + l2)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b, null_right, right))
            if best[1] is None:
                for i in own:
                    raw[i] += rate * sg / (sh + l2)
                return rate * sg / (sh + l2)
            f, b, null_right, right = best[1]
            return (f, b, null_right, grow([i for i in own if i not in set(right)], level + 1), grow(right, level + 1))

        out.append(grow(list(range(len(data))), 0))
    return out, raw


def test_newton_equals_brute_force_with_nulls(spark, table, rows):
    model = newton.NewtonBoosting(COLS, trees=3, depth=3, rate=0.5, bins=400, least=2.0).fit(table)
    borders = [[b.tolist() for b in own] for own in model.borders]
    for own in borders:
        assert all(x == sorted({r[1 + f] for r in rows} - {None})[:-1] for f, x in enumerate(own) if f)  # so few values are all proposed
    start = math.log(sum(r[-1] for r in rows) / sum(1 - r[-1] for r in rows))
    want, raw = newton_brute([(r[-1], r[1:-1]) for r in rows], 3, 3, 0.5, 1.0, 2.0, borders, start)

    def tree_of(t, b, node=0):
        f = t.feature[node]
        return t.value[node] if f < 0 else (f, float([*b[f], math.inf][min(t.border[node] - 1, len(b[f]))]), t.null_right[node], tree_of(t, b, t.left[node]), tree_of(t, b, t.right[node]))

    def check(x, y):
        if isinstance(x, tuple):
            assert x[:3] == y[:3]
            check(x[3], y[3])
            check(x[4], y[4])
        else:
            assert abs(x - y) < 1e-6

    for t, b, own in zip(model.trees, model.borders, want, strict=True):
        check(tree_of(t, b), own)
    assert any(True in t.null_right for t in model.trees)
    got = {r.id: r.rawPrediction for r in model.transform(table).collect()}
    assert max(abs(got[r[0]] - z) for r, z in zip(rows, raw, strict=True)) < 1e-6


# --- extra trees -------------------------------------------------------------------------


def test_extra_trees_equal_brute_force(spark, table, rows):
    model = extra.ExtraTrees(COLS, trees=5, depth=4, features=3, seed=9).fit(table)
    again = extra.ExtraTrees(COLS, trees=5, depth=4, features=3, seed=9).fit(table.repartition(11, "b"))
    assert [t.splits for t in model.trees] == [t.splits for t in again.trees] and [t.value for t in model.trees] == [t.value for t in again.trees]

    def grow(tree, node, own, level):
        ys = [r[-1] for r in own]
        if level == 4 or len(own) < 2 or len(set(ys)) == 1:
            return {}, {node: sum(ys) / len(ys)}
        col = lambda f: [r[1 + f] for r in own if r[1 + f] is not None]
        low, high = np.array([min(col(f), default=math.inf) for f in range(6)]), np.array([max(col(f), default=-math.inf) for f in range(6)])
        best = None
        for f, at in extra.candidates(9, tree, node, low, high, 3):
            right = [r for r in own if r[1 + f] is not None and r[1 + f] > at]
            left = [r for r in own if not (r[1 + f] is not None and r[1 + f] > at)]
            if left and right:
                score = sum(sum(r[-1] for r in s) ** 2 / len(s) for s in (left, right))
                if best is None or score > best[0]:
                    best = (score, f, at, left, right)
        if best is None:
            return {}, {node: sum(ys) / len(ys)}
        splits, values = {node: best[1:3]}, {}
        for side, part in ((1, best[3]), (2, best[4])):
            s, v = grow(tree, 2 * node + side, part, level + 1)
            splits |= s
            values |= v
        return splits, values

    scores = [0.0] * len(rows)
    for t, own in enumerate(model.trees):
        splits, values = grow(t, 0, rows, 0)
        assert own.splits == splits and own.value == values
        cells = np.array([[math.nan if x is None else x for x in r[1:-1]] for r in rows])
        scores = [s + x / 5 for s, x in zip(scores, own.scored(cells), strict=True)]
    got = {r.id: r.probability[1] for r in model.transform(table).collect()}
    assert max(abs(got[r[0]] - s) for r, s in zip(rows, scores, strict=True)) < 1e-9


def test_extra_trees_in_turns_and_of_numbers(spark, table, monkeypatch):
    base = extra.ExtraTrees(COLS, trees=4, depth=4, seed=2).fit(table)
    monkeypatch.setattr(extra, "NODES", 3)
    assert [t.splits for t in extra.ExtraTrees(COLS, trees=4, depth=4, seed=2).fit(table).trees] == [t.splits for t in base.trees]
    numbers = extra.ExtraTrees(["a"], impurity="variance", trees=8, depth=6).fit(table.withColumn("label", F.col("a") * 3))
    off = numbers.transform(table).agg(F.avg(F.abs(F.col("prediction") - 3 * F.col("a")))).first()[0]
    assert off < 0.6


# --- as pipelines ----------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["ordered_boosting", "leafwise_boosting", "newton_boosting", "extra_trees"])
def test_kinds_learn_from_numbers_and_categories(spark, table, kind):
    from tidemark.operators import metrics
    from tidemark.operators.intervals import by_rows

    df = table.withColumn("c", F.when(F.col("k2") == 1, "two").when(F.col("k1") == 1, "one"))
    more = {"ordered_boosting": {"key": ["id"], "depth": 3}, "leafwise_boosting": {"leaves": 6}, "newton_boosting": {"depth": 3}, "extra_trees": {"depth": 5}}[kind]
    out = learning.out_of_fold(df, learning.build_pipeline(kind, ["a", "b"], ["c"], trees=5, **more), by_rows(df, 1, ("id",), 10))
    assert out.count() == 500 and out.filter("__fold__ = 0").count() == 250
    valid = out.filter("__fold__ = 0")
    ap, base = (metrics.average_precision(valid.withColumn("p", c), "label", "p").first()["average_precision"] for c in (F.col("pred_0"), F.lit(0.5)))
    assert ap > base + 0.15
    for odd in (df.limit(0), df.withColumn("label", F.lit(1.0))):
        got = learning.predict(learning.build_pipeline(kind, ["a", "b"], ["c"], trees=2, **more).fit(odd), df.limit(3)).collect()
        assert len(got) == 3 and all(0 <= r.pred_0 <= 1 for r in got)
    with pytest.raises(ValueError):
        learning.build_pipeline(kind, ["a"], text="c")
