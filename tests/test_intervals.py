"""Folds as pairs of half-open ranges, against plain Python over positions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, learning, splits


def expected(n, k, gap):
    """Positions of each fold's training and validation, as a row-count splitter with a gap gives them."""
    size = n // (k + 1)
    starts = range(n - k * size, n, size)
    return [(list(range(s - gap)), list(range(s, s + size))) for s in starts]


@pytest.mark.parametrize(("n", "k", "gap"), [(12, 2, 1), (12, 3, 0), (103, 5, 7), (40, 4, 7), (7, 6, 0)])
def test_by_rows_equals_positions(spark, n, k, gap):
    df = spark.createDataFrame([(i, (n - i) // 3) for i in range(n)], "i int, t int").repartition(3)
    place = sorted(range(n), key=lambda i: ((n - i) // 3, i))
    folds = intervals.by_rows(df, k, ("t", "i"), gap)
    for f, (train, valid) in enumerate(expected(n, k, gap)):
        assert sorted(r.i for r in folds.train(df, f).collect()) == sorted(place[p] for p in train)
        assert sorted(r.i for r in folds.valid(df, f).collect()) == sorted(place[p] for p in valid)
    got = {r.i: r["__fold__"] for r in folds.assigned(df).collect()}
    held = {place[p]: f for f, (_, valid) in enumerate(expected(n, k, gap)) for p in valid}
    assert got == {i: held.get(i, -1) for i in range(n)}
    parts = {(r.i, r.fold): r.part for r in folds.membership(df).collect()}
    for f, (train, valid) in enumerate(expected(n, k, gap)):
        own = {place[p]: "train" for p in train} | {place[p]: "valid" for p in valid} | {place[p]: "gap" for p in range(len(train), valid[0])}
        assert {i: part for (i, x), part in parts.items() if x == f} == own
    assert intervals.Intervals.from_json(folds.to_json()) == folds
    assert sorted(r.i for r in folds.unvalidated(df).collect()) == sorted(i for i in range(n) if i not in held)


def test_too_few_rows_and_ties(spark):
    df = spark.createDataFrame([(i, i // 6) for i in range(12)], "i int, t int")
    for k, gap in ((12, 0), (2, 4), (0, 0)):
        with pytest.raises(ValueError, match="too few"):
            intervals.by_rows(df, k, ("t", "i"), gap)
    with pytest.raises(ValueError, match="tie"):
        intervals.by_rows(df, 2, ("t", "i")).check(df, "t")
    with pytest.raises(ValueError, match="gap"):
        intervals.holdout(df, 0.5, ("t", "i"), 6)
    rows = intervals.holdout(df, 0.25, ("t", "i"), 3).summary(df).collect()
    assert [(r.n_train, r.n_gap, r.n_valid) for r in rows] == [(6, 3, 3)]


def test_calendar(spark):
    times = ["2030-01-01 00:00:00", "2030-03-13 23:59:59", "2030-03-14 00:00:00", "2030-05-14 23:59:59", "2030-05-15 00:00:00", "2030-07-15 23:59:59"]
    df = spark.createDataFrame([(i, dt.datetime.fromisoformat(t), i % 2) for i, t in enumerate(times)] + [(9, None, 0)], "i int, t timestamp_ntz, y int")
    folds = intervals.calendar([("2030-03-14", "2030-05-15"), ("2030-04-01", "2030-05-15", "2030-07-16")], "t")
    assert [(r["n_train"], r["n_gap"], r["n_valid"]) for r in folds.check(df)] == [(3, 0, 2), (4, 1, 2)]
    assert sorted(r.i for r in folds.train(df, 1).collect()) == [0, 1, 2, 9]
    assert {r.i: r["__fold__"] for r in folds.assigned(df).collect()} == {0: -1, 1: -1, 2: 0, 3: 0, 4: 1, 5: 1, 9: -1}
    assert sorted(r.i for r in folds.unvalidated(df).collect()) == [0, 1, 9]
    assert "PushedFilters: [Or(" in _scan(spark, df, folds) or "LessThan(t" in _scan(spark, df, folds)
    for bad in (("2030-02-02", "2030-02-01", "2030-03-01"), ("2030-03-01", "2030-03-01")):
        with pytest.raises(ValueError, match="bounds"):
            intervals.calendar([bad], "t")
    with pytest.raises(ValueError, match="empty"):
        intervals.calendar([("2029-01-01", "2030-05-15")], "t").check(df.filter("t is not null"))
    with pytest.raises(ValueError, match="lacks"):
        folds.check(df.filter("i not in (1, 3)"), label="y", classes=[0, 1])


def _scan(spark, df, folds):
    import tempfile

    path = tempfile.mkdtemp() + "/t"
    df.write.parquet(path)
    return folds.train(spark.read.parquet(path), 0)._jdf.queryExecution().toString()


def test_out_of_fold_never_trains_on_the_gap(spark):
    """Labels of the gap alone are large; a mean that has seen one of them would be far off."""
    n, k, gap = 60, 3, 5
    size = n // (k + 1)
    for f in range(k):
        start = n - (k - f) * size
        rows = [(i, 0.0 if not start - gap <= i < start else 1000.0, float(i % 2)) for i in range(n)]
        df = spark.createDataFrame(rows, "i int, label double, x double")
        folds = intervals.by_rows(df, k, ("i",), gap)
        out = learning.out_of_fold(df, learning.build_pipeline("linear", ["x"]), folds)
        assert out.count() == n
        own = [r.pred_0 for r in out.filter(f"__fold__ = {f}").collect()]
        assert len(own) == size and max(abs(p) for p in own) < 1e-6
        assert all(r.pred_0 is None for r in out.filter("__fold__ < 0").collect())


def test_plan_and_reuse(spark):
    df = spark.createDataFrame([(i, dt.datetime(2030, 1, 1 + i), i % 3, i // 2) for i in range(24)], "id int, timestamp timestamp_ntz, y int, g int")
    for kind in splits.KINDS:
        args = {"k": 3, "label": "y", "group": "g", "gap": 2, "bounds": (("2030-01-08", "2030-01-10", "2030-01-16"), ("2030-01-16", "2030-01-20"))}
        out, folds, record = splits.plan_splits(df, kind, ["id"], classes=[0, 1, 2] if "time" in kind else None, **args)
        again = splits.plan_splits(df, kind, ["id"], classes=[0, 1, 2] if "time" in kind else None, reuse=record, **args)
        assert again[2] == record and out.count() == 24
        for p in record["parts"]:
            assert (folds.train(out, p["fold"]).count(), folds.valid(out, p["fold"]).count()) == (p["n_train"], p["n_valid"])
        with pytest.raises(ValueError, match="do not match"):
            splits.plan_splits(df.filter("id > 0"), kind, ["id"], reuse=record, **args)
        with pytest.raises(ValueError, match="integrity"):
            splits.plan_splits(df, kind, ["id"], reuse=record | {"signature": "x"}, **args)
    with pytest.raises(ValueError, match="class"):
        splits.plan_splits(df, "stratified", ["id"], 9, label="y")
    with pytest.raises(ValueError, match="groups"):
        splits.plan_splits(df, "group", ["id"], 13, group="g")
    with pytest.raises(ValueError, match="missing"):
        splits.plan_splits(df.withColumn("timestamp", F.when(F.col("id") > 0, F.col("timestamp"))), "time", ["id"])


def test_words_of_any_script(spark):
    df = spark.createDataFrame([(0, "crétin über straße naïve x"), (1, "日本 über"), (2, None)], "i int, t string").fillna("")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=learning.encoding([], text="t")).fit(df)
    assert sorted(model.stages[1].vocabulary) == sorted(["crétin", "über", "straße", "naïve", "日本"])
    with pytest.raises(ValueError, match="words"):
        Pipeline(stages=learning.encoding([], text="t", vocabulary=4)).fit(df)
    hashed = Pipeline(stages=learning.encoding([], text="t", vocabulary=64, hashed=True)).fit(df).transform(df)
    assert hashed.first()["features"].size == 64
