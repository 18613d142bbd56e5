"""Sources, splits, metrics, blends and estimators on small tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranges
from tidemark.operators import audit, blend, intervals, learning, metrics, splits, static
from tidemark.sources import tables


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n001,1.5\n002,\n")
    (tmp_path / "a.tsv").write_text("id\tx\n001\t1.5\n")
    (tmp_path / "a.jsonl").write_text('{"id": "1", "x": 2}\n{"id": "2", "x": 3}\n')
    (tmp_path / "a.json").write_text('[{"id": "1", "x": 2},\n {"id": "2", "x": 3}]')
    df = tables.read_table(spark, f"{tmp_path}/a.csv", id_columns=["id"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("001", 1.5), ("002", None)]
    assert tables.read_table(spark, f"{tmp_path}/a.csv", limit=1).count() == 1
    assert tables.read_table(spark, f"{tmp_path}/a.tsv").count() == 1
    assert tables.read_table(spark, f"{tmp_path}/a.jsonl").count() == tables.read_table(spark, f"{tmp_path}/a.json").count() == 2
    df.write.parquet(f"{tmp_path}/b.parquet")
    assert tables.read_table(spark, f"{tmp_path}/b.parquet").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/a.xyz")
    with pytest.raises(ValueError, match="missing columns"):
        tables.require_columns(df, ["id", "nope"])
    tables.save_frame(df, f"{tmp_path}/out")
    with pytest.raises(Exception):
        tables.save_frame(df, f"{tmp_path}/out")
    sample, n = tables.sampled(df, 1)
    assert sample.count() == 1 and n == 2
    assert tables.inventory(spark, str(tmp_path)).count() > 3
    tables.save_json({"a": 1}, f"{tmp_path}/x.json", exclusive=True)
    with pytest.raises(FileExistsError):
        tables.save_json({"a": 1}, f"{tmp_path}/x.json", exclusive=True)
    assert tables.materialized(df, f"{tmp_path}/m").count() == tables.materialized(df, f"{tmp_path}/m").count() == 2


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", -1, None), (1, "b", 0, 0.2), (2, "c", 0, 0.9)], "__row__ long, id string, __fold__ int, pred_0 double")
    tables.save_predictions(df, f"{tmp_path}/p", ["id"], {"k": 1})
    got, meta = tables.read_predictions(spark, f"{tmp_path}/p")
    assert got.count() == meta["rows"] == 3
    with pytest.raises(ValueError):
        tables.save_predictions(df.withColumn("__fold__", F.lit(0)), f"{tmp_path}/q", ["id"], {})
    template = spark.createDataFrame([("c", 0), ("b", 1)], "id string, o int")
    out = tables.build_submission(df.filter("__fold__ >= 0"), template, "id", "fraud", ordinal="o").collect()
    assert [tuple(r) for r in out] == [("c", 0.9), ("b", 0.2)]
    with pytest.raises(ValueError, match="same ids"):
        tables.build_submission(df, template, "id", "fraud")


def test_splits(spark):
    times = ["2031-02-03 08:00:00", "2031-02-09 23:59:59.999999", "2031-02-10 00:00:00", "2031-02-10 00:00:00", "2031-02-19 12:00:00", "2031-02-20 00:00:00", "2031-03-01 00:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    bounds = (("2031-02-10", "2031-02-20"), ("2031-02-20", "2031-02-25"))
    assert [r["__fold__"] for r in splits.calendar_folds(df, bounds).orderBy("i").collect()] == [-1, -1, 0, 0, 0, 1, -1]
    assert [tuple(r) for r in splits.fold_sizes(df, bounds).collect()] == [(0, 2, 3), (1, 5, 1)]
    with pytest.raises(ValueError):
        splits.check_boundary(df, df)
    with pytest.raises(ValueError):
        splits.check_groups(df, df, "i")
    many = spark.range(103).withColumn("g", F.col("id") % 7).withColumn("y", F.col("id") % 2)
    sizes = [r["count"] for r in splits.kfold(many, 4, ["id"]).groupBy("__fold__").count().collect()]
    assert sorted(sizes) == [25, 26, 26, 26]
    assert splits.group_fold(many, 3, "g", stratify="y").groupBy("g").agg(F.count_distinct("__fold__").alias("n")).filter("n > 1").count() == 0
    w = splits.recency_weight(df).agg(F.avg("weight")).first()[0]
    assert abs(w - 1) < 1e-9


def test_metrics(spark):
    rows = [(0, 1, 0.62), (0, 0, 0.62), (0, 0, 0.4), (0, 1, 0.35), (0, 1, 0.35), (1, 0, 0.8), (1, 1, 0.7), (1, 0, 0.05)]
    df = spark.createDataFrame(rows, "fold int, y int, p double")

    def precision_sum(own):  # each score from the highest on: the share of positives gained, times precision so far
        seen, hit, out, total = 0, 0, 0.0, sum(y for _, y, _ in own)
        for score in sorted({p for _, _, p in own}, reverse=True):
            tied = [y for _, y, p in own if p == score]
            seen, hit = seen + len(tied), hit + sum(tied)
            out += sum(tied) / total * hit / seen
        return out

    got = {r["fold"]: r["average_precision"] for r in metrics.average_precision(df, "y", "p", by=("fold",)).collect()}
    assert all(abs(got[k] - precision_sum([x for x in rows if x[0] == k])) < 1e-12 for k in (0, 1))
    pairs = [(p, q) for _, y, p in rows if y for _, z, q in rows if not z]
    assert abs(metrics.roc_auc(df, "y", "p").first()["roc_auc"] - sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)) < 1e-12
    assert metrics.average_precision(df.filter("y = 0"), "y", "p").first()["average_precision"] is None
    each = metrics.custom(df, lambda y, p: (y * p).sum(), ["y", "p"], ["fold"]).collect()
    assert {r["fold"]: round(r["score"], 6) for r in each} == {0: 1.32, 1: 0.7}
    assert metrics.probability_faults(df.withColumn("q", 1 - F.col("p")), ["p", "q"]).first()["not_summing"] == 0
    for average in ("macro", "micro", "weighted"):
        assert 0 <= metrics.classification(df.withColumn("h", metrics.labels_from(F.col("p"))), "y", "h", average).first()["f1"] <= 1
    assert [r[0] for r in df.select(metrics.labels_from([F.col("p"), 1 - F.col("p")])).collect()] == [0, 0, 1, 1, 1, 0, 0, 1]


def test_blend(spark):
    make = lambda v: spark.createDataFrame([(i, -1 if x is None else 0, x) for i, x in enumerate(v)], "__row__ long, __fold__ int, pred_0 double")
    a, b, c = make([0.11, None, 0.57, 0.03]), make([0.5, None, 0.21, 0.9]), make([0.77, None, 0.3, 0.31])
    got = [r["pred_0"] for r in blend.blend([a, b, c], [0.6, 0.1, 0.3]).orderBy("__row__").collect()]
    assert got[1] is None and [round(got[i], 9) for i in (0, 2, 3)] == [0.347, 0.453, 0.201]
    with pytest.raises(ValueError, match="same rows"):
        blend.blend([a, b.withColumn("__fold__", F.lit(1))], [0.5, 0.5])
    with pytest.raises(ValueError, match="same rows"):
        blend.blend([a, b.union(b.limit(1))], [0.5, 0.5])
    with pytest.raises(ValueError):
        blend.blend([a, b.withColumn("pred_0", F.lit(0.1))], [0.5, 0.5])
    with pytest.raises(ValueError):
        blend.blend([a, b.filter("__row__ > 0")], [0.5, 0.5])
    with pytest.raises(ValueError):
        blend.blend([a, b], [0.5, 0.6])
    assert (blend.verdict([0.01, 0.0]), blend.verdict([-0.01, 0.0]), blend.verdict([0.01, -0.01])) == ("WIN", "LOSE", "FLAT-MIXED")
    assert [r["different"] for r in blend.compare_numbers(a, b, "__row__", ["pred_0"]).collect()] == [3]


def test_static_and_audit(spark):
    train = spark.createDataFrame([(31, 40, 1), (32, 41, 0), (33, 41, 0), (34, 41, 1), (35, None, 0), (36, None, 1), (37, 90, 1)], "id int, x int, y int")
    test = spark.createDataFrame([(41, None), (42, 90), (43, 12), (44, 90)], "id int, x int")
    assert {(r["x"], r["n"], r["labels"]) for r in audit.label_conflicts(train, ["x"], "y").collect()} == {(41, 3, 2), (None, 2, 2)}
    assert {r["x"] for r in audit.vector_overlap(train, test, ["x"]).collect()} == {None, 90}
    with pytest.raises(ValueError):
        static.check_profile(train, ["x", "customer_id"])
    with pytest.raises(ValueError):
        static.check_profile(train, ["x"], ["x"], limit=2)
    assert audit.column_roles(train)["id"] == ["id"]
    nested = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    assert static.nested_text(nested).first()[0] == '{"a":1}'
    assert spark.createDataFrame([("a\nb|c",)], "s string").select(static.brief(F.col("s"))).first()[0] == "a b/c"
    static.assert_superset(test, train.select("id", "x", "y"))
    with pytest.raises(ValueError):
        static.assert_superset(train, test)


def test_estimators(spark):
    rows = [(i, float(i % 10), "ab"[i % 2], f"word{i % 3} text", i % 10 >= 5, i % 3 - (i < 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, c string, t string, label boolean, __fold__ int").withColumn("label", F.col("label").cast("double"))
    for kind in ("logistic", "forest", "boosted"):
        p = learning.build_pipeline(kind, ["x"], ["c"], "t")
        got = learning.predict(p.fit(df), df.withColumn("c", F.lit("new")))
        assert got.count() == 60 and got.filter("pred_0 between 0 and 1").count() == 60
    oof = learning.out_of_fold(df, learning.build_pipeline("logistic", ["x"]), intervals.Assigned((0, 1, 2)))
    assert oof.filter("__fold__ < 0 and pred_0 is not null").count() == 0
    with pytest.raises(ValueError):
        learning.build_pipeline("catboost", ["x"])


def test_ranges_stay_the_same(spark, tmp_path):
    """Places, cuts, ranks, AUC and quantiles of many distinct values with payload, written and collected, against NumPy."""
    import numpy as np

    rng = np.random.default_rng(6)
    n = 400_000
    score = rng.permutation(n) / n + rng.random()
    y = (rng.random(n) < score / score.max()).astype(int)
    order = rng.permutation(n)
    import pandas as pd

    pd.DataFrame({"id": np.arange(n), "score": score, "y": y, "t": order // 7, "u": order, "text": "payload " * 5, "more": rng.random(n)}).to_parquet(f"{tmp_path}/in.parquet")
    df = spark.read.parquet(f"{tmp_path}/in.parquet").repartition(5)
    rank = np.empty(n)
    rank[np.argsort(score)] = np.arange(1, n + 1)
    pos = y.sum()
    auc = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert abs(metrics.roc_auc(df, "y", "score").first()["roc_auc"] - auc) < 1e-12
    metrics.roc_auc(df, "y", "score").write.parquet(f"{tmp_path}/auc")
    assert abs(spark.read.parquet(f"{tmp_path}/auc").first()["roc_auc"] - auc) < 1e-12
    top = np.argsort(-score)
    hit = np.cumsum(y[top])
    ap = (hit / np.arange(1, n + 1))[y[top] == 1].mean()
    assert abs(metrics.average_precision(df, "y", "score").first()["average_precision"] - ap) < 1e-9

    splits.time_holdout(df, 0.2, ["t", "u"], 1000).write.parquet(f"{tmp_path}/h")
    held = spark.read.parquet(f"{tmp_path}/h")
    assert {r["split"]: r["count"] for r in held.groupBy("split").count().collect()} == {"valid": 80_000, "gap": 1000, "train": 319_000}
    assert held.filter((F.col("split") == "valid") != (F.col("u") >= 320_000)).count() == 0 and held.columns == [*df.columns, "split"]
    splits.time_folds(df, 4, ["t", "u"], 50).write.parquet(f"{tmp_path}/f")
    folds = spark.read.parquet(f"{tmp_path}/f")
    want = F.when(F.col("u") < 80_000, -1).otherwise(F.floor((F.col("u") - 80_000) / 80_000))
    assert folds.filter(F.col(splits.FOLD) != want).count() == 0
    ranges.number(df, ["t", "u"], "place").write.parquet(f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").filter("place <> u").count() == 0
    blend.average_ranks(df, "score", "r").select("id", "r").write.parquet(f"{tmp_path}/r")
    got = spark.read.parquet(f"{tmp_path}/r").toPandas().set_index("id")["r"].sort_index().to_numpy()
    assert (got == rank).all()
    q = ranges.quantiles(df, "more", (0, 0.1, 0.5, 0.999, 1)).first()["q"]
    assert np.abs(np.array(q) - np.quantile(df.select("more").toPandas()["more"], (0, 0.1, 0.5, 0.999, 1))).max() < 1e-12
    groups = ranges.quantiles(df.withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), "more", (0.25,), ("g",)).collect()
    pdf = df.select("id", "more").toPandas()
    for r in groups:
        own = pdf["more"][pdf["id"] % 3 == (r["g"] or 0)]
        assert abs(r["q"][0] - np.quantile(own, 0.25)) < 1e-12 and r["n"] == len(own)


def test_ranges_of_odd_values(spark):
    """Nulls, quotes, ties, times and one value alone keep their order."""
    import datetime as dt

    rows = [(i, v, dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=i // 4)) for i, v in enumerate([None, "", "a'b", "a\\b", "z", "z", "ä", None, "'", "z"] * 5)]
    df = spark.createDataFrame(rows, "i int, s string, t timestamp_ntz")
    for cols in (["s", "i"], ["t", "s", "i"], ["t", "i"]):
        got = [r["i"] for r in ranges.number(df, cols, "n").orderBy("n").collect()]
        assert got == [r["i"] for r in df.orderBy(*cols).collect()]
        cuts = ranges.at_ranks(df, cols, [0, 7, 49])
        for k, v in cuts.items():
            assert df.filter(ranges.reached(df, cols, v)).count() == len(rows) - k
    assert ranges.number(df.limit(0), ["i"], "n").count() == 0 and ranges.at_ranks(df.limit(0), ["i"], [0]) == {}
    assert [r["q"] for r in ranges.quantiles(df.limit(0), "i", (0.5,)).collect()] in ([], [[None]])
    sizes = [r["count"] for r in splits.group_fold(df, 3, "i").groupBy(splits.FOLD).count().collect()]
    assert sorted(sizes) == [16, 17, 17]


def test_multiclass_metrics(spark):
    import itertools

    rows = [("a", 0.7, 0.2, 0.1), ("b", 0.3, 0.3, 0.4), ("c", 0.1, 0.2, 0.7), ("a", 0.2, 0.5, 0.3), ("b", 0.1, 0.8, 0.1), ("c", 0.4, 0.4, 0.2), ("a", 0.6, 0.1, 0.3)]
    df, cols = spark.createDataFrame(rows, "y string, pa double, pb double, pc double"), {"a": "pa", "b": "pb", "c": "pc"}
    at = {"a": 1, "b": 2, "c": 3}
    auc = lambda p, q: sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q))
    rest = {k: auc([r[at[k]] for r in rows if r[0] == k], [r[at[k]] for r in rows if r[0] != k]) for k in at}
    n = {k: sum(r[0] == k for r in rows) for k in at}
    got = lambda **how: metrics.multiclass_roc_auc(df, "y", cols, **how).first()["roc_auc"]
    assert abs(got() - sum(rest.values()) / 3) < 1e-12
    assert abs(got(average="weighted") - sum(rest[k] * n[k] for k in at) / 7) < 1e-12
    pair = {}
    for a, b in itertools.combinations(at, 2):
        one = lambda k, o: auc([r[at[k]] for r in rows if r[0] == k], [r[at[k]] for r in rows if r[0] == o])
        pair[a, b] = (one(a, b) + one(b, a)) / 2
    assert abs(got(multi_class="ovo") - sum(pair.values()) / 3) < 1e-12
    weight = {(a, b): n[a] + n[b] for a, b in pair}
    assert abs(got(multi_class="ovo", average="weighted") - sum(pair[k] * weight[k] for k in pair) / sum(weight.values())) < 1e-12
    import math

    loss = metrics.multiclass_log_loss(df, "y", cols).first()["log_loss"]
    assert abs(loss + sum(math.log(r[at[r[0]]]) for r in rows) / 7) < 1e-12
    with pytest.raises(Exception, match="no probability"):
        metrics.multiclass_log_loss(df, "y", {"a": "pa", "b": "pb"}).collect()


def test_early_screen(spark):
    df = spark.createDataFrame([(1, 0.9, "a"), (0, 0.5, "a"), (1, 0.1, "a"), (0, 0.8, "b"), (1, 0.2, "b")], "y int, p double, w string")
    windows = {"all": F.lit(True), "b": F.col("w") == "b", "none": F.col("w") == "z"}
    got = {r["window"]: r for r in metrics.early_screen(df, "y", "p", windows, {"all": 0.71, "b": 0.6, "none": 0.1}, {"all": 0.02, "b": 0.05, "none": 1.0}).collect()}
    ap = (1 + 2 / 4 + 3 / 5) / 3
    assert abs(got["all"]["score"] - ap) < 1e-12 and not got["all"]["failed"]
    assert got["b"]["score"] == 0.5 and got["b"]["failed"] and got["none"]["failed"] and got["none"]["score"] is None
    with pytest.raises(ValueError):
        metrics.early_screen(df, "y", "p", windows, {"all": 1.0}, {"all": 0.0})


def test_class_rank_averages_and_saved_blends(spark, tmp_path):
    make = lambda v: spark.createDataFrame([(i, -1 if x is None else 0, x, None if x is None else 1 - x) for i, x in enumerate(v)], "__row__ long, __fold__ int, pred_0 double, pred_1 double")
    a, b = make([0.9, None, 0.2, 0.6]), make([0.8, None, 0.7, 0.1])
    got = blend.rank_average_classes([a, b]).orderBy("__row__").collect()
    # ranks of class 0: 3, 1, 2 and 3, 2, 1; of class 1 the other way round
    assert got[1]["pred_0"] is None
    for i, (x, y) in {0: (3, 1), 2: (1.5, 2.5), 3: (1.5, 2.5)}.items():
        assert abs(got[i]["pred_0"] - x / (x + y)) < 1e-12 and abs(got[i]["pred_0"] + got[i]["pred_1"] - 1) < 1e-12
    for name, t in (("a", a), ("b", b)):
        tables.save_predictions(t, f"{tmp_path}/{name}", [], {})
    out = blend.blend_files([(f"{tmp_path}/a", 0.5), (f"{tmp_path}/b", 0.5)], f"{tmp_path}/ab", spark, {"name": "half"})
    assert [None if r["pred_0"] is None else round(r["pred_0"], 9) for r in out.orderBy("__row__").collect()] == [0.85, None, 0.45, 0.35]
    meta = tables.read_predictions(spark, f"{tmp_path}/ab")[1]
    assert meta["contract"]["name"] == "half" and [p["weight"] for p in meta["contract"]["parts"]] == [0.5, 0.5]
