"""Mergeable aggregates, the cache of parts, tables certified as they are, and columns of the caller."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, metrics, static
from tidemark.operators.mergeable import Aggregate, BinnedPrecision, aggregate
from tidemark.plans import experiment
from tidemark.sources.matrix import cached


class Spread(Aggregate):
    """A user's own: the largest difference of two columns, and in how many rows they differ."""

    def zero(self):
        return (0.0, 0)

    def update(self, state, a, b):
        off = np.abs(a - b)
        return max(state[0], float(off.max())), state[1] + int((off > 0).sum())

    def merge(self, a, b):
        return max(a[0], b[0]), a[1] + b[1]

    def finish(self, state):
        return state[0] + 1000 * state[1]


def test_own_aggregates_merge(spark, monkeypatch):
    from tidemark.operators import mergeable

    monkeypatch.setattr(mergeable, "HELD", 3)
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("h"), (F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 10 == 0, F.col("id") + 3.0).otherwise(F.col("id")).alias("b")).repartition(13)
    got = {(r.g, r.h): r.score for r in aggregate(df, Spread(), ["a", "b"], ["g", "h"]).collect()}
    assert got == {(g, str(g) if g else None): 3.0 + 1000 * sum(i % 7 == g for i in range(0, 1000, 10)) for g in range(7)}
    assert aggregate(df, Spread(), ["a", "b"]).first()["score"] == 3.0 + 100_000
    assert aggregate(df.limit(0), Spread(), ["a", "b"], ["g"]).count() == 0
    assert metrics.score(df, "tests.test_scale_forms:Spread", "a", "b") == 3.0 + 100_000


def test_average_precision_of_ten_million_rows(spark):
    """In one group, without any task that holds it; equal to the exact metric, as scores are multiples of a step."""
    df = spark.range(10_000_000).select((F.xxhash64("id") % 1000 / 1000).alias("p"), F.col("id")).select(F.abs("p").alias("p"), (F.abs(F.xxhash64("id", F.lit(1)) % 1000) / 1000 < F.abs("p") * 0.5).cast("int").alias("y"))
    got = aggregate(df, BinnedPrecision(1000), ["y", "p"]).first()["score"]
    want = metrics.average_precision(df, "y", "p").first()["average_precision"]
    assert abs(got - want) < 1e-9


def test_cache_makes_what_changed(spark, tmp_path):
    made = []

    def make(df):
        made.append(sorted(df.inputFiles()))
        return df.select("i", (F.col("v") * 2).alias("w"))

    source, path = f"{tmp_path}/in", f"{tmp_path}/made"
    for k in range(6):
        spark.createDataFrame([(10 * k + j, float(j)) for j in range(3)], "i int, v double").coalesce(1).write.mode("append").parquet(source)
    first, n = cached(spark, source, {"r": 1}, make, path, 4)
    assert n == len(made) > 1 and sorted((r.i, r.w) for r in first.collect()) == sorted((10 * k + j, 2.0 * j) for k in range(6) for j in range(3))
    spark.sparkContext.setJobGroup("hit", "no job may start")
    again, n = cached(spark, source, {"r": 1}, make, path, 4)
    assert n == 0 and list(spark.sparkContext.statusTracker().getJobIdsForGroup("hit")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert again.count() == 18
    before = len(made)
    spark.createDataFrame([(99, 9.0)], "i int, v double").coalesce(1).write.mode("append").parquet(source)
    more, n = cached(spark, source, {"r": 1}, make, path, 4)
    assert n == 1 and len(made) == before + 1 and more.count() == 19
    assert cached(spark, source, {"r": 2}, make, path, 4)[1] > 1
    whole, n = cached(spark, source, {"r": 1}, make, f"{path}1", 1)
    assert n == 1 and whole.count() == 19
    with pytest.raises(ValueError, match="no Parquet"):
        cached(spark, path + "1/none", {}, make, path) if (tmp_path / "made1" / "none").mkdir() is None else None


def _events(spark, n=80):
    import datetime as dt
    import random

    r, t, rows = random.Random(2), 0, []
    for i in range(n):
        t += r.choice([0, 0, 60, 4000, 90_000])
        rows.append((i, r.choice("ab"), r.choice("de"), r.choice("mn"), r.choice(["x", None]), r.choice("lk"), float(r.randint(1, 50)), 3.0, dt.datetime(2029, 1, 1) + dt.timedelta(seconds=t), r.randint(0, 1)))
    return spark.createDataFrame(rows, "transaction_id int, customer_id string, device_id string, merchant_id string, merchant_category string, location string, amount double, account_age_days double, timestamp timestamp_ntz, fraud int")


def test_table_is_certified_as_it_is(spark, monkeypatch):
    df = _events(spark)
    got = experiment.certify_table(df, "customer_merchant", "2029-01-10").collect()
    assert [r.property for r in got] == list(experiment.PROPERTIES) and all(r.rows > 0 and r.differing == 0 for r in got)
    family = history.FAMILIES["customer_merchant"]
    from pyspark.sql import Window

    leaky = lambda: {"customer_merchant_prior_count": F.count(F.lit(1)).over(Window.partitionBy("_c", "_m"))}
    import dataclasses

    monkeypatch.setitem(history.FAMILIES, "customer_merchant", dataclasses.replace(family, columns=leaky))
    bad = {r.property: r.differing for r in experiment.certify_table(df, "customer_merchant", "2029-01-10").collect()}
    assert bad["strict_past"] > 0


@pytest.mark.parametrize("over", [10**9, 5])
def test_columns_of_the_caller_come_back(spark, over):
    df = _events(spark)
    taken = {"us": F.lit("mine"), "_x": F.lit(1), "_c": F.array(F.lit(2)), "_age": F.create_map(F.lit("k"), F.lit(3)), "_now": F.struct(F.lit(4).alias("s")), "_part": F.lit(b"5"), "_chunk": F.lit(6), "_own": F.lit(7), "_mean_y": F.lit(8), "__p": F.lit(9)}
    own = df.withColumns(taken)
    families = ["customer_history", "merchant_history", "customer_merchant", "device_sharing"]
    got = history.features(own, families, split_over=over)
    plain = history.features(df, families)
    assert got.columns[: len(own.columns)] == own.columns and got.select(*own.columns).dtypes == own.dtypes
    for r in got.collect():
        assert (r["us"], r["_x"], r["_c"], r["_age"], r["_now"][0], bytes(r["_part"]), r["_chunk"], r["_own"], r["_mean_y"], r["__p"]) == ("mine", 1, [2], {"k": 3}, 4, b"5", 6, 7, 8, 9)
    names = [c for f in families for c in history.FAMILIES[f].columns()]
    a, b = (x.select("transaction_id", *names).toPandas().set_index("transaction_id").sort_index().astype(float) for x in (got, plain))
    assert ((a - b).abs().fillna(0) < 1e-9).all().all() and (a.isna() == b.isna()).all().all()


def test_deviation_of_a_heavy_key_is_exact(spark):
    df = _events(spark).withColumn("amount", F.lit(1e9))
    for over in (10**9, 5):
        worst = history.features(df, ["customer_history"], split_over=over).agg(F.max("customer_prior_std_log_amount")).first()[0]
        assert worst < 1e-12


def test_groups_by_ranges(spark):
    rows = [(i, None if i % 5 == 0 else i % 3, (i * 7) % 40, None if i % 4 == 0 else float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, g int, t int, v double").repartition(4)
    got = {r.i: (r.past_group_count, r.past_group_mean) for r in history.past_group(df, "g", ("t", "i"), "v").collect()}
    for i, g, t, _ in rows:
        past = [x for x in rows if x[1] == g and (x[2], x[0]) < (t, i)]
        real = [x[3] for x in past if x[3] is not None]
        assert got[i][0] == len(past) and (got[i][1] is None) == (not real) and (not real or abs(got[i][1] - sum(real) / len(real)) < 1e-9)


def test_merchants_as_a_category(spark):
    df = _events(spark).withColumn("merchant_id", F.col("transaction_id").cast("string")).drop("timestamp")
    out = static.training_frame(df, "fraud", profile="merchant_onehot")
    assert "merchant_id" in out.columns and "customer_id" not in out.columns
    assert "merchant_id" not in static.training_frame(df, "fraud").columns
    with pytest.raises(ValueError, match="not allowed"):
        static.check_profile(df, ["merchant_id"], profile="velocity")
    many = spark.range(5_002).select(F.col("id").cast("string").alias("merchant_id"), F.lit(1).alias("fraud"))
    with pytest.raises(ValueError, match="values"):
        static.training_frame(many, "fraud", profile="merchant_onehot")
