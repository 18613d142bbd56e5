"""Forms that tables of many rows take: counts of keys, trailing counts of keys with many rows, marks of gaps."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, splits


def _trips(spark, n=400):
    made = spark.range(n).withColumn("t", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.pmod(F.xxhash64("id"), F.lit(40 * 24 * 6)) * 600_000_000))
    key = lambda k, of: F.concat(F.lit(k), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(of)).cast("string"))
    return made.select("id", F.col("t").alias("timestamp"), key("c", 4).alias("customer_id"), key("d", 3).alias("device_id"), key("m", 5).alias("merchant_id"), key("l", 3).alias("location"), key("g", 3).alias("merchant_category"), (F.col("id") % 3).cast("int").alias("account_age_days"))

@pytest.mark.parametrize("family", [f for f in history.FAMILIES if "amount" not in history.FAMILIES[f].needs])
def test_large_tables_without_an_amount(spark, family):
    """More rows than ``split_over``: heavy keys are counted, and the amount, which the family doesn't read, isn't there."""
    rows = _trips(spark)
    whole, split = (history.features(rows, [family], split_over=n).orderBy("id").collect() for n in (10_000, 60))
    for a, b in zip(whole, split, strict=True):
        assert [round(x, 9) if isinstance(x, float) else x for x in a] == [round(x, 9) if isinstance(x, float) else x for x in b]

def test_trailing_counts_keep_sums_from_the_first_row(spark, capsys):
    """Counts of trailing frames: no frame moves its begin along, or a key's rows would be added up for each of them."""
    counted = ["customer_velocity_1h", "device_velocity", "merchant_history", "device_sharing", "customer_new_merchants", "merchant_new_customers", "merchant_acceleration"]
    history.features(_trips(spark), counted).explain()
    frames = [x for x in capsys.readouterr().out.split("specifiedwindowframe(")[1:] if x.startswith("RangeFrame")]
    assert frames and all("unboundedpreceding" in x[:60] for x in frames)


def test_the_first_gap_is_marked(spark):
    rows = spark.range(60).select("id", (F.col("id") * 3 % 60).alias("t"), F.col("id").alias("u"))
    got = {(r["t"], r["u"]): r[splits.FOLD] for r in splits.time_folds(rows, 2, ["t", "u"], 7, mark=-2).collect()}
    want = [*[-1] * 13, *[-2] * 7, *[0] * 20, *[1] * 20]
    assert [got[k] for k in sorted(got)] == want
    plain = {(r["t"], r["u"]): r[splits.FOLD] for r in splits.time_folds(rows, 2, ["t", "u"], 7).collect()}
    assert [plain[k] for k in sorted(plain)] == [max(k, -1) for k in want]


@pytest.mark.parametrize("name", ["time_series_folds", "time_folds_wide"])
def test_fold_queries_mark_the_gap(name, spark, data, same):
    from tidemark import catalog

    fn = catalog.queries()[name]
    same(fn, catalog.oracle_sql()[name])
    assert fn(spark, data).filter(F.col("__fold__") == -2).count() == 20


def test_category_statistics_round_ties_as_sql_does(spark, tmp_path):
    """Among means of whole labels over many counts, some end in a 5 after the digits that are kept."""
    import duckdb

    from tidemark import catalog

    rows = spark.range(10_000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.when(F.pmod(F.xxhash64("id"), F.lit(14)) < 5, 60.0).otherwise(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["by_type"] for r in catalog.queries()["category_statistics"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(c.sql(catalog.oracle_sql()["category_statistics"]).df()[["event_id", "by_type"]].itertuples(index=False))
    assert [k for k in want if got[k] != want[k]] == []


def test_chunks_of_heavy_keys_hold_rows(spark):
    """A heavy key whose rows are far apart has chunks of about half of ``split_over`` rows, not one for each day (F31)."""
    from tidemark.functions import frames

    day = 86_400_000_000
    rows = spark.range(1200).select("id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.floor(F.col("id") / 2) * day).alias("timestamp"), (F.col("id") % 2).cast("string").alias("merchant_id"), (F.col("id") % 90).cast("double").alias("amount"))
    out = history.prepare(rows)
    heavy = history._heavy(out, {"_m": 0}, 100)["_m"]
    own = frames.in_chunks(out.join(heavy, "_m"), day)
    assert own.select("_m", frames.CHUNK).distinct().count() <= 2 * 14
    assert own.groupBy("_m", frames.CHUNK).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= 100
    whole, split = (history.features(rows, ["merchant_amount"], split_over=n).orderBy("id").collect() for n in (10_000, 100))
    for a, b in zip(whole, split, strict=True):
        assert [round(x, 9) if isinstance(x, float) else x for x in a] == [round(x, 9) if isinstance(x, float) else x for x in b]


@pytest.mark.parametrize("name", ["impute_and_scale", "customer_history", "merchant_amount", "split_key_history", "split_key_trailing"])
def test_order_lines_are_joined_once(spark, data, name):
    from tidemark import catalog

    assert not [f for f in catalog.queries()[name](spark, data).inputFiles() if "lineitem" in f]  # the result reads the joined rows


def test_learners_get_their_rows_in_bounded_parts(spark, monkeypatch):
    from tidemark.operators import learning

    class Parts(learning.Estimator):
        def _fit(self, df):
            return df.rdd.getNumPartitions()

    monkeypatch.setattr(learning, "ROWS_A_TASK", 10)
    monkeypatch.setitem(learning.ESTIMATORS, "forest", lambda seed: Parts())
    rows = spark.range(0, 100, 1, 1).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("label"))
    learner = learning.build_pipeline("forest", ["x"]).getStages()[-1]
    assert learner._fit(rows) == 10
