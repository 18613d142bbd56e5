"""The history families against plain Python, and their properties."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import DAY, split_past, windowed_distinct
from tidemark.operators import history

from .brute_history import brute

SCHEMA = "i int, timestamp timestamp, customer_id string, device_id string, merchant_id string, merchant_category string, location string, amount double, account_age_days double"
D = 86400


def frame(spark, ts, cust=None, dev=None, merch=None, cat=None, loc=None, amt=None, age=None):
    n = len(ts)
    fill = lambda x, d: x if x is not None else [d] * n
    cols = zip(ts, fill(cust, "x"), fill(dev, "d"), fill(merch, "m"), fill(cat, "g"), fill(loc, "l"), fill(amt, 1.0), fill(age, 1.0), strict=True)
    rows = [(i, t if isinstance(t, dt.datetime) else dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t), c, d, m, g, lo, float(a), None if y is None else float(y)) for i, (t, c, d, m, g, lo, a, y) in enumerate(cols)]
    return spark.createDataFrame(rows, SCHEMA)


def as_dicts(rows):
    """Rows of ``SCHEMA`` as the plain functions read them; a missing key is a value of its own."""
    out = []
    for i, t, c, d, m, g, lo, x, age in rows:
        us = round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        out.append({"i": i, "us": us, "c": c or "?", "d": d or "?", "m": m, "g": g or "?", "l": lo or "?", "x": x, "born": None if age is None else us // DAY - int(age)})
    return out


def check(spark, rows, names=None, **how):
    """All columns of the families against the plain functions."""
    want = brute(as_dicts(rows))
    names = names or [f for f in history.FAMILIES if not f.endswith("velocity_1h")]
    got = {r["i"]: r for r in history.features(spark.createDataFrame(rows, SCHEMA), names, **how).collect()}
    made = [c for f in names for c in history.FAMILIES[f].columns()]
    assert set(made) <= set(want[0])
    for row, w in zip(rows, want, strict=True):
        for c in made:
            v = got[row[0]][c]
            assert (v is None) == (w[c] is None) and (v is None or abs(v - w[c]) < 1e-6), (row, c, v, w[c])


@pytest.mark.parametrize("seed", [3, 8])
def test_families_equal_plain_functions(spark, seed):
    check(spark, stream(seed, 140))


@pytest.mark.parametrize("over,lead", [(0, "_c"), (30, "_d"), (10, "_m")])
def test_heavy_keys_equal_plain_functions(spark, over, lead):
    """Keys read chunk by chunk, all of them or the heaviest alone."""
    check(spark, stream(21, 110), [f.name for f in history.FAMILIES.values() if f.lead == lead and not f.name.endswith("velocity_1h")], split_over=over)


def test_heavy_keys_are_dealt_by_time(spark):
    """A key with more than a third of all rows is spread over its chunks of time, and nothing is dealt by that key alone."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"c{i % 50}", f"d{i % 9}", "big" if i % 5 < 2 else f"m{i % 70}", "g", "l", 1.0, 1.0) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    families = [history.FAMILIES[f] for f in ("merchant_history", "merchant_acceleration")]
    got = history._split(history.prepare(df.filter("merchant_id = 'big'")).drop("_age", "_born"), "_m", families, [("m", "c")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert len([d for d in dealt if "_chunk" not in d]) == 1  # the carried rows, one a chunk
    assert len(dealt) > 1
    parts = [r["n"] for r in got.repartition(8, "_m", "_chunk").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) > 3 and max(parts) < 0.5 * sum(parts)
    whole = history.features(df, ["merchant_history", "merchant_acceleration"])
    split = history.features(df, ["merchant_history", "merchant_acceleration"], split_over=3000)
    assert split.exceptAll(whole).count() == 0 and split.count() == 9000


def test_edges_of_windows(spark):
    """Rows exactly at, and a microsecond on either side of, the ends of every window, with ties."""
    start, rows = dt.datetime(2025, 5, 5, 5, 55), []
    for hours in (1, 2, 24, 7 * 24, 30 * 24):
        for us in (-1, 0, 0, 1):
            at = start + dt.timedelta(hours=hours, microseconds=us)
            for c, d, m in (("p", "u", "r"), ("q", "u", "r")):
                rows.append((len(rows), at, c, d, m, "k", "n", 7.0 + len(rows), 3.0))
    rows += [(len(rows) + k, start, c, "u", "r", None, "n", 2.5, a) for k, (c, a) in enumerate((("p", 3.0), ("p", 2.0), ("q", None)))]
    check(spark, rows)


def test_single_hour_families(spark):
    rows = stream(12, 90)
    for name, key in (("customer_velocity_1h", "customer_prior_1h_count"), ("device_velocity_1h", "device_prior_1h_count")):
        want = {r["i"]: w[key] for r, w in zip(as_dicts(rows), brute(as_dicts(rows)), strict=True)}
        assert {r["i"]: r[key] for r in history.features(spark.createDataFrame(rows, SCHEMA), [name]).collect()} == want


def stream(seed, n=80):
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 0, 1, 1800, 3600, 86399, 86400, 3 * D])
        out.append((i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), r.choice(["a", "b", None]), r.choice(["d", "e", None]), r.choice("mno"), r.choice(["g", None]), r.choice(["l", "k", None]), float(r.randint(0, 90)), float(r.randint(1, 5))))
    return out


ALL = [f for f in history.FAMILIES if f not in ("customer_velocity_1h", "device_velocity_1h")]


def all_features(spark, rows):
    out = history.features(spark.createDataFrame(rows, SCHEMA), ALL).collect()
    made = [c for f in ALL for c in history.FAMILIES[f].columns()]
    return {r["i"]: tuple(None if r[c] is None else round(float(r[c]), 8) for c in made) for r in out}


def test_ties_future_duplicates_and_labels(spark):
    rows = stream(4)
    base = all_features(spark, rows)
    ties = {}
    for r in rows:
        ties.setdefault(r[1], []).append(r)
    turned = [r for t in sorted(ties) for r in reversed(ties[t])]
    assert all_features(spark, turned) == base
    cut = rows[50][1]
    changed = [r if r[1] < cut else (r[0], r[1], "z", "z", "z", "z", "z", 5.0, 2.0) for r in rows]
    after = all_features(spark, changed)
    assert all(after[r[0]] == base[r[0]] for r in rows if r[1] < cut)
    twice = all_features(spark, [*rows, (999, *rows[-1][1:])])
    assert twice[rows[-1][0]] == twice[999] == base[rows[-1][0]]


def test_prior_stream_continues(spark):
    rows = stream(9)
    cut = rows[40][1]
    prior, now = (spark.createDataFrame([r for r in rows if (r[1] < cut) == early], SCHEMA) for early in (True, False))
    whole = history.features(spark.createDataFrame(rows, SCHEMA), ["customer_history", "device_sharing"]).filter(f"timestamp >= '{cut}'")
    assert sorted(map(str, history.seeded(prior, now, ["customer_history", "device_sharing"]).collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(ValueError):
        history.seeded(now, prior, ["customer_history"])


def test_build_requests(spark):
    df = frame(spark, [0, 1])
    assert history.build(df, "merchant_acceleration", ["merchant_log_rate_change_1h_vs_previous_1h", "merchant_transactions_1h"]).columns[-2:] == ["merchant_log_rate_change_1h_vs_previous_1h", "merchant_transactions_1h"]
    for bad, error in (([], ValueError), (["nope"], ValueError), (["merchant_transactions_1h"] * 2, ValueError), ("merchant_transactions_1h", TypeError)):
        with pytest.raises(error):
            history.build(df, "merchant_acceleration", bad)
    with pytest.raises(Exception, match="whole"):
        history.features(frame(spark, [0, 1], age=[1.5, 1]), ["account_consistency"]).collect()
    with pytest.raises(Exception, match="not negative"):
        history.features(frame(spark, [0, 1], amt=[-1, 1]), ["customer_history"]).collect()
    assert history.features(df.limit(0), ["customer_history"]).count() == 0


def test_sweep_and_split_equal_frames(spark):
    df = history.prepare(spark.createDataFrame(stream(2, 150), SCHEMA)).cache()
    for open_left in (False, True):
        from tidemark.functions.windows import trailing, with_distinct

        a = df.withColumn("k", F.size(F.collect_set("_c").over(trailing(2 * DAY, "_m", open_left=open_left))).cast("long")).select("i", "k")
        c = with_distinct(df.repartition("_m"), "_m", "_c", {"k": (2 * DAY, open_left)}).select("i", "k")
        assert sorted(a.collect()) == sorted(c.collect())
        b = windowed_distinct(df, "_m", "_c", 2 * DAY, "k", open_left).select("i", "k")
        assert sorted(a.collect()) == sorted(b.collect())
    from tidemark.functions.windows import past

    w = past("_c")
    a = df.select("i", F.count("*").over(w).alias("n"), F.min("us").over(w).alias("lo"), F.max("us").over(w).alias("hi"), F.sum("_x").over(w).alias("x"))
    b = split_past(df, "_c", {"x": F.col("_x")}, bucket=2 * DAY).select("i", F.col("prior_count").alias("n"), F.col("prior_first").alias("lo"), F.col("prior_last").alias("hi"), "x")
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    from tidemark.functions.windows import split_trailing, trailing

    for open_left, bucket in ((False, None), (True, 5 * DAY)):
        w = trailing(2 * DAY, "_c", open_left=open_left)
        a = df.select("i", F.count("*").over(w).alias("n"), F.sum("_x").over(w).alias("x"))
        b = split_trailing(df, "_c", 2 * DAY, {"x": F.col("_x")}, open_left, bucket).select("i", F.col("recent_count").alias("n"), "x")
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_few_shuffles(spark, data):
    """All families of a key share one exchange."""
    df = spark.createDataFrame(stream(3), SCHEMA)
    plan = history.features(df, ["customer_history", "customer_device", "customer_merchant", "amount_30d", "customer_new_merchants"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = history.features(df, ALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_each_measure_is_one_window(spark):
    rows = frame(spark, [3600 * i for i in range(24)])
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        out = history.features(rows, ["customer_history", "customer_device", "customer_velocity", "customer_velocity_1h"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # by customer: count, last, first, mean amount, mean and deviation of logs, counts up to an hour, a day and a week before;
    # by pair: count and last
    assert plan.count("windowspecdefinition(") == 11


@pytest.mark.parametrize("over", [10**6, 20])
def test_many_rows_are_dealt_into_tasks_of_their_number(spark, monkeypatch, over):
    """However few bytes are shuffled; and windows keep a part of a busy key's rows on disk. Results are the same."""
    df = spark.createDataFrame(stream(31, 150), SCHEMA)
    families = [f for f in history.FAMILIES if not f.endswith("velocity_1h")]
    want = history.features(df, families)
    monkeypatch.setattr(history, "TASK_ROWS", 10)
    monkeypatch.setattr(history, "WINDOW_ROWS", 25)
    try:
        got = history.features(df, families, split_over=over)
        assert spark.conf.get(history._SPILL) == "25"
        a, b = (x.toPandas().set_index("i").sort_index() for x in (got, want))
        if over > 150:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            assert history.features(df, families).rdd.getNumPartitions() == 15
    finally:
        spark.conf.unset(history._SPILL)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for c in (c for f in families for c in history.FAMILIES[f].columns()):
        x, y = a[c].astype(float), b[c].astype(float)
        assert (x.isna() == y.isna()).all() and not ((x - y).abs() > 1e-6).any(), c
