import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, history, metrics, splits
from tidemark.plans import experiment

SPEC = {"name": "e1", "parent": "customer_history", "families": ["customer_merchant"], "folds": [["2026-01-10", "2026-01-20"], ["2026-01-20", "2026-02-01"]]}


@pytest.mark.parametrize("family", ["customer_history", "device_global", "merchant_new_customers", "account_consistency", "merchant_acceleration", "device_sharing"])
def test_certification(spark, family):
    assert all(experiment.certify(spark, family).values())


def test_certification_sees_a_leak(spark, monkeypatch):
    leaky = history.Family("leaky", lambda: {"x": F.sum("_x").over(history.Window.partitionBy("_c"))}, "_c", ("customer_id", "amount"))
    monkeypatch.setitem(history.FAMILIES, "leaky", leaky)
    got = experiment.certify(spark, "leaky")
    assert not got["strict_past"] and not got["future_independence"]


def test_spec():
    assert experiment.Spec.load(json.dumps(SPEC)).families == ("customer_merchant",)
    for bad in ({**SPEC, "more": 1}, {k: v for k, v in SPEC.items() if k != "folds"}, {**SPEC, "parent": "x"}, {**SPEC, "families": ["x"]}, {**SPEC, "families": ["customer_history"]}, {**SPEC, "folds": SPEC["folds"][::-1]}):
        with pytest.raises(ValueError):
            experiment.Spec.load(json.dumps(bad))


def test_run_and_report(spark):
    r = random.Random(1)
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=2 * i), r.choice("abcdef"), r.choice("de"), r.choice("mnop"), "g", "l", None, float(r.randint(1, 99)), 5.0) for i in range(360)]
    df = spark.createDataFrame(rows, "transaction_id int, timestamp timestamp_ntz, customer_id string, device_id string, merchant_id string, merchant_category string, location string, device_type string, amount double, account_age_days double")
    df = df.withColumn("fraud", ((F.col("amount") > 60) | (F.col("merchant_id") == "m")).cast("int"))
    got = experiment.run(df, experiment.Spec.load(json.dumps(SPEC)), require_certified=False)
    assert set(got["scores"]["parent"]) == {0, 1} and got["verdict"] in ("WIN", "LOSE", "FLAT-MIXED")
    assert "| 1 |" in experiment.card(got)
    text = audit.report(df, df.filter("amount > 50"), ["amount"], ["customer_id"], "fraud", "timestamp")
    assert "## Drift of customer_id" in text and "| amount |" in text
    audit.require_time_sorted(df, "timestamp", "transaction_id")
    with pytest.raises(ValueError):
        audit.require_time_sorted(df, "timestamp", "amount")


def test_dispatchers(spark):
    df = spark.range(60).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 7 / 7).alias("p"), (F.col("id") % 5).alias("g"), F.timestamp_seconds("id").alias("timestamp"))
    for m in metrics.REGISTRY:
        value = metrics.score(df.withColumn("h", (F.col("p") > 0.5).cast("int")), m, "y", "h" if m in ("accuracy", "precision", "recall", "f1") else "p", "macro")
        assert isinstance(value, float)
    with pytest.raises(ValueError):
        metrics.score(df, "f1", "y", "p")
    with pytest.raises(ValueError):
        metrics.score(df, "nope", "y", "p")
    marks = set()
    for kind in splits.KINDS:
        out, mark = splits.make_splits(df, kind, ["id"], 3, label="y", group="g", bounds=(("1970-01-01 00:00:20", "1970-01-01 00:00:40"),))
        assert out.count() == 60 and out.filter(f"{splits.FOLD} is null").count() == 0
        assert splits.make_splits(df, kind, ["id"], 3, label="y", group="g", bounds=(("1970-01-01 00:00:20", "1970-01-01 00:00:40"),))[1] == mark
        marks.add(mark)
    assert len(marks) == len(splits.KINDS)
