"""Declarative feature experiments: a spec, certification of its families, and a report of scores against a parent.

The spec is a small JSON document; certification runs each family over a tied
random stream and over changed copies of it; the experiment builds parent and
candidate features, predicts out of fold and scores windows. All of it is
driver-side control over DataFrame plans.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import blend, history, intervals, learning, metrics, splits
from tidemark.operators.static import PROFILES, add_static
from tidemark.session import stored

PROPERTIES = ("strict_past", "tie_isolation", "tie_order", "duplicate_in_tie", "future_independence", "label_independence", "continuation")


@dataclass(frozen=True)
class Spec:
    """What is tried: families on top of a parent profile, folds, an estimator, and the gates of a win."""

    name: str
    parent: str
    families: tuple[str, ...]
    folds: tuple[tuple[str, ...], ...]  # (valid from, valid until), or (train before, valid from, valid until)
    estimator: str = "logistic"
    target: str = "fraud"
    time: str = "timestamp"
    min_delta: float = 0.0005
    seed: int = 42
    params: dict = dataclasses.field(default_factory=dict)  # of the estimator

    def __post_init__(self):
        if self.parent not in PROFILES:
            raise ValueError(f"unknown parent profile {self.parent!r}")
        if unknown := [f for f in self.families if f not in history.FAMILIES]:
            raise ValueError(f"unknown families {unknown}")
        if again := [f for f in self.families if f in PROFILES[self.parent]]:
            raise ValueError(f"the parent has {again} already")
        if any(f[-2] >= f[-1] or f[0] > f[-2] for f in self.folds) or list(self.folds) != sorted(self.folds):
            raise ValueError("folds must be half-open intervals in order, and train before they validate")

    @classmethod
    def load(cls, text: str) -> Spec:
        """From JSON; unknown and missing keys are errors."""
        raw = json.loads(text)
        fields = {f.name: f for f in dataclasses.fields(cls)}
        if unknown := sorted(set(raw) - set(fields)):
            raise ValueError(f"unknown keys: {unknown}")
        if missing := sorted(n for n, f in fields.items() if f.default is f.default_factory is dataclasses.MISSING and n not in raw):
            raise ValueError(f"missing keys: {missing}")
        raw["families"] = tuple(raw["families"])
        raw["folds"] = tuple(tuple(f) for f in raw["folds"])
        return cls(**raw)


_COLUMNS = "i int, timestamp timestamp, customer_id string, device_id string, merchant_id string, merchant_category string, location string, amount double, account_age_days double, fraud int"


def _stream(seed: int, n: int = 60) -> list[tuple]:
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 0, 1, 3600, 86_400, 200_000])
        out.append((i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), r.choice(["a", "b", None]), r.choice(["d", "e"]), r.choice("mn"), r.choice(["g", None]), r.choice(["l", "k"]), float(r.randint(0, 90)), float(r.randint(1, 5)), r.randint(0, 1)))
    return out


def certify(spark: SparkSession, family: str, seed: int = 1) -> dict[str, bool]:
    """Whether each of ``PROPERTIES`` holds for a family, on one random stream full of ties."""
    names = list(history.FAMILIES[family].columns())

    def made(rows: Sequence[tuple]) -> dict[int, tuple]:
        got = history.features(spark.createDataFrame(list(rows), _COLUMNS), [family]).collect()
        return {r["i"]: tuple(None if r[c] is None else round(float(r[c]), 9) for c in names) for r in got}

    rows = _stream(seed)
    base, cut, last = made(rows), rows[len(rows) // 2][1], rows[-1]
    by_time = sorted(rows, key=lambda r: (r[1], -r[0]))
    early = [r for r in rows if r[1] < cut]
    changed = [r if r[1] < cut else (r[0], r[1], "z", "z", "z", "z", "z", 1.0, 1.0, 1) for r in rows]
    twice = made([*rows, (-1, *last[1:])])
    tied = [r for r in rows if r[1] == last[1]]
    alone = made([r for r in rows if r[1] < last[1]] + [last])
    got_changed = made(changed)
    prior, now = (spark.createDataFrame([r for r in rows if (r[1] < cut) == x], _COLUMNS) for x in (True, False))
    seeded = {r["i"]: tuple(None if r[c] is None else round(float(r[c]), 9) for c in names) for r in history.seeded(prior, now, [family]).collect()}
    return {
        "strict_past": made(early) == {r[0]: base[r[0]] for r in early},
        "tie_isolation": alone[last[0]] == base[last[0]] and len(tied) >= 1,
        "tie_order": made(by_time) == base,
        "duplicate_in_tie": twice[-1] == twice[last[0]] == base[last[0]],
        "future_independence": all(got_changed[r[0]] == base[r[0]] for r in early),
        "label_independence": made([(*r[:-1], 1 - r[-1]) for r in rows]) == base,
        "continuation": seeded == {r[0]: base[r[0]] for r in rows if r[1] >= cut},
    }


def certify_table(df: DataFrame, family: str, cut: str, row_id: str = "transaction_id", target: str = "fraud", time: str = "timestamp") -> DataFrame:
    """``property, rows, differing``: the same properties on a user's own table, as joins of its features with those of changed copies.

    ``cut``: where past and future are parted. ``differing`` counts rows whose features should be the same and aren't.
    """
    names = list(history.FAMILIES[family].columns())
    at = F.lit(cut).cast("timestamp_ntz")
    early, late = df.filter(F.col(time) < at), df.filter(F.col(time) >= at)
    # values of the same rows, to nine digits of their own size
    close = lambda a, b: a.eqNullSafe(b) | (F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(a)) * 1e-9)

    def made(rows: DataFrame) -> DataFrame:
        return history.features(rows, [family], time).select(F.col(row_id).alias("id"), F.col(time).alias("at"), *[F.col(c).cast("double").alias(c) for c in names])

    base = stored(made(df))
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != row_id]
    other = late.withColumns({c: F.lit("another") for c in strings})
    last = df.agg(F.max(time)).first()[0]
    tied = df.filter(F.col(time) == F.lit(last))
    one = tied.orderBy(row_id).limit(1)  # of the last tie
    again = one.withColumn(row_id, F.lit(-1).cast(df.schema[row_id].dataType))
    variants = {
        "strict_past": made(early),
        "tie_isolation": made(df.filter(F.col(time) < F.lit(last)).unionByName(one)).filter(F.col("at") == F.lit(last)),
        "tie_order": made(df.repartition(7, F.xxhash64(row_id)).sortWithinPartitions(F.xxhash64(row_id))),
        "duplicate_in_tie": made(df.unionByName(again)).filter(F.col("id") != F.lit(-1).cast(df.schema[row_id].dataType)),
        "future_independence": made(early.unionByName(other)).filter(F.col("at") < at),
        "label_independence": made(df.withColumn(target, 1 - F.col(target))) if target in df.columns else base,
        "continuation": history.seeded(early, late, [family], time).select(F.col(row_id).alias("id"), F.col(time).alias("at"), *[F.col(c).cast("double").alias(c) for c in names]),
    }
    parts = []
    for name in PROPERTIES:
        both = variants[name].alias("a").join(base.alias("b"), F.col("a.id") == F.col("b.id"), "left")
        equal = F.col("b.id").isNotNull()
        for c in names:
            equal = equal & close(F.col(f"a.{c}"), F.col(f"b.{c}"))
        parts.append(both.agg(F.lit(name).alias("property"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(equal, F.lit(False))).alias("differing")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_folds(df: DataFrame, label: str, prediction: str = "pred_0") -> dict[int, float | None]:
    """Average precision of each validated fold."""
    rows = metrics.average_precision(df.filter(F.col(splits.FOLD) >= 0), label, prediction, by=(splits.FOLD,)).collect()
    return {r[splits.FOLD]: r["average_precision"] for r in rows}


def screen(df: DataFrame, spec: Spec, fold: int, best: float, margin: float = 0.0) -> tuple[float | None, bool]:
    """The candidate's score on one fold, and whether it is worth running the others: not worse than ``best`` by more than ``margin``."""
    families = (*PROFILES[spec.parent], *spec.families)
    score = _scored(df, dataclasses.replace(spec, folds=(spec.folds[fold],)), families)[1].get(0)
    return score, score is not None and score - best >= -margin


def _scored(df: DataFrame, spec: Spec, families: Sequence[str]) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions with these families, and their scores by fold."""
    folds = intervals.calendar(spec.folds, spec.time, df.schema[spec.time].dataType.simpleString())
    base = add_static(df, spec.time)
    frame = history.features(base, families, spec.time) if families else base
    columns = ["log_amount", "hour", "weekday", *[c for f in families for c in history.FAMILIES[f].columns()]]
    filled = learning.impute(frame.withColumns({c: F.col(c).cast("double") for c in columns}), {c: 0.0 for c in columns}).withColumn("label", F.col(spec.target).cast("double"))
    pipeline = learning.build_pipeline(spec.estimator, columns, seed=spec.seed, **spec.params)
    out = learning.out_of_fold(filled, pipeline, folds)  # rows of gaps and after the last fold stay without a prediction
    return out, score_folds(out, spec.target)


def run(df: DataFrame, spec: Spec, require_certified: bool = True) -> dict:
    """Scores of the parent and of the candidate by fold, their differences and the verdict."""
    spark = df.sparkSession
    certified = {f: certify(spark, f) for f in spec.families}
    if require_certified and not all(all(v.values()) for v in certified.values()):
        raise ValueError(f"not certified: {certified}")
    scores = {}
    for who, families in (("parent", PROFILES[spec.parent]), ("candidate", (*PROFILES[spec.parent], *spec.families))):
        _, scores[who] = _scored(df, spec, families)
    deltas = [scores["candidate"][k] - scores["parent"][k] for k in sorted(scores["parent"])]
    return {"spec": dataclasses.asdict(spec), "certified": certified, "scores": scores, "deltas": deltas, "verdict": blend.verdict(deltas, spec.min_delta)}


def replay(spark: SparkSession, path: str, labels: DataFrame, label: str, stored: dict[int, float], tolerance: float = 1e-9) -> dict[int, float]:
    """Recomputes a saved prediction table's scores, verifying its content; raises where they differ from ``stored``."""
    from tidemark.sources.tables import read_predictions

    df, _ = read_predictions(spark, path)
    got = score_folds(df.join(labels, blend.ROW), label)
    if off := {k: (v, got.get(k)) for k, v in stored.items() if got.get(k) is None or abs(got[k] - v) > tolerance}:
        raise ValueError(f"scores differ from those stored: {off}")
    return got


def card(result: dict) -> str:
    """The result as a markdown page."""
    s = result["spec"]
    lines = [f"# {s['name']}", "", f"Families on top of `{s['parent']}`: {', '.join(s['families'])}. Verdict: **{result['verdict']}**.", "", "| fold | parent | candidate | delta |", "|-|-|-|-|"]
    for k, d in zip(sorted(result["scores"]["parent"]), result["deltas"], strict=True):
        lines.append(f"| {k} | {result['scores']['parent'][k]:.6f} | {result['scores']['candidate'][k]:.6f} | {d:+.6f} |")
    return "\n".join([*lines, ""])
