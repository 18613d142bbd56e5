"""Quality classifier by Bradley-Terry pairwise ranking.

A labelled document with label 1 is preferred over one with label 0. Under
Bradley-Terry the preference has probability ``sigmoid(w . (x_a - x_b))``, so
``w`` is fitted by logistic loss on feature differences of preference pairs.
The threshold is a quantile of the training documents' scores: the share of
label 0 among them. Scores are mapped to 0..1 by a logistic curve that takes
the threshold to ``AT_THRESHOLD``.

Learning uses every labelled row and every pair of a good and a bad one
(:func:`learn`). Pairs aren't made: rows are counted and added up by label and by
bins of their score, ``1 / BINS`` wide, and a pair stands for its bins' mean
scores. A Newton step is two passes over the stored features of the labelled rows;
only sums by bin reach the driver. The threshold and the scores' spread are exact
quantiles over all of them. Scoring reads whole texts of all rows. A null or empty text
has the features of an empty document. With only one label to learn from, the
score is that label's share. Repeated rows count as rows; rows of ``docs`` and
``labels`` with null ids or labels aren't learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ranges import quantiles
from tidemark.llm import _features, _spark, _text

MAX_LABELLED = 20_000
MAX_PAIRS = 200_000
AT_THRESHOLD = 0.7
RIDGE = 1e-3
ROUNDS = 40
BINS = 16  # of a score's unit, in ``learn``
FAR = 64  # scores beyond are in the outermost bins


def features(texts: pa.Array) -> np.ndarray:
    """Surface features, their square roots, and squares of the first two."""
    x = _features.surface(_features.Slice(texts))
    return np.column_stack([x, np.sqrt(np.abs(x)), x[:, :2] ** 2])


def labelled(docs: DataFrame, labels: DataFrame, label: str, extract, doc_id: str = "doc_id", text: str = "text", bound: int = MAX_LABELLED, fold=lambda key: F.lit(0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of at most ``bound`` labelled rows of ``docs``, in a fixed order.

    Of rows that share an id the one counts whose features sort first.
    """
    _spark.small_batches(docs.sparkSession)
    key = F.col(f"`{doc_id}`")
    marks = labels.select(key.alias("_id"), F.col(f"`{label}`").cast("double").alias("_y")).dropna()
    marks = marks.orderBy(F.xxhash64("_id"), "_id", "_y").limit(bound)  # so the broadcast is bounded
    rows = docs.select(key.alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(marks), "_id").select(F.xxhash64("_id").alias("_at"), "_y", "_text", fold("_id").cast("int").alias("_fold"), "_id")

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                x = extract(part.column(2))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat, part.column(3), part.column(4)], ["_at", "_y", "_x", "_fold", "_id"])

    schema = T.StructType([rows.schema["_at"], rows.schema["_y"], T.StructField("_x", T.ArrayType(T.DoubleType())), rows.schema["_fold"], rows.schema["_id"]])
    made = rows.mapInArrow(run, schema)
    found = made.groupBy("_id", "_y", "_at", "_fold").agg(F.min("_x").alias("_x")).drop("_id").toPandas()
    if found.empty:
        return np.zeros((0, extract(pa.array([""])).shape[1])), np.zeros(0), np.zeros(0, np.int64)
    x = np.stack(found["_x"].to_numpy())
    order = np.lexsort([*x.T[::-1], found["_y"], found["_at"]])
    return x[order], found["_y"].to_numpy()[order], found["_fold"].to_numpy(np.int64)[order]


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float  # of w . x
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        z = self.slope * (self.raw(x) - self.threshold) + at
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _constant(d: int, good: int, bad: int) -> Ranking:
    """Of one label, or none: the score is the label's share."""
    share = float(np.clip(good / (good + bad), 0.01, 0.99)) if good + bad else 0.5
    shift = np.log(share / (1 - share)) - np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
    return Ranking(np.zeros(d), np.ones(d), np.zeros(d), -shift, 1.0)


def examples(docs: DataFrame, labels: DataFrame, label: str, extract, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_y`` and the features ``_x`` of all labelled rows of ``docs``. Of rows that share an id the one counts whose features sort first."""
    _spark.small_batches(docs.sparkSession)
    key = F.col(f"`{doc_id}`").alias("_id")
    marks = labels.select(key, F.col(f"`{label}`").cast("double").alias("_y")).dropna()
    rows = docs.select(key, F.col(f"`{text}`").alias("_text")).filter("_id is not null")

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                x = extract(part.column(1))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["_id", "_x"])

    # features before the join: they are shuffled, texts aren't
    made = rows.mapInArrow(run, T.StructType([rows.schema["_id"], T.StructField("_x", T.ArrayType(T.DoubleType()))]))
    return made.join(marks, "_id").groupBy("_id", "_y").agg(F.min("_x").alias("_x")).select("_y", "_x")


def _sums(rows: DataFrame, d: int, width: int, make) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums by key, over all rows, of ``make(x, good)``: keys and ``width`` numbers for each. Tasks add up their own rows first."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            keys, values = make(x, batch.column(0).to_numpy(zero_copy_only=False) > 0.5)
            own, at = np.unique(keys, return_inverse=True)
            total = np.zeros((len(own), width))
            np.add.at(total, at, values)
            for k, v in zip(own.tolist(), total, strict=True):
                held[k] = held[k] + v if k in held else v
        if held:
            flat = pa.array(np.concatenate(list(held.values())))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.FixedSizeListArray.from_arrays(flat, width).cast(pa.list_(pa.float64()))], ["k", "v"])

    parts = rows.select("_y", "_x").mapInArrow(run, "k long, v array<double>")
    found = parts.groupBy("k").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).toPandas().sort_values("k")  # a row a key
    return found["k"].to_numpy(np.int64), found.drop(columns="k").to_numpy(np.float64).reshape(-1, width)


def learn(rows: DataFrame, d: int) -> Ranking:
    """The ranking of all pairs of ``rows``, a written table of labels ``_y`` and ``d`` features ``_x``."""
    keys, sums = _sums(rows, d, d + 1, lambda x, good: (good.astype(np.int64), np.column_stack([np.ones(len(x)), x])))
    count = dict(zip(keys.tolist(), sums[:, 0], strict=True))
    n_good, n_bad = int(count.get(1, 0)), int(count.get(0, 0))
    if not n_good or not n_bad:
        return _constant(d, n_good, n_bad)
    n = n_good + n_bad
    mean = _steady(sums[:, 1:].sum(axis=0) / n)
    squares = _sums(rows, d, d, lambda x, good: (np.zeros(len(x), np.int64), (x - mean) ** 2))[1][0]
    scale = _steady(np.sqrt(squares / n))
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = np.zeros(d)
    for _ in range(ROUNDS):  # Newton steps
        place = _placing(mean, scale, w)
        keys, sums = _sums(rows, d, d + 1, lambda x, good: (lambda z, at: (at + good * _KEYS, np.column_stack([np.ones(len(z)), z])))(*place(x)))  # noqa: B023
        good = keys >= _KEYS
        a, b = sums[good], sums[~good]  # counts and sums of features by bin
        wrong = 1 / (1 + np.exp(np.clip((a[:, 1:] @ w / a[:, 0])[:, None] - b[:, 1:] @ w / b[:, 0], -500, 500)))  # that the bad one is preferred
        pairs = n_good * n_bad
        gradient = ((wrong @ b[:, 0]) @ a[:, 1:] - (a[:, 0] @ wrong) @ b[:, 1:]) / pairs - RIDGE * w
        both = wrong * (1 - wrong)
        weight = np.zeros(2 * _KEYS)
        weight[keys[good]], weight[keys[~good]] = both @ b[:, 0], a[:, 0] @ both
        own = _sums(rows, d, d, lambda x, good: _squares(*place(x), good, weight))[1]  # noqa: B023
        cross = a[:, 1:].T @ both @ b[:, 1:]
        step = np.linalg.solve((own - cross - cross.T) / pairs + RIDGE * np.eye(d), gradient)
        w = _steady(w + step)
        if np.abs(step).max() < 1e-5:
            break
    model = Ranking(mean, scale, w, 0.0, 1.0)

    def raw(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False) > 0.5), pa.array(model.raw(x))], ["good", "raw"])

    scored = _spark.stored(rows.select("_y", "_x").mapInArrow(raw, "good boolean, raw double"))
    threshold = float(quantiles(scored, "raw", (n_bad / n,)).first()["q"][0])
    middle = {r["good"]: r["q"][0] for r in quantiles(scored, "raw", (0.5,), ("good",)).collect()}
    spread = middle[True] - middle[False]
    return Ranking(mean, scale, w, threshold, 4.0 / max(spread, 1e-6) if spread > 0 else 1.0)


_KEYS = 2 * FAR * BINS + 1


def _steady(values: np.ndarray) -> np.ndarray:
    """To twelve digits: sums of floats come in any order."""
    return np.array([float(f"{v:.12g}") for v in values])


def _placing(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    def place(x):
        z = np.clip((x - mean) / scale, -8, 8)
        return z, np.clip(np.rint((z * w).sum(axis=1) * BINS), -FAR * BINS, FAR * BINS).astype(np.int64) + FAR * BINS

    return place


def _squares(z: np.ndarray, at: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(z.shape[1]), (z * weight[at + good * _KEYS][:, None]).T @ z


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """The ranking of rows in memory, from pairs drawn of them; a plain form for small tables, the query learns by :func:`learn`."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
    if not len(good) or not len(bad):
        return _constant(d, len(good), len(bad))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(5)
    n = min(MAX_PAIRS, 40 * max(len(good), len(bad)))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(d)
    for _ in range(ROUNDS):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (1 - p) / n - RIDGE * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    threshold = float(np.quantile(raw, len(bad) / len(y)))
    spread = float(np.median(raw[good]) - np.median(raw[bad]))
    return Ranking(mean, scale, w, threshold, 4.0 / max(spread, 1e-6) if spread > 0 else 1.0)


def apply(docs: DataFrame, model, extract, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` of every row, by ``model.score(extract(texts))``."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = [F.col(f"`{c}`") for c in keep]
    kept = docs.select(*cols)

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "__text"):
                score = shared.value.score(extract(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], "score"])

    return docs.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, kept.schema.add("score", "double"))


def rank(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Every row of ``docs`` with its ``score``, learned from all rows of ``labels``."""
    rows = _spark.stored(examples(docs, labels, label, features, doc_id, text))
    model = learn(rows, features(pa.array([""])).shape[1])
    return apply(docs, model, features, keep, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _spark.table(spark, sf_dir, "labels")
    held = _spark.fixed_remainder(F.col("doc_id"), 4) == 2
    scored = rank(docs.withColumn("held_out", held), labels.filter(~held), keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))
