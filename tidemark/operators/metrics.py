"""Evaluation metrics as aggregations; none of them collects rows.

Average precision and ROC AUC work on one row for each distinct score, so ties
count as one threshold. Both are the exact step sums, not trapezoids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.mergeable import Aggregate, aggregate
from tidemark.functions.ranges import running

EPSILON = 1e-15


def _steps(df: DataFrame, by: list[str], score: str, extra: list[Column]) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("_s")).agg(*extra)


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, positives, average_precision`` of each group; NULL without positives."""
    keys = list(by)
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = _steps(rows, keys, score, [F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")])
    c = running(steps, keys, "_s", ("tp", "n"), descending=True)
    out = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("tp").alias("positives"), F.sum(F.col("tp") * F.col("c_tp") / F.col("c_n")).alias("_t"))
    return out.select(*keys, "n", "positives", (F.col("_t") / F.when(F.col("positives") > 0, F.col("positives"))).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, positives, roc_auc``: the share of (positive, negative) pairs in order, ties half; NULL with one class."""
    keys = list(by)
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = _steps(rows, keys, score, [F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")])
    c = running(steps, keys, "_s", ("tp",), descending=True).withColumn("_neg", F.col("n") - F.col("tp"))
    # each negative loses to the positives above it and ties with those at its score
    won = F.sum(F.col("_neg") * (F.col("c_tp") - F.col("tp") / 2))
    out = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("tp").alias("positives"), F.sum("_neg").alias("_q"), won.alias("_w"))
    return out.select(*keys, "n", "positives", (F.col("_w") / F.when(F.col("positives") * F.col("_q") > 0, F.col("positives") * F.col("_q"))).alias("roc_auc"))


def regression(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, mae, mse, rmse, r2``."""
    e = F.col(actual) - F.col(predicted)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(actual).alias("_v"))
    return out.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.when(F.col("_v") > 0, F.col("_v"))).alias("r2"))


def labels_from(probability: Column | Sequence[Column], threshold: float = 0.5) -> Column:
    """Binary: 1 from the threshold on. Several columns: the place of the greatest, the first on ties."""
    if isinstance(probability, Column):
        return (probability >= threshold).cast("int")
    a = F.array(*probability)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def classification(df: DataFrame, label: str, predicted: str, average: str = "binary", by: Sequence[str] = ()) -> DataFrame:
    """``n, accuracy, precision, recall, f1`` for class 1 (``binary``), or ``macro``, ``micro``, ``weighted`` means over classes."""
    keys = list(by)
    if average == "binary":
        t, p = F.col(label) == 1, F.col(predicted) == 1
        c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(predicted)).alias("_ok"), F.count_if(t & p).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"))
        return c.select(*keys, "n", (F.col("_ok") / F.col("n")).alias("accuracy"), *_rates(F.col("tp"), F.col("fp"), F.col("fn")))
    cells = df.groupBy(*keys, F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_c")).otherwise(0)
    true = cells.groupBy(*keys, F.col("_y").alias("_k")).agg(F.sum("_c").alias("_support"), F.sum(hit).alias("_tp"), F.lit(0).cast("long").alias("_said"))
    said = cells.groupBy(*keys, F.col("_p").alias("_k")).agg(F.lit(0).cast("long").alias("_support"), F.lit(0).cast("long").alias("_tp"), F.sum("_c").alias("_said"))
    each = true.unionByName(said).groupBy(*keys, "_k").agg(*[F.sum(c).alias(c) for c in ("_support", "_tp", "_said")])
    total = F.sum("_support")
    if average == "micro":
        out = each.groupBy(*keys).agg(total.alias("n"), F.sum("_tp").alias("tp"), F.sum("_said").alias("said"))
        return out.select(*keys, "n", (F.col("tp") / F.col("n")).alias("accuracy"), *_rates(F.col("tp"), F.col("said") - F.col("tp"), F.col("n") - F.col("tp")))
    rated = each.select("*", *_rates(F.col("_tp"), F.col("_said") - F.col("_tp"), F.col("_support") - F.col("_tp")))
    mean = (lambda c: F.avg(c)) if average == "macro" else (lambda c: F.sum(F.col(c) * F.col("_support")) / total)
    return rated.groupBy(*keys).agg(total.alias("n"), (F.sum("_tp") / total).alias("accuracy"), *[mean(c).alias(c) for c in ("precision", "recall", "f1")])


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    rate = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    return [rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1")]


def multiclass_log_loss(df: DataFrame, label: str, probabilities: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``n, log_loss`` over classes: ``probabilities`` maps a class to its column; rows are scaled to add up to 1."""
    total = sum((F.col(c) for c in probabilities.values()), F.lit(0.0))
    own = F.lit(None).cast("double")
    for k, c in probabilities.items():
        own = F.when(F.col(label) == k, F.col(c)).otherwise(own)
    p = F.least(F.greatest(own / total, F.lit(EPSILON)), F.lit(1 - EPSILON))
    known = F.when(own.isNull(), F.raise_error(F.lit("a label has no probability column"))).otherwise(p)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(known)).alias("log_loss"))


def multiclass_roc_auc(df: DataFrame, label: str, probabilities: dict[str, str], average: str = "macro", multi_class: str = "ovr") -> DataFrame:
    """``n, roc_auc`` over classes: each against the rest (``ovr``) or each pair both ways (``ovo``).

    ``macro`` is the plain mean; ``weighted`` weighs a class, or a pair, by its rows.
    """
    if multi_class not in ("ovr", "ovo") or average not in ("macro", "weighted"):
        raise ValueError("multi_class must be ovr or ovo, average macro or weighted")
    one = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("s"))
    long = df.select(F.col(label).alias("_label"), F.explode(F.array(*[one(k, c) for k, c in probabilities.items()])).alias("p")).select("_label", "p.k", "p.s")
    if multi_class == "ovr":
        each = roc_auc(long.withColumn("_y", (F.col("_label") == F.col("k")).cast("int")), "_y", "s", by=("k",))
        mean = F.avg("roc_auc") if average == "macro" else F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")
        return each.agg(F.max("n").alias("n"), mean.alias("roc_auc"))
    # a row counts for its own class against each other one, and for each other class against its own
    names = list(probabilities)
    rival = F.explode(F.when(F.col("_label") == F.col("k"), F.array(*[F.lit(n) for n in names])).otherwise(F.array("_label")))
    pairs = long.withColumn("r", rival).filter("r <> k").withColumn("_y", (F.col("_label") == F.col("k")).cast("int"))
    both = roc_auc(pairs, "_y", "s", by=("k", "r"))
    pair = both.groupBy(F.least("k", "r").alias("a"), F.greatest("k", "r").alias("b")).agg(F.avg("roc_auc").alias("auc"), F.max("n").alias("m"))
    mean = F.avg("auc") if average == "macro" else F.sum(F.col("auc") * F.col("m")) / F.sum("m")
    return pair.agg(mean.alias("roc_auc")).crossJoin(df.agg(F.count(F.lit(1)).alias("n"))).select("n", "roc_auc")  # one row each


def log_loss(df: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col(probability), F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def probability_faults(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """How many rows have a probability out of 0..1 or not finite, or (several columns) don't add up to 1."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)
    off = F.abs(sum((F.col(c) for c in columns), F.lit(0.0)) - 1) > tolerance if len(columns) > 1 else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("out_of_range"), F.count_if(~bad & off).alias("not_summing"))


def windowed(df: DataFrame, windows: dict[str, Column], metric: Callable[..., DataFrame], *args, **how) -> DataFrame:
    """The metric of each named window; a row counts in every window whose condition it meets."""
    member = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in windows.items()]))
    return metric(df.withColumn("window", F.explode(member)), *args, by=("window",), **how)


def early_screen(df: DataFrame, label: str, score: str, windows: dict[str, Column], references: dict[str, float], drops: dict[str, float], metric: Callable[..., DataFrame] = average_precision, value: str = "average_precision") -> DataFrame:
    """``window, score, reference, delta, failed`` of each window: failed if the score is below its reference by more than its drop, or there is none.

    An experiment of which a window failed isn't worth fitting on further folds.
    """
    if set(windows) != set(references) or set(windows) != set(drops):
        raise ValueError("each window needs a reference and a drop")
    named = df.sparkSession.createDataFrame([(w, float(references[w]), float(drops[w])) for w in windows], "window string, reference double, _drop double")
    got = windowed(df, windows, metric, label, score).select("window", F.col(value).alias("score"))
    both = named.join(got, "window", "left").withColumn("delta", F.col("score") - F.col("reference"))
    return both.select("window", "score", "reference", "delta", F.coalesce(F.col("delta") < -F.col("_drop"), F.lit(True)).alias("failed"))


def custom(df: DataFrame, metric: Callable, columns: Sequence[str], by: Sequence[str], name: str = "score") -> DataFrame:
    """A user's function of pandas columns, once for each group, which must fit a worker; or an :class:`~tidemark.operators.mergeable.Aggregate`, for groups of any size."""
    if isinstance(metric, Aggregate):
        return aggregate(df, metric, columns, by, name)

    def run(pdf):
        return pdf[list(by)].head(1).assign(**{name: float(metric(*[pdf[c] for c in columns]))})

    schema = df.select(*by).schema.add(name, "double")
    return df.groupBy(*by).applyInPandas(run, schema)


#: Metrics by name: the function, whether a higher value is better, and what it is computed from.
REGISTRY: dict[str, tuple[Callable[..., DataFrame], bool, str]] = {
    **{m: (regression, m == "r2", "value") for m in ("mae", "mse", "rmse", "r2")},
    **{m: (classification, True, "label") for m in ("accuracy", "precision", "recall", "f1")},
    "log_loss": (log_loss, False, "probability"),
    "roc_auc": (roc_auc, True, "score"),
    "average_precision": (average_precision, True, "score"),
}


def score(df: DataFrame, metric: str, label: str, prediction: str, average: str | None = None) -> float | None:
    """One metric of the whole table. ``f1``, ``precision`` and ``recall`` need an ``average``; ``module:function`` is a user's own (a function needs the table in one worker, a mergeable aggregate doesn't)."""
    if ":" in metric:
        import importlib

        module, _, name = metric.partition(":")
        own = getattr(importlib.import_module(module), name)
        if isinstance(own, type) and issubclass(own, Aggregate):
            own = own()
        if isinstance(own, Aggregate):
            found = aggregate(df, own, [label, prediction]).first()
            return found["score"] if found else None
        return custom(df.withColumn("_all", F.lit(1)), own, [label, prediction], ["_all"]).first()["score"]
    if metric not in REGISTRY:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(REGISTRY)}")
    fn, _, _ = REGISTRY[metric]
    if fn is classification:
        if metric != "accuracy" and average is None:
            raise ValueError(f"{metric} needs an average")
        return fn(df, label, prediction, average or "micro").first()[metric]
    if metric == "log_loss" and sum(probability_faults(df, [prediction]).first()[c] for c in ("out_of_range", "not_summing")):
        raise ValueError("a probability is missing or out of range")
    return fn(df, label, prediction).first()[metric]
