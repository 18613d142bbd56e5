"""Profiling, drift and leakage audits. Each is one or two aggregations over the table."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranges import quantiles, range_of

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _each(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n, missing, missing_rate``."""
    n = F.count(F.lit(1))
    cols = columns or df.columns
    return _each(df, [F.struct(F.lit(c).alias("column"), n.alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.avg(F.col(c).isNull().cast("int")).alias("missing_rate")) for c in cols])


def missing_patterns(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent patterns of missing columns (1: missing) and their rows."""
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(k)


def numeric_profile(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, std, extremes, percentiles (linear between values), 3-IQR outliers and bias-corrected skew.

    Exact percentiles come from counts of distinct values in order; ``exact=False`` uses sketches, in one scan.
    """
    if exact:
        first = {c: None for c in columns} | {r["column"]: r["q"] for r in quantiles(_long(df, columns), "value", PERCENTILES, by=("column",)).collect()}
    else:
        first = df.agg(*[F.percentile_approx(c, list(PERCENTILES), 10_000).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        q = [None if first[c] is None else float(x) for x in (first[c] or [None] * len(PERCENTILES))]
        spread = None if q[2] is None else q[4] - q[2]
        n, skew = F.count(c), F.skewness(c)
        far = F.count_if((F.col(c) < q[2] - 3 * spread) | (F.col(c) > q[4] + 3 * spread)) if spread is not None else F.lit(0).cast("long")
        fixed = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))
        tiles = [F.lit(v).cast("double").alias(f"p{round(p * 100):02d}") for v, p in zip(q, PERCENTILES, strict=True)]
        out.append(F.struct(F.lit(c).alias("column"), n.alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), *tiles, far.alias("extreme"), fixed.alias("skew")))
    return _each(df, out)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value`` of each number of each row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share``; null is a value."""
    n = df.count() or 1
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / n)


def categorical_profile(df: DataFrame, columns: Sequence[str], rare: int = 10) -> DataFrame:
    """``column, distinct, singletons, rare, top_n`` from one count per value of all columns at once."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.count("value").alias("distinct"), F.count_if((F.col("n") == 1) & F.col("value").isNotNull()).alias("singletons"), F.count_if((F.col("n") < rare) & F.col("value").isNotNull()).alias("rare"), F.max("n").alias("top_n"))


def tv_drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``column, tv_distance, only_a, only_b``: half the sum of differences of the shares."""
    x = value_counts(a, column).select(F.col("value").alias("_va"), F.col("share").alias("_sa"))
    y = value_counts(b, column).select(F.col("value").alias("_vb"), F.col("share").alias("_sb"))
    both = x.join(y, F.col("_va").eqNullSafe(F.col("_vb")), "full_outer")
    gone = lambda c: F.count_if(F.col(c).isNull())
    diff = F.sum(F.abs(F.coalesce("_sa", F.lit(0.0)) - F.coalesce("_sb", F.lit(0.0)))) / 2
    return both.agg(diff.alias("tv_distance"), gone("_sb").alias("only_a"), gone("_sa").alias("only_b")).select(F.lit(column).alias("column"), "*")


def numeric_drift(a: DataFrame, b: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles of both tables side by side."""
    both = _long(a, columns).withColumn("side", F.lit("a")).unionByName(_long(b, columns).withColumn("side", F.lit("b")))
    q = quantiles(both, "value", at, by=("column", "side"))
    sides = q.groupBy("column").agg(*[F.max(F.when(F.col("side") == t, F.col("q"))).alias(t) for t in "ab"])
    every = a.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(sides, "column", "left").select("column", *[F.col(t)[i].alias(f"{t}_p{round(p * 100):02d}") for t in "ab" for i, p in enumerate(at)])


def entity_overlap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, in_a, in_b, shared`` distinct values, nulls left out."""
    tag = lambda d, t: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*", F.lit(t).alias("t"))
    each = tag(a, 1).unionByName(tag(b, 2)).filter("value is not null").groupBy("column", "value").agg(F.max((F.col("t") == 1).cast("int")).alias("a"), F.max((F.col("t") == 2).cast("int")).alias("b"))
    return each.groupBy("column").agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"), F.sum(F.col("a") * F.col("b")).alias("shared"))


def label_conflicts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Groups of rows equal in ``features`` with more than one label; null is a value."""
    labels = F.count_distinct(label) + F.max(F.col(label).isNull().cast("int"))
    return df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), labels.alias("labels")).filter("labels > 1")


def vector_overlap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of ``columns`` in both tables; null equals null."""
    return a.select(*columns).intersect(b.select(*columns))


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``n, distinct, duplicates``."""
    cols = list(columns or df.columns)
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``a`` that ``b`` doesn't have; null equals null."""
    return a.select(column).distinct().exceptAll(b.select(column).distinct())


def time_profile(df: DataFrame, time: str, ordinal: str) -> DataFrame:
    """``n, first, last, distinct, backward``: rows earlier than the one before them by ``ordinal``.

    Neighbours are found within ranges of the ordinal and across their ends, not in one task.
    """
    from pyspark.sql import Window

    own = df.select(F.col(ordinal).alias("_o"), F.col(time).alias("_t"))
    rows = own.withColumn("_p", range_of(own, ["_o"]))
    back = (F.col("_t") < F.lag("_t").over(Window.partitionBy("_p").orderBy("_o"))).cast("int")
    parts = rows.withColumn("_b", back).groupBy("_p").agg(F.sum("_b").alias("b"), F.min_by("_t", "_o").alias("f"), F.max_by("_t", "_o").alias("l"))
    ends = parts.withColumn("e", (F.col("f") < F.lag("l").over(Window.orderBy("_p"))).cast("int"))  # one row a partition
    backward = ends.agg((F.coalesce(F.sum("b"), F.lit(0)) + F.coalesce(F.sum("e"), F.lit(0))).alias("backward"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("first"), F.max("_t").alias("last"), F.count_distinct("_t").alias("distinct"))
    return whole.crossJoin(backward)  # one row each


def require_time_sorted(df: DataFrame, time: str, ordinal: str) -> DataFrame:
    if time_profile(df, time, ordinal).first()["backward"]:
        raise ValueError(f"{time} must not go back")
    return df


def time_overlap(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """Both ranges, and whether they overlap."""
    x, y = (d.agg(F.min(time).alias(f"{t}_first"), F.max(time).alias(f"{t}_last")) for d, t in ((a, "a"), (b, "b")))
    return x.crossJoin(y).withColumn("overlap", (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")))  # one row each


def time_like(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> DataFrame:
    """``column, parseable, time_like``: whether at least ``share`` of the values are times."""
    ok = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("timestamp").isNotNull().cast("int")))
    return _each(df, [F.struct(F.lit(c).alias("column"), ok(c).alias("parseable"), F.coalesce(ok(c) >= share, F.lit(False)).alias("time_like")) for c in columns])


def target_leaks(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``column, equal, correlation`` with the target."""
    num = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")}
    corr = lambda c: F.corr(c, target) if c in num else F.lit(None).cast("double")
    return _each(df, [F.struct(F.lit(c).alias("column"), F.bool_and(F.col(c).cast("string").eqNullSafe(F.col(target).cast("string"))).alias("equal"), corr(c).alias("correlation")) for c in columns])


def bucket_support(df: DataFrame, bucket: Column, label: str, score: str) -> DataFrame:
    """``bucket, n, positives, average_precision, prevalence``."""
    from tidemark.operators.metrics import average_precision

    out = average_precision(df.withColumn("bucket", bucket), label, score, by=("bucket",))
    return out.withColumn("prevalence", F.col("positives") / F.col("n"))


def coverage(df: DataFrame, conditions: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows that meet each condition."""
    return df.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in conditions.items()])


def deviation_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``n, median, p90, low, high, nonzero`` of each group."""
    tiles = quantiles(df, value, (0.5, 0.9), by).drop("n")
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg((F.col(value) != 0).cast("int")).alias("nonzero"))
    out = out.alias("a").join(tiles.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by], "left").select("a.*", F.col("b.q").alias("_q"))
    return out.select(*by, "n", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p90"), "low", "high", "nonzero")


# Parts of names that tell a column's role.
ROLES = {"entity": r"(^|_)(customer|user|account|client|card|device|merchant|session|household|store|seller)($|_)", "id": r"(^|_)(id|key|uuid|guid)($|_)", "time": r"(^|_)(time|date|timestamp|ts|day)($|_)", "geo": r"(^|_)(lat|lon|latitude|longitude|location|city|country)($|_)"}


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    return {role: [c for c in df.columns if re.search(p, c.lower())] for role, p in ROLES.items()}


def roles_table(df: DataFrame) -> DataFrame:
    """``role, column`` by the columns' names."""
    return df.sparkSession.createDataFrame([(role, c) for role, cols in column_roles(df).items() for c in cols], "role string, column string")


def mean_and_std(scores: Sequence[float]) -> tuple[float, float]:
    m = math.fsum(scores) / len(scores)
    return m, math.sqrt(math.fsum((x - m) ** 2 for x in scores) / len(scores))


def report(train: DataFrame, test: DataFrame | None = None, numbers: Sequence[str] = (), categories: Sequence[str] = (), target: str | None = None, time: str | None = None) -> str:
    """A markdown audit of a table, and of its drift to another."""

    def grid(df: DataFrame) -> list[str]:
        cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "/").replace("\n", " ")[:180]
        rows = df.limit(200).collect()
        return [f"| {' | '.join(df.columns)} |", "|" + "-|" * len(df.columns), *[f"| {' | '.join(map(cell, r))} |" for r in rows], ""]

    out = ["# Data audit", "", f"Columns by name: {column_roles(train)}", "", "## Missing values", "", *grid(missingness(train))]
    out += ["## Duplicate rows", "", *grid(duplicates(train))]
    if numbers:
        out += ["## Numbers", "", *grid(numeric_profile(train, numbers))]
    if categories:
        out += ["## Categories", "", *grid(categorical_profile(train, categories))]
    if target:
        out += ["## Target", "", *grid(value_counts(train, target)), *grid(target_leaks(train, target, [c for c in (*numbers, *categories) if c != target]))]
    if test is not None:
        shared = [c for c in (*numbers, *categories) if c in test.columns]
        for c in (c for c in categories if c in shared):
            out += [f"## Drift of {c}", "", *grid(tv_drift(train, test, c))]
        if own := [c for c in numbers if c in shared]:
            out += ["## Drift of numbers", "", *grid(numeric_drift(train, test, own))]
        if shared:
            out += ["## Overlap", "", *grid(entity_overlap(train, test, shared)), f"Equal rows: {vector_overlap(train, test, shared).count()}", ""]
        if time:
            out += ["## Time", "", *grid(time_overlap(train, test, time))]
    return "\n".join(out)
