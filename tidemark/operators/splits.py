"""Fold assignment, checks of splits, and weights by age."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import at_ranks, number, reached
from tidemark.functions.windows import DAY, event_us
from tidemark.operators import intervals
from tidemark.operators.intervals import FOLD


def calendar_folds(df: DataFrame, bounds: Sequence[tuple[str, str]], time: str = "timestamp") -> DataFrame:
    """``__fold__``: the half-open interval that holds the time, -1 outside. A fold trains on all earlier rows."""
    c = F.lit(-1)
    for k, (a, b) in reversed(list(enumerate(bounds))):
        c = F.when((F.col(time) >= F.lit(a).cast("timestamp_ntz")) & (F.col(time) < F.lit(b).cast("timestamp_ntz")), k).otherwise(c)
    return df.withColumn(FOLD, c)


def fold_sizes(df: DataFrame, bounds: Sequence[tuple[str, str]], time: str = "timestamp") -> DataFrame:
    """``fold, n_train, n_valid`` of expanding folds."""
    cols = []
    for k, (a, b) in enumerate(bounds):
        lo, hi = F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")
        cols.append(F.struct(F.lit(k).alias("fold"), F.count_if(F.col(time) < lo).alias("n_train"), F.count_if((F.col(time) >= lo) & (F.col(time) < hi)).alias("n_valid")))
    return df.agg(F.array(*cols).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def _mixed(seed: int, *cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def kfold(df: DataFrame, k: int, key: Sequence[str], seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Folds of equal size (to one row), within each class if stratified, from a seeded hash of the key.

    Rows are numbered within parts of the hash range, and parts by prefix counts,
    so no task orders the whole table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [stratify] if stratify else []
    rows = df.withColumn("_h", _mixed(seed, *key)).withColumn("_p", F.floor((F.col("_h").cast("double") / 2.0**63 + 1) * n / 2).cast("int"))
    size = rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = size.select(*[F.col(c).alias("_y") for c in by], F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", *key)) - 1)
    cond = (F.col("_p") == F.col("_q")) & (F.col(stratify).eqNullSafe(F.col("_y")) if stratify else F.lit(True))
    return own.join(carry, cond).withColumn(FOLD, ((F.col("_r") + F.col("_c")) % k).cast("int")).drop("_h", "_p", "_q", "_c", "_r", "_y")


def group_fold(df: DataFrame, k: int, group: str, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """All rows of a group in one fold; groups dealt by size (and by share of the class) in turn."""
    mark = F.sum(F.col(stratify).cast("double")) if stratify else F.lit(0.0)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), mark.alias("_m"))
    # groups may be as many as rows: they are numbered range by range
    turns = number(sizes.withColumns({"_m": -F.col("_m"), "_n": -F.col("_n"), "_x": _mixed(seed, group)}), ("_m", "_n", "_x", group), "_turn")
    there_and_back = F.pmod("_turn", F.lit(2 * k))
    folds = turns.select(F.col(group).alias("_g"), F.when(there_and_back < k, there_and_back).otherwise(2 * k - 1 - there_and_back).cast("int").alias(FOLD))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def time_folds(df: DataFrame, k: int, order: Sequence[str], gap: int = 0, mark: int | None = None) -> DataFrame:
    """``__fold__``: which of the last ``k`` equal parts of the order holds a row, -1 before them.

    Only what validates a row; what a fold trains on, and its gap, are in :func:`tidemark.operators.intervals.by_rows`.
    With ``mark``, rows that no fold validates and that lie in the first fold's gap have that value.
    """
    folds = intervals.by_rows(df, k, order, gap)
    out = folds.assigned(df)
    if mark is None:
        return out
    return out.withColumn(FOLD, F.when((F.col(FOLD) < 0) & folds.in_gap(0), mark).otherwise(F.col(FOLD)).cast("int"))


def _cut(df: DataFrame, order: Sequence[str], cuts: dict, start, name: str, kind: str) -> DataFrame:
    """``name``: the value of the last cut that a row's place in the order has reached, or ``start``."""
    c = F.lit(start)
    found = at_ranks(df, order, list(cuts)) if cuts else {}
    for place in sorted(found):
        c = F.when(reached(df, order, found[place]), cuts[place]).otherwise(c)
    return df.withColumn(name, c.cast(kind))


def time_holdout(df: DataFrame, fraction: float, order: Sequence[str], gap: int = 0) -> DataFrame:
    """``split``: the last ``ceil(n * fraction)`` rows are ``valid``, ``gap`` rows before them ``gap``, the rest ``train``.

    ``order`` must tell rows apart, as in :func:`time_folds`.
    """
    total = df.count()
    first = total - math.ceil(total * fraction)
    cuts = ({max(first - gap, 0): "gap"} if gap and first else {}) | ({first: "valid"} if first < total else {})
    return _cut(df, order, cuts, "train", "split", "string")


def check_boundary(train: DataFrame, valid: DataFrame, time: str = "timestamp") -> None:
    """Raises if training times reach into validation."""
    a, b = train.agg(F.max(time)).first()[0], valid.agg(F.min(time)).first()[0]
    if a is not None and b is not None and a >= b:
        raise ValueError("training reaches into validation: times tie or overlap at the boundary")


def check_groups(train: DataFrame, valid: DataFrame, group: str) -> None:
    """Raises if a group is in both."""
    if train.select(group).intersect(valid.select(group)).limit(1).count():
        raise ValueError(f"a value of {group} is in training and validation")


def recency_weight(df: DataFrame, half_life_days: float = 60.0, time: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """``weight = 2 ** (-age / half life)``, age from the latest row, scaled to mean 1."""
    us = event_us(F.col(time))
    last = df.groupBy(*by).agg(F.max(us).alias("_last"))
    keyed = df.join(last, list(by)) if by else df.crossJoin(F.broadcast(last))  # one row: the latest time
    raw = F.pow(F.lit(2.0), -(F.col("_last") - us) / (half_life_days * DAY))
    weighed = keyed.withColumn("_w", raw)
    mean = weighed.groupBy(*by).agg(F.avg("_w").alias("_mean"))
    both = weighed.join(mean, list(by)) if by else weighed.crossJoin(F.broadcast(mean))
    return both.withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean", "_last")


KINDS = ("kfold", "stratified", "group", "stratified_group", "time", "time_holdout", "calendar_time")


def make_splits(df: DataFrame, kind: str, key: Sequence[str], k: int = 5, seed: int = 42, label: str | None = None, group: str | None = None, time: str = "timestamp", fraction: float = 0.2, gap: int = 0, bounds: Sequence[Sequence[str]] = (), classes: Sequence | None = None) -> tuple[DataFrame, str]:
    """The table with its fold column, checked, and a signature of settings and assignment (see :func:`plan_splits`)."""
    out, _, record = plan_splits(df, kind, key, k, seed, label, group, time, fraction, gap, bounds, classes)
    return out, record["signature"]


def plan_splits(df: DataFrame, kind: str, key: Sequence[str], k: int = 5, seed: int = 42, label: str | None = None, group: str | None = None, time: str = "timestamp", fraction: float = 0.2, gap: int = 0, bounds: Sequence[Sequence[str]] = (), classes: Sequence | None = None, reuse: dict | None = None):
    """The table with its fold column, the folds' parts (``train``, ``valid``), and a record of both.

    In time, folds are :class:`~tidemark.operators.intervals.Intervals`: both parts have rows, and training ends before
    validation begins, or it is an error. Otherwise every row has one fold, and a group lies in one. ``classes``: what
    each fold's training must contain. ``reuse``: a record made before for the same settings and rows; its ranges are used.
    """
    from tidemark.sources.tables import content_hash, object_hash

    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    settings = [kind, list(key), k, seed, label, group, time, fraction, gap, [list(b) for b in bounds]]
    in_time = kind in ("time", "time_holdout", "calendar_time")
    rows = content_hash(df, [*key, *([time] if in_time else [])])
    if reuse and (reuse["settings"] != settings or reuse["rows"] != rows):
        raise ValueError("saved splits do not match these rows or settings")
    if in_time:
        if df.filter(F.col(time).isNull()).limit(1).count():
            raise ValueError(f"{time} has missing values")
        if reuse:
            folds = intervals.Intervals.from_json(reuse["folds"])
        elif kind == "time":
            folds = intervals.by_rows(df, k, [time, *key], gap)
        elif kind == "time_holdout":
            folds = intervals.holdout(df, fraction, [time, *key], gap)
        else:
            folds = intervals.calendar(bounds, time, df.schema[time].dataType.simpleString())
        parts = folds.check(df, time, label, classes)
        out, written = folds.assigned(df), folds.to_json()
    else:
        if kind in ("group", "stratified_group"):
            found = df.agg(F.count_if(F.col(group).isNull()).alias("missing"), F.count_distinct(group).alias("n")).first()
            if found["missing"] or found["n"] < k:
                raise ValueError(f"groups must not be missing, and there must be {k} or more")
        if kind in ("stratified", "stratified_group") and (df.groupBy(label).count().agg(F.min("count")).first()[0] or 0) < k:
            raise ValueError(f"every class must have {k} rows or more")
        out = kfold(df, k, key, seed, label if kind == "stratified" else None) if kind in ("kfold", "stratified") else group_fold(df, k, group, seed, label if kind == "stratified_group" else None)
        sizes = {r[FOLD]: r["count"] for r in out.groupBy(FOLD).count().collect()}  # one row a fold
        parts = [{"fold": f, "n_train": sum(sizes.values()) - sizes.get(f, 0), "n_valid": sizes.get(f, 0)} for f in range(k)]
        if any(not p["n_train"] or not p["n_valid"] for p in parts):
            raise ValueError("a fold leaves empty training or validation data")
        folds, written = intervals.Assigned(tuple(range(k))), None
    record = {"settings": settings, "rows": rows, "folds": written, "parts": parts, "assignment": content_hash(out, [*key, FOLD])}
    record["signature"] = object_hash([settings, rows, written, record["assignment"]])
    if reuse and reuse["signature"] != record["signature"]:
        raise ValueError("saved splits fail their integrity check")
    return out, folds, record
