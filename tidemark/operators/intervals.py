"""Folds in time as pairs of half-open ranges.

A fold trains on the rows before ``train_before`` and validates those from
``valid_from`` to before ``valid_until``, in the order of one or more columns. What
lies between ``train_before`` and ``valid_from`` is its gap: in neither part. A row so
belongs to the training parts of many folds, and a row of one fold's gap may be
validated by the fold before and be trained on by the one after; a single fold column
can't say that.

The ranges are a small table of literals. Whether a row is in a part is a predicate on
the row alone: no shuffle, no join, and filters on time reach the scan. Bounds are kept
as text with the types of the order's columns, so they can be saved as JSON and read
again on another day or in another time zone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranges import at_or_after, at_ranks

FOLD = "__fold__"


@dataclass(frozen=True)
class Range:
    """Values of the order's columns, as text; ``valid_until`` None: to the end."""

    train_before: tuple
    valid_from: tuple
    valid_until: tuple | None = None


@dataclass(frozen=True)
class Intervals:
    order: tuple[str, ...]
    kinds: tuple[str, ...]  # SQL types of these columns
    ranges: tuple[Range, ...]

    @property
    def numbers(self) -> range:
        return range(len(self.ranges))

    def _reached(self, values: tuple) -> Column:
        return at_or_after(self.order, self.kinds, values)

    def in_training(self, k: int) -> Column:
        """Nulls come first in an order: such rows are trained on."""
        before = ~self._reached(self.ranges[k].train_before)
        return before | F.col(f"`{self.order[0]}`").isNull() if len(self.order) == 1 else before

    def in_validation(self, k: int) -> Column:
        r = self.ranges[k]
        return self._reached(r.valid_from) if r.valid_until is None else self._reached(r.valid_from) & ~self._reached(r.valid_until)

    def in_gap(self, k: int) -> Column:
        return ~self.in_training(k) & ~self._reached(self.ranges[k].valid_from)

    def train(self, df: DataFrame, k: int) -> DataFrame:
        return df.filter(self.in_training(k))

    def valid(self, df: DataFrame, k: int) -> DataFrame:
        return df.filter(self.in_validation(k))

    def unvalidated(self, df: DataFrame) -> DataFrame:
        """Rows that no fold validates."""
        inside = F.lit(False)
        for k in self.numbers:
            inside = inside | self.in_validation(k)
        return df.filter(~F.coalesce(inside, F.lit(False)))

    def assigned(self, df: DataFrame, name: str = FOLD) -> DataFrame:
        """``name``: the fold that validates a row, -1 without one."""
        c = F.lit(-1)
        for k in self.numbers:
            c = F.when(self.in_validation(k), k).otherwise(c)
        return df.withColumn(name, c.cast("int"))

    def membership(self, df: DataFrame, fold: str = "fold", part: str = "part") -> DataFrame:
        """A row for each part (``train``, ``gap`` or ``valid``) that a row has in a fold; later rows have none."""
        parts = []
        for k in self.numbers:
            inner = F.when(self.in_training(k), "train").when(self.in_validation(k), "valid").when(self.in_gap(k), "gap")
            parts.append(F.when(inner.isNotNull(), F.struct(F.lit(k).alias(fold), inner.alias(part))))
        return df.select("*", F.explode(F.array_compact(F.array(*parts))).alias("__part")).select(*[F.col(f"`{c}`") for c in df.columns], "__part.*")

    def table(self, spark: SparkSession) -> DataFrame:
        """``fold, train_before, valid_from, valid_until``, as texts joined by a bar."""
        text = lambda v: None if v is None else "|".join("" if x is None else str(x) for x in v)
        rows = [(k, text(r.train_before), text(r.valid_from), text(r.valid_until)) for k, r in enumerate(self.ranges)]
        return spark.createDataFrame(rows, "fold int, train_before string, valid_from string, valid_until string")

    def summary(self, df: DataFrame, time: str | None = None, label: str | None = None) -> DataFrame:
        """``fold``, rows and first and last ``time`` of both parts, rows in the gap, and the labels in training; one pass."""
        t = F.col(f"`{time or self.order[0]}`")
        made = []
        for k in self.numbers:
            train, gap, valid = self.in_training(k), self.in_gap(k), self.in_validation(k)
            cols = [F.lit(k).alias("fold"), *[F.count_if(c).alias(n) for n, c in (("n_train", train), ("n_gap", gap), ("n_valid", valid))]]
            for n, part in (("train", train), ("valid", valid)):
                cols += [F.min(F.when(part, t)).alias(f"{n}_first"), F.max(F.when(part, t)).alias(f"{n}_last")]
            if label:
                cols.append(F.array_sort(F.collect_set(F.when(train, F.col(f"`{label}`")))).alias("labels"))
            made.append(F.struct(*cols))
        return df.agg(F.array(*made).alias("f")).select(F.explode("f").alias("f")).select("f.*")

    def check(self, df: DataFrame, time: str | None = None, label: str | None = None, classes: Iterable | None = None) -> list[dict]:
        """The summary's rows; raises where a part is empty, times tie at a boundary, or training lacks a class."""
        rows = [r.asDict() for r in self.summary(df, time, label if classes is not None else None).collect()]
        for r in rows:
            if not r["n_train"] or not r["n_valid"]:
                raise ValueError(f"fold {r['fold']} leaves empty training or validation data")
            if r["train_last"] >= r["valid_first"]:
                raise ValueError(f"training of fold {r['fold']} reaches into validation: times tie or overlap at the boundary")
            if classes is not None and set(classes) - set(r["labels"]):
                raise ValueError(f"training of fold {r['fold']} lacks the classes {sorted(set(classes) - set(r['labels']), key=str)}")
        return rows

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Intervals:
        raw = json.loads(text)
        tuples = lambda r: Range(**{k: None if v is None else tuple(v) for k, v in r.items()})
        return cls(tuple(raw["order"]), tuple(raw["kinds"]), tuple(tuples(r) for r in raw["ranges"]))


@dataclass(frozen=True)
class Assigned:
    """Folds of a column: each is validated by a model of all others; rows of negative folds are in no part."""

    folds: tuple[int, ...]
    column: str = FOLD

    @property
    def numbers(self) -> tuple[int, ...]:
        return self.folds

    def train(self, df: DataFrame, k: int) -> DataFrame:
        return df.filter((F.col(self.column) != k) & (F.col(self.column) >= 0))

    def valid(self, df: DataFrame, k: int) -> DataFrame:
        return df.filter(F.col(self.column) == k)

    def unvalidated(self, df: DataFrame) -> DataFrame:
        return df.filter(~F.coalesce(F.col(self.column).isin(*self.folds), F.lit(False)))


def _kinds(df: DataFrame, order: Sequence[str]) -> tuple[str, ...]:
    return tuple(df.schema[c].dataType.simpleString() for c in order)


def by_rows(df: DataFrame, k: int, order: Sequence[str], gap: int = 0) -> Intervals:
    """``k`` folds of ``n // (k + 1)`` rows each at the end of the order; a fold trains on all rows before it but the last ``gap``.

    ``order`` must tell rows apart (rows equal in it go to one side of a bound). Only the rows at the bounds are looked up.
    """
    n = df.count()
    size = n // (k + 1)
    starts = [n - (k - f) * size for f in range(k)]
    if k < 1 or not size:
        raise ValueError(f"{n} rows are too few for {k} folds")
    if gap < 0 or starts[0] - gap < 1:
        raise ValueError(f"{n} rows are too few for {k} folds with a gap of {gap}")
    at = at_ranks(df, order, sorted({*starts, *(s - gap for s in starts)}))
    ranges = [Range(at[s - gap], at[s], at[starts[f + 1]] if f + 1 < k else None) for f, s in enumerate(starts)]
    return Intervals(tuple(order), _kinds(df, order), tuple(ranges))


def holdout(df: DataFrame, fraction: float, order: Sequence[str], gap: int = 0) -> Intervals:
    """One fold: the last ``ceil(n * fraction)`` rows, at least one; the ``gap`` rows before them are in no part."""
    n = df.count()
    start = n - max(1, math.ceil(n * fraction))
    if gap < 0 or start - gap < 1:
        raise ValueError("no training rows are left after the gap")
    at = at_ranks(df, order, sorted({start, start - gap}))
    return Intervals(tuple(order), _kinds(df, order), (Range(at[start - gap], at[start]),))


def calendar(bounds: Sequence[Sequence[str]], time: str = "timestamp", kind: str = "timestamp_ntz") -> Intervals:
    """Folds ``(train_before, valid_from, valid_until)``, or ``(valid_from, valid_until)`` without a gap."""
    import pandas as pd

    ranges = []
    for b in bounds:
        before, start, end = b if len(b) == 3 else (b[0], *b)
        if not pd.Timestamp(before) <= pd.Timestamp(start) < pd.Timestamp(end):
            raise ValueError(f"bounds must satisfy train_before <= valid_from < valid_until: {tuple(b)}")
        ranges.append(Range((before,), (start,), (end,)))
    return Intervals((time,), (kind,), tuple(ranges))
