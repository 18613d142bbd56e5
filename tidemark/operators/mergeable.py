"""A user's own metrics and aggregates as states that merge, for groups of any size.

An aggregate says how to begin (``zero``), how to take in a batch of columns
(``update``), how to join two states (``merge``) and what to make of the last
(``finish``). Map tasks make a state of each group, and states meet in two rounds: about
the square root of their number in each task of the first, and what is left in the
second. No task sees a group's rows, only states, which travel pickled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

HELD = 100_000  # groups whose states a map task holds before they leave it


class Aggregate:
    """To be subclassed; states may be anything that pickles, and must not grow with the rows."""

    def zero(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, *columns: np.ndarray) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> float | None:
        raise NotImplementedError


class BinnedPrecision(Aggregate):
    """Average precision over ``bins`` equal steps of the score: exact where scores within a step are equal. Columns: label, score."""

    def __init__(self, bins: int = 10_000, low: float = 0.0, high: float = 1.0):
        self.bins, self.low, self.high = bins, low, high

    def zero(self):
        return np.zeros((2, self.bins + 1), np.int64)

    def update(self, state, label, score):
        at = np.clip(np.rint((score.astype(float) - self.low) / (self.high - self.low) * self.bins), 0, self.bins).astype(np.int64)
        state[0] += np.bincount(at, minlength=self.bins + 1)
        state[1] += np.bincount(at[label.astype(bool)], minlength=self.bins + 1)
        return state

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        n, hit = np.cumsum(state[0][::-1]), np.cumsum(state[1][::-1])
        if not hit[-1]:
            return None
        return float((state[1][::-1][n > 0] * (hit[n > 0] / n[n > 0])).sum() / hit[-1])


def aggregate(df: DataFrame, how: Aggregate, columns: Sequence[str], by: Sequence[str] = (), name: str = "score") -> DataFrame:
    """``by`` and ``name``: the aggregate of each group's columns; without ``by`` of the whole table (no row for an empty one)."""
    keys = list(by)
    own = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    fields = [StructType().add(f"k{i}", own.schema[f"k{i}"].dataType)[0] for i in range(len(keys))]
    schema = StructType([*fields]).add("state", "binary").add("part", IntegerType())
    names = [f"k{i}" for i in range(len(keys))]
    spark = df.sparkSession
    fan = max(1, math.isqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))

    def batch_of(states: dict, part: int, batch_schema) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in states], batch_schema.field(i).type) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([pickle.dumps(s) for s in states.values()], pa.binary()), pa.array([part] * len(states), pa.int32())], [*names, "state", "part"])

    def run(batches):
        from pyspark import TaskContext

        part, states, shape = TaskContext.get().partitionId() % fan, {}, None
        for batch in batches:
            shape = batch.schema
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            for key, rows in _groups(table, names):
                values = [rows.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))]
                states[key] = how.update(states[key] if key in states else how.zero(), *values)
            if len(states) >= HELD:
                yield batch_of(states, part, shape)
                states = {}
        if states:
            yield batch_of(states, part, shape)

    def met(table: pa.Table) -> Any:
        state = None
        for b in table.column("state").to_pylist():
            state = pickle.loads(b) if state is None else how.merge(state, pickle.loads(b))
        return state

    def first(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(len(keys), "state", pa.array([pickle.dumps(met(table))], pa.binary()))

    def last(table: pa.Table) -> pa.Table:
        value = how.finish(met(table))
        return table.slice(0, 1).select(names).append_column("value", pa.array([value], pa.float64()))

    made = own.mapInArrow(run, schema)
    some = made.groupBy(*names, "part").applyInArrow(first, schema)
    out = some.groupBy(*names).applyInArrow(last, StructType([*fields]).add("value", DoubleType()))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("value").alias(name))


def _groups(table: pa.Table, names: list[str]):
    """The rows of each key of a batch."""
    if not names:
        yield (), table
        return
    keys = list(zip(*(table.column(n).to_pylist() for n in names), strict=True))
    place: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        place.setdefault(k, []).append(i)
    for k, rows in place.items():
        yield k, table.take(pa.array(rows))
