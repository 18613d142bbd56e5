"""What all tree learners share: numbers as bins, exact sums over all rows, and models as SQL.

Learning a tree is a series of passes over a stored table of bins. In a pass a map
task adds up a small array of integers (numpy, over Arrow batches), one for each core,
and Spark sums these arrays element by element. What reaches the driver is one array,
whose size depends on the model's parameters and not on the rows.

Gradients are summed as integers: each is rounded once to a multiple of 2 to the
``-bits``, with as many bits as the number of rows leaves of 62. Sums of integers are
the same in any order, so a model doesn't depend on how the rows are dealt out, on
retries, or on the number of tasks.

A model is scored by built-in expressions alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from tidemark.session import stored

WIDE = 1 << 11  # values of a row of a pass; longer arrays take several rows
ACCURACY = 20_000  # of quantiles: ranks are off by no more than a part in so many


def exact_bits(rows: int, largest: float = 1.0) -> int:
    """Bits after the point with which ``rows`` numbers of up to ``largest`` add up within 62 bits."""
    return 62 - math.ceil(math.log2(max(rows, 2))) - math.ceil(math.log2(max(largest, 1.0)))


def fixed(values: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(np.ldexp(values, bits)).astype(np.int64)


def totals(rows: DataFrame, columns: Sequence[str], fn: Callable[[dict], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of the int64 arrays of this shape that ``fn`` makes of a batch's columns."""
    size = math.prod(shape)
    width = min(size, WIDE)
    parts = -(-size // width)

    def run(batches):
        total = np.zeros(parts * width, np.int64)
        seen = False
        for batch in batches:
            if batch.num_rows:
                total[:size] += fn(dict(zip(columns, map(_array, batch.columns), strict=True))).reshape(-1)
                seen = True
        if seen:
            bounds = pa.array(np.arange(parts + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.ListArray.from_arrays(bounds, pa.array(total))], ["part", "v"])

    # an array for each core, not for each file: tasks read several parts of the table one after the other
    made = rows.select(*columns).coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "part int, v array<long>")
    each = made.select("part", F.posexplode("v").alias("place", "x")).filter("x <> 0").groupBy("part", "place").agg(F.sum("x").alias("x"))
    out = np.zeros(parts * width, np.int64)
    got = each.toArrow()  # as many rows as the array has places
    out[got.column("part").to_numpy().astype(np.int64) * width + got.column("place").to_numpy()] = got.column("x").to_numpy()
    return out[:size].reshape(shape)


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are; lists of one length as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def borders_of(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` borders of each column: quantiles of its numbers, from one pass; equal ones are one."""
    at = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`").cast("double")), at, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    # a border at the largest number would part nothing
    high = df.agg(*[F.max(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`").cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [np.array(sorted({q for q in (found[i] or []) if q < high[i]}), float) for i in range(len(columns))]


def binned(df: DataFrame, columns: Sequence[str], borders: Sequence[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``x``: of each column the number of borders below its value, plus 1; 0 for null and NaN."""

    def run(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, len(columns)), np.int16)
            for i, b in enumerate(borders):
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                cells[:, i] = np.where(np.isnan(v), 0, np.searchsorted(b, v, "left") + 1)
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(columns))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(columns) :], pa.ListArray.from_arrays(bounds, pa.array(cells.reshape(-1)))], [*keep, "x"])

    own = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)], *keep)
    return own.mapInArrow(run, own.select(*keep).schema.add("x", ArrayType(ShortType())))


def histogram(leaf: np.ndarray, cells: np.ndarray, leaves: int, bins: int, stats: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of each statistic by leaf, feature and bin; rows of a negative leaf count for nothing."""
    out = np.zeros((leaves, cells.shape[1], bins, len(stats)), np.int64)
    inside = leaf >= 0
    leaf, cells, stats = leaf[inside].astype(np.int64), cells[inside].astype(np.int64), [s[inside] for s in stats]
    for f in range(cells.shape[1]):
        at = leaf * bins + cells[:, f]
        for k, s in enumerate(stats):
            # halves of 31 bits, so that the doubles of bincount are exact
            high, low = s >> 31, s & ((1 << 31) - 1)
            add = lambda v: np.rint(np.bincount(at, v, leaves * bins)).astype(np.int64)  # noqa: B023, E731
            out[:, f, :, k] = ((add(high) << 31) + add(low)).reshape(leaves, bins)
    return out


def rescored(table: DataFrame, columns: Sequence[str], fn: Callable[[dict], np.ndarray]) -> DataFrame:
    """The table written anew with the column ``raw`` (a number, or a list of one length) as ``fn`` makes it of a batch."""

    def run(batches):
        for batch in batches:
            raw = fn(dict(zip(columns, map(_array, batch.columns), strict=True)))
            made = pa.array(raw.reshape(-1))
            if raw.ndim == 2:
                made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * raw.shape[1]), made)
            yield batch.set_column(list(columns).index("raw"), "raw", made)

    own = table.select(*columns)
    return stored(own.mapInArrow(run, own.schema))


class TreeModel(Model):
    """A sum of trees over columns, with a link: ``logistic`` gives a probability, ``identity`` a number."""

    def __init__(self, raw: str, link: str):
        super().__init__()
        self.raw, self.link = raw, link

    def features(self, df: DataFrame) -> DataFrame:
        """The columns that ``raw`` reads, added to the table."""
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.features(df).withColumn("rawPrediction", F.expr(self.raw))
        if self.link == "logistic":
            p = 1 / (1 + F.exp(-F.col("rawPrediction")))
            out = out.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (p > 0.5).cast("double"))
        else:
            out = out.withColumn("prediction", F.col("rawPrediction"))
        return out.select(*df.columns, *[c for c in ("rawPrediction", "probability", "prediction") if c in out.columns])


def number(value: float) -> str:
    """A double as an SQL literal that reads back as the same double."""
    return f"{float(value)!r}D" if math.isfinite(value) else f"double('{value}')"


def above(name: str, border: float | None) -> str:
    """SQL: whether a number is over the border; null and NaN are below all numbers, which are over the border None."""
    real = f"not isnan(coalesce({name}, double('NaN')))"
    return f"({real})" if border is None else f"({real} and {name} > {number(border)})"


def balanced(terms: list[str]) -> str:
    """A sum as a balanced tree, so that the parser and the optimizer don't recurse once for each term."""
    while len(terms) > 1:
        terms = [f"({a} + {b})" for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def gradients(loss: str, y: np.ndarray, raw: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """The downward slope of the loss and its curvature."""
    if loss == "squared":
        return np.clip(y - raw, -largest, largest), np.ones_like(raw)
    p = 1 / (1 + np.exp(-raw))
    return y - p, p * (1 - p)


def prepared(df: DataFrame, numbers: Sequence[str], key: Sequence[str], label: str, loss: str, seed: int):
    """``n0 .. , y, u`` (a seeded hash of the key) of the labelled rows, stored; their number, the first score and the largest slope."""
    place = F.xxhash64(*[column(c) for c in key], F.lit(seed)) if key else F.lit(0).cast("long")
    own = df.filter(column(label).isNotNull()).select(*[column(c).cast("double").alias(f"n{i}") for i, c in enumerate(numbers)], column(label).cast("double").alias("y"), place.alias("u"))
    own = stored(own)
    found = own.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.abs("y")).alias("high"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("odd")).first()
    mean = found["mean"] or 0.0
    if loss == "squared":
        return own, found["n"], mean, max(1.0, 4 * ((found["high"] or 0.0) + abs(mean)))
    if found["odd"]:
        raise ValueError("labels must be 0 and 1")
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return own, found["n"], math.log(mean / (1 - mean)), 1.0


def column(name: str) -> Column:
    return F.col(f"`{name}`")
