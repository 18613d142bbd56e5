"""Frames of a key's rows that can be read whole or chunk by chunk.

A family reads frames (``past``, ``trailing``) by a few measures: counts, means,
sums, first and last times, the greatest value. Usually a frame is a window over
the key. For a key with so many rows that no task should hold it, the same
measures are read per key and chunk of time: what lies in earlier chunks comes as
one carried row for each chunk (all measures of the past are sums or extremes),
and the rows that a trailing frame still reaches are copied into the next chunk.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import SECOND
from tidemark.functions.windows import past as past_window
from tidemark.functions.windows import trailing as trailing_window

CHUNK, OWN = "_chunk", "_own"
MEAN = "_mean"  # and a column: its mean over a heavy key's rows, which any number near could stand for
LENGTH = "_length"  # of a heavy key's chunks


@dataclass(frozen=True)
class Carried:
    """A measure of the past: what it sums or takes the extreme of, by key."""

    kind: str  # n, sum, min, max
    name: str  # of the column in carried rows
    value: Column | None = None


class _Modes(threading.local):
    """How frames are read just now, by this thread: whole, only noted, or by chunk; and whether measures are shared."""

    wanted: dict[tuple[str, ...], dict[str, Carried]] | None = None
    chunked = False
    shared: dict[tuple[str, ...], dict[str, Column]] | None = None


_Mode = _Modes()


@contextmanager
def noting() -> Iterator[dict[tuple[str, ...], dict[str, Carried]]]:
    """Notes what frames of the past are asked for, by their keys."""
    _Mode.wanted = {}
    try:
        yield _Mode.wanted
    finally:
        _Mode.wanted = None


@contextmanager
def by_chunk() -> Iterator[None]:
    _Mode.chunked = True
    try:
        yield
    finally:
        _Mode.chunked = False


@contextmanager
def sharing() -> Iterator[dict[tuple[str, ...], dict[str, Column]]]:
    """Notes each window once, by its keys, as a column to make; families then read it by name.

    Spark makes a window anew for each place that a family or the next one reads it at.
    """
    _Mode.shared = {}
    try:
        yield _Mode.shared
    finally:
        _Mode.shared = None


class Frame:
    """Rows of the key before this one: all, or those of a width."""

    def __init__(self, keys: Sequence[str], width: int | None = None, open_left: bool = False, until: int = 0):
        self.keys, self.width, self.open_left, self.until = tuple(keys), width, open_left, until

    def _window(self):
        keys = (*self.keys, CHUNK) if _Mode.chunked else self.keys
        return past_window(*keys) if self.width is None else trailing_window(self.width, *keys, open_left=self.open_left, until=self.until)

    def _once(self, name: str, window: Column) -> Column:
        """The window, or the column that stands for it where measures are shared."""
        if _Mode.shared is None:
            return window
        name = f"_once_{name}_of_{'_'.join(k.strip('_') for k in self.keys)}"
        _Mode.shared.setdefault(self.keys, {})[name] = window
        return F.col(name)

    def _bounds(self) -> str:
        return "past" if self.width is None else f"{self.width}_{int(self.open_left)}_{self.until}"

    def _measure(self, kind: str, label: str, value: Column) -> Column:
        """The sum (0 over no rows), least or greatest ``value`` of the frame."""
        take = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
        name = f"_{kind}_{label}_{'_'.join(k.strip('_') for k in self.keys)}"
        if _Mode.wanted is not None and self.width is None:
            _Mode.wanted.setdefault(self.keys, {})[name] = Carried(kind, name, value)
        if self.width is not None and kind == "sum":
            # whole numbers: what came before the frame's end less what came before its begin. Spark adds a moving frame
            # up anew for each row, which for a key with many rows is their product; sums from the first row on are kept
            ends = (-self.until - 1, -self.width + int(self.open_left) - 1)
            # a frame that ends just before the row has the past's sum, unless the past leaves out rows of earlier chunks
            names = ("sum_past" if e == -1 and not _Mode.chunked else f"sum_to{-e}" for e in ends)
            upto, before = (F.coalesce(self._once(f"{n}_{label}", F.sum(value).over(self._window().rangeBetween(Window.unboundedPreceding, e))), F.lit(0)) for n, e in zip(names, ends, strict=True))
            return upto - before
        if not _Mode.chunked or self.width is not None:
            out = self._once(f"{kind}_{self._bounds()}_{label}", take(value).over(self._window()))
        else:
            here = self._once(f"{kind}_own_{label}", take(F.when(F.col(OWN), value)).over(self._window()))
            join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[kind]
            out = join(here, F.col(name))
        return F.coalesce(out, F.lit(0)) if kind == "sum" else out

    def count(self) -> Column:
        return self._measure("sum", "n", F.lit(1).cast("long"))

    def total(self, column: str) -> Column:
        return self._measure("sum", column.strip("_"), F.col(column).cast("long"))

    def mean(self, column: str) -> Column:
        if not _Mode.chunked and _Mode.wanted is None or self.width is not None:
            return self._once(f"avg_{self._bounds()}_{column.strip('_')}", F.avg(column).over(self._window()))
        n = self._measure("sum", f"has{column}", F.col(column).isNotNull().cast("long"))
        return self._measure("sum", f"of{column}", F.col(column)) / F.when(n > 0, n)

    def std(self, column: str) -> Column:
        """Population standard deviation; by chunk, sums are of what is over the key's mean, so that squares don't cancel."""
        if not _Mode.chunked and _Mode.wanted is None or self.width is not None:
            return self._once(f"std_{self._bounds()}_{column.strip('_')}", F.stddev_pop(column).over(self._window()))
        n = self._measure("sum", f"has{column}", F.col(column).isNotNull().cast("long"))
        over = F.col(column) - F.col(f"{MEAN}{column}")
        squares = self._measure("sum", f"squares{column}", over * over) / F.when(n > 0, n)
        mean = self._measure("sum", f"over{column}", over) / F.when(n > 0, n)
        return F.when(n > 0, F.sqrt(F.greatest(squares - F.pow(mean, 2), F.lit(0.0))))

    def age(self) -> Column:
        """Seconds since the first row of the frame."""
        return (F.col("us") - self._measure("min", "us", F.col("us"))) / float(SECOND)

    def since(self, flag: str | None = None) -> Column:
        """Seconds since the last row of the frame (with ``flag``: the last whose flag is 1)."""
        at = F.col("us") if flag is None else F.when(F.col(flag) == 1, F.col("us"))
        return (F.col("us") - self._measure("max", f"us{flag or ''}", at)) / float(SECOND)

    def greatest(self, label: str, value: Column) -> Column:
        return self._measure("max", label, value)


def past(*keys: str) -> Frame:
    """All rows of the key strictly before."""
    return Frame(keys)


def trailing(width: int, *keys: str, open_left: bool = False, until: int = 0) -> Frame:
    """Rows of the key in ``[t - width, t - until)``, or ``(t - width, t - until)``."""
    return Frame(keys, width, open_left, until)


def in_chunks(df: DataFrame, length: int, us: str = "us") -> DataFrame:
    """``df`` with its chunk of time; windows over key and chunk spread a key over its chunks. Keys that bring no ``LENGTH`` have that given."""
    if LENGTH not in df.columns:
        df = df.withColumn(LENGTH, F.lit(length).cast("long"))
    at = (F.col(us) - F.pmod(us, LENGTH)) / F.col(LENGTH)  # a whole number
    # rows without a time come before all others
    return df.withColumns({CHUNK: F.coalesce(at.cast("long"), F.lit(-(2**62))), OWN: F.lit(True)})


def with_copies(own: DataFrame, reach: int, us: str = "us") -> DataFrame:
    """And copies (not ``_own``) of the rows that the next chunk's trailing frames reach; each ``LENGTH`` must be ``reach`` at least."""
    if not reach:
        return own
    kept = [c for c in own.columns if c.startswith("_") or c == us]
    near = own.filter(F.col(us) >= (F.col(CHUNK) + 1) * F.col(LENGTH) - reach).select(*kept)
    return own.unionByName(near.withColumns({CHUNK: F.col(CHUNK) + 1, OWN: F.lit(False)}), allowMissingColumns=True)


def carry(df: DataFrame, wanted: dict[tuple[str, ...], dict[str, Carried]], rows: DataFrame, present: Sequence[str] = ()) -> DataFrame:
    """``df`` with the measures of all earlier chunks, for each of the keys asked for.

    ``rows``: those of ``df`` that are ``OWN``, read once for each of the keys. Keys among ``present`` are never null: joined by plain
    equality, they leave ``df`` dealt as windows over them need it.
    """
    for keys, measures in wanted.items():
        take = {"sum": F.sum, "min": F.min, "max": F.max}
        whole = rows.filter(OWN).groupBy(*keys, CHUNK).agg(*[take[m.kind](m.value).alias(m.name) for m in measures.values()])
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
        carried = whole.select(*[F.col(k).alias(f"{k}__") for k in (*keys, CHUNK)], *[take[m.kind](m.name).over(before).alias(m.name) for m in measures.values()])
        same = [F.col(k) == F.col(f"{k}__") if k in (*present, CHUNK) else F.col(k).eqNullSafe(F.col(f"{k}__")) for k in (*keys, CHUNK)]
        # rows copied from the chunk before may have keys that the chunk itself doesn't have
        df = df.join(carried, same, "left").drop(*[f"{k}__" for k in (*keys, CHUNK)])
    return df
