"""Order-based results over tables that no task can hold: ranges with fixed bounds.

A table is cut into ranges of its order by bounds that are taken once, from a
bounded sample, and then stand in the plan as literals. Whatever reads the table,
and however often, a row is always in the same range; only one row a range meets
in a single task. The sample decides how even the ranges are, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES = 512  # bounds in an expression
SAMPLED = 40  # rows of the sample for each range


def _literal(value: str | None, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    return f"cast('{value.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}' as {kind})"


def range_of(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> Column:
    """The number of the range that a row of ``df`` is in: rows of a lower range come first in ``order``."""
    ranges = min(ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    kinds = [df.schema[c].dataType.simpleString() for c in order]
    names = [f"_{i}" for i in range(len(order))]
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(order, names, strict=True)])
    some = own.withColumn("_x", F.rand(17)).orderBy("_x").limit(SAMPLED * ranges).drop("_x")  # bounded
    # as text, so that the driver's time zone and number formats play no part
    rows = some.orderBy(*names).select(*[F.col(n).cast("string") for n in names]).collect()
    picked = [tuple(rows[k * len(rows) // ranges]) for k in range(1, ranges)] if rows else []
    bounds = list(dict.fromkeys(picked))
    key = "struct(" + ", ".join(f"`{c}` as {n}" for c, n in zip(order, names, strict=True)) + ")"
    lit = ["struct(" + ", ".join(f"{_literal(v, k)} as {n}" for v, k, n in zip(b, kinds, names, strict=True)) + ")" for b in bounds]

    def tree(lo: int, hi: int) -> str:  # bounds lo to before hi are still open
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"case when {key} < {lit[mid]} then {tree(lo, mid)} else {tree(mid + 1, hi)} end"

    return F.expr(tree(0, len(bounds))).cast("int")


def number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``name``: the place of each row in ``order`` (ascending, nulls first), from 0."""
    rows = df.withColumn("__p", range_of(df, order))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carry = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__c"))
    own = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*[F.col(f"`{c}`") for c in order])) - 1)
    return own.join(carry, F.col("__p") == F.col("__q")).withColumn(name, F.col("__r") + F.col("__c")).drop("__p", "__q", "__r", "__c")


def at_ranks(df: DataFrame, order: Sequence[str], ranks: Sequence[int]) -> dict[int, tuple]:
    """The values of the ``order`` columns, as text, of the rows at the given places.

    The ranges are counted; those with a wanted place, one for each place at most,
    are ordered. Nothing else moves.
    """
    own = df.select(*[F.col(f"`{c}`") for c in order]).withColumn("__p", range_of(df, order))
    sizes = sorted((r["__p"], r["n"]) for r in own.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    wanted, begin = [], 0
    for p, n in sizes:
        wanted += [(p, k - begin, k) for k in sorted(set(ranks)) if begin <= k < begin + n]
        begin += n
    if not wanted:
        return {}
    places = df.sparkSession.createDataFrame(wanted, "__q int, __s long, __k long")
    inside = own.filter(F.col("__p").isin(sorted({p for p, _, _ in wanted})))
    placed = inside.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*[F.col(f"`{c}`") for c in order])) - 1)
    found = placed.join(F.broadcast(places), (F.col("__p") == F.col("__q")) & (F.col("__r") == F.col("__s")))  # one row a place
    return {r["__k"]: tuple(r)[1:] for r in found.select("__k", *[F.col(f"`{c}`").cast("string") for c in order]).collect()}


def reached(df: DataFrame, order: Sequence[str], values: tuple) -> Column:
    """Whether a row comes at or after ``values`` (as :func:`at_ranks` gives them) in ``order``."""
    return at_or_after(order, [df.schema[c].dataType.simpleString() for c in order], values)


def at_or_after(order: Sequence[str], kinds: Sequence[str], values: Sequence) -> Column:
    """:func:`reached` with the SQL types of the columns. A single column is compared as it is, so that a scan can use it; where it is null, so is the result."""
    if len(order) == 1 and values[0] is not None:
        return F.expr(f"`{order[0]}` >= {_literal(values[0], kinds[0])}")
    left = ", ".join(f"`{c}` as _{i}" for i, c in enumerate(order))
    right = ", ".join(f"{_literal(v, k)} as _{i}" for i, (v, k) in enumerate(zip(values, kinds, strict=True)))
    return F.expr(f"struct({left}) >= struct({right})")


def running(steps: DataFrame, by: Sequence[str], order: str, values: Sequence[str], descending: bool = False) -> DataFrame:
    """``c_<value>``: sums over all rows of the group up to and with this one in ``order``.

    Distinct orders may be as many as rows, so no task orders a whole group: each
    range has its own sums, and the sums of whole ranges are carried on.
    """
    keys = list(by)
    ranged = steps.withColumn("__p", range_of(steps, [order]))
    turn = F.desc if descending else F.asc
    whole = ranged.groupBy(*keys, "__p").agg(*[F.sum(v).alias(f"__w_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(turn("__p")).rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*keys, "__p", *[F.coalesce(F.sum(f"__w_{v}").over(before), F.lit(0)).alias(f"__b_{v}") for v in values])
    own = Window.partitionBy(*keys, "__p").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "__p")]
    joined = ranged.withColumns({f"__o_{v}": F.sum(v).over(own) for v in values}).alias("a").join(carry.alias("b"), cond)
    return joined.select("a.*", *[(F.col(f"a.__o_{v}") + F.col(f"b.__b_{v}")).alias(f"c_{v}") for v in values]).drop("__p", *[f"__o_{v}" for v in values])


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n`` and ``q``: an array of exact quantiles, linear between values, of each group.

    Counts of distinct values are summed in order; a quantile is picked where the
    sums pass its rank. No task holds all values of a group.
    """
    keys = list(by)
    steps = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    c = running(steps, keys, "__v", ["__n"])
    total = steps.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if keys:
        same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
        both = c.alias("a").join(total.alias("b"), same).select("a.*", "b.__total")
    else:
        both = c.crossJoin(F.broadcast(total))  # one row
    picks = []
    for i, p in enumerate(at):
        rank = F.lit(float(p)) * (F.col("__total") - 1)
        for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("c___n") - F.col("__n") <= r) & (r < F.col("c___n"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{side}{i}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"__f{i}"))
    out = both.groupBy(*keys).agg(F.max("__total").alias("n"), *picks)
    q = F.array(*[F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}") for i in range(len(at))])
    return out.select(*keys, "n", q.alias("q"))
