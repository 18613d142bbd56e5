"""Window recipes over an event-time axis ``us`` (microseconds, bigint).

A frame that ends one microsecond before the current row sees strictly earlier
rows only: rows with the same time, whatever their order, never see each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def event_us(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without zone count as UTC (the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


# How times are written, the first that fits counts.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss")


def parse_time(text: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """A time from text in any of the formats, or from a number of seconds since the epoch; NULL where none fits."""
    t = F.trim(text.cast("string"))
    seconds = F.timestamp_micros(F.round(t.try_cast("double") * SECOND).cast("long"))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats], seconds)


def past(*keys: str, us: str = "us") -> WindowSpec:
    """All rows of the key strictly before."""
    return Window.partitionBy(*keys).orderBy(us).rangeBetween(Window.unboundedPreceding, -1)


def trailing(width: int, *keys: str, open_left: bool = False, until: int = 0, us: str = "us") -> WindowSpec:
    """Rows of the key in ``[t - width, t - until)``, or ``(t - width, t - until)``."""
    return Window.partitionBy(*keys).orderBy(us).rangeBetween(-width + int(open_left), -until - 1)


def first_of(*keys: str, us: str = "us") -> Column:
    """1 on exactly one row of each key, one with its least time; so a running sum counts keys seen."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(us)) == 1).cast("int")


def count(w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(w)


def since(w: WindowSpec, when: Column | None = None, us: str = "us") -> Column:
    """Seconds since the last row of the frame (with ``when``: the last such row)."""
    at = F.col(us) if when is None else F.when(when, F.col(us))
    return (F.col(us) - F.max(at).over(w)) / F.lit(float(SECOND))


def share(part: Column, whole: Column, empty: float | None) -> Column:
    value = part / F.when(whole > 0, whole)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def average_rank(value: str | Column, *within: str) -> Column:
    """Rank in ascending order, ties sharing the mean of their ranks."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*within).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*within, v)) - 1) / 2


def windowed_distinct(df: DataFrame, key: str, partner: str, width: int, name: str, open_left: bool = False, us: str = "us") -> DataFrame:
    """``distinct`` by a sweep, for frames too large to rebuild: rows gain the column ``name``.

    A partner counts while some row of it is in the frame. Its rows' spells are
    merged to islands; each island is +1 when it begins and -1 after it ends, and
    a running sum over the key's deltas and rows is the count.
    """
    w = Window.partitionBy(key, partner).orderBy(us)
    reach = width - int(open_left)
    d = df.select(key, partner, us).distinct()
    d = d.withColumn("__b", F.coalesce((F.col(us) - F.lag(us).over(w) > reach).cast("int"), F.lit(1)))
    d = d.withColumn("__e", F.coalesce((F.lead(us).over(w) - F.col(us) > reach).cast("int"), F.lit(1)))
    starts = d.filter("__b = 1").select(key, F.col(us).alias("__t"), F.lit(1).alias("__n"))
    ends = d.filter("__e = 1").select(key, (F.col(us) + reach).alias("__t"), F.lit(-1).alias("__n"))
    rows = df.select("*", F.col(us).alias("__t"), F.lit(0).alias("__n"), F.lit(True).alias("__row"))
    both = rows.unionByName(starts.unionByName(ends), allowMissingColumns=True)
    total = F.coalesce(F.sum("__n").over(past(key, us="__t")), F.lit(0)).cast("long")
    return both.withColumn(name, total).filter("__row").drop("__t", "__n", "__row")


def with_distinct(df: DataFrame, key: str, partner: str, wanted: dict[str, tuple[int, bool]], us: str = "us", more: tuple[str, ...] = ()) -> DataFrame:
    """Columns of distinct partners in trailing frames: ``wanted`` has the width and whether the frame is open on the left.

    Frames are those of the key, and of the columns ``more`` if there are any.

    The last row of a partner before t tells whether it counts: from after its own
    time until its next row, or until it leaves the frame. So the count is the rows
    that have begun less those that have ended, and each row brings an event for
    each end: a sort, whatever the frames hold. ``df`` must be dealt by ``key``
    alone to need no other exchange.
    """
    following = F.lead(us).over(Window.partitionBy(key, *more, partner).orderBy(us))
    events = [F.struct(F.col(us).alias("t"), F.lit(0).alias("k"))]
    for k, (width, open_left) in enumerate(wanted.values(), 1):
        out = F.col(us) + (width - int(open_left))
        events.append(F.struct(F.least(out, F.coalesce("__next", out)).alias("t"), F.lit(k).alias("k")))
    own = [c for c in df.columns if c not in (key, *more, us)]
    rows = df.withColumn("__next", following).select(key, *more, F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own"), F.explode(F.array(*events)).alias("__e"))
    # an end needs no columns of its row
    rows = rows.select(key, *more, F.col("__e.t").alias("__t"), F.col("__e.k").alias("__k"), F.when(F.col("__e.k") == 0, F.col("__own")).alias("__own"))
    w = past(key, *more, us="__t")
    begun = F.count_if(F.col("__k") == 0).over(w)
    made = {n: begun - F.count_if(F.col("__k") == k).over(w) for k, n in enumerate(wanted, 1)}
    # a row's own event has its time: the order by it stays known
    return rows.withColumns(made).filter("__k = 0").select(key, *more, F.col("__t").alias(us), *[F.col(f"__own.`{c}`").alias(c) for c in own], *wanted)


def split_past(df: DataFrame, key: str, sums: dict[str, Column], bucket: int = 30 * DAY, us: str = "us") -> DataFrame:
    """Strictly-past count and sums of a key that may hold any share of the rows.

    Rows are dealt by key and time bucket; what lies in earlier buckets comes as
    one prefix row a bucket, so no task has to hold a whole key. Rows gain
    ``prior_count``, ``prior_first``, ``prior_last`` and a column for each of ``sums``.
    """
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).withColumn("_bucket", F.floor(F.col(us) / bucket))
    names = list(sums)
    whole = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min(us).alias("_lo"), F.max(us).alias("_hi"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        F.col(key).alias("_key"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"),
        F.min("_lo").over(before).alias("_clo"), F.max("_hi").over(before).alias("_chi"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in names],
    )
    own = past(key, "_bucket", us=us)
    both = df.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at")))
    n = F.count(F.lit(1)).over(own) + F.col("_cn")
    made = {"prior_count": n, "prior_first": F.least(F.min(us).over(own), F.col("_clo")), "prior_last": F.greatest(F.max(us).over(own), F.col("_chi"))}
    for name in names:
        made[name] = F.when(F.col("_cn") + F.count(F.lit(1)).over(own) > 0, F.coalesce(F.sum(f"_v_{name}").over(own), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    return both.withColumns(made).drop("_bucket", "_key", "_at", "_cn", "_clo", "_chi", *[f"_{p}_{n}" for p in "vc" for n in names])


def split_trailing(df: DataFrame, key: str, width: int, sums: dict[str, Column], open_left: bool = False, bucket: int | None = None, us: str = "us") -> DataFrame:
    """Count and sums over ``[t - width, t)`` of a key that may hold any share of the rows.

    Rows are dealt by key and time bucket of at least ``width``; each also goes to
    the next bucket, so a frame lies within one. Rows gain ``recent_count`` and a
    column for each of ``sums`` (NULL over no rows).
    """
    size = max(width, bucket or width)
    names = list(sums)
    own = df.withColumns({f"_v_{n}": c for n, c in sums.items()} | {"_bucket": F.floor(F.col(us) / size), "_own": F.lit(True)})
    again = own.select(key, us, *[f"_v_{n}" for n in names], (F.col("_bucket") + 1).alias("_bucket"), F.lit(False).alias("_own"))
    w = trailing(width, key, "_bucket", open_left=open_left, us=us)
    both = own.unionByName(again, allowMissingColumns=True)
    made = {"recent_count": F.count(F.lit(1)).over(w)} | {n: F.sum(f"_v_{n}").over(w) for n in names}
    return both.withColumns(made).filter("_own").drop("_bucket", "_own", *[f"_v_{n}" for n in names])
