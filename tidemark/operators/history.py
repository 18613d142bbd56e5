"""Strictly-past event-history families E1 to E20.

Every family is a function from nothing to ``{column: Column}`` over a prepared
frame (see :func:`prepare`), with the keys it needs. Null keys are a group of
their own. ``None``/NULL stands for what has no history, except where a family
says 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions import frames
from tidemark.functions.frames import past, trailing
from tidemark.functions.ranges import number, running
from tidemark.functions.windows import DAY, HOUR, event_us, first_of, share, with_distinct
from tidemark.session import stored

#: What stands for a missing key.
MISSING = {
    "customer_id": "__MISSING_CUSTOMER__",
    "device_id": "__MISSING_DEVICE__",
    "merchant_id": "__MISSING_MERCHANT__",
    "location": "__MISSING_LOCATION__",
    "merchant_category": "__MISSING_CATEGORY__",
}
KEYS = {"customer_id": "c", "device_id": "d", "merchant_id": "m", "location": "l", "merchant_category": "g"}


@dataclass(frozen=True)
class Family:
    """``columns()`` over a prepared frame; ``flags`` are pairs whose first row it needs marked."""

    name: str
    columns: Callable[[], dict[str, Column]]
    lead: str  # the key by which its windows are dealt
    needs: tuple[str, ...]  # input columns
    flags: tuple[tuple[str, str], ...] = ()
    kinds: tuple[tuple[str, int, bool], ...] = ()  # trailing counts of distinct customers: column, width, open on the left
    after: Callable[[], dict[str, Column]] = field(default=dict)  # columns made from those of ``columns``
    drop: tuple[str, ...] = ()
    doc: str = ""


def prepare(df: DataFrame, time: str = "timestamp", amount: str = "amount", age: str = "account_age_days") -> DataFrame:
    """Adds the internal columns that families read; absent input columns give nulls."""
    have = set(df.columns)
    col = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    made = {f"_{short}": F.coalesce(col(name, "string").cast("string"), F.lit(MISSING[name])) for name, short in KEYS.items()}
    us = event_us(F.col(time))
    made |= {"us": us, "_x": col(amount, "double").cast("double"), "_age": col(age, "double").cast("double")}
    out = df.withColumns(made)
    day = F.floor(F.col("us") / DAY)
    # a negative amount and an age that isn't whole are errors, as soon as a family reads them
    valid_x = F.when(F.col("_x") >= 0, F.col("_x")).when(F.col("_x").isNull(), F.raise_error(F.lit("amount is missing"))).otherwise(F.raise_error(F.lit("amount must be finite and not negative")))
    age = F.when(F.isnan("_age") | F.col("_age").isNull() | (F.abs("_age") == float("inf")), F.lit(None).cast("long")).when(F.col("_age") == F.floor("_age"), F.col("_age").cast("long")).otherwise(F.raise_error(F.lit("account age must be whole")).cast("long"))
    return out.withColumns({
        "_x": valid_x, "_y": F.log1p(valid_x), "_hour": F.floor(F.pmod(F.col("us"), F.lit(DAY)) / HOUR), "_wday": F.pmod(day + 3, F.lit(7)), "_born": day - age,
    }).withColumn("_part", F.least(F.floor(F.col("_hour") / 6), F.lit(3)))


def _kinds(name: str) -> Column:
    """The distinct customers of a trailing frame that the family names among its ``kinds``."""
    return F.col(f"_kinds_{name}")


def _flag(a: str, b: str) -> str:
    return f"_new_{a}{b}"


INTERNAL = (*[f"_{s}" for s in KEYS.values()], "us", "_x", "_y", "_age", "_hour", "_wday", "_born", "_part")


# --- families ---------------------------------------------------------------


def _amounts(k: str, p: str) -> dict[str, Column]:
    w = past(k)
    n, mean, log_mean, std = w.count(), w.mean("_x"), w.mean("_y"), w.std("_y")
    return {
        f"{p}_prior_mean_amount": mean,
        f"{p}_prior_mean_log_amount": log_mean,
        f"{p}_prior_std_log_amount": std,
        f"{p}_amount_to_prior_mean": F.col("_x") / (mean + 1),
        f"{p}_log_amount_zscore": F.when(n >= 5, (F.col("_y") - log_mean) / F.greatest(std, F.lit(0.1))),
    }


def _e1() -> dict[str, Column]:
    w = past("_c")
    return {
        "customer_prior_count": w.count(),
        "customer_first_seen": (w.count() == 0).cast("int"),
        "customer_seconds_since_last": w.since(),
        "customer_observed_age_seconds": w.age(),
        **_amounts("_c", "customer"),
        "customer_log_amount_minus_prior_mean": F.col("_y") - w.mean("_y"),
    }


def _pair(a: str, b: str, prefix: str, empty: float | None, new: str | None = "new", recency: bool = True, whole: str | None = None) -> dict[str, Column]:
    """Familiarity of a pair: count, newness, recency, share of ``whole``'s (``a``'s) rows."""
    w = past(a, b)
    n = w.count()
    out = {f"{prefix}_prior_count": n}
    if new:
        out[f"{prefix}_{new}"] = (n == 0).cast("int")
    if recency:
        out[f"{prefix}_seconds_since_last"] = w.since()
    return out | {f"{prefix}_count_share": share(n, past(whole or a).count(), empty)}


def _e3() -> dict[str, Column]:
    w, pair = past("_d"), past("_d", "_c")
    n, own, kinds = w.count(), pair.count(), w.total(_flag("d", "c"))
    return {
        "device_prior_count": n,
        "device_prior_distinct_customer_count": kinds,
        "device_prior_distinct_customer_count_excluding_current": kinds - (own > 0).cast("int"),
        "device_seconds_since_last": w.since(),
        "device_observed_age_seconds": w.age(),
        "device_prior_other_customer_transaction_count": n - own,
        "customer_share_of_device_prior_transactions": share(own, n, None),
    }


def _broad(k: str, p: str) -> dict[str, Column]:
    hour, day, week = (trailing(w, k).count() for w in (HOUR, DAY, 7 * DAY))
    return {f"{p}_prior_1h_count": hour, f"{p}_prior_24h_count": day, f"{p}_prior_7d_count": week, f"{p}_1h_vs_7d_rate_ratio": (hour + 1) / (week / 168 + 1)}


def _e6() -> dict[str, Column]:
    w, life = trailing(30 * DAY, "_c"), past("_c")
    mean, log_mean = w.mean("_x"), w.mean("_y")
    return {
        "customer_30d_count": w.count(),
        "customer_30d_mean_amount": mean,
        "customer_30d_mean_log_amount": log_mean,
        "customer_amount_to_30d_mean": F.col("_x") / (mean + 1),
        "customer_log_amount_minus_30d_mean": F.col("_y") - log_mean,
        "customer_30d_to_lifetime_mean_ratio": (mean + 1) / (life.mean("_x") + 1),
    }


def _e9() -> dict[str, Column]:
    w, day = past("_m"), trailing(DAY, "_m")
    return {
        "merchant_prior_transaction_count": w.count(),
        "merchant_seconds_since_last": w.since(),
        "merchant_prior_unique_customers": w.total(_flag("m", "c")),
        "merchant_transactions_24h": day.count(),
        "merchant_unique_customers_24h": _kinds("m_24h"),
    }


def _e10() -> dict[str, Column]:
    out = {}
    for name, width in (("24h", DAY), ("7d", 7 * DAY)):
        kinds = _kinds(f"d_{name}")
        out[f"device_unique_customers_{name}"] = kinds
        out[f"device_other_customers_{name}"] = kinds - (trailing(width, "_d", "_c").count() > 0).cast("int")
    life = past("_d").total(_flag("d", "c"))
    return out | {"device_7d_unique_to_lifetime_unique_ratio": out["device_unique_customers_7d"] / F.greatest(life, F.lit(1))}


def _e12() -> dict[str, Column]:
    flag, out = _flag("c", "m"), {}
    for name, days in (("7d", 7), ("30d", 30)):
        w = trailing(days * DAY, "_c", open_left=True)
        new = w.total(flag)
        out[f"customer_new_merchants_{name}"] = new
        out[f"customer_new_merchant_share_{name}"] = share(new, w.count(), 0)
    return out | {"customer_seconds_since_last_new_merchant": past("_c").since(flag)}


def _e13() -> dict[str, Column]:
    flag, out = _flag("m", "c"), {}
    for name, days in (("24h", 1), ("7d", 7)):
        w = trailing(days * DAY, "_m", open_left=True)
        new = w.total(flag)
        out[f"merchant_new_customers_{name}"] = new
        out[f"merchant_new_customer_share_{name}"] = share(new, _kinds(f"m_open_{name}"), 0)
    return out | {"merchant_seconds_since_last_new_customer": past("_m").since(flag)}


def _e18() -> dict[str, Column]:
    a, b = trailing(HOUR, "_m").count(), trailing(2 * HOUR, "_m", until=HOUR).count()
    return {"merchant_transactions_1h": a, "merchant_log_rate_change_1h_vs_previous_1h": F.log1p(a) - F.log1p(b)}


def _e19() -> dict[str, Column]:
    # running count of each (customer, day) up to and with its row; the past row with the most, then the earliest day, is the mode
    mode = past("_c").greatest("mode", F.when(F.col("_born").isNotNull(), F.struct(F.col("_upto").alias("n"), (-F.col("_born")).alias("day"))))
    known = F.col("_born").isNotNull() & mode.isNotNull()
    off = F.when(known, F.col("_born") + mode["day"]).otherwise(F.lit(0))
    return {
        "customer_creation_day_deviation": off,
        "customer_creation_day_abs_deviation": F.abs(off),
        "customer_creation_day_mode_share": F.when(known, mode["n"] / past("_c").count()).otherwise(F.lit(0.0)),
    }


FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("customer_history", _e1, "_c", ("customer_id", "amount")),
        Family("customer_device", lambda: _pair("_c", "_d", "customer_device", None), "_c", ("customer_id", "device_id")),
        Family("customer_location", lambda: _pair("_c", "_l", "customer_location", None), "_c", ("customer_id", "location")),
        Family("device_global", _e3, "_d", ("customer_id", "device_id"), (("d", "c"),)),
        Family("customer_velocity_1h", lambda: {"customer_prior_1h_count": trailing(HOUR, "_c").count()}, "_c", ("customer_id",)),
        Family("device_velocity_1h", lambda: {"device_prior_1h_count": trailing(HOUR, "_d").count()}, "_d", ("device_id",)),
        Family("customer_velocity", lambda: _broad("_c", "customer"), "_c", ("customer_id",)),
        Family("device_velocity", lambda: _broad("_d", "device"), "_d", ("device_id",)),
        Family("amount_30d", _e6, "_c", ("customer_id", "amount")),
        Family("customer_merchant", lambda: _pair("_c", "_m", "customer_merchant", 0, "is_new"), "_c", ("customer_id", "merchant_id")),
        Family("customer_category", lambda: _pair("_c", "_g", "customer_category", 0, "is_new"), "_c", ("customer_id", "merchant_category")),
        Family("merchant_history", _e9, "_m", ("customer_id", "merchant_id"), (("m", "c"),), (("m_24h", DAY, False),)),
        Family("device_sharing", _e10, "_d", ("customer_id", "device_id"), (("d", "c"),), (("d_24h", DAY, False), ("d_7d", 7 * DAY, False))),
        Family("merchant_amount", lambda: _amounts("_m", "merchant"), "_m", ("merchant_id", "amount")),
        Family("customer_new_merchants", _e12, "_c", ("customer_id", "merchant_id"), (("c", "m"),)),
        Family("merchant_new_customers", _e13, "_m", ("customer_id", "merchant_id"), (("m", "c"),), (("m_open_24h", DAY, True), ("m_open_7d", 7 * DAY, True))),
        Family("device_location", lambda: _pair("_d", "_l", "device_location", None, "is_new"), "_d", ("device_id", "location")),
        Family("temporal_habits", lambda: {"customer_daypart_share": share(past("_c", "_part").count(), past("_c").count(), 0), "customer_weekday_share": share(past("_c", "_wday").count(), past("_c").count(), 0)}, "_c", ("customer_id",)),
        Family("device_merchant", lambda: _pair("_d", "_m", "device_merchant", 0, None, False), "_d", ("device_id", "merchant_id")),
        Family("merchant_location", lambda: _pair("_m", "_l", "merchant_location", 0, None, False), "_m", ("merchant_id", "location")),
        Family("merchant_acceleration", _e18, "_m", ("merchant_id",)),
        Family("account_consistency", _e19, "_c", ("customer_id", "account_age_days")),
    )
}


#: Rows of a key from which it is read chunk by chunk: what one task orders and keeps frames of in little time and memory.
SPLIT_OVER = 1_000_000
#: Rows of a task, about, beyond which rows are dealt into more tasks than the session's partitions.
TASK_ROWS = 100_000
#: Rows of a window that stay in memory; more wait on disk. Spark doesn't take memory from a window that is being read, so windows over a busy
#: key that follow each other would hold all that a task has.
WINDOW_ROWS = 100_000
_SPILL = "spark.sql.windowExec.buffer.spill.threshold"
#: Heavy keys that are sent to all tasks; more are joined as Spark sees fit.
SENT = 100_000
#: How far back each family's trailing frames go.
REACH = {"customer_velocity_1h": HOUR, "device_velocity_1h": HOUR, "customer_velocity": 7 * DAY, "device_velocity": 7 * DAY, "amount_30d": 30 * DAY, "merchant_history": DAY, "device_sharing": 7 * DAY, "customer_new_merchants": 30 * DAY, "merchant_new_customers": 7 * DAY, "merchant_acceleration": 2 * HOUR}
LEADS = ("_d", "_m", "_c")


def features(df: DataFrame, families: Sequence[str], time: str = "timestamp", amount: str = "amount", age: str = "account_age_days", split_over: int = SPLIT_OVER) -> DataFrame:
    """``df`` with the columns of the families.

    Windows are grouped by the key that leads them and made key by key, so rows
    are dealt once for each of customer, device and merchant, however many
    families there are. Keys of more than ``split_over`` rows are dealt by time as
    well and read chunk by chunk (see ``frames``); they are found by one count of
    the keys.
    """
    unknown = [f for f in families if f not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown families: {unknown}")
    chosen = [FAMILIES[f] for f in dict.fromkeys(families)]
    keep = list(df.columns)
    # the caller's columns of names that are used here travel as one struct
    taken, whole = [c for c in keep if (c == "us" or c.startswith("_")) and c not in (time, amount, age)], f"row{uuid.uuid4().hex}"
    if taken:
        df = df.withColumn(whole, F.struct(*[F.col(f"`{c}`") for c in taken])).drop(*taken)
    out = prepare(df, time, amount, age)
    made: list[str] = []
    # what no family reads isn't carried along, nor checked: where the caller left the amount out, the count of heavy keys must not read it
    needs = {c for f in chosen for c in f.needs}
    out = out.drop(*(("_x", "_y") if "amount" not in needs else ()), *(("_age", "_born") if "account_age_days" not in needs else ()), *[f"_{s}" for n, s in KEYS.items() if n not in needs])
    if not any(f.name == "temporal_habits" for f in chosen):
        out = out.drop("_hour", "_wday", "_part")
    leads = {k: _reach(f for f in chosen if f.lead == k) for k in LEADS if any(f.lead == k for f in chosen)}
    seen = Observation()
    heavy = _heavy(out, leads, split_over, seen)
    rows = (seen.get["n"] or 0) // len(leads) if leads else 0
    tasks = 0  # as many as the session has
    if rows > TASK_ROWS:
        spark = df.sparkSession
        if int(spark.conf.get(_SPILL)) == 2**31 - 1:  # nobody has set it
            spark.conf.set(_SPILL, str(WINDOW_ROWS))
        tasks = max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism)
    for lead in LEADS:
        own = [f for f in chosen if f.lead == lead]
        pairs = list(dict.fromkeys(p for f in chosen for p in f.flags if f"_{p[0]}" == lead))
        if not own and not pairs:
            continue
        if lead in heavy:
            out = stored(out)  # it is read several times
            keys = heavy[lead]
            rest = _whole(out.join(keys, lead, "left_anti"), lead, own, pairs, tasks)
            out = rest.unionByName(_split(out.join(keys, lead), lead, own, pairs, tasks).select(*rest.columns))
        else:
            out = _whole(out, lead, own, pairs, tasks)
    for f in chosen:
        made += list(f.columns())
    return out.select(*[F.col(whole).getField(c).alias(c) if c in taken else F.col(f"`{c}`") for c in keep], *dict.fromkeys(made))


def _reach(own: Iterable[Family]) -> int:
    """How far back the trailing frames of the families go."""
    return max((REACH.get(f.name, 0) for f in own), default=0)


def _heavy(df: DataFrame, leads: dict[str, int], over: int, seen: Observation | None = None) -> dict[str, DataFrame]:
    """The keys of more than ``over`` rows, for those of the leads that have any, each with the length of its chunks. ``seen`` gets ``n``, the rows of all leads.

    A chunk has half of ``over`` rows, were they even in time, but is no shorter than
    a day and the lead's reach: chunks of few rows would carry as many measures as rows.
    """
    if not leads:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lead"), F.col(k).alias("key")) for k in leads]))
    mean = F.avg("_y") if "_y" in df.columns else F.lit(None).cast("double")
    y = ["_y"] if "_y" in df.columns else []
    counts = df.select(each.alias("r"), "us", *y).groupBy("r.lead", "r.key").agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("span"), mean.alias("mean"))
    if seen is not None:
        counts = counts.observe(seen, F.sum("n").alias("n"))
    counts = stored(counts.filter(F.col("n") > over))  # a key for each ``over`` rows of a lead at most
    found = {r["lead"]: r["keys"] for r in counts.groupBy("lead").agg(F.count(F.lit(1)).alias("keys")).collect()}
    even = (F.col("span") * (over / 2) / F.col("n")).cast("long")
    out = {}
    for k in found:
        length = F.greatest(F.lit(max(leads[k], DAY)).cast("long"), even)
        keys = counts.filter(F.col("lead") == k).select(F.col("key").alias(k), F.col("mean").alias(f"{frames.MEAN}_y"), length.alias(frames.LENGTH))
        out[k] = F.broadcast(keys) if found[k] <= SENT else keys
    return out


def _parts(own: Sequence[Family]) -> tuple[dict, bool]:
    kinds = {f"_kinds_{n}": (width, open_left) for f in own for n, width, open_left in f.kinds}
    return kinds, any(f.name == "account_consistency" for f in own)


def _whole(out: DataFrame, lead: str, own: Sequence[Family], pairs: Sequence[tuple[str, str]], tasks: int = 0) -> DataFrame:
    """The families of a key, each key in one task."""
    kinds, upto = _parts(own)
    if tasks:
        out = out.repartition(tasks, lead)  # a number that adaptive execution keeps: it goes by bytes shuffled, which windows multiply
    elif pairs or upto or kinds:
        out = out.repartition(lead)  # by the key alone: the windows over pairs and over the key all fit
    # a pair's first row is marked where the pair's first key leads; which row of a tie it is doesn't matter
    if pairs:
        out = out.withColumns({_flag(*p): first_of(f"_{p[0]}", f"_{p[1]}") for p in pairs})
    with frames.sharing() as windows:
        cols = {n: c for f in own for n, c in f.columns().items()}
    made = [n for w in windows.values() for n in w]
    # windows of the pair that is marked last and its partners' next rows fit the order that its mark left
    if pairs and (same := windows.pop(tuple(f"_{k}" for k in pairs[-1]), None)):
        out = out.withColumns(same)
    if kinds:
        out = with_distinct(out, lead, "_c", kinds)
    if upto:
        running = Window.partitionBy("_c", "_born").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_upto", F.count(F.lit(1)).over(running))
    return _columns(out, windows, cols).drop("_upto", *kinds, *made)


def _columns(out: DataFrame, windows: dict[tuple[str, ...], dict[str, Column]], cols: dict[str, Column]) -> DataFrame:
    """The windows, those of the key alone first, and the families' columns over them."""
    for keys in sorted(windows, key=len):
        out = out.withColumns(windows[keys])
    return out.withColumns(cols) if cols else out


def _split(out: DataFrame, lead: str, own: Sequence[Family], pairs: Sequence[tuple[str, str]], tasks: int = 0) -> DataFrame:
    """The same for heavy keys: each key and chunk of time in one task. ``out`` is read several times."""
    kinds, upto = _parts(own)
    reach = _reach(own)
    rows = frames.in_chunks(out, max(reach, DAY))
    with frames.noting() as first:  # a pair's mark needs to know whether an earlier chunk has the pair
        for a, b in pairs:
            past(f"_{a}", f"_{b}").count()
        if upto:
            past("_c", "_born").count()
    present = [f"_{s}" for s in KEYS.values()]
    if first:
        rows = frames.carry(rows, first, rows, present)
    if pairs:
        alone = lambda a, b: first_of(f"_{a}", f"_{b}", frames.CHUNK)
        rows = rows.withColumns({_flag(a, b): F.when(F.coalesce(f"_sum_n_{a}_{b}", F.lit(0)) == 0, alone(a, b)).otherwise(0) for a, b in pairs})
    if upto:
        running = Window.partitionBy("_c", "_born", frames.CHUNK).orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_upto", F.count(F.lit(1)).over(running) + F.coalesce("_sum_n_c_born", F.lit(0)))
    rows = rows.drop(*[m for measures in first.values() for m in measures])
    base = stored(rows) if first else rows
    rows = frames.with_copies(base, reach)
    deal = (lambda df: df.repartition(tasks, lead, frames.CHUNK)) if tasks else (lambda df: df)
    if kinds:
        rows = with_distinct(deal(rows), lead, "_c", kinds, more=(frames.CHUNK,))
    with frames.noting() as wanted:
        for f in own:
            f.columns()
    rows = frames.carry(rows, wanted, base, present)
    if not kinds or any(len(k) > 1 for k in wanted):  # joins by other keys have dealt them anew
        rows = deal(rows)
    with frames.by_chunk(), frames.sharing() as windows:
        cols = {n: c for f in own for n, c in f.columns().items()}
    return _columns(rows, windows, cols).filter(frames.OWN)


def build(df: DataFrame, family: str | Sequence[str], requested: Sequence[str], **how) -> DataFrame:
    """The requested columns of one or several families, in that order, after the columns of ``df``."""
    names = [family] if isinstance(family, str) else list(family)
    if isinstance(requested, str) or not isinstance(requested, Sequence):
        raise TypeError("requested must be a list of names")
    if not requested:
        raise ValueError("no column requested")
    if len(set(requested)) < len(requested):
        raise ValueError("a column is requested twice")
    have = [c for n in names for c in FAMILIES[n].columns()]
    if unknown := [c for c in requested if c not in have]:
        raise ValueError(f"unknown columns: {unknown}")
    return features(df, names, **how).select(*[F.col(f"`{c}`") for c in df.columns], *requested)


def past_group(df: DataFrame, group: str, order: Sequence[str], value: str | None = None) -> DataFrame:
    """Row-based helper: rows of the group before this one in ``order``, and their mean ``value``."""
    # places in the order, then sums over ranges of places: a group with most of the rows is in no single task
    place, one, own = (f"{n}{uuid.uuid4().hex}" for n in ("place", "one", "own"))
    rows = number(df, order, place).withColumns({one: F.lit(1), own: F.col(f"`{value}`").cast("double") if value else F.lit(None).cast("double")})
    has = F.col(own).isNotNull().cast("long")
    steps = rows.withColumns({f"{own}n": has, f"{own}s": F.coalesce(own, F.lit(0.0))})
    past_rows = running(steps, [group], place, [one, f"{own}n", f"{own}s"])
    n, total = F.col(f"c_{own}n") - F.col(f"{own}n"), F.col(f"c_{own}s") - F.col(f"{own}s")
    out = past_rows.withColumn("past_group_count", F.col(f"c_{one}") - 1)
    keep = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep, "past_group_count", *([F.when(n > 0, total / n).alias("past_group_mean")] if value else []))


def seeded(prior: DataFrame, current: DataFrame, families: Sequence[str], time: str = "timestamp", **how) -> DataFrame:
    """Features of ``current`` with histories that begin in ``prior``, which must end before it."""
    us = event_us(F.col(time))
    end, begin = prior.agg(F.max(us)).first()[0], current.agg(F.min(us)).first()[0]
    if end is not None and begin is not None and end >= begin:
        raise ValueError("the prior stream must end before the current one begins")
    now = f"now{uuid.uuid4().hex}"
    both = prior.withColumn(now, F.lit(False)).unionByName(current.withColumn(now, F.lit(True)), allowMissingColumns=True)
    return features(both, families, time, **how).filter(now).drop(now)
