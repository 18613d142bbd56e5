"""The history families over a stream, equal to the batch ones.

One stateful operator runs for each leading key (customer, device, merchant); families of
several keys are operators one after the other, each adding its columns, in one query.
Rows wait until the watermark has passed their time, so that all rows of a tie are there;
then each reads the state, and only afterwards all of them join it.

An operator's groups are ``GROUPS`` parts of the keys by a hash, not single keys, as each call
of the engine and each access of the state store costs more than many rows. Waiting rows of a
group lie in blocks, an entry of the state each; an event-time timer at the first row of a
block does the waking up, and the group's rows that the watermark has passed come out in
rounds of about ``ROUND`` rows, key by key and tie by tie: what a round reads of a key's state
is read once, and what has changed is written once, not for each row. The last tie of a stream
comes out once a later time has been seen, such as a closing row.

A key's state (:mod:`tidemark.streaming.state`) is a head with lifetime sums, a map of its
partners' counts and last times, of which a row touches its own, and a log of recent rows
with a cursor for each window. What a row costs doesn't depend on how busy its key is.

Rows behind the watermark can't be given features any more. ``late="drop"`` leaves them to
the engine, which counts them; ``late="mark"`` lets the first operator return them at
once, without features, with what was wrong in a column ``late``.

``snapshot`` reads a query's state into a table, one row for each entry, and another query
goes on from it: rows that were still waiting come out there.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import operator
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.windows import DAY, HOUR, SECOND
from tidemark.operators.history import FAMILIES, prepare
from tidemark.streaming.state import STORED, Held, Log, Stored, Trailing, deviation, loaded, mean_of, packed, unpacked, whole

FIELDS = ("us", "_x", "_y", "_c", "_d", "_m", "_l", "_g", "_part", "_wday", "_born")
WHOLE = ("us", "_part", "_wday", "_born")
TIME = "event_time"
GROUPS = 1_024  # of keys; a checkpoint or snapshot goes on with the number that it began with
BLOCK = 1_000  # rows that wait in one entry of the state
ROUND = 100_000  # rows that a task holds at once, about
_HOUR, _DAY, _WEEK = Trailing(HOUR), Trailing(DAY), Trailing(7 * DAY)
#: The windows that each family reads, and the partner columns that it counts.
WINDOWS = {
    "customer_velocity_1h": (_HOUR,), "device_velocity_1h": (_HOUR,), "customer_velocity": (_HOUR, _DAY, _WEEK), "device_velocity": (_HOUR, _DAY, _WEEK),
    "amount_30d": (Trailing(30 * DAY, sums=True),), "merchant_history": (Trailing(DAY, kind="_c"),), "device_sharing": (Trailing(DAY, kind="_c"), Trailing(7 * DAY, kind="_c")),
    "customer_new_merchants": (Trailing(7 * DAY, True, "_m"), Trailing(30 * DAY, True, "_m")), "merchant_new_customers": (Trailing(DAY, True, "_c"), Trailing(7 * DAY, True, "_c")),
    "merchant_acceleration": (_HOUR, Trailing(2 * HOUR)),
}
PARTNERS = {"customer_device": "_d", "customer_location": "_l", "device_global": "_c", "customer_merchant": "_m", "customer_category": "_g", "merchant_history": "_c", "device_sharing": "_c", "customer_new_merchants": "_m", "merchant_new_customers": "_c", "device_location": "_l", "device_merchant": "_m", "merchant_location": "_l", "account_consistency": "_born"}
AMOUNTS = {"customer_history", "merchant_amount", "amount_30d"}  # that read sums over all rows
PAIRS = {"customer_device": ("new", True, None), "customer_location": ("new", True, None), "customer_merchant": ("is_new", True, 0.0), "customer_category": ("is_new", True, 0.0), "device_location": ("is_new", True, None), "device_merchant": (None, False, 0.0), "merchant_location": (None, False, 0.0)}


class KeyState:
    """What is remembered of one key; ``save`` writes what has changed."""

    def __init__(self, families: Sequence[str], held: Held):
        self.families, self.held = families, held
        self.kinds = sorted({PARTNERS[f] for f in families if f in PARTNERS} | ({"_part", "_wday"} if "temporal_habits" in families else set()))
        self.n, self.first, self.last, x, y, yy, *mode, following, oldest, self.purge = held.get_head()
        self.x, self.y, self.yy, self.mode = int(x), int(y), int(yy), mode  # rows and day of the most frequent creation day, the earliest on ties
        self.asked = [(f, WINDOWS.get(f, ())) for f in families]
        self.summed = not AMOUNTS.isdisjoint(families)
        self.log = Log(held, sorted({w for f in families for w in WINDOWS.get(f, ())}, key=lambda w: w.name), following, oldest)
        self.known: dict[tuple[str, str], tuple[int, int | None]] = {}
        self.numbers: dict[str, tuple[int, int | None]] = {}  # of partners, and the time of the last new one
        self.changed: set[tuple] = set()

    def save(self) -> None:
        self.log.save()
        for key in self.changed:
            if len(key) == 1:
                self.held.put("kinds", key, self.numbers[key[0]])
            else:
                self.held.put("partners", key, self.known[key])
        self.changed = set()
        self.held.set_head((self.n, self.first, self.last, str(self.x), str(self.y), str(self.yy), *self.mode, self.log.next, self.log.oldest, self.purge))

    def _partner(self, kind: str, value) -> tuple[int, int | None]:
        """Rows with the partner and the time of the last."""
        key = (kind, str(value))
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self.held.get("partners", *key) or (0, None)
        return found

    def _number(self, kind: str) -> tuple[int, int | None]:
        if kind not in self.numbers:
            self.numbers[kind] = self.held.get("kinds", kind) or (0, None)
        return self.numbers[kind]

    def read(self, row: dict) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for f, windows in self.asked:
            out.update(self._family(f, windows, row))
        return out

    def _since(self, t, at):
        return None if at is None else (t - at) / SECOND

    def _amounts(self, p: str, row: dict) -> dict[str, Any]:
        n = self.n
        mean, log_mean, std = (mean_of(self.x, n), mean_of(self.y, n), deviation(n, self.y, self.yy)) if n else (None, None, None)
        return {f"{p}_prior_mean_amount": mean, f"{p}_prior_mean_log_amount": log_mean, f"{p}_prior_std_log_amount": std, f"{p}_amount_to_prior_mean": row["_x"] / (mean + 1) if n else None, f"{p}_log_amount_zscore": (row["_y"] - log_mean) / max(std, 0.1) if n >= 5 else None}

    def _family(self, f: str, windows: Sequence[Trailing], row: dict) -> dict[str, Any]:
        t, n, first, last = row["us"], self.n, self.first, self.last
        frames = [self.log.until(w, t) for w in windows]
        if f in PAIRS:
            new, recency, empty = PAIRS[f]
            own, at = self._partner(PARTNERS[f], row[PARTNERS[f]])
            out = {f"{f}_prior_count": own, f"{f}_count_share": own / n if n else empty}
            if new:
                out[f"{f}_{new}"] = int(own == 0)
            if recency:
                out[f"{f}_seconds_since_last"] = self._since(t, at)
            return out
        if f == "customer_history":
            return {"customer_prior_count": n, "customer_first_seen": int(n == 0), "customer_seconds_since_last": self._since(t, last), "customer_observed_age_seconds": self._since(t, first), **self._amounts("customer", row), "customer_log_amount_minus_prior_mean": row["_y"] - mean_of(self.y, n) if n else None}
        if f == "merchant_amount":
            return self._amounts("merchant", row)
        if f == "device_global":
            kinds, own = self._number("_c")[0], self._partner("_c", row["_c"])[0]
            return {"device_prior_count": n, "device_prior_distinct_customer_count": kinds, "device_prior_distinct_customer_count_excluding_current": kinds - int(own > 0), "device_seconds_since_last": self._since(t, last), "device_observed_age_seconds": self._since(t, first), "device_prior_other_customer_transaction_count": n - own, "customer_share_of_device_prior_transactions": own / n if n else None}
        if f.endswith("velocity_1h"):
            return {f"{f.split('_')[0]}_prior_1h_count": frames[0][1]}
        if f in ("customer_velocity", "device_velocity"):
            p = f.split("_")[0]
            a, b, c = (w[1] for w in frames)
            return {f"{p}_prior_1h_count": a, f"{p}_prior_24h_count": b, f"{p}_prior_7d_count": c, f"{p}_1h_vs_7d_rate_ratio": (a + 1) / (c / 168 + 1)}
        if f == "amount_30d":
            _, k, x, y, *_ = frames[0]
            mean, log_mean = (mean_of(x, k), mean_of(y, k)) if k else (None, None)
            return {"customer_30d_count": k, "customer_30d_mean_amount": mean, "customer_30d_mean_log_amount": log_mean, "customer_amount_to_30d_mean": row["_x"] / (mean + 1) if k else None, "customer_log_amount_minus_30d_mean": row["_y"] - log_mean if k else None, "customer_30d_to_lifetime_mean_ratio": (mean + 1) / (mean_of(self.x, n) + 1) if k else None}
        if f == "merchant_history":
            return {"merchant_prior_transaction_count": n, "merchant_seconds_since_last": self._since(t, last), "merchant_prior_unique_customers": self._number("_c")[0], "merchant_transactions_24h": frames[0][1], "merchant_unique_customers_24h": frames[0][5]}
        if f == "device_sharing":
            out = {}
            for name, w, frame in zip(("24h", "7d"), WINDOWS[f], frames, strict=True):
                out |= {f"device_unique_customers_{name}": frame[5], f"device_other_customers_{name}": frame[5] - int(self.log.holds(w, t, str(row["_c"])))}
            return out | {"device_7d_unique_to_lifetime_unique_ratio": out["device_unique_customers_7d"] / max(self._number("_c")[0], 1)}
        if f == "customer_new_merchants":
            out = {}
            for name, frame in zip(("7d", "30d"), frames, strict=True):
                out |= {f"customer_new_merchants_{name}": frame[4], f"customer_new_merchant_share_{name}": frame[4] / frame[1] if frame[1] else 0.0}
            return out | {"customer_seconds_since_last_new_merchant": self._since(t, self._number("_m")[1])}
        if f == "merchant_new_customers":
            out = {}
            for name, frame in zip(("24h", "7d"), frames, strict=True):
                out |= {f"merchant_new_customers_{name}": frame[4], f"merchant_new_customer_share_{name}": frame[4] / frame[5] if frame[5] else 0.0}
            return out | {"merchant_seconds_since_last_new_customer": self._since(t, self._number("_c")[1])}
        if f == "temporal_habits":
            of = lambda k: self._partner(k, row[k])[0] / n if n else 0.0
            return {"customer_daypart_share": of("_part"), "customer_weekday_share": of("_wday")}
        if f == "merchant_acceleration":
            hour, two = frames[0][1], frames[1][1]
            return {"merchant_transactions_1h": hour, "merchant_log_rate_change_1h_vs_previous_1h": math.log1p(hour) - math.log1p(two - hour)}
        if f == "account_consistency":
            if row["_born"] is None or not self.mode[0]:
                return {"customer_creation_day_deviation": 0, "customer_creation_day_abs_deviation": 0, "customer_creation_day_mode_share": 0.0}
            k, day = self.mode
            off = row["_born"] - day
            return {"customer_creation_day_deviation": off, "customer_creation_day_abs_deviation": abs(off), "customer_creation_day_mode_share": k / n}
        raise ValueError(f)

    def add(self, rows: list[dict]) -> None:
        """A whole tie joins the state."""
        for r in rows:
            t = r["us"]
            self.n, self.first, self.last = self.n + 1, t if self.first is None else self.first, t
            if self.summed:
                y = whole(r["_y"])
                self.x, self.y, self.yy = self.x + whole(r["_x"]), self.y + y, self.yy + y * y
            fresh = []
            for k in self.kinds:
                if r[k] is None:
                    continue
                key = (k, str(r[k]))
                before, _ = self._partner(*key)
                if not before:
                    fresh.append(k)
                    self.numbers[k] = (self._number(k)[0] + 1, t)
                    self.changed.add((k,))
                self.known[key] = (before + 1, t)
                self.changed.add(key)
                if k == "_born" and (before + 1, -r[k]) > (self.mode[0], -self.mode[1] if self.mode[0] else 0):
                    self.mode = [before + 1, r[k]]
            if self.log.windows:
                self.log.append(t, r["_x"], r["_y"], str(r["_c"]), str(r["_m"]), fresh)


def _plain(pdf: pd.DataFrame) -> list[dict]:
    """Rows with Python's own values; names with ``_`` in front don't reach an operator, they come with ``of_``."""
    out: dict[str, list] = {}
    for c in pdf.columns:
        if c == TIME:
            continue
        name = "_" + c[3:] if c.startswith("of_") else c
        values = pdf[c].tolist()
        if pdf[c].dtype == object or pdf[c].hasnans:
            values = [None if v is None or v != v else v for v in values]
        out[name] = [None if v is None else int(v) for v in values] if name in WHOLE else values
    return [dict(zip(out, row, strict=True)) for row in zip(*out.values(), strict=True)]


_US = operator.itemgetter("us")


def _due(row: dict) -> int:
    """The watermark, in milliseconds, at which no other row of its time can come."""
    return row["us"] // 1000 + 1


class HistoryProcessor(StatefulProcessor):
    """Holds rows back until their time is complete, then emits them with their features.

    ``payload``: columns that go on as they are; ``timed``: whether another operator follows; ``mark``: whether rows behind the
    watermark come out at once, as the ``first`` operator finds them; ``lead``: the field that tells the keys of a group apart
    (none: a group is one key).
    """

    def __init__(self, families: Sequence[str], payload: Sequence[str], columns: Sequence[str], timed: bool, mark: bool, first: bool, lead: str | None = None):
        self.families, self.payload, self.columns, self.timed, self.mark, self.first, self.lead = list(families), list(payload), list(columns), timed, mark, first, lead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = Stored(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The entries of a snapshot go into the state at once; rows of an earlier stream wait like others, but never come out."""
        if "entry" in initialState.columns:
            if (was := int(key[0].split("/")[1])) != GROUPS:
                raise ValueError(f"the snapshot has {was} groups of keys, not {GROUPS}")
            for at in loaded(self.held, initialState[["map", "entry", "content"]].itertuples(index=False, name=None)):
                self.handle.registerTimer(at)
        else:
            self._wait([{**r, "prior": True} for r in _plain(initialState)])

    def _out(self, rows: list[dict], passed: int) -> pd.DataFrame:
        """For another operator rows are of the time just after the watermark: all that it has passed come in one batch."""
        names = [*self.payload, *([TIME] if self.timed else []), *self.columns, *(["late"] if self.mark else [])]
        made = {}
        for c in names:
            own = "_" + c[3:] if c.startswith("of_") else c
            made[c] = [r.get(own) for r in rows]
        if self.timed:
            made[TIME] = pd.to_datetime([passed + 1] * len(rows), unit="ms")
        return pd.DataFrame({c: v if c == TIME else pd.Series(v, dtype=object) for c, v in made.items()}, columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new: list[dict] = []
        for pdf in rows:
            behind = []
            for r in _plain(pdf):
                if self.mark and self.first and r["us"] // 1000 < passed:
                    r["late"] = f"{passed * 1000 - r['us']} us behind the watermark"
                if self.mark and r.get("late"):
                    behind.append(r)
                else:
                    new.append(r)
            if len(new) >= ROUND:
                self._wait(new)
                new = []
            if behind:
                yield self._out(behind, passed)
        self._wait(new)

    def _wait(self, rows: list[dict]) -> None:
        """Rows join the waiting ones in blocks, with a timer at the first row of each; rows of one millisecond stay together."""
        blocks: list[list[dict]] = []
        for _, same in itertools.groupby(sorted(rows, key=_US), key=_due):
            if not blocks or len(blocks[-1]) >= BLOCK:
                blocks.append([])
            blocks[-1] += same
        for own in blocks:
            at = _due(own[0])
            before = self.held.get("waiting", at)
            self.held.put("waiting", (at,), (packed([*unpacked(before[0]), *own] if before else own),))
            self.handle.registerTimer(at)

    def _passed(self, passed: int) -> Iterator[tuple[list[dict], int]]:
        """The group's waiting rows that the watermark has passed, in the order of their times, about a round at a time; the others wait on.

        With each round comes the time in milliseconds before which no other row becomes due.
        """
        ready: list[dict] = []
        starts = sorted(at for (at,) in self.held.keys("waiting") if at <= passed)
        for at, following in zip(starts, [*starts[1:], passed + 1], strict=True):
            ready += unpacked(self.held.get("waiting", at)[0])
            self.held.put("waiting", (at,), None)
            if len(ready) < ROUND and following <= passed:
                continue
            ready.sort(key=_US)
            cut = bisect.bisect_left(ready, following, key=_due)  # no later block has a row before these
            if cut:
                yield ready[:cut], following
            ready = ready[cut:]
        self._wait(ready)

    def _with_features(self, rows: list[dict], upto: int) -> list[dict]:
        """Rows of one round, key by key; all rows due before ``upto`` are among them or were before."""
        keys: dict[str | None, list[dict]] = {}
        for r in rows:
            keys.setdefault(r[self.lead] if self.lead else None, []).append(r)
        out: list[dict] = []
        leaving: dict[int, list] = {}
        for key, own in keys.items():
            state = KeyState(self.families, self.held.of(key))
            for _, tie in itertools.groupby(own, key=_US):
                tie = list(tie)
                for r in tie:
                    if not r.get("prior"):
                        r.update(state.read(r))
                        out.append(r)
                state.add(tie)
            self._leave(state, key, upto, leaving)
        self._leave_later(leaving)
        return out

    def _leave(self, state: KeyState, key: str | None, upto: int, leaving: dict[int, list]) -> None:
        """Writes the state; of a silent key the rows that are kept leave once the last of them has left every window, at the end of that day."""
        state.log.save()
        if state.log.oldest < state.log.next:
            at = -(-(state.last + max(w.width for w in state.log.windows) + 2_000) // DAY) * DAY // 1000
            if at < upto:
                state.log.passed(at * 1000)
            elif not state.purge:
                state.purge = at
                leaving.setdefault(at, []).append(key)
        state.save()
        state.held.flush()

    def _leave_later(self, leaving: dict[int, list]) -> None:
        """Keys for which a timer is set, by its time."""
        for at, keys in leaving.items():
            before = self.held.get("leaving", at)
            self.held.put("leaving", (at,), (json.dumps([*(json.loads(before[0]) if before else []), *keys]),))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()  # timers come in the order of their times
        passed = timerValues.getCurrentWatermarkInMs()
        if self.held.get("waiting", at):
            for rows, upto in self._passed(passed):
                if out := self._with_features(rows, upto):
                    yield self._out(out, passed)
        if found := self.held.get("leaving", at):
            self.held.put("leaving", (at,), None)
            leaving: dict[int, list] = {}
            for own in json.loads(found[0]):
                state = KeyState(self.families, self.held.of(own))
                state.log.passed(at * 1000)
                state.purge = 0
                self._leave(state, own, at, leaving)
            self._leave_later(leaving)

    def close(self) -> None:
        pass


def _leads(families: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Families by leading key, in the order in which the keys come."""
    out: dict[str, list[str]] = {}
    for f in families:
        out.setdefault(FAMILIES[f].lead, []).append(f)
    return list(out.items())


def _fields(families: Sequence[str]) -> list[str]:
    """What the families' operators read of a row beside its time."""
    read = {"_x", "_y", "_c", "_m", *[FAMILIES[f].lead for f in families], *[PARTNERS[f] for f in families if f in PARTNERS], *(("_part", "_wday") if "temporal_habits" in families else ())}
    return [c for c in FIELDS if c in read]


def _group(lead: str):
    """The part of the keys that a row belongs to."""
    return F.concat(F.pmod(F.xxhash64("of" + lead), F.lit(GROUPS)).cast("string"), F.lit(f"/{GROUPS}"))


def _rows(df: DataFrame, row_id: str, time: str, families: Sequence[str], more: Sequence[str] = (), **how) -> DataFrame:
    return prepare(df, time, **how).select(F.col(row_id).cast("string").alias(row_id), *more, F.col("us"), *[F.col(c).alias("of" + c) for c in _fields(families)])


def stream_features(events: DataFrame, families: Sequence[str], row_id: str = "transaction_id", time: str = "timestamp", prior: DataFrame | None = None, late: str = "drop", delay: str = "0 seconds", snapshots: dict[str, DataFrame] | None = None, **how) -> DataFrame:
    """``row_id, us`` and the columns of the families, in the families' order by leading key.

    ``prior`` has the rows of an earlier stream, all before the events; histories begin with them. ``snapshots`` has the
    state of an earlier query for each leading key instead, as :func:`snapshot` reads it. ``late``: ``drop`` or ``mark``.
    ``delay``: how long a row may be late. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    if late not in ("drop", "mark"):
        raise ValueError("late rows are dropped or marked")
    if prior is not None and snapshots is not None:
        raise ValueError("histories begin with rows or with a snapshot")
    base = events.withColumn(TIME, F.col(time).cast("timestamp")).withWatermark(TIME, delay)
    flow = _rows(base, row_id, time, families, [TIME], **how)
    of = {f.name: f.dataType for f in flow.schema.fields}
    done: list[str] = []
    kinds = column_types(families)
    steps = _leads(families)
    for i, (lead, own) in enumerate(steps):
        last, names = i == len(steps) - 1, [c for f in own for c in FAMILIES[f].columns()]
        later = [f for _, more in steps[i + 1 :] for f in more]
        carried = [row_id, "us", *["of" + c for c in (_fields(later) if later else ())], *done]
        mark = late == "mark"
        fields = [T.StructField(c, kinds.get(c) or of[c]) for c in carried] + ([] if last else [T.StructField(TIME, T.TimestampType())]) + [T.StructField(c, kinds[c]) for c in names] + ([T.StructField("late", T.StringType())] if mark else [])
        start = None
        if prior is not None:
            start = _rows(prior, row_id, time, own, **how).withColumn("key", _group(lead)).groupBy("key")
        elif snapshots is not None:
            start = snapshots[lead].select("key", "map", "entry", "content").groupBy("key")
        flow = flow.withColumn("key", _group(lead))
        if mark:  # without the column that carries the watermark the engine drops nothing
            flow = flow.drop(TIME)
        flow = flow.groupBy("key").transformWithStateInPandas(
            HistoryProcessor(own, carried, names, not last, mark, i == 0, lead), outputStructType=T.StructType(fields), outputMode="Append", timeMode="EventTime",
            initialState=start, eventTimeColumnName="" if last else TIME,
        )
        done += names
    return flow


def snapshot(spark: SparkSession, checkpoint: str, families: Sequence[str]) -> dict[str, DataFrame]:
    """The state of a stopped query by leading key: ``key`` (a group of keys)``, map, entry, content``, an entry of a map a row.

    Its size follows the keys, their partners and the rows of their longest window, not the rows of the stream. Write it to a
    table to keep it. The query must have had the same families.
    """
    steps = _leads(families)
    out = {}
    for i, (lead, _) in enumerate(steps):
        operator = len(steps) - 1 - i  # the last operator of a query has number 0
        read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", name).load()  # noqa: B023, E731
        parts = []
        for name, (key, value) in STORED.items():
            entry, content = ([c.split()[0] for c in x.split(", ")] for x in (key, value))
            parts.append(read(name).select(F.col("key.key").alias("key"), F.lit(name).alias("map"), _listed("user_map_key", entry).alias("entry"), _listed("user_map_value", content).alias("content")))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        out[lead] = found
    return out


def _listed(struct: str, names: Sequence[str]):
    """The fields of a struct as a JSON list."""
    each = [F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(f"{struct}.{n}").alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', "$1"), F.lit("null")) for n in names]
    return F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]"))


def column_types(families: Sequence[str]) -> dict[str, T.DataType]:
    """Types of the families' columns: counts and flags are whole."""
    real = ("seconds", "mean", "share", "ratio", "std", "zscore", "log")
    return {c: T.DoubleType() if any(w in c for w in real) and not c.endswith("transaction_count") else T.LongType() for f in families for c in FAMILIES[f].columns()}


def late_rows(query) -> int:
    """Rows that a streaming query has dropped in its last batches because they were behind its watermark, by its progress reports."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
