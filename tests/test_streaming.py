"""The stream gives what the batch gives, whatever the chunks."""

import datetime as dt
import random

import pytest

from tidemark.operators import history
from tidemark.streaming.history import late_rows, stream_features

SCHEMA = "transaction_id string, customer_id string, device_id string, merchant_id string, merchant_category string, location string, amount double, timestamp timestamp, account_age_days int"
LEADS = {}
for _f in history.FAMILIES.values():
    if not _f.name.endswith("velocity_1h"):
        LEADS.setdefault(_f.lead, []).append(_f.name)


@pytest.mark.parametrize("lead,seeded", [(k, False) for k in sorted(LEADS)] + [("_c", True), ("_m", True)])
def test_stream_equals_batch(spark, tmp_path, lead, seeded):
    r, t, rows = random.Random(5), 0, []
    for i in range(60):
        t += r.choice([0, 0, 1, 1800, 3600, 86400, 200000])
        rows.append((str(i), r.choice("abc"), r.choice(["d", None]), r.choice("mn"), r.choice(["x", None]), r.choice(["l", "k"]), float(r.randint(1, 99)), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), r.choice([1, 2, 5])))
    cut = rows[25][7] if seeded else rows[0][7]
    now = [x for x in rows if x[7] >= cut]
    prior = spark.createDataFrame([x for x in rows if x[7] < cut], SCHEMA) if seeded else None
    for k in range(0, len(now), 20):  # chunks cut through ties
        spark.createDataFrame(now[k : k + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", *["z"] * 5, 1.0, dt.datetime(2030, 1, 1), 1)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_features(events, LEADS[lead], prior=prior).writeStream.format("memory").queryName(f"out{lead}{seeded}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    a = spark.table(f"out{lead}{seeded}").toPandas().set_index("transaction_id").sort_index()
    b = history.features(spark.createDataFrame(rows, SCHEMA), LEADS[lead]).filter(f"timestamp >= '{cut}'").toPandas().set_index("transaction_id").sort_index()
    assert list(a.index) == list(b.index)
    for c in a.columns.drop("us"):
        x, y = a[c].astype(float), b[c].astype(float)
        assert (x.isna() == y.isna()).all() and not ((x - y).abs() > 1e-6).any(), c


def test_late_rows_are_counted(spark, tmp_path):
    """A row behind the watermark changes nothing and is told of."""
    at = lambda h: dt.datetime(2027, 3, 1) + dt.timedelta(hours=h)
    row = lambda i, h: (str(i), "a", "d", "m", "x", "l", 5.0, at(h), 1)
    for k, rows in enumerate(([row(0, 0), row(1, 10)], [row(2, 20)], [row(3, 1), row(4, 30)], [row(5, 1000)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = stream_features(events, ["customer_history"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        if k == 2:
            assert late_rows(q) == 1
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("us").collect()
    assert [(r["transaction_id"], r["customer_prior_count"]) for r in got] == [("0", 0), ("1", 1), ("2", 2), ("4", 3)]


def _rows(n, seed=3):
    r, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 0, 1, 1800, 3600, 86400, 200000])
        rows.append((str(i), r.choice("abc"), r.choice(["d", None]), r.choice("mn"), r.choice(["x", None]), r.choice(["l", "k"]), float(r.randint(1, 99)), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), r.choice([1, 2, 5])))
    return rows


END = ("end", *["z"] * 5, 1.0, dt.datetime(2030, 1, 1), 1)


def _written(spark, path, rows, each=15):
    for k in range(0, len(rows), each):
        spark.createDataFrame(rows[k : k + each], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _ran(spark, tmp_path, families, name, **how):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{name}")
    q = stream_features(events, families, **how).writeStream.format("parquet").option("path", f"{tmp_path}/out{name}").option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out{name}").toPandas().set_index("transaction_id").sort_index()


def _equal(a, b, columns):
    assert list(a.index) == list(b.index)
    for c in columns:
        x, y = a[c].astype(float), b[c].astype(float)
        assert (x.isna() == y.isna()).all() and not ((x - y).abs() > 1e-6).any(), c


MIXED = ["device_sharing", "customer_history", "merchant_new_customers", "customer_merchant", "amount_30d", "merchant_acceleration"]


def test_families_of_several_keys_in_one_stream(spark, tmp_path):
    rows = _rows(60)
    _written(spark, f"{tmp_path}/in", [*rows, END])
    a = _ran(spark, tmp_path, MIXED, "")
    b = history.features(spark.createDataFrame(rows, SCHEMA), MIXED).toPandas().set_index("transaction_id").sort_index()
    _equal(a, b, [c for f in MIXED for c in history.FAMILIES[f].columns()])


@pytest.mark.parametrize("families", [["customer_history"], ["customer_history", "merchant_amount"]])
def test_late_rows_come_out_with_their_reason(spark, tmp_path, families):
    at = lambda h: dt.datetime(2027, 3, 1) + dt.timedelta(hours=h)
    row = lambda i, h: (str(i), "a", "d", "m", "x", "l", 5.0, at(h), 1)
    for rows in ([row(0, 0), row(1, 10)], [row(2, 20)], [row(3, 1), row(4, 30)], [row(5, 2), row(6, 1000)], [row(7, 3)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = _ran(spark, tmp_path, families, "", late="mark")
    late = got[got["late"].notna()]
    assert sorted(late.index) == ["3", "5", "7"] and late["customer_prior_count"].isna().all()
    assert late.loc["3", "late"] == f"{(20 - 1) * 3600 * 10**6} us behind the watermark"
    on_time = got[got["late"].isna()].sort_values("us")
    assert list(on_time.index) == ["0", "1", "2", "4"] and list(on_time["customer_prior_count"]) == [0, 1, 2, 3]


@pytest.mark.parametrize("families", [["customer_history", "amount_30d", "customer_new_merchants", "account_consistency"], MIXED])
def test_another_query_goes_on_from_a_snapshot(spark, tmp_path, families):
    from tidemark.streaming.history import snapshot

    rows = _rows(60, 8)
    cut = next(i for i in range(30, 60) if rows[i][7] > rows[i - 1][7])
    _written(spark, f"{tmp_path}/in1", rows[:cut])
    first = _ran(spark, tmp_path, families, "1")
    states = {}
    for lead, df in snapshot(spark, f"{tmp_path}/c1", families).items():
        df.write.parquet(f"{tmp_path}/state{lead}")
        states[lead] = spark.read.parquet(f"{tmp_path}/state{lead}")
        assert states[lead].filter("map = 'head'").count() <= 3
        assert states[lead].filter("map = 'log'").count() <= cut
    _written(spark, f"{tmp_path}/in2", [*rows[cut:], END])
    second = _ran(spark, tmp_path, families, "2", snapshots=states)
    assert len(first) + len(second) == 60  # rows that waited come out of the second
    import pandas as pd

    b = history.features(spark.createDataFrame(rows, SCHEMA), families).toPandas().set_index("transaction_id").sort_index()
    _equal(pd.concat([first, second]).sort_index(), b, [c for f in families for c in history.FAMILIES[f].columns()])


def _dense(n, per_day):
    r = random.Random(n)
    step = 86_400_000_000 // per_day
    return [{"us": 10**15 + i * step, "_x": float(r.randint(0, 9)), "_y": r.random() * 5, "_c": f"c{r.randrange(50)}", "_d": "d", "_m": f"m{r.randrange(20)}", "_l": "l", "_g": "g", "_part": 1, "_wday": 2, "_born": 3} for i in range(n)]


def test_work_of_a_row_does_not_grow_with_its_key():
    """Entries of the state that a row reads and writes, for a key with few and with very many rows a day; and the results."""
    from tidemark.functions.windows import DAY
    from tidemark.streaming.history import KeyState
    from tidemark.streaming.state import Held

    families, cost = ["merchant_new_customers", "merchant_history"], {}
    for per_day in (50, 100_000):
        held, rows, touched = Held(), _dense(4_000, per_day), []
        for i, r in enumerate(rows):
            before = held.touched
            state = KeyState(families, held)
            got = state.read(r)
            state.add([r])
            state.save()
            touched.append(held.touched - before)
            if i % 997 == 0:
                week, day = ([x for x in rows[:i] if x["us"] > r["us"] - w] for w in (7 * DAY, DAY))
                assert got["merchant_unique_customers_24h"] == len({x["_c"] for x in rows[:i] if x["us"] >= r["us"] - DAY})
                first = {}
                for x in rows[:i]:
                    first.setdefault(x["_c"], x["us"])
                assert got["merchant_new_customers_7d"] == sum(t > r["us"] - 7 * DAY for t in first.values())
                assert abs(got["merchant_new_customer_share_24h"] - (sum(t > r["us"] - DAY for t in first.values()) / len({x["_c"] for x in day}) if day else 0.0)) < 1e-12 and len(week) >= len(day)
        cost[per_day] = sum(touched[2_000:]) / 2_000
    assert cost[100_000] <= cost[50] * 1.05 and cost[50] < 60
    state = KeyState(families, held)
    state.log.passed(rows[-1]["us"] + 8 * DAY)
    state.save()
    assert not held.maps["log"] and not held.maps["inside"]


def test_deviation_of_equal_amounts_is_zero():
    from tidemark.streaming.state import deviation, mean_of, whole

    for x in (1e9, 0.1, 20.723265836946414):
        n, y = 999, whole(x)
        assert deviation(n, n * y, n * y * y) == 0.0 and mean_of(n * y, n) == x


@pytest.mark.parametrize("block", [7, 1_000])
def test_rows_that_come_together_share_the_reads_of_their_key(spark, monkeypatch, block):
    """Three batches whose times overlap: each row's features as row by row, with few timers and accesses of the state."""
    import pandas as pd

    from tidemark.streaming import history as streams
    from tidemark.streaming.state import Held

    monkeypatch.setattr(streams, "BLOCK", block)
    families, rows = ["customer_merchant", "customer_velocity", "customer_new_merchants"], _dense(3_000, 400)
    for r in rows:
        r["us"] -= r["us"] % 2_000_000_000  # ties, also of one millisecond
    names = [c for f in families for c in history.FAMILIES[f].columns()]
    held = Held()
    plain, want = streams.KeyState(families, Held()), {}
    for us in sorted({r["us"] for r in rows}):
        tie = [r for r in rows if r["us"] == us]
        want |= {(us, r["_c"], r["_m"]): [plain.read(r)[c] for c in names] for r in tie}
        plain.add(tie)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    timers, fired, got = set(), 0, []
    p = streams.HistoryProcessor(families, ["us", "of_c", "of_m"], names, False, False, True)
    p.held, p.batch, p.read, p.handle = held, None, {}, type("Handle", (), {"registerTimer": staticmethod(timers.add)})
    mixed = random.Random(1).sample(range(2_000), 2_000)
    for own, ms in ((mixed[:1_200], 0), (mixed[1_200:], rows[1_000]["us"] // 1000), (range(2_000, 3_000), rows[-1]["us"] // 1000 + 40 * 86_400_000)):
        list(p.handleInputRows(("k",), iter([pd.DataFrame([{c if c == "us" else "of" + c: rows[i][c] for c in rows[i]} for i in own])]), Now(0)))
        while due := sorted(t for t in timers if t <= ms):
            for out in p.handleExpiredTimer(("k",), Now(ms), Now(due[0])):
                got += out.values.tolist()
            timers.remove(due[0])
            fired += 1
    assert [r[0] for r in got] == sorted(r["us"] for r in rows) and not held.maps["waiting"]
    assert all(want[tuple(r[:3])] == r[3:] for r in got)
    if block == 1_000:
        assert fired < 20 and held.touched < 3 * len(rows)


class _Store:
    """A group's state in plain dictionaries, in pages as in the state store."""

    def __new__(cls):
        from tidemark.streaming.state import STORED, Held, Paged

        class Store(Held):
            def __init__(self):
                super().__init__()
                self.maps = {n: {} for n in STORED}

            def of(self, key):
                return Paged(self, key or "")

        return Store()


def _in_groups(families, lead, batches):
    """Rows through the operator of one group of keys: its output by key and time, and its state."""
    import pandas as pd

    from tidemark.streaming import history as streams

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    names, timers, got = [c for f in families for c in history.FAMILIES[f].columns()], set(), {}
    p = streams.HistoryProcessor(families, ["us", "of_c", "of_m"], names, False, False, True, lead)
    p.held, p.handle = _Store(), type("Handle", (), {"registerTimer": staticmethod(timers.add)})
    for own, ms in batches:
        list(p.handleInputRows(("g",), iter([pd.DataFrame([{c if c == "us" else "of" + c: r[c] for c in r} for r in own])] if own else []), Now(0)))
        for t in sorted(t for t in timers if t <= ms):
            for out in p.handleExpiredTimer(("g",), Now(ms), Now(t)):
                got |= {tuple(r[:3]): r[3:] for r in out.values.tolist()}
            timers.remove(t)
    return got, p.held


def _each_key(families, lead, rows):
    from tidemark.streaming.history import KeyState
    from tidemark.streaming.state import Held

    names, want, states = [c for f in families for c in history.FAMILIES[f].columns()], {}, {}
    for us in sorted({r["us"] for r in rows}):
        tie = [r for r in rows if r["us"] == us]
        for k in {r[lead] for r in tie}:
            state, own = states.setdefault(k, KeyState(families, Held())), [r for r in tie if r[lead] == k]
            want |= {(us, r["_c"], r["_m"]): [state.read(r)[c] for c in names] for r in own}
            state.add(own)
    return want


@pytest.mark.parametrize("rounds", [50, 100_000])
def test_keys_of_a_group_share_calls_and_keep_their_states(spark, monkeypatch, rounds):
    """What a key costs of the state store: its page read and written once a round; rows are as key by key, also in small rounds."""
    from tidemark.streaming import history as streams

    monkeypatch.setattr(streams, "ROUND", rounds)
    families, rows = ["customer_history", "customer_merchant", "customer_velocity", "account_consistency", "amount_30d", "customer_new_merchants"], _dense(1_500, 300)
    late = rows[-1]["us"] // 1000
    got, held = _in_groups(families, "_c", [(rows[:700][::-1], rows[500]["us"] // 1000), (rows[700:], late + 1)])
    assert got == _each_key(families, "_c", rows)
    assert len(held.maps["head"]) == len({r["_c"] for r in rows}) and not held.maps["waiting"]
    if rounds == 100_000:
        assert held.touched < 5 * len(held.maps["head"]) + 40


def test_a_silent_key_of_a_group_forgets_its_rows(spark):
    families, rows = ["customer_velocity"], _dense(400, 300)
    week = 7 * 86_400_000
    _, held = _in_groups(families, "_c", [(rows, rows[-1]["us"] // 1000 + 1)])
    assert any('"log"' in head[-1] for head in held.maps["head"].values()) and held.maps["leaving"]
    _, held = _in_groups(families, "_c", [(rows, rows[-1]["us"] // 1000 + 1), ([], rows[-1]["us"] // 1000 + 2 * week)])
    assert not any('"log"' in head[-1] for head in held.maps["head"].values()) and not held.maps["leaving"]


@pytest.mark.parametrize("lead", ["_d", "_m"])
def test_a_busy_key_of_a_group_has_pages(spark, monkeypatch, lead):
    from tidemark.streaming import history as streams
    from tidemark.streaming import state

    monkeypatch.setattr(state, "PAGE", 16)
    monkeypatch.setattr(streams, "ROUND", 300)
    families, rows = (["device_sharing", "device_merchant"] if lead == "_d" else ["merchant_new_customers", "merchant_history"]), _dense(2_000, 400)
    got, held = _in_groups(families, lead, [(rows[:900], rows[800]["us"] // 1000), (rows[900:], rows[-1]["us"] // 1000 + 1)])
    assert got == _each_key(families, lead, rows)
    assert len(held.maps["page"]) > 4 if lead == "_d" else held.maps["page"]
    assert max(len(p[0]) for p in held.maps["page"].values()) < 100 * 16 * 8


def test_entries_move_to_more_pages(monkeypatch):
    from tidemark.streaming import state

    store, want = _Store(), {}
    for n in (5, 300, 301, 9_000):
        one = store.of("k")
        for i in range(n):
            for entry, value in ((("partners", "_c", str(i)), (i, None)), (("log", i), (i, 0.5, None, "c", "m", ""))):
                one.put(entry[0], entry[1:], value)
                want[entry] = value
        one.put("partners", ("_c", "0"), None)
        want.pop(("partners", "_c", "0"), None)
        one.set_head((n, *state.START[1:]))
        one.flush()
        again = store.of("k")
        assert again.get_head()[0] == n and again.entries == len(want) and again.get("partners", "_c", "0") is None
        assert all(again.get(*e) == v for e, v in want.items())
    assert again.pages == 256 and len(store.maps["page"]) > 200


def test_waiting_rows_come_back():
    from tidemark.streaming.state import packed, unpacked

    rows = [{"us": 10**15 + i, "_x": None if i == 2 else i / 3, "_c": str(i), "n": None if i == 1 else i, "mixed": 1 if i else 0.5} for i in range(4)] + [{"us": 1, "prior": True}]
    assert unpacked(packed(rows)) == [{c: r.get(c) for c in [*rows[0], "prior"]} for r in rows]


def test_a_snapshot_of_other_groups_is_refused():
    """Keys would be looked for in groups that don't have them."""
    import pandas as pd

    from tidemark.streaming import history as streams

    p = streams.HistoryProcessor(["customer_history"], ["us"], [], False, False, True, "_c")
    p.held = _Store()
    entry = pd.DataFrame({"map": ["leaving"], "entry": ["[5]"], "content": ['["[]"]']})
    with pytest.raises(ValueError):
        p.handleInitialState(("3/7",), entry, None)
