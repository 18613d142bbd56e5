import collections
import heapq
import math
import random

import numpy as np
import pytest

from tidemark.llm import pfair

IRRATIONAL = {"a": math.sqrt(2), "b": math.sqrt(3), "c": math.sqrt(5), "d": 0.001}


def edf(weights, blocks):
    """The source and the number of the block that runs in each slot, slot by slot."""
    ends = sorted((blocks[s] / weights[s], s) for s in weights)
    active, gone, tau = math.fsum(weights.values()), 0, 0.0
    waiting = [(0.0, 1 / w, s, 0) for s, w in weights.items()]
    heapq.heapify(waiting)
    ready = []
    for _ in range(sum(blocks.values())):
        room = 1.0
        while gone < len(ends) - 1 and (ends[gone][0] - tau) * active <= room:
            room -= max(0.0, ends[gone][0] - tau) * active
            tau = max(tau, ends[gone][0])
            gone += 1
            active = math.fsum(weights[s] for _, s in ends[gone:])
        tau += room / active
        while waiting and (waiting[0][0] < tau or not ready):
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        yield s, j
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (due, (j + 2) / weights[s], s, j + 1))


def lags(order, weights, blocks):
    """How far each source is from its share at most: the slot is shared out by weight among those that lack something."""
    done, share, worst = collections.Counter(), dict.fromkeys(weights, 0.0), 0.0
    for s, j in order:
        assert j == done[s]
        done[s] += 1
        room = 1.0
        while room > 1e-12:
            own = [k for k in weights if share[k] < blocks[k] - 1e-9]
            if not own:
                break
            all_of = sum(weights[k] for k in own)
            step = min([room / all_of] + [(blocks[k] - share[k]) / weights[k] for k in own])
            for k in own:
                share[k] += step * weights[k]
            room -= step * all_of
        worst = max(worst, *(abs(done[k] - share[k]) for k in weights))
    assert done == blocks
    return worst


def scheduled(spark, weights, blocks, length=None):
    return [(r["key"], r["block"]) for r in pfair.slots(spark, weights, blocks, length).orderBy("slot").collect()]


def test_lag_over_a_million_slots(spark):
    """Every source is less than a block from its share of the given weights at every slot, also where some end."""
    blocks = {"a": 200_000, "b": 100_000, "c": 690_000, "d": 10_000}
    got = pfair.slots(spark, IRRATIONAL, blocks).toPandas().sort_values("slot")
    assert (got["slot"].to_numpy() == np.arange(1_000_000)).all()
    # the share by the slots' ends, from the times at which sources end
    ends = sorted((blocks[s] / w, s) for s, w in IRRATIONAL.items())
    taus = [0.0] + [e for e, _ in ends]
    slots = [math.fsum(min(blocks[s], w * e) for s, w in IRRATIONAL.items()) for e in taus]
    tau = np.interp(np.arange(1, 1_000_001), slots, taus)
    for s, w in IRRATIONAL.items():
        own = got["key"].to_numpy() == s
        assert (got["block"].to_numpy()[own] == np.arange(blocks[s])).all()
        lag = np.abs(np.cumsum(own) - np.minimum(w * tau, blocks[s])).max()
        assert lag < 1 + 1e-6, (s, lag)


def test_stretches_are_those_of_the_whole_schedule():
    """At each border as many blocks of each source have run as in the schedule made slot by slot, whatever the length."""
    r = random.Random(6)
    for _ in range(150):
        weights = {f"s{i:02}": r.random() ** 3 + 0.001 for i in range(r.randint(1, 12))}
        blocks = {s: r.randint(1, 90) for s in weights}
        want, ran = list(edf(weights, blocks)), collections.Counter()
        for first, size, own, _ in pfair.stretches(weights, blocks, r.choice([1, 2, 7, 50])):
            for s, w, lo, hi in own:
                assert ran[s] == lo < hi and w == weights[s]
                ran[s] = hi
            assert ran == collections.Counter(s for s, _ in want[: first + size])
        assert ran == blocks


@pytest.mark.parametrize("length", [1, 7, 200, None])
def test_slots_against_slot_by_slot(spark, length):
    r = random.Random(length or 0)
    for i in range(4):
        weights = {f"s{i}": r.random() + 0.01 for i in range(r.randint(1, 7))}
        blocks = {s: r.randint(1, 60) for s in weights}
        got = scheduled(spark, weights, blocks, length)
        assert got == list(edf(weights, blocks)) and lags(got, weights, blocks) < 1 + 1e-6
    for weights in ({f"t{i}": float(r.randint(1, 5)) for i in range(9)}, dict.fromkeys("abc", 1.0)):  # ties
        blocks = {s: r.randint(1, 60) for s in weights}
        assert lags(scheduled(spark, weights, blocks, length), weights, blocks) < 1 + 1e-6


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1}, {"a": math.sqrt(2), "b": 0.1, "c": math.pi, None: 1.0}])
def test_positions(docs_of, weights):
    r = random.Random(2)
    sources = [r.choice(["a", "a", "a", "b", "c", None]) for _ in range(400)]
    got = pfair.mix(docs_of(["t"] * 400, sources=sources), weights, block_docs=3).toPandas()
    assert got["_position"].is_unique and sorted(got["doc_id"]) == list(range(400))
    rows = collections.Counter("n" if s is None else f"s{s}" for s in sources)
    got["k"] = ["n" if s is None or s != s else f"s{s}" for s in got["source"]]
    given = {("n" if s is None else f"s{s}"): w for s, w in (weights or {}).items()}
    w = {k: (given.get(k, min(given.values()) * pfair.UNWEIGHTED) if weights else math.sqrt(n)) for k, n in rows.items()}
    want = list(edf(w, {k: -(-n // 3) for k, n in rows.items()}))
    order = got.sort_values("_position").drop_duplicates("_slot")
    assert list(zip(order["k"], order["_block"])) == want and order["_slot"].tolist() == list(range(len(want)))
    assert (got.sort_values("_position")["_slot"].diff().dropna() >= 0).all()


def test_sources_that_end_stay_near_their_share(docs_of):
    """Two sources of weights 1 and sqrt 2 and one that ends early, single documents as blocks, several stretches."""
    sources = ["a"] * 2000 + ["b"] * 2000 + ["c"] * 100
    weights = {"a": 1.0, "b": math.sqrt(2), "c": 0.5}
    got = pfair.mix(docs_of(["t"] * 4100, sources=sources), weights, block_docs=1).toPandas().sort_values("_position")
    assert got["_position"].tolist() == list(range(4100))
    assert lags(zip(got["source"], got["_block"]), weights, collections.Counter(sources)) < 1 + 1e-6


def test_many_sources_and_null_ids(docs_of):
    sources = [f"host{i % 700}" for i in range(1500)]
    docs = docs_of([f"t{i}" for i in range(1500)], sources=sources).selectExpr("if(doc_id % 3 = 0, null, doc_id % 5) as doc_id", "text", "source")
    got = pfair.mix(docs, block_docs=2).toPandas()
    assert got["_position"].is_unique and len(got) == 1500 and got.groupby("_slot")["source"].nunique().max() == 1
    assert got["_slot"].nunique() == got["_slot"].max() + 1
    with pytest.raises(ValueError, match="sources"):
        old, pfair.MAX_SOURCES = pfair.MAX_SOURCES, 9
        try:
            pfair.mix(docs)
        finally:
            pfair.MAX_SOURCES = old


def test_odd_input(docs_of):
    docs = docs_of(["t"] * 5, sources=[None] * 5)
    assert sorted(r["_position"] for r in pfair.mix(docs.union(docs)).collect()) == list(range(10))
    assert pfair.mix(docs.limit(0)).count() == 0
    assert pfair.mix(docs).columns[: len(docs.columns)] == docs.columns
    named = docs.selectExpr("*", "1 as _position", "'k' as _key", "2 as _rank", "3 as slot", "4 as _n")
    got = pfair.mix(named)
    assert sorted(r["_position"] for r in got.collect()) == list(range(5))
    assert [tuple(r) for r in got.select("_key", "_rank", "slot", "_n").distinct().collect()] == [("k", 2, 3, 4)]
    with pytest.raises(ValueError, match="weights"):
        pfair.mix(docs, {"a": 0.0})


def test_columns_of_any_name_and_type(docs_of):
    extra = "'own' as {0}"
    names = ["__key", "__block", "__mixed", "key", "group", "block", "slot", "n", "ahead", "held", "row", "own", "first", "u"]
    docs = docs_of(["t"] * 40, sources=["a", "b"] * 20)
    docs = docs.selectExpr("*", *[extra.format(c) for c in names], "map('k', doc_id) as m", "array(1, null) as arr", "struct(doc_id) as st", "cast('b' as binary) as bin")
    got = pfair.mix(docs, block_docs=3)
    assert got.columns[:-3] == docs.columns
    assert got.select(docs.columns).drop("m").exceptAll(docs.drop("m")).count() == 0
    rows = got.collect()
    assert all(r["m"] == {"k": r["doc_id"]} for r in rows) and len({r["_position"] for r in rows}) == 40


def test_no_python_in_the_plan(spark, data):
    plan = pfair.query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
