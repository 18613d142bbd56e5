"""Mixing sources to target weights by Pfair scheduling.

The documents of each source form blocks of ``block_docs``. A source of weight w
should have had ``w * tau`` blocks, where tau is the time in which all sources
together have as many as there are slots so far; it stops at the source's last
block, and the others go on in the same proportions. Its j-th block is released
when that share passes j and due when it reaches j + 1; at each slot the released
block that is due first runs. Such a schedule keeps every block inside its
window, so a source is always less than one block away from its share of the
given weights, whatever these are and however many blocks there are: they aren't
rounded, and nothing drifts.

The slots are dealt into stretches. The driver finds, from the weights and the
numbers of blocks alone, how many blocks of each source the schedule has run at
the stretches' borders (``stretches``); the slots themselves are scheduled by the
executors, a stretch each, with built-in functions (``slots``). The driver holds one
stretch at a time and at most about ``BORDERS`` counts.

Numbering within a source uses groups of about ``GROUP_ROWS`` rows by a hash of
all columns and prefix sums over the groups' counts, so a source with a third of
all rows is spread like any other, and so are null or repeated ids whose rows
differ in some column. The slots of a group's blocks go to the group, so rows are
shuffled once. All rows are kept; each gets a distinct ``position`` (places that a
source's short last block leaves empty aren't used).

Null sources form a source of their own. Empty input gives an empty result.
Repeated rows count as rows; rows equal in all columns are interchangeable.
Columns of any name (but those of ``output``) and of any type come back unchanged.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import comparable, table

BLOCK_DOCS = 16
GROUP_ROWS = 4_000
STRETCH = 1024  # slots that one row of the schedule's table stands for, more where there are more than BORDERS counts
BORDERS = 1_000_000
STEPS = 128  # slots whose blocks are gathered in one array before it joins the others
MAX_SOURCES = 100_000  # whose counts are on the driver
UNWEIGHTED = 1e-3  # of the least given weight, for sources without one
OUTPUT = ("_block", "_slot", "_position")


def _phases(weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Between two sources' ends: the slot and tau where it begins, the blocks of sources that have ended, the weight of the others."""
    by_end = np.argsort(blocks / weights, kind="stable")
    left = np.cumsum(weights[by_end][::-1])[::-1]
    gone = np.concatenate([[0], np.cumsum(blocks[by_end])[:-1]]).astype(float)
    tau = np.concatenate([[0.0], (blocks / weights)[by_end][:-1]])
    at = np.maximum.accumulate(gone + tau * left)
    keep = np.append(at[1:] > at[:-1], True)
    return at[keep], tau[keep], gone[keep], left[keep]


def stretches(weights: dict[str, float], blocks: dict[str, int], length: int) -> Iterator[tuple]:
    """Rows of ``(first, size, own, phases)``: what each stretch of ``length`` slots needs to be scheduled by itself.

    ``own`` has the sources that run in it, in the order of their names, with the blocks run before it and after it.
    Blocks due before a border have been run at it; where they leave slots idle, those that are due later have run
    instead, so only these (one a source at most) are scheduled here.
    """
    names = sorted(weights)
    w, n = np.array([weights[s] for s in names], float), np.array([blocks[s] for s in names], np.int64)
    at, taus, gone, left = _phases(w, n)
    total, run = int(n.sum()), np.zeros(len(names), np.int64)

    def tau(t):
        p = np.maximum(np.searchsorted(at, t, "left") - 1, 0)
        return (t - gone[p]) / left[p]

    def slot_of(release):  # the first whose end comes after the release
        p = np.maximum(np.searchsorted(taus, release, "right") - 1, 0)
        t = np.floor(gone[p] + release * left[p])
        t = np.where(tau(t) > release, t - 1, t)
        return np.where(tau(t + 1) > release, t, t + 1).astype(np.int64)

    for first in range(0, total, length):
        size = min(length, total - first)
        end = first + size
        if end == total:
            after = n
        else:
            share = w * tau(np.float64(end))
            due = np.clip(np.floor(share - share * 1e-15 - 1e-12).astype(np.int64), run, n)
            counts = due - run
            own = np.repeat(np.arange(len(names)), counts)
            number = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts - run, counts)
            released = np.clip(slot_of(number / w[own]) - first, 0, size - 1)
            idle = np.maximum.accumulate(np.arange(1, size + 1) - np.cumsum(np.bincount(released, minlength=size)))
            idle = np.flatnonzero(np.diff(np.maximum(idle, 0), prepend=0) > 0)
            lacking = size - len(own)
            open_ = np.flatnonzero((due < n) & (due <= share))
            begins = slot_of(due[open_] / w[open_]) - first
            waiting = sorted(zip(begins.tolist(), (due[open_] / w[open_]).tolist(), ((due[open_] + 1) / w[open_]).tolist(), open_.tolist()))
            ready: list = []
            after, place = due.copy(), 0
            for slot in idle.tolist()[:lacking]:
                while place < len(waiting) and (waiting[place][0] <= slot or not ready):
                    heapq.heappush(ready, waiting[place][2:])
                    place += 1
                if ready:
                    after[heapq.heappop(ready)[1]] += 1
            short = end - int(after.sum())  # by rounding of numbers alone
            for s in ([s for _, s in sorted(ready)] + [s for *_, s in waiting[place:]])[:short]:
                after[s] += 1
        runs = np.flatnonzero(after > run)
        a, b = np.maximum(np.searchsorted(at, [first + 1, end], "left") - 1, 0)
        phases = list(zip(at[a : b + 1].tolist(), gone[a : b + 1].tolist(), left[a : b + 1].tolist()))
        yield first, size, list(zip([names[i] for i in runs], w[runs].tolist(), run[runs].tolist(), after[runs].tolist())), phases
        run = after


#: Of the released blocks in a slot the one due first, or else the one released next; ``s`` has the next block of each of ``own``.
PICK = """
transform(array(element_at(filter(phases, p -> p.at < first + u + 1), -1)), p ->
    array_min(transform(own, (o, i) -> if(s.next[i] < o.hi,
        if(s.next[i] / o.w < (first + u + 1 - p.gone) / p.left,
            named_struct('waits', 0, 'by', (s.next[i] + 1) / o.w, 'due', (s.next[i] + 1) / o.w, 'i', i),
            named_struct('waits', 1, 'by', s.next[i] / o.w, 'due', (s.next[i] + 1) / o.w, 'i', i)),
        null))))[0]
"""
#: The blocks that run in the slots ``u`` of a stretch, in arrays of STEPS.
RUN = """
aggregate(
    sequence(0, (size - 1) div {steps}),
    named_struct('next', transform(own, o -> o.lo), 'out', cast(array() as array<array<struct<i: int, block: bigint>>>)),
    (all, c) -> transform(array(aggregate(
        sequence(c * {steps}, least(c * {steps} + {steps}, size) - 1),
        named_struct('next', all.next, 'out', cast(array() as array<struct<i: int, block: bigint>>)),
        (s, u) -> transform(array({pick}), k -> named_struct(
            'next', transform(s.next, (n, i) -> if(i = k.i, n + 1, n)),
            'out', concat(s.out, array(named_struct('i', k.i, 'block', s.next[k.i])))))[0]
    )), r -> named_struct('next', r.next, 'out', concat(all.out, array(r.out))))[0],
    all -> flatten(all.out))
"""


def slots(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], length: int | None = None) -> DataFrame:
    """Rows of ``(key, block, slot)`` for every block of every source, scheduled by the executors a stretch of ``length`` slots each."""
    length = length or max(STRETCH, math.ceil(sum(blocks.values()) * len(blocks) / BORDERS))
    dealt = spark.createDataFrame(
        list(stretches(weights, blocks, length)),
        "first long, size int, own array<struct<key: string, w: double, lo: long, hi: long>>, phases array<struct<at: double, gone: double, left: double>>",
    )
    ran = dealt.select("first", "own", F.posexplode(F.expr(RUN.format(steps=STEPS, pick=PICK))).alias("u", "ran"))
    return ran.select(F.expr("own[ran.i].key").alias("key"), F.col("ran.block").alias("block"), (F.col("first") + F.col("u")).alias("slot"))


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, source: str = "source", output: tuple[str, str, str] = OUTPUT) -> DataFrame:
    """The rows of ``docs`` with block, slot and position, as ``output`` (in place of columns of these names).

    ``weights`` maps a source to its target weight; without it, the square root of its rows.
    """
    spark, tag = docs.sparkSession, uuid.uuid4().hex
    key, group, mixed, row, ahead, held = (f"{c}{tag}" for c in ("key", "group", "mixed", "row", "ahead", "held"))
    src = F.col(f"`{source}`")
    keyed = docs.withColumn(key, F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src.cast("string"))))
    docs = docs.drop(*output)
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = keyed.groupBy(key).count().limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r[key]: r["count"] for r in found}
    if not rows:
        return docs.select(*names, *[F.lit(0).cast("long").alias(c) for c in output])
    given = {("n" if s is None else f"s{s}"): w for s, w in (weights or {}).items()}
    if any(not (w > 0 and math.isfinite(w)) for w in given.values()):
        raise ValueError("weights must be finite and over 0")
    least = min([w for k, w in given.items() if k in rows] or [1.0]) * UNWEIGHTED
    weight = {k: (given.get(k, least) if weights else math.sqrt(n)) for k, n in rows.items()}
    run = slots(spark, weight, {k: -(-n // block_docs) for k, n in rows.items()})

    groups = max(1, math.ceil(sum(rows.values()) / GROUP_ROWS))
    keyed = keyed.withColumn(mixed, F.xxhash64(*comparable(docs))).withColumn(group, F.pmod(mixed, F.lit(groups)))
    sizes = keyed.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("key"), F.col(group).alias("group"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    blocks = sizes.select("key", "group", "ahead", F.expr(f"explode(sequence(ahead div {block_docs}, (ahead + n - 1) div {block_docs}))").alias("block"))
    # a group's slots, in the order of its blocks
    own = blocks.join(run, ["key", "block"]).groupBy("key", "group", "ahead").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("held"))
    own = own.select(F.col("key").alias(key), F.col("group").alias(group), F.col("ahead").alias(ahead), F.col("held").alias(held))

    ranked = keyed.withColumn(row, F.row_number().over(Window.partitionBy(key, group).orderBy(mixed)) - 1)
    rank = f"({ahead} + {row})"
    block = f"{rank} div {block_docs}"
    slot = f"{held}[cast({block} - {ahead} div {block_docs} as int)].slot"
    made = (block, slot, f"{slot} * {block_docs} + {rank} % {block_docs}")
    return ranked.join(own, [key, group]).select(*names, *[F.expr(e).alias(c) for e, c in zip(made, output)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the narrow columns tell rows with null ids apart
    docs = docs.select(*[c for c in docs.columns if c != "text"])
    return mix(docs).select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position")
    )
