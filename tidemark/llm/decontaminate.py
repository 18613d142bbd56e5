"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items and documents are lower-case words of letters and digits. Seeds are the
item's word n-grams that are in few documents of the corpus (``RARE`` of them at
most, as a share or ``FEW``); an item is also cut into stretches of ``STRETCH``
n-grams, and those of a stretch that are not much more frequent than its rarest
(``NEAR`` times) are seeds too, so an item has seeds all along, however common
its text is, and an edit that spares an n-gram leaves a seed. A document with a seed is
aligned with the item around it (local alignment of words: ``MATCH``,
``-MISMATCH``, ``-GAP``); its score is the alignment's share of what the whole
item would score. Pairs of at least ``THRESHOLD`` are returned.

The seed counts cover all documents. All else about a document happens in one
task, so the only shuffle is that of the counts. Items travel as a broadcast,
in groups of at most ``MAX_ITEM_WORDS`` words; more items take more passes.

An item of fewer than ``MIN_WORDS`` words is looked for as a whole phrase (score
1), if it is in no more documents than a seed may be; one in more documents is
ordinary prose.

Null and empty texts match nothing. Repeated documents give repeated pairs,
repeated items one; an empty table gives an empty result. Item ids may be null
or of any type. Other columns of the input may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import _features, _spark, _text

GRAM = 3
STRETCH = 4
RARE, FEW, NEAR = 1e-4, 100, 4
MIN_WORDS = 6
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, 1, 1
MAX_ITEM_WORDS = 1_000_000  # with their n-grams and counts about 50 MB
MAX_SEEDS = 1_000_000  # pairs of a document's and an item's n-gram looked at at once
CELLS = 2_000_000


def words(texts: pa.Array) -> tuple[_text.Words, np.ndarray]:
    w = _text.Words(*_text.utf8(_features.lowered(texts)), letters_only=True)
    return w, w.hashes()


class Items:
    """Words of the items, one after the other, and their n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        w, h = words(pa.array([t or "" for _, t in rows], pa.string()))
        grams, inside = w.grams(h, GRAM)
        self.ids = [i for i, _ in rows]
        self.hashes, self.first, self.size = h, w.first, w.count
        at = np.flatnonzero(inside & (w.count[w.doc] >= MIN_WORDS)) if len(h) else np.zeros(0, np.int64)
        self.gram, self.item, self.place = grams[at], w.doc[at], at - w.first[:-1][w.doc[at]]
        self.short = {}  # by number of words: sorted phrases and their items
        for n in range(1, MIN_WORDS):
            own = np.flatnonzero(w.count == n)
            if len(own):
                phrase = w.grams(h, n)[0][w.first[:-1][own]]
                order = np.argsort(phrase, kind="stable")
                self.short[n] = (phrase[order], own[order])

    def select(self, keep: np.ndarray) -> None:
        order = np.argsort(self.gram[keep], kind="stable")
        self.gram, self.item, self.place = (x[keep][order] for x in (self.gram, self.item, self.place))


def _groups(benchmark: DataFrame, item_id: str, text: str):
    """Items in groups that fit a broadcast; rows come to the driver one partition at a time."""
    group, size = [], 0
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).filter("t is not null").distinct()
    for r in items.orderBy("i", "t").toLocalIterator():
        n = len(r["t"]) // 2 + 1  # no text has more words
        if group and size + n > MAX_ITEM_WORDS:
            yield Items(group)
            group, size = [], 0
        group.append((r["i"], r["t"]))
        size += n
    if group:
        yield Items(group)


def _hits(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


def counts(docs: DataFrame, grams: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], int]:
    """In how many documents each of the n-grams (sorted, by their words) is, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        total, n = {k: np.zeros(len(g), np.int64) for k, g in shared.value.items()}, 0
        for batch in batches:
            n += batch.num_rows
            for part in _text.slices(batch, "_text"):
                w, h = words(part.column(1))
                for k, known in shared.value.items():
                    g, inside = w.grams(h, k)
                    at = np.flatnonzero(inside & _hits(g, known)) if len(g) else []
                    if len(at):
                        pairs = np.unique(w.doc[at] * len(known) + np.searchsorted(known, g[at]))
                        total[k] += np.bincount(pairs % len(known), minlength=len(known))
        for k, sums in total.items():
            there = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), k)), pa.array(there), pa.array(sums[there])], ["k", "g", "n"])
        yield pa.RecordBatch.from_pydict({"k": [-1], "g": [0], "n": [n]})

    rows = docs.select("_id", "_text").mapInArrow(run, "k long, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(len(g), np.int64) for k, g in grams.items()}  # one row at most for each n-gram of the items
    for k, own in rows.groupby("k"):
        if k >= 0:
            out[k][own["g"].to_numpy()] = own["n"].to_numpy()
    return out, int(rows["n"][rows["k"] == -1].sum())


def seeds(items: Items, docs: DataFrame) -> None:
    """Keeps the rare n-grams and short items; those that no document has are of no use."""
    own = {k: [p] for k, (p, _) in items.short.items()}
    if len(items.gram):
        own.setdefault(GRAM, []).append(items.gram)
    names = {k: np.unique(np.concatenate(p)) for k, p in own.items()}
    found, n_docs = counts(docs, names)
    rarest = max(FEW, RARE * n_docs)
    for k, (phrase, item) in items.short.items():
        n = found[k][np.searchsorted(names[k], phrase)]
        keep = (n > 0) & (n <= rarest)
        items.short[k] = (phrase[keep], item[keep])
    if not len(items.gram):
        return
    n = found[GRAM][np.searchsorted(names[GRAM], items.gram)]
    _, stretch = np.unique(np.column_stack([items.item, items.place // STRETCH]), axis=0, return_inverse=True)
    least = np.full(stretch.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, stretch, np.where(n > 0, n, least[0]))
    rare = np.maximum(rarest, NEAR * least[stretch].clip(max=1 << 50))
    items.select(np.flatnonzero((n > 0) & (n <= rare)))


def align(queries: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the passage word where it ends."""
    n = len(queries)
    score, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda k: (len(passages[k]), len(queries[k])))
    at = 0
    while at < n:
        to = at + 1
        while to < n and (to - at + 1) * len(passages[order[to]]) <= CELLS // 8 and to - at < 4096:
            to += 1
        own = order[at:to]
        rows, cols = max(len(queries[k]) for k in own), max(len(passages[k]) for k in own)
        q, p = np.zeros((len(own), rows), np.uint64), np.ones((len(own), cols), np.uint64)  # padding never matches
        for i, k in enumerate(own):
            q[i, : len(queries[k])], p[i, : len(passages[k])] = queries[k] | np.uint64(2), passages[k] | np.uint64(2)
        steps = GAP * np.arange(cols, dtype=np.int32)
        above = np.zeros((len(own), cols + 1), np.int32)
        best, end = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64)
        for i in range(rows):
            here = above[:, :-1] + np.where(q[:, i : i + 1] == p, MATCH, -MISMATCH).astype(np.int32)
            np.maximum(here, above[:, 1:] - GAP, out=here)
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + steps, axis=1) - steps  # gaps along the passage
            top = here.max(axis=1)
            better = top > best
            end[better] = here[better].argmax(axis=1)
            best = np.maximum(best, top)
            above[:, 1:] = here
        score[own], ends[own] = best, end
        at = to
    return score, ends


def _pairs(items: Items, w: _text.Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document row, item row, score and last word of the pairs over the threshold."""
    short = _phrases(items, w, h)
    g, inside = w.grams(h, GRAM)
    if not len(g) or not len(items.gram):
        return short
    hits = np.flatnonzero(inside & _hits(g, items.gram))
    lo, hi = np.searchsorted(items.gram, g[hits], "left"), np.searchsorted(items.gram, g[hits], "right")
    spots, cuts = [], np.searchsorted(np.cumsum(hi - lo), np.arange(0, int((hi - lo).sum()) + MAX_SEEDS, MAX_SEEDS), "left")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        many = hi[a:b] - lo[a:b]
        seed = np.arange(many.sum()) + np.repeat(lo[a:b] - (np.cumsum(many) - many), many)
        at = np.repeat(hits[a:b], many)
        doc, item = w.doc[at], items.item[seed]
        begin = at - w.first[doc] - items.place[seed]  # where the item would start in the document
        spots.append(np.unique(np.column_stack([doc, item, begin // (items.size[item] // 2 + 4)]), axis=0))
    if not len(hits):
        return short
    spot = np.unique(np.concatenate(spots), axis=0)
    doc, item = spot[:, 0], spot[:, 1]
    pad = items.size[item] // 2 + 4
    low = w.first[doc] + np.maximum(spot[:, 2] * pad - pad, 0)
    high = np.minimum(w.first[doc] + (spot[:, 2] + 1) * pad + items.size[item] + pad, w.first[doc + 1])
    queries = [items.hashes[items.first[i] : items.first[i + 1]] for i in item]
    score, end = align(queries, [h[a:b] for a, b in zip(low, high, strict=True)])
    share, last = score / (MATCH * items.size[item]), low + end - w.first[doc]
    order = np.lexsort((last, -share, item, doc))
    doc, item, share, last = doc[order], item[order], share[order], last[order]
    top = np.ones(len(doc), bool)
    top[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    top &= share >= THRESHOLD
    return tuple(np.concatenate([x, y]) for x, y in zip((doc[top], item[top], share[top], last[top]), short, strict=True))


def _phrases(items: Items, w: _text.Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of the short items: the first place of each in each document."""
    out = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))]
    for n, (phrase, item) in items.short.items():
        g, inside = w.grams(h, n)
        if not len(g) or not len(phrase):
            continue
        at = np.flatnonzero(inside & _hits(g, phrase))
        _, first = np.unique(np.rec.fromarrays([w.doc[at], g[at]], names="d,g"), return_index=True)
        at = at[first]
        lo, hi = np.searchsorted(phrase, g[at], "left"), np.searchsorted(phrase, g[at], "right")
        own = item[np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]
        at = np.repeat(at, hi - lo)
        out.append((w.doc[at], own, np.ones(len(at)), at + n - 1 - w.first[w.doc[at]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, score, last_word`` of each document with an item's text."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    key = F.col(f"`{doc_id}`")
    rows = docs.select(key.alias("_id"), F.col(f"`{text}`").alias("_text")).filter("_text is not null")
    own = benchmark.select(F.col(f"`{item_id}`").alias("item_id")).schema["item_id"]
    schema = docs.select(key.alias("doc_id")).schema.add("item_id", own.dataType).add("score", "double").add("last_word", "long")
    out = spark.createDataFrame([], schema)
    for items in _groups(benchmark, item_id, item_text):
        seeds(items, rows)
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for part in _text.slices(batch, "_text"):
                    doc, item, score, last = _pairs(items, *words(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array([items.ids[k] for k in item], to_arrow_type(own.dataType)), pa.array(score), pa.array(last.astype(np.int64))], schema.names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"), _spark.table(spark, sf_dir, "benchmark"))
