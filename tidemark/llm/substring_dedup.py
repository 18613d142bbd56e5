"""Substring dedup: repeated word windows by prefix-partitioned suffix trees.

A word is removed if a window of ``WINDOW`` consecutive words that covers it
has a word sequence that also starts anywhere else. Such windows hang below a
node of depth ``WINDOW`` in the suffix tree of all texts with two suffixes or
more, so only the top ``WINDOW`` words of suffixes matter, and suffixes whose
prefix is unique need not be looked at further.

1. Prefixes. Each window has an anchor, its least ``ANCHOR``-word n-gram by hash
   (the leftmost on ties), so equal windows have equal anchors at equal
   offsets. Anchors are counted over the corpus; a window whose anchor is
   nowhere else is a leaf and drops out.
2. Partitions. The rest is dealt by prefixes of variable length: the anchor, or,
   where an anchor is at more than ``HEAVY`` places, all words of the window, so
   that no partition outgrows a task's memory. An anchor serves about
   ``(WINDOW - ANCHOR) / 2`` windows in a row; they travel as one fragment of
   32-bit word symbols, which holds the suffixes of all of them.
3. Subtrees. A task takes whole prefixes up to ``BATCH`` windows and splits their
   suffixes by 2, 4, 8 ... words (each level names pairs of the level before),
   leaving out those that have become unique, down to ``WINDOW`` words. A name
   is a node of the subtree, and a deepest node with two suffixes or more is a
   repeat; repeats that start one after the other merge to maximal ones.

Windows repeated within one map task are known there (by a 64-bit hash): one of
them travels, so a sequence with any number of copies reaches a partition once
from each map task. The tree is built over 32-bit symbols, in which two words may
be alike; each window therefore brings a 64-bit hash of all its words, and a node
of depth ``WINDOW`` holds only windows that agree in it.

Null and empty texts have no words and keep none. Repeated rows count as rows:
their windows repeat. Rows are told apart by a 64-bit hash of id and text, so
null ids, ids of any type and different texts under one id are compared like
others. Rows of one hash that are more than ``EQUAL`` and a thousandth of all (a
thousand such hashes at most, which are broadcast) lose all their windows at once;
one row stands for them in the comparison with others. Rows repeated less often have
their places and stretches as sets. Other columns of the input may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _spark, _text

WINDOW = 35
ANCHOR = 8
HELD = 800_000  # windows that a map task compares with each other
HEAVY = 5_000  # places of an anchor from which its windows are dealt by all their words
BATCH = 300_000  # windows of a subtree batch, more only for one prefix
EQUAL = 1_000  # equal rows from which one stands for all
SHARE = 1_000  # and they are more than this part of all rows


def anchors(w: _text.Words, h: np.ndarray, window: int, anchor: int):
    """Of each window: its first word, its anchor's first word, the anchor's hash and the window's hash."""
    full, inside = w.grams(h, window)
    start = np.flatnonzero(inside)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram, _ = w.grams(h, anchor)
    span, have = window - anchor + 1, 1
    least, at = gram.copy(), np.arange(len(gram))
    while have < span:  # leftmost least of a doubling span
        step = min(have, span - have)
        later = least[step:] < least[:-step]
        least[:-step], at[:-step] = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return start, at[start], gram[at[start]], full[start]


def _words(col: pa.Array) -> tuple[_text.Words, np.ndarray]:
    w = _text.Words(*_text.utf8(col))
    return w, w.hashes()


def _base(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with text, as both joins read them so that they share one exchange; and the others."""
    own = lambda: docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    rows = own().filter("_text is not null").withColumn("_key", F.xxhash64("_doc", "_text"))
    return rows, own().filter("_text is null")


def _equal(rows: DataFrame) -> DataFrame | None:
    """``_key`` of rows that are repeated very often: ``SHARE`` keys at most."""
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EQUAL)
    total = rows.count()
    found = [r["_key"] for r in sizes.filter(F.col("n") > total // SHARE).collect()]
    return rows.sparkSession.createDataFrame([(k,) for k in found], "_key long") if found else None


def _compared(rows: DataFrame, equal: DataFrame | None) -> DataFrame:
    """The rows that are compared: all, but of those repeated very often one."""
    if equal is None:
        return rows
    hot = F.broadcast(equal)  # SHARE rows at most
    one = rows.join(hot, "_key", "left_semi").groupBy("_key").agg(F.first("_doc").alias("_doc"), F.first("_text").alias("_text"))
    return rows.join(hot, "_key", "left_anti").unionByName(one.select("_doc", "_text", "_key"))


def anchor_places(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """``prefix, places``: where each anchor is, one row for each map task's share of it."""

    def flush(held):
        prefix, doc_id, word = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(prefix, kind="stable")
        prefix = prefix[order]
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        at = np.flatnonzero(new)
        places = pa.StructArray.from_arrays([pa.array(doc_id[order]), pa.array(word[order].astype(np.int32))], ["_id", "word"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(prefix)).astype(np.int32)), places)
        yield pa.RecordBatch.from_arrays([pa.array(prefix[at].view(np.int64)), lists], ["prefix", "places"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                w, h = _words(part.column(1))
                _, at, prefix, _ = anchors(w, h, window, anchor)
                at, first = np.unique(at, return_index=True)
                if len(at):
                    doc = w.doc[at]
                    held.append((prefix[first], part.column(0).to_numpy(zero_copy_only=False)[doc], at - w.first[:-1][doc]))
                    n += len(at)
            if n >= HELD:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return rows.select(F.col("_key").alias("_id"), "_text").mapInArrow(run, "prefix long, places array<struct<_id: long, word: int>>")


def fragments(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows ``_id, word, key, known, symbols, labels``: windows from ``word`` on, of one anchor.

    ``labels`` has the hash of each window and ``known`` a bit for each window that is known to repeat. A row with a
    null ``key`` tells only of ``known`` windows in a row that repeat.
    """

    def flush(held, symbols):
        word, offset, prefix, label, doc_id, heavy, place = (np.concatenate(x) for x in zip(*held, strict=True))
        words = np.concatenate(symbols)
        path = _text.mix(label ^ _text.mix(prefix + offset.astype(np.uint64)))
        _, first, which, count = np.unique(path, return_index=True, return_inverse=True, return_counts=True)
        known = (count > 1)[which]
        sent = np.zeros(len(word), bool)
        sent[first] = True

        def runs(k, one_anchor):
            new = np.ones(len(k), bool)
            new[1:] = (np.diff(k) != 1) | (doc_id[k[1:]] != doc_id[k[:-1]]) | (word[k[1:]] != word[k[:-1]] + 1)
            if one_anchor:
                new[1:] |= (prefix[k[1:]] != prefix[k[:-1]]) | (offset[k[1:]] != offset[k[:-1]] - 1) | heavy[k[1:]]
            at = np.flatnonzero(new)
            return k[at], at, np.diff(np.append(at, len(k)))

        k = np.flatnonzero(sent)
        head, at, n = runs(k, True)
        bits = np.add.reduceat(known[k].astype(np.int64) << (np.arange(len(k)) - np.repeat(at, n)), at)
        size = n + window - 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(bounds[-1]) + np.repeat(place[head] - bounds[:-1], size)
        body = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(words[take].tobytes())])
        hashes = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((8 * np.append(at, len(k))).astype(np.int32).tobytes()), pa.py_buffer(label[k].tobytes())])
        key = np.where(heavy[head], path[head], prefix[head]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc_id[head]), pa.array(word[head].astype(np.int32)), pa.array(key), pa.array(bits), body, hashes], _FRAGMENT)
        k = np.flatnonzero(known)
        if len(k):
            head, _, n = runs(k, False)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id[head]), pa.array(word[head].astype(np.int32)), pa.nulls(len(head), pa.int64()), pa.array(n), *[pa.nulls(len(head), pa.binary())] * 2], _FRAGMENT)

    def run(batches):
        held, symbols, n, total = [], [], 0, 0
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                w, h = _words(part.column(1))
                start, at, prefix, label = anchors(w, h, window, anchor)
                marks = part.column(2)
                inner = marks.flatten()
                owner = np.repeat(np.arange(part.num_rows), marks.value_lengths().fill_null(0).to_numpy())
                place = inner.field(0).to_numpy()
                own = place < w.count[owner]  # not so only where two rows' keys collide
                mark = np.zeros(len(h) + 1, np.int8)
                mark[(w.first[:-1][owner] + place)[own]] = 1 + inner.field(1).to_numpy(zero_copy_only=False).astype(np.int8)[own]
                keep = mark[at] > 0
                start, at, prefix, label = start[keep], at[keep], prefix[keep], label[keep]
                if len(start):
                    doc = w.doc[start]
                    held.append((start - w.first[:-1][doc], at - start, prefix, label, part.column(0).to_numpy()[doc], mark[at] == 2, start + total))
                    symbols.append((h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                    n += len(start)
                    total += len(h)
            if n >= HELD or total >= 4 * HELD:
                if held:
                    yield from flush(held, symbols)
                held, symbols, n, total = [], [], 0, 0
        if held:
            yield from flush(held, symbols)

    return marked.mapInArrow(run, "_id long, word int, key long, known long, symbols binary, labels binary")


_FRAGMENT = ["_id", "word", "key", "known", "symbols", "labels"]


def deepest(symbols: np.ndarray, left: np.ndarray, window: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Which of the suffixes share their first ``window`` words, and their label, with another.

    ``left`` has the number of words from each place to its fragment's end. Names
    of 2, 4, 8 ... words are made from pairs of names; a suffix whose name is
    alone is a leaf, and so is one whose second half is.
    """
    name, depth = symbols.astype(np.uint64), 1
    shared = np.ones(len(symbols), bool)
    while depth < window:
        step = min(depth, window - depth)
        at = np.flatnonzero(shared & (left >= depth + step))
        at = at[shared[at + step]]
        pair = name[at] << np.uint64(32) | name[at + step]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        shared = np.zeros(len(symbols), bool)
        shared[at] = (count > 1)[which]
        name = np.zeros(len(symbols), np.uint64)
        name[at] = which
        depth += step
    shared &= left >= window
    if labels is not None and shared.any():
        at = np.flatnonzero(shared)
        order = np.lexsort((labels[at], name[at]))
        x, y = name[at[order]], labels[at[order]]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        shared[at[order]] = np.append(same, False) | np.append(False, same)
    return shared


def _flat(rows: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows' binary values, one after the other, and how many each row has."""
    body = rows.column(column).combine_chunks()
    if isinstance(body, pa.ChunkedArray):
        body = body.chunk(0)
    bounds = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    return np.frombuffer(body.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(kind), np.diff(bounds) // np.dtype(kind).itemsize


def _tree(rows: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of the windows that repeat and weren't known to."""
    n = rows.num_rows
    symbols, size = _flat(rows, "symbols", "<u4")
    hashes, _ = _flat(rows, "labels", "<u8")
    row = np.repeat(np.arange(n), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    left = size[row] - step
    labels = np.zeros(len(row), np.uint64)
    labels[left >= window] = hashes  # one for each window
    hit = np.flatnonzero(deepest(symbols, left, window, labels))
    row, step = row[hit], step[hit]
    new = rows.column("known").to_numpy()[row] >> step & 1 == 0
    row, step = row[new], step[new]
    return rows.column("_id").to_numpy()[row], rows.column("word").to_numpy()[row] + step


def _islands(doc: np.ndarray, word: np.ndarray, window: int) -> pa.RecordBatch:
    """Stretches of words covered by windows that start one after the other."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(word[new].astype(np.int64)), pa.array((word[last] + window if len(doc) else word).astype(np.int64))], ["_id", "first", "last"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``_id, first, last``: stretches of words covered by repeated windows; they may touch or overlap."""
    if not 0 <= window - anchor < 62 or anchor < 1:
        raise ValueError("the anchor must be shorter than the window, by 61 words at most")
    _spark.small_batches(docs.sparkSession)
    rows, _ = _base(docs, doc_id, text)
    return _repeats(_compared(rows, _equal(rows)), window, anchor)


def _repeats(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    # made twice: hashing the texts again costs less than a table of all anchors
    places = anchor_places(rows, window, anchor)
    counts = places.groupBy("prefix").agg(F.sum(F.size("places").cast("long")).alias("n")).filter("n > 1")
    shared = places.join(counts, "prefix").select(F.explode("places").alias("p"), (F.col("n") > HEAVY).alias("heavy"))
    marks = shared.groupBy(F.col("p._id").alias("_id")).agg(F.collect_set(F.struct(F.col("p.word").alias("word"), "heavy")).alias("_marks"))
    marked = rows.join(marks, F.col("_key") == F.col("_id")).select("_id", "_text", "_marks", "_doc")  # the id only so that the texts' exchange is the same as in ``remove``
    made = fragments(marked, window, anchor)
    # what is known already only has to find its document
    dealt = made.withColumn("_deal", F.coalesce("key", F.xxhash64("_id", "word"))).repartition("_deal").sortWithinPartitions("key").drop("_deal")

    def grow(batches):
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            told = np.asarray(batch.column(2).is_null())
            if told.any():
                gone = batch.filter(pa.array(told))
                first = gone.column(1).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([gone.column(0), pa.array(first), pa.array(first + gone.column(3).to_numpy() - 1 + window)], ["_id", "first", "last"])
                batch = batch.filter(pa.array(~told))
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.column(4).nbytes // 4
            if size >= 3 * BATCH:
                rows = pa.Table.from_batches(kept)
                key = rows.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last prefix may go on
                if cut:
                    yield _islands(*_tree(rows.slice(0, cut), window), window)
                    kept = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(b.column(4).nbytes for b in kept) // 4
        if kept:
            yield _islands(*_tree(pa.Table.from_batches(kept), window), window)

    return dealt.mapInArrow(grow, "_id long, first long, last long")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: ``kept`` has the words left, joined by one space."""
    if not 0 <= window - anchor < 62 or anchor < 1:
        raise ValueError("the anchor must be shorter than the window, by 61 words at most")
    _spark.small_batches(docs.sparkSession)
    everything, others = _base(docs, doc_id, text)
    equal = _equal(everything)
    rows = _compared(everything, equal)
    found = _repeats(rows, window, anchor)
    spans = found.groupBy("_id").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    if equal is not None:  # the one that stands for them has no row of its own in the result
        rows = everything.join(F.broadcast(equal), "_key", "left_anti")
    joined = rows.join(spans, F.col("_key") == F.col("_id"), "left").select("_doc", "_text", "_spans")
    joined = joined.unionByName(others.withColumn("_spans", F.lit(None).cast("array<struct<first: long, last: long>>")))
    if equal is not None:
        hot = everything.join(F.broadcast(equal), "_key", "left_semi").select("_doc", "_text")
        joined = joined.unionByName(hot.withColumn("_spans", F.expr("array(named_struct('first', 0L, 'last', -1L))")))

    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            spans = batch.column(2)
            first, last = (spans.flatten().field(k).to_numpy() for k in (0, 1))
            bounds = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())])
            data, offs = _text.utf8(batch.column(1))
            raw = data.tobytes()
            for i in range(batch.num_rows):
                words = raw[offs[i] : offs[i + 1]].split()
                a, b = bounds[i], bounds[i + 1]
                gone = 0
                if b > a and last[a] < 0:  # all windows, where there is one
                    gone = len(words) if len(words) >= window else 0
                    kept = words if not gone else []
                elif b > a:
                    level = np.zeros(len(words) + 1, np.int64)
                    np.add.at(level, np.minimum(first[a:b], len(words)), 1)
                    np.add.at(level, np.minimum(last[a:b], len(words)), -1)
                    keep = np.cumsum(level)[:-1] == 0
                    gone = len(words) - int(keep.sum())
                    kept = list(compress(words, keep.tolist()))
                else:
                    kept = words
                out["n_words"].append(len(words))
                out["n_removed"].append(gone)
                out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
            out["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(out)

    schema = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
