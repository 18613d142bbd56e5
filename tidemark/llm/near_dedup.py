"""Near duplicates by order MinHash, verified by banded alignment.

A document is the sequence of its ``SHINGLE``-word shingles (lower-case words of
letters and digits), each labelled by its occurrence in the document. Each of
``TABLES`` sketches takes the ``MINIMA`` least shingles under one permutation and
keeps their order in the text; documents with an equal sketch are candidates.
Two documents of similarity 0.8 share one with probability 1 - 0.36 ** 12.

* Texts with equal shingles form a class first, and equal texts without any (one
  aggregation on a digest); one of them stands for all from then on.
* In a bucket every member is linked with the most similar member and with the
  most central one among those like it, by 64-bin signatures that travel along:
  the links of a bucket grow with its members, not with their pairs. A family
  of edited copies hangs on its source that way. A bucket of more than ``BUCKET``
  members is split by a hash of the member, and its ``CENTRES`` most central
  members are shown to all parts.
* What these links leave apart is then compared in full, so the choice of links
  decides the work and not the classes. In each bucket of several classes, rows
  with a partner of another class that may be similar by signature and length are
  found first; they alone travel with their shingles, and the task counts the
  common shingles of every such pair and aligns those that share enough. Only
  links leave the task, one fewer than the classes it joins at most.
* In that comparison the rows of a bucket's largest class are dealt once to each
  part of the others and never meet each other, so a bucket filled by one class
  costs in proportion to its rows.
* A link holds if the shingle sequences align: with L shingles in common, in
  order, ``L / (n + m - L) >= SIMILARITY``. The alignment is banded by what this
  allows at most, so the band loses nothing.
* Classes are the connected components of the links, found without collecting.

Null texts count as empty; texts with no word are equal to each other. Texts of
fewer than ``SHINGLE`` words are duplicates only of equal texts. Rows are told
apart by id and text, so a null id, an id of any type and different texts under
one id are compared like others; a class is named by its least id that isn't
null (null if it has none). An empty table gives an empty result. Other columns
of the input may have any name.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark.llm import _features, _spark, _text
from tidemark.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 12
MINIMA = 2
BINS = 64
LIKELY = 0.55  # estimated similarity from which a link is verified: five deviations below 0.8
BUCKET = 2048
CENTRES = 16  # members of a split bucket that all its parts see
SHINGLES = 4_000_000  # of a part in the full comparison
BATCH_ROWS = 20_000
LONG = 4000  # shingles from which alignment goes by blocks
NARROW = 512  # band that is tried first

_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**63, TABLES + 1, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, TABLES + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document row and hash of each shingle, in text order."""
    w = _text.Words(*_text.utf8(_features.lowered(texts)), letters_only=True)
    g, inside = w.grams(w.hashes(), SHINGLE)
    return w.doc[inside], g[inside]


def _labelled(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with the number of their occurrence."""
    both = _text.mix(gram ^ _text.mix(doc.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    new = np.ones(len(both), bool)
    new[1:] = both[order[1:]] != both[order[:-1]]
    at = np.flatnonzero(new)
    nth = np.zeros(len(both), np.uint64)
    nth[order] = (np.arange(len(both)) - np.repeat(at, np.diff(np.append(at, len(both))))).astype(np.uint64)
    return _text.mix(gram + nth * np.uint64(0x9E3779B97F4A7C15))


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, sketch keys (``TABLES`` each) and signature (``BINS`` bytes, 0: empty) of each text."""
    n = len(texts)
    doc, gram = shingles(texts)
    count = np.bincount(doc, minlength=n)
    keys, sig = np.zeros((n, TABLES), np.uint64), np.zeros((n, BINS), np.uint8)
    full = np.flatnonzero(count)
    if not len(full):
        return count, keys, sig
    x = _labelled(doc, gram)
    start = np.concatenate([[0], np.cumsum(count[full])[:-1]])
    own = np.repeat(np.arange(len(full)), count[full])
    for t in range(TABLES):
        v = (x ^ _XOR[t]) * _ODD[t]
        v ^= v >> np.uint64(32)
        picked = []
        for _ in range(MINIMA):
            least = np.minimum.reduceat(v, start)
            at = np.flatnonzero(v == least[own])
            first = np.ones(len(at), bool)
            first[1:] = own[at[1:]] != own[at[:-1]]
            picked.append(at[first])
            v[at[first]] = _TOP
        key = np.full(len(full), t, np.uint64)
        for place in np.sort(np.column_stack(picked), axis=1).T:  # in text order
            key = _text.mix(key * np.uint64(31) + x[place])
        keys[full, t] = key
    v = _text.mix(x ^ _XOR[TABLES])
    best = np.full(n * BINS, _TOP)
    np.minimum.at(best, doc * BINS + (v >> np.uint64(58)).astype(np.int64), v)
    sig = (np.where(best == _TOP, 0, 1 + _text.mix(best) % np.uint64(255))).astype(np.uint8).reshape(n, BINS)
    return count, keys, sig


def _name(doc_id: str, text: str) -> Column:
    """Tells rows of different ids or texts apart, null ids too."""
    return F.concat_ws(":", F.hex(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))), F.col(f"`{doc_id}`").cast("string"))


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _name, _text``, empty for null."""
    return docs.select(F.col(f"`{doc_id}`").alias("_id"), _name(doc_id, text).alias("_name"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))


def sketch_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _name, digest, n, keys, sig`` of every row."""
    rows = named(docs, doc_id, text)

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                texts = part.column(2)
                data, offs = _text.utf8(texts)
                raw = data.tobytes()
                n, keys, sig = sketches(texts)
                grams = shingles(texts)[1].tobytes()
                ends = (8 * np.cumsum(n)).tolist()
                own = [b"s" + grams[e - 8 * k : e] if k else raw[a:b].strip() and b"t" + raw[a:b] for k, e, a, b in zip(n.tolist(), ends, offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in own]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TABLES), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(n.astype(np.int32)), flat, pa.array([s.tobytes() for s in sig], pa.binary())], ["_id", "_name", "digest", "n", "keys", "sig"])

    schema = rows.drop("_text").schema.add("digest", "binary").add("n", "integer").add("keys", ArrayType(LongType())).add("sig", "binary")
    return rows.mapInArrow(run, schema)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity as two signatures tell it (rows against rows)."""
    same = ((a == b) & (a > 0)).sum(axis=-1)
    some = ((a > 0) | (b > 0)).sum(axis=-1)
    return same / np.maximum(some, 1)


def _alike(n: np.ndarray, sig: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of all rows with all others, 0 where it can't be enough."""
    out = np.zeros((len(n), len(m)), np.float32)
    some = (sig > 0).astype(np.float32), (other > 0).astype(np.float32)
    for at in range(0, len(n), 64):
        to = min(at + 64, len(n))
        same = ((sig[at:to, None] == other[None]) & (sig[at:to, None] > 0)).sum(axis=2)
        either = some[0][at:to].sum(axis=1)[:, None] + some[1].sum(axis=1)[None] - some[0][at:to] @ some[1].T
        near = same / np.maximum(either, 1)
        fits = np.minimum(n[at:to, None], m[None]) >= SIMILARITY * np.maximum(n[at:to, None], m[None])
        out[at:to] = np.where(fits & (near >= LIKELY), near, 0)
    return out


def bucket_links(rep: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Links of a bucket's members (places), its most central member, and how near the others are to it."""
    near = _alike(n, sig, n, sig)
    np.fill_diagonal(near, 0)
    central = near.sum(axis=1)
    some = np.flatnonzero(central > 0)
    like = near[some]
    best = like.argmax(axis=1)
    # ties by rank, so that different buckets agree
    hub = np.where(like > 0, central[None] + 1, 0).argmax(axis=1)
    return np.concatenate([some, some]), np.concatenate([best, hub]), int(central.argmax()), float(central.max())


def _bucket_rows(reps: DataFrame) -> DataFrame:
    return reps.filter("n > 0").select("rep", "n", "sig", F.explode("keys").alias("key"))


def _grouped(batches, names, work, rows_at_once: int = BATCH_ROWS, bytes_at_once: int = 64 << 20):
    """Calls ``work(table, bounds)`` with whole groups of rows equal in ``names``; rows come sorted by them."""
    kept, rows, size = [], 0, 0

    def cut(table):
        cols = [table.column(c).to_numpy() for c in names]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= rows_at_once or size >= bytes_at_once:
            table = pa.Table.from_batches(kept)
            at = cut(table)
            if len(at) > 1:
                yield from work(table.slice(0, int(at[-1])), at)
                kept = table.slice(int(at[-1])).combine_chunks().to_batches()
                rows, size = sum(b.num_rows for b in kept), sum(b.nbytes for b in kept)
    if kept:
        table = pa.Table.from_batches(kept)
        yield from work(table, np.append(cut(table), table.num_rows))


def _signatures(col, bins: int = BINS) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, bins)


def candidates(reps: DataFrame, wide: DataFrame) -> DataFrame:
    """Distinct links ``a < b`` to verify; ``wide`` has the keys of more than two members."""
    rows = _bucket_rows(reps)
    big = wide.filter(F.col("size") > BUCKET)
    n_big = big.count()
    parted = rows.withColumn("salt", F.lit(0))
    if n_big:
        salts = big.select("key", F.ceil(F.col("size") / BUCKET).cast("int").alias("parts"))
        # one row for each BUCKET rows at most; sent to all only while that is few
        split = rows.join(F.broadcast(salts) if n_big <= 10_000 else salts, "key", "left")
        parted = split.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rep", "key"), "parts"), F.lit(0)).cast("int")).drop("parts")

    def link(batches):
        def work(table, bounds):
            rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
            size = np.diff(bounds)
            sig = _signatures(table.column("sig"))
            out = []
            two = bounds[:-1][size == 2]
            if len(two):
                ok = (likeness(sig[two], sig[two + 1]) >= LIKELY) & (np.minimum(n[two], n[two + 1]) >= SIMILARITY * np.maximum(n[two], n[two + 1]))
                out.append((rep[two[ok]], rep[two[ok] + 1]))
            for k in np.flatnonzero(size > 2):
                own = slice(bounds[k], bounds[k + 1])
                order = np.argsort(rep[own])
                a, b, _, _ = bucket_links(rep[own][order], n[own][order], sig[own][order])
                out.append((rep[own][order][a], rep[own][order][b]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        yield from _grouped(batches, ("key", "salt"), work)

    found = parted.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(link, "a long, b long")
    if n_big:  # the rows of split buckets are few and are read twice more
        found = found.unionByName(_across(_spark.stored(parted.join(big.select("key"), "key", "left_semi"))))
    return found.distinct()


def _across(rows: DataFrame) -> DataFrame:
    """Links of split buckets' members with the most central members of their other parts."""

    def centre(batches):
        def work(table, bounds):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = table.slice(a, b - a)
                order = np.argsort(own.column("rep").to_numpy())
                rep, n, sig = own.column("rep").to_numpy()[order], own.column("n").to_numpy()[order], _signatures(own.column("sig"))[order]
                _, _, hub, near = bucket_links(rep, n, sig)
                row = own.column("key")[0].as_py(), near, int(rep[hub]), int(n[hub]), sig[hub].tobytes()
                kinds = (("key", pa.int64()), ("near", pa.float64()), ("c_rep", pa.int64()), ("c_n", pa.int32()), ("c_sig", pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, kinds, strict=True)], [k for k, _ in kinds])

        yield from _grouped(batches, ("key", "salt"), work)

    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt").select("key", "salt", "rep", "n", "sig")
    centres = dealt.mapInArrow(centre, "key long, near double, c_rep long, c_n int, c_sig binary")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("near"), "c_rep"))  # one row a part
    shown = centres.withColumn("place", place).filter(F.col("place") <= CENTRES).groupBy("key").agg(F.collect_list(F.struct("c_rep", "c_n", "c_sig")).alias("centres"))

    def link(batches):
        def work(table, bounds):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = table.slice(a, b - a)
                cs = own.column("centres")[0].as_py()
                near = _alike(own.column("n").to_numpy(), _signatures(own.column("sig")), np.array([c["c_n"] for c in cs]), np.stack([np.frombuffer(c["c_sig"], np.uint8) for c in cs]))
                ids = np.array([c["c_rep"] for c in cs])
                near[own.column("rep").to_numpy()[:, None] == ids[None]] = 0
                k = np.flatnonzero(near.max(axis=1) > 0)
                x, y = own.column("rep").to_numpy()[k], ids[near[k].argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        yield from _grouped(batches, ("key", "salt"), work)

    with_centres = rows.join(_spark.stored(shown), "key").repartition("key", "salt").sortWithinPartitions("key", "salt")
    return with_centres.select("key", "salt", "rep", "n", "sig", "centres").mapInArrow(link, "a long, b long")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (``rep, key, component, n`` and more) of buckets of several classes, in blocks ``kind, x, y``.

    Two rows of different classes of a bucket meet in one block. ``main`` marks a
    row of the bucket's largest class: those are dealt into parts that never meet
    each other. Blocks of kind 0 are a part of the main class and a part of the
    rest, which also meets itself where ``x`` is 0; those of kind 1 two parts of the rest.
    """
    weigh = lambda rows, n: F.greatest(F.ceil(rows / BUCKET), F.ceil(n / SHINGLES)).cast("int")
    each = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("w"))
    most = F.max_by(F.struct("component", "c", "w"), F.struct("c", "component"))
    sums = each.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("c").alias("c"), F.sum("w").alias("w"), most.alias("m")).filter("classes > 1")
    parts = sums.select("key", F.col("m.component").alias("largest"), weigh(F.col("m.c"), F.col("m.w")).alias("px"), weigh(F.col("c") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("py"))
    own = rows.join(parts, "key").withColumn("main", F.col("component") == F.col("largest"))
    own = own.withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.when(F.col("main"), F.col("px")).otherwise(F.col("py"))).cast("int"))
    block = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_rest = F.transform(upto(F.col("py")), lambda y: block(0, F.col("part"), y))
    with_main = F.transform(upto(F.col("px")), lambda x: block(0, x, F.col("part")))
    with_others = F.transform(F.filter(upto(F.col("py")), lambda y: y != F.col("part")), lambda y: block(1, F.least(y, F.col("part")), F.greatest(y, F.col("part"))))
    blocks = F.when(F.col("main"), with_rest).otherwise(F.concat(with_main, with_others))
    return own.withColumn("b", F.explode(blocks)).select("*", "b.*").drop("b", "px", "py", "largest")


BLOCK = ("key", "kind", "x", "y")


def _likely(table: pa.Table, part: slice):
    """Places (in the part) of pairs of rows of different classes that may be similar, a batch at a time."""
    own = table.slice(part.start, part.stop - part.start)
    kin, n, main, at = (own.column(c).to_numpy(zero_copy_only=False) for c in ("component", "n", "main", "part"))
    kind, x, y = (own.column(c)[0].as_py() for c in BLOCK[1:])
    sig, every = _signatures(own.column("sig")), np.arange(own.num_rows)
    first, second = (every[at == x], every[at == y]) if kind else (every, every) if x == 0 else (every[main], every[~main])
    for lo in range(0, len(first), 64):
        some = first[lo : lo + 64]
        i, j = np.nonzero(_alike(n[some], sig[some], n[second], sig[second]))
        i, j = some[i], second[j]
        new = (kin[i] != kin[j]) & ((i < j) if first is second else True)
        if new.any():
            yield i[new], j[new]


def apart(rows: DataFrame) -> DataFrame:
    """``rep, key`` of the rows with a partner of another class that may be similar."""

    def run(batches):
        def work(table, bounds):
            rep, key = table.column("rep").to_numpy(), table.column("key").to_numpy()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                hit = np.zeros(b - a, bool)
                for i, j in _likely(table, slice(a, b)):
                    hit[i] = hit[j] = True
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rep[a:b][hit]), pa.array(key[a:b][hit])], ["rep", "key"])

        yield from _grouped(batches, BLOCK, work)

    met = dealt(rows).select(*BLOCK, "rep", "component", "n", "sig", "main", "part")
    return met.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "rep long, key long").distinct()


def _bits(grams: list) -> np.ndarray:
    """A row of bits for each sequence: which of the shingles that some share it has."""
    size = np.array([len(g) for g in grams])
    own = np.repeat(np.arange(len(grams)), size)
    _, which, count = np.unique(_labelled(own, np.concatenate(grams)), return_inverse=True, return_counts=True)
    keep = (count > 1)[which]
    bit, row = (np.cumsum(count > 1) - 1)[which[keep]], own[keep]
    width = 8 * (int((count > 1).sum()) // 64 + 1)
    out = np.zeros((len(grams), width), np.uint8)
    for lo in range(0, len(grams), 256):
        a, b = np.searchsorted(row, [lo, lo + 256])
        rows = min(256, len(grams) - lo)
        value = np.bincount((row[a:b] - lo) * width + (bit[a:b] >> 3), np.left_shift(1, bit[a:b] & 7), rows * width)
        out[lo : lo + rows] = value.astype(np.uint8).reshape(rows, width)
    return out.view(np.uint64)


def _joined(table: pa.Table, part: slice) -> tuple[list, list]:
    """Verified links between classes of a block, none of which the others imply."""
    own = table.slice(part.start, part.stop - part.start)
    kin, rep = own.column("component").to_numpy(), own.column("rep").to_numpy()
    grams = [np.frombuffer(g, np.uint64) for g in own.column("grams").to_pylist()]
    n, bits = np.array([len(g) for g in grams]), _bits(grams)
    pairs = []
    for i, j in _likely(table, part):
        step = max(1, (8 << 20) // bits.shape[1])
        for lo in range(0, len(i), step):
            x, y = i[lo : lo + step], j[lo : lo + step]
            both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            s = both / (n[x] + n[y] - both)
            ok = s >= SIMILARITY - 1e-9
            pairs.append(np.rec.fromarrays([s[ok], x[ok], y[ok]], names="s,x,y"))
    up: dict = {}

    def find(c):
        while up.get(c, c) != c:
            c = up[c]
        return c

    a, b = [], []
    pairs = np.concatenate(pairs) if pairs else []
    for k in np.argsort([-p["s"] for p in pairs], kind="stable"):
        x, y = int(pairs[k]["x"]), int(pairs[k]["y"])
        u, v = find(int(kin[x])), find(int(kin[y]))
        if u != v and aligned(grams[x], grams[y]) >= SIMILARITY:
            up[max(u, v)] = min(u, v)
            a.append(int(min(rep[x], rep[y])))
            b.append(int(max(rep[x], rep[y])))
    return a, b


def remaining(reps: DataFrame, wide: DataFrame, found: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Verified links between rows of a bucket that aren't in one component yet."""
    kin = reps.filter("n > 0").join(found, F.col("rep") == F.col("node"), "left")
    kin = kin.select("rep", "_name", "n", "sig", "keys", F.coalesce("component", "rep").alias("component"))
    rows = kin.select("rep", "component", "n", "sig", F.explode("keys").alias("key")).join(wide.select("key"), "key", "left_semi")
    left = _spark.stored(apart(_spark.stored(rows)))
    own = _spark.stored(left.select("rep").distinct().join(kin.drop("keys"), "rep"))
    full = left.join(own.drop("_name"), "rep")
    met = dealt(full).join(sequences(own.select("rep", "_name"), docs, doc_id, text), "rep")

    def run(batches):
        def work(table, bounds):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                x, y = _joined(table, slice(a, b))
                if x:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        yield from _grouped(batches, BLOCK, work)

    met = met.select(*BLOCK, "rep", "component", "n", "sig", "main", "part", "grams")
    return met.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "a long, b long").distinct()


def common(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose places differ by ``band`` at most, one machine word at a time."""
    if len(a) > LONG or len(b) > LONG:
        return _by_blocks(a, b, band)
    where: dict = {}
    for i, s in enumerate(a):
        where[s] = where.get(s, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, strip = full, (1 << (2 * band + 1)) - 1
    for j, s in enumerate(b):
        if y := where.get(s):
            y &= strip << (j - band) if j >= band else strip >> (band - j)
            u = v & y
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _by_blocks(a: list, b: list, band: int) -> int:
    """The same for long sequences: blocks of ``b`` against the part of ``a`` within their band.

    Bits below the band don't change any more and those above are ones, so only the part's are kept.
    """
    found, low, high, v = 0, 0, 0, 0
    step, strip = max(band, 64), (1 << (2 * band + 1)) - 1
    for begin in range(0, len(b), step):
        to, end = max(0, begin - band), min(len(a), begin + step + band)
        if to >= len(a):
            break
        found += (to - low) - (v & ((1 << (to - low)) - 1)).bit_count()
        v = (v >> (to - low)) | (((1 << (end - high)) - 1) << (high - to))
        low, high = to, end
        full = (1 << (high - low)) - 1
        where: dict = {}
        for i, s in enumerate(a[low:high]):
            where.setdefault(s, []).append(i)
        few, masks = max(8, (high - low) // 2048), {}  # masks of frequent shingles are kept
        for j in range(begin, min(begin + step, len(b))):
            s = b[j]
            if s not in where:
                continue
            y = masks.get(s)
            if y is None:
                y = 0
                for i in where[s]:
                    y |= 1 << i
                if len(where[s]) > few:
                    masks[s] = y
            at = j - band - low
            y &= strip << at if at >= 0 else strip >> -at
            u = v & y
            v = ((v + u) | (v - u)) & full
    return found + (high - low) - v.bit_count()


def _common(a: list, b: list, band: int) -> int:
    """``common`` by narrower bands first: with L found, a better path stays within ``longest - L``."""
    longest, width = max(len(a), len(b)), min(band, NARROW)
    while True:
        found = common(a, b, width)
        if width >= band or longest - found <= width:
            return found
        width = min(band, 4 * width)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two shingle sequences: common ones in order, of all. 0 if it can't reach ``SIMILARITY``."""
    n, m = len(a), len(b)
    need = math.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9)
    if not n or not m or min(n, m) < need:
        return 0.0
    least = min(n, m)
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    rest = least - head
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    found = head + tail
    x, y = a[head : n - tail], b[head : m - tail]
    if len(x) and len(y):
        found += _common(x.tolist(), y.tolist(), max(n, m) - need)
    return found / (n + m - found)


def sequences(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``rep, grams``: the shingles of the rows ``rep, _name``, in text order; a table that is read more than once."""
    rows = named(docs, doc_id, text).select("_name", "_text").join(wanted, "_name").select("rep", "_text")

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                doc, gram = shingles(part.column(1))
                ends = 8 * np.cumsum(np.bincount(doc, minlength=part.num_rows))
                offs = pa.py_buffer(np.append(0, ends).astype(np.int64))
                grams = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, offs, pa.py_buffer(gram.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), grams], ["rep", "grams"])

    # rows equal in id and text have one name
    return _spark.stored(rows.mapInArrow(run, "rep long, grams binary").dropDuplicates(["rep"]))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Those of the links ``a, b`` whose texts align, with their ``similarity``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "_name"), "rep")
    seqs = sequences(wanted, docs, doc_id, text)
    left = pairs.join(seqs.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(seqs.select(F.col("rep").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(g, np.uint64) for g in batch.column(k).to_pylist()] for k in (2, 3))
            s = np.array([aligned(p, q) for p, q in zip(x, y, strict=True)])
            ok = pa.array(s >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(s).filter(ok)], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables of rows (``_id, _name, digest``) and of distinct texts (``digest, _name, class_id, keeper``).

    ``_name`` there names the row that stands for the text, and ``keeper`` the one
    text of each class that does so for the class: that of its least id.
    """
    _spark.small_batches(docs.sparkSession)
    made = _spark.stored(sketch_table(docs, doc_id, text))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_name", "n", "keys", "sig")
    reps = made.groupBy("digest").agg(F.min(order).alias("r"))
    reps = _spark.stored(reps.select(F.monotonically_increasing_id().alias("rep"), "digest", "r._id", "r._name", "r.n", "r.keys", "r.sig"))
    sizes = _bucket_rows(reps).groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    wide = _spark.stored(sizes.filter("size > 2"))  # of two members the pair is tried
    links = _spark.stored(verified(_spark.stored(candidates(reps, wide)), reps, docs, doc_id, text).select("a", "b"))
    found = components(links)
    more = _spark.stored(remaining(reps, wide, found, docs, doc_id, text))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    kin = reps.select("rep", "digest", "_id", "_name").join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    kin = _spark.stored(kin.drop("node"))
    least = kin.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_name", "rep")).alias("k"))
    named_by = kin.join(least.select("component", F.col("k._id").alias("class_id"), F.col("k.rep").alias("first")), "component")
    return made.select("_id", "_name", "digest"), named_by.select("digest", "_name", "class_id", (F.col("rep") == F.col("first")).alias("keeper"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` of every row; the class is named by its least id."""
    rows, texts = classed(docs, doc_id, text)
    return rows.join(texts.select("digest", "class_id"), "digest").select(F.col("_id").alias("doc_id"), "class_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each class, with the least id; of rows equal in id and text the one that sorts first."""
    _, texts = classed(docs, doc_id, text)
    name, place = f"name{uuid.uuid4().hex}", f"place{uuid.uuid4().hex}"
    own = docs.withColumn(name, _name(doc_id, text))
    kept = own.join(texts.filter("keeper").select(F.col("_name").alias(name)), name, "left_semi")
    kept = kept.withColumn(place, F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64(*_spark.comparable(docs)))))
    return kept.filter(F.col(place) == 1).drop(name, place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"))
