"""Phrase collocation mining: contiguous pattern growth over projected occurrences.

1. Words. Map tasks count the words of each language over some million of them at a
   time, Spark sums them; words with ``LEAST`` occurrences or more are frequent. No
   other word is in a frequent phrase.
2. Projection. Each occurrence of a frequent word is a pointer: the word and the up to
   three frequent words that follow it in its piece. Equal pointers of a map task are
   one with a count. They are dealt by prefix: the first word, and, as long as the last
   word of the prefix is hot (over ``HOT`` occurrences), one word more. A prefix so has
   no more occurrences than a word that isn't hot, however many its first word has;
   prefixes of hot words alone are dealt by all four, and are summed in the map tasks.
   Phrases of hot words alone whose pointers so go to several tasks are counted apart:
   the map tasks' sums of them travel as pointers of their own, which meet in one task.
3. Growth. A task takes the pointers of its prefixes, in order, and extends a prefix
   to the right depth-first: the pointers of each extension are a slice of those of
   the prefix, and only frequent extensions are entered. A phrase of hot words that is
   spread over several tasks is entered in any case, but told only by the task where its
   sums meet: a task gives frequent phrases alone, however many tasks there are.
4. Scores. Phrases ask for the counts of the parts of all their cuts by an equi-join;
   hot words are asked for by a broadcast of at most ``SHARE`` rows. Phrases nearly
   always inside a longer one are dropped, and each language's first ``TOP`` are ranked.

Symbols are indexes into the sorted frequent words, 32 bits each, while these are no
more than ``DENSE`` (then their hashes are broadcast, 32 MB); beyond, symbols are the
64-bit hashes themselves, nothing is broadcast but hot words, and the results are the
same. Words are told apart by a 64-bit hash of language and word; counts and scores are
exact (38-digit decimals where products may pass 64 bits).

Null texts count as empty and null languages as ``und``. Ids aren't used; repeated rows
count as rows; other columns aren't touched. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _spark, _text

LEAST = 30
LONGEST = 4
TOP = 2_000
INSIDE = (80, 100)  # a phrase goes if a longer one around it has this share of its occurrences
SCALE = 2_000_000
HELD = 1_500_000  # words that a map task combines before they leave it
HOT = 200_000  # occurrences of a word from which prefixes that end in it are made longer
SHARE = 100_000  # hot words have more than this part of all words, so they are no more than this
DENSE = 1 << 22
BUCKET = 1_000_000  # words of the text for each bucket of prefixes
UNKNOWN = "und"

_GAPS = np.zeros(256, bool)
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS[[32, 9]] = True
_GAPS |= _BREAKS
_H = [f"h{i + 1}" for i in range(LONGEST)]


def _words(part: pa.RecordBatch, seeds: dict[str, np.uint64]):
    """Words of a slice: their bytes, places, 64-bit hashes with the language, and the row's language."""
    langs = part.column(0).to_pylist()
    for k in set(langs) - seeds.keys():
        seeds[k] = np.uint64(int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little"))
    data, offs = _text.utf8(part.column(1))
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    w = _text.Words(data, offs, gaps=_GAPS)
    number = {k: i for i, k in enumerate(seeds)}
    lang = np.array([number[k] for k in langs], np.int64)
    salt = np.array([seeds[k] for k in langs], np.uint64)
    h = _text.mix(w.hashes() ^ salt[w.doc]) if len(w.start) else np.zeros(0, np.uint64)
    h = np.clip(h, 1, np.iinfo(np.uint64).max - np.uint64(1))  # 0 is the end of a piece, the greatest marks sums
    return w, h, lang


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    _spark.small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, h, count`` of parts of the table; a null word has the number of all words."""

    def flush(names, held, words):
        (h, lang), (count,), _ = _text.sums([np.concatenate(x) for x in zip(*(k for k, _ in held), strict=True)], np.concatenate([c for _, c in held]))
        known, first = np.unique(np.concatenate([k for k, _ in words]), return_index=True)
        word = pa.concat_arrays([w for _, w in words]).take(pa.array(first)).take(pa.array(np.searchsorted(known, h)))
        names = pa.array(names, pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), word, pa.array(h.view(np.int64)), pa.array(count)], ["lang", "word", "h", "count"])
        which, at = np.unique(lang, return_inverse=True)
        total = np.bincount(at, count).astype(np.int64) if len(at) else which
        yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.nulls(len(which), pa.string()), pa.nulls(len(which), pa.int64()), pa.array(total)], ["lang", "word", "h", "count"])

    def run(batches):
        seeds: dict[str, np.uint64] = {}
        held, words, n = [], [], 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w, h, lang = _words(part, seeds)
                if not len(h):
                    continue
                (h, of), (count,), at = _text.sums([h, lang[w.doc]], np.ones(len(h), np.int64))
                held.append(([h, of], count))
                h, one = np.unique(h, return_index=True)
                words.append((h, _text.pieces(w.data, w.start[at[one]], w.end[at[one]])))
                n += len(w.start)
            if n >= HELD:
                yield from flush(list(seeds), held, words)
                held, words, n = [], [], 0
        if held:
            yield from flush(list(seeds), held, words)

    return texts.mapInArrow(run, "lang string, word string, h long, count long")


class _Symbols:
    """Hashes to symbols and back; 0 is no word. ``table``: the frequent hashes in order, or None if they are too many."""

    def __init__(self, table: np.ndarray | None, hot: np.ndarray):
        self.table, self.kind = table, np.dtype(np.uint64 if table is None else np.uint32)
        self.hot = np.sort(self.of(hot)) if len(hot) else np.zeros(0, self.kind)

    def of(self, h: np.ndarray) -> np.ndarray:
        if self.table is None:
            return h
        at = np.minimum(np.searchsorted(self.table, h), max(0, len(self.table) - 1))
        return np.where(self.table[at] == h, at + 1, 0).astype(self.kind) if len(self.table) else np.zeros(len(h), self.kind)

    def hashes(self, symbols: np.ndarray) -> np.ndarray:
        if self.table is None:
            return symbols.view(np.int64)
        return np.append(np.zeros(1, np.uint64), self.table)[symbols].view(np.int64)

    @property
    def sums(self):
        """In the place after a phrase: the pointer has the phrase's sum, not a next word."""
        return np.iinfo(self.kind).max

    def is_hot(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(symbols), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, symbols), len(self.hot) - 1)] == symbols


def followers(symbols: np.ndarray, joined: np.ndarray) -> list[np.ndarray]:
    """The symbol of each word and of the three after it; 0 from the end of the piece, or a word that isn't frequent, on.

    ``joined``: whether the next word is in the same piece.
    """
    cells, after = [symbols], np.zeros(len(symbols) + LONGEST, symbols.dtype)
    after[: len(joined)] = symbols[1:] * joined
    for k in range(1, LONGEST):
        cells.append(after[k - 1 : k - 1 + len(symbols)] * (cells[-1] != 0))
    return cells


def with_sums(cells: list[np.ndarray], count: np.ndarray, lang: np.ndarray, is_hot, sums):
    """The pointers, and one for each phrase of two or three hot words at their begin, with its number of occurrences."""
    out, alone = [(cells, count, lang)], is_hot(cells[0])
    for k in range(2, LONGEST):
        alone = alone & is_hot(cells[k - 1])
        if alone.any():
            of, (n,), at = _text.sums([c[alone] for c in cells[:k]], count[alone])
            more = [np.full(len(n), sums if i == k else 0, cells[0].dtype) for i in range(k, LONGEST)]
            out.append(([*of, *more], n, lang[alone][at]))
    return [np.concatenate(c) for c in zip(*(o[0] for o in out), strict=True)], *(np.concatenate([o[i] for o in out]) for i in (1, 2))


def pointers(texts: DataFrame, symbols, buckets: int) -> DataFrame:
    """``lang, bucket, cells, counts``: a map task's pointers of a bucket's prefixes, in order, one column after the other."""

    def flush(names, held):
        *cells, lang = [np.concatenate(x) for x in zip(*held, strict=True)]
        cells, (count,), at = _text.sums(cells, np.ones(len(lang), np.int64))
        lang = lang[at]  # a word's symbol tells its language
        cells, count, lang = with_sums(cells, count, lang, symbols.value.is_hot, symbols.value.sums)
        to, longer = _text.mix(cells[0].astype(np.uint64)), np.ones(len(count), bool)
        for a, b in zip(cells, cells[1:], strict=False):
            longer &= symbols.value.is_hot(a)  # sums end in a symbol that isn't hot, so all of a phrase's go the same way
            to = np.where(longer, _text.mix(to ^ b.astype(np.uint64)), to)
        bucket = (to % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket * len(names) + lang, kind="stable")
        place = (bucket * len(names) + lang)[order]
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(place))
        ordered, count = [c[order] for c in cells], count[order].astype(np.uint32)
        blobs = [b"".join(c[i:j].tobytes() for c in ordered) for i, j in zip(at, ends, strict=True)]
        counts = [count[i:j].tobytes() for i, j in zip(at, ends, strict=True)]
        names = pa.array(names, pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[order][at])), pa.array(bucket[order][at]), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["lang", "bucket", "cells", "counts"])

    def run(batches):
        seeds: dict[str, np.uint64] = {}
        held, n = [], 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w, h, lang = _words(part, seeds)
                if not len(h):
                    continue
                piece = np.cumsum(_BREAKS[w.data])[w.start]
                cells = followers(symbols.value.of(h), (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1]))
                go = cells[1] != 0
                held.append((*(c[go] for c in cells), lang[w.doc[go]]))
                n += len(h)
            if n >= HELD:
                yield from flush(list(seeds), held)
                held, n = [], 0
        if held:
            yield from flush(list(seeds), held)

    return texts.mapInArrow(run, "lang string, bucket long, cells binary, counts binary")


def grow(cells: list[np.ndarray], count: np.ndarray, is_hot, least: int, sums: int | None = None):
    """Frequent extensions of the prefixes of ordered pointers: the first pointer of each, its length and its occurrences.

    Phrases of hot words alone, of which other tasks have more, are given by the pointers that end in ``sums``.
    """
    total = np.append(0, np.cumsum(count))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def extend(lo: int, hi: int, depth: int, spread: bool) -> None:
        own = cells[depth][lo:hi]
        begin = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        end = np.append(begin[1:], hi - lo)
        n = total[lo + end] - total[lo + begin]
        more = is_hot(own[begin]) & spread & (depth + 1 < LONGEST)
        go = np.flatnonzero((own[begin] != 0) & (more | (n >= least)))
        if spread and depth and sums is not None:
            told = go[own[begin[go]] == sums]
            found.append((lo + begin[told], np.full(len(told), depth), n[told]))
            go = go[own[begin[go]] != sums]
        if depth:
            own_go = go[~more[go]]
            found.append((lo + begin[own_go], np.full(len(own_go), depth + 1), n[own_go]))
        if depth + 1 < LONGEST:
            for k in go.tolist():
                extend(lo + int(begin[k]), lo + int(end[k]), depth + 1, bool(more[k]))

    if len(count):
        extend(0, len(count), 0, True)
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def frequent_phrases(texts: DataFrame, symbols, buckets: int, least: int) -> DataFrame:
    """``lang, h1 .. h4, f``: phrases of two words or more and their occurrences; 0 after a phrase's last word."""

    def task(key, rows):
        kind = symbols.value.kind
        count = [np.frombuffer(b, np.uint32) for b in rows.column("counts").to_pylist()]
        parts = [np.frombuffer(b, kind).reshape(LONGEST, len(c)) for b, c in zip(rows.column("cells").to_pylist(), count, strict=True)]
        cells, (count,), _ = _text.sums(list(np.concatenate(parts, 1)), np.concatenate(count).astype(np.int64))
        first, length, n = grow(cells, count, symbols.value.is_hot, least, symbols.value.sums)
        out = {"lang": pa.array([key[1].as_py()] * len(first), pa.string())}
        for i, name in enumerate(_H):
            out[name] = symbols.value.hashes(np.where(i < length, cells[i][first], 0).astype(kind))
        return pa.table(out | {"f": n})

    dealt = pointers(texts, symbols, buckets)
    return dealt.groupBy("bucket", "lang").applyInArrow(task, f"lang string, {', '.join(f'{h} long' for h in _H)}, f long")


def _part(of: list, start: int, length: int, names: list[str]) -> Column:
    """``length`` words of a phrase from ``start`` on, as a struct with zeros behind."""
    return F.struct(*[(of[start + i] if i < length and start + i < LONGEST else F.lit(0).cast("long")).alias(n) for i, n in enumerate(names)])


def scored(phrases: DataFrame, words: DataFrame, hot: DataFrame) -> DataFrame:
    """Phrases with ``a, l, r, score`` of their lowest-scoring cut, without those nearly always inside a longer one."""
    h, p = [F.col(x) for x in _H], [f"p{i + 1}" for i in range(LONGEST)]
    size = sum(((x != 0).cast("int") for x in h), F.lit(0))
    asks = [F.when(size > k, F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), _part(h, 0, k, p).alias("p") if left else _part(h, k, LONGEST - k, p).alias("p"))) for k in range(1, LONGEST) for left in (True, False)]
    asked = phrases.select("*", F.explode(F.array_compact(F.array(*asks))).alias("ask")).select(*_H, "lang", F.col("f").alias("a"), "ask.k", "ask.left", "ask.p.*")
    one = [F.col("h").alias(p[0]), *[F.lit(0).cast("long").alias(x) for x in p[1:]], F.col("count").alias("c")]
    parts = phrases.select(*[x.alias(n) for x, n in zip(h, p, strict=True)], F.col("f").alias("c")).unionByName(words.select(*one))
    often = F.broadcast(hot.select(*one))  # SHARE words at most
    told = asked.join(often, p).unionByName(asked.join(often, p, "left_anti").join(parts, p))
    pick = [F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("c"))).alias(f"{side}{k}") for k in range(1, LONGEST) for left, side in ((True, "l"), (False, "r"))]
    whole = told.groupBy(*_H).agg(F.max("lang").alias("lang"), F.max("a").alias("a"), *pick)

    def cut(k):
        score = F.expr(f"(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(19, 0))) div (cast(l{k} as decimal(19, 0)) + cast(r{k} as decimal(19, 0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = whole.select(*_H, "lang", "a", F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, LONGEST)]))).alias("cut"))

    inner = [F.when((size > n) & (size >= s + n), _part(h, s, n, _H)) for n in range(2, LONGEST) for s in range(LONGEST - n + 1)]
    around = phrases.filter(f"{_H[2]} <> 0").select(F.col("f"), F.explode(F.array_compact(F.array(*inner))).alias("s")).select("f", "s.*").groupBy(*_H).agg(F.max("f").alias("around"))
    low, high = INSIDE
    inside = F.col("around").cast("decimal(19,0)") * high >= F.col("a").cast("decimal(19,0)") * low
    return best.join(around, _H, "left").filter(~F.coalesce(inside, F.lit(False))).select(*_H, "lang", "a", "cut.score", "cut.l", "cut.r")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, hot: int = HOT, dense: int = DENSE, buckets: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of two to four words of each language."""
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    counts = word_counts(texts).groupBy("lang", "word").agg(F.sum("count").alias("count"), F.max("h").alias("h"))
    counts = _spark.stored(counts.filter((F.col("count") >= least) | F.col("word").isNull()))
    words, totals = counts.filter("word is not null"), counts.filter("word is null").select("lang", F.col("count").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("count") > max(hot, total // SHARE))
    bounded = lambda df: np.sort(df.select("h").toArrow().column(0).to_numpy().view(np.uint64))
    table = bounded(words) if words.count() <= dense else None
    symbols = spark.sparkContext.broadcast(_Symbols(table, bounded(often)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    phrases = _spark.stored(frequent_phrases(texts, symbols, buckets or max(2 * parts, total // BUCKET), least))
    rows = _spark.stored(scored(phrases, words, often))

    order = [F.desc("score"), F.desc("a")]
    # first in parts of a language, with all ties; words are only looked up for what is left
    some = rows.withColumn("part", F.pmod(F.xxhash64(*_H), F.lit(parts)))
    for by in (["lang", "part"], ["lang"]):
        some = some.withColumn("first", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("first") <= top)
    some = some.select("lang", "a", "l", "r", "score", F.array(*_H).alias("of"))
    each = some.select("*", F.posexplode(F.filter("of", lambda x: x != 0)).alias("at", "h"))
    named = each.join(words.select("h", "word"), "h").groupBy("of", "lang", "a", "l", "r", "score")
    named = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = named.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(_spark.table(spark, sf_dir, "documents"))


def oracle() -> str:
    cut = lambda k, left: f"list_slice(ws, 1, {k})" if left else f"list_slice(ws, {k + 1}, len(ws))"
    cuts = " union all ".join(f"select lang, ws, a, {k} as k, {cut(k, True)} as x, {cut(k, False)} as y from c where len(ws) > {k}" for k in range(1, LONGEST))
    grams = " union all ".join(f"select lang, list_slice(ws, i, i + {n - 1}) as ws from w where i + {n - 1} <= len(ws)" for n in range(1, LONGEST + 1))
    subs = " union all ".join(f"select lang, list_slice(ws, {s}, {s + n - 1}) as ws, a from c where len(ws) > {n} and len(ws) >= {s + n - 1}" for n in range(2, LONGEST) for s in range(1, LONGEST - n + 2))
    low, high = INSIDE
    return rf"""
with d as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d)),
w as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from p),
f as (select lang, ws, count(*) as a from ({grams}) group by all having count(*) >= {LEAST}),
n as (select lang, sum(len(ws)) as n from p group by all),
c as (select * from f where len(ws) > 1),
s as (select q.lang, q.ws, q.a, k, fx.a as l, fy.a as r, ({SCALE}::hugeint * q.a) // (fx.a + fy.a) as score
  from ({cuts}) q join f fx on fx.lang = q.lang and fx.ws = q.x join f fy on fy.lang = q.lang and fy.ws = q.y),
b as (select * from s qualify row_number() over (partition by lang, ws order by score, k) = 1),
o as (select lang, ws, max(a) as around from ({subs}) group by all),
r as (select b.lang, array_to_string(b.ws, ' ') as phrase, a, l, r, score from b left join o using (lang, ws) where around is null or {high} * around::hugeint < {low} * a::hugeint),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from r)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from z join n using (lang) where rank <= {TOP}
"""
