"""Source divergence audit: how far the sources of a language differ in their terms.

1. Counts. A map task cuts whole texts into terms with numpy and sums occurrences and
   documents by language, source and term, over some million terms at a time; Spark
   sums these by term. Terms in fewer than ``MIN_DOCS`` documents of their language
   are left out, once all its documents are counted.
2. Blocks. The terms of a language are dealt into blocks by hash, so many that a
   block's matrix of groups by terms is small. Each block meets the list of the
   language's groups (without a broadcast, so their number has no limit) and becomes
   a dense int64 tile: the smoothed share of each term in each group, in parts of
   10^9. One group's row after the other is broadcast against all later rows, which
   gives the block's part of the distance of all pairs; and each group keeps a heap
   of its ``TOP`` most overused terms of the block.
3. Merge. Parts of a pair are summed over the blocks, heaps of a group are merged,
   and both are ranked.

Shares are exact: ``1 + floor(10^9 * (count + 5) / (N + 5 V))`` is made by long
division in steps of 1,000, which holds for counts up to 9 * 10^15.

Null texts, languages and sources count as ''. A group without terms has a share
for each kept term, like all others; a language without kept terms has distances of
0. Ids aren't used, repeated rows count as rows, other columns aren't touched. A
language with one source has no pairs. An empty table gives an empty result. Terms
are told apart by 64-bit hashes within a map task and by their text in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _spark, _text

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
HELD = 4_000_000  # terms that a map task sums before they leave it
CELLS = 1 << 15  # of a tile
LEAST = 256  # terms of a tile, whatever the number of groups

_GAPS = np.ones(256, bool)
_GAPS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, count, docs`` of parts of the table; a row with the term '' and no counts tells of a group."""
    _spark.small_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def flush(names, held, words):
        group, term, count, n_docs = (np.concatenate(x) for x in zip(*held, strict=True))
        (group, term), (count, n_docs), _ = _text.sums((group, term), count, n_docs)
        hashes, first = np.unique(np.concatenate([h for h, _ in words]), return_index=True)
        word = pa.concat_arrays([w for _, w in words]).take(pa.array(first))
        langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        at = pa.array(group)
        yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), word.take(pa.array(np.searchsorted(hashes, term))), pa.array(count), pa.array(n_docs)], _COUNTS)

    def run(batches):
        names: dict[tuple[str, str], int] = {}
        told, held, words, n = 0, [], [], 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                of_row = np.array([names.setdefault(k, len(names)) for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
                data, offs = _text.utf8(part.column(2))
                data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
                w = _text.Words(data, offs, gaps=_GAPS)
                if not len(w.start):
                    continue
                (doc, term), (count,), at = _text.sums((w.doc, w.hashes()), np.ones(len(w.start), np.int64))
                (group, term), (count, n_docs), first = _text.sums((of_row[doc], term), count, np.ones(len(doc), np.int64))
                held.append((group, term, count, n_docs))
                term, one = np.unique(term, return_index=True)
                words.append((term, _text.pieces(data, w.start[at[first[one]]], w.end[at[first[one]]])))
                n += len(w.start)
            if n >= HELD:
                yield from flush(list(names), held, words)
                held, words, n = [], [], 0
            if len(names) > told:
                new = list(names)[told:]
                told = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in new]), pa.array([k[1] for k in new]), pa.array([""] * len(new)), *[pa.array([0] * len(new), pa.int64())] * 2], _COUNTS)
        if held:
            yield from flush(list(names), held, words)

    return own.mapInArrow(run, "lang string, source string, term string, count long, docs long")


_COUNTS = ["lang", "source", "term", "count", "docs"]


def shares(counts: np.ndarray, total, kept: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept))``, exactly, of int64."""
    rest, below, out = counts + SMOOTH, np.asarray(total) + SMOOTH * kept, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1_000
        out = out * 1_000 + rest // below
        rest = rest % below
    return out + 1


def pair_sums(p: np.ndarray) -> np.ndarray:
    """``out[i, j]``: the sum over the columns of ``abs(p[i] - p[j])``."""
    out = np.zeros((len(p), len(p)), np.int64)
    for i in range(len(p) - 1):
        out[i, i + 1 :] = np.abs(p[i + 1 :] - p[i]).sum(1)
    return out + out.T


def _tile(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A block's parts of the pairs' distances and its candidates for the groups' terms; ``other`` or ``term`` is null."""
    names = groups.column("source").combine_chunks()
    total, kept, every = (groups.column(c).to_numpy() for c in ("total", "kept", "every"))
    out = {"source": [], "term": [], "value": []}
    if counts.num_rows:
        number = {name: i for i, name in enumerate(names.to_pylist())}
        row = np.array([number[x] for x in counts.column("source").to_pylist()])
        words, column = np.unique([x.encode() for x in counts.column("term").to_pylist()], return_inverse=True)  # UTF-8 order
        tile = np.zeros((len(names), len(words)), np.int64)
        tile[row, column] = counts.column("count").to_numpy()
        p = shares(tile, total[:, None], int(kept[0]))
        q = shares(tile.sum(0), every[0], int(kept[0]))
        sums = pair_sums(p)
        for g in range(len(names)):
            over = np.flatnonzero((tile[g] > 0) & (p[g] > q))
            best = over[np.argsort(q[over] - p[g, over], kind="stable")[:top]]
            out["source"].append(np.full(len(best), g))
            out["term"].append(words[best])
            out["value"].append(p[g, best] - q[best])
    else:
        sums = np.zeros((len(names), len(names)), np.int64)
    found = sum(map(len, out["term"]))
    one, two = np.nonzero(~np.eye(len(names), dtype=bool))
    source = np.concatenate([*out["source"], one]).astype(np.int64)
    return pa.table({
        "source": names.take(pa.array(source)),
        "other": pa.concat_arrays([pa.nulls(found, pa.string()), names.take(pa.array(two)).cast(pa.string())]),
        "term": pa.array([*(w.decode() for part in out["term"] for w in part), *[None] * len(two)], pa.string()),
        "value": np.concatenate([*out["value"], sums[one, two]]).astype(np.int64),
    })


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS, least: int = LEAST) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group its distance to the other sources of the
    language (``pair``, all of them), and its ``top`` most overused terms (``term``)."""
    # map tasks have combined their counts; dealt by term, one exchange serves the sums and the documents of a term
    parts = term_counts(docs, text, lang, source).repartition("lang", "term")
    by_term = Window.partitionBy("lang", "term")
    summed = parts.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    summed = summed.withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("one", (F.row_number().over(by_term.orderBy("source")) == 1).cast("long"))
    counts = _spark.stored(summed.filter((F.col("term") == "") | (F.col("in_docs") >= min_docs)).select("lang", "term", "source", "count", "one"))
    real = counts.filter("term <> ''")
    groups = _spark.stored(counts.groupBy("lang", "source").agg(F.sum("count").alias("total")))
    kept = real.groupBy("lang").agg(F.sum("one").alias("kept"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("every")).join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    wide = F.greatest(F.lit(least), F.expr(f"{cells} div groups"))
    langs = _spark.stored(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / wide))))
    dealt = real.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "count")
    lists = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = lists.select("lang", "block", "source", "total", "kept", "every")

    def tile(key, counts, groups):
        made = _tile(counts, groups, top)
        return made.add_column(0, "lang", pa.array([key[0].as_py()] * made.num_rows, pa.string()))

    made = dealt.groupBy("lang", "block").cogroup(lists.groupBy("lang", "block")).applyInArrow(tile, "lang string, source string, other string, term string, value long")
    merged = made.groupBy("lang", "source", "other", "term").agg(F.sum("value").alias("value"))  # a term is in one block
    part = F.when(F.col("term").isNull(), "pair").otherwise("term")
    ranked = merged.select("lang", "source", part.alias("part"), F.coalesce("term", "other").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return ranked.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_spark.table(spark, sf_dir, "documents"))


def oracle() -> str:
    return rf"""
with d as (select row_number() over () as i, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by all having count(distinct i) >= {MIN_DOCS}),
c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select g.lang, (select count(*) from k where k.lang = g.lang) as v from (select distinct lang from g) g),
n as (select g.lang, g.source, v, coalesce(sum(c), 0) as n from g join v using (lang) left join c using (lang, source) group by all),
m as (select lang, sum(n) as m from n group by all),
p as (select n.lang, n.source, k.term, coalesce(c, 0) as c, 1 + ({SCALE}::hugeint * (coalesce(c, 0) + {SMOOTH})) // (n + {SMOOTH} * v) as p
  from n join k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
q as (select lang, term, 1 + ({SCALE}::hugeint * (sum(c) + {SMOOTH})) // (any_value(m) + {SMOOTH} * any_value(v)) as q from p join m using (lang) join v using (lang) group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item,
    coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  union all select lang, source, 'term', term, p - q from p join q using (lang, term) where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from o)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= {TOP}
"""
