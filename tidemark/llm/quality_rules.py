"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the text, so the scan, the measures
and the verdict are a single stage without shuffle or Python. Steps that several
measures need (the word array, the window hashes) are bound once by a
one-element ``transform``: inside a lambda, Catalyst would otherwise evaluate
the outer expression anew for each element.

Window repeats compare 64-bit hashes of eight words within one text.

Null or empty text: no words, all counts 0, ``base_failed`` true. Other columns
of the input are not touched and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his are this or had from "
    "der die das und ist nicht ein eine zu den von mit sich auf für dem im des auch "
    "le la les de des et un une est que qui dans pour par sur pas au avec du en "
    "el los las y del se una por con para su al lo como más esta o"
).split()

WINDOW = 8
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a missing bound doesn't bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are SQL over the counts made below.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 20.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("upper_ratio", "n_upper / word_chars", None, 0.5),
)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _pairs(h: Column, step: int) -> Column:
    n = F.size(h) - step
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def _covered(grams: Column, width: int) -> Column:
    """Words in windows whose hash occurs at two places or more."""

    def marked(s):
        same = F.filter(
            s,
            lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]),
        )
        return let(F.array_sort(F.transform(same, lambda e: e["i"])), total)

    def total(at):
        ends = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1), p + width) - p))
        return F.aggregate(ends, F.lit(0), lambda a, x: a + x)

    pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
        let(F.array_sort(pairs), marked)
    )


def _repeats(words: Column, width: int) -> Column:
    hashed = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: let(_pairs(h1, 1), lambda h2: let(_pairs(h2, 2), lambda h4: let(_pairs(h4, 4), lambda h8: _covered(h8, width)))),
    )
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(hashed)


def _measures(text: Column) -> Column:
    flat = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    split = F.filter(F.split(flat, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words):
        return let(
            lines,
            lambda rows: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeats(words, WINDOW).cast("long").alias("n_repeat_words"),
                F.size(rows).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            ),
        )

    return let(split, of)


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES) -> DataFrame:
    """Counts and verdict of each document, one row each, with the columns ``keep``."""
    made = docs.select(*[F.col(f"`{c}`") for c in keep], _measures(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_m"))
    out = made.select(*[F.col(f"`{c}`") for c in keep], "_m.*")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True)
    for r in rules:
        x = F.expr(r.measure)
        for bound, holds in ((r.low, lambda b, x=x: x >= b), (r.high, lambda b, x=x: x <= b)):
            if bound is not None:
                verdict = verdict & holds(bound)
    return out.withColumn("base_failed", base).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """The same rows in DuckDB: windows by unnesting, no hashes."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    tests = " and ".join(
        f"({r.measure}) {op} {b}" for r in RULES for op, b in ((">=", r.low), ("<=", r.high)) if b is not None
    )
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW})),
r as (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g),
p as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from r where c > 1),
q as (select doc_id, cast(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as bigint) as n_repeat_words from p group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(q.n_repeat_words, 0) as n_repeat_words,
  len(ls) as n_lines, len(list_filter(ws, lambda x: x in ({stop}))) as n_stop_words,
  length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper
  from w left join q on w.doc_id = q.doc_id),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else {tests} end as kept from b
"""
