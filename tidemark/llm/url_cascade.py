"""URL filter: host and path rules, then a Bloom filter cascade for the listed hosts.

The cascade knows every key that the corpus can ask for (each host and the
domains above it). Level 0 encodes the listed keys of that universe, level 1
the other keys that pass level 0 by mistake, level 2 the listed keys that pass
level 1, and so on until no mistake is left. A key's answer is the parity of
the first level that it doesn't pass, which is exact for the whole universe, so
judging a page needs no join: the levels are a few bits a listed key and travel
as one broadcast of at most ``MAX_BITS``. Where listed keys need more, keys are
dealt into shards by a hash, each with a cascade of its own, and pages pass one
after the other.

Null urls and urls without ``://`` have empty host and path, match nothing and
are allowed. Other columns of the input may have any name; repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import stored, table

# The rules, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# The listed hosts; each stands for itself and its subdomains.
LISTED = ("casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_BITS = 1 << 29  # of all levels of a cascade: 64 MB in each worker


LEVELS = 1.25  # bits of all levels and shards' unevenness, in those of the first level


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def parents(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    size: int
    hashes: int
    seed: int

    def passes(self, keys: Sequence[str]) -> np.ndarray:
        at = positions(keys, self.size, self.hashes, self.seed)
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool).all(axis=1)


def positions(keys: Sequence[str], size: int, hashes: int, seed: int) -> np.ndarray:
    """Bit positions of each key, by double hashing of a keyed digest."""
    salt = seed.to_bytes(8, "little")
    raw = b"".join(hashlib.blake2b(k.encode(), digest_size=16, salt=salt).digest() for k in keys)
    two = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    steps = np.arange(hashes, dtype=np.uint64)
    return ((two[:, :1] + steps * (two[:, 1:] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class Cascade:
    """Levels for the keys of one of ``shards`` shards; a key of another isn't listed here."""

    levels: tuple[Level, ...]
    shard: int = 0
    shards: int = 1

    def listed(self, keys: Sequence[str]) -> np.ndarray:
        own = [self.shards == 1 or zlib.crc32(k.encode()) % self.shards == self.shard for k in keys]
        out, open_ = np.zeros(len(keys), bool), np.flatnonzero(own)
        for i, level in enumerate(self.levels):
            if not len(open_):
                break
            ok = level.passes([keys[k] for k in open_])
            out[open_[~ok]] = i % 2 == 1
            open_ = open_[ok]
        out[open_] = len(self.levels) % 2 == 1
        return out

    @property
    def n_bits(self) -> int:
        return sum(x.size for x in self.levels)


def _level(keys: DataFrame, n: int, bits_a_key: float, seed: int) -> Level:
    size = max(64, int(n * bits_a_key))
    hashes = max(1, round(bits_a_key * 0.693))

    def words(batches):
        for b in batches:
            at = positions(b.column(0).to_pylist(), size, hashes, seed).ravel() if b.num_rows else np.zeros(0, np.int64)
            word, which = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size // 64 + 1, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Level(bits, size, hashes, seed)


def _passing(level):
    @F.pandas_udf(T.BooleanType())
    def passes(keys: pd.Series) -> pd.Series:
        return pd.Series(level.value.passes(keys.tolist()), dtype=bool)

    return passes


def fit_cascades(universe: DataFrame, listed: DataFrame | Iterable[str], bits_a_key: float = 10.0) -> Iterator[Cascade]:
    """A cascade for each shard of ``universe`` (one column ``key`` of distinct strings)."""
    spark = universe.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in listed], "key string")
    listed = listed.select("key").dropna().distinct()
    inside = stored(universe.join(listed, "key", "left_semi"))
    others = stored(universe.join(listed, "key", "left_anti"))
    # later levels hold a small share of the keys; an eighth is left for shards of uneven size
    shards = max(1, math.ceil(LEVELS * inside.count() * bits_a_key / MAX_BITS))
    for shard in range(shards):
        own = F.crc32(F.col("key").cast("binary")) % shards == shard
        yield Cascade(_levels(inside.filter(own), others.filter(own), bits_a_key), shard, shards)


def _levels(inside: DataFrame, others: DataFrame, bits_a_key: float) -> tuple[Level, ...]:
    levels: list[Level] = []
    while n := inside.count():
        level = _level(inside, n, bits_a_key, len(levels))
        levels.append(level)
        shared = inside.sparkSession.sparkContext.broadcast(level)
        inside, others = stored(others.filter(_passing(shared)("key"))), inside
    return tuple(levels)


def fit_cascade(universe: DataFrame, listed: DataFrame | Iterable[str], bits_a_key: float = 10.0) -> Cascade:
    """The cascade of a universe whose listed keys fit one."""
    first, *more = fit_cascades(universe, listed, bits_a_key)
    if more:
        raise ValueError(f"more than {MAX_BITS} bits; use fit_cascades")
    return first


def judge(pages: DataFrame, listed: DataFrame | Iterable[str] = LISTED, rules=RULES, page_id: str = "page_id", url: str = "url", bits_a_key: float = 10.0) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{page_id}`"), host.alias("host"), path.alias("path"))
    hosts = parts.select("host").filter("host <> ''").distinct()
    universe = stored(hosts.select(F.explode(parents(F.col("host"))).alias("key")).distinct())
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    made = parts.withColumn("rule", name).withColumn("_v", verdict).withColumn("_l", F.lit(False))
    for i, cascade in enumerate(fit_cascades(universe, listed, bits_a_key)):
        if i:  # the bits of the cascade before aren't needed any more
            made = stored(made)
        if cascade.levels:
            made = made.withColumn("_l", F.col("_l") | _listed_in(spark.sparkContext.broadcast(cascade))("host"))
    return made.select(
        page_id, "host", "path", "rule", F.coalesce("_v", F.when(F.col("_l"), "block").otherwise("allow")).alias("verdict")
    )


def _listed_in(cascade):
    """Whether a host or a domain above it is listed."""

    @F.pandas_udf(T.BooleanType())
    def is_listed(hosts: pd.Series) -> pd.Series:
        codes, names = pd.factorize(hosts)
        keys, owner = [], []
        for i, name in enumerate(names):
            while name:
                keys.append(name)
                owner.append(i)
                name = name.partition(".")[2]
        hit = np.zeros(len(names), bool)
        if keys:
            np.logical_or.at(hit, np.array(owner), cascade.value.listed(keys))
        return pd.Series(hit[codes] if len(names) else np.zeros(len(codes), bool))

    return is_listed


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in longest)
    listed = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in LISTED)
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
c as (select page_id, translate(h, '{UPPER}', '{UPPER.lower()}') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when {listed} then 'block' else 'allow' end as verdict from c
"""
