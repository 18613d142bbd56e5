"""Exact dedup: two passes with a Bloom filter of hashes that occur again.

1. The texts are read once: each row gets the SHA-256 of its text, in which every
   run of white space counts as one space, and is written to the shared folder
   with the columns to keep.
2. First pass, over the hashes: each sets ``HASHES`` slots of a filter of about
   ``BITS`` bits a row. Slots are counted, combined in the map tasks, and those hit
   twice or more become the bits of bitmaps of 32,768 slots.
3. Second pass: a row whose slots aren't all set has a hash that occurs once; it
   goes straight to the result. The others may be repeated. They alone are grouped
   by hash and joined with their groups.

The filter is broadcast and has ``max_bits`` at most: with more rows the hashes are
dealt into shards, each with a filter and a part of the written table of its own.
Groups of more than ``HEAVY`` rows and a thousandth of all rows are a thousand at
most; their rows meet them by broadcast, and never in one task. The main path is
DataFrame functions alone.

Of equal texts the row with the least id stays (null ids come last); among rows
that tie in it, the one written first stays, so one row of a group is kept whatever
repeats. Null texts count as empty. Ids may be of any type that has an order, and
columns of any name and type are carried unchanged, but for columns named as those
added. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _spark

BITS = 16  # of the filter for each row
HASHES = 2  # slots that a row sets
MAX_BITS = 1 << 31  # of one filter (256 MB)
BITMAP = 32_768  # slots of a row of the filter, as ``bitmap_construct_agg`` has them
HEAVY = 10_000  # rows of a group from which it may be heavy
SHARE = 1_000  # heavy groups hold more than this part of all rows, so they are no more than this
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def normal_hash(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space as one space."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(flat.cast("binary"), 256))


def _slots(key: Column, width: int) -> list[Column]:
    """A slot in each of ``HASHES`` parts of ``width`` slots."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(width)) + i * width for i in range(HASHES)]


def repeated_slots(rows: DataFrame, width: int) -> DataFrame:
    """``shard, bucket, bits``: the slots that rows hit twice or more, as bitmaps."""
    hits = rows.select("shard", F.explode(F.array(*_slots(F.col("key"), width))).alias("slot"))
    again = hits.groupBy("shard", "slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bucket, place = F.expr(f"slot div {BITMAP}"), F.col("slot") % BITMAP
    return again.groupBy("shard", bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def asked(rows: DataFrame, bits: DataFrame, width: int) -> DataFrame:
    """The rows of one shard with ``maybe``: whether all their slots are set, so that their key may occur again."""
    every = F.lit(True)
    for i, slot in enumerate(_slots(F.col("key"), width)):
        own = F.broadcast(bits.select(F.col("bucket").alias(f"b{i}"), F.col("bits").alias(f"m{i}")))  # MAX_BITS at most
        rows = rows.withColumn(f"s{i}", slot).join(own, F.expr(f"s{i} div {BITMAP}") == F.col(f"b{i}"), "left")
        byte = F.conv(F.hex(F.expr(f"substring(m{i}, cast(s{i} % {BITMAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
        every = every & (byte.bitwiseAND(F.pow(F.lit(2), F.col(f"s{i}") % 8).cast("int")) > 0)
    return rows.withColumn("maybe", F.coalesce(every, F.lit(False))).drop(*[f"{c}{i}" for c in "smb" for i in range(HASHES)])


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: Sequence[str] | None = None, bits: int = BITS, max_bits: int = MAX_BITS, heavy: int = HEAVY) -> DataFrame:
    """All rows of ``docs``, with the given columns (all without it) and ``keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    carried = [c for c in (docs.columns if columns is None else columns) if c not in OUTPUT]
    n = docs.count()
    shards = max(1, math.ceil(n * bits / max_bits))
    width = max(BITMAP, math.ceil(n * bits / shards / HASHES))
    key = normal_hash(F.col(f"`{text}`"))
    # the row travels as one struct, so that no name of it meets one made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{doc_id}`").alias("id"), key.alias("key"))
    rows = rows.withColumns({"place": F.monotonically_increasing_id(), "shard": F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)).cast("int")})
    rows = _spark.stored(rows, by="shard")
    filters = _spark.stored(repeated_slots(rows, width), by="shard")
    parts = [asked(rows.filter(F.col("shard") == s), filters.filter(F.col("shard") == s), width) for s in range(shards)]
    flagged = parts[0]
    for p in parts[1:]:
        flagged = flagged.unionByName(p)

    maybe = flagged.filter("maybe")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("place").alias("place"))
    groups = maybe.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    groups = _spark.stored(groups)
    limit = max(heavy, n // SHARE)
    large = groups.filter(F.col("n") > limit).select(F.col("key").alias("hk"), F.col("n").alias("hn"), F.col("first").alias("hf"))
    small = groups.filter(F.col("n") <= limit).select(F.col("key").alias("gk"), F.col("n").alias("gn"), F.col("first").alias("gf"))
    met = maybe.join(F.broadcast(large), F.col("key") == F.col("hk"), "left")  # SHARE groups at most
    # rows of heavy groups are dealt by their place, and find no other group
    to = F.when(F.col("hk").isNull(), F.col("key")).otherwise(F.col("place").cast("string").cast("binary"))
    met = met.withColumn("to", to).join(small, F.col("to") == F.col("gk"), "left")
    first, size = F.coalesce("hf", "gf"), F.coalesce("hn", "gn", F.lit(1))
    kept = F.coalesce(first["place"] == F.col("place"), F.lit(True))
    grouped = met.select("row", "key", F.when(first.isNull(), F.col("id")).otherwise(first["id"]).alias("keep"), size.alias("n"), kept.alias("kept"))
    alone = flagged.filter("not maybe").select("row", "key", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
    out = alone.unionByName(grouped)
    made = [F.col("keep"), F.col("n"), F.col("kept"), F.lower(F.hex("key"))]
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried], *[c.alias(name) for c, name in zip(made, OUTPUT, strict=True)])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return mark(docs, doc_id, text, **settings).filter("kept").drop(*OUTPUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(_spark.table(spark, sf_dir, "documents"), columns=["doc_id"])


def oracle() -> str:
    return r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
