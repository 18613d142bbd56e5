"""Connected components of a distributed edge table, by alternating stars.

A large-star step hangs each node's larger neighbours on the least node next to
it, a small-star step its smaller ones; both keep components whole and end in
stars around each component's least node after a number of steps that grows
with the logarithm of its size. Each step is an aggregation and a join, written
to the shared folder, so no lineage builds up and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import stored


def _hang(pairs: DataFrame, larger: bool) -> DataFrame:
    """``pairs`` (u, v): every v of u, or u itself, on the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u")
    if larger:
        return hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("u"), F.col("m").alias("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of all nodes of the edges ``a, b``."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, True)
        e = stored(_hang(large.distinct(), False).distinct())
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
