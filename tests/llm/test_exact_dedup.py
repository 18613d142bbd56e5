import hashlib
import re

import pytest

from tidemark.llm import exact_dedup as e

CASES = ["a b", "a  b", "a\tb", " a b", None, "", " \n ", "A b", "a b", "x" * 20_000, "x" * 20_000, "b", "b", "b", "c"]


def brute(rows):
    """doc_id, keep_id, size, hash of each row, and how many rows of a group are kept."""
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    made = [(i, first[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)]
    return sorted(made, key=str)


def checked(frame, rows):
    got = frame.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = {}
    for r in got:
        kept.setdefault(r.text_sha256, []).append(r)
    for group in kept.values():
        stays = [r for r in group if r.kept]
        assert len(stays) == 1 and stays[0].doc_id == stays[0].keep_id


@pytest.mark.parametrize("settings", [{}, {"max_bits": 40}, {"heavy": 2}, {"bits": 1, "heavy": 1, "max_bits": 8}])
def test_equals_brute_force(spark, rng, settings):
    rows = list(enumerate(CASES)) + [(100 + i, f"t{rng.randrange(60)}") for i in range(90)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    checked(e.mark(docs, **settings), rows)


def test_null_shared_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c"), (None, "d"), (7, "a"), (7, "a"), (None, None)]
    checked(e.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows)


def test_one_text_many_times(spark):
    from pyspark.sql import functions as F

    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id"))).otherwise("same").alias("text"))
    out = e.mark(docs, heavy=100)
    assert out.filter("kept").count() == 40_001
    assert {(r.group_size, r["count"]) for r in out.groupBy("group_size").count().collect()} == {(1, 40_000), (20_000, 20_000)}


def test_columns_come_back_unchanged(spark):
    rows = [(1, "a", {"k": 1}, [1], (2,), b"x", 9, 8, 7), (2, "a", {}, [], (3,), b"", 6, 5, 4), (3, "z", None, None, None, None, 3, 2, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, m map<string,int>, a array<int>, s struct<x:int>, b binary, key int, place int, `row.id` int")
    out = e.dedup(docs)
    assert out.schema == docs.schema
    assert sorted(out.collect(), key=lambda r: r[0]) == [r for r in docs.collect() if r[0] != 2]
    marked = e.mark(docs.withColumnRenamed("doc_id", "maybe").withColumnRenamed("text", "shard"), "maybe", "shard")
    assert {(r.maybe, r.key, r.keep_id) for r in marked.collect()} == {(1, 9, 1), (2, 6, 1), (3, 3, 3)}


def test_empty_table(spark):
    assert e.mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_and_unique_rows_stay(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    out = e.mark(docs)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = docs.select("doc_id", e.normal_hash(docs.text).alias("key")).selectExpr("key", "0 as shard")
    assert e.repeated_slots(rows.union(rows.limit(1)), 1 << 15).count() in (1, 2)  # the slots of the one that repeats
    assert e.asked(rows, e.repeated_slots(rows, 1 << 20).filter("shard = 0"), 1 << 20).filter("maybe").count() == 0


def test_equals_sql(same):
    same(e.query, e.oracle())
