"""Views of the driver's tables as one time-ordered transaction table.

Columns: ``transaction_id, customer_id, merchant_id, device_id,
merchant_category, location, device_type, amount, timestamp, account_age_days``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("transaction_id", "customer_id", "merchant_id", "device_id", "merchant_category", "location", "device_type", "amount", "timestamp", "account_age_days")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: days as times (many ties), suppliers as merchants, parts as devices; some keys null."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
    )
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_suppkey").cast("string").alias("merchant_id"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey").cast("string")).alias("device_id"),
        F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("merchant_category"),
        F.when(F.col("s_nationkey") != 7, F.col("s_nationkey").cast("string")).alias("location"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("device_type"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_linenumber") * 7).cast("int").alias("account_age_days"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: microsecond times for windows of hours."""
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        (k % 23).cast("string").alias("merchant_id"),
        F.when(k % 17 != 0, (k % 17).cast("string")).alias("device_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("merchant_category"),
        F.when(k % 5 != 0, (k % 5).cast("string")).alias("location"),
        F.when(k % 3 != 0, (k % 3).cast("string")).alias("device_type"),
        F.col("value").alias("amount"),
        F.col("ts").alias("timestamp"),
        k.alias("account_age_days"),
    )
