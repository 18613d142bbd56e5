"""Reading and writing tables by file type, with the checks around them."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("transaction_id", "customer_id")],
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    *[T.StructField(c, T.StringType()) for c in ("merchant_id", "merchant_category", "device_id", "device_type", "location", "payment_method", "transaction_type")],
    T.StructField("account_age_days", T.IntegerType()),
    T.StructField("fraud", T.IntegerType()),
])


def _delimited(sep: str):
    def read(spark: SparkSession, path: str, schema) -> DataFrame:
        r = spark.read.option("header", True).option("sep", sep)
        return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)

    return read


def _json(lines: bool):
    def read(spark: SparkSession, path: str, schema) -> DataFrame:
        r = spark.read.option("multiLine", not lines)
        return (r.schema(schema) if schema else r).json(path)

    return read


def _excel(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        import openpyxl
    except ImportError as e:
        raise NotImplementedError("reading spreadsheets needs openpyxl") from e
    rows = list(openpyxl.load_workbook(path, read_only=True).active.iter_rows(values_only=True))  # one sheet on the driver
    return spark.createDataFrame(rows[1:], schema or [str(c) for c in rows[0]])


READERS: dict[str, Callable] = {
    ".csv": _delimited(","),
    ".tsv": _delimited("\t"),
    ".jsonl": _json(True),
    ".ndjson": _json(True),
    ".json": _json(False),
    ".parquet": lambda spark, path, schema: (spark.read.schema(schema) if schema else spark.read).parquet(path),
    ".orc": lambda spark, path, schema: (spark.read.schema(schema) if schema else spark.read).orc(path),
    ".xlsx": _excel,
    ".xls": _excel,
}


def read_table(spark: SparkSession, path: str, limit: int | None = None, id_columns: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """A table by the suffix of its path. Ids are read as text, so leading zeros stay."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind not in READERS:
        raise ValueError(f"unsupported file type {kind!r}; known: {sorted(READERS)}")
    if id_columns and schema is None and kind in (".csv", ".tsv"):
        found = READERS[kind](spark, path, None).schema
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in id_columns else f.dataType) for f in found])
    df = READERS[kind](spark, path, schema)
    df = df.withColumns({c: F.col(c).cast("string") for c in id_columns if c in df.columns})
    return df if limit is None else df.limit(limit)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def load_transactions(spark: SparkSession, path: str, target: str | None = "fraud", profile: str = "static", limit: int | None = None) -> DataFrame:
    """Scan, check, and add a feature profile. Without ``target`` the table must not have one."""
    from tidemark.operators.static import add_profile

    df = read_table(spark, path, limit, ("transaction_id", "customer_id", "merchant_id", "device_id"))
    require_columns(df, ["transaction_id", "customer_id", "merchant_id", "device_id", "timestamp", "amount", *([target] if target else [])])
    if not target and "fraud" in df.columns:
        raise ValueError("a table to be scored must not have the target")
    return add_profile(df, profile)


def sampled(df: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, int]:
    """A uniform sample of ``k`` rows, the least by a random key in each partition and then of all, and the row count."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(k).drop("_r"), df.count()


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def save_frame(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV in a new folder; an existing one is an error."""
    df.write.mode("errorifexists").option("header", header).option("lineSep", "\n").csv(path)


def save_json(value, path: str, exclusive: bool = False) -> None:
    """A JSON document on the driver: into a new file, or over an old one at once."""
    text = json.dumps(value, indent=2, sort_keys=True, default=str) + "\n"
    if exclusive:
        with open(path, "x", encoding="utf-8", newline="\n") as f:
            f.write(text)
        return
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(beside, path)


def object_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A hash of the rows that doesn't depend on their order or number of partitions."""
    cols = list(columns or df.columns)
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), *cols)).alias("x")).first()
    return object_hash([r["n"], str(r["s"]), r["x"], [f"{f.name}:{f.dataType.simpleString()}" for f in df.select(*cols).schema]])


def save_predictions(df: DataFrame, path: str, ids: Sequence[str], contract: dict, row: str = "__row__", fold: str = "__fold__") -> dict:
    """Writes predictions as Parquet with a JSON sidecar of identity and coverage, after checking both."""
    from tidemark.operators.blend import check_covered

    cols = [row, *ids, fold, *sorted(c for c in df.columns if c.startswith("pred_"))]
    out = require_columns(df, cols).select(*cols)
    if fold in df.columns:
        check_covered(out)
    n = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row).alias("d")).first()
    if n["n"] != n["d"]:
        raise ValueError(f"{row} isn't unique")
    out.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    meta = {"rows": n["n"], "identity": content_hash(out, [row, *ids]), "content": content_hash(out), "contract": contract}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path.rstrip('/')}.meta")
    return meta


def read_predictions(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, dict]:
    df = spark.read.parquet(path)
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}.meta").first()["value"])
    if verify and content_hash(df) != meta["content"]:
        raise ValueError("the predictions aren't those that were saved")
    return df, meta


def build_submission(predictions: DataFrame, template: DataFrame, key: str, value: str, prediction: str = "pred_0", ordinal: str | None = None) -> DataFrame:
    """The template's ids with their predictions; both must have the same ids, once each.

    With ``ordinal`` (the template's place of each row) the result is in that order.
    """
    a, b = (d.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for d in (predictions, template))
    for d, what in ((a, "predictions"), (b, "template")):
        if d.filter("n > 1").limit(1).count():
            raise ValueError(f"an id of the {what} isn't unique")
    if a.join(b, key, "left_anti").limit(1).count() or b.join(a, key, "left_anti").limit(1).count():
        raise ValueError("predictions and template don't have the same ids")
    joined = template.select(key, *([ordinal] if ordinal else [])).join(predictions.select(key, F.col(prediction).alias(value)), key)
    bad = joined.filter(F.col(value).isNull() | F.isnan(value) | (F.col(value) < 0) | (F.col(value) > 1)).limit(1).count()
    if bad:
        raise ValueError("a prediction is missing or not a probability")
    return joined.orderBy(ordinal).select(key, value) if ordinal else joined.select(key, value)


def materialized(df: DataFrame, path: str) -> DataFrame:
    """The table from ``path`` if it was written by this function with the same schema and content hash, else written now."""
    spark = df.sparkSession
    mark = content_hash(df)
    try:
        if spark.read.text(f"{path.rstrip('/')}.manifest").first()["value"] == mark:
            return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  only a missing path means that it isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.manifest")
    return spark.read.parquet(path)
