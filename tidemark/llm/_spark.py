"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []  # folders of this driver
ARROW_ROWS = 512  # rows in an Arrow batch: with texts of up to some MB a batch still fits a worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts vary in length by a factor of thousands; keep Arrow batches to few rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        # a session without a cluster, as in tests
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(top)
    _made.append(f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> int:
    """Deletes what this driver's operators have written to the shared folder so far; results not yet read are lost. How many folders that were."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _made]
    _made.clear()
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in paths)


def comparable(df: DataFrame) -> list:
    """The columns of ``df`` to hash or sort by, those of a type that has neither as JSON."""
    odd = {f.name for f in df.schema.fields if any(t in f.dataType.simpleString() for t in ("map<", "variant"))}
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if c in odd else F.col(f"`{c}`") for c in df.columns]


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of ``df``, written once as a table in the shared folder (in a part for each value of its last column ``by``): lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixed_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
