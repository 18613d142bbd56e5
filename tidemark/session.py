"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",  # event time is microseconds since the epoch
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as a table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")  # a session without a cluster, as in tests
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/core-{uuid.uuid4().hex}/{name}"
