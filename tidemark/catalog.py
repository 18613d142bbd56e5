"""Registry of the engine's queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import event_us
from tidemark.operators import history
from tidemark.plans import feature_oracles as fo
from tidemark.plans import more_queries  # noqa: F401  registers its queries with the others
from tidemark.plans import queries as others
from tidemark.plans import tree_queries  # noqa: F401  likewise
from tidemark.plans import transactions
from tidemark.session import stored

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

DIGITS = 5
# Windows of hours run over the events, whose times have microseconds; all else over order lines, whose days tie.
OVER_EVENTS = ("customer_velocity_1h", "device_velocity_1h", "customer_velocity", "device_velocity", "merchant_acceleration", "temporal_habits")


def query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def _family(name: str, view) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        family = history.FAMILIES[name]
        need = [c for c in transactions.COLUMNS if c in (*family.needs, "transaction_id", "customer_id", "timestamp")]
        rows = view(spark, sf_dir).select(*need)
        if view is transactions.order_lines:
            rows = stored(rows)  # read for the count of heavy keys and for the features, joined once
        out = history.features(rows, [name])
        cols = [F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, DIGITS)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in family.columns()]
        return out.select("transaction_id", F.col("customer_id").alias("customer_key"), event_us(F.col("timestamp")).alias("us"), *cols)

    return run


for _name in history.FAMILIES:
    _events = _name in OVER_EVENTS
    query(_name, fo.family_sql(_name, fo.EVENTS if _events else fo.ORDER_LINES, DIGITS))(_family(_name, transactions.event_stream if _events else transactions.order_lines))
    if not _events and _name not in ("amount_30d",):
        query(f"{_name}_events", fo.family_sql(_name, fo.EVENTS, DIGITS))(_family(_name, transactions.event_stream))


for _name, (_fn, _sql) in others.registry().items():
    query(_name, _sql)(_fn)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES
