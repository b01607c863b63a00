"""Name -> (query, oracle SQL). Importing the query modules fills the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corredor.queries.bindings import Warehouse, warehouse
from corredor.queries.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: doubles to six digits, 64-bit integers, ISO text for times."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            col = F.substring(col.cast("string"), 1, 19)
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    """Register ``fn(warehouse)`` under ``name`` with its oracle."""

    def register(fn: Callable[[Warehouse], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(warehouse(spark, sf_dir)))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn

    return register


def load_all() -> None:
    from corredor.queries import assertions, core, decisions, ingestion, models, streams  # noqa: F401
