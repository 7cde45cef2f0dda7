"""Registry of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom.plans.oracle import compose
from stockloom.plans.workspace import Workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over a workspace and, where SQL can express it, its check."""

    def add(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = compose(sql)
        return fn

    return add


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, so every client reads the same values."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            out[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out) if out else df


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_dates(QUERIES[name](Workspace.from_star(spark, sf_dir)))


@lru_cache(maxsize=1)
def load_all() -> None:
    """Import every module that registers queries."""
    from stockloom.plans import queries_core, queries_stock, queries_sales, queries_recommend, queries_memory, queries_actions, queries_answers, queries_streaming  # noqa: F401
