"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hourlake.queries.bindings import Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(bound)`` under ``name``; ``ids`` lists the inventory entries it exercises."""

    def add(fn: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Bound(spark, sf_dir))
        COVERS[name] = ids.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """All doubles rounded, so that the order of a sum does not show."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns])


def plain_time(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns as zone-less ones, as in the test tables."""
    times = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in df.columns])
