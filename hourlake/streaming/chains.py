"""Rollups of rollups over streams: the source is read once, each level has a watermark of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hourlake.streaming.rollups import event_time, read_feed, stream_to_table

BUCKET = "bucket_utc"


@dataclass(frozen=True)
class Level:
    """One rollup of a chain: the width of its buckets, how long it waits for late rows, and where it is stored."""

    width: str
    watermark: str
    path: str
    checkpoint: str


def first_level(sdf: DataFrame, level: Level, keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh") -> DataFrame:
    """Sums, counts and extremes per bucket and key: what later levels can add up."""
    rows = event_time(sdf, time_col).withWatermark(time_col, level.watermark)
    return _bucketed(
        rows, F.window(time_col, level.width), keys,
        F.sum(value_col).alias("total"), F.count(value_col).alias("n_values"), F.count(F.lit(1)).alias("n_obs"),
        F.max(value_col).alias("peak"), F.min(value_col).alias("trough"),
    )


def next_level(rollup: DataFrame, level: Level, keys: list[str]) -> DataFrame:
    """A wider rollup of a rollup. Means stay weighted, as sums and counts are added up."""
    rows = rollup.withWatermark(BUCKET, level.watermark)
    return _bucketed(
        rows, F.window(BUCKET, level.width), keys,
        F.sum("total").alias("total"), F.sum("n_values").alias("n_values"), F.sum("n_obs").alias("n_obs"),
        F.max("peak").alias("peak"), F.min("trough").alias("trough"),
    )


def _bucketed(rows: DataFrame, window, keys: list[str], *measures) -> DataFrame:
    names = ["total", "n_values", "n_obs", "peak", "trough"]
    return rows.groupBy(window.alias("w"), *keys).agg(*measures).select(F.col("w.start").alias(BUCKET), *keys, *names)


def run_chain(
    sdf: DataFrame, levels: list[Level], keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh", trigger: str | None = None
) -> list[StreamingQuery]:
    """Store every level's final buckets, exactly once and across restarts.

    The first level reads the source; each other one reads the table that the level before appends to, whose
    log of complete files keeps it from seeing a bucket twice. Without ``trigger`` each level runs over all that
    is there before the next begins.
    """
    spark: SparkSession = sdf.sparkSession
    queries, frame = [], first_level(sdf, levels[0], keys, time_col, value_col)
    for k, level in enumerate(levels):
        if k:
            before = levels[k - 1]
            frame = next_level(read_feed(spark, before.path, schema), level, keys)
        schema = frame.schema
        queries.append(stream_to_table(frame, level.path, level.checkpoint, trigger))
    return queries


def with_means(rollup: DataFrame) -> DataFrame:
    """A stored level with the mean of its values."""
    return rollup.withColumn("avg", F.try_divide("total", "n_values"))
