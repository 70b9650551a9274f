"""Streaming rollups and upserts.

Streams need event time as TIMESTAMP, so zone-less columns are cast under the session zone UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hourlake.functions.times import time_literal
from hourlake.operators import upkeep


def read_feed(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None, glob: str | None = None
) -> DataFrame:
    """Landed files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def event_time(sdf: DataFrame, time_col: str) -> DataFrame:
    return sdf.withColumn(time_col, F.col(time_col).cast("timestamp"))


def stream_rollup(sdf: DataFrame, width: str, watermark: str, keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh") -> DataFrame:
    """Average, peak, trough and count per bucket and key over a stream.

    In ``append`` mode a bucket comes out once it is final, in ``update`` mode whenever it changes.
    State is bounded by the watermark: buckets leave it when they are final.
    """
    return (
        event_time(sdf, time_col)
        .withWatermark(time_col, watermark)
        .groupBy(F.window(time_col, width), *keys)
        .agg(
            F.avg(value_col).alias("avg_mwh"),
            F.max(value_col).alias("peak_mwh"),
            F.min(value_col).alias("trough_mwh"),
            F.count(F.lit(1)).alias("n_obs"),
        )
        .select(F.col("window.start").alias("bucket_utc"), *keys, "avg_mwh", "peak_mwh", "trough_mwh", "n_obs")
    )


def stream_rollup_sum(sdf: DataFrame, width: str, watermark: str, keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh") -> DataFrame:
    return (
        event_time(sdf, time_col)
        .withWatermark(time_col, watermark)
        .groupBy(F.window(time_col, width), *keys)
        .agg(F.sum(value_col).alias("total_mwh"))
        .select(F.col("window.start").alias("bucket_utc"), *keys, "total_mwh")
    )


def stream_dedup(sdf: DataFrame, id_cols: list[str], time_col: str, watermark: str) -> DataFrame:
    """Repeated deliveries of unchanging rows dropped; ids are remembered for the watermark only."""
    return event_time(sdf, time_col).withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(id_cols)


def run_stream(writer: DataStreamWriter, trigger: str | None = None) -> StreamingQuery:
    """Start a query: every ``trigger`` (such as ``'15 minutes'``), or once over all that is there.

    The latter waits for the end and raises what went wrong.
    """
    if trigger:
        return writer.trigger(processingTime=trigger).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_to_table(sdf: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append a stream's final rows to a Parquet folder, exactly once.

    ``checkpoint`` is where the stream goes on after a restart: the same path each time, one per table.
    """
    writer = (
        sdf.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return run_stream(writer, trigger)


def stream_upsert(
    sdf: DataFrame,
    path: str,
    keys: list[str],
    checkpoint: str,
    time_col: str = "period_utc",
    order_col: str | None = None,
    trigger: str | None = None,
    output_mode: str = "append",
    logs: Sequence[str] = (),
    grain: str = "day",
) -> StreamingQuery:
    """Upsert every micro-batch by key. Delivering rows again has no effect, a revision replaces
    what it revises, and a batch repeated after a failure gives the same table. What really changes is noted in
    ``logs``, for rollups that are refreshed from them."""

    def write(batch: DataFrame, _: int) -> None:
        upkeep.upsert(batch, path, keys, time_col, order_col, grain=grain, logs=logs)

    writer = (
        sdf.writeStream.outputMode(output_mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return run_stream(writer, trigger)


def stream_incremental(
    sdf: DataFrame,
    path: str,
    keys: list[str],
    checkpoint: str,
    late_hours: int = upkeep.LATE_HOURS,
    time_col: str = "period_utc",
    order_col: str | None = None,
    trigger: str | None = None,
    on_late: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Feed a mart from a stream; facts later than ``late_hours`` behind the stored maximum stay out,
    as they do in the batch refresh. ``on_late`` is told after each batch how many that were."""

    def write(batch: DataFrame, _: int) -> None:
        start, late = upkeep.refresh_start(batch.sparkSession, path, late_hours, time_col), Observation()
        if start is not None:
            bound = time_literal(start, batch.schema[time_col].dataType)
            batch = batch.observe(late, F.count_if(F.col(time_col) <= bound).alias("n")).where(F.col(time_col) > bound)
        upkeep.upsert(batch, path, keys, time_col, order_col)
        if on_late:
            on_late(upkeep.observed(late) if start is not None else 0)

    return run_stream(sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)
