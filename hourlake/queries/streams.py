"""Streams over the events table, run until all input is consumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourlake.operators import upkeep
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import plain_time, query, rounded
from hourlake.session import shared_dir
from hourlake.streaming import rollups

CLOSED = "WHERE bucket_utc + INTERVAL 1 {unit} <= (SELECT max(ts) FROM events) - INTERVAL {delay} HOUR"


def _rollup_sql(unit: str, delay: int | None) -> str:
    body = f"""SELECT date_trunc('{unit}', ts) AS bucket_utc, event_type AS ba_code, round(avg(value), 9) AS avg_mwh,
 max(value) AS peak_mwh, min(value) AS trough_mwh, count(*) AS n_obs FROM events GROUP BY 1, 2"""
    return body if delay is None else f"SELECT * FROM ({body}) {CLOSED.format(unit=unit.upper(), delay=delay)}"


def _feed(b) -> DataFrame:
    path = f"{b.sf_dir}/events.parquet"
    schema = b.table("events").schema
    folder = upkeep.is_folder(b.spark, path)
    feed = rollups.read_feed(b.spark, path if folder else b.sf_dir, schema, glob=None if folder else "events.parquet")
    return feed.select("event_id", F.col("ts").alias("period_utc"), F.col("event_type").alias("ba_code"), F.col("value").alias("value_mwh"))


@query("stream_hourly_final", "STR1 SRC12 STR7", _rollup_sql("hour", 1))
def _(b):
    path = shared_dir(b.spark, "hourly")
    rollups.stream_to_table(rollups.stream_rollup(_feed(b), "1 hour", "1 hour", ["ba_code"]), path, shared_dir(b.spark, "checkpoint"))
    return plain_time(rounded(b.spark.read.parquet(path), 9))


@query("stream_daily_final", "STR2", _rollup_sql("day", 6))
def _(b):
    path = shared_dir(b.spark, "daily")
    rollups.stream_to_table(rollups.stream_rollup(_feed(b), "1 day", "6 hours", ["ba_code"]), path, shared_dir(b.spark, "checkpoint"))
    return plain_time(rounded(b.spark.read.parquet(path), 9))


@query("stream_daily_live", "STR2 STR4", _rollup_sql("day", None))
def _(b):
    """Every change upserted, so the open day is there as well."""
    path = shared_dir(b.spark, "daily")
    live = rollups.stream_rollup(_feed(b), "1 day", "6 hours", ["ba_code"])
    rollups.stream_upsert(live, path, ["bucket_utc", "ba_code"], shared_dir(b.spark, "checkpoint"), time_col="bucket_utc", output_mode="update")
    return plain_time(rounded(b.spark.read.parquet(path).drop(upkeep.DATE_COL), 9))


@query(
    "stream_generation_hourly",
    "STR3",
    f"""SELECT bucket_utc, ba_code, round(total_mwh, 9) AS total_mwh FROM (SELECT date_trunc('hour', ts) AS bucket_utc, event_type AS ba_code,
 sum(value) AS total_mwh FROM events GROUP BY 1, 2) {CLOSED.format(unit="HOUR", delay=1)}""",
)
def _(b):
    path = shared_dir(b.spark, "generation")
    rollups.stream_to_table(rollups.stream_rollup_sum(_feed(b), "1 hour", "1 hour", ["ba_code"]), path, shared_dir(b.spark, "checkpoint"))
    return plain_time(rounded(b.spark.read.parquet(path), 9))


LAST_PER_HOUR = """SELECT date_trunc('hour', ts) AS period_utc, event_type AS ba_code, arg_max(value, ts) AS value_mwh FROM events GROUP BY 1, 2"""


def _revisions(b) -> DataFrame:
    """Readings of an hour as revisions of one row, the latest one valid."""
    feed = rollups.event_time(_feed(b), "period_utc").withColumnRenamed("period_utc", "seen_at")
    return feed.select(F.window("seen_at", "1 hour")["start"].alias("period_utc"), "ba_code", "value_mwh", "seen_at")


@query("stream_revisions", "STR4 STR5 SNK1", LAST_PER_HOUR)
def _(b):
    """The feed is delivered twice, the second time from the start."""
    path = shared_dir(b.spark, "readings")
    for _ in range(2):
        rollups.stream_upsert(_revisions(b), path, ["period_utc", "ba_code"], shared_dir(b.spark, "checkpoint"), order_col="seen_at")
    return plain_time(b.spark.read.parquet(path).select("period_utc", "ba_code", "value_mwh"))


@query("stream_deduplicated", "STR5", "SELECT event_type AS ba_code, count(*) AS n, round(sum(value), 4) AS mwh FROM events GROUP BY 1")
def _(b):
    """Every row is delivered twice and kept once."""
    path = shared_dir(b.spark, "unique")
    twice = _feed(b).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    rollups.stream_to_table(rollups.stream_dedup(twice, ["event_id"], "period_utc", "1 hour"), path, shared_dir(b.spark, "checkpoint"))
    out = b.spark.read.parquet(path).groupBy("ba_code").agg(F.count(F.lit(1)).alias("n"), F.sum("value_mwh").alias("mwh"))
    return rounded(out)


@query(
    "stream_into_mart",
    "STR6 SNK3",
    ctes(
        "",
        """SELECT period_utc, ba_code, value_mwh FROM old WHERE period_utc <= now - INTERVAL 36 HOUR
 UNION ALL SELECT period_utc, ba_code, value_mwh FROM latest WHERE period_utc > now - INTERVAL 36 HOUR""",
        latest=LAST_PER_HOUR,
        old="SELECT *, max(period_utc) OVER () AS now FROM (SELECT period_utc, ba_code, -1.0 AS value_mwh FROM latest)",
    ).replace("FROM latest WHERE", "FROM latest, (SELECT max(period_utc) AS now FROM latest) m WHERE"),
)
def _(b):
    """A mart that holds stale values meets the feed: the last 36 hours are replaced."""
    path = shared_dir(b.spark, "mart")
    keys = ["period_utc", "ba_code"]
    hour = F.window("ts", "1 hour")["start"].cast("timestamp")
    stale = b.table("events").select(hour.alias("period_utc"), F.col("event_type").alias("ba_code")).distinct()
    upkeep.upsert(stale.select(*keys, F.lit(-1.0).alias("value_mwh"), F.lit(None).cast("timestamp").alias("seen_at")), path, keys)
    rollups.stream_incremental(_revisions(b), path, keys, shared_dir(b.spark, "checkpoint"), order_col="seen_at")
    return plain_time(b.spark.read.parquet(path).select(*keys, "value_mwh"))
