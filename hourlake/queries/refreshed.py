"""Stored rollups refreshed from a log of changes, however late these come."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourlake.operators import refresh, upkeep
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import plain_time, query, rounded
from hourlake.queries.stored import KEYS
from hourlake.queries.streams import _feed
from hourlake.session import shared_dir
from hourlake.streaming import rollups


def _hours(n: int):
    return F.expr(f"INTERVAL '{n}' HOUR")


def _rows(b, rollup: refresh.Rollup) -> DataFrame:
    return plain_time(rounded(refresh.read_rollup(b.spark, rollup)))


@query(
    "refreshed_hourly",
    "STR1 AGG1 SNK1",
    ctes(
        "dnow",
        """SELECT period_utc AS bucket_utc, ba_code, round(value_mwh + CASE WHEN period_utc BETWEEN now - INTERVAL 120 HOUR AND now - INTERVAL 97 HOUR THEN 100 ELSE 0 END, 4) AS avg_mwh,
 round(value_mwh + CASE WHEN period_utc BETWEEN now - INTERVAL 120 HOUR AND now - INTERVAL 97 HOUR THEN 100 ELSE 0 END, 4) AS peak_mwh,
 round(value_mwh + CASE WHEN period_utc BETWEEN now - INTERVAL 120 HOUR AND now - INTERVAL 97 HOUR THEN 100 ELSE 0 END, 4) AS trough_mwh,
 CAST(1 AS BIGINT) AS n_obs FROM demand, dnow WHERE period_utc <= now - INTERVAL 2 HOUR""",
    ),
)
def _(b):
    """The day five days back is revised: its buckets follow. A revision older than seven days and the open hour wait."""
    path, base = shared_dir(b.spark, "demand"), shared_dir(b.spark, "rollups")
    rollup = refresh.Rollup(f"{base}/hourly", f"{base}/log", "1 hour", ("ba_code",))
    t, now = F.col("period_utc"), b.demand_now
    upkeep.upsert(b.demand, path, KEYS, logs=[rollup.log])
    refresh.refresh(b.spark, path, refresh.Rollup(rollup.path, rollup.log, "1 hour", ("ba_code",), start_hours=None), now)
    revised = b.demand.where(t.between(now - _hours(120), now - _hours(97))).withColumn("value_mwh", F.col("value_mwh") + 100)
    too_old = b.demand.where(t.between(now - _hours(480), now - _hours(457))).withColumn("value_mwh", F.col("value_mwh") + 1000)
    upkeep.upsert(revised.unionByName(too_old), path, KEYS, logs=[rollup.log])
    refresh.refresh(b.spark, path, rollup, now)
    return _rows(b, rollup)


@query(
    "refreshed_daily",
    "STR2 STR4 AGG2",
    """SELECT date_trunc('day', ts) AS bucket_utc, event_type AS ba_code, round(avg(value), 4) AS avg_mwh, round(max(value), 4) AS peak_mwh,
 round(min(value), 4) AS trough_mwh, count(*) AS n_obs
 FROM (SELECT event_type, ts, value * CASE WHEN event_id % 9 = 0 THEN 3 ELSE 1 END AS value FROM events)
 WHERE date_trunc('day', ts) + INTERVAL 30 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2""",
)
def _(b):
    """Facts come as a stream, corrections of every ninth row later as a second one; the days that they touch follow."""
    path, base = shared_dir(b.spark, "facts"), shared_dir(b.spark, "rollups")
    rollup = refresh.Rollup(f"{base}/daily", f"{base}/log", "1 day", ("ba_code",), 180 * 24, 6)
    keys, now = ["period_utc", "event_id", "ba_code"], b.table("events").agg(F.max("ts").cast("timestamp")).scalar()
    feeds = [rollups.event_time(_feed(b), "period_utc")]
    feeds.append(feeds[0].where("event_id % 9 = 0").withColumn("value_mwh", F.col("value_mwh") * 3))
    for feed in feeds:
        rollups.stream_upsert(feed, path, keys, shared_dir(b.spark, "checkpoint"), logs=[rollup.log])
        refresh.refresh(b.spark, path, rollup, now)
    return _rows(b, rollup)


@query(
    "refreshed_generation",
    "STR3 AGG3 SNK7",
    ctes(
        "generation snow",
        """SELECT period_utc AS bucket_utc, ba_code, fuel_code, round(sum(value_mwh), 4) AS total_mwh FROM generation, snow
 WHERE NOT (fuel_code = 'COL' AND period_utc > now - INTERVAL 720 HOUR) AND period_utc + INTERVAL 2 HOUR <= now GROUP BY 1, 2, 3""",
    ),
)
def _(b):
    """One fuel's last 30 days are deleted: its buckets leave the rollup."""
    path, base = shared_dir(b.spark, "generation"), shared_dir(b.spark, "rollups")
    keys = ["period_utc", "ba_code", "fuel_code"]
    rollup = refresh.Rollup(f"{base}/generation", f"{base}/log", "1 hour", ("ba_code", "fuel_code"), None, 1, total=True)
    now = b.shipped_now
    upkeep.upsert(b.generation, path, keys, grain="month", logs=[rollup.log])
    refresh.refresh(b.spark, path, rollup, now, "month", "month")
    recent = (F.col("fuel_code") == "COL") & (F.col("period_utc") > now - _hours(720))
    upkeep.purge(b.spark, path, recent, "m", [rollup.log], keys)
    refresh.refresh(b.spark, path, rollup, now, "month", "month")
    return plain_time(rounded(refresh.read_rollup(b.spark, rollup, "month")))
