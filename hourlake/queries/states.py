"""Sketches in stored rollups, state that knows revisions, chained streams, drifting payloads."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from hourlake.operators import sketches, upkeep
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import plain_time, query, rounded
from hourlake.queries.streams import LAST_PER_HOUR, _feed
from hourlake.session import shared_dir
from hourlake.sources import drift
from hourlake.streaming import chains, revisions, rollups


@query(
    "quantiles_from_rollups",
    "AGG4 AGG1 AGG2",
    ctes(
        "demand dnow",
        """SELECT '72 h' AS span, ba_code, count(*) AS n_obs, round(avg(value_mwh), 4) AS avg_mwh, round(quantile_disc(value_mwh, 0.95), 4) AS p95, true AS near
 FROM demand, dnow WHERE period_utc >= now - INTERVAL 72 HOUR GROUP BY 2
 UNION ALL SELECT '720 h', event_type, count(*), round(avg(value), 4), NULL, true FROM events
 WHERE date_trunc('hour', ts) >= (SELECT max(date_trunc('hour', ts)) FROM events) - INTERVAL 720 HOUR GROUP BY 2""",
    ),
)
def _(b):
    """The 95th percentile of three days and of thirty from stored hourly sketches; of single readings its
    rank is compared with the exact one."""
    base = shared_dir(b.spark, "sketches")
    readings = b.table("events").select(F.col("ts").alias("period_utc"), F.col("event_type").alias("ba_code"), F.col("value").alias("value_mwh"))
    for name, df in (("hours", b.demand), ("readings", readings)):
        upkeep.upsert(sketches.sketch_rollup(df, "1 hour", ["ba_code"]), f"{base}/{name}", ["bucket_utc", "ba_code"], "bucket_utc")
    hours, fine = (b.spark.read.parquet(f"{base}/{name}") for name in ("hours", "readings"))
    short = sketches.window_quantiles(hours, ["ba_code"], {"p95": 0.95}, 72)
    long = sketches.window_quantiles(fine, ["ba_code"], {"p95": 0.95}, 720)
    at_most = F.count_if(F.col("value_mwh") <= F.col("p95")) / F.max("n_obs")
    below = F.count_if(F.col("value_mwh") < F.col("p95")) / F.max("n_obs")
    start = b.demand_now - F.expr("INTERVAL '720' HOUR")
    off = sketches.rank_error()
    ranks = readings.where(F.col("period_utc") >= start).join(long, "ba_code").groupBy("ba_code").agg(((at_most >= 0.95 - off) & (below <= 0.95 + off)).alias("near"))
    long = long.join(ranks, "ba_code").withColumn("p95", F.lit(None).cast("double"))
    both = short.withColumn("near", F.lit(True)).withColumn("span", F.lit("72 h")).unionByName(long.withColumn("span", F.lit("720 h")))
    return rounded(both.select("span", "ba_code", "n_obs", F.col("avg").alias("avg_mwh"), "p95", "near"))


@query("stream_latest_revisions", "STR4 STR5", LAST_PER_HOUR)
def _(b):
    """Readings as revisions of their hour, landed in files of no order, one micro-batch each: the latest counts."""
    landed, path = shared_dir(b.spark, "landed"), shared_dir(b.spark, "latest")
    events = b.table("events").select("event_id", "ts", F.col("event_type").alias("ba_code"), F.col("value").alias("value_mwh"))
    events.repartition(4, "event_id").write.parquet(landed)
    feed = rollups.event_time(rollups.read_feed(b.spark, landed, events.schema, max_files=1), "ts")
    rows = feed.select(F.window("ts", "1 hour")["start"].alias("period_utc"), "ba_code", "ts", "value_mwh")
    revisions.stream_latest(rows, path, ["period_utc", "ba_code"], "ts", shared_dir(b.spark, "checkpoint"), "60 days")
    return plain_time(b.spark.read.parquet(path).select("period_utc", "ba_code", "value_mwh"))


CHAIN_SQL = """WITH hours AS (SELECT date_trunc('hour', ts) AS bucket_utc, event_type AS ba_code, sum(value) AS total, count(*) AS n_obs, max(value) AS peak, min(value) AS trough
 FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
 days AS (SELECT date_trunc('day', bucket_utc) AS bucket_utc, ba_code, sum(total) AS total, CAST(sum(n_obs) AS BIGINT) AS n_obs, max(peak) AS peak, min(trough) AS trough
 FROM hours GROUP BY 1, 2 HAVING date_trunc('day', bucket_utc) + INTERVAL 24 HOUR <= (SELECT max(bucket_utc) FROM hours) - INTERVAL 6 HOUR)
 SELECT 'hour' AS width, bucket_utc, ba_code, round(total / n_obs, 6) AS avg, n_obs, peak, trough FROM hours
 UNION ALL SELECT 'day', bucket_utc, ba_code, round(total / n_obs, 6), n_obs, peak, trough FROM days"""


@query("stream_chain", "STR1 STR2 STR7", CHAIN_SQL)
def _(b):
    """Hours and, from these, days: two sinks of one read of the source."""
    base = shared_dir(b.spark, "chain")
    levels = [chains.Level(w, late, f"{base}/{n}", f"{base}/checkpoint-{n}") for n, w, late in (("hour", "1 hour", "1 hour"), ("day", "1 day", "6 hours"))]
    chains.run_chain(_feed(b), levels, ["ba_code"])
    parts = [chains.with_means(b.spark.read.parquet(x.path)).withColumn("width", F.lit(n)) for x, n in zip(levels, ("hour", "day"), strict=True)]
    both = parts[0].unionByName(parts[1])
    return plain_time(rounded(both.select("width", "bucket_utc", "ba_code", "avg", "n_obs", "peak", "trough"), 6))


@query(
    "drifting_payloads",
    "SRC1 SRC8 NRM3 SNK8",
    """SELECT CASE event_type WHEN 'error' THEN 'not json' WHEN 'signup' THEN 'type of value' WHEN 'purchase' THEN 'not an object' ELSE 'ok' END AS reason, event_type,
 CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN event_type IN ('view', 'click') THEN value END), 4) AS total,
 CAST(sum(CASE WHEN event_type = 'click' THEN user_id END) AS BIGINT) AS zones, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS texts
 FROM events GROUP BY 1, 2""",
)
def _(b):
    """Files in which one kind of event has an added field, one a changed type, one is no object and one is broken."""
    landed = shared_dir(b.spark, "landed")
    fields = ["event_id", "event_type", "value"]
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.to_json(F.struct(*fields, F.struct(F.col("user_id").alias("zone")).alias("site"))))
        .when(kind == "signup", F.to_json(F.struct("event_id", "event_type", F.lit("n/a").alias("value"))))
        .when(kind == "purchase", F.concat(F.lit('["'), kind, F.lit('"]')))
        .when(kind == "error", F.concat(F.lit('{"event_type":"error","value":'), F.col("value").cast("string")))
        .otherwise(F.to_json(F.struct(*fields)))
    )
    b.table("events").select(line.alias("value"), kind).write.partitionBy("event_type").text(landed)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    stored = shared_dir(b.spark, "records")
    drift.parse_records(drift.read_records(b.spark, landed), schema).write.parquet(stored)
    rows = b.spark.read.parquet(stored)
    reason = F.coalesce("broken", F.when(F.size("drifted") > 0, F.concat(F.lit("type of "), F.col("drifted")[0])), F.lit("ok"))
    name = F.regexp_extract("file", "event_type=([a-z]+)", 1)
    return rounded(
        rows.groupBy(reason.alias("reason"), name.alias("event_type")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("value").alias("total"),
            F.sum(drift.field("site.zone", "bigint")).alias("zones"),
            F.count(F.when(F.size("drifted") > 0, drift.field("value", "string"))).alias("texts"),
        )
    )
