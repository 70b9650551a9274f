"""What a target lacks: holes of its keys, ranges to load, and where the next load begins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlake.functions.times import bucket_start
from hourlake.operators import upkeep
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query
from hourlake.session import shared_dir
from hourlake.sources import tables

HOLES = {
    "h": "SELECT DISTINCT user_id, date_trunc('hour', ts) AS t FROM events",
    "r": "SELECT min(t) AS lo, max(t) + INTERVAL 1 HOUR AS hi FROM h",
    "marks": """SELECT user_id, t FROM h UNION ALL SELECT DISTINCT user_id, lo - INTERVAL 1 HOUR FROM h, r
 UNION ALL SELECT DISTINCT user_id, hi FROM h, r""",
    "n": "SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM marks",
    "holes": """SELECT user_id, t + INTERVAL 1 HOUR AS from_utc, nx AS to_utc, date_diff('hour', t, nx) - 1 AS hours FROM n
 WHERE nx > t + INTERVAL 1 HOUR""",
}
RANGES = {
    **HOLES,
    "o": """SELECT *, CASE WHEN from_utc <= max(to_utc) OVER (PARTITION BY user_id ORDER BY from_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 2 HOUR
 THEN 0 ELSE 1 END AS opens FROM holes""",
    "g": "SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY from_utc) AS g FROM o",
}


def _holes(b):
    """Each user's hours without an event, from the first hour of the table to its last."""
    hours = b.table("events").select("user_id", bucket_start("ts", "1 hour").alias("period_utc"))
    span = hours.agg(F.struct(F.min("period_utc").alias("lo"), (F.max("period_utc") + F.expr("INTERVAL '1' HOUR")).alias("hi"))).scalar()
    return tables.missing_ranges(hours, ["user_id"], span["lo"], span["hi"])


@query("missing_ranges", "SRC11", ctes("", "SELECT * FROM holes", **HOLES))
def _(b):
    return _holes(b)


@query(
    "ranges_to_load",
    "SRC11",
    ctes(
        "",
        """SELECT user_id, min(from_utc) - INTERVAL 3 HOUR AS from_utc, max(to_utc) AS to_utc, count(*) AS holes FROM g GROUP BY user_id, g""",
        **RANGES,
    ),
)
def _(b):
    """Holes that lie up to two hours apart are one range, which begins three hours early."""
    return tables.fetch_ranges(_holes(b), ["user_id"], join_hours=2, overlap_hours=3)


@query(
    "catchup_from_store",
    "SRC11 SNK2",
    """SELECT greatest(max(date_trunc('hour', ts)) - INTERVAL 3 HOUR, max(date_trunc('hour', ts)) + INTERVAL 20 HOUR - INTERVAL 168 HOUR) AS start_utc,
 max(date_trunc('hour', ts)) AS last_period_utc FROM events""",
)
def _(b):
    """The next load's start from the newest partitions of a stored target."""
    path = shared_dir(b.spark, "demand")
    upkeep.append_rows(b.demand, path)
    now = b.demand_now + F.expr("INTERVAL '20' HOUR")
    return tables.catchup_start(path, now, spark=b.spark)
