"""Stored rollups that follow every change of their facts, however late it comes.

Writers of the facts note the keys and times of what they change in a log (``upkeep.upsert(logs=...)``,
``upkeep.purge(logs=...)``, ``stream_upsert(logs=...)``), one log per rollup. A refresh recomputes exactly
the buckets that the log names between two ages, and swaps their partitions in. Entries outside those
ages stay in the log for a later or a wider refresh. Nothing but dates and counters comes to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourlake.functions.times import anchor, bucket_start, interval_hours
from hourlake.operators import rollups, upkeep
from hourlake.operators.filters import DATE_COL

BUCKET = "bucket_utc"


@dataclass(frozen=True)
class Rollup:
    """A rollup of stored facts: average, peak, trough and count per bucket and key, or with ``total`` the sum.

    A refresh covers whole buckets that begin at most ``start_hours`` and end at least ``end_hours`` before
    the given time; None leaves that side open. ``where`` limits the facts that count.
    """

    path: str
    log: str
    width: str
    keys: tuple[str, ...]
    start_hours: int | None = 168
    end_hours: int | None = 1
    total: bool = False
    where: str | None = None
    time_col: str = "period_utc"
    value_col: str = "value_mwh"

    def of(self, facts: DataFrame) -> DataFrame:
        """The rollup of ``facts``."""
        make = rollups.rollup_sum if self.total else rollups.rollup
        rows = facts.where(self.where) if self.where else facts
        return make(rows, self.width, list(self.keys), self.time_col, self.value_col)


def log_batches(spark: SparkSession, log: str) -> list[str]:
    """The batches of a log that are complete."""
    if not upkeep.exists(spark, log):
        return []
    fs, p = upkeep._folder(spark, log)
    folders = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]
    return sorted(f for f in folders if upkeep.exists(spark, f"{f}/_SUCCESS"))


def invalidate(facts: DataFrame, rollup: Rollup, logs: Sequence[str] | None = None) -> None:
    """Note all of ``facts`` as changed: for facts that were stored without a log, or to rebuild a range."""
    upkeep.log_changes(facts, logs or [rollup.log], [rollup.time_col, *rollup.keys])


def _end(bucket: Column, width: str) -> Column:
    return bucket + F.expr(f"INTERVAL '{width}'")


def touched_buckets(spark: SparkSession, batches: list[str], rollup: Rollup, now) -> tuple[DataFrame, DataFrame]:
    """(buckets to recompute, log entries to keep) of some batches of the log."""
    entries = spark.read.parquet(*batches).select(rollup.time_col, *rollup.keys)
    bucket = bucket_start(rollup.time_col, rollup.width)
    inside = F.lit(True)
    if rollup.start_hours is not None:
        inside = inside & (bucket >= anchor(entries, rollup.time_col, now) - interval_hours(rollup.start_hours))
    if rollup.end_hours is not None:
        inside = inside & (_end(bucket, rollup.width) <= anchor(entries, rollup.time_col, now) - interval_hours(rollup.end_hours))
    return entries.where(inside).select(bucket.alias(BUCKET), *rollup.keys).distinct(), entries.where(~inside)


def facts_of(spark: SparkSession, facts_path: str, touched: DataFrame, rollup: Rollup, grain: str = "day") -> DataFrame:
    """The stored facts of ``touched`` buckets. Their dates are read first, so that only those partitions are opened."""
    last = _end(F.col(BUCKET), rollup.width) - F.expr("INTERVAL '1' MICROSECOND")
    days = touched.select(F.explode(F.sequence(F.to_date(BUCKET), F.to_date(last))).alias("day"))
    if grain == "month":
        days = days.select(F.trunc("day", "month").alias("day"))
    part = upkeep.partition_col(grain)
    facts = spark.read.parquet(facts_path)
    pruned = facts.where(F.col(part).isin([r["day"] for r in days.distinct().collect()])).drop(part)
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in rollup.keys]
    marked = pruned.withColumn("_bucket", bucket_start(rollup.time_col, rollup.width)).alias("f")
    on = F.col("f._bucket") == F.col(f"t.{BUCKET}")
    for condition in same:
        on = on & condition
    return marked.join(touched.alias("t"), on, "left_semi").drop("_bucket")


def refresh(spark: SparkSession, facts_path: str, rollup: Rollup, now=None, grain: str = "day", rollup_grain: str = "day") -> int:
    """Recompute the buckets that the log names and return their number.

    ``now`` is a time, or a Column such as a scalar subquery; without it the latest time in the log counts. ``grain``
    is that of the facts' partitions, ``rollup_grain`` that of the rollup's. A bucket whose facts are all gone is
    removed. Only partitions with such buckets are rewritten. The log's batches are cleared after the swap: a
    run lost in between repeats the same buckets.
    """
    upkeep.recover(spark, rollup.path)
    upkeep.recover(spark, facts_path)
    batches = log_batches(spark, rollup.log)
    if not batches:
        return 0
    inside, outside = touched_buckets(spark, batches, rollup, now)
    work = upkeep.beside(rollup.path, f"touched-{uuid.uuid4().hex}")
    part = upkeep.partition_col(rollup_grain)
    try:
        upkeep.with_date(inside, BUCKET, rollup_grain).write.partitionBy(part).parquet(work)
        dates = upkeep.stored_dates(spark, work, part)
        n = 0
        if dates:
            touched = spark.read.parquet(work)
            n = touched.count()
            _replace(spark, facts_path, touched, dates, rollup, grain, rollup_grain)
        kept = outside.isEmpty()
        if not kept:
            outside.distinct().write.parquet(f"{rollup.log}/batch={uuid.uuid4().hex}")
        for b in batches:
            upkeep.remove_folder(spark, b)
    finally:
        upkeep.remove_folder(spark, work)
    return n


def _replace(spark: SparkSession, facts_path: str, touched: DataFrame, dates: list, rollup: Rollup, grain: str, rollup_grain: str) -> None:
    """Swap in the partitions of ``dates`` with the touched buckets recomputed."""
    part = upkeep.partition_col(rollup_grain)
    fresh = upkeep.with_date(rollup.of(facts_of(spark, facts_path, touched.drop(part), rollup, grain)), BUCKET, rollup_grain)
    if not upkeep.exists(spark, rollup.path):
        upkeep.commit(spark, [upkeep.stage(fresh, rollup.path, part, [BUCKET, *rollup.keys], whole=True)])
        return
    old = spark.read.parquet(rollup.path).where(F.col(part).isin(dates))
    on = F.col(f"o.{BUCKET}") == F.col(f"t.{BUCKET}")
    for k in rollup.keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}"))
    content = old.alias("o").join(touched.alias("t"), on, "left_anti").unionByName(fresh)
    swap = upkeep.stage(content, rollup.path, part, [BUCKET, *rollup.keys])
    left = set(upkeep.stored_dates(spark, swap.staged, part))
    gone = tuple(upkeep._part_name(part, d) for d in dates if d not in left)
    upkeep.commit(spark, [upkeep.Swap(swap.staged, swap.path, False, gone)])


def read_rollup(spark: SparkSession, rollup: Rollup, rollup_grain: str = "day") -> DataFrame:
    return spark.read.parquet(rollup.path).drop(upkeep.partition_col(rollup_grain) if rollup_grain else DATE_COL)
