"""Streams of revised rows: the state keeps each key's latest revision and lets only real changes through."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hourlake.streaming.rollups import event_time, stream_upsert

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestRevision(StatefulProcessor):
    """Of a key's rows the one with the largest ``order``; ties go to the larger values.

    A row is given out if it is newer than what is remembered and differs from it. When the watermark passes the
    key's time, no revision can come any more and the state is given back.
    """

    def __init__(self, keys: list[str], time_col: str, order_col: str, values: list[str], schema: T.StructType):
        self.keys, self.order_col, self.values, self.schema = keys, order_col, values, schema
        self.time_at = keys.index(time_col)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType([self.schema[c] for c in (self.order_col, *self.values)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [self.order_col, *self.values]
        known = self.latest.get() if self.latest.exists() else None
        best = known
        for batch in rows:
            for r in batch[columns].itertuples(index=False, name=None):
                if best is None or _rank(r) > _rank(best):
                    best = r
        if best is known or (known is not None and _rank(best) <= _rank(known)):
            return
        self.latest.update(tuple(_plain(v) for v in best))
        if known is None:
            moment = pd.Timestamp(key[self.time_at])
            self.handle.registerTimer(int(moment.timestamp() * 1000))
        if known is None or [_plain(v) for v in best[1:]] != [_plain(v) for v in known[1:]]:
            change = "insert" if known is None else "update"
            yield pd.DataFrame([[*key, *best, change]], columns=[*self.keys, *columns, "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v.item() if hasattr(v, "item") else v


def _rank(row) -> tuple:
    """Order first, then the values; nulls come before all else."""
    return tuple((v is not None, 0 if v is None else v) for v in map(_plain, row))


def latest_revisions(sdf: DataFrame, keys: list[str], order_col: str, watermark: str, time_col: str = "period_utc") -> DataFrame:
    """A changelog of a stream of revisions: keys, ``order_col``, the other columns and ``change`` (insert or update).

    ``keys`` must hold ``time_col``. Repeated deliveries, older revisions after newer ones and newer ones without a new
    value give nothing. Revisions come until the watermark passes the row's own time; state is bounded by it.
    Keys and times must not be null.
    """
    if time_col not in keys:
        raise ValueError(f"keys {keys} must contain the time column {time_col}")
    spark = sdf.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = event_time(sdf, time_col)
    values = [c for c in rows.columns if c not in (*keys, order_col)]
    out = T.StructType([rows.schema[c] for c in (*keys, order_col, *values)]).add("change", "string")
    processor = LatestRevision(keys, time_col, order_col, values, rows.schema)
    return rows.withWatermark(time_col, watermark).groupBy(*keys).transformWithStateInPandas(processor, outputStructType=out, outputMode="update", timeMode="EventTime")


def stream_latest(
    sdf: DataFrame, path: str, keys: list[str], order_col: str, checkpoint: str, watermark: str, time_col: str = "period_utc", trigger: str | None = None, logs=()
) -> StreamingQuery:
    """Keep a stored table at each key's latest revision. A micro-batch without real changes rewrites nothing."""
    changes = latest_revisions(sdf, keys, order_col, watermark, time_col).drop("change")
    return stream_upsert(changes, path, keys, checkpoint, time_col, order_col, trigger, "update", logs)
