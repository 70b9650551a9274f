"""Quantiles over any window from stored rollups, by mergeable sketches.

Each bucket of a rollup carries a KLL sketch of its values, a few kilobytes whatever it has seen. The sketches of a
window are merged, so that its quantiles come from the rollup alone. The exact percentile stays the default
of ``rollups.agg_demand_recent``; this is for windows too long or too fine for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourlake.functions.times import anchor, bucket_start, interval_hours

K = 400


def rank_error(k: int = K) -> float:
    """How far the rank of a quantile may be off, as a share of the values, with 99 % confidence.

    The published fit for KLL sketches. A sketch that has seen at most ``k`` values is exact.
    """
    return 2.296 / k**0.9021


def sketch_rollup(df: DataFrame, width: str, keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh", k: int = K) -> DataFrame:
    """Count, sum, extremes and a sketch of the values per bucket and key; null values are left out."""
    known = df.where(F.col(value_col).isNotNull())
    return known.groupBy(bucket_start(time_col, width).alias("bucket_utc"), *keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(value_col).alias("total"),
        F.max(value_col).alias("peak"),
        F.min(value_col).alias("trough"),
        F.kll_sketch_agg_double(F.col(value_col).cast("double"), k).alias("sketch"),
    )


def window_quantiles(rollup: DataFrame, keys: list[str], quantiles: dict[str, float], hours: int, as_of=None) -> DataFrame:
    """Quantiles, mean, extremes and count per key over the buckets that begin in the last ``hours``.

    ``quantiles`` maps column names to shares. Each is a value of the data whose rank is at most ``rank_error`` off;
    sketches are merged in partial aggregation, so a hot key's buckets never meet whole. A bucket counts if it begins
    at ``as_of - hours`` or later; without ``as_of`` the latest bucket is the last of the window.
    """
    start = _start(rollup, hours, as_of)
    merged = (
        rollup.where(F.col("bucket_utc") >= start)
        .groupBy(*keys)
        .agg(
            F.sum("n_obs").alias("n_obs"),
            (F.sum("total") / F.sum("n_obs")).alias("avg"),
            F.max("peak").alias("peak"),
            F.min("trough").alias("trough"),
            F.kll_merge_agg_double("sketch").alias("_sketch"),
        )
    )
    found = {name: F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))) for name, q in quantiles.items()}
    return merged.withColumns(found).drop("_sketch")


def _start(rollup: DataFrame, hours: int, as_of) -> Column:
    return anchor(rollup, "bucket_utc", as_of) - interval_hours(hours)
