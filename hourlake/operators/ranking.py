"""Ordering, top-k with a rest, trailing trim and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourlake import reference_data as ref
from hourlake.operators.filters import trailing


def order_by(df: DataFrame, *specs: str) -> DataFrame:
    """Order by specs such as ``'abs(net_mwh) desc nulls last'``."""
    columns = []
    for spec in specs:
        text = spec.lower().strip()
        nulls = None
        for ending in (" nulls last", " nulls first"):
            if text.endswith(ending):
                nulls, text = ending.split()[-1], text[: -len(ending)].rstrip()
        desc = text.endswith(" desc")
        for ending in (" desc", " asc"):
            if text.endswith(ending):
                text = text[: -len(ending)].rstrip()
        c = F.expr(text)
        how = ("desc" if desc else "asc") + (f"_nulls_{nulls}" if nulls else "")
        columns.append(getattr(c, how)())
    return df.orderBy(*columns)


def last_rows(df: DataFrame, time_col: str, limit: int = 50, ties: list[str] | None = None, max_limit: int = 500) -> DataFrame:
    """The newest log rows; each task keeps its own top rows, then the tops are merged."""
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be within 1..{max_limit}, got {limit}")
    return df.orderBy(F.col(time_col).desc(), *(ties or [])).limit(limit)


def top_k(df: DataFrame, value_col: str, k: int = 10, ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(F.col(value_col).desc_nulls_last(), *(ties or [])).limit(k)


def problems(details: DataFrame, worst: str = "residual_pct", ties: list[str] | None = None) -> DataFrame:
    """The rows that did not pass, worst first."""
    return details.where(F.col("status") != "pass").orderBy(F.col(worst).desc_nulls_last(), *(ties or []))


# --- top-n and other --------------------------------------------------------------------------


def top_keys(df: DataFrame, key: str, value_col: str, n: int) -> DataFrame:
    """The n keys with the largest mean, at most n rows."""
    means = df.where(F.col(value_col).isNotNull()).groupBy(key).agg(F.avg(value_col).alias("_mean"))
    return means.orderBy(F.col("_mean").desc(), key).limit(n).select(key)


def top_n_other(
    df: DataFrame, key: str, value_col: str, n: int = ref.TOP_ZONES, time_col: str = "period_utc", other: str = ref.OTHER_LABEL
) -> DataFrame:
    """Sums per time and band, the n keys with the largest mean as bands of their own and the rest
    together in one. In long form: the set of bands depends on the data."""
    named = top_keys(df, key, value_col, n).withColumn("band", F.col(key))
    return (
        df.where(F.col(value_col).isNotNull())
        .join(named, key, "left")
        .groupBy(time_col, F.coalesce("band", F.lit(other)).alias("band"))
        .agg(F.sum(value_col).alias(value_col))
    )


def compare_wide(series: DataFrame, key: str, value_col: str, n: int = 3, time_col: str = "period_utc") -> DataFrame:
    """The n keys with the largest mean side by side: ``key_i`` and ``value_i`` per time.

    Ranks stand in for the column names, which keeps the schema fixed and needs no collect.
    """
    means = series.where(F.col(value_col).isNotNull()).groupBy(key).agg(F.avg(value_col).alias("_mean"))
    top = means.orderBy(F.col("_mean").desc(), key).limit(n)
    in_order = F.sort_array(F.collect_list(F.struct((-F.col("_mean")).alias("m"), F.col(key).alias("k"))))
    ranked = top.agg(in_order.alias("_top")).select(F.posexplode("_top").alias("_rank", "_at"))
    rows = series.join(ranked.select(F.col("_at.k").alias(key), "_rank"), key)
    columns = []
    for i in range(1, n + 1):
        mine = F.col("_rank") == i - 1
        columns += [F.max(F.when(mine, F.col(key))).alias(f"key_{i}"), F.sum(F.when(mine, F.col(value_col))).alias(f"value_{i}")]
    return rows.groupBy(time_col).agg(*columns)


def fuel_bands(share: DataFrame) -> DataFrame:
    """Which band each fuel of a share frame belongs to.

    Primary fuels always get their own. Other fuels with a presentable name and enough share follow
    by volume until the cap. Everything else, the source's own catch-all included, is "Other". The
    input has one row per fuel.
    """
    names = F.create_map(*[F.lit(x) for pair in ref.FUEL_LABELS.items() for x in pair])
    override = names[F.col("fuel_code")]
    name = F.coalesce("fuel_name", "fuel_code")
    catch_all = (F.col("fuel_code") == ref.CATCH_ALL_FUEL) | (F.lower(F.trim(name)) == ref.OTHER_LABEL.lower())
    primary = F.col("fuel_code").isin(*ref.PRIMARY_FUELS)
    presentable = override.isNotNull() | (name != F.col("fuel_code"))
    enough = F.coalesce("pct", F.lit(0.0)) >= ref.BAND_SHARE_PCT
    flagged = share.select(
        "fuel_code",
        "mwh",
        "pct",
        F.coalesce(override, name).alias("_label"),
        primary.alias("_primary"),
        (~catch_all & (primary | (presentable & enough))).alias("_eligible"),
    )
    by_rule = [F.col("_eligible").desc(), F.col("_primary").desc(), F.coalesce("mwh", F.lit(0.0)).desc(), "fuel_code"]
    chosen = flagged.where("_eligible").orderBy(*by_rule).limit(ref.MAX_NAMED_BANDS).select("fuel_code", F.lit(True).alias("_named"))
    return flagged.join(chosen, "fuel_code", "left").select(
        "fuel_code", F.when(F.col("_named"), F.col("_label")).otherwise(F.lit(ref.OTHER_LABEL)).alias("band"), "mwh", "pct"
    )


def band_series(mix: DataFrame, bands: DataFrame, time_col: str = "period_utc", value_col: str = "value_mwh") -> DataFrame:
    """Sums per time and band, ready for stacking."""
    return (
        mix.where(F.col(value_col).isNotNull())
        .join(bands.select("fuel_code", "band"), "fuel_code", "left")
        .groupBy(time_col, F.coalesce("band", F.lit(ref.OTHER_LABEL)).alias("band"))
        .agg(F.sum(value_col).alias(value_col))
    )


def band_shares(bands: DataFrame) -> DataFrame:
    return bands.groupBy("band").agg(F.sum(F.coalesce("pct", F.lit(0.0))).alias("pct"))


# --- trailing trim ----------------------------------------------------------------------------


def incomplete_tail(
    buckets: DataFrame,
    time_col: str,
    count_col: str,
    value_col: str,
    group: list[str] | None = None,
    max_trim: int = 3,
    hours: int | None = None,
    as_of=None,
) -> DataFrame:
    """Per series the time from which trailing buckets count as incomplete, and how many there are.

    A trailing bucket is incomplete when it has under 0.9 of the median contributor count or under
    0.6 of the median value. Only the unbroken run at the end counts, at most ``max_trim`` buckets
    and never so many that fewer than two stay. Series of under four buckets and series with a
    median of zero or less are left alone (null time). The input holds one row per bucket. ``hours`` takes the
    medians over that many before ``as_of`` (default: the latest bucket); without it over all. Of each
    series only the last ``max_trim`` buckets are looked at one by one.
    """
    group = group or ["_all"]
    if group == ["_all"]:
        buckets = buckets.withColumn("_all", F.lit(1))
    if hours is not None:
        buckets = trailing(buckets, time_col, hours, as_of, max_hours=hours)
    stats = buckets.groupBy(*group).agg(F.median(count_col).alias("_mc"), F.median(value_col).alias("_mv"), F.count(F.lit(1)).alias("_n"))
    back = F.row_number().over(W.partitionBy(*group).orderBy(F.col(time_col).desc()))
    last = buckets.select(*group, F.col(time_col).alias("_t"), F.col(count_col).alias("_c"), F.col(value_col).alias("_v"), back.alias("_back"))
    last = last.where(F.col("_back") <= max_trim).join(stats, group)
    short = (F.col("_c") < F.col("_mc") * 0.9) | (F.col("_v") < F.col("_mv") * 0.6)
    # the run ends before the first complete bucket, counted from the end
    run = F.coalesce(F.min(F.when(~F.coalesce(short, F.lit(False)), F.col("_back"))) - 1, F.max("_back"))
    times = [F.max(F.when(F.col("_back") == i, F.col("_t"))).alias(f"_t{i}") for i in range(1, max_trim + 1)]
    found = last.groupBy(*group).agg(*[F.first(c).alias(c) for c in ("_mc", "_mv", "_n")], run.alias("_run"), *times)
    usable = (F.col("_n") >= 4) & (F.col("_mc") > 0) & (F.col("_mv") > 0)
    trimmed = F.when(usable, F.least(F.col("_run"), F.lit(max_trim), F.col("_n") - 2)).otherwise(0).cast("int")
    start = F.coalesce(*[F.when(F.col("n_trimmed") == i, F.col(f"_t{i}")) for i in range(1, max_trim + 1)])
    out = found.withColumn("n_trimmed", trimmed)
    return out.select(*[g for g in group if g != "_all"], "n_trimmed", start.alias("trim_from"))


def drop_incomplete_tail(
    buckets: DataFrame,
    time_col: str,
    count_col: str,
    value_col: str,
    group: list[str] | None = None,
    max_trim: int = 3,
    hours: int | None = None,
    as_of=None,
) -> DataFrame:
    """The buckets without their incomplete trailing run; inner buckets always stay."""
    tail = incomplete_tail(buckets, time_col, count_col, value_col, group, max_trim, hours, as_of)
    if group:
        kept = buckets.join(tail.drop("n_trimmed"), group)
        return kept.where(F.col("trim_from").isNull() | (F.col(time_col) < F.col("trim_from"))).drop("trim_from")
    cut = tail.select("trim_from").scalar()
    return buckets.where(F.coalesce(F.col(time_col) < cut, F.lit(True)))


# --- sets -------------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same or partly the same columns, matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def endpoints_distinct(flows: DataFrame, from_col: str = "from_ba", to_col: str = "to_ba") -> DataFrame:
    """Number of distinct keys on either end, read in one scan."""
    ends = flows.select(F.explode(F.array(from_col, to_col)).alias("ba"))
    return ends.agg(F.countDistinct("ba").alias("distinct_bas"))


def keep_hours(rows: DataFrame, kept: DataFrame, time_col: str = "period_utc") -> DataFrame:
    """Rows on the hours another frame kept."""
    return rows.join(kept.select(time_col).distinct(), time_col, "left_semi")
