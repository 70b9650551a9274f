"""Aggregations. All of them combine partially before the shuffle, so hot keys do not pile up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourlake import reference_data as ref
from hourlake.functions.numbers import mape, pct, rmse
from hourlake.functions.times import anchor, bucket_start, interval_hours
from hourlake.operators.filters import prune_dates, trailing, trailing_latest
from hourlake.operators.joins import scalar, share_of_group


# --- time buckets -----------------------------------------------------------------------------


def rollup(df: DataFrame, width: str, keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh") -> DataFrame:
    """Average, peak, trough and row count per bucket and key."""
    return df.groupBy(bucket_start(time_col, width).alias("bucket_utc"), *keys).agg(
        F.avg(value_col).alias("avg_mwh"),
        F.max(value_col).alias("peak_mwh"),
        F.min(value_col).alias("trough_mwh"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def rollup_sum(df: DataFrame, width: str, keys: list[str], time_col: str = "period_utc", value_col: str = "value_mwh") -> DataFrame:
    return df.groupBy(bucket_start(time_col, width).alias("bucket_utc"), *keys).agg(F.sum(value_col).alias("total_mwh"))


# --- demand -----------------------------------------------------------------------------------


def agg_demand_recent(fct: DataFrame, as_of=None, hours: int = 72, approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Per-key summary of the last ``hours``.

    The 95th percentile is exact and interpolated. It keeps the distinct values of a key's window,
    at most one per hour of it. For sub-hourly input over long windows ``approximate`` switches to a
    mergeable sketch of fixed size.
    """
    p95 = (
        F.percentile_approx("demand_mwh", 0.95, accuracy)
        if approximate
        else F.percentile("demand_mwh", 0.95)
    )
    return trailing(fct, "period_utc", hours, as_of).groupBy("ba_code").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("period_utc").alias("first_period_utc"),
        F.max("period_utc").alias("last_period_utc"),
        F.avg("demand_mwh").alias("avg_mwh"),
        F.max("demand_mwh").alias("peak_mwh"),
        F.min("demand_mwh").alias("trough_mwh"),
        F.avg("abs_forecast_error_pct").alias("avg_abs_error_pct"),
        p95.alias("p95_mwh"),
    )


def demand_network(demand: DataFrame) -> DataFrame:
    """Network total and number of reporting keys per hour."""
    rows = demand.where(F.col("value_mwh").isNotNull())
    return rows.groupBy("period_utc").agg(F.sum("value_mwh").alias("mwh"), F.count(F.lit(1)).alias("bas"))


def demand_by_key(demand: DataFrame) -> DataFrame:
    """Mean demand per key, largest first."""
    rows = demand.where(F.col("value_mwh").isNotNull())
    return rows.groupBy("ba_code").agg(F.avg("value_mwh").alias("avg_mw")).orderBy(F.col("avg_mw").desc(), "ba_code")


def demand_change(demand: DataFrame, as_of=None) -> DataFrame:
    """Demand of the last hour and its change against the same hour a day before.

    The two hours are fixed by the anchor, so the scan is filtered to them.
    """
    now = anchor(demand, "period_utc", as_of)
    t = F.col("period_utc")
    day_ago = now - interval_hours(24)
    sums = prune_dates(demand, "period_utc", day_ago, now).where((t == now) | (t == day_ago)).agg(
        F.sum(F.when(t == now, F.col("value_mwh"))).alias("mwh_now"),
        F.sum(F.when(t == day_ago, F.col("value_mwh"))).alias("mwh_24h_ago"),
    )
    return sums.withColumn("delta_pct", pct(F.col("mwh_now") - F.col("mwh_24h_ago"), "mwh_24h_ago", "nullif"))


def forecast_scorecard(export: DataFrame) -> DataFrame:
    """Mean absolute percentage error, accuracy and bias of a demand-versus-forecast frame."""
    out = export.agg(F.avg("abs_forecast_error_pct").alias("mape_pct"), F.avg("forecast_error_mwh").alias("bias_mwh"))
    return out.withColumn("accuracy_pct", 100 - F.col("mape_pct"))


# --- generation -------------------------------------------------------------------------------


def agg_generation_mix_recent(fct: DataFrame, as_of=None, hours: int = 72) -> DataFrame:
    """Sum by key and fuel over the last ``hours`` and its share of the key's total."""
    by_fuel = (
        trailing(fct, "period_utc", hours, as_of)
        .groupBy("ba_code", "fuel_code", "fuel_name", "fuel_category", "is_renewable", "is_carbon_free")
        .agg(F.sum("generation_mwh").alias("mwh"))
    )
    return share_of_group(by_fuel, ["ba_code"], "mwh")


def _with_share_pcts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "renewable_pct": pct("renewable_mwh", "total_mwh"),
            "carbon_free_pct": pct("carbon_free_mwh", "total_mwh"),
        }
    )


def agg_renewable_share(fct: DataFrame, as_of=None, hours: int = 72) -> DataFrame:
    """Hourly renewable and carbon-free sums and shares; a sum over no matching row is 0."""
    v = F.col("generation_mwh")
    hourly = trailing(fct, "period_utc", hours, as_of).groupBy("period_utc").agg(
        F.sum(F.when(F.col("is_renewable"), v).otherwise(0.0)).alias("renewable_mwh"),
        F.sum(F.when(F.col("is_carbon_free"), v).otherwise(0.0)).alias("carbon_free_mwh"),
        F.sum(v).alias("total_mwh"),
    )
    return _with_share_pcts(hourly)


def renewable_share_export(generation: DataFrame, fuels: DataFrame, as_of=None, hours: int = 168) -> DataFrame:
    """Export variant: a sum over no matching row is null."""
    v = F.col("value_mwh")
    rows = trailing(generation, "period_utc", hours, as_of).join(fuels, "fuel_code", "left")
    hourly = rows.groupBy("period_utc").agg(
        F.sum(v).alias("total_mwh"),
        F.sum(F.when(F.col("is_renewable"), v)).alias("renewable_mwh"),
        F.sum(F.when(F.col("is_carbon_free"), v)).alias("carbon_free_mwh"),
    )
    return _with_share_pcts(hourly)


def generation_mix(generation: DataFrame, hours: int = 24, ba_code: str | None = None, as_of=None) -> DataFrame:
    """Sum per hour and fuel over the last ``hours`` available or before ``as_of``, of one key or of all."""
    rows = trailing_latest(generation, "period_utc", hours, "ba_code", ba_code, as_of=as_of)
    return rows.groupBy("period_utc", "fuel_code").agg(F.sum("value_mwh").alias("value_mwh"))


def generation_share(generation: DataFrame, fuels: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Per-fuel sum over the last ``hours`` available or before ``as_of`` and its share of the network total.

    Facts are summed per fuel first. The network total and the fuel names then meet a frame of a
    few rows. Flags of unlisted fuels stay null here.
    """
    by_fuel = trailing_latest(generation, "period_utc", hours, as_of=as_of).groupBy("fuel_code").agg(F.sum("value_mwh").alias("mwh"))
    total = F.nullif(scalar(by_fuel, F.sum("mwh")), F.lit(0.0))
    return (
        by_fuel.join(fuels, "fuel_code", "left")
        .select("fuel_code", "fuel_name", "is_renewable", "is_carbon_free", "mwh", (F.col("mwh") / total * 100).alias("pct"))
        .orderBy(F.col("mwh").desc(), "fuel_code")
    )


def share_totals(share: DataFrame) -> DataFrame:
    """Network total with the carbon-free and renewable percentages of a share frame."""
    part = F.coalesce("pct", F.lit(0.0))
    return share.agg(
        F.sum(F.coalesce("mwh", F.lit(0.0))).alias("total_mwh"),
        F.sum(F.when(F.col("is_carbon_free"), part).otherwise(0.0)).alias("carbon_free_pct"),
        F.sum(F.when(F.col("is_renewable"), part).otherwise(0.0)).alias("renewable_pct"),
    )


# --- interchange and Europe -------------------------------------------------------------------


def interchange_flows(interchange: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Net flow and row count per directed pair, largest magnitude first."""
    flows = trailing(interchange, "period_utc", hours, as_of).groupBy("from_ba", "to_ba").agg(
        F.sum("value_mwh").alias("net_mwh"), F.count(F.lit(1)).alias("n_obs")
    )
    return flows.orderBy(F.abs("net_mwh").desc_nulls_last(), "from_ba", "to_ba")


def mirror_pairs(flows: DataFrame) -> DataFrame:
    """Directed flows to one row per unordered pair.

    Both partners report a link, so their rows, put in one direction, are averaged. The sign of the
    mean orients the pair.
    """
    lo, hi = F.least("from_ba", "to_ba"), F.greatest("from_ba", "to_ba")
    value = F.coalesce("net_mwh", F.lit(0.0))
    signed = F.when(F.col("from_ba") == lo, value).otherwise(-value)
    pairs = flows.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.avg(signed).alias("net_mwh"))
    forward = F.col("net_mwh") >= 0
    return pairs.select(
        F.when(forward, F.col("lo")).otherwise(F.col("hi")).alias("from_ba"),
        F.when(forward, F.col("hi")).otherwise(F.col("lo")).alias("to_ba"),
        (F.abs("net_mwh") / 1000).alias("gw"),
    ).orderBy(F.col("gw").desc(), "from_ba", "to_ba")


def flow_totals(flows: DataFrame) -> DataFrame:
    """Sum of flow magnitudes and number of distinct endpoints.

    The endpoints are made distinct before they are counted, over the pairs already summed.
    """
    total = flows.agg((F.sum(F.abs(F.coalesce("net_mwh", F.lit(0.0)))) / 1000).alias("total_gw"))
    ends = flows.select(F.explode(F.array("from_ba", "to_ba")).alias("ba"))
    return total.withColumn("distinct_bas", scalar(ends, F.countDistinct("ba")))


def zone_load(load: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    rows = trailing(load, "period_utc", hours, as_of)
    return rows.groupBy("period_utc", "bidding_zone").agg(F.sum("value_mw").alias("value_mw"))


def zone_summary(zone_hours: DataFrame, step_hours: float = 1.0) -> DataFrame:
    """Mean and sum per zone. ``total_mw`` adds power readings as they come; ``energy_mwh`` weighs
    them by the length of their interval."""
    rows = zone_hours.where(F.col("value_mw").isNotNull())
    return rows.groupBy("bidding_zone").agg(
        F.avg("value_mw").alias("avg_mw"),
        F.sum("value_mw").alias("total_mw"),
        (F.sum("value_mw") * step_hours).alias("energy_mwh"),
    )


def zone_totals(zone_hours: DataFrame) -> DataFrame:
    """Peak of the network total and the total over all zones and hours."""
    hourly = zone_hours.groupBy("period_utc").agg(F.sum("value_mw").alias("mw"))
    return hourly.agg(F.max("mw").alias("peak_total_mw"), F.sum("mw").alias("total_mw"))


# --- scores, counts, extremes -----------------------------------------------------------------


def score_sets(
    pairs: DataFrame, key_col: str = "ba_code", actual: str = "actual", yhat: str = "yhat", groups: DataFrame | None = None
) -> DataFrame:
    """Pairs, MAPE and RMSE overall and per key, the overall row marked by ``is_total``.

    The totals add up the per-key partial sums, so the pairs are aggregated once. Grouping sets would
    give no total for empty input; here it is always present. ``groups`` names sources that are scored
    side by side: one total for each of its rows, whatever pairs there are.
    """
    by = groups.columns if groups is not None else []
    a, f = F.col(actual), F.col(yhat)
    parts = pairs.groupBy(*by, key_col).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.abs(a - f) / F.nullif(a, F.lit(0.0))).alias("_ape"),
        F.count(F.nullif(a, F.lit(0.0))).alias("_n_ape"),
        F.sum((a - f) * (a - f)).alias("_se"),
    )
    totals = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pairs", "_ape", "_n_ape", "_se")])
    if groups is not None:
        totals = groups.join(totals, by, "left")
    total_rows = totals.select(
        *by,
        F.lit(None).cast("string").alias(key_col),
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
        "_ape",
        "_n_ape",
        "_se",
        F.lit(True).alias("is_total"),
    )
    return parts.withColumn("is_total", F.lit(False)).unionByName(total_rows).select(
        *by,
        key_col,
        "is_total",
        "pairs",
        (F.try_divide("_ape", "_n_ape") * 100).alias("mape_pct"),
        F.sqrt(F.try_divide("_se", "pairs")).alias("rmse_mwh"),
    )


def score_grouping_sets(pairs: DataFrame, key_col: str = "ba_code", actual: str = "actual", yhat: str = "yhat") -> DataFrame:
    """As ``score_sets`` with SQL grouping sets: no row at all for empty input."""
    scored = pairs.groupingSets([[], [F.col(key_col)]], F.col(key_col)).agg(
        (F.grouping_id() == 1).alias("is_total"),
        F.count(F.lit(1)).alias("pairs"),
        mape(actual, yhat).alias("mape_pct"),
        rmse(actual, yhat).alias("rmse_mwh"),
    )
    return scored.select(key_col, "is_total", "pairs", "mape_pct", "rmse_mwh")


def plausibility_counts(demand: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    rows = trailing(demand, "period_utc", hours, as_of)
    return rows.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("value_mwh").isNull()).alias("nulls"),
        F.count_if(F.col("value_mwh") <= 0).alias("non_positive"),
        F.countDistinct("ba_code").alias("bas"),
    )


def series_wide(demand: DataFrame, values: tuple[str, ...] = ("D", "NG", "TI")) -> DataFrame:
    """Series as columns per (period, key). The value list is fixed, so no pass to find it."""
    columns = [F.max(F.when(F.col("series") == v, F.col("value_mwh"))).alias(v.lower()) for v in values]
    return demand.where(F.col("series").isin(*values)).groupBy("period_utc", "ba_code").agg(*columns)


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key)


def arg_extreme(df: DataFrame, value: str | Column, how: str = "max", group: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The row holding the largest or smallest value, overall or per group.

    One aggregate on (value, kept columns), which breaks ties by the kept columns in order.
    """
    v = F.col(value) if isinstance(value, str) else value
    keep = keep or [c for c in df.columns if c not in (group or [])]
    order = F.struct(v.alias("_v"), *keep)
    pick = F.max(order) if how == "max" else F.min(order)
    chosen = df.where(v.isNotNull()).groupBy(*(group or [])).agg(pick.alias("_pick"))
    return chosen.select(*(group or []), *[F.col(f"_pick.{c}").alias(c) for c in keep])


def top_group(df: DataFrame, key: str, value_col: str, out: str = "mwh") -> DataFrame:
    """The key with the largest sum."""
    sums = df.groupBy(key).agg(F.sum(value_col).alias(out))
    return sums.orderBy(F.col(out).desc_nulls_last(), key).limit(1)


def table_census(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Row count and latest time per table, unioned. Reads one column of each table at most."""
    parts = []
    for name, (df, time_col) in tables.items():
        latest = F.max(time_col).cast("timestamp_ntz") if time_col else F.lit(None).cast("timestamp_ntz")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), latest.alias("last_period_utc")).withColumn("tbl", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("tbl", "n_rows", "last_period_utc")


def anomaly_measures(anomalies: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("is_anomaly"))
    n = F.count(F.lit(1))
    return anomalies.agg(
        flagged.alias("flagged"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        (F.try_divide(flagged, n) * 100).alias("rate_pct"),
        F.max(F.abs("z_score")).alias("max_abs_z"),
    )


def run_measures(runs: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Successful and failed runs of the last ``hours``, both ends included."""
    now = anchor(runs, "started_at", as_of)
    recent = runs.where(F.col("started_at") >= now - interval_hours(hours))
    return recent.agg(
        F.count_if(F.col("status") == "ok").alias("ok_runs"), F.count_if(F.col("status") == "error").alias("error_runs")
    )


def freshness_measures(freshness: DataFrame) -> DataFrame:
    """Largest lag and the source it belongs to; expects the age columns in minutes."""
    return freshness.agg(
        F.max("minutes_since_fetch").alias("max_lag_min"),
        F.max(F.struct("minutes_since_fetch", "source"))["source"].alias("worst_source"),
    )


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")])


def advisory(n: Column, flagged: Column) -> tuple[Column, Column]:
    """Status and text of an advisory check: it warns when any key is flagged and never fails."""
    text = (
        F.when(n == 0, ref.NOTHING_SETTLED)
        .when(flagged == 0, F.format_string(ref.ALL_RECONCILE, n))
        .otherwise(F.format_string(ref.SOME_RECONCILE, n - flagged, n, flagged))
    )
    return F.when((n == 0) | (flagged == 0), "pass").otherwise("warn"), text


def status_rollup(details: DataFrame) -> DataFrame:
    """``advisory`` over the rows of a check."""
    counts = details.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "pass").alias("flagged"))
    status, text = advisory(F.col("n"), F.col("flagged"))
    return counts.select(status.alias("status"), text.alias("value"), "n", "flagged")


def energy_measures(df: DataFrame, key: str | None, value_col: str) -> DataFrame:
    """Plain sums, overall or per key."""
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(F.sum(value_col).alias("mwh"), (F.sum(value_col) / 1000).alias("gwh"))
