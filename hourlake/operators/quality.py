"""Data quality and freshness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hourlake import reference_data as ref
from hourlake.functions.numbers import pct
from hourlake.functions.times import anchor, interval_hours, seconds_between
from hourlake.operators.filters import prune_dates, settled, with_ages
from hourlake.operators.joins import align_hours
from hourlake.operators.rollups import advisory, plausibility_counts, series_wide, status_rollup

RECON_WARN_PCT = 10.0
MIN_OVERLAP_HOURS = 1


# --- freshness --------------------------------------------------------------------------------


def staleness(freshness: DataFrame, sla: DataFrame, as_of=None) -> DataFrame:
    """``is_stale`` and its reason per source.

    A source is stale when it was never fetched, when its fetch is older than allowed, or when its
    data is (where a data limit is set). Sources without limits of their own get the default.
    """
    fetch_default, period_default = ref.DEFAULT_SLA_HOURS
    aged = with_ages(freshness, as_of).join(sla.withColumn("_listed", F.lit(True)), "source", "left")
    fetch_h = F.when(F.col("_listed"), F.col("fetch_sla_h")).otherwise(F.lit(fetch_default))
    period_h = F.when(F.col("_listed"), F.col("period_sla_h")).otherwise(F.lit(period_default).cast("double"))
    since_fetch = F.col("sec_since_fetch") / 3600
    since_period = F.col("sec_since_period") / 3600
    fetch_reason = F.when(since_fetch.isNull(), ref.NEVER_FETCHED).when(
        since_fetch > fetch_h,
        F.format_string(ref.FETCH_TOO_OLD, since_fetch, F.bround(fetch_h)),
    )
    period_reason = F.when(
        since_period > period_h, F.format_string(ref.DATA_TOO_OLD, since_period, F.bround(period_h))
    )
    reason = F.nullif(F.concat_ws("; ", fetch_reason, period_reason), F.lit(""))
    return (
        aged.withColumn("stale_reason", reason)
        .withColumn("is_stale", F.col("stale_reason").isNotNull())
        .drop("_listed", "fetch_sla_h", "period_sla_h")
    )


def simple_status(freshness: DataFrame, stale_hours: float = 3.0) -> DataFrame:
    """error, stale or ok per source, from the last error and the age of the last fetch alone."""
    failed = F.coalesce(F.trim("last_error") != "", F.lit(False))
    age = F.col("sec_since_fetch")
    status = F.when(failed, "error").when(age.isNull() | (age > stale_hours * 3600), "stale").otherwise("ok")
    return freshness.withColumn("status", status)


def status_summary(statuses: DataFrame) -> DataFrame:
    """Healthy and troubled sources, and the one fetched longest ago."""
    ok = F.col("status") == "ok"
    return statuses.agg(
        F.count_if(ok).alias("healthy"),
        F.count_if(~ok).alias("issues"),
        F.max(F.struct("sec_since_fetch", "source"))["source"].alias("most_stale"),
    )


def _check(name: str, df: DataFrame, status: Column, value: Column, *counts: str) -> DataFrame:
    """One summary row of a check; counts the check does not have stay null."""
    columns = {c: F.col(c).cast("long") for c in counts}
    return df.select(
        F.lit(name).alias("name"), status.alias("status"), value.alias("value"), *[c.alias(n) for n, c in columns.items()]
    )


def check_freshness(freshness: DataFrame, sla: DataFrame, as_of=None) -> DataFrame:
    """pass when no source is stale, fail when all are, warn in between."""
    counted = staleness(freshness, sla, as_of).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if("is_stale").alias("stale")
    ).withColumn("fresh", F.col("sources") - F.col("stale"))
    status = F.when(F.col("stale") == 0, "pass").when(F.col("stale") == F.col("sources"), "fail").otherwise("warn")
    text = F.format_string(ref.FRESH_SOURCES, "fresh", "sources")
    return _check("freshness", counted, status, text, "sources", "fresh", "stale")


# --- plausibility and balance -----------------------------------------------------------------


def check_plausibility(demand: DataFrame, as_of=None, hours: int = 24, fail_share: float = 0.02) -> DataFrame:
    status, text = _plausible(fail_share)
    return _check("demand_plausibility", plausibility_counts(demand, as_of, hours), status, text, "observations", "nulls", "non_positive", "bas")


def _plausible(fail_share: float) -> tuple[Column, Column]:
    """Status and text from the counts observations, nulls and non_positive."""
    bad = F.col("nulls") + F.col("non_positive")
    share = F.coalesce(F.try_divide(bad, "observations"), F.lit(0.0))
    status = F.when(share > fail_share, "fail").when(bad > 0, "warn").otherwise("pass")
    return status, F.format_string(ref.DEMAND_COUNTS, "observations", "nulls", "non_positive")


def energy_balance(demand: DataFrame, as_of=None, warn_pct: float = RECON_WARN_PCT, from_h: int = 72, to_h: int = 3) -> DataFrame:
    """Per key: generation less interchange less demand over settled hours where all three exist."""
    hours = series_wide(settled(demand, "period_utc", as_of, from_h, to_h))
    aligned = hours.where("d IS NOT NULL AND ng IS NOT NULL AND ti IS NOT NULL")
    sums = aligned.groupBy("ba_code").agg(
        F.sum("d").alias("demand_mwh"),
        F.sum("ng").alias("net_generation_mwh"),
        F.sum("ti").alias("total_interchange_mwh"),
        F.count(F.lit(1)).alias("hours"),
    )
    usable = sums.where((F.col("demand_mwh") != 0) & (F.col("hours") >= MIN_OVERLAP_HOURS))
    residual = F.col("net_generation_mwh") - F.col("total_interchange_mwh") - F.col("demand_mwh")
    return _reconciled(usable, residual, "demand_mwh", warn_pct)


def fuel_reconciliation(
    demand: DataFrame, generation: DataFrame, as_of=None, warn_pct: float = RECON_WARN_PCT, from_h: int = 72, to_h: int = 3
) -> DataFrame:
    """Per key: generation summed over fuels against reported net generation on common hours."""
    end = anchor(demand, "period_utc", as_of)
    keys = ["period_utc", "ba_code"]
    reported = settled(demand.where(F.col("series") == "NG"), "period_utc", end, from_h, to_h).groupBy(*keys).agg(
        F.max("value_mwh").alias("_ng")
    )
    fuels = settled(generation, "period_utc", end, from_h, to_h).groupBy(*keys).agg(F.sum("value_mwh").alias("_fuel"))
    common = align_hours(reported, fuels, keys).where("_ng IS NOT NULL AND _fuel IS NOT NULL")
    sums = common.groupBy("ba_code").agg(
        F.sum("_fuel").alias("fuel_sum_mwh"), F.sum("_ng").alias("net_generation_mwh"), F.count(F.lit(1)).alias("hours")
    )
    usable = sums.where((F.col("net_generation_mwh") != 0) & (F.col("hours") >= MIN_OVERLAP_HOURS))
    return _reconciled(usable, F.col("fuel_sum_mwh") - F.col("net_generation_mwh"), "net_generation_mwh", warn_pct)


def _reconciled(sums: DataFrame, residual: Column, base: str, warn_pct: float) -> DataFrame:
    with_residual = sums.withColumn("residual_mwh", residual).withColumn("residual_pct", pct("residual_mwh", base, "nullif"))
    flagged = F.when(F.abs("residual_pct") > warn_pct, "warn").otherwise("pass").alias("status")
    measures = [c for c in with_residual.columns if c.endswith("_mwh")]
    return with_residual.select(
        "ba_code", flagged, *[F.round(c, 1).alias(c) for c in measures], F.round("residual_pct", 2).alias("residual_pct"), "hours"
    )


def check_energy_balance(demand: DataFrame, as_of=None, **limits) -> DataFrame:
    rolled = status_rollup(energy_balance(demand, as_of, **limits))
    return _check("energy_balance", rolled, F.col("status"), F.col("value"))


def check_fuel_shares(demand: DataFrame, generation: DataFrame, as_of=None, **limits) -> DataFrame:
    rolled = status_rollup(fuel_reconciliation(demand, generation, as_of, **limits))
    return _check("fuel_shares", rolled, F.col("status"), F.col("value"))


def validation_report(
    demand: DataFrame,
    generation: DataFrame,
    freshness: DataFrame,
    sla: DataFrame,
    as_of=None,
    fetched_as_of=None,
    warn_pct: float = RECON_WARN_PCT,
    from_h: int = 72,
    to_h: int = 3,
    hours: int = 24,
    fail_share: float = 0.02,
) -> DataFrame:
    """The summary rows of all four checks with the newest demand hour that they saw.

    Demand is read once, from the start of the longest window, and aggregated to hours and then to keys with
    what all checks need; generation is read once. Without ``as_of`` the latest times are looked up first, a
    scan of two columns. Per-key details are frames of their own (``energy_balance``, ``fuel_reconciliation``): their
    number grows with the keys, so they are not packed into a row here.
    """
    t, v, own = F.col("period_utc"), F.col("value_mwh"), F.col("series") == "D"
    if as_of is None:
        latest = demand.agg(F.struct(F.max(t).alias("every"), F.max(F.when(own, t)).alias("own"))).scalar()
        now, own_now = latest["every"], latest["own"]
    else:
        now = own_now = anchor(demand, "period_utc", as_of)
    start = F.least(now - interval_hours(from_h), own_now - interval_hours(hours))
    rows = prune_dates(demand, "period_utc", start).where(t > start)
    recent = own & (t > own_now - interval_hours(hours))
    per_hour = rows.groupBy("ba_code", "period_utc").agg(
        *[F.max(F.when(F.col("series") == x, v)).alias(x) for x in ("D", "NG", "TI")],
        F.max(F.when(own, t)).alias("newest"),
        F.count_if(recent).alias("observations"),
        F.count_if(recent & v.isNull()).alias("nulls"),
        F.count_if(recent & (v <= 0)).alias("non_positive"),
    )
    fuels = settled(generation, "period_utc", now, from_h, to_h).groupBy("ba_code", "period_utc").agg(F.sum("value_mwh").alias("fuel"))
    d, ng, ti, fuel = (F.col(x) for x in ("D", "NG", "TI", "fuel"))
    is_settled = (t > now - interval_hours(from_h)) & (t <= now - interval_hours(to_h))
    balanced = is_settled & d.isNotNull() & ng.isNotNull() & ti.isNotNull()
    fuelled = is_settled & ng.isNotNull() & fuel.isNotNull()

    def flagged(residual: Column, base: Column, common: Column) -> list[Column]:
        """Whether a key has enough hours to be judged, and whether it is off."""
        total = F.sum(F.when(common, base))
        usable = (F.count_if(common) >= MIN_OVERLAP_HOURS) & F.coalesce(total != 0, F.lit(False))
        off = F.abs(F.sum(F.when(common, residual)) / F.nullif(total, F.lit(0.0)) * 100) > warn_pct
        return [usable, usable & F.coalesce(off, F.lit(False))]

    judged = {"balance": flagged(ng - ti - d, d, balanced), "fuels": flagged(fuel - ng, ng, fuelled)}
    counts = ("observations", "nulls", "non_positive")
    per_key = per_hour.join(fuels, ["ba_code", "period_utc"], "left").groupBy("ba_code").agg(
        *[c.alias(f"{name}_{kind}") for name, pair in judged.items() for kind, c in zip(("n", "off"), pair, strict=True)],
        *[F.sum(c).alias(c) for c in counts],
        F.max("newest").alias("newest"),
    )
    total = per_key.agg(
        *[F.count_if(F.col(f"{name}_{kind}")).alias(f"{name}_{kind}") for name in judged for kind in ("n", "off")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.count_if((F.col("observations") > 0) & F.col("ba_code").isNotNull()).alias("bas"),
        F.max("newest").alias("newest"),
    )

    columns = ("sources", "fresh", "stale", *counts, "bas")

    def row(name: str, status: Column, text: Column, **numbers: Column) -> Column:
        cells = [numbers.get(c, F.lit(None)).cast("long").alias(c) for c in columns]
        return F.struct(F.lit(name).alias("name"), status.alias("status"), text.alias("value"), *cells, F.col("newest").alias("as_of_utc"))

    sources = check_freshness(freshness, sla, fetched_as_of).select(F.struct("status", "value", "sources", "fresh", "stale")).scalar()
    rows = [
        row("freshness", sources["status"], sources["value"], **{c: sources[c] for c in ("sources", "fresh", "stale")}),
        row("demand_plausibility", *_plausible(fail_share), **{c: F.col(c) for c in (*counts, "bas")}),
        row("energy_balance", *advisory(F.col("balance_n"), F.col("balance_off"))),
        row("fuel_shares", *advisory(F.col("fuels_n"), F.col("fuels_off"))),
    ]
    return total.select(F.inline(F.array(*rows)))


# --- sources, columns, loads ------------------------------------------------------------------


def resolve_source(df: DataFrame, keys: list[str], priority: list[str], source_col: str = "source") -> DataFrame:
    """One row per key: the one from the source first in ``priority``, unlisted sources last.

    Several rows of one source are decided by all other columns, the largest first, so that every run keeps
    the same row; maps cannot be compared and don't count. Only the best row per key and task is shuffled
    (window group limit).
    """
    order = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(source_col))
    ranked = F.when(order > 0, order).otherwise(len(priority) + 1)
    ties = [F.col(f.name).desc() for f in df.schema if f.name not in (*keys, source_col) and not isinstance(f.dataType, T.MapType)]
    w = W.partitionBy(*keys).orderBy(ranked, source_col, *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def column_tests(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), exprs: dict[str, str] | None = None) -> DataFrame:
    """Failing rows per column test.

    Null and expression tests share one pass. A uniqueness test counts the values that occur more
    than once; an expression test counts rows where it is false.
    """
    one_pass = {f"not_null_{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    one_pass |= {name: F.count_if(~F.expr(e)) for name, e in (exprs or {}).items()}
    parts = []
    if one_pass:
        counts = df.agg(*[c.alias(n) for n, c in one_pass.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("test"), F.col(n).alias("failures")) for n in one_pass])
        parts.append(counts.select(F.inline(pairs)))
    for c in unique:
        repeated = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(repeated.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(f"unique_{c}").alias("test"), "failures"))
    tests = reduce(DataFrame.unionByName, parts)
    return tests.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def freshness_test(df: DataFrame, loaded_at: str, as_of, warn_h: float = 6, error_h: float = 24) -> DataFrame:
    """Age of the newest load against a warning and an error limit; no rows at all is an error."""
    latest = df.agg(F.max(loaded_at).alias("last_loaded"))
    age = seconds_between("last_loaded", anchor(df, loaded_at, as_of)) / 3600
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_h), "error").when(F.col("age_hours") > warn_h, "warn").otherwise("pass")
    return latest.withColumn("age_hours", age).withColumn("status", status)
