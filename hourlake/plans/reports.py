"""Report views over several operators: dashboards and the export set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from hourlake.operators import filters, joins, ranking, rollups, upkeep
from hourlake.operators.windows import latest_readings


def demand_bundle(demand: DataFrame, hours: int = 24, as_of=None) -> dict[str, DataFrame]:
    """Network series without its incomplete tail, mean per key, and per-key series on the hours
    that are left."""
    rows = filters.trailing(demand, "period_utc", hours, as_of, max_hours=max(hours, 168))
    network = ranking.drop_incomplete_tail(rollups.demand_network(rows), "period_utc", "bas", "mwh")
    per_key = ranking.keep_hours(rows.where(F.col("value_mwh").isNotNull()), network)
    return {"series": network, "by_key": rollups.demand_by_key(rows), "key_series": per_key.select("period_utc", "ba_code", "value_mwh")}


def generation_bundle(generation: DataFrame, fuels: DataFrame, hours: int = 24, as_of=None) -> dict[str, DataFrame]:
    """Fuel bands, their shares, and the stacked series without its incomplete tail."""
    share = rollups.generation_share(generation, fuels, hours, as_of)
    mix = rollups.generation_mix(generation, hours, as_of=as_of)
    bands = ranking.fuel_bands(share)
    hourly = mix.where(F.col("value_mwh").isNotNull()).groupBy("period_utc").agg(
        F.count(F.lit(1)).alias("n_fuels"), F.sum("value_mwh").alias("mwh")
    )
    kept = ranking.drop_incomplete_tail(hourly, "period_utc", "n_fuels", "mwh")
    return {
        "totals": rollups.share_totals(share),
        "bands": bands,
        "band_shares": ranking.band_shares(bands),
        "series": ranking.keep_hours(ranking.band_series(mix, bands), kept),
    }


def europe_bundle(load: DataFrame, hours: int = 24, as_of=None, step_hours: float = 1.0) -> dict[str, DataFrame]:
    """Zones, network totals, and the stacked series of the top zones without its incomplete tail."""
    zone_hours = rollups.zone_load(load, hours, as_of)
    hourly = zone_hours.where(F.col("value_mw").isNotNull()).groupBy("period_utc").agg(
        F.count(F.lit(1)).alias("n_zones"), F.sum("value_mw").alias("mw")
    )
    kept = ranking.drop_incomplete_tail(hourly, "period_utc", "n_zones", "mw")
    return {
        "zones": rollups.zone_summary(zone_hours, step_hours),
        "totals": rollups.zone_totals(zone_hours),
        "series": ranking.keep_hours(ranking.top_n_other(zone_hours, "bidding_zone", "value_mw"), kept),
    }


def weather_latest(weather: DataFrame, stations: DataFrame, as_of=None, hours: int = 6, mode: str = "furthest") -> DataFrame:
    return joins.with_location(latest_readings(weather, as_of, hours, mode), stations, "ba_code", "BA:")


def europe_weather_latest(weather: DataFrame, zones: DataFrame, as_of=None, hours: int = 6, mode: str = "furthest") -> DataFrame:
    return joins.with_location(latest_readings(weather, as_of, hours, mode), zones, "zone_eic", "EU:")


def export_slices(
    anomalies: DataFrame, vintages: DataFrame, interchange: DataFrame, runs: DataFrame, fuels: DataFrame, as_of=None
) -> dict[str, tuple[DataFrame, list]]:
    """The exports that are plain slices, each with its order."""
    recent = filters.trailing(anomalies, "period_utc", 168, as_of)
    fitted = filters.trailing(vintages, "fit_at_utc", 24, as_of)
    flows = filters.trailing(interchange, "period_utc", 168, as_of)
    return {
        "anomalies": (recent, [F.col("period_utc").desc(), F.abs("z_score").desc(), "ba_code"]),
        "forecast": (fitted, ["ba_code", "period_utc"]),
        "interchange": (flows.select("period_utc", "from_ba", "to_ba", F.col("value_mwh").alias("net_mwh")), ["period_utc", "from_ba", "to_ba"]),
        "ingest_runs": (ranking.last_rows(runs, "started_at", 200, ["run_id"]), []),
        "fuel_types": (fuels.select("fuel_code", "fuel_name", "is_renewable", "is_carbon_free"), ["fuel_code"]),
    }


@dataclass(frozen=True)
class ExportTables:
    """What the exports are made from."""

    demand: DataFrame
    forecast: DataFrame
    generation: DataFrame
    interchange: DataFrame
    anomalies: DataFrame
    vintages: DataFrame
    freshness: DataFrame
    runs: DataFrame
    fuels: DataFrame
    authorities: DataFrame


def export_marts(t: ExportTables, as_of=None) -> dict[str, tuple[DataFrame, list]]:
    """All ten exports, each with its order. Without ``as_of`` every window ends with its own table."""
    own = t.demand.where(F.col("series") == "D")
    named = joins.generation_with_meta(filters.trailing(t.generation, "period_utc", 168, as_of), t.fuels).drop("fuel_category")
    keys = joins.dim_keys(t.demand, t.authorities, as_of).drop("ba_sk")
    return {
        "demand_hourly": (joins.demand_vs_forecast_export(own, t.forecast, as_of), ["period_utc", "ba_code"]),
        "generation_hourly": (named, ["period_utc", "ba_code", "fuel_code"]),
        "renewable_share_hourly": (rollups.renewable_share_export(t.generation, t.fuels, as_of), ["period_utc"]),
        "source_freshness": (filters.with_ages(t.freshness, as_of, "minutes"), ["source"]),
        "balancing_authorities": (keys, ["ba_code"]),
        **export_slices(t.anomalies, t.vintages, t.interchange, t.runs, t.fuels, as_of),
    }


def write_exports(t: ExportTables, out: str, as_of=None) -> dict[str, T.StructType]:
    """Write all ten exports below ``out`` and return their schemas, which CSV files don't keep."""
    frames = export_marts(t, as_of)
    upkeep.export_csv(frames, out)
    return {name: df.schema for name, (df, _) in frames.items()}
