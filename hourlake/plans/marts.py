"""The mart layer: staging, intermediate, fact and aggregate frames composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourlake.functions.numbers import pct
from hourlake.operators import filters, joins, quality, rollups, upkeep

#: Sources by the trust in them, best first; unlisted ones come last, by name.
SOURCE_PRIORITY = ["EIA", "ENTSOE", "NOAA"]


def fct_demand(demand: DataFrame, forecast: DataFrame) -> DataFrame:
    """Demand with forecast, error and absolute percentage error (any forecast but zero counts)."""
    staged = filters.series_rows(demand, "D")
    joined = joins.demand_with_forecast(staged, filters.rename_value(forecast, "value_mwh", "forecast_mwh"))
    return joined.withColumn("abs_forecast_error_pct", pct("forecast_error_mwh", "forecast_mwh", "abs"))


def fct_generation(generation: DataFrame, fuels: DataFrame) -> DataFrame:
    return joins.generation_with_meta(generation, fuels)


def fct_interchange(interchange: DataFrame) -> DataFrame:
    return filters.rename_value(interchange, "value_mwh", "net_mwh").select("period_utc", "from_ba", "to_ba", "net_mwh")


@dataclass(frozen=True)
class RawTables:
    demand: DataFrame
    demand_forecast: DataFrame
    generation: DataFrame
    interchange: DataFrame
    fuels: DataFrame
    authorities: DataFrame


FACT_KEYS = {
    "fct_demand_hourly": ["period_utc", "ba_code"],
    "fct_generation_hourly": ["period_utc", "ba_code", "fuel_code"],
    "fct_interchange_hourly": ["period_utc", "from_ba", "to_ba"],
}


#: Raw tables by the columns that name a row whatever its source.
RAW_KEYS = {
    "demand": ["period_utc", "ba_code", "series"],
    "demand_forecast": ["period_utc", "ba_code"],
    "generation": ["period_utc", "ba_code", "fuel_code"],
    "interchange": ["period_utc", "from_ba", "to_ba"],
}


def one_source(df: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """Rows of the best source per key, where the table tells its sources apart."""
    return quality.resolve_source(df, keys, priority) if "source" in df.columns else df


def build_marts(
    raw: RawTables, out: str, as_of=None, recent_hours: int = 72, grain: str = "day", priority: list[str] = SOURCE_PRIORITY, late_hours: int = upkeep.LATE_HOURS
) -> DataFrame:
    """Refresh the facts incrementally, rebuild the aggregates and the dimension from them, and publish them if all tests pass.

    Several sources of one row are resolved by ``priority`` first. The raw tables are filtered by time and
    by their day or month partition before anything is joined. Every mart is staged beside the published one:
    of a fact only the partitions that change; the aggregates read the facts as they will be, with a date bound.
    The staged content is tested, and one marker swaps in all marts or, if a test fails, none. Returns the rows
    of the tests: mart, test, failures, status.
    """
    spark = raw.demand.sparkSession
    demand_start = upkeep.refresh_start(spark, f"{out}/fct_demand_hourly", late_hours, grain=grain)
    starts = {"demand": demand_start, "demand_forecast": demand_start} | {
        t: upkeep.refresh_start(spark, f"{out}/fct_{t}_hourly", late_hours, grain=grain) for t in ("generation", "interchange")
    }
    new = {t: one_source(upkeep.since(getattr(raw, t), starts[t]), keys, priority) for t, keys in RAW_KEYS.items()}
    facts = {
        "fct_demand_hourly": fct_demand(new["demand"], new["demand_forecast"].drop("source")),
        "fct_generation_hourly": fct_generation(new["generation"], raw.fuels),
        "fct_interchange_hourly": fct_interchange(new["interchange"]),
    }
    swaps: dict[str, upkeep.Swap | None] = {}
    try:
        for name, df in facts.items():
            _, swaps[name] = upkeep.staged_upsert(df, f"{out}/{name}", FACT_KEYS[name], grain=grain)
        part = upkeep.partition_col(grain)
        demand, generation = (upkeep.as_committed(spark, f"{out}/{n}", swaps[n], part) for n in ("fct_demand_hourly", "fct_generation_hourly"))
        tables = {
            "agg_demand_recent": rollups.agg_demand_recent(demand, as_of, recent_hours),
            "agg_generation_mix_recent": rollups.agg_generation_mix_recent(generation, as_of, recent_hours),
            "agg_renewable_share_network": rollups.agg_renewable_share(generation, as_of, recent_hours),
            "dim_balancing_authority": joins.dim_keys(raw.demand, raw.authorities, as_of),
        }
        for name, df in tables.items():
            swaps[name] = upkeep.stage(df, f"{out}/{name}", None, whole=True)
        staged = {n: upkeep.staged_rows(spark, s) if s else spark.read.parquet(f"{out}/{n}").limit(0) for n, s in swaps.items()}
        tests = mart_tests(staged)
        rows = tests.collect()  # a row per test
    except BaseException:
        upkeep.discard(spark, [s for s in swaps.values() if s])
        raise
    if all(r["status"] == "pass" for r in rows):
        upkeep.commit(spark, [s for s in swaps.values() if s])
    else:
        upkeep.discard(spark, [s for s in swaps.values() if s])
    return spark.createDataFrame(rows, tests.schema)


def mart_tests(tables: dict[str, DataFrame]) -> DataFrame:
    """The failing rows of each test of the given marts: mart, test, failures, status."""
    parts = []
    for name, df in tables.items():
        rows = quality.column_tests(df, **MART_TESTS[name])
        parts.append(rows.select(F.lit(name).alias("mart"), "test", "failures", "status"))
    return reduce(DataFrame.unionByName, parts)


def published(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The published marts, after any swap that was cut short is finished."""
    upkeep.recover(spark, f"{out}/fct_demand_hourly")
    return {n: spark.read.parquet(f"{out}/{n}") for n in MART_TESTS}


MART_TESTS = {
    "fct_demand_hourly": {
        "not_null": ["period_utc", "ba_code"],
        "exprs": {"demand_not_negative": "demand_mwh >= 0 OR demand_mwh IS NULL"},
    },
    "fct_generation_hourly": {"not_null": ["period_utc", "ba_code", "fuel_code"]},
    "fct_interchange_hourly": {"not_null": ["period_utc", "from_ba", "to_ba"]},
    "agg_demand_recent": {"unique": ["ba_code"], "not_null": ["ba_code"]},
    "agg_generation_mix_recent": {"not_null": ["ba_code", "fuel_code"]},
    "agg_renewable_share_network": {"unique": ["period_utc"], "not_null": ["period_utc"]},
    "dim_balancing_authority": {"unique": ["ba_code", "ba_sk"], "not_null": ["ba_code", "ba_sk"]},
}
