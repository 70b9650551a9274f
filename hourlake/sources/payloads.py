"""Landed payload documents to flat rows.

Every function takes a frame of parsed documents (see the readers at the end, which work for batch
and for streams alike) and unnests it with ``explode``/``inline``. Nothing here is an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hourlake import schemas
from hourlake.functions.labels import add_prefix, wind_to_kph, wmo_text
from hourlake.functions.numbers import fahrenheit_to_celsius
from hourlake.functions.times import parse_utc, resolution_minutes


def page_rows(pages: DataFrame) -> DataFrame:
    """One row per record of ``response.data``; works for the region, fuel and interchange pages."""
    return pages.select(F.explode("response.data").alias("r")).select("r.*")


def noaa_rows(docs: DataFrame, ba_col: str = "ba_code") -> DataFrame:
    """Hourly forecast periods as weather rows in UTC, degrees C and km/h.

    Relative humidity stands in for cloud cover, as the feed carries no cover of its own.
    """
    p = F.col("p")
    return (
        docs.select(F.col(ba_col).alias("_ba"), F.explode("properties.periods").alias("p"))
        .where(p["startTime"].isNotNull() & (p["startTime"] != ""))
        .select(
            parse_utc(p["startTime"]).alias("period_utc"),
            add_prefix("_ba", "BA:").alias("station_id"),
            fahrenheit_to_celsius(p["temperature"]).alias("temperature_c"),
            wind_to_kph(p["windSpeed"]).alias("wind_speed_kph"),
            p["relativeHumidity"]["value"].alias("cloud_cover_pct"),
            p["shortForecast"].alias("short_forecast"),
        )
    )


def openmeteo_rows(docs: DataFrame, zone_col: str = "zone_eic") -> DataFrame:
    """Parallel hourly arrays as weather rows; arrays shorter than ``time`` read as null."""
    hourly = [
        F.col(f"hourly.{name}").alias(name)
        for name in ("time", "temperature_2m", "windspeed_10m", "cloudcover", "weathercode")
    ]
    return (
        docs.select(F.col(zone_col).alias("_zone"), *hourly)
        .select("_zone", F.inline(F.arrays_zip("time", "temperature_2m", "windspeed_10m", "cloudcover", "weathercode")))
        .where(F.col("time").isNotNull() & (F.col("time") != ""))
        .select(
            parse_utc("time").alias("period_utc"),
            add_prefix("_zone", "EU:").alias("station_id"),
            F.col("temperature_2m").alias("temperature_c"),
            F.col("windspeed_10m").alias("wind_speed_kph"),
            F.col("cloudcover").alias("cloud_cover_pct"),
            wmo_text("weathercode").alias("short_forecast"),
        )
    )


def entsoe_points(series: DataFrame, zone_col: str | Column = "bidding_zone") -> DataFrame:
    """TimeSeries elements to one row per point.

    A point's time is the interval start plus (position - 1) steps. Positions the document leaves
    out stay out; points without a position or quantity are dropped.
    """
    zone = F.col(zone_col) if isinstance(zone_col, str) else zone_col
    start = parse_utc(F.col("period.timeInterval.start"))
    step = resolution_minutes("period.resolution")
    minutes = step * (F.col("point.position") - 1)
    return (
        series.select(zone.alias("bidding_zone"), F.col("MktPSRType.psrType").alias("psr_type"), F.explode("Period").alias("period"))
        .where(F.col("period.timeInterval.start").isNotNull() & F.col("period.resolution").isNotNull())
        .select("bidding_zone", "psr_type", "period", F.explode("period.Point").alias("point"))
        .where(F.col("point.position").isNotNull() & F.col("point.quantity").isNotNull())
        .select(
            (start + F.make_dt_interval(mins=minutes)).alias("period_utc"),
            "bidding_zone",
            "psr_type",
            F.col("point.quantity").alias("value_mw"),
        )
    )


def parse_json(df: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """Payload text in a column to the document's fields, next to the frame's other columns."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.from_json(text_col, schema).alias("_doc")).select(*rest, "_doc.*")


# --- readers ----------------------------------------------------------------------------------


def _with_partitions(schema: T.StructType, partitions: dict[str, str] | None) -> T.StructType:
    out = T.StructType(list(schema.fields))
    for name, kind in (partitions or {}).items():
        out = out.add(name, kind)
    return out


def read_json_docs(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partitions: dict[str, str] | None = None,
    stream: bool = False,
    max_files_per_trigger: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Landed JSON documents under ``path``, batch or stream.

    The schema is declared, never inferred. Path folders such as ``ba_code=PJM`` become columns
    when named in ``partitions``.
    """
    reader = (spark.readStream if stream else spark.read).schema(_with_partitions(schema, partitions))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.option("multiLine", str(multi_line).lower()).json(path)


def read_series_xml(
    spark: SparkSession, path: str, partitions: dict[str, str] | None = None, stream: bool = False
) -> DataFrame:
    """TimeSeries elements of landed XML documents, whatever namespace the document uses.

    One task reads a document whole, so land many of bounded size.
    """
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("xml")
        .schema(_with_partitions(schemas.LOAD_SERIES, partitions))
        .option("rowTag", "TimeSeries")
        .option("ignoreNamespace", "true")
        .load(path)
    )
