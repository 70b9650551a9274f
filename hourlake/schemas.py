"""Table schemas. Instants are TIMESTAMP (the session zone is UTC); measures are nullable doubles."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "timestamp": T.TimestampType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
}


def _table(text: str) -> T.StructType:
    """Columns from ``name type`` pairs, without needing a session as DDL parsing would."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DEMAND = _table("period_utc timestamp, ba_code string, value_mwh double, series string, source string")
DEMAND_FORECAST = _table("period_utc timestamp, ba_code string, value_mwh double, source string")
GENERATION = _table("period_utc timestamp, ba_code string, fuel_code string, value_mwh double, source string")
INTERCHANGE = _table("period_utc timestamp, from_ba string, to_ba string, value_mwh double, source string")
ENTSOE_LOAD = _table(
    "period_utc timestamp, bidding_zone string, value_mw double, process_type string, source string"
)
ENTSOE_GENERATION = _table(
    "period_utc timestamp, bidding_zone string, psr_type string, value_mw double, source string"
)
WEATHER = _table(
    "period_utc timestamp, station_id string, temperature_c double, wind_speed_kph double, "
    "cloud_cover_pct double, short_forecast string"
)
BALANCING_AUTHORITY = _table("ba_code string, ba_name string, region string, country string, timezone string")
FUEL_TYPE = _table(
    "fuel_code string, fuel_name string, category string, is_renewable boolean, is_carbon_free boolean"
)
WEATHER_STATION = _table("station_id string, ba_code string, latitude double, longitude double")
EU_WEATHER_ZONE = _table("zone_eic string, zone_name string, latitude double, longitude double")
INGEST_RUN = _table(
    "run_id string, source string, started_at timestamp, finished_at timestamp, rows_written long, "
    "status string, error_message string"
)
SOURCE_FRESHNESS = _table(
    "source string, last_period_utc timestamp, last_fetch_utc timestamp, last_rows long, last_error string"
)
FORECAST_VINTAGE = _table(
    "period_utc timestamp, ba_code string, yhat_mwh double, yhat_lower double, yhat_upper double, "
    "model_name string, fit_at_utc timestamp"
)
DEMAND_ANOMALY = _table(
    "period_utc timestamp, ba_code string, actual_mwh double, expected_mwh double, residual_mwh double, "
    "z_score double, is_anomaly boolean, severity string, detected_at timestamp"
)
MIX_SHIFT = _table(
    "detected_at_utc timestamp, ba_code string, fuel_code string, share_now double, "
    "share_baseline double, shift_pp double, severity string"
)

TABLE_KEYS = {
    "raw.demand": ["period_utc", "ba_code", "series", "source"],
    "raw.demand_forecast": ["period_utc", "ba_code", "source"],
    "raw.generation": ["period_utc", "ba_code", "fuel_code", "source"],
    "raw.interchange": ["period_utc", "from_ba", "to_ba", "source"],
    "raw.entsoe_load": ["period_utc", "bidding_zone", "process_type", "source"],
    "raw.entsoe_generation": ["period_utc", "bidding_zone", "psr_type", "source"],
    "raw.weather": ["period_utc", "station_id"],
    "raw.eu_weather": ["period_utc", "station_id"],
    "ml.demand_forecast": ["period_utc", "ba_code", "model_name", "fit_at_utc"],
    "ml.demand_anomaly": ["period_utc", "ba_code"],
    "ml.generation_mix_shift": ["detected_at_utc", "ba_code", "fuel_code"],
    "ops.source_freshness": ["source"],
}

# Landed payload documents, one per line.


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _page(record: str) -> T.StructType:
    return _struct(response=_struct(data=T.ArrayType(_table(record))))


_DOUBLES = T.ArrayType(T.DoubleType())

REGION_PAGE = _page("period string, respondent string, type string, value string")
FUEL_PAGE = _page("period string, respondent string, fueltype string, value string")
INTERCHANGE_PAGE = _page("period string, fromba string, toba string, value string")
NOAA_HOURLY = _struct(
    properties=_struct(
        periods=T.ArrayType(
            _struct(
                startTime=T.StringType(),
                temperature=T.DoubleType(),
                windSpeed=T.StringType(),
                relativeHumidity=_table("value double"),
                shortForecast=T.StringType(),
            )
        )
    )
)
OPENMETEO_HOURLY = _struct(
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
    hourly=_struct(
        time=T.ArrayType(T.StringType()),
        temperature_2m=_DOUBLES,
        windspeed_10m=_DOUBLES,
        cloudcover=_DOUBLES,
        weathercode=_DOUBLES,
    ),
)
LOAD_SERIES = _struct(
    MktPSRType=_table("psrType string"),
    Period=T.ArrayType(
        _struct(
            timeInterval=_table("start string, end string"),
            resolution=T.StringType(),
            Point=T.ArrayType(_table("position int, quantity double")),
        )
    ),
)
