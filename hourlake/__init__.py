"""Hourly operational time series on Spark: landing, upsert, rollups, marts, scoring, data quality."""
