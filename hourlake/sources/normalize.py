"""Payload rows to table rows.

Rows whose period cannot be read or whose key is missing don't become table rows; ``split_rejects`` gives
them back with the reason, so nothing vanishes unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourlake.functions.labels import valid_key
from hourlake.functions.numbers import safe_double
from hourlake.functions.times import parse_period


def _present(*names: str):
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(name).isNotNull() & (F.col(name) != "")
    return cond


def stamp(df: DataFrame, **constants) -> DataFrame:
    """Constant columns such as ``source='EIA'``."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def split_rejects(rows: DataFrame, key_cols: list[str], period_col: str = "period", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Payload rows that can be stored, and the others with ``reason``: ``period`` or the first bad key column.

    A key must be there and not blank; with ``strict`` it must have the form of a key as well. To write both
    from one read of the landing use ``store_split``.
    """
    marked = rows.withColumn("reason", _reason(key_cols, period_col, strict))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def _reason(key_cols: list[str], period_col: str, strict: bool):
    reason = F.when(parse_period(period_col).isNull(), F.lit("period"))
    for k in key_cols:
        reason = reason.when(~(valid_key(k) if strict else _present(k)), F.lit(k))
    return reason


def store_split(rows: DataFrame, path: str, key_cols: list[str], period_col: str = "period", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``split_rejects`` by way of a copy below ``path``: the landing is parsed once for both outputs."""
    rows.withColumn("reason", _reason(key_cols, period_col, strict)).withColumn("kept", F.col("reason").isNull()).write.partitionBy("kept").parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    kept = F.col("kept").cast("boolean")
    return stored.where(kept).drop("kept", "reason"), stored.where(~kept).drop("kept")


def _readable(out: DataFrame) -> DataFrame:
    return out.where(F.col("period_utc").isNotNull())


def region_rows(rows: DataFrame) -> DataFrame:
    """Region records with key and series present, parsed; still holding every series."""
    return _readable(
        rows.where(_present("respondent", "type")).select(
            parse_period("period").alias("period_utc"),
            F.col("respondent").alias("ba_code"),
            safe_double("value").alias("value_mwh"),
            F.col("type").alias("series"),
        )
    )


def route_region(rows: DataFrame, source: str = "EIA") -> tuple[DataFrame, DataFrame]:
    """Split region records into demand rows (series D, NG, TI) and demand forecast rows (DF).

    Other series are ignored. To write both from one read of the landing, pass the rows that
    ``store_split`` returns.
    """
    parsed = stamp(region_rows(rows), source=source)
    demand = parsed.where(F.col("series").isin("D", "NG", "TI"))
    forecast = parsed.where(F.col("series") == "DF").drop("series")
    return demand, forecast


def fuel_rows(rows: DataFrame, source: str = "EIA") -> DataFrame:
    out = rows.where(_present("respondent", "fueltype")).select(
        parse_period("period").alias("period_utc"),
        F.col("respondent").alias("ba_code"),
        F.col("fueltype").alias("fuel_code"),
        safe_double("value").alias("value_mwh"),
    )
    return stamp(_readable(out), source=source)


def interchange_rows(rows: DataFrame, source: str = "EIA") -> DataFrame:
    out = rows.where(_present("fromba", "toba")).select(
        parse_period("period").alias("period_utc"),
        F.col("fromba").alias("from_ba"),
        F.col("toba").alias("to_ba"),
        safe_double("value").alias("value_mwh"),
    )
    return stamp(_readable(out), source=source)


def entsoe_load_rows(points: DataFrame) -> DataFrame:
    return stamp(points.drop("psr_type"), process_type="A16", source="ENTSOE")


def entsoe_generation_rows(points: DataFrame) -> DataFrame:
    """Points per production type; points that name none are dropped."""
    return stamp(points.where(_present("psr_type")), source="ENTSOE")
