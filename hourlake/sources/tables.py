"""Stored tables, seeds and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from hourlake import reference_data as ref, schemas
from hourlake.functions.labels import add_prefix
from hourlake.functions.times import bucket_start, interval_hours, seconds_between, time_literal
from hourlake.operators.filters import prune_dates


def read_facts(
    spark: SparkSession,
    path: str,
    start=None,
    end=None,
    time_col: str = "period_utc",
    date_col: str = "d",
    **equals,
) -> DataFrame:
    """A stored fact table for ``start < time <= end`` and given column values.

    The bounds are literals, so the same bounds on the date partition column prune folders before
    any file is opened; the other filters reach the Parquet readers.
    """
    df = spark.read.parquet(path)
    kind = df.schema[time_col].dataType
    dated = date_col in df.columns
    if start is not None:
        df = df.where(F.col(time_col) > time_literal(start, kind))
        if dated:
            df = df.where(F.col(date_col) >= time_literal(start, kind).cast("date"))
    if end is not None:
        df = df.where(F.col(time_col) <= time_literal(end, kind))
        if dated:
            df = df.where(F.col(date_col) <= time_literal(end, kind).cast("date"))
    for name, value in equals.items():
        values = value if isinstance(value, (list, tuple, set)) else [value]
        df = df.where(F.col(name).isin(*values))
    return df


def latest_period(df: DataFrame, time_col: str = "period_utc") -> Column:
    """Latest time as a scalar subquery."""
    return df.agg(F.max(time_col)).scalar()


def catchup_start(
    target: DataFrame | str,
    now,
    overlap_hours: int = 3,
    max_hours: int = 168,
    time_col: str = "period_utc",
    key_filter: Column | None = None,
    spark: SparkSession | None = None,
    date_col: str = "d",
) -> DataFrame:
    """One row with the start of the next load: the last stored time less the overlap, but never
    further back than ``max_hours`` before the current hour; that bound alone when nothing is stored.

    A target that is given by its path (with ``spark``) is read in the partitions of those hours only; a last stored
    time before them then counts as none.
    """
    stored = spark.read.parquet(target) if isinstance(target, str) else target
    kind = stored.schema[time_col].dataType
    now_col = now if isinstance(now, Column) else time_literal(now, kind)
    if isinstance(target, str):
        since = now_col - interval_hours(max_hours + overlap_hours + 1)
        low = F.to_date(since) if date_col != "m" else F.trunc(since, "month")
        stored = stored.where((F.col(date_col) >= low) & (F.col(time_col) > since))
    if key_filter is not None:
        stored = stored.where(key_filter)
    floor = F.window("_now", "1 hour")["start"] - interval_hours(max_hours)
    return (
        stored.agg(F.max(time_col).alias("_last"))
        .withColumn("_now", now_col)
        .select("_last", floor.alias("_floor"))
        .select(
            F.greatest(F.col("_last") - interval_hours(overlap_hours), F.col("_floor")).alias("start_utc"),
            F.col("_last").alias("last_period_utc"),
        )
    )


def missing_ranges(
    target: DataFrame, keys: list[str], start, end, expected: DataFrame | None = None, time_col: str = "period_utc", step_hours: int = 1
) -> DataFrame:
    """The holes of a target: key columns, from_utc, to_utc (not included) and hours, for times in ``start`` to ``end``.

    Every key should have a row for each step from ``start`` up to, not including, ``end``. Holes before the first, after
    the last and between stored times count alike. ``expected`` names the keys to look for, whether they are
    stored or not; without it those with any row in the target count. The rows of a key are its distinct
    steps, so their number is bounded by the range of time.
    """
    kind = target.schema[time_col].dataType
    low, high = (x if isinstance(x, Column) else time_literal(x, kind) for x in (start, end))
    t, step = F.col(time_col), interval_hours(step_hours)
    dated = prune_dates(target, time_col, low, high)
    steps = dated.where((t >= low) & (t < high)).select(*keys, bucket_start(time_col, f"{step_hours} hours").alias("_t")).distinct()
    named = (expected if expected is not None else target).select(*keys).distinct()
    edges = F.explode(F.array(low - step, high)).alias("_t")
    marks = steps.unionByName(named.select(*keys, edges)) if expected is None else steps.join(named, keys, "left_semi").unionByName(named.select(*keys, edges))
    following = F.lead("_t").over(W.partitionBy(*keys).orderBy("_t"))
    holes = marks.withColumn("_next", following).where(F.col("_next") > F.col("_t") + step)
    found = holes.select(*keys, (F.col("_t") + step).alias("from_utc"), F.col("_next").alias("to_utc"))
    return found.withColumn("hours", (seconds_between("from_utc", "to_utc") / 3600).cast("long"))


def fetch_ranges(holes: DataFrame, per: list[str], join_hours: int = 0, overlap_hours: int = 0) -> DataFrame:
    """Holes merged into ranges to load: per ``per`` (a source, or keys) those that overlap or lie ``join_hours`` apart at most.

    Each range begins ``overlap_hours`` early. Columns: ``per``, from_utc, to_utc, holes.
    """
    w = W.partitionBy(*per).orderBy("from_utc", "to_utc")
    reached = F.max("to_utc").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col("from_utc") > F.col("_reached") + interval_hours(join_hours), F.lit(True))
    same = holes.groupBy(*per, "from_utc", "to_utc").agg(F.count(F.lit(1)).alias("_n"))
    marked = same.withColumn("_reached", reached).withColumn("_opens", opens.cast("int"))
    numbered = marked.withColumn("_range", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*per, "_range")
        .agg((F.min("from_utc") - interval_hours(overlap_hours)).alias("from_utc"), F.max("to_utc").alias("to_utc"), F.sum("_n").alias("holes"))
        .drop("_range")
    )


def read_seed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV seed with a header and declared types."""
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)


# --- dimensions (LocalRelations of known, fixed size) -----------------------------------------


def fuel_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.FUEL_TYPES, schemas.FUEL_TYPE)


def balancing_authorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.BALANCING_AUTHORITIES, schemas.BALANCING_AUTHORITY)


def ba_centroids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.BA_CENTROIDS, "ba_code string, latitude double, longitude double")


def europe_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.EUROPE_ZONES, schemas.EU_WEATHER_ZONE)


def production_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ref.PRODUCTION_TYPES.items()), "psr_type string, psr_name string")


def wmo_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ref.WMO_TEXT.items()), "code int, text string")


def source_sla(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.SOURCE_SLA_HOURS, "source string, fetch_sla_h double, period_sla_h double")


def _or(name: str, default: Column | None = None) -> Column:
    filled = F.nullif(F.trim(F.col(name)), F.lit(""))
    return filled if default is None else F.coalesce(filled, default)


def authority_dimension(meta: DataFrame, centroids: DataFrame) -> DataFrame:
    """Authorities known from the seed or from the centroid list, blanks filled with defaults."""
    named = meta.where(_or("ba_code").isNotNull()).withColumn("ba_code", F.trim("ba_code"))
    return named.join(centroids.select("ba_code"), "ba_code", "full_outer").select(
        "ba_code",
        _or("ba_name", F.col("ba_code")).alias("ba_name"),
        _or("region").alias("region"),
        _or("country", F.lit("US")).alias("country"),
        _or("timezone").alias("timezone"),
    )


def station_dimension(centroids: DataFrame) -> DataFrame:
    return centroids.select(add_prefix("ba_code", "BA:").alias("station_id"), "ba_code", "latitude", "longitude")


def seed_reference(spark: SparkSession, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three reference tables."""
    centroids = ba_centroids(spark)
    return {
        "balancing_authority": authority_dimension(meta if meta is not None else balancing_authorities(spark), centroids),
        "weather_station": station_dimension(centroids),
        "eu_weather_zone": europe_zones(spark),
    }

