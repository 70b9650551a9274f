"""The test tables in the roles of the grid tables, as frames and as SQL common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourlake import reference_data as ref
from hourlake.functions.times import bucket_start
from hourlake.session import use_utc
from hourlake.sources import tables

FUEL_CASE = """CASE l_linenumber WHEN 1 THEN 'NG' WHEN 2 THEN 'NUC' WHEN 3 THEN 'COL' WHEN 4 THEN 'WAT'
 WHEN 5 THEN 'WND' WHEN 6 THEN 'SUN' ELSE CASE l_returnflag WHEN 'A' THEN 'OTH'
 WHEN 'N' THEN CASE l_linestatus WHEN 'F' THEN 'BAT' ELSE 'GEO' END
 ELSE CASE l_linestatus WHEN 'F' THEN 'SNB' ELSE 'PS' END END END"""
SERIES_CASE = "CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'N' THEN 'NG' ELSE 'TI' END"
SOURCE_CASE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'EIA-region' WHEN '2-HIGH' THEN 'EIA-fuel'
 WHEN '3-MEDIUM' THEN 'EIA-interchange' WHEN '4-NOT SPECIFIED' THEN 'NOAA' ELSE 'Manual' END"""
FETCH_HOURS = """CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
 WHEN '4-NOT SPECIFIED' THEN 4 END"""
STATUS_CASE = "CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'ok' END"


class Bound:
    """One folder of test tables. Anchors are computed on the raw tables, so that a window filter
    does not aggregate the facts a second time."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # demand: events per hour and type
    @cached_property
    def demand(self) -> DataFrame:
        hourly = self.table("events").groupBy(
            bucket_start("ts", "1 hour").alias("period_utc"), F.col("event_type").alias("ba_code")
        )
        return hourly.agg(F.sum("value").alias("value_mwh"))

    @property
    def demand_now(self) -> Column:
        latest = self.table("events").agg(F.max("ts").alias("ts"))
        return latest.select(bucket_start("ts", "1 hour")).scalar()

    @property
    def demand_raw(self) -> DataFrame:
        """The long table: demand under two sources and a second series."""
        d = self.demand
        kinds = F.array(
            F.struct(F.lit("D").alias("series"), F.lit("EIA").alias("source"), F.lit(1.0).alias("f")),
            F.struct(F.lit("D").alias("series"), F.lit("DEMO").alias("source"), F.lit(0.5).alias("f")),
            F.struct(F.lit("NG").alias("series"), F.lit("EIA").alias("source"), F.lit(1.1).alias("f")),
        )
        rows = d.withColumn("k", F.explode(kinds))
        return rows.select("period_utc", "ba_code", (F.col("value_mwh") * F.col("k.f")).alias("value_mwh"), "k.series", "k.source")

    @property
    def day_ahead(self) -> DataFrame:
        """Yesterday's value raised by 2 %, for the hour a day later."""
        ahead = F.col("period_utc") + F.expr("INTERVAL '24' HOUR")
        return self.demand.select(ahead.alias("period_utc"), "ba_code", (F.col("value_mwh") * 1.02).alias("value_mwh"))

    @property
    def vintages(self) -> DataFrame:
        """Two forecasts of every hour: its value a day earlier and a week earlier."""
        lag = self.demand.withColumn("lag", F.explode(F.array(F.lit(24), F.lit(168))))
        v = F.col("value_mwh")
        return lag.select(
            (F.col("period_utc") + F.make_dt_interval(hours=F.col("lag"))).alias("period_utc"),
            "ba_code",
            v.alias("yhat_mwh"),
            (v * 0.9).alias("yhat_lower"),
            (v * 1.1).alias("yhat_upper"),
            F.concat(F.lit("lag"), F.col("lag").cast("string")).alias("model_name"),
            F.col("period_utc").alias("fit_at_utc"),
        )

    # shipments
    @property
    def shipped_now(self) -> Column:
        return self.table("lineitem").agg(F.max("l_shipdate")).scalar()

    def _lines(self) -> DataFrame:
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        return self.table("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))

    @cached_property
    def generation(self) -> DataFrame:
        return self._lines().groupBy(
            F.col("l_shipdate").alias("period_utc"),
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ba_code"),
            F.expr(FUEL_CASE).alias("fuel_code"),
        ).agg(F.sum("l_quantity").alias("value_mwh"))

    @property
    def fuels(self) -> DataFrame:
        return tables.fuel_types(self.spark)

    def _regional(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", "n_regionkey")
        return self._lines().join(nations, F.col("s_nationkey") == F.col("n_nationkey"))

    @property
    def demand_long(self) -> DataFrame:
        """Three series per day and region."""
        return self._regional().groupBy(
            F.col("l_shipdate").alias("period_utc"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("ba_code"),
            F.expr(SERIES_CASE).alias("series"),
        ).agg(F.sum("l_quantity").alias("value_mwh"))

    @property
    def generation_regional(self) -> DataFrame:
        """Fuel totals of the net generation series, off by a share that differs per region."""
        off = 0.8513 + 0.1 * F.col("n_regionkey")
        return self._regional().where("l_returnflag = 'N'").groupBy(
            F.col("l_shipdate").alias("period_utc"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("ba_code"),
            F.expr(FUEL_CASE).alias("fuel_code"),
        ).agg(F.sum(F.col("l_quantity") * off).alias("value_mwh"))

    @property
    def interchange(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        lines = (
            self._lines()
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        )
        return lines.groupBy(
            F.col("l_shipdate").alias("period_utc"),
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("from_ba"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("to_ba"),
        ).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value_mwh"))

    @property
    def zone_load(self) -> DataFrame:
        return self._lines().groupBy(
            F.col("l_shipdate").alias("period_utc"),
            F.concat(F.lit("Z"), F.col("s_nationkey").cast("string")).alias("bidding_zone"),
        ).agg(F.sum("l_quantity").alias("value_mw"))

    # weather: one reading per event
    @property
    def weather(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").alias("period_utc"),
            F.concat(F.lit("BA:"), F.col("user_id").cast("string")).alias("station_id"),
            F.col("value").alias("temperature_c"),
            (F.col("value") / 2).alias("wind_speed_kph"),
            F.col("event_type").alias("short_forecast"),
        )

    @property
    def weather_now(self) -> Column:
        return self.table("events").agg(F.max("ts")).scalar()

    @property
    def stations(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("ba_code"),
            F.col("c_acctbal").alias("latitude"),
            F.col("c_nationkey").cast("double").alias("longitude"),
        )

    # operations
    @property
    def runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.expr(SOURCE_CASE).alias("source"),
            F.col("o_orderdate").alias("started_at"),
            F.col("o_custkey").alias("rows_written"),
            F.expr(STATUS_CASE).alias("status"),
        )

    @property
    def freshness(self) -> DataFrame:
        fetched = F.col("o_orderdate") + F.make_dt_interval(hours=F.expr(FETCH_HOURS))
        return self.table("orders").groupBy(F.expr(SOURCE_CASE).alias("source")).agg(
            F.max("o_orderdate").alias("last_period_utc"),
            F.max(fetched).alias("last_fetch_utc"),
            F.count(F.lit(1)).alias("last_rows"),
            F.max(F.when(F.col("o_orderpriority") == "3-MEDIUM", "HTTP 500")).alias("last_error"),
        )

    @property
    def ops_now(self) -> Column:
        return self.table("orders").agg(F.max("o_orderdate") + F.expr("INTERVAL '6' HOUR")).scalar()

    @property
    def sla(self) -> DataFrame:
        return tables.source_sla(self.spark)

    @property
    def nations(self) -> DataFrame:
        """Key dimension: nations with their region, keyed like the generation keys."""
        regions = self.table("region")
        n = self.table("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select(
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ba_code"),
            F.col("n_name").alias("ba_name"),
            F.col("r_name").alias("region"),
            F.lit(None).cast("string").alias("country"),
            F.lit(None).cast("string").alias("timezone"),
        )


# --- the same roles as common table expressions -----------------------------------------------


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values_cte(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


CTES = {
    "demand": "SELECT date_trunc('hour', ts) AS period_utc, event_type AS ba_code, sum(value) AS value_mwh FROM events GROUP BY 1, 2",
    "dnow": "SELECT max(period_utc) AS now FROM demand",
    "demand_raw": """SELECT period_utc, ba_code, value_mwh * f AS value_mwh, series, source FROM demand,
 (VALUES ('D', 'EIA', 1.0), ('D', 'DEMO', 0.5), ('NG', 'EIA', 1.1)) AS k(series, source, f)""",
    "day_ahead": "SELECT period_utc + INTERVAL 24 HOUR AS period_utc, ba_code, value_mwh * 1.02 AS value_mwh FROM demand",
    "vintages": """SELECT period_utc + to_hours(lag) AS period_utc, ba_code, value_mwh AS yhat_mwh,
 value_mwh * 0.9 AS yhat_lower, value_mwh * 1.1 AS yhat_upper, 'lag' || lag AS model_name, period_utc AS fit_at_utc
 FROM demand, (VALUES (24), (168)) AS l(lag)""",
    "lines": "SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "snow": "SELECT max(l_shipdate) AS now FROM lineitem",
    "generation": f"""SELECT l_shipdate AS period_utc, 'N' || s_nationkey AS ba_code, {FUEL_CASE} AS fuel_code,
 sum(l_quantity) AS value_mwh FROM lines GROUP BY 1, 2, 3""",
    "fuels": values_cte(ref.FUEL_TYPES, "fuel_code, fuel_name, category, is_renewable, is_carbon_free"),
    "regional": "SELECT * FROM lines JOIN nation ON s_nationkey = n_nationkey",
    "demand_long": f"""SELECT l_shipdate AS period_utc, 'R' || n_regionkey AS ba_code, {SERIES_CASE} AS series,
 sum(l_quantity) AS value_mwh FROM regional GROUP BY 1, 2, 3""",
    "generation_regional": f"""SELECT l_shipdate AS period_utc, 'R' || n_regionkey AS ba_code, {FUEL_CASE} AS fuel_code,
 sum(l_quantity * (0.8513 + 0.1 * n_regionkey)) AS value_mwh FROM regional WHERE l_returnflag = 'N' GROUP BY 1, 2, 3""",
    "interchange": """SELECT l_shipdate AS period_utc, 'N' || s_nationkey AS from_ba, 'N' || c_nationkey AS to_ba,
 sum(l_extendedprice * (1 - l_discount)) AS value_mwh FROM lines JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "zone_load": "SELECT l_shipdate AS period_utc, 'Z' || s_nationkey AS bidding_zone, sum(l_quantity) AS value_mw FROM lines GROUP BY 1, 2",
    "weather": """SELECT ts AS period_utc, 'BA:' || user_id AS station_id, value AS temperature_c,
 value / 2 AS wind_speed_kph, event_type AS short_forecast FROM events""",
    "stations": """SELECT CAST(c_custkey AS VARCHAR) AS ba_code, c_acctbal AS latitude, CAST(c_nationkey AS DOUBLE) AS longitude
 FROM customer""",
    "runs": f"""SELECT o_orderkey AS run_id, {SOURCE_CASE} AS source, o_orderdate AS started_at, o_custkey AS rows_written,
 {STATUS_CASE} AS status FROM orders""",
    "freshness": f"""SELECT {SOURCE_CASE} AS source, max(o_orderdate) AS last_period_utc,
 max(o_orderdate + to_hours({FETCH_HOURS})) AS last_fetch_utc, count(*) AS last_rows,
 max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'HTTP 500' END) AS last_error FROM orders GROUP BY 1""",
    "onow": "SELECT max(o_orderdate) + INTERVAL 6 HOUR AS now FROM orders",
    "sla": values_cte(ref.SOURCE_SLA_HOURS, "source, fetch_sla_h, period_sla_h"),
    "nations": """SELECT 'N' || n_nationkey AS ba_code, n_name AS ba_name, r_name AS region,
 CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS timezone FROM nation JOIN region ON n_regionkey = r_regionkey""",
}

NEEDS = {
    "dnow": ["demand"],
    "demand_raw": ["demand"],
    "day_ahead": ["demand"],
    "vintages": ["demand"],
    "generation": ["lines"],
    "regional": ["lines"],
    "demand_long": ["regional"],
    "generation_regional": ["regional"],
    "interchange": ["lines"],
    "zone_load": ["lines"],
}


def ctes(names: str, body: str, **more: str) -> str:
    """``WITH`` the named roles, further expressions in order, then the body."""
    done: dict[str, str] = {}

    def need(n: str) -> None:
        for m in NEEDS.get(n, []):
            need(m)
        done.setdefault(n, CTES[n])

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({text})" for n, text in {**done, **more}.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
