"""Landed payloads: documents built from table columns, parsed back by the library."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from hourlake import schemas
from hourlake.functions.labels import name_or_code, split_valid_keys, wind_to_kph, wmo_text
from hourlake.functions.numbers import leading_number, safe_double
from hourlake.functions.times import parse_utc
from hourlake.reference_data import WMO_TEXT
from hourlake.operators import ranking
from hourlake.queries.bindings import ctes, values_cte
from hourlake.queries.registry import plain_time, query, rounded
from hourlake.session import shared_dir
from hourlake.sources import normalize, payloads, tables
from hourlake.streaming import rollups

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SERIES_OF = "CASE event_type WHEN 'view' THEN 'D' WHEN 'click' THEN 'NG' WHEN 'purchase' THEN 'TI' WHEN 'signup' THEN 'DF' ELSE 'XX' END"
VALUE_TEXT = "CASE WHEN user_id > 100 THEN 'abc' WHEN user_id > 90 THEN '' ELSE CAST(value AS {text}) END"


def _page(record):
    return F.to_json(F.struct(F.struct(F.array(record).alias("data")).alias("response")))


def _events(b):
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table("events").withColumn("k", k)


def _hour_text():
    return F.date_format("ts", "yyyy-MM-dd'T'HH")


def _region_pages(b):
    record = F.struct(
        _hour_text().alias("period"),
        F.col("user_id").cast("string").alias("respondent"),
        F.expr(SERIES_OF).alias("type"),
        F.expr(VALUE_TEXT.format(text="STRING")).alias("value"),
    )
    pages = _events(b).select(_page(record).alias("page"))
    return payloads.page_rows(payloads.parse_json(pages, "page", schemas.REGION_PAGE))


REGION = f"""SELECT date_trunc('hour', ts) AS period_utc, CAST(user_id AS VARCHAR) AS ba_code,
 CASE WHEN user_id > 90 THEN NULL ELSE value END AS value_mwh, {SERIES_OF} AS series, 'EIA' AS source FROM events"""


@query("region_pages_to_demand", "SRC1 NRM1 NRM2 NRM3 NRM6", f"SELECT * FROM ({REGION}) WHERE series IN ('D', 'NG', 'TI')")
def _(b):
    return plain_time(normalize.route_region(_region_pages(b))[0])


@query("region_pages_to_forecast", "SRC1 NRM3", f"SELECT period_utc, ba_code, value_mwh, source FROM ({REGION}) WHERE series = 'DF'")
def _(b):
    return plain_time(normalize.route_region(_region_pages(b))[1])


@query(
    "fuel_pages",
    "SRC2 NRM4",
    """SELECT date_trunc('hour', ts) AS period_utc, CAST(user_id AS VARCHAR) AS ba_code, event_type AS fuel_code, value AS value_mwh, 'EIA' AS source
 FROM events WHERE event_type <> 'error'""",
)
def _(b):
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("period"),
        F.col("user_id").cast("string").alias("respondent"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("fueltype"),
        F.col("value").cast("string").alias("value"),
    )
    pages = _events(b).select(_page(record).alias("page"))
    return plain_time(normalize.fuel_rows(payloads.page_rows(payloads.parse_json(pages, "page", schemas.FUEL_PAGE))))


@query(
    "interchange_pages",
    "SRC3 NRM5",
    """SELECT o_orderdate AS period_utc, CAST(o_custkey AS VARCHAR) AS from_ba, o_orderpriority AS to_ba, o_totalprice AS value_mwh, 'EIA' AS source
 FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(b):
    record = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH").alias("period"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("fromba"),
        F.col("o_orderpriority").alias("toba"),
        F.col("o_totalprice").cast("string").alias("value"),
    )
    pages = b.table("orders").select(_page(record).alias("page"))
    return plain_time(normalize.interchange_rows(payloads.page_rows(payloads.parse_json(pages, "page", schemas.INTERCHANGE_PAGE))))


# --- XML --------------------------------------------------------------------------------------

RESOLUTION = """CASE o_orderpriority WHEN '1-URGENT' THEN 'PT15M' WHEN '2-HIGH' THEN 'PT30M' WHEN '3-MEDIUM' THEN 'PT60M'
 WHEN '4-NOT SPECIFIED' THEN 'PT1H' ELSE 'P1D' END"""
STEP = "CASE o_orderpriority WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 30 ELSE 60 END"


#: A document is read whole by one task, so its series are bounded, however many a task lands.
SERIES_PER_DOCUMENT = 50_000


def _as_documents(batches):
    """The series of one task as full documents and a last one with the rest, a line per tag and series."""
    start, end = (pd.DataFrame({"value": [tag]}) for tag in ("<GL_MarketDocument>", "</GL_MarketDocument>"))
    room = SERIES_PER_DOCUMENT
    yield start
    for batch in batches:
        while len(batch) > room:
            yield from (batch[:room], end, start)
            batch, room = batch[room:], SERIES_PER_DOCUMENT
        yield batch
        room -= len(batch)
    yield end


def _landed_series(b):
    """Landed XML documents, one per file, read back as TimeSeries elements.

    Each line of an order is a series with one point that has a quantity and one that has none;
    returned lines name no production type.
    """
    rows = b.table("lineitem").join(b.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.col("l_linenumber").cast("string")
    kind = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("<MktPSRType><psrType>B0"), line, F.lit("</psrType></MktPSRType>")))
    series = F.concat(
        F.lit("<TimeSeries><zone>"),
        F.col("l_returnflag"),
        F.lit("</zone>"),
        F.coalesce(kind, F.lit("")),
        F.lit("<Period><timeInterval><start>"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"),
        F.lit("Z</start></timeInterval><resolution>"),
        F.expr(RESOLUTION),
        F.lit("</resolution><Point><position>"),
        line,
        F.lit("</position><quantity>"),
        F.col("l_quantity").cast("string"),
        F.lit("</quantity></Point><Point><position>9</position></Point></Period></TimeSeries>"),
    )
    landing = shared_dir(b.spark, "landing")
    documents = rows.select(series.alias("value")).mapInPandas(_as_documents, "value string")
    documents.write.option("maxRecordsPerFile", SERIES_PER_DOCUMENT + 2).text(landing)
    return payloads.read_series_xml(b.spark, landing, {"zone": "string"})


POINTS = f"""SELECT o_orderdate + to_minutes({STEP} * (l_linenumber - 1)) AS period_utc, l_returnflag AS bidding_zone, l_quantity AS value_mw"""


@query(
    "load_documents",
    "SRC4 SRC6 NRM6",
    f"{POINTS}, 'A16' AS process_type, 'ENTSOE' AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(b):
    return plain_time(normalize.entsoe_load_rows(payloads.entsoe_points(_landed_series(b), "zone")))


@query(
    "generation_documents",
    "SRC5 SRC6",
    f"{POINTS}, 'B0' || l_linenumber AS psr_type, 'ENTSOE' AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'",
)
def _(b):
    return plain_time(normalize.entsoe_generation_rows(payloads.entsoe_points(_landed_series(b), "zone")))


# --- weather ----------------------------------------------------------------------------------


@query(
    "hourly_forecast_documents",
    "SRC7 NRM7 NRM8 NRM10",
    f"""SELECT date_trunc('second', ts) + INTERVAL 5 HOUR AS period_utc, 'BA:' || user_id AS station_id, round((value - 32) * 5 / 9, 4) AS temperature_c,
 round(CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN k ELSE k + 2.5 END * 1.609344, 4) AS wind_speed_kph,
 CAST(k AS DOUBLE) AS cloud_cover_pct, event_type AS short_forecast FROM (SELECT *, {K} AS k FROM events)""",
)
def _(b):
    k = F.col("k").cast("string")
    wind = F.when(F.col("event_type") == "view", F.concat(k, F.lit(" mph"))).when(
        F.col("event_type") != "error", F.concat(k, F.lit(" to "), (F.col("k") + 5).cast("string"), F.lit(" mph"))
    )
    period = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")).alias("startTime"),
        F.col("value").alias("temperature"),
        F.coalesce(wind, F.lit("calm")).alias("windSpeed"),
        F.struct(F.col("k").cast("double").alias("value")).alias("relativeHumidity"),
        F.col("event_type").alias("shortForecast"),
    )
    doc = F.to_json(F.struct(F.struct(F.array(period).alias("periods")).alias("properties")))
    docs = _events(b).select(F.col("user_id").cast("string").alias("ba_code"), doc.alias("doc"))
    return plain_time(rounded(payloads.noaa_rows(payloads.parse_json(docs, "doc", schemas.NOAA_HOURLY))))


WMO_SQL = values_cte(list(WMO_TEXT.items()), "code, text")


@query(
    "parallel_array_documents",
    "SRC8 NRM9",
    ctes(
        "",
        """SELECT date_trunc('minute', ts) AS period_utc, 'EU:' || user_id AS station_id, value AS temperature_c, value AS wind_speed_kph,
 CAST(k AS DOUBLE) AS cloud_cover_pct, coalesce(text, 'WMO ' || k) AS short_forecast FROM e LEFT JOIN wmo ON code = k
 UNION ALL SELECT date_trunc('minute', ts) + INTERVAL 1 HOUR, 'EU:' || user_id, NULL, value / 2, NULL, coalesce(text, 'WMO ' || (k + 1))
 FROM e LEFT JOIN wmo ON code = k + 1""",
        e=f"SELECT *, {K} AS k FROM events",
        wmo=WMO_SQL,
    ),
)
def _(b):
    first = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    second = F.date_format(F.col("ts") + F.expr("INTERVAL '1' HOUR"), "yyyy-MM-dd'T'HH:mm")
    v, k = F.col("value"), F.col("k").cast("double")
    hourly = F.struct(
        F.array(first, F.lit(None).cast("string"), second).alias("time"),
        F.array(v).alias("temperature_2m"),
        F.array(v, F.lit(None).cast("double"), v / 2).alias("windspeed_10m"),
        F.array(k).alias("cloudcover"),
        F.array(k, k, k + 1).alias("weathercode"),
    )
    docs = _events(b).select(F.col("user_id").cast("string").alias("zone_eic"), F.to_json(F.struct(hourly.alias("hourly"))).alias("doc"))
    return plain_time(payloads.openmeteo_rows(payloads.parse_json(docs, "doc", schemas.OPENMETEO_HOURLY)))


@query(
    "weather_codes",
    "NRM9 SRC10",
    ctes(
        "",
        "SELECT coalesce(text, 'WMO ' || p_size) AS condition, count(*) AS n FROM part LEFT JOIN wmo ON code = p_size GROUP BY 1",
        wmo=WMO_SQL,
    ),
)
def _(b):
    return b.table("part").groupBy(wmo_text("p_size").alias("condition")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "wind_texts",
    "NRM7",
    """SELECT p_partkey, round(CASE WHEN p_size < 10 THEN NULL WHEN p_size < 30 THEN p_size * 1.609344
 ELSE (p_size + p_size + 5) / 2.0 * 1.609344 END, 4) AS kph FROM part""",
)
def _(b):
    s = F.col("p_size")
    t = s.cast("string")
    text = (
        F.when(s < 10, F.lit("variable"))
        .when(s < 30, F.concat(t, F.lit("kph")))
        .otherwise(F.concat(t, F.lit(" to "), (s + 5).cast("string"), F.lit(" mph")))
    )
    return rounded(b.table("part").select("p_partkey", wind_to_kph(text).alias("kph")))


# --- values, keys, names ----------------------------------------------------------------------


@query(
    "numbers_from_text",
    "NRM2 NRM13",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice END AS strict,
 CASE o_orderstatus WHEN 'P' THEN o_totalprice WHEN 'F' THEN o_totalprice ELSE NULL END AS lenient FROM orders""",
)
def _(b):
    price = F.col("o_totalprice").cast("string")
    status = F.col("o_orderstatus")
    strict = F.when(status == "P", F.concat(price, F.lit("d"))).otherwise(F.concat(F.lit(" "), price))
    lenient = (
        F.when(status == "P", F.concat(price, F.lit(" USD"))).when(status == "F", price).otherwise(F.concat(F.lit("USD "), price))
    )
    return b.table("orders").select("o_orderkey", safe_double(strict).alias("strict"), leading_number(lenient).alias("lenient"))


@query(
    "times_from_text",
    "NRM13",
    """SELECT event_id, date_trunc('second', ts) AS no_zone, date_trunc('second', ts) AS zulu,
 date_trunc('second', ts) - INTERVAL 2 HOUR AS shifted FROM events""",
)
def _(b):
    blank = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return plain_time(
        b.table("events").select(
            "event_id",
            parse_utc(blank).alias("no_zone"),
            parse_utc(F.concat(iso, F.lit("Z"))).alias("zulu"),
            parse_utc(F.concat(iso, F.lit("+02:00"))).alias("shifted"),
        )
    )


@query(
    "well_formed_keys",
    "NRM12",
    r"""SELECT regexp_full_match(o_orderpriority, '[A-Za-z0-9_-]{1,20}') AS ok, o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def _(b):
    good, bad = split_valid_keys(b.table("orders").select(F.col("o_orderpriority").alias("code")), "code")
    both = ranking.union_all(good.withColumn("ok", F.lit(True)), bad.withColumn("ok", F.lit(False)))
    return both.groupBy("ok", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "names_with_fallback",
    "NRM11",
    "SELECT p_partkey, coalesce(n_name, 'key ' || p_size) AS shown FROM part LEFT JOIN nation ON p_size = n_nationkey",
)
def _(b):
    """Sizes read as keys of nations: those above the last nation have no name."""
    rows = b.table("part").join(b.table("nation"), F.col("p_size") == F.col("n_nationkey"), "left")
    code = F.concat(F.lit("key "), F.col("p_size").cast("string"))
    return rows.select("p_partkey", name_or_code("n_name", code).alias("shown"))


@query(
    "reference_keys",
    "NRM14 SET2",
    ctes(
        "nations",
        """SELECT coalesce(n.ba_code, c.ba_code) AS ba_code, coalesce(n.ba_name, n.ba_code, c.ba_code) AS ba_name, n.region, 'US' AS country,
 CAST(NULL AS VARCHAR) AS timezone FROM nations n FULL OUTER JOIN (SELECT DISTINCT 'N' || p_size AS ba_code FROM part) c ON n.ba_code = c.ba_code""",
    ),
)
def _(b):
    centroids = b.table("part").select(F.concat(F.lit("N"), F.col("p_size").cast("string")).alias("ba_code")).distinct()
    return tables.authority_dimension(b.nations, centroids)


@query(
    "catchup_start",
    "SRC11",
    ctes(
        "dnow",
        "SELECT greatest(now - INTERVAL 3 HOUR, now + INTERVAL 10 HOUR - INTERVAL 168 HOUR) AS start_utc, now AS last_period_utc FROM dnow",
    ),
)
def _(b):
    return tables.catchup_start(b.demand, b.demand_now + F.expr("INTERVAL '10' HOUR"))


@query("csv_seed", "SRC9", "SELECT n_nationkey, n_name, n_regionkey, n_regionkey > 2 AS is_far FROM nation")
def _(b):
    """The nation table as a landed CSV seed, read with declared types."""
    landing = shared_dir(b.spark, "seed")
    seed = b.table("nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_regionkey") > 2).alias("is_far"))
    seed.write.option("header", "true").csv(landing)
    return tables.read_seed_csv(b.spark, landing, seed.schema)


LANDED_SQL = ctes(
    "demand generation interchange",
    """SELECT 'demand' AS kind, period_utc, ba_code AS k, CAST(NULL AS VARCHAR) AS l, round(value_mwh + CASE WHEN day(period_utc) <= 3 THEN 1000 ELSE 0 END, 4) AS value_mwh FROM demand
 UNION ALL SELECT 'fuel', period_utc, ba_code, fuel_code, round(value_mwh, 4) FROM generation
 UNION ALL SELECT 'interchange', period_utc, from_ba, to_ba, round(value_mwh, 4) FROM interchange""",
)


def _land(b, df, record, part, files: int, path: str) -> None:
    """Pages of a day's records each, as JSON documents in several files."""
    pages = df.groupBy(part.alias("part")).agg(F.collect_list(record).alias("data"))
    documents = pages.repartition(files, "part").select(F.to_json(F.struct(F.struct("data").alias("response"))).alias("value"))
    documents.write.mode("append").text(path)


@query("landed_pages", "SRC1 SRC2 SRC3 SRC12 NRM3 NRM4 NRM5 SNK1 STR4", LANDED_SQL)
def _(b):
    """Pages of many records in several files, read as streams of a file per micro-batch into stored tables. The
    first days of demand come again, corrected, in files that land after the rest."""
    base = shared_dir(b.spark, "landing")
    period, value = F.date_format("period_utc", "yyyy-MM-dd'T'HH").alias("period"), F.col("value_mwh").cast("string").alias("value")
    day = F.to_date("period_utc")
    region = F.struct(period, F.col("ba_code").alias("respondent"), F.lit("D").alias("type"), value)
    fuel = F.struct(period, F.col("ba_code").alias("respondent"), F.col("fuel_code").alias("fueltype"), value)
    flow = F.struct(period, F.col("from_ba").alias("fromba"), F.col("to_ba").alias("toba"), value)
    _land(b, b.demand, region, day, 3, f"{base}/region")
    late = b.demand.where(F.dayofmonth("period_utc") <= 3).withColumn("value_mwh", F.col("value_mwh") + 1000)
    _land(b, late, region, day, 1, f"{base}/region")
    _land(b, b.generation, fuel, F.trunc("period_utc", "month"), 2, f"{base}/fuel")
    _land(b, b.interchange, flow, F.trunc("period_utc", "month"), 2, f"{base}/interchange")
    feeds = {
        "region": (schemas.REGION_PAGE, lambda rows: normalize.route_region(rows)[0], ["period_utc", "ba_code", "series"], "day"),
        "fuel": (schemas.FUEL_PAGE, normalize.fuel_rows, ["period_utc", "ba_code", "fuel_code"], "month"),
        "interchange": (schemas.INTERCHANGE_PAGE, normalize.interchange_rows, ["period_utc", "from_ba", "to_ba"], "month"),
    }
    parts = []
    for name, (schema, rows, keys, grain) in feeds.items():
        pages = payloads.read_json_docs(b.spark, f"{base}/{name}", schema, stream=True, max_files_per_trigger=1)
        rollups.stream_upsert(rows(payloads.page_rows(pages)), f"{base}/{name}-table", keys, f"{base}/{name}-checkpoint", grain=grain)
        other = {"region": F.lit(None).cast("string"), "fuel": F.col("fuel_code"), "interchange": F.col("to_ba")}[name]
        kind, first = ("demand" if name == "region" else name), ("from_ba" if name == "interchange" else "ba_code")
        stored = b.spark.read.parquet(f"{base}/{name}-table")
        parts.append(stored.select(F.lit(kind).alias("kind"), "period_utc", F.col(first).alias("k"), other.alias("l"), "value_mwh"))
    return plain_time(rounded(ranking.union_all(*parts)))
