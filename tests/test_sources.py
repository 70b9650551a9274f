import datetime as dt
import json
from xml.etree import ElementTree

import pytest

import __spark_entry__ as entry
from hourlake import schemas
from hourlake.operators import upkeep
from hourlake.queries import payloads as landed
from hourlake.sources import normalize, payloads, tables


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_region_pages_are_routed(spark, tmp_path):
    record = {"period": "2026-06-17T00", "respondent": "PJM", "value": "100"}
    kinds = ["D", "DF", "NG", "TI", "XX"]
    rows = [{**record, "type": k} for k in kinds] + [{**record, "respondent": None, "type": "D"}]
    for i, part in enumerate((rows[:3], rows[3:])):
        write(tmp_path / "in", f"{i}.json", json.dumps({"response": {"data": part}}))
    records = payloads.page_rows(payloads.read_json_docs(spark, str(tmp_path / "in"), schemas.REGION_PAGE))
    demand, forecast = normalize.route_region(records)
    assert sorted(r.series for r in demand.collect()) == ["D", "NG", "TI"]
    assert forecast.collect()[0].value_mwh == 100.0
    assert demand.schema == schemas.DEMAND or demand.columns == ["period_utc", "ba_code", "value_mwh", "series", "source"]


def test_documents_with_gaps_keep_their_times(spark, tmp_path):
    doc = """<GL xmlns="urn:some:ns"><TimeSeries><MktPSRType><psrType>B16</psrType></MktPSRType><Period><timeInterval>
    <start>2026-01-01T00:00Z</start><end>2026-01-01T01:00Z</end></timeInterval><resolution>PT15M</resolution>
    <Point><position>1</position><quantity>10</quantity></Point><Point><position>3</position><quantity>12.5</quantity></Point>
    <Point><position>4</position></Point></Period></TimeSeries>
    <TimeSeries><Period><timeInterval><start>2026-01-01T00:00Z</start></timeInterval><resolution>PT60M</resolution>
    <Point><position>2</position><quantity>5</quantity></Point></Period></TimeSeries></GL>"""
    write(tmp_path / "xml" / "zone=Z1", "a.xml", doc)
    series = payloads.read_series_xml(spark, str(tmp_path / "xml"), {"zone": "string"})
    points = payloads.entsoe_points(series, "zone")
    load = sorted((r.period_utc.hour * 60 + r.period_utc.minute, r.value_mw) for r in normalize.entsoe_load_rows(points).collect())
    assert load == [(0, 10.0), (30, 12.5), (60, 5.0)]
    assert [r.psr_type for r in normalize.entsoe_generation_rows(points).collect()] == ["B16", "B16"]


@pytest.mark.parametrize("name", ["load_documents", "generation_documents"])
@pytest.mark.parametrize("n", [0, 50_000, 120_000])
def test_documents_of_a_full_task_are_bounded(spark, tmp_path, monkeypatch, name, n):
    lines = spark.range(n).coalesce(1).selectExpr("0L AS l_orderkey", "1 AS l_linenumber", "'A' AS l_returnflag", "CAST(id AS DOUBLE) AS l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    order = spark.range(1).selectExpr("id AS o_orderkey", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS o_orderdate", "'2-HIGH' AS o_orderpriority")
    order.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(landed, "shared_dir", lambda spark, kind: f"{tmp_path}/{kind}")
    got = entry.queries()[name](spark, str(tmp_path)).selectExpr("count(*) AS n", "count(DISTINCT value_mw) AS m", "sum(value_mw) AS total").first()
    assert (got.n, got.m, got.total or 0) == (n, n, n * (n - 1) / 2)
    roots = [ElementTree.parse(f).getroot() for f in (tmp_path / "landing").glob("part-*") if f.stat().st_size]
    assert {r.tag for r in roots} <= {"GL_MarketDocument"} and all({e.tag for e in r} <= {"TimeSeries"} for r in roots)
    sizes = [len(r) for r in roots]
    assert sum(sizes) == n and max(sizes, default=0) <= 50_000


def test_hourly_forecast_document(spark, tmp_path):
    periods = [
        {"startTime": "2026-01-01T00:00:00-05:00", "temperature": 80, "windSpeed": "10 to 15 mph", "relativeHumidity": {"value": 40}, "shortForecast": "Sunny"},
        {"startTime": "", "temperature": 1},
        {"startTime": "2026-01-01T01:00:00-05:00", "temperature": None, "windSpeed": None},
    ]
    write(tmp_path / "noaa" / "ba_code=PJM", "a.json", json.dumps({"properties": {"periods": periods}}))
    rows = payloads.noaa_rows(payloads.read_json_docs(spark, str(tmp_path / "noaa"), schemas.NOAA_HOURLY, {"ba_code": "string"})).orderBy("period_utc").collect()
    assert len(rows) == 2 and rows[0].station_id == "BA:PJM"
    assert (rows[0].temperature_c, rows[0].wind_speed_kph, rows[0].cloud_cover_pct) == pytest.approx((26.6667, 20.1168, 40.0), abs=1e-4)
    assert rows[1].temperature_c is None and rows[1].wind_speed_kph is None


def test_parallel_arrays_may_be_short(spark, tmp_path):
    hourly = {"time": ["2026-01-01T00:00", None, "2026-01-01T02:00"], "temperature_2m": [21.4], "windspeed_10m": [1, 2, 3], "cloudcover": [], "weathercode": [2, 3, 123]}
    write(tmp_path / "om" / "zone_eic=Z", "a.json", json.dumps({"latitude": 1.0, "longitude": 2.0, "hourly": hourly}))
    docs = payloads.read_json_docs(spark, str(tmp_path / "om"), schemas.OPENMETEO_HOURLY, {"zone_eic": "string"})
    rows = payloads.openmeteo_rows(docs).orderBy("period_utc").collect()
    assert [(r.temperature_c, r.wind_speed_kph, r.short_forecast) for r in rows] == [(21.4, 1.0, "Partly cloudy"), (None, 3.0, "WMO 123")]


def test_reference_tables(spark, frame):
    meta = frame([("PJM", " ", "East", "", None), ("ZZZ", "Zed", None, "CA", "UTC"), ("", "x", "x", "x", "x")], schemas.BALANCING_AUTHORITY)
    seeded = {r.ba_code: r for r in tables.seed_reference(spark, meta)["balancing_authority"].collect()}
    assert (seeded["PJM"].ba_name, seeded["PJM"].country) == ("PJM", "US")
    assert seeded["ZZZ"].country == "CA" and seeded["IID"].ba_name == "IID"
    assert "" not in seeded
    names = {r.zone_eic: r.zone_name for r in tables.europe_zones(spark).collect()}
    assert len(names) == 20 and all(names.values())
    for coded in (tables.production_types(spark), tables.wmo_codes(spark)):
        assert coded.count() == coded.select(coded.columns[0]).distinct().count() > 0


def test_catchup_start_is_bounded(spark, frame):
    now = dt.datetime(2026, 1, 10, 5, 30)
    recent = frame([(dt.datetime(2026, 1, 10, 1),)], "period_utc timestamp_ntz")
    old = frame([(dt.datetime(2025, 1, 1),)], "period_utc timestamp_ntz")
    starts = [tables.catchup_start(t, now).first().start_utc for t in (recent, old, old.limit(0))]
    assert starts == [dt.datetime(2026, 1, 9, 22), dt.datetime(2026, 1, 3, 5), dt.datetime(2026, 1, 3, 5)]


def test_range_scan_prunes_partitions(spark, frame, tmp_path):
    rows = [(dt.datetime(2026, 1, d, h), "A", 1.0) for d in range(1, 6) for h in (0, 12)]
    path = str(tmp_path / "t")
    upkeep.append_rows(frame(rows, "period_utc timestamp_ntz, ba_code string, value_mwh double"), path)
    df = tables.read_facts(spark, path, dt.datetime(2026, 1, 2, 12), dt.datetime(2026, 1, 4), ba_code="A")
    assert df.count() == 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan and "EqualTo(ba_code,A)" in plan
    assert "GreaterThan(period_utc" in plan
