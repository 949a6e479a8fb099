"""Sources, sinks and jobs on small generated files."""

import json

import pytest

from aerolith import schemas
from aerolith.functions import fixed
from aerolith.operators import joins as J
from aerolith.plans import adapter as AD
from aerolith.plans import jobs as C
from aerolith.plans import queries_io as QI
from aerolith.sources import archive as SA
from aerolith.sources import payloads as SP
from aerolith.sources import sinks as K

SF = "/root/testdata/sf0.001"


def test_location_map_whole_file_with_null_name(spark, tmp_path):
    p = tmp_path / "location.json"
    p.write_text(json.dumps({"2178": "Del Norte", "0": None, "3": "Ünïcode"}, indent=4))
    rows = {r.location_id: r.name for r in SP.read_location_map(spark, str(p)).collect()}
    assert rows == {2178: "Del Norte", 0: None, 3: "Ünïcode"}


def test_sensor_lookup_fallbacks_and_skips(spark, tmp_path):
    doc = {"results": [{"id": 7, "name": "Loc", "sensors": [
        {"id": 1, "name": "PM25 sensor", "parameter": {"name": "PM25", "units": None}, "units": "µg/m³"},
        {"id": 2, "name": "o3", "parameter": None},
        {"id": None, "name": "no id", "parameter": {"name": "co"}},
        {"id": 4, "name": None, "parameter": {"name": None}}]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    got = {r.sensor_id: (r.parameter, r.units) for r in SP.sensor_lookup(spark, str(tmp_path)).collect()}
    assert got == {1: ("pm25", "µg/m³"), 2: ("o3", "")}


def test_corrupt_payload_quarantined(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"id": 1, "name": "x", "city": "c",
                                                              "country": "k", "timezone": "UTC",
                                                              "coordinates": {"latitude": 1.0, "longitude": 2.0}}]}))
    (tmp_path / "b.json").write_text("{not json")
    good, bad = SP.read_payload_checked(spark, "locations", str(tmp_path))
    assert good.count() == 1
    rows = bad.collect()
    assert len(rows) == 1 and rows[0].file_path.endswith("b.json")
    with pytest.raises(ValueError):
        SP.read_payload(spark, "nope", str(tmp_path))


def test_live_insert_twice_equals_once(spark, tmp_path):
    meta, latest = str(tmp_path / "meta"), str(tmp_path / "latest")
    QI.land_metadata(spark, SF, meta)
    QI.land_latest(spark, SF, latest)
    fact = str(tmp_path / "fact")
    _, n1 = C.live_collection(spark, meta, latest, fact_path=fact, multiline=False)
    _, n2 = C.live_collection(spark, meta, latest, fact_path=fact, multiline=False)
    total = spark.read.schema(schemas.RAW_AIR_QUALITY).parquet(fact).count()
    assert n1["inserted"] == total > 0 and n2["inserted"] == 0
    assert n1["failed_documents"] == 0


def test_load_measurements_reports_inserted_and_skipped(spark, tmp_path):
    m = AD.measurements(spark, SF)
    table = str(tmp_path / "m")
    distinct = m.select(*K.NATURAL_KEYS).distinct().count()
    r1 = K.load_measurements(spark, m, table)
    r2 = K.load_measurements(spark, m, table)
    assert r1 == {"inserted": distinct, "skipped": m.count() - distinct, "months": [(2024, 1)]}
    assert r2 == {"inserted": 0, "skipped": m.count(), "months": [(2024, 1)]}


def test_null_keys_are_keys_of_their_own(spark, tmp_path):
    schema = "location_id long, sensor_id long, parameter string, measurement_time timestamp_ntz, value double"
    rows = spark.sql("""SELECT * FROM VALUES (5L, CAST(NULL AS BIGINT), 'pm10', TIMESTAMP_NTZ'2024-01-01 00:00:00', 1D),
        (CAST(NULL AS BIGINT), 5L, 'pm10', TIMESTAMP_NTZ'2024-01-01 00:00:00', 2D), (1L, 1L, 'pm10', NULL, 3D)
        AS t(location_id, sensor_id, parameter, measurement_time, value)""").withColumn("id", C.natural_id())
    assert rows.schema.fieldNames()[:5] == [c.split()[0] for c in schema.split(", ")]
    table = str(tmp_path / "m")
    assert K.load_measurements(spark, rows, table) == {"inserted": 3, "skipped": 0, "months": [(2024, 1)]}
    assert K.load_measurements(spark, rows, table) == {"inserted": 0, "skipped": 3, "months": [(2024, 1)]}
    assert spark.read.parquet(table).select("id").distinct().count() == 3


def test_initialize_leaves_a_table_with_strange_content_alone(spark, tmp_path):
    paths = K.initialize_tables(spark, str(tmp_path))
    K.append_partitioned(QI.R(spark, SF).withColumn("ingestion_datetime", QI.X.utc_now()), paths["raw.air_quality"])
    n = spark.read.parquet(paths["raw.air_quality"]).count()
    (tmp_path / "raw" / "air_quality" / "run=1").mkdir()
    (tmp_path / "raw" / "air_quality" / "run=1" / "x.parquet").write_text("not parquet")
    K.initialize_tables(spark, str(tmp_path))
    kept = sum(spark.read.parquet(str(f)).count() for f in (tmp_path / "raw" / "air_quality").rglob("part-*.parquet"))
    assert kept == n


def test_broken_archive_lines_are_counted(spark, tmp_path):
    base = str(tmp_path / "a")
    SA.write_archive(QI.R(spark, SF).limit(50), base)
    folder = next((tmp_path / "a").rglob("month=*"))
    head = "location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n"
    (folder / "broken.csv").write_text(head + "x,y,z\n1,2,here,not a time,1.0,2.0,pm10,u,3.0\n")
    assert SA.corrupt_lines(spark, base).count() == 2
    assert SA.read_archive(spark, base).where("location_id IS NULL").count() == 0


def test_archive_ids_become_a_partition_filter(spark, tmp_path):
    base = str(tmp_path / "a")
    SA.write_archive(QI.R(spark, SF), base)
    ids = AD.locations(spark, SF).where("country = 'ASIA'").select("location_id")
    df = SA.select_partitions(SA.scan_archive(spark, base), ids, "2024-01", "2024-01")
    text = df._jdf.queryExecution().toString()
    filters = [x for x in text.splitlines() if "PartitionFilters" in x]
    assert filters and all("locationid" in x for x in filters)


def test_export_rejects_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        K.export(AD.locations(spark, SF), str(tmp_path / "x"), "excel")


def test_add_locations_duplicate_is_error(spark):
    loc = AD.locations(spark, SF)
    with pytest.raises(ValueError):
        J.add_locations(loc, loc.limit(1))


def test_update_with_no_columns_is_noop(spark):
    loc = AD.locations(spark, SF)
    assert J.update_locations(loc, loc.select("location_id")) is loc


def test_first_existing_table(spark):
    AD.locations(spark, SF).createOrReplaceTempView("air_quality_data")
    assert K.first_existing_table(spark, ["air_quality", "air_quality_data"]) == "air_quality_data"
    with pytest.raises(RuntimeError):
        K.first_existing_table(spark, ["nope_a", "nope_b"])


def test_download_name_slug():
    assert K.download_name("Del Norte/West", "pm25", "2024-01-01", "2024-01-31") == \
        "air_quality_del_norte_west_pm25_2024-01-01_to_2024-01-31.csv"


def test_listing_limit(spark, tmp_path):
    _, chg = QI._change_set(spark, SF)
    QI.land_listing(chg, str(tmp_path))
    docs = [len(r.results) for r in spark.read.json(str(tmp_path)).collect()]
    got = SP.locations_listing(spark, str(tmp_path), limit=7, multiline=False).count()
    assert got == sum(min(n, 7) for n in docs)  # the limit is one of each request


def test_measurement_collection_metrics(spark, tmp_path):
    path, table = str(tmp_path / "p"), str(tmp_path / "t")
    QI.land_measurement_payloads(spark, SF, path)
    stats = C.measurement_collection(spark, path, table, "2024-01-01", "2024-02-01", multiline=False)
    scored = AD.scored(spark, SF)
    assert stats["extracted"] == scored.count()
    assert stats["transformed"] == AD.measurements(spark, SF).count()
    assert stats["filtered"] == stats["extracted"] - stats["transformed"]
    # exact copies share the natural key: one of each pair is skipped
    assert stats["loaded"] + stats["skipped"] == stats["transformed"]


def test_public_helpers(spark, tmp_path):
    import datetime as dt
    from pyspark.sql import functions as F
    from aerolith.operators import ordering as L
    from aerolith.operators import aggregates as A

    m = AD.measurements(spark, SF)
    assert L.cap_rows(m, 7).count() == 7
    daily = A.daily_stats_pandas(AD.raw_air_quality(spark, SF))
    first = L.by_weekday(daily).first()
    assert first.weekday == "Monday"
    K.write_location_rows(AD.locations(spark, SF), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == AD.locations(spark, SF).count()
    lo, hi = SP.last_day_window(F.lit(dt.datetime(2024, 1, 2, 12)))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.hi - r.lo) == dt.timedelta(days=1)
    raw = spark.createDataFrame(
        [(1, 2, "L", "pm25", 10.0, "ug/m3", "2024-01-01T00:00:00Z", (1.0, 2.0)),
         (1, 2, "L", "pm25", -1.0, "ug/m3", "2024-01-01T01:00:00Z", (1.0, 2.0))],
        "locationsId long, sensorsId long, location string, parameter string, value double, unit string, "
        "datetime string, coordinates struct<latitude:double,longitude:double>")
    recs = SP.measurement_records(raw).collect()
    assert len(recs) == 1 and recs[0].latitude == 1.0 and recs[0].source == fixed.SOURCE_NAME
    assert recs[0].measurement_time == dt.datetime(2024, 1, 1)


def test_a_refresh_reads_and_writes_the_months_of_the_load(spark, tmp_path):
    from pyspark.sql import functions as F
    from aerolith.operators import aggregates as A
    m = AD.measurements(spark, SF).withColumn("measurement_time", F.add_months("measurement_time", (F.col("id") % 3).cast("int")).cast("timestamp_ntz"))
    table = str(tmp_path / "fact")
    K.load_measurements(spark, m.where("id % 5 <> 0"), table)
    fact = spark.read.schema(m.drop("year", "month").select(*[f.name for f in schemas.MEASUREMENTS.fields if f.name in m.columns]).schema
                             .add("year", "long").add("month", "string")).parquet(table)
    view = C.monthly_views(str(tmp_path))["presentation.daily_aggregates"]
    view.create(fact)
    folder = tmp_path / "presentation" / "daily_aggregates"
    files = lambda: {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    before = files()
    res = K.load_measurements(spark, m.where("id % 5 = 0 AND id % 3 = 1"), table)
    assert res["months"] == [(2024, 2)]
    fact = spark.read.schema(fact.schema).parquet(table)
    read = [p for p in K.J.in_months(fact, "measurement_time", res["months"]).inputFiles() if "month=" in p]
    pruned = K.J.in_months(fact, "measurement_time", res["months"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) > len(pruned) and all("month=02" in r.f for r in pruned)
    got = view.refresh(fact, res["months"])
    want = A.daily_aggregates(fact)
    same = lambda a, b: a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()
    assert same(got.drop("avg_value", "std_value", "avg_quality"), want.drop("avg_value", "std_value", "avg_quality"))
    kept = {k: v for k, v in files().items() if "month=02" not in k}
    assert kept == {k: v for k, v in before.items() if "month=02" not in k} and len(kept) >= 2
    assert view.refresh(fact, []).count() == want.count()
