"""Checked round-trip queries over sources, sinks, jobs and streams.

Each builder lands data derived from the driver tables in a fresh folder
under the shared checkpoint root, runs the operator or job that reads it
back, and returns the rows; the oracle recomputes the same content from the
driver tables in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import aggregates as A
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.plans import adapter as AD
from aerolith.plans import jobs as C
from aerolith.plans.adapter import oracle
from aerolith.plans.queries_core import (CHG_CTES, DAILY_PANDAS_BODY, GEN1_VALID, PROFILE_CTES, WIDE_CTE,
                                         _change_set)
from aerolith.plans.registry import dates_as_timestamps, register, rounded
from aerolith.session import scratch_path
from aerolith.sources import archive as SA
from aerolith.sources import payloads as SP
from aerolith.sources import sinks as K
from aerolith.streaming import ingest as T

M, S, R, LOC = AD.measurements, AD.scored, AD.raw_air_quality, AD.locations
RAW_COLS = ["location_id", "sensors_id", "location", "datetime", "lat", "lon", "parameter",
            "units", "value", "locationid", "month", "year"]
RAW_COLS_SQL = ", ".join(RAW_COLS)


def _iso(col: str):
    """NTZ -> ISO-8601 text with a UTC offset."""
    return F.date_format(F.col(col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


# ============================================================== archive
@register("archive_roundtrip", oracle(f"SELECT {RAW_COLS_SQL} FROM raw_aq"))
def q_archive_roundtrip(spark, d):
    base = scratch_path(spark, "archive")
    SA.write_archive(R(spark, d), base)
    ids = LOC(spark, d).select("location_id")
    return SA.read_archive(spark, base, ids, "2023-11", "2024-01").drop("ingestion_datetime")


@register("archive_missing_partitions", oracle("""
SELECT c.c_custkey AS locationid, t.year, t.month
FROM customer c CROSS JOIN (VALUES (CAST(2023 AS BIGINT), '11'), (CAST(2023 AS BIGINT), '12'),
                                   (CAST(2024 AS BIGINT), '01')) t(year, month)
WHERE NOT EXISTS (SELECT 1 FROM raw_aq r WHERE r.locationid = c.c_custkey AND r.year = t.year
                  AND r.month = t.month)"""))
def q_archive_missing(spark, d):
    base = scratch_path(spark, "archive")
    SA.write_archive(R(spark, d), base)
    ids = LOC(spark, d).select("location_id")
    return SA.missing_partitions(spark, base, ids, "2023-11", "2024-01")


@register("archive_backfill", oracle(f"SELECT {RAW_COLS_SQL} FROM raw_aq"))
def q_archive_backfill(spark, d):
    base = scratch_path(spark, "archive")
    SA.write_archive(R(spark, d), base)
    mp = scratch_path(spark, "locmap")
    K.write_location_map(LOC(spark, d), mp)
    fact = scratch_path(spark, "fact")
    res = C.archive_backfill(spark, base, mp, "2024-01", "2024-01", fact, map_whole_file=False)
    if res["appended"] <= 0:
        raise RuntimeError("backfill appended nothing")
    return spark.read.schema(schemas.RAW_AIR_QUALITY).parquet(fact).select(*RAW_COLS)


BAD_LINES = """
spots AS (SELECT DISTINCT locationid, year, month FROM raw_aq)"""


def land_bad_lines(raw: DataFrame, base: str) -> None:
    """A file in every partition of an archive with a line of each kind that is no plain row: an empty
    time, a time that is none, a sensor id that is none."""
    at = raw.select("locationid", "year", "month").distinct()
    kinds = F.array(*[F.struct(F.lit(sensor).alias("sensors_id"), F.lit(t).alias("datetime"))
                      for sensor, t in (("1", None), ("2", "yesterday"), ("three", "2024-01-01T00:00:00Z"))])
    lines = at.select("*", F.explode(kinds).alias("k")).select(
        F.col("locationid").cast("string").alias("location_id"), "k.sensors_id", F.lit("here").alias("location"), "k.datetime",
        F.lit("1.5").alias("lat"), F.lit("2.5").alias("lon"), F.lit("pm10").alias("parameter"), F.lit("ug/m3").alias("units"),
        F.lit("3.5").alias("value"), "locationid", "year", "month")
    SA.write_folders(lines, base, "append")


@register("archive_ledger", oracle("""
SELECT n + 3 * p AS lines, n + p AS appended, p AS without_time, 2 * p AS corrupt_lines, 0 AS outside, 2 * p AS kept_aside, p AS null_times
FROM (SELECT COUNT(*) AS n FROM raw_aq), (SELECT COUNT(*) AS p FROM spots)""", BAD_LINES))
def q_archive_ledger(spark, d):
    """O-C1, O-S1: every line of the archive is counted once, and is in the fact or kept aside."""
    base, fact, aside = (scratch_path(spark, x) for x in ("archive", "fact", "rejects"))
    SA.write_archive(R(spark, d), base)
    land_bad_lines(R(spark, d), base)
    mp = scratch_path(spark, "locmap")
    K.write_location_map(LOC(spark, d), mp)
    res = C.archive_backfill(spark, base, mp, "2024-01", "2024-01", fact, map_whole_file=False, rejects_path=aside)
    stored = spark.read.schema(schemas.RAW_AIR_QUALITY).parquet(fact)
    counts = ("lines", "appended", "without_time", "corrupt_lines", "outside")
    return (stored.agg(F.count(F.lit(1)).alias("appended"), F.count(F.when(F.col("datetime").isNull(), F.lit(1))).alias("null_times"))
            .select("appended", "null_times", *[F.lit(res[c]).cast("bigint").alias(c) for c in counts if c != "appended"],
                    F.lit(spark.read.parquet(aside).count()).alias("kept_aside")))


# ============================================================== location map
@register("location_map_roundtrip", oracle("SELECT location_id, name FROM locations"))
def q_location_map(spark, d):
    path = scratch_path(spark, "locmap")
    K.write_location_map(LOC(spark, d), path, shard_size=100)
    return SP.read_location_map(spark, path, whole_file=False)


@register("location_map_rejects", oracle("""
SELECT 'not JSON' AS reason, COUNT(DISTINCT CAST(floor(location_id / 100) AS BIGINT)) AS n FROM locations
UNION ALL SELECT 'an id is no number', COUNT(DISTINCT CAST(floor(location_id / 100) AS BIGINT)) FROM locations
UNION ALL SELECT 'rows', COUNT(*) FROM locations"""))
def q_location_map_rejects(spark, d):
    """O-S4: beside each shard of a map stand one that is cut short and one with a name for an id."""
    path = scratch_path(spark, "locmap")
    K.write_location_map(LOC(spark, d), path, shard_size=100)
    shards = spark.read.text(path)
    cut = shards.select(F.expr("substring(value, 1, length(value) - 4)").alias("value"))
    named = shards.select(F.regexp_replace("value", r'^\{"', '{"near ').alias("value"))
    cut.unionByName(named).write.mode("append").text(path)
    rows = SP.read_location_map(spark, path, whole_file=False, strict=False).agg(F.count(F.lit(1)).alias("n"))
    bad = SP.rejected_map_shards(spark, path, whole_file=False).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return bad.unionByName(rows.select(F.lit("rows").alias("reason"), "n"))


# ============================================================== payloads
def _sensor_key():
    return AD.sensor_key("location_id", "sensor_id", "parameter")


def land_metadata(spark, d, path):
    """One metadata document per location with its distinct sensors."""
    m = M(spark, d)
    sensor = F.struct(_sensor_key().alias("id"), F.col("parameter").alias("name"),
                      F.col("unit").alias("units"),
                      F.struct(F.col("parameter").alias("name"), F.col("unit").alias("units"))
                      .alias("parameter"))
    docs = (m.groupBy("location_id", "location").agg(F.array_sort(F.collect_set(sensor)).alias("sensors"))
            .select(F.array(F.struct(F.col("location_id").alias("id"), F.col("location").alias("name"),
                                     "sensors")).alias("results")))
    docs.write.mode("overwrite").json(path)


def land_latest(spark, d, path, n=fixed.PAYLOAD_LATEST_LIMIT):
    """One latest document per location: its newest ``n`` readings."""
    m = M(spark, d).withColumn("sensor_key", _sensor_key())
    top = W.ranked_latest(m, ["location_id"], [F.col("measurement_time").desc(),
                                               F.col("sensor_key").desc()], n)
    item = F.struct(F.col("sensor_key").alias("sensorsId"), F.col("location_id").alias("locationsId"),
                    "value", F.struct(_iso("measurement_time").alias("utc"),
                                      _iso("measurement_time").alias("local")).alias("datetime"),
                    F.struct("latitude", "longitude").alias("coordinates"))
    docs = top.groupBy("location_id").agg(F.collect_list(item).alias("results")).select("results")
    docs.write.mode("overwrite").json(path)


LIVE_CTES = """
mk AS (SELECT m.*, CAST(location_id * 10000 + sensor_id * 100 +
          CASE parameter WHEN 'pm25' THEN 1 WHEN 'pm10' THEN 2 WHEN 'so2' THEN 3
                         WHEN 'no2' THEN 4 ELSE 5 END AS BIGINT) AS sensor_key FROM measurements m),
live AS (SELECT location_id, sensor_key AS sensors_id, location, measurement_time AS datetime,
                latitude AS lat, longitude AS lon, parameter, unit AS units, value,
                location_id AS locationid, strftime(measurement_time, '%m') AS month,
                CAST(year(measurement_time) AS BIGINT) AS year
         FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id
                     ORDER BY measurement_time DESC, sensor_key DESC) AS rn FROM mk) t WHERE rn <= 100),
seed AS (SELECT location_id, sensor_key AS sensors_id, location, measurement_time AS datetime,
                latitude AS lat, longitude AS lon, parameter, unit AS units, value,
                location_id AS locationid, strftime(measurement_time, '%m') AS month,
                CAST(year(measurement_time) AS BIGINT) AS year
         FROM mk WHERE measurement_time < TIMESTAMP '2024-01-29')"""


def _payload_dirs(spark, d):
    """Metadata and latest payloads; the metadata is landed by two polls."""
    meta, latest = scratch_path(spark, "meta"), scratch_path(spark, "latest")
    land_metadata(spark, d, f"{meta}/poll=1")
    land_metadata(spark, d, f"{meta}/poll=2")
    land_latest(spark, d, latest)
    return f"{meta}/poll=*", latest


def _broken_document(spark, path):
    """One document of a payload folder cut short, as a broken download leaves it."""
    spark.createDataFrame([('{"results": [{"locationsId": 1, "val',)], "value string").write.mode("append").text(path)


@register("quarantined_documents", oracle("""
SELECT 'locations' AS kind, 1 AS bad_documents, COUNT(*) AS good_rows FROM chg
UNION ALL SELECT 'measurements', 1, COUNT(*) FROM scored""", CHG_CTES))
def q_quarantined_documents(spark, d):
    """O-E3: every good document is read, the broken one of each folder is kept and counted."""
    _, chg = _change_set(spark, d)
    listing, payload = scratch_path(spark, "listing"), scratch_path(spark, "mpayload")
    land_listing(chg, listing)
    land_measurement_payloads(spark, d, payload)
    out = None
    for kind, path in (("locations", listing), ("measurements", payload)):
        _broken_document(spark, path)
        good, bad = SP.read_payload_checked(spark, kind, path, multiline=False)
        row = (good.agg(F.count(F.lit(1)).alias("good_rows"))
               .select(F.lit(kind).alias("kind"), F.lit(bad.count()).alias("bad_documents"), "good_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def land_odd_payloads(spark, d, path, per_doc: int = 100) -> None:
    """Measurement documents in which some readings of each are not as the schema has them: by the last
    digit of the id 3 has a value that is no number, 4 a number as text, 5 a location that is no number,
    6 a time that is none, 7 no time, 8 no object for its coordinates, and 9 is a bare text."""
    k = F.col("id") % 10
    field = lambda name, x: F.concat(F.lit(f'"{name}":'), x)
    text = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.lit(1 << 20))  # noqa: E731  ends with the brace
    json_of = lambda x: F.regexp_replace(text(F.coalesce(x.cast("string"), F.lit(""))), r"\}$", "")
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    value = F.when(k == 3, F.lit('"n/a"')).when((k == 4) & F.col("value").isNotNull(), json_of(F.col("value"))).otherwise(number(F.col("value")))
    place = F.when(k == 5, F.lit('"unknown"')).otherwise(number(F.col("location_id")))
    time = F.when(k == 6, F.lit('"yesterday"')).when(k == 7, F.lit("null")).otherwise(json_of(_iso("measurement_time")))
    where = F.when(k == 8, F.lit('"north"')).otherwise(F.to_json(F.struct("latitude", "longitude")))
    whole = F.concat(F.lit("{"), F.concat_ws(",", field("locationsId", place), field("sensorsId", number(F.col("sensor_id"))),
                     field("location", json_of(F.col("location"))), field("parameter", json_of(F.col("parameter"))), field("value", value),
                     field("unit", json_of(F.col("unit"))), field("datetime", time), field("coordinates", where)), F.lit("}"))
    items = S(spark, d).select("id", F.when(k == 9, F.lit('"lost"')).otherwise(whole).alias("item"))
    docs = (items.groupBy(F.floor(F.col("id") / per_doc).alias("_doc"))
            .agg(F.concat(F.lit('{"results":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value")))
    docs.select("value").write.mode("overwrite").text(path)
    spark.createDataFrame([('{"results": [{"locationsId": 1, "val',), ('{"detail": "rate limit exceeded"}',)], "value string") \
         .write.mode("append").text(path)


@register("payload_salvage", oracle("""
SELECT location_id, sensor_id, location, parameter, CASE WHEN id % 10 = 3 THEN NULL ELSE value END AS value, unit, measurement_time,
       CASE WHEN id % 10 = 8 THEN NULL ELSE latitude END AS latitude, CASE WHEN id % 10 = 8 THEN NULL ELSE longitude END AS longitude
FROM scored WHERE id % 10 NOT IN (5, 6, 7, 9)"""))
def q_payload_salvage(spark, d):
    """O-S9, O-S8, O-F16: a reading of a wrong type costs its field or itself, not its document."""
    path = scratch_path(spark, "mpayload")
    land_odd_payloads(spark, d, path)
    rows = SP.measurement_rows(SP.read_payload(spark, "measurements", path, multiline=False))
    return rows.select("location_id", "sensor_id", F.col("location_name").alias("location"), "parameter", "value", "unit",
                       "measurement_time", "latitude", "longitude")


@register("payload_rejects", oracle("""
SELECT CASE WHEN id % 10 IN (3, 8) THEN 'repaired' ELSE 'rejected' END AS status,
       CASE id % 10 WHEN 3 THEN 'value' WHEN 5 THEN 'locationsId' WHEN 8 THEN 'coordinates' WHEN 9 THEN '$' ELSE 'datetime' END AS field,
       CASE id % 10 WHEN 3 THEN '"n/a"' WHEN 5 THEN '"unknown"' WHEN 6 THEN 'yesterday' WHEN 8 THEN '"north"' WHEN 9 THEN '"lost"' END AS text,
       COUNT(*) AS n
FROM scored WHERE id % 10 IN (3, 5, 6, 7, 8, 9) GROUP BY 1, 2, 3"""))
def q_payload_rejects(spark, d):
    """O-E3: each field that became null and each record that was left out, with its text."""
    path = scratch_path(spark, "mpayload")
    land_odd_payloads(spark, d, path)
    docs = SP.landing(spark, "measurements", path, multiline=False, once=True)
    lost = docs.rejected().select(F.lit("rejected").alias("status"), F.explode("issues").alias("i")).select("status", "i.*")
    nulled = docs.repaired().select(F.lit("repaired").alias("status"), "field", "text")
    return lost.unionByName(nulled).groupBy("status", "field", "text").agg(F.count(F.lit(1)).alias("n"))


@register("payload_ledger", oracle("""
SELECT records, rejected, repaired, records - rejected - extracted AS outside, extracted, transformed, extracted - transformed AS filtered, 2 AS errors
FROM (SELECT COUNT(*) AS records, COUNT(*) FILTER (id % 10 IN (5, 6, 7, 9)) AS rejected, COUNT(*) FILTER (id % 10 IN (3, 8)) AS repaired,
             COUNT(*) FILTER (id % 10 NOT IN (5, 6, 7, 9) AND measurement_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') AS extracted,
             COUNT(*) FILTER (id % 10 NOT IN (3, 5, 6, 7, 9) AND measurement_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
                              AND value IS NOT NULL AND value >= 0 AND quality_score > 0) AS transformed FROM scored)"""))
def q_payload_ledger(spark, d):
    """O-C6: every record of the documents read is in one count of the job's metrics."""
    path, table = scratch_path(spark, "mpayload"), scratch_path(spark, "measurements")
    land_odd_payloads(spark, d, path)
    got = C.measurement_collection(spark, path, table, "2024-01-05", "2024-01-25", multiline=False)
    if got["loaded"] + got["skipped"] != got["transformed"]:
        raise RuntimeError(f"unexpected metrics {got}")
    names = ("records", "rejected", "repaired", "outside", "extracted", "transformed", "filtered", "errors")
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@register("latest_two_polls", oracle("SELECT location_id, COUNT(*) AS n FROM (SELECT location_id FROM live UNION ALL SELECT location_id FROM live) t GROUP BY location_id", LIVE_CTES))
def q_latest_two_polls(spark, d):
    """O-S6: the limit belongs to a request, so two polls of a location keep both."""
    path = scratch_path(spark, "latest")
    land_latest(spark, d, f"{path}/poll=1")
    land_latest(spark, d, f"{path}/poll=2")
    return SP.latest_rows(spark, f"{path}/poll=*", multiline=False).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@register("live_collection_dry_run", oracle("SELECT * FROM live", LIVE_CTES))
def q_live_dry_run(spark, d):
    meta, latest = _payload_dirs(spark, d)
    rows, _ = C.live_collection(spark, meta, latest, dry_run=True, multiline=False)
    return rows.select(*RAW_COLS)


@register("live_collection_insert", oracle("""
SELECT * FROM seed UNION ALL
SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.location_id = l.location_id
  AND s.sensors_id = l.sensors_id AND s.datetime = l.datetime AND s.parameter = l.parameter)""", LIVE_CTES))
def q_live_insert(spark, d):
    meta, latest = _payload_dirs(spark, d)
    fact = scratch_path(spark, "fact")
    seed = (M(spark, d).where(F.col("measurement_time") < F.lit("2024-01-29").cast("timestamp_ntz"))
            .select("location_id", _sensor_key().alias("sensors_id"), "location",
                    F.col("measurement_time").alias("datetime"), F.col("latitude").alias("lat"),
                    F.col("longitude").alias("lon"), "parameter", F.col("unit").alias("units"), "value",
                    F.col("location_id").alias("locationid"), X.month_text("measurement_time").alias("month"),
                    X.year_number("measurement_time").alias("year"),
                    X.utc_now().alias("ingestion_datetime")))
    K.append_partitioned(seed, fact)
    _broken_document(spark, latest)
    _, stats = C.live_collection(spark, meta, latest, fact_path=fact, multiline=False)
    if stats["failed_documents"] != 1 or stats["inserted"] <= 0:
        raise RuntimeError(f"unexpected collection result {stats}")
    return spark.read.schema(schemas.RAW_AIR_QUALITY).parquet(fact).select(*RAW_COLS)


# ============================================================== exports (K5-K9)
EXPORT_SQL = oracle(f"""
SELECT location_id, location, latitude, longitude, parameter, unit, value, measurement_time,
       ROUND(quality_score, 6) AS quality_score
FROM measurements WHERE quality_score > 0.5 AND parameter = 'pm10'
ORDER BY measurement_time DESC, id DESC LIMIT {fixed.EXPORT_MAX_ROWS}""")
EXPORT_SCHEMA = ("location_id long, location string, latitude double, longitude double, "
                 "parameter string, unit string, value double, measurement_time timestamp_ntz, "
                 "quality_score double")


def _export_roundtrip(spark, d, fmt):
    out = scratch_path(spark, f"export-{fmt}")
    sl = K.export_slice(M(spark, d), parameter="pm10")
    K.export(sl, out, fmt)
    back = K.read_export(spark, out, fmt, EXPORT_SCHEMA)
    return rounded(back, "quality_score")


@register("export_csv", EXPORT_SQL)
def q_export_csv(spark, d):
    return _export_roundtrip(spark, d, "csv")


@register("export_json", EXPORT_SQL)
def q_export_json(spark, d):
    return _export_roundtrip(spark, d, "json")


@register("export_parquet", EXPORT_SQL)
def q_export_parquet(spark, d):
    return _export_roundtrip(spark, d, "parquet")


@register("dashboard_download", oracle(
    "SELECT * FROM dp WHERE location = 'Customer#000000042' AND parameter = 'pm25' "
    "AND measurement_date >= TIMESTAMP '2024-01-03' AND measurement_date <= TIMESTAMP '2024-01-25'",
    GEN1_VALID + ",\ndp AS (" + DAILY_PANDAS_BODY + ")"))
def q_dashboard_download(spark, d):
    daily = rounded(A.daily_stats_pandas(R(spark, d)), "average_value")
    name = K.download_name("Customer#000000042", "pm25", "2024-01-03", "2024-01-25")
    out = scratch_path(spark, name.replace(".csv", ""))
    K.dashboard_download(daily, out, "Customer#000000042", "pm25", "2024-01-03", "2024-01-25")
    return K.read_export(spark, out, "csv", daily.schema)


# ============================================================== listing sync (S7, O-C4, K4)
def land_listing(chg: DataFrame, path: str, per_doc: int = 100) -> None:
    """Listing documents of at most ``per_doc`` locations each (ids are
    unique, so ``id div per_doc`` bounds every document)."""
    item = F.struct(F.col("location_id").alias("id"), "name", "city", "country", "timezone",
                    F.struct("latitude", "longitude").alias("coordinates"))
    docs = (chg.groupBy(F.floor(F.col("location_id") / per_doc).alias("_doc"))
            .agg(F.collect_list(item).alias("results")).select("results"))
    docs.write.mode("overwrite").json(path)


@register("location_sync_counts", oracle("""
SELECT CASE WHEN l.location_id IS NULL THEN 'added' ELSE 'updated' END AS sync_status, COUNT(*) AS n
FROM chg c LEFT JOIN locations l ON c.location_id = l.location_id GROUP BY 1""", CHG_CTES))
def q_location_sync_counts(spark, d):
    loc, chg = _change_set(spark, d)
    path = scratch_path(spark, "listing")
    land_listing(chg, path)
    counts, _ = C.location_sync(spark, path, loc, scratch_path(spark, "dim"), limit=None,
                                multiline=False)
    return counts


@register("location_sync_result", oracle("""
SELECT location_id, name, city, country, latitude, longitude, timezone, is_active
FROM locations l WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.location_id = l.location_id)
UNION ALL SELECT location_id, name, city, country, latitude, longitude, timezone, TRUE AS is_active FROM chg""",
    CHG_CTES))
def q_location_sync_result(spark, d):
    loc, chg = _change_set(spark, d)
    path = scratch_path(spark, "listing")
    land_listing(chg, path)
    _, dim = C.location_sync(spark, path, loc, scratch_path(spark, "dim"), limit=None, multiline=False)
    return dim.select("location_id", "name", "city", "country", "latitude", "longitude", "timezone",
                      "is_active")


@register("listing_filtered", oracle("""
SELECT location_id, name, city, country, latitude, longitude, timezone FROM chg
WHERE country = 'ASIA' AND city = 'NATION_2'""", CHG_CTES))
def q_listing_filtered(spark, d):
    _, chg = _change_set(spark, d)
    path = scratch_path(spark, "listing")
    land_listing(chg, path)
    return SP.locations_listing(spark, path, "ASIA", "NATION_2", multiline=False)


# ============================================================== measurement collection
def land_measurement_payloads(spark, d, path, per_doc: int = 100) -> None:
    """Measurement documents of at most ``per_doc`` readings (ids unique)."""
    s = S(spark, d)
    item = F.struct(F.col("location_id").alias("locationsId"), F.col("sensor_id").alias("sensorsId"),
                    "location", "parameter", "value", "unit", _iso("measurement_time").alias("datetime"),
                    F.struct("latitude", "longitude").alias("coordinates"))
    docs = (s.groupBy(F.floor(F.col("id") / per_doc).alias("_doc"))
            .agg(F.collect_list(item).alias("results")).select("results"))
    docs.write.mode("overwrite").json(path)


@register("measurement_collection", oracle(f"""
SELECT DISTINCT location_id, sensor_id, location, latitude, longitude, parameter, unit, value,
       measurement_time, ROUND(quality_score, 6) AS quality_score, '{fixed.SOURCE_NAME}' AS source
FROM measurements WHERE measurement_time >= TIMESTAMP '2024-01-05' AND measurement_time <= TIMESTAMP '2024-01-25'"""))
def q_measurement_collection(spark, d):
    path, table = scratch_path(spark, "mpayload"), scratch_path(spark, "measurements")
    land_measurement_payloads(spark, d, path)
    C.measurement_collection(spark, path, table, "2024-01-05", "2024-01-25", multiline=False)
    back = spark.read.schema(schemas.MEASUREMENTS).parquet(table)
    return rounded(back.select("location_id", "sensor_id", "location", "latitude", "longitude", "parameter",
                               "unit", "value", "measurement_time", "quality_score", "source"),
                   "quality_score")


# ============================================================== views + caller SQL
@register("named_param_sql", oracle("""
SELECT location_id, location, parameter, unit,
       CAST(CAST(measurement_time AS DATE) AS TIMESTAMP) AS measurement_date,
       ROUND(AVG(value), 6) AS avg_value, COUNT(*) AS measurement_count
FROM measurements WHERE quality_score > 0.5 AND parameter = 'pm25'
GROUP BY location_id, location, parameter, unit, CAST(measurement_time AS DATE)"""))
def q_named_param_sql(spark, d):
    C.register_views(spark, C.presentation_gen2(M(spark, d), LOC(spark, d)))
    out = spark.sql("SELECT location_id, location, parameter, unit, measurement_date, avg_value, "
                    "measurement_count FROM presentation_daily_aggregates WHERE parameter = :p",
                    args={"p": "pm25"})
    return rounded(dates_as_timestamps(out), "avg_value")


@register("refreshed_view", oracle("""
SELECT location_id, location, parameter, unit, CAST(CAST(t AS DATE) AS TIMESTAMP) AS measurement_date,
       ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value, COUNT(*) AS measurement_count
FROM (SELECT DISTINCT location_id, location, sensor_id, parameter, unit, value, quality_score,
             CASE WHEN location_id % 2 = 0 THEN measurement_time + INTERVAL 31 DAYS ELSE measurement_time END AS t FROM measurements)
WHERE quality_score > 0.5 GROUP BY location_id, location, parameter, unit, CAST(t AS DATE)"""))
def q_refreshed_view(spark, d):
    """O-K10: a stored view, refreshed for the months of a second load, equals one built of all rows."""
    root = scratch_path(spark, "warehouse")
    table = K.initialize_tables(spark, root)["raw.measurements"]
    later = F.when(F.col("location_id") % 2 == 0, F.col("measurement_time") + F.expr("INTERVAL 31 DAYS")).otherwise(F.col("measurement_time"))
    m = M(spark, d).withColumn("measurement_time", later).withColumn("id", C.natural_id())
    march = F.lit("2024-02-15").cast("timestamp_ntz")
    K.load_measurements(spark, m.where(F.col("measurement_time") < march), table)
    fact = lambda: spark.read.schema(K.dated_schema("raw.measurements")).parquet(table)
    view = C.monthly_views(root)["presentation.daily_aggregates"]
    view.create(fact())
    res = K.load_measurements(spark, m.where(F.col("measurement_time") >= march), table)
    out = view.refresh(fact(), res["months"])
    return rounded(dates_as_timestamps(out.drop("std_value", "avg_quality")), "avg_value")


@register("gen1_views", oracle("""
SELECT location_id, location, MAX(lat) AS lat, MAX(lon) AS lon, MAX(datetime) AS datetime,
       MAX(CASE WHEN parameter = 'pm10' THEN value END) AS pm10,
       MAX(CASE WHEN parameter = 'pm25' THEN value END) AS pm25,
       MAX(CASE WHEN parameter = 'so2' THEN value END) AS so2
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter
             ORDER BY datetime DESC, value DESC, lat DESC, lon DESC, location DESC) AS rn
      FROM raw_aq WHERE value >= 0 AND parameter IN ('pm10', 'pm25', 'so2')) t
WHERE rn = 1 GROUP BY location_id, location"""))
def q_gen1_views(spark, d):
    names = C.register_views(spark, C.presentation_gen1(R(spark, d)))
    return spark.table(names[1])


@register("gen1_views_all", oracle("""
SELECT 'valid' AS view, location_id, parameter, COUNT(*) AS n, ROUND(SUM(value), 6) AS total FROM raw_aq WHERE value >= 0 GROUP BY location_id, parameter
UNION ALL SELECT 'daily', location_id, parameter, COUNT(*), ROUND(SUM(average_value), 6)
FROM (SELECT location_id, parameter, AVG(value) AS average_value FROM raw_aq WHERE value >= 0
      GROUP BY location_id, location, CAST(datetime AS DATE), lat, lon, parameter, units) d GROUP BY location_id, parameter"""))
def q_gen1_views_all(spark, d):
    """O-C2: the two views beside the pivot, read by their registered names."""
    names = C.register_views(spark, C.presentation_gen1(R(spark, d)))
    sums = lambda kind, name, value: rounded(spark.table(name).groupBy("location_id", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")), "total").select(F.lit(kind).alias("view"), "location_id", "parameter", "n", "total")
    return sums("valid", names[0], "value").unionByName(sums("daily", names[2], "average_value"))


@register("initialized_tables", oracle("""
SELECT 'raw.air_quality' AS name, COUNT(*) AS n_rows, CAST(SUM(location_id) AS BIGINT) AS locations, ROUND(SUM(value), 6) AS total FROM raw_aq
UNION ALL SELECT 'raw.measurements', COUNT(*), CAST(SUM(location_id) AS BIGINT), ROUND(SUM(value), 6) FROM measurements
UNION ALL SELECT 'staging.locations', COUNT(*), CAST(SUM(location_id) AS BIGINT), ROUND(SUM(latitude), 6) FROM locations
UNION ALL SELECT 'staging.sensors', COUNT(*), CAST(SUM(location_id) AS BIGINT), CAST(NULL AS DOUBLE) FROM sensors"""))
def q_initialized_tables(spark, d):
    """O-K12 + O-S10: create the typed tables, load the derived data into
    them and read every table back through its fixed schema."""
    root = scratch_path(spark, "warehouse")
    paths = K.initialize_tables(spark, root)
    now = X.utc_now()
    K.append_partitioned(R(spark, d).withColumn("ingestion_datetime", now), paths["raw.air_quality"])
    m = P.with_lineage(M(spark, d), now=now)
    dated = m.select(*[f.name for f in schemas.MEASUREMENTS.fields],
                     X.year_number("measurement_time").alias("year"), X.month_text("measurement_time").alias("month"))
    K.append_partitioned(dated, paths["raw.measurements"])
    loc = LOC(spark, d).withColumn("last_updated", now)
    K.append_plain(loc.select(*[f.name for f in schemas.LOCATIONS.fields]), paths["staging.locations"])
    sens = AD.sensors(spark, d).select(
        F.col("sensor_key").alias("sensor_id"), "location_id", F.col("parameter").alias("name"),
        "parameter", "unit", F.lit(True).alias("is_active"), now.alias("last_updated"))
    K.append_plain(sens, paths["staging.sensors"])
    again = K.initialize_tables(spark, root)  # a second call leaves the content alone
    total = {"raw.air_quality": "value", "raw.measurements": "value", "staging.locations": "latitude"}
    parts = [rounded(K.read_table(spark, name, path).agg(
                F.count(F.lit(1)).alias("n_rows"), F.sum("location_id").alias("locations"),
                (F.sum(total[name]) if name in total else F.lit(None).cast("double")).alias("total")), "total")
             .select(F.lit(name).alias("name"), "n_rows", "locations", "total") for name, path in again.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ============================================================== streaming
def _land_stream(spark, d, src_fn=S, n_files: int = 6) -> str:
    path = scratch_path(spark, "landing")
    T.land_records(src_fn(spark, d).drop("quality_score"), path, n_files)
    return path


STREAM_COLS = ["location_id", "sensor_id", "location", "latitude", "longitude", "parameter", "unit",
               "value", "measurement_time"]
STREAM_COLS_SQL = ", ".join(STREAM_COLS)


@register("stream_ingest", oracle(f"""
SELECT id, {STREAM_COLS_SQL}, ROUND(quality_score, 6) AS quality_score FROM measurements
UNION ALL SELECT id, {STREAM_COLS_SQL.replace("location_id,", "location_id + 10000000 AS location_id,")}, ROUND(quality_score, 6) FROM measurements"""))
def q_stream_ingest(spark, d):
    src = _land_stream(spark, d)
    table, ck = scratch_path(spark, "stream-table"), scratch_path(spark, "stream-ck")
    T.ingest_insert_if_absent(spark, src, table, ck).awaitTermination()
    # a second run over the same files and checkpoint must add nothing
    T.ingest_insert_if_absent(spark, src, table, ck).awaitTermination()
    # another source into the same table, with its own checkpoint, starts at batch 0 again
    other = _land_stream(spark, d, lambda s, x: S(s, x).withColumn("location_id", F.col("location_id") + 10000000), 2)
    T.ingest_insert_if_absent(spark, other, table).awaitTermination()
    back = spark.read.parquet(table).drop("batch_id")
    return rounded(back.select("id", *STREAM_COLS, "quality_score"), "quality_score")


@register("stream_dedupe", oracle(f"SELECT DISTINCT {STREAM_COLS_SQL} FROM measurements"))
def q_stream_dedupe(spark, d):
    src = _land_stream(spark, d)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    dd = T.dedupe_stream(s, ["location_id", "sensor_id", "measurement_time", "parameter"])
    out = scratch_path(spark, "stream-dedupe")
    T.run_to_table(dd.select(*STREAM_COLS), out, "append", label="dedupe")
    return spark.read.parquet(out)


@register("stream_hourly", oracle("""
SELECT location_id, parameter, date_trunc('hour', measurement_time) AS hour,
       ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
       ROUND(STDDEV_SAMP(value), 6) AS std_value, COUNT(value) AS count,
       ROUND(AVG(quality_score), 6) AS avg_quality
FROM measurements
GROUP BY location_id, parameter, date_trunc('hour', measurement_time)
HAVING date_trunc('hour', measurement_time) + INTERVAL 1 HOUR
       <= (SELECT MAX(measurement_time) FROM measurements) - INTERVAL 1 HOUR"""))
def q_stream_hourly(spark, d):
    src = _land_stream(spark, d)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    out = scratch_path(spark, "stream-hourly")
    T.run_to_table(T.hourly_stream(s, "1 hour"), out, "append", label="hourly")
    return rounded(spark.read.parquet(out), "avg_value", "std_value", "avg_quality")


@register("stream_hourly_closed", oracle("""
SELECT location_id, parameter, date_trunc('hour', measurement_time) AS hour,
       ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
       ROUND(STDDEV_SAMP(value), 6) AS std_value, COUNT(value) AS count,
       ROUND(AVG(quality_score), 6) AS avg_quality
FROM measurements GROUP BY location_id, parameter, date_trunc('hour', measurement_time)"""))
def q_stream_hourly_closed(spark, d):
    """O-T3 with its correction path: every hour, also those the stream left open."""
    src = _land_stream(spark, d)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    out = scratch_path(spark, "stream-hourly")
    T.run_to_table(T.hourly_stream(s, "1 hour"), out, "append", label="hourly")
    emitted = spark.read.schema("location_id long, parameter string, hour timestamp_ntz, avg_value double, min_value double, "
                                "max_value double, std_value double, count long, avg_quality double").parquet(out)
    return rounded(T.close_hours(emitted, M(spark, d), T.correction_start(spark, out)), "avg_value", "std_value", "avg_quality")


@register("stream_latest", oracle("""
SELECT location_id, location, latitude, longitude, parameter, unit, value, measurement_time,
       ROUND(quality_score, 6) AS quality_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter ORDER BY measurement_time DESC, id DESC) AS rn
  FROM measurements WHERE quality_score > 0.5) t WHERE rn = 1"""))
def q_stream_latest(spark, d):
    src = _land_stream(spark, d)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    out = scratch_path(spark, "stream-latest")
    T.run_to_table(T.latest_stream(s), out, "update", label="latest",
                   keys=["location_id", "parameter"])
    return rounded(T.read_snapshot(spark, out), "quality_score")


@register("stream_staleness", oracle("""
SELECT COUNT(CASE WHEN last_t < (SELECT MAX(measurement_time) FROM lt) - INTERVAL 24 HOURS THEN 1 END)
       AS stale_locations
FROM (SELECT location, MAX(measurement_time) AS last_t FROM lt WHERE location IS NOT NULL GROUP BY location) g""",
    """lt AS (SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter ORDER BY measurement_time DESC, id DESC) AS rn
  FROM measurements WHERE quality_score > 0.5) t WHERE rn = 1)"""))
def q_stream_staleness(spark, d):
    src = _land_stream(spark, d)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    out = scratch_path(spark, "stream-latest")
    T.run_to_table(T.latest_stream(s), out, "complete", label="latest")
    return T.staleness_on_refresh(T.read_snapshot(spark, out))


BAND_SQL = "CASE " + " ".join(
    f"WHEN value >= {b[0]} AND value <= {b[1]} THEN {i}" for i, b in enumerate(fixed.AQI_BREAKPOINTS)) + \
    f" ELSE {len(fixed.AQI_BREAKPOINTS) - 1} END"


@register("stream_alerts", oracle(f"""
SELECT id, parameter, value,
       CASE WHEN quality_score = 0 THEN 'out_of_range' ELSE 'aqi_band' END AS alert
FROM scored
WHERE quality_score = 0 OR (parameter IN ('pm25', 'pm10') AND value IS NOT NULL AND {BAND_SQL} >= 3)"""))
def q_stream_alerts(spark, d):
    src = _land_stream(spark, d)
    s = T.read_record_stream(spark, src, max_files=2)
    out = scratch_path(spark, "stream-alerts")
    T.run_to_table(T.alert_stream(s).select("id", "parameter", "value", "alert"), out, "append",
                   label="alerts")
    return spark.read.parquet(out)


@register("stream_feed", oracle("SELECT 'measurement' AS type, location_id, parameter, value FROM measurements"))
def q_stream_feed(spark, d):
    src = _land_stream(spark, d)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    out = scratch_path(spark, "stream-feed")
    T.run_to_table(T.feed_stream(s), out, "append", label="feed")
    env = ("struct<type:string,data:struct<location_id:bigint,location:string,parameter:string,"
           "value:double,unit:string,measurement_time:string>,timestamp:string>")
    e = spark.read.parquet(out).select(F.from_json("value", env).alias("e"))
    return e.select(F.col("e.type").alias("type"), F.col("e.data.location_id").alias("location_id"),
                    F.col("e.data.parameter").alias("parameter"), F.col("e.data.value").alias("value"))


# ============================================================== map layer / report
@register("map_layer", oracle("""
SELECT location_id, location, lat, lon, aqi,
       CASE WHEN aqi IS NULL THEN NULL ELSE GREATEST(aqi, 1.0) END AS marker_size
FROM wa WHERE lat IS NOT NULL AND lon IS NOT NULL""",
    WIDE_CTE))
def q_map_layer(spark, d):
    pts, _ = C.map_layer(R(spark, d))
    return pts.select("location_id", "location", "lat", "lon", "aqi", "marker_size")


@register("quality_report_counts", oracle("""
SELECT lower(parameter) AS parameter, COUNT(*) AS count FROM raw_aq
WHERE value IS NOT NULL AND value >= 0 GROUP BY lower(parameter)"""))
def q_quality_report(spark, d):
    return C.quality_report(R(spark, d))["parameter_counts"]


# ============================================================== full pipeline (O-C7)
@register("full_pipeline", oracle("""
SELECT l.location_id, l.name AS location_name, l.city, l.country, l.latitude, l.longitude,
       COUNT(DISTINCT m.parameter) AS parameter_count, MAX(m.measurement_time) AS last_measurement_time,
       ROUND(AVG(m.quality_score), 6) AS avg_quality_score
FROM dim l LEFT JOIN mc m ON l.location_id = m.location_id
WHERE l.is_active GROUP BY l.location_id, l.name, l.city, l.country, l.latitude, l.longitude""",
    CHG_CTES + """,
dim AS (SELECT location_id, name, city, country, latitude, longitude, is_active
        FROM locations l WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.location_id = l.location_id)
        UNION ALL SELECT location_id, name, city, country, latitude, longitude, TRUE FROM chg),
mc AS (SELECT DISTINCT location_id, sensor_id, parameter, measurement_time, value, quality_score
       FROM measurements WHERE measurement_time >= TIMESTAMP '2024-01-05'
         AND measurement_time <= TIMESTAMP '2024-01-25')"""))
def q_full_pipeline(spark, d):
    loc, chg = _change_set(spark, d)
    listing, payload = scratch_path(spark, "listing"), scratch_path(spark, "mpayload")
    land_listing(chg, listing)
    land_measurement_payloads(spark, d, payload)
    done = C.full_pipeline(spark, listing, payload, scratch_path(spark, "warehouse"), loc,
                           "2024-01-05", "2024-01-25", multiline=False)
    return rounded(spark.table(done["views"][2]), "avg_quality_score")


@register("collection_metrics", oracle("""
SELECT (SELECT COUNT(*) FROM scored WHERE measurement_time >= TIMESTAMP '2024-01-05'
          AND measurement_time <= TIMESTAMP '2024-01-25') AS extracted,
       COUNT(*) AS transformed, (SELECT COUNT(*) FROM (SELECT DISTINCT location_id, sensor_id, parameter, measurement_time
          FROM measurements WHERE measurement_time >= TIMESTAMP '2024-01-05' AND measurement_time <= TIMESTAMP '2024-01-25') t) AS loaded,
       0 AS loaded_again, 1 AS errors
FROM measurements WHERE measurement_time >= TIMESTAMP '2024-01-05' AND measurement_time <= TIMESTAMP '2024-01-25'"""))
def q_collection_metrics(spark, d):
    """O-A26, O-A27: counts observed while the job writes, for a first and a second run."""
    path, table = scratch_path(spark, "mpayload"), scratch_path(spark, "measurements")
    land_measurement_payloads(spark, d, path)
    _broken_document(spark, path)
    a, b = (C.measurement_collection(spark, path, table, "2024-01-05", "2024-01-25", multiline=False) for _ in range(2))
    if not a["started"] <= a["ended"] <= b["started"] or a["loaded"] + a["skipped"] != a["transformed"]:
        raise RuntimeError(f"unexpected metrics {a} {b}")
    return spark.createDataFrame([(a["extracted"], a["transformed"], a["loaded"], b["loaded"], a["errors"])],
                                 "extracted long, transformed long, loaded long, loaded_again long, errors int")


@register("first_existing_table", oracle("SELECT COUNT(*) AS n FROM raw_aq"))
def q_first_existing_table(spark, d):
    """O-S11: the first candidate that the catalog has is the one that is read."""
    R(spark, d).createOrReplaceTempView(fixed.RAW_TABLE_CANDIDATES[1])
    spark.catalog.dropTempView(fixed.RAW_TABLE_CANDIDATES[0])
    name = K.first_existing_table(spark, list(fixed.RAW_TABLE_CANDIDATES))
    return spark.table(name).agg(F.count(F.lit(1)).alias("n"))


@register("export_truncation", oracle("""
SELECT COUNT(*) AS matching, LEAST(COUNT(*), 1000) AS exported, COUNT(*) > 1000 AS truncated
FROM measurements WHERE quality_score > 0.5"""))
def q_export_truncation(spark, d):
    return K.export_truncated(M(spark, d), max_rows=1000)


@register("map_center_of_layer", oracle("""
SELECT ROUND(AVG(lat), 6) AS center_lat, ROUND(AVG(lon), 6) AS center_lon FROM wa
WHERE lat IS NOT NULL AND lon IS NOT NULL""", WIDE_CTE))
def q_map_center_of_layer(spark, d):
    _, center = C.map_layer(R(spark, d))
    return rounded(center, "center_lat", "center_lon")


@register("quality_report_profile", oracle("""
SELECT COUNT(*) AS total_records, COUNT(CASE WHEN value IS NULL THEN 1 END) AS missing_values,
       COUNT(CASE WHEN value < 0 THEN 1 END) AS negative_values,
       (SELECT duplicate_records FROM dup) AS duplicate_records,
       (SELECT stale_locations FROM st) AS stale_locations, MAX(datetime) AS latest_reading
FROM r""", PROFILE_CTES))
def q_quality_report_profile(spark, d):
    return C.quality_report(R(spark, d))["profile"]


@register("quality_report_locations", oracle("""
SELECT location, COUNT(*) AS count FROM raw_aq WHERE value IS NOT NULL AND value >= 0 AND location IS NOT NULL
GROUP BY location ORDER BY count DESC, location LIMIT 12"""))
def q_quality_report_locations(spark, d):
    return C.quality_report(R(spark, d))["location_counts"]


@register("archive_subset", oracle(f"SELECT {RAW_COLS_SQL} FROM raw_aq WHERE locationid IN (SELECT location_id FROM locations WHERE country = 'ASIA')"))
def q_archive_subset(spark, d):
    """O-S2: an id frame of some locations reads their folders only."""
    base = scratch_path(spark, "archive")
    SA.write_archive(R(spark, d), base)
    ids = LOC(spark, d).where(F.col("country") == "ASIA").select("location_id")
    return SA.read_archive(spark, base, ids, "2023-11", "2024-01").drop("ingestion_datetime")
