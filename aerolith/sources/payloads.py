"""Landed API payload sources (O-S4 .. O-S9) and the payload-to-row
projection (O-P15).

The engine starts from payload files already landed in shared storage (JSON
documents with a ``results`` array); fetching is outside Spark. ``landing``
parses them record by record; every function here takes a path or a
:class:`~aerolith.sources.landing.Landing`, so that a job parses its documents once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import joins as J
from aerolith.operators import predicates as P
from aerolith.sources.landing import Landing, landing, texts

Source = str | Landing


def location_map_shards(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """O-S4 (file_path, text, reason, entries): the JSON objects id -> name below ``path``, one a file or, with
    ``whole_file=False``, one a line. ``reason`` tells why an object is rejected: it is cut short or no JSON
    (which includes an id given twice), it is no object, or an id in it is no number."""
    shard = texts(spark, path, whole_file).withColumn("doc", F.try_parse_json("text"))
    shard = shard.withColumn("map", F.try_variant_get("doc", "$", "map<string,variant>"))
    entries = F.transform(F.map_entries("map"), lambda e: F.struct(
        e["key"].try_cast("bigint").alias("location_id"), F.try_variant_get(e["value"], "$", "string").alias("name")))
    shard = shard.withColumn("entries", entries)
    reason = (F.when(F.col("doc").isNull(), F.lit("not JSON")).when(F.col("map").isNull(), F.lit("not an object"))
              .when(F.exists("entries", lambda e: e["location_id"].isNull()), F.lit("an id is no number")))
    return shard.select("file_path", "text", reason.alias("reason"), "entries")


def rejected_map_shards(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """O-S4 (file_path, reason, text): the objects of a location map that cannot be used."""
    return location_map_shards(spark, path, whole_file).where(F.col("reason").isNotNull()).select("file_path", "reason", "text")


def read_location_map(spark: SparkSession, path: str, whole_file: bool = True, strict: bool = True) -> DataFrame:
    """O-S4 JSON object id -> name as rows (location_id long, name string); null names are kept.
    ``whole_file``: each file is one (pretty-printed) object; otherwise each line is an object (a
    sharded map), so a large map is parsed by many tasks. An object that cannot be used raises, naming
    its file; with ``strict=False`` it is left out, and ``rejected_map_shards`` has it."""
    shards = location_map_shards(spark, path, whole_file)
    if strict:
        broken = F.raise_error(F.concat(F.lit("location map "), F.col("file_path"), F.lit(": "), F.col("reason")))
        entries = F.when(F.col("reason").isNull(), F.col("entries")).otherwise(broken.cast("array<struct<location_id:bigint,name:string>>"))
    else:
        shards, entries = shards.where(F.col("reason").isNull()), F.col("entries")
    return shards.select(F.explode(entries).alias("e")).select("e.location_id", "e.name")


def landed(spark: SparkSession, kind: str, source: Source, multiline: bool = True) -> Landing:
    """``source`` itself if it is parsed already, else the parsed documents below it."""
    return source if isinstance(source, Landing) else landing(spark, kind, source, multiline)


def read_payload(spark: SparkSession, kind: str, source: Source, multiline: bool = True) -> DataFrame:
    """O-S9 the usable records of landed payloads of ``kind`` ('locations', 'latest', 'measurements',
    'metadata'). ``quarantined`` has the documents that could not be read. Unknown kinds raise."""
    return landed(spark, kind, source, multiline).rows()


def quarantined(spark: SparkSession, kind: str, source: Source, multiline: bool = True) -> DataFrame:
    """O-E3 (file_path, reason, _corrupt_record): documents that could not be read, whole.
    Every job counts them as its failed documents."""
    return landed(spark, kind, source, multiline).quarantined()


def read_payload_checked(spark: SparkSession, kind: str, source: Source,
                         multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """O-E3 (records of the good documents, quarantined bad documents)."""
    docs = landed(spark, kind, source, multiline)
    return docs.rows(), docs.quarantined()


def location_metadata(spark: SparkSession, source: Source, multiline: bool = True) -> DataFrame:
    """O-S5 one row per location: id and name."""
    return read_payload(spark, "metadata", source, multiline).select(
        F.col("id").alias("location_id"), F.col("name").alias("location_name"))


def sensor_lookup(spark: SparkSession, source: Source, multiline: bool = True) -> DataFrame:
    """O-S5 sensors out of the metadata payloads: sensor_id, location_id,
    parameter (lower case, parameter name else sensor name), units ('' if
    missing). Sensors without an id or a parameter name are skipped."""
    loc = read_payload(spark, "metadata", source, multiline)
    s = loc.select(F.col("id").alias("location_id"), F.explode("sensors").alias("s"))
    pname = F.coalesce(X.blank_to_null(F.col("s.parameter.name")), X.blank_to_null(F.col("s.name")))
    units = F.coalesce(X.blank_to_null(F.col("s.parameter.units")), X.blank_to_null(F.col("s.units")),
                       F.lit(""))
    return (s.select(F.col("s.id").alias("sensor_id"), "location_id",
                     F.lower(pname).alias("parameter"), units.alias("units"))
            .where(F.col("sensor_id").isNotNull() & F.col("parameter").isNotNull()))


def latest_rows(spark: SparkSession, source: Source, limit: int | None = fixed.PAYLOAD_LATEST_LIMIT,
                multiline: bool = True) -> DataFrame:
    """O-S6 latest measurements, at most ``limit`` newest of each document: the
    limit belongs to a request, so two polls of a location keep both."""
    docs = landed(spark, "latest", source, multiline).results()
    items = F.transform("results", lambda r: F.struct(
        X.parse_utc(r["datetime"]["utc"]).alias("measured_at"), r["sensorsId"].alias("sensor_id"),
        r["locationsId"].alias("location_id"), X.nan_to_null(r["value"]).alias("value"),
        r["datetime"]["utc"].alias("utc"), r["coordinates"].alias("coordinates")))
    newest = F.sort_array(items, asc=False)
    kept = F.slice(newest, 1, limit) if limit else newest
    return docs.select(F.explode(kept).alias("r")).select(
        "r.sensor_id", "r.location_id", "r.value", "r.utc", "r.coordinates", "r.measured_at")


def locations_listing(spark: SparkSession, source: Source, country: str | None = None,
                      city: str | None = None, limit: int | None = fixed.LOCATION_LISTING_LIMIT,
                      multiline: bool = True) -> DataFrame:
    """O-S7 listing -> flat location rows, optional country/city; at most
    ``limit`` of each document, as a request returns them."""
    docs = landed(spark, "locations", source, multiline).results()
    wanted = F.col("results")
    if country is not None:
        wanted = F.filter(wanted, lambda r: r["country"] == F.lit(country))
    if city is not None:
        wanted = F.filter(wanted, lambda r: r["city"] == F.lit(city))
    kept = F.slice(wanted, 1, limit) if limit else wanted
    r = docs.select(F.explode(kept).alias("r")).select("r.*")
    r = P.flatten_coordinates(r.withColumnRenamed("id", "location_id"))
    return r.select("location_id", "name", "city", "country", "latitude", "longitude", "timezone")


def measurements_range(spark: SparkSession, source: Source, date_from, date_to,
                       multiline: bool = True) -> DataFrame:
    """O-S8 measurement payloads within [date_from, date_to] (standardised
    names, flattened coordinates, UTC time)."""
    rows = measurement_rows(read_payload(spark, "measurements", source, multiline))
    return rows.where(P.optional_filters(date_from=date_from, date_to=date_to))


def measurement_rows(records: DataFrame) -> DataFrame:
    """Measurement records with the table's names, flattened coordinates and UTC time."""
    r = P.standardise_columns(records)
    if "coordinates" in r.columns:
        r = P.flatten_coordinates(r)
    return r.withColumn("measurement_time", X.parse_utc("measurement_time"))


def last_day_window(now_col=None):
    """O-S8 default range: the last 24 hours before ``now`` (an argument)."""
    now = now_col if now_col is not None else X.utc_now()
    return X.minus_days(now, 1), now


def payload_to_raw_rows(latest: DataFrame, sensors: DataFrame, metadata: DataFrame,
                        now=None) -> DataFrame:
    """O-P15 + O-J3 + O-J9 latest rows -> ``raw.air_quality`` rows.

    Rows whose sensor is unknown or whose location id is missing are
    dropped; the name defaults to the id text; the UTC time gives the text
    month and the year."""
    rows = latest.where(F.col("location_id").isNotNull() & F.col("sensor_id").isNotNull())
    sens = sensors.select("sensor_id", "parameter", "units")
    joined = J.lookup_sensors(rows, sens, "sensor_id")
    named = J.attach_location_name(joined, metadata, name_col="location_name", out="location")
    t = F.col("measured_at")
    return named.select(
        "location_id", F.col("sensor_id").alias("sensors_id"), "location", t.alias("datetime"),
        F.col("coordinates.latitude").alias("lat"), F.col("coordinates.longitude").alias("lon"),
        "parameter", "units", "value", F.col("location_id").alias("locationid"),
        X.month_text(t).alias("month"), X.year_number(t).alias("year"),
        (now if now is not None else X.utc_now()).alias("ingestion_datetime"))


def measurement_records(r: DataFrame, now=None, keep: bool = True) -> DataFrame:
    """O-C5 measurement transform: standardise payload records (unless
    ``measurement_rows`` has), score, lineage, keep rule; ``location_name``
    becomes the table's ``location``."""
    if dict(r.dtypes).get("measurement_time") != "timestamp_ntz":
        r = measurement_rows(r)
    r = r.withColumn("value", X.nan_to_null("value"))
    if "location_name" in r.columns:
        r = r.withColumnRenamed("location_name", "location")
    r = r.withColumn("quality_score", X.quality_score("parameter", "value"))
    r = P.with_lineage(r, now=now)
    return P.keep_valid_scored(r) if keep else r
