"""Explicit schemas for every table and source. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Gen 1 fact: raw.air_quality. ``month`` is zero-padded text.
RAW_AIR_QUALITY = _struct(
    ("location_id", L), ("sensors_id", L), ("location", S), ("datetime", TS),
    ("lat", D), ("lon", D), ("parameter", S), ("units", S), ("value", D),
    ("locationid", L), ("month", S), ("year", L), ("ingestion_datetime", TS),
)

# Archive CSV file content (partition columns come from the path).
ARCHIVE_CSV = _struct(
    ("location_id", L), ("sensors_id", L), ("location", S), ("datetime", S),
    ("lat", D), ("lon", D), ("parameter", S), ("units", S), ("value", D),
)
ARCHIVE_PARTITIONS = _struct(("locationid", L), ("year", L), ("month", S))

# Gen 2 fact: raw.measurements.
MEASUREMENTS = _struct(
    ("id", L), ("location_id", L), ("sensor_id", L), ("location", S),
    ("latitude", D), ("longitude", D), ("parameter", S), ("unit", S),
    ("value", D), ("measurement_time", TS), ("ingestion_time", TS),
    ("source", S), ("quality_score", D),
)

# Dimensions.
LOCATIONS = _struct(
    ("location_id", L), ("name", S), ("city", S), ("country", S),
    ("latitude", D), ("longitude", D), ("timezone", S), ("is_active", B),
    ("last_updated", TS),
)
SENSORS = _struct(
    ("sensor_id", L), ("location_id", L), ("name", S), ("parameter", S),
    ("unit", S), ("is_active", B), ("last_updated", TS),
)

# Landed API payloads (one JSON document per file, ``results`` array).
_COORDS = _struct(("latitude", D), ("longitude", D))
_PARAM = _struct(("name", S), ("units", S))
_SENSOR = _struct(("id", L), ("name", S), ("units", S), ("parameter", _PARAM))
LOCATION_METADATA_PAYLOAD = _struct(
    ("results", T.ArrayType(_struct(("id", L), ("name", S), ("sensors", T.ArrayType(_SENSOR))))),
)
LATEST_PAYLOAD = _struct(
    ("results", T.ArrayType(_struct(
        ("sensorsId", L), ("locationsId", L), ("value", D),
        ("datetime", _struct(("utc", S), ("local", S))), ("coordinates", _COORDS),
    ))),
)
LOCATIONS_LISTING_PAYLOAD = _struct(
    ("results", T.ArrayType(_struct(
        ("id", L), ("name", S), ("city", S), ("country", S), ("timezone", S),
        ("coordinates", _COORDS),
    ))),
)
MEASUREMENTS_PAYLOAD = _struct(
    ("results", T.ArrayType(_struct(
        ("locationsId", L), ("sensorsId", L), ("location", S), ("parameter", S),
        ("value", D), ("unit", S), ("datetime", S), ("coordinates", _COORDS),
    ))),
)
PAYLOAD_SCHEMAS = {
    "locations": LOCATIONS_LISTING_PAYLOAD,
    "latest": LATEST_PAYLOAD,
    "measurements": MEASUREMENTS_PAYLOAD,
    "metadata": LOCATION_METADATA_PAYLOAD,
}


def empty_frame(spark, schema: T.StructType):
    """Empty typed table (O-K12); Catalyst folds it to a LocalRelation."""
    return spark.createDataFrame([], schema)
