"""Projections, filters and predicates (O-P1 .. O-P20).

Filters are plain Catalyst predicates, so comparisons against columns of a
Parquet scan reach it as ``PushedFilters`` and partition columns as
``PartitionFilters``; projections narrow the ``ReadSchema``.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.functions import scalars as X

RAW_COLUMNS = ["location_id", "sensors_id", "location", "datetime", "lat", "lon",
               "parameter", "units", "value", "locationid", "month", "year",
               "ingestion_datetime"]


def _present(df: DataFrame, cols: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


# ------------------------------------------------------------------ validity rules
def valid_readings(raw: DataFrame) -> DataFrame:
    """O-P1 gen 1 view ``presentation.air_quality``: ``value >= 0`` (drops nulls)."""
    return raw.select(*_present(raw, RAW_COLUMNS)).where(F.col("value") >= 0)


def load_readings(raw: DataFrame, include_invalid: bool = False) -> DataFrame:
    """O-P2 gen 1 loader: fixed column list, optional validity filter and a
    lower-cased parameter. Null parameter stays null (T19 deviation)."""
    cols = _present(raw, ["location_id", "location", "datetime", "lat", "lon",
                          "parameter", "units", "value", "ingestion_datetime", "sensors_id"])
    out = raw.select(*cols)
    if not include_invalid:
        out = out.where(F.col("value").isNotNull() & (F.col("value") >= 0))
    return out.withColumn("parameter", F.lower("parameter"))


def parameter_in(df: DataFrame, parameters: list[str], col: str = "parameter") -> DataFrame:
    """O-P3 ``parameter IN (...)`` (pushed to the scan as an In filter)."""
    return df.where(F.col(col).isin(list(parameters)))


def trusted(df: DataFrame, above: float = fixed.TRUSTED_SCORE_ABOVE) -> DataFrame:
    """O-P4 ``quality_score > 0.5``; unknown parameters (0.5) are hidden."""
    return df.where(F.col("quality_score") > F.lit(above))


def _as_bound(value, end_of_day: bool = False):
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if end_of_day:
        value = value + dt.timedelta(days=1)
    return value


def optional_filters(location_id: int | None = None, parameter: str | None = None,
                     date_from=None, date_to=None, time_col: str = "measurement_time",
                     date_to_mode: str = "midnight") -> Column:
    """O-P5 conjunction of the given filters; ``None`` means "no filter".

    Unlike the reference (truthiness, T22) an id of 0 is a real filter.
    ``date_to_mode``: 'midnight' compares ``<= date_to`` as given (the rest of
    the last day is lost, T16); 'inclusive_day' keeps the whole last day.
    """
    preds: list[Column] = [F.lit(True)]
    if location_id is not None:
        preds.append(F.col("location_id") == F.lit(location_id))
    if parameter is not None:
        preds.append(F.col("parameter") == F.lit(parameter))
    if date_from is not None:
        preds.append(F.col(time_col) >= F.lit(_as_bound(date_from)))
    if date_to is not None:
        if date_to_mode == "inclusive_day":
            preds.append(F.col(time_col) < F.lit(_as_bound(date_to, end_of_day=True)))
        else:
            preds.append(F.col(time_col) <= F.lit(_as_bound(date_to)))
    return reduce(lambda a, b: a & b, preds)


def keep_valid_scored(df: DataFrame) -> DataFrame:
    """O-P6 three-way keep rule: value not null, >= 0, score > 0."""
    v = F.col("value")
    return df.where(v.isNotNull() & (v >= 0) & (F.col("quality_score") > 0))


def locations_filter(locations: DataFrame, active_only: bool = True,
                     country: str | None = None, city: str | None = None) -> DataFrame:
    """O-P7 active / country / city filter; O-L4 orders the result where that is wanted."""
    pred = F.lit(True)
    if active_only:
        pred = pred & (F.col("is_active") == F.lit(True))
    if country is not None:
        pred = pred & (F.col("country") == F.lit(country))
    if city is not None:
        pred = pred & (F.col("city") == F.lit(city))
    return locations.where(pred)


def by_location_id(df: DataFrame, location_id: int) -> DataFrame:
    """O-P8 point lookup. Batch form: ``df.join(ids, 'location_id', 'left_semi')``."""
    return df.where(F.col("location_id") == F.lit(location_id))


def by_location_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """O-P8 batch lookup as a semi-join (AQE broadcasts ``ids`` when small)."""
    return df.join(ids.select("location_id").distinct(), "location_id", "left_semi")


def search_locations(locations: DataFrame, term: str,
                     limit: int = fixed.SEARCH_LIMIT) -> DataFrame:
    """O-P9 case-insensitive contains on name, city or country; top ``limit``
    by country, city, name with nulls last (T6) and the id as tie-break."""
    pred = (X.contains_ci("name", term) | X.contains_ci("city", term)
            | X.contains_ci("country", term))
    cols = ["location_id", "name", "city", "country", "latitude", "longitude", "is_active"]
    return (locations.where(pred).select(*cols)
            .orderBy(F.col("country").asc_nulls_last(), F.col("city").asc_nulls_last(),
                     F.col("name").asc_nulls_last(), F.col("location_id").asc())
            .limit(limit))


def daily_slice(daily: DataFrame, location=None, parameter=None,
                start_date=None, end_date=None, location_col: str = "location",
                date_col: str = "measurement_date") -> DataFrame:
    """O-P10 equality on location/parameter and an inclusive date range."""
    pred = F.lit(True)
    if location is not None:
        pred = pred & (F.col(location_col) == F.lit(location))
    if parameter is not None:
        pred = pred & (F.col("parameter") == F.lit(parameter))
    if start_date is not None:
        pred = pred & (F.col(date_col) >= F.lit(_as_bound(start_date)))
    if end_date is not None:
        pred = pred & (F.col(date_col) <= F.lit(_as_bound(end_date)))
    return daily.where(pred)


def with_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """O-P11 drop rows without coordinates."""
    return df.dropna(subset=[lat, lon])


def in_bbox(df: DataFrame, bbox: tuple[float, float, float, float],
            lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """O-P12 bounding box (minLon, minLat, maxLon, maxLat), inclusive."""
    min_lon, min_lat, max_lon, max_lat = bbox
    return df.where(F.col(lon).between(min_lon, max_lon) & F.col(lat).between(min_lat, max_lat))


# Payload field -> table column (O-P13).


def standardise_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """O-P13 rename known columns, keep the rest."""
    m = mapping or fixed.PAYLOAD_RENAMES
    return df.select(*[F.col(f"`{c}`").alias(m.get(c, c)) for c in df.columns])


def flatten_coordinates(df: DataFrame, struct_col: str = "coordinates",
                        drop: bool = True) -> DataFrame:
    """O-P14 / O-F22 ``coordinates.{latitude,longitude}`` -> two columns
    (null-safe: a null struct gives null fields)."""
    out = (df.withColumn("latitude", F.col(f"{struct_col}.latitude"))
             .withColumn("longitude", F.col(f"{struct_col}.longitude")))
    return out.drop(struct_col) if drop else out


def with_lineage(df: DataFrame, source: str = fixed.SOURCE_NAME, now: Column | None = None) -> DataFrame:
    """O-P17 literal source column and ingestion time (one value per query)."""
    return df.withColumn("source", F.lit(source)).withColumn(
        "ingestion_time", now if now is not None else X.utc_now())


def empty_like(df: DataFrame) -> DataFrame:
    """O-P18 empty clone (``WHERE 1 = 0``); folds to an empty LocalRelation."""
    return df.limit(0)


def ensure_parameter_columns(df: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """O-P19 add missing parameter columns as null and coerce all to double."""
    params = parameters or fixed.POLLUTANT_ORDER
    have = set(df.columns)
    out = df
    for p in params:
        out = out.withColumn(p, X.to_number(p) if p in have else F.lit(None).cast("double"))
    return out


def choose_parameter(df: DataFrame, current: str | None, location=None,
                     location_col: str = "location") -> DataFrame:
    """O-P20 current selection when it exists at the location, else the first
    sorted parameter seen there. One-row result; ``chosen`` null if none."""
    scope = df if location is None else df.where(F.col(location_col) == F.lit(location))
    agg = scope.where(F.col("parameter").isNotNull()).agg(
        F.min("parameter").alias("first_parameter"),
        F.max(F.when(F.col("parameter") == F.lit(current), F.lit(1)).otherwise(F.lit(0)))
        .alias("has_current"))
    return agg.select(F.when(F.col("has_current") == 1, F.lit(current))
                      .otherwise(F.col("first_parameter")).alias("chosen"))


def validate_required(df: DataFrame, required: str = "id") -> DataFrame:
    """O-P16 one aggregate: rows, rows missing the required field, valid flag
    (an empty input is invalid)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count(F.when(F.col(required).isNull(), F.lit(1))).alias("n_missing")) \
        .withColumn("is_valid", (F.col("n_rows") > 0) & (F.col("n_missing") == 0))


def invalid_rows(df: DataFrame, required: str = "id") -> DataFrame:
    """O-P16 the offending rows themselves: those missing the required field."""
    return df.where(F.col(required).isNull())
