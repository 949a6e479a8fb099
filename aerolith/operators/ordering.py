"""Sorts, limits, top-k and set operations (O-L1 .. O-L9, O-E1 .. O-E4).

Every limit here is the feature itself (a page, a cap, a top-k report) and
is placed in the plan, so Spark runs ``TakeOrderedAndProject`` (per-task
top-k, then a merge of at most k rows per task). Each order ends in a key
that makes it total, so a page is reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.operators import predicates as P


def _clamp(n: int, lo: int, hi: int) -> int:
    if not lo <= n <= hi:
        raise ValueError(f"limit {n} outside [{lo}, {hi}]")
    return n


def latest_page(latest: DataFrame, location_id: int | None = None, parameter: str | None = None,
                limit: int = fixed.LATEST_PAGE_DEFAULT) -> DataFrame:
    """O-L1 ``/measurements/latest``: trusted latest values, newest first."""
    n = _clamp(limit, 1, fixed.LATEST_PAGE_MAX)
    src = P.trusted(latest).where(P.optional_filters(location_id, parameter))
    return src.orderBy(F.col("measurement_time").desc(), F.col("location_id").asc(),
                       F.col("parameter").asc()).limit(n)


def daily_page(daily: DataFrame, location_id: int | None = None, parameter: str | None = None,
               date_from=None, date_to=None, limit: int = fixed.DAILY_PAGE_DEFAULT) -> DataFrame:
    """O-L2 ``/measurements/daily``: filters, newest day first, capped."""
    n = _clamp(limit, 1, fixed.DAILY_PAGE_MAX)
    pred = P.optional_filters(location_id, parameter, date_from, date_to,
                              time_col="measurement_date")
    cols = ["location_id", "location", "parameter", "unit", "measurement_date", "avg_value",
            "min_value", "max_value", "std_value", "measurement_count", "avg_quality"]
    return (daily.where(pred).select(*cols)
            .orderBy(F.col("measurement_date").desc(), F.col("location_id").asc(),
                     F.col("parameter").asc(), F.col("unit").asc_nulls_last(),
                     F.col("location").asc_nulls_last())
            .limit(n))


def trend_series(m: DataFrame, location_id: int | None = None, parameter: str | None = None,
                 start=None, end=None, cap: int = fixed.TREND_SERIES_CAP) -> DataFrame:
    """O-L3 newest ``cap`` trusted readings, returned in ascending time for
    display (top-k first, then a sort of at most ``cap`` rows)."""
    pred = P.optional_filters(location_id, parameter, start, end)
    top = (P.trusted(m).where(pred).select("id", "measurement_time", "value", "parameter")
           .orderBy(F.col("measurement_time").desc(), F.col("id").desc()).limit(cap))
    return top.orderBy("measurement_time", "id")


def order_locations(locations: DataFrame) -> DataFrame:
    """O-L4 country, city, name with nulls last (T6), id as tie-break."""
    return locations.orderBy(F.col("country").asc_nulls_last(), F.col("city").asc_nulls_last(),
                             F.col("name").asc_nulls_last(), F.col("location_id").asc())


def cap_rows(df: DataFrame, n: int = fixed.EXPORT_MAX_ROWS) -> DataFrame:
    """O-L6 cap inside the plan (the reference fetched everything first)."""
    return df.limit(n)


def first_locations(locations: DataFrame, n: int) -> DataFrame:
    """O-L7 first ``n`` locations by id (the reference order is arbitrary)."""
    return locations.orderBy("location_id").limit(n)


def by_weekday(df: DataFrame, date_col: str = "measurement_date") -> DataFrame:
    """O-L8 Monday-first weekday order, then the date."""
    return df.orderBy(F.weekday(F.col(date_col)), F.col(date_col))


def newest_first(df: DataFrame, time_col: str = "measurement_time", tie: str = "id") -> DataFrame:
    """O-L9 map layer newest first, no limit: a global range-partitioned sort,
    to be requested only when the consumer needs the order."""
    return df.orderBy(F.col(time_col).desc(), F.col(tie).desc())


# ------------------------------------------------------------------ set operations
def location_options(summary: DataFrame) -> DataFrame:
    """O-E1 DISTINCT (location_id, location_name) ordered by name."""
    return (summary.select("location_id", "location_name").distinct()
            .orderBy(F.col("location_name").asc_nulls_last(), F.col("location_id")))


def sorted_options(values: DataFrame, col: str, fallback: DataFrame | None = None,
                   fallback_col: str | None = None) -> DataFrame:
    """O-E2 sorted distinct non-null values; when there are none, the
    fallback's non-null values instead (guarded by a NOT EXISTS subquery)."""
    v = values.select(F.col(col).alias("value")).dropna().distinct()
    if fallback is not None:
        fb = (fallback.select(F.col(fallback_col or col).alias("value")).dropna().distinct()
              .where(~v.exists()))
        v = v.unionByName(fb)
    return v.orderBy("value")


def union_sources(*frames: DataFrame) -> DataFrame:
    """O-E3 / O-E4 UNION ALL by name on the common columns."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionByName(f.select(*common))
    return out
