"""Checked queries over the adapter relations: scalars, predicates, latest
family, aggregates, quality profile, joins, mutations, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import aggregates as A
from aerolith.operators import joins as J
from aerolith.operators import latest as W
from aerolith.operators import ordering as L
from aerolith.operators import predicates as P
from aerolith.operators import quality as Q
from aerolith.plans import adapter as AD
from aerolith.plans.adapter import oracle
from aerolith.plans.registry import dates_as_timestamps, register, rounded

M = AD.measurements
S = AD.scored
R = AD.raw_air_quality
LOC = AD.locations

FACT_COLS = ("id, location_id, sensor_id, location, latitude, longitude, parameter, unit, "
             "value, measurement_time")
PARAMS5 = ["pm25", "pm10", "so2", "no2", "humidity"]

# ============================================================== O-A4 (flagship)
DAILY_SQL = oracle("""
SELECT location_id, location, parameter, unit,
       CAST(CAST(measurement_time AS DATE) AS TIMESTAMP) AS measurement_date,
       ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
       ROUND(STDDEV_SAMP(value), 6) AS std_value, COUNT(*) AS measurement_count,
       ROUND(AVG(quality_score), 6) AS avg_quality
FROM measurements WHERE quality_score > 0.5
GROUP BY location_id, location, parameter, unit, CAST(measurement_time AS DATE)
""")


@register("daily_aggregates", DAILY_SQL)
def q_daily_aggregates(spark, d):
    out = A.daily_aggregates(M(spark, d))
    return rounded(dates_as_timestamps(out), "avg_value", "std_value", "avg_quality")


# ============================================================== scalars
@register("quality_score", oracle("SELECT id, parameter, value, ROUND(quality_score, 6) AS quality_score FROM scored"))
def q_quality_score(spark, d):
    s = S(spark, d).select("id", "parameter", "value", "quality_score")
    return rounded(s, "quality_score")


@register("time_parts", oracle("""
SELECT id, CAST(CAST(measurement_time AS DATE) AS TIMESTAMP) AS day,
       dayofweek(measurement_time) AS weekday_sql, isodow(measurement_time) - 1 AS weekday_monday0,
       dayname(measurement_time) AS weekday_name,
       CAST(CASE WHEN isodow(measurement_time) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
       date_trunc('hour', measurement_time) AS hour,
       strftime(measurement_time, '%m') AS month, year(measurement_time) AS year,
       measurement_time - INTERVAL 24 HOURS AS minus_24h, measurement_time - INTERVAL 1 DAY AS minus_1d
FROM measurements"""))
def q_time_parts(spark, d):
    m = M(spark, d)
    t = F.col("measurement_time")
    return m.select("id", X.to_midnight(t).alias("day"),
                    X.weekday_number_sql(t).alias("weekday_sql"),
                    X.weekday_number_monday0(t).alias("weekday_monday0"),
                    X.weekday_name(t).alias("weekday_name"), X.weekend_flag(t).alias("is_weekend"),
                    X.floor_hour(t).alias("hour"), X.month_text(t).alias("month"),
                    X.year_number(t).alias("year"), X.minus_hours(t, 24).alias("minus_24h"),
                    X.minus_days(t, 1).alias("minus_1d"))


LABEL_CASE = "CASE parameter " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PARAMETER_LABELS.items()) + " ELSE upper(parameter) END"


@register("text_functions", oracle(f"""
SELECT id, {LABEL_CASE} AS parameter_label, translate(lower(location), ' /', '__') AS location_slug,
       upper(parameter) AS parameter_upper, lower(location) AS location_lower,
       COALESCE(NULLIF(location, ''), CAST(location_id AS VARCHAR)) AS location_or_id
FROM measurements"""))
def q_text_functions(spark, d):
    m = M(spark, d)
    return m.select("id", X.parameter_label("parameter").alias("parameter_label"),
                    X.slug("location").alias("location_slug"),
                    F.upper("parameter").alias("parameter_upper"),
                    F.lower("location").alias("location_lower"),
                    X.name_or_id("location", "location_id").alias("location_or_id"))


@register("numeric_functions", oracle("""
SELECT id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_num,
       CASE WHEN value IS NULL THEN NULL ELSE GREATEST(value, 1.0) END AS marker_size,
       CASE WHEN value IS NULL THEN 0 ELSE 1 END AS has_value
FROM scored"""))
def q_numeric_functions(spark, d):
    s = S(spark, d)
    return s.select("id", X.to_number("value").alias("value_num"),
                    X.clip_lower("value", 1.0).alias("marker_size"),
                    F.when(F.col("value").isNull(), 0).otherwise(1).alias("has_value"))


# ============================================================== predicates
@register("valid_readings", oracle("""
SELECT location_id, sensors_id, location, datetime, lat, lon, parameter, units, value, locationid, month, year
FROM raw_aq WHERE value >= 0"""))
def q_valid_readings(spark, d):
    return P.valid_readings(R(spark, d))


@register("load_readings", oracle("""
SELECT location_id, location, datetime, lat, lon, lower(parameter) AS parameter, units, value, sensors_id
FROM raw_aq WHERE value IS NOT NULL AND value >= 0"""))
def q_load_readings(spark, d):
    return P.load_readings(R(spark, d))


@register("load_readings_all", oracle("""
SELECT location_id, location, datetime, lat, lon, lower(parameter) AS parameter, units, value, sensors_id
FROM raw_aq"""))
def q_load_readings_all(spark, d):
    return P.load_readings(R(spark, d), include_invalid=True)


@register("parameter_in", oracle(f"SELECT {FACT_COLS} FROM measurements WHERE parameter IN ('pm10', 'pm25', 'so2')"))
def q_parameter_in(spark, d):
    return P.parameter_in(M(spark, d), ["pm10", "pm25", "so2"]).drop("quality_score")


@register("trusted", oracle(f"SELECT {FACT_COLS}, ROUND(quality_score, 6) AS quality_score FROM measurements WHERE quality_score > 0.5"))
def q_trusted(spark, d):
    return rounded(P.trusted(M(spark, d)), "quality_score")


@register("optional_filters", oracle(f"""
SELECT {FACT_COLS} FROM measurements
WHERE parameter = 'pm25' AND measurement_time >= TIMESTAMP '2024-01-05 00:00:00'
  AND measurement_time <= TIMESTAMP '2024-01-20 00:00:00'"""))
def q_optional_filters(spark, d):
    pred = P.optional_filters(None, "pm25", "2024-01-05", "2024-01-20")
    return M(spark, d).where(pred).drop("quality_score")


@register("optional_filters_inclusive_day", oracle(f"""
SELECT {FACT_COLS} FROM measurements
WHERE parameter = 'no2' AND measurement_time >= TIMESTAMP '2024-01-05 00:00:00'
  AND CAST(measurement_time AS DATE) <= DATE '2024-01-20'"""))
def q_optional_filters_inclusive(spark, d):
    pred = P.optional_filters(None, "no2", "2024-01-05", "2024-01-20", date_to_mode="inclusive_day")
    return M(spark, d).where(pred).drop("quality_score")


@register("keep_valid_scored", oracle(f"SELECT {FACT_COLS}, ROUND(quality_score, 6) AS quality_score FROM measurements"))
def q_keep_valid(spark, d):
    return rounded(P.keep_valid_scored(S(spark, d)), "quality_score")


@register("locations_active_country", oracle("""
SELECT location_id, name, city, country, latitude, longitude, timezone, is_active
FROM locations WHERE is_active AND country = 'ASIA'"""))
def q_locations_filter(spark, d):
    return P.locations_filter(LOC(spark, d), True, country="ASIA")


@register("locations_by_ids", oracle("""
SELECT l.location_id, l.name, l.city, l.country FROM locations l
WHERE EXISTS (SELECT 1 FROM measurements m WHERE m.location_id = l.location_id AND m.parameter = 'so2')"""))
def q_locations_by_ids(spark, d):
    ids = M(spark, d).where(F.col("parameter") == "so2").select("location_id")
    return P.by_location_ids(LOC(spark, d), ids).select("location_id", "name", "city", "country")


@register("search_locations", oracle("""
SELECT location_id, name, city, country, latitude, longitude, is_active FROM locations
WHERE lower(name) LIKE '%nation_1%' OR lower(city) LIKE '%nation_1%' OR lower(country) LIKE '%nation_1%'
ORDER BY country NULLS LAST, city NULLS LAST, name NULLS LAST, location_id LIMIT 50"""))
def q_search(spark, d):
    return P.search_locations(LOC(spark, d), "NATION_1")


@register("coordinates_bbox", oracle(f"""
SELECT {FACT_COLS} FROM measurements
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  AND longitude BETWEEN -100 AND -20 AND latitude BETWEEN 10 AND 60"""))
def q_bbox(spark, d):
    m = P.with_coordinates(M(spark, d))
    return P.in_bbox(m, (-100.0, 10.0, -20.0, 60.0)).drop("quality_score")


@register("lineage_source", oracle(f"SELECT id, '{fixed.SOURCE_NAME}' AS source FROM measurements"))
def q_lineage(spark, d):
    return P.with_lineage(M(spark, d)).select("id", "source")


@register("validate_required", oracle("""
SELECT COUNT(*) AS n_rows, COUNT(CASE WHEN value IS NULL THEN 1 END) AS n_missing,
       COUNT(*) > 0 AND COUNT(CASE WHEN value IS NULL THEN 1 END) = 0 AS is_valid
FROM scored"""))
def q_validate(spark, d):
    return P.validate_required(S(spark, d), "value")


@register("choose_parameter", oracle("""
SELECT CASE WHEN MAX(CASE WHEN parameter = 'o3' THEN 1 ELSE 0 END) = 1 THEN 'o3'
            ELSE MIN(parameter) END AS chosen
FROM raw_aq WHERE location = 'Customer#000000007' AND parameter IS NOT NULL"""))
def q_choose_parameter(spark, d):
    return P.choose_parameter(R(spark, d), "o3", "Customer#000000007")


# ============================================================== latest family
@register("latest_ranked_sql", oracle("""
SELECT location_id, location, lat, lon, parameter, value, datetime FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter
         ORDER BY datetime DESC, value DESC, lat DESC, lon DESC, location DESC) AS rn
  FROM raw_aq WHERE value >= 0 AND parameter IN ('pm10', 'pm25', 'so2')) t
WHERE rn = 1"""))
def q_latest_ranked(spark, d):
    return W.latest_ranked_sql(R(spark, d))


LATEST_PIVOT_SQL = oracle("""
SELECT location_id, location, MAX(lat) AS lat, MAX(lon) AS lon, MAX(datetime) AS datetime,
       MAX(CASE WHEN parameter = 'pm10' THEN value END) AS pm10,
       MAX(CASE WHEN parameter = 'pm25' THEN value END) AS pm25,
       MAX(CASE WHEN parameter = 'so2' THEN value END) AS so2
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter
             ORDER BY datetime DESC, value DESC, lat DESC, lon DESC, location DESC) AS rn
      FROM raw_aq WHERE value >= 0 AND parameter IN ('pm10', 'pm25', 'so2')) t
WHERE rn = 1 GROUP BY location_id, location""")


@register("latest_pivot_sql", LATEST_PIVOT_SQL)
def q_latest_pivot(spark, d):
    return W.latest_pivot_sql(R(spark, d))


LATEST_M_SQL = oracle("""
SELECT location_id, location, latitude, longitude, parameter, unit, value, measurement_time,
       ROUND(quality_score, 6) AS quality_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter
         ORDER BY measurement_time DESC, id DESC) AS rn
  FROM measurements WHERE quality_score > 0.5) t WHERE rn = 1""")


@register("latest_measurements", LATEST_M_SQL)
def q_latest_measurements(spark, d):
    return rounded(W.latest_measurements(M(spark, d)), "quality_score")


GEN1_VALID = """
v AS (SELECT location_id, location, datetime, lat, lon, lower(parameter) AS parameter, units, value, sensors_id
      FROM raw_aq WHERE value IS NOT NULL AND value >= 0),
lr AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, location, parameter
               ORDER BY datetime DESC, sensors_id DESC, value DESC, lat DESC, lon DESC) AS rn
        FROM v WHERE location_id IS NOT NULL AND location IS NOT NULL AND parameter IS NOT NULL) t
       WHERE rn = 1)"""


@register("latest_rows_pandas", oracle(
    "SELECT location_id, location, parameter, datetime, lat, lon, units, value, sensors_id FROM lr",
    GEN1_VALID))
def q_latest_rows_pandas(spark, d):
    return W.latest_rows_pandas(R(spark, d)).select(
        "location_id", "location", "parameter", "datetime", "lat", "lon", "units", "value", "sensors_id")


@register("latest_map", oracle("""
SELECT location_id, location, MAX(datetime) OVER (PARTITION BY location_id, location) AS datetime,
       CASE parameter WHEN 'humidity' THEN 'not_listed' ELSE parameter END AS parameter, value FROM lr""", GEN1_VALID))
def q_latest_map(spark, d):
    """O-W3: a parameter outside the fixed list survives."""
    raw = R(spark, d).withColumn("parameter", F.when(F.lower("parameter") == "humidity", F.lit("not_listed"))
                                 .otherwise(F.col("parameter")))
    return W.latest_map(raw).select("location_id", "location", "datetime", F.explode("latest").alias("parameter", "value"))


def _pollutant_cols_sql(src: str = "lr") -> str:
    return ",\n       ".join(f"MAX(CASE WHEN parameter = '{p}' THEN value END) AS {p}"
                              for p in fixed.POLLUTANT_ORDER)


AQI_SQL = """
CASE WHEN pm25 IS NULL AND pm10 IS NULL THEN 0.0 WHEN pm25 IS NULL THEN pm10 WHEN pm10 IS NULL THEN pm25
     ELSE GREATEST(pm25, pm10) END"""


def _band_sql(x: str, pick: int) -> str:
    parts = " ".join(f"WHEN {x} >= {lo} AND {x} <= {hi} THEN '{b[pick]}'"
                     for b in fixed.AQI_BREAKPOINTS for lo, hi in [(b[0], b[1])])
    none = fixed.AQI_NO_READING[pick - 2]
    other = fixed.AQI_OUT_OF_BANDS[pick - 2]
    return f"CASE WHEN {x} IS NULL THEN '{none}' {parts} ELSE '{other}' END"


WIDE_CTE = GEN1_VALID + f""",
w AS (SELECT location_id, location,
       first(lat ORDER BY datetime DESC, parameter DESC) FILTER (WHERE lat IS NOT NULL) AS lat,
       first(lon ORDER BY datetime DESC, parameter DESC) FILTER (WHERE lon IS NOT NULL) AS lon,
       MAX(datetime) AS datetime,
       {_pollutant_cols_sql()}
      FROM lr GROUP BY location_id, location),
wa AS (SELECT *, {AQI_SQL} AS aqi FROM w)"""

WIDE_SELECT = ("SELECT *, " + _band_sql("aqi", 2) + " AS aqi_category, "
               + _band_sql("aqi", 3) + " AS aqi_color FROM wa")


@register("latest_wide", oracle(WIDE_SELECT, WIDE_CTE))
def q_latest_wide(spark, d):
    return W.latest_wide(R(spark, d))


@register("most_recent_row", oracle(
    "SELECT * FROM (" + WIDE_SELECT + ") x ORDER BY datetime DESC, location_id DESC LIMIT 1", WIDE_CTE))
def q_most_recent_row(spark, d):
    return W.most_recent_row(W.latest_wide(R(spark, d)))


@register("aqi_share", oracle(
    "SELECT location_id, location, aqi, LEAST(aqi / 500.0, 1.0) * 360.0 AS aqi_degrees, "
    + _band_sql("aqi", 2) + " AS category FROM wa", WIDE_CTE))
def q_aqi_share(spark, d):
    w = W.latest_wide(R(spark, d))
    return w.select("location_id", "location", "aqi", X.aqi_share_degrees("aqi").alias("aqi_degrees"),
                    X.aqi_category("aqi").alias("category"))


@register("last_value_pivot", oracle("""
SELECT location_id, location,
       """ + ",\n       ".join(
    f"arg_max(value, (datetime, sensors_id)) FILTER (WHERE parameter = '{p}' AND value IS NOT NULL) AS {p}"
    for p in PARAMS5) + """
FROM raw_aq WHERE value >= 0 AND parameter IS NOT NULL GROUP BY location_id, location"""))
def q_last_value_pivot(spark, d):
    v = P.valid_readings(R(spark, d))
    return W.last_value_pivot(v, ["location_id", "location"], PARAMS5, "datetime", ["sensors_id"])


@register("duplicated_rows", oracle(f"""
SELECT {FACT_COLS} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, measurement_time, parameter ORDER BY id) AS rn
  FROM scored) t WHERE rn > 1"""))
def q_duplicated_rows(spark, d):
    return W.duplicated_rows(S(spark, d), ["location_id", "measurement_time", "parameter"], "id") \
        .drop("quality_score")


@register("newest_per_location", oracle(f"""
SELECT {FACT_COLS} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY measurement_time DESC, id DESC) AS rn
  FROM measurements) t WHERE rn <= 100"""))
def q_newest_per_location(spark, d):
    return W.newest_n_per_location(M(spark, d), 100).drop("quality_score")


# ============================================================== aggregates
@register("daily_stats_sql", oracle("""
SELECT location_id, location, CAST(CAST(datetime AS DATE) AS TIMESTAMP) AS measurement_date,
       dayofweek(datetime) AS weekday_number, dayname(datetime) AS weekday,
       CAST(CASE WHEN dayname(datetime) IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
       lat, lon, parameter, units, ROUND(AVG(value), 6) AS average_value
FROM raw_aq WHERE value >= 0
GROUP BY location_id, location, CAST(datetime AS DATE), dayofweek(datetime), dayname(datetime),
         CASE WHEN dayname(datetime) IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END,
         lat, lon, parameter, units"""))
def q_daily_stats_sql(spark, d):
    return rounded(dates_as_timestamps(A.daily_stats_sql(R(spark, d))), "average_value")


DAILY_PANDAS_BODY = """
SELECT location_id, location, CAST(CAST(datetime AS DATE) AS TIMESTAMP) AS measurement_date,
       isodow(datetime) - 1 AS weekday_number, dayname(datetime) AS weekday,
       CAST(CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
       parameter, units, MAX(lat) AS lat, MAX(lon) AS lon, ROUND(AVG(value), 6) AS average_value
FROM v WHERE location_id IS NOT NULL AND location IS NOT NULL AND parameter IS NOT NULL
  AND units IS NOT NULL AND datetime IS NOT NULL
GROUP BY location_id, location, CAST(datetime AS DATE), isodow(datetime), dayname(datetime), parameter, units"""


@register("daily_stats_pandas", oracle(DAILY_PANDAS_BODY, GEN1_VALID))
def q_daily_stats_pandas(spark, d):
    return rounded(A.daily_stats_pandas(R(spark, d)), "average_value")


@register("daily_slice", oracle(
    "SELECT * FROM dp WHERE location = 'Customer#000000042' AND parameter = 'pm25' "
    "AND measurement_date >= TIMESTAMP '2024-01-03' AND measurement_date <= TIMESTAMP '2024-01-25'",
    GEN1_VALID + ",\ndp AS (" + DAILY_PANDAS_BODY + ")"))
def q_daily_slice(spark, d):
    daily = rounded(A.daily_stats_pandas(R(spark, d)), "average_value")
    return P.daily_slice(daily, "Customer#000000042", "pm25", "2024-01-03", "2024-01-25")


# ------------------------------------------------------------- location summaries
@register("location_summary", oracle("""
SELECT l.location_id, l.name AS location_name, l.city, l.country, l.latitude, l.longitude,
       COUNT(DISTINCT m.parameter) AS parameter_count, MAX(m.measurement_time) AS last_measurement_time,
       ROUND(AVG(m.quality_score), 6) AS avg_quality_score
FROM locations l LEFT JOIN measurements m ON l.location_id = m.location_id
WHERE l.is_active = TRUE
GROUP BY l.location_id, l.name, l.city, l.country, l.latitude, l.longitude"""))
def q_location_summary(spark, d):
    return rounded(A.location_summary(LOC(spark, d), M(spark, d)), "avg_quality_score")


@register("location_statistics", oracle("""
SELECT l.location_id, l.name, l.city, l.country, COUNT(DISTINCT m.parameter) AS parameter_count,
       COUNT(m.id) AS total_measurements, MAX(m.measurement_time) AS last_measurement_time,
       ROUND(AVG(m.quality_score), 6) AS avg_quality_score, MIN(m.measurement_time) AS first_measurement_time
FROM locations l LEFT JOIN measurements m ON l.location_id = m.location_id
GROUP BY l.location_id, l.name, l.city, l.country"""))
def q_location_statistics(spark, d):
    return rounded(A.location_statistics(LOC(spark, d), M(spark, d)), "avg_quality_score")


@register("location_statistics_one", oracle("""
SELECT l.location_id, l.name, l.city, l.country, COUNT(DISTINCT m.parameter) AS parameter_count,
       COUNT(m.id) AS total_measurements, MAX(m.measurement_time) AS last_measurement_time,
       ROUND(AVG(m.quality_score), 6) AS avg_quality_score, MIN(m.measurement_time) AS first_measurement_time
FROM locations l LEFT JOIN measurements m ON l.location_id = m.location_id
WHERE l.location_id = 42 GROUP BY l.location_id, l.name, l.city, l.country"""))
def q_location_statistics_one(spark, d):
    return rounded(A.location_statistics(LOC(spark, d), M(spark, d), 42), "avg_quality_score")


@register("location_groups", oracle("""
SELECT l.country, l.city, COUNT(DISTINCT l.location_id) AS location_count,
       COUNT(DISTINCT m.parameter) AS parameter_count
FROM locations l LEFT JOIN measurements m ON l.location_id = m.location_id
WHERE l.is_active GROUP BY l.country, l.city"""))
def q_location_groups(spark, d):
    return A.location_groups(LOC(spark, d), M(spark, d))


@register("system_summary", oracle("""
SELECT (SELECT COUNT(*) FROM locations WHERE is_active) AS total_locations,
       COUNT(*) AS total_measurements, COUNT(DISTINCT parameter) AS total_parameters,
       MAX(measurement_time) AS latest_measurement
FROM measurements"""))
def q_system_summary(spark, d):
    return A.system_summary(LOC(spark, d), M(spark, d))


@register("trusted_summary", oracle("""
SELECT COUNT(DISTINCT location_id) AS location_count, COUNT(DISTINCT parameter) AS parameter_count,
       COUNT(*) AS total_measurements, MAX(measurement_time) AS latest_measurement
FROM measurements WHERE quality_score > 0.5"""))
def q_trusted_summary(spark, d):
    return A.trusted_summary(M(spark, d))


@register("quality_by_parameter", oracle("""
SELECT parameter, COUNT(*) AS count, ROUND(AVG(quality_score), 6) AS avg_quality
FROM measurements GROUP BY parameter"""))
def q_quality_by_parameter(spark, d):
    return rounded(A.quality_by_parameter(M(spark, d)), "avg_quality")


@register("quality_overview", oracle("""
SELECT ROUND(AVG(avg_quality), 6) AS avg_quality, CAST(SUM(count) AS BIGINT) AS total_records,
       COUNT(*) AS parameters
FROM (SELECT parameter, COUNT(*) AS count, AVG(quality_score) AS avg_quality
      FROM measurements GROUP BY parameter) q"""))
def q_quality_overview(spark, d):
    return rounded(A.quality_overview(M(spark, d)), "avg_quality")


@register("hourly", oracle("""
SELECT location_id, parameter, date_trunc('hour', measurement_time) AS hour,
       ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
       ROUND(STDDEV_SAMP(value), 6) AS std_value, COUNT(value) AS count,
       ROUND(AVG(quality_score), 6) AS avg_quality,
       first(latitude ORDER BY measurement_time, id) FILTER (WHERE latitude IS NOT NULL) AS latitude,
       first(longitude ORDER BY measurement_time, id) FILTER (WHERE longitude IS NOT NULL) AS longitude,
       first(unit ORDER BY measurement_time, id) FILTER (WHERE unit IS NOT NULL) AS unit
FROM measurements GROUP BY location_id, parameter, date_trunc('hour', measurement_time)"""))
def q_hourly(spark, d):
    return rounded(A.hourly(M(spark, d)), "avg_value", "std_value", "avg_quality")


@register("counts_by_parameter", oracle("""
SELECT parameter, COUNT(*) AS count FROM raw_aq WHERE value IS NOT NULL AND value >= 0 GROUP BY parameter"""))
def q_counts_by_parameter(spark, d):
    return A.counts_by_parameter(P.load_readings(R(spark, d)))


@register("top_locations", oracle("""
SELECT location, COUNT(*) AS count FROM raw_aq
WHERE value IS NOT NULL AND value >= 0 AND location IS NOT NULL
GROUP BY location ORDER BY count DESC, location LIMIT 12"""))
def q_top_locations(spark, d):
    return A.top_locations_by_count(P.load_readings(R(spark, d)))


LABEL_CASE_RAW = LABEL_CASE.replace("parameter", "lower(parameter)")


@register("overview", oracle(f"""
SELECT COUNT(*) AS total_records, COUNT(DISTINCT location) AS location_count,
       COUNT(DISTINCT lower(parameter)) AS parameter_count,
       CAST(MIN(CAST(datetime AS DATE)) AS TIMESTAMP) AS min_date,
       CAST(MAX(CAST(datetime AS DATE)) AS TIMESTAMP) AS max_date,
       MAX(datetime) AS latest_reading,
       (SELECT string_agg({LABEL_CASE}, ', ' ORDER BY parameter) FROM (
          SELECT DISTINCT lower(parameter) AS parameter FROM raw_aq
          WHERE value IS NOT NULL AND value >= 0 AND parameter IS NOT NULL) c) AS parameter_labels
FROM raw_aq WHERE value IS NOT NULL AND value >= 0"""))
def q_overview(spark, d):
    return A.overview(R(spark, d))


@register("non_null_counts", oracle("""
SELECT parameter, COUNT(id) AS id, COUNT(location_id) AS location_id, COUNT(sensor_id) AS sensor_id,
       COUNT(location) AS location, COUNT(latitude) AS latitude, COUNT(longitude) AS longitude,
       COUNT(unit) AS unit, COUNT(value) AS value, COUNT(measurement_time) AS measurement_time,
       COUNT(quality_score) AS quality_score
FROM scored WHERE parameter IS NOT NULL GROUP BY parameter"""))
def q_non_null_counts(spark, d):
    return A.non_null_counts(S(spark, d))


def _profile_sql(col: str) -> str:
    return (f"SELECT '{col}' AS \"column\", COUNT({col}) AS count, ROUND(AVG({col}), 6) AS mean, "
            f"ROUND(STDDEV_SAMP({col}), 6) AS std, MIN({col}) AS min, "
            f"ROUND(quantile_cont({col}, 0.25), 6) AS p25, ROUND(quantile_cont({col}, 0.5), 6) AS p50, "
            f"ROUND(quantile_cont({col}, 0.75), 6) AS p75, MAX({col}) AS max FROM measurements")


NUMERIC = ("id", "location_id", "sensor_id", "latitude", "longitude", "value", "quality_score")


@register("numeric_profile", oracle(" UNION ALL ".join(
    _profile_sql(c) for c in NUMERIC)))
def q_numeric_profile(spark, d):
    out = A.numeric_profile(M(spark, d), list(NUMERIC))
    return rounded(out, "mean", "std", "p25", "p50", "p75")


@register("mean_matrix", oracle("""
SELECT location_id, """ + ", ".join(
    f"ROUND(AVG(value) FILTER (WHERE parameter = '{p}'), 6) AS {p}" for p in PARAMS5) + """
FROM measurements GROUP BY location_id"""))
def q_mean_matrix(spark, d):
    out = A.mean_matrix(M(spark, d), "parameter", "location_id", "value", PARAMS5)
    return rounded(out, *PARAMS5)


@register("mean_matrix_long", oracle("""
SELECT location_id, parameter, ROUND(AVG(value), 6) AS avg_value
FROM measurements GROUP BY location_id, parameter"""))
def q_mean_matrix_long(spark, d):
    return rounded(A.mean_matrix_long(M(spark, d), "parameter", "location_id", "value"), "avg_value")


@register("map_center", oracle("""
SELECT ROUND(AVG(latitude), 6) AS center_lat, ROUND(AVG(longitude), 6) AS center_lon FROM measurements
WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""))
def q_map_center(spark, d):
    return rounded(A.map_center(P.with_coordinates(M(spark, d))), "center_lat", "center_lon")


@register("weekday_distribution", oracle("""
SELECT weekday_number, weekday, MIN(average_value) AS min, ROUND(quantile_cont(average_value, 0.25), 6) AS q1,
       ROUND(quantile_cont(average_value, 0.5), 6) AS median, ROUND(quantile_cont(average_value, 0.75), 6) AS q3,
       MAX(average_value) AS max, COUNT(average_value) AS count
FROM (""" + DAILY_PANDAS_BODY.replace("ROUND(AVG(value), 6)", "AVG(value)") + """) dp
GROUP BY weekday_number, weekday""", GEN1_VALID))
def q_weekday_distribution(spark, d):
    out = A.weekday_distribution(A.daily_stats_pandas(R(spark, d)))
    return rounded(out, "min", "q1", "median", "q3", "max")


@register("parameter_distribution", oracle("""
SELECT parameter, MIN(value) AS min, ROUND(quantile_cont(value, 0.25), 6) AS q1,
       ROUND(quantile_cont(value, 0.5), 6) AS median, ROUND(quantile_cont(value, 0.75), 6) AS q3,
       MAX(value) AS max, COUNT(value) AS count
FROM measurements WHERE quality_score > 0.5 GROUP BY parameter"""))
def q_parameter_distribution(spark, d):
    return rounded(A.parameter_distribution(P.trusted(M(spark, d))), "q1", "median", "q3")


@register("first_unit", oracle("""
SELECT location_id, parameter, first(units ORDER BY datetime, sensors_id) FILTER (WHERE units IS NOT NULL) AS units
FROM raw_aq GROUP BY location_id, parameter"""))
def q_first_unit(spark, d):
    return A.first_unit(R(spark, d), ["location_id", "parameter"], "units", ("datetime", "sensors_id"))


# ------------------------------------------------------------- quality profile
PROFILE_CTES = """
r AS (SELECT location_id, location, datetime, lat, lon, lower(parameter) AS parameter, units,
             value, sensors_id FROM raw_aq),
dup AS (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_records
        FROM (SELECT COUNT(*) AS n FROM r GROUP BY location_id, datetime, parameter) g),
st AS (SELECT COUNT(CASE WHEN last_t < (SELECT MAX(datetime) FROM r) - INTERVAL 24 HOURS THEN 1 END)
              AS stale_locations
       FROM (SELECT location, MAX(datetime) AS last_t FROM r WHERE location IS NOT NULL GROUP BY location) g)"""


@register("quality_profile", oracle("""
SELECT COUNT(*) AS total_records, COUNT(CASE WHEN value IS NULL THEN 1 END) AS missing_values,
       COUNT(CASE WHEN value < 0 THEN 1 END) AS negative_values,
       (SELECT duplicate_records FROM dup) AS duplicate_records,
       (SELECT stale_locations FROM st) AS stale_locations, MAX(datetime) AS latest_reading
FROM r""", PROFILE_CTES))
def q_quality_profile(spark, d):
    return Q.quality_profile(R(spark, d))


@register("duplicate_count", oracle("""
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_records FROM (
  SELECT COUNT(*) AS n FROM scored GROUP BY location_id, sensor_id, measurement_time, parameter) g"""))
def q_duplicate_count(spark, d):
    return Q.duplicate_count(S(spark, d), ["location_id", "sensor_id", "measurement_time", "parameter"])


@register("stale_locations", oracle("""
SELECT COUNT(CASE WHEN last_t < (SELECT MAX(measurement_time) FROM measurements) - INTERVAL 24 HOURS
              THEN 1 END) AS stale_locations
FROM (SELECT location, MAX(measurement_time) AS last_t FROM measurements
      WHERE location IS NOT NULL GROUP BY location) g"""))
def q_stale_locations(spark, d):
    return Q.stale_locations(M(spark, d), "location", "measurement_time", 24)


@register("stale_locations_all", oracle("""
SELECT COUNT(CASE WHEN last_t < (SELECT MAX(datetime) FROM raw_aq) - INTERVAL 24 HOURS THEN 1 END)
       AS stale_locations
FROM (SELECT location, MAX(datetime) AS last_t FROM raw_aq WHERE location IS NOT NULL GROUP BY location) g"""))
def q_stale_locations_all(spark, d):
    return Q.stale_locations(R(spark, d))


@register("outliers_iqr", oracle("""
SELECT m.id, m.parameter, m.value,
       COALESCE(m.value < b.q1 - 1.5 * (b.q3 - b.q1) OR m.value > b.q3 + 1.5 * (b.q3 - b.q1), FALSE) AS is_outlier
FROM measurements m LEFT JOIN (
  SELECT parameter, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM measurements GROUP BY parameter) b ON m.parameter = b.parameter"""))
def q_outliers_iqr(spark, d):
    return Q.outliers(M(spark, d), "iqr").select("id", "parameter", "value", "is_outlier")


@register("outliers_zscore", oracle("""
SELECT m.id, m.parameter, m.value,
       COALESCE(abs((m.value - b.mu) / NULLIF(b.sd, 0)) > 3, FALSE) AS is_outlier
FROM scored m LEFT JOIN (
  SELECT parameter, AVG(value) AS mu, STDDEV_SAMP(value) AS sd FROM scored GROUP BY parameter) b
  ON m.parameter = b.parameter"""))
def q_outliers_zscore(spark, d):
    return Q.outliers(S(spark, d), "zscore").select("id", "parameter", "value", "is_outlier")


@register("iqr_bounds", oracle("""
SELECT parameter, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower_bound,
       ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper_bound
FROM (SELECT parameter, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM measurements GROUP BY parameter) b"""))
def q_iqr_bounds(spark, d):
    return rounded(Q.iqr_bounds(M(spark, d)), "q1", "q3", "lower_bound", "upper_bound")


# ------------------------------------------------------------- joins
# Incremental load: the table holds everything up to 2024-01-20; the batch
# carries everything from 2024-01-15 on, so five days overlap.
INC_CTES = """
tgt AS (SELECT * FROM raw_aq WHERE datetime < TIMESTAMP '2024-01-20'),
stg AS (SELECT * FROM raw_aq WHERE datetime >= TIMESTAMP '2024-01-15')"""


def _inc_frames(spark, d):
    r = R(spark, d)
    tgt = r.where(F.col("datetime") < F.lit("2024-01-20").cast("timestamp_ntz"))
    stg = r.where(F.col("datetime") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return tgt, stg


INSERT_ABSENT_SQL = oracle("""
SELECT s.* FROM stg s WHERE NOT EXISTS (
  SELECT 1 FROM tgt t WHERE t.location_id = s.location_id AND t.sensors_id = s.sensors_id
    AND t.datetime = s.datetime AND t.parameter = s.parameter)""", INC_CTES)


@register("insert_if_absent", INSERT_ABSENT_SQL)
def q_insert_if_absent(spark, d):
    tgt, stg = _inc_frames(spark, d)
    return J.insert_if_absent(stg, tgt, time_col=None)  # against the whole fact


@register("insert_if_absent_narrowed", INSERT_ABSENT_SQL)
def q_insert_if_absent_narrowed(spark, d):
    tgt, stg = _inc_frames(spark, d)
    return J.insert_if_absent(stg, tgt, time_col="datetime")


@register("insert_count", oracle("""
SELECT COUNT(*) AS inserted FROM stg s WHERE NOT EXISTS (
  SELECT 1 FROM tgt t WHERE t.location_id = s.location_id AND t.sensors_id = s.sensors_id
    AND t.datetime = s.datetime AND t.parameter = s.parameter)""", INC_CTES))
def q_insert_count(spark, d):
    tgt, stg = _inc_frames(spark, d)
    return J.insert_if_absent(stg, tgt, time_col="datetime").agg(F.count(F.lit(1)).alias("inserted"))


@register("sensor_lookup", oracle("""
SELECT m.id, m.location_id, s.parameter, s.unit, m.value
FROM (SELECT *, CAST(location_id * 10000 + sensor_id * 100 +
             CASE parameter WHEN 'pm25' THEN 1 WHEN 'pm10' THEN 2 WHEN 'so2' THEN 3
                            WHEN 'no2' THEN 4 ELSE 5 END AS BIGINT) AS sensor_key FROM measurements) m
JOIN sensors s ON m.sensor_key = s.sensor_key"""))
def q_sensor_lookup(spark, d):
    m = M(spark, d).select("id", "location_id", "value",
                           AD.sensor_key("location_id", "sensor_id", "parameter").alias("sensor_key"))
    sens = AD.sensors(spark, d).drop("location_id")
    return J.lookup_sensors(m, sens, "sensor_key").select("id", "location_id", "parameter", "unit", "value")


@register("attach_location_name", oracle("""
SELECT m.id, m.location_id, COALESCE(NULLIF(l.name, ''), CAST(m.location_id AS VARCHAR)) AS location
FROM measurements m LEFT JOIN locations l ON m.location_id = l.location_id"""))
def q_attach_location_name(spark, d):
    m = M(spark, d).select("id", "location_id")
    return J.attach_location_name(m, LOC(spark, d)).select("id", "location_id", "location")


# Change set for the dimension: every location of region ASIA renamed (an
# update), and one new location per supplier (inserts), keyed past the
# customer key range.
CHG_CTES = """
chg AS (
  SELECT location_id, upper(name) AS name, city, country, latitude, longitude, timezone, is_active
  FROM locations WHERE country = 'ASIA'
  UNION ALL
  SELECT s.s_suppkey + 1000000 AS location_id, s.s_name AS name, n.n_name AS city, r.r_name AS country,
         CAST(s.s_suppkey % 90 AS DOUBLE) AS latitude, CAST(-(s.s_suppkey % 180) AS DOUBLE) AS longitude,
         'UTC' AS timezone, TRUE AS is_active
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def _change_set(spark, d):
    loc = LOC(spark, d)
    upd = loc.where(F.col("country") == "ASIA").withColumn("name", F.upper("name"))
    s = AD.table(spark, d, "supplier")
    n = AD.table(spark, d, "nation")
    r = AD.table(spark, d, "region")
    new = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
           .select((F.col("s_suppkey") + 1000000).alias("location_id"), F.col("s_name").alias("name"),
                   F.col("n_name").alias("city"), F.col("r_name").alias("country"),
                   (F.col("s_suppkey") % 90).cast("double").alias("latitude"),
                   (-(F.col("s_suppkey") % 180)).cast("double").alias("longitude"),
                   F.lit("UTC").alias("timezone"), F.lit(True).alias("is_active")))
    return loc, upd.unionByName(new)


@register("sync_classification", oracle("""
SELECT CASE WHEN l.location_id IS NULL THEN 'added' ELSE 'updated' END AS sync_status, COUNT(*) AS n
FROM chg c LEFT JOIN locations l ON c.location_id = l.location_id GROUP BY 1""", CHG_CTES))
def q_sync_classification(spark, d):
    loc, chg = _change_set(spark, d)
    return J.sync_counts(chg, loc)


@register("upsert_locations", oracle("""
SELECT * FROM locations l WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.location_id = l.location_id)
UNION ALL SELECT * FROM chg""", CHG_CTES))
def q_upsert(spark, d):
    loc, chg = _change_set(spark, d)
    return J.upsert(loc, chg, ["location_id"], stamp_col=None)


@register("insert_ignore_conflict", oracle("""
SELECT * FROM chg c WHERE NOT EXISTS (SELECT 1 FROM locations l WHERE c.location_id = l.location_id)""",
    CHG_CTES))
def q_insert_ignore(spark, d):
    loc, chg = _change_set(spark, d)
    return J.insert_ignore_conflict(chg, loc, ["location_id"])


@register("add_locations", oracle("""
SELECT * FROM locations UNION ALL
SELECT * FROM chg c WHERE NOT EXISTS (SELECT 1 FROM locations l WHERE c.location_id = l.location_id)""",
    CHG_CTES))
def q_add_locations(spark, d):
    loc, chg = _change_set(spark, d)
    new = chg.join(loc.select("location_id"), "location_id", "left_anti")
    return J.add_locations(loc, new)


@register("update_locations", oracle("""
SELECT l.location_id, COALESCE(c.name, l.name) AS name, l.city, l.country, l.latitude, l.longitude,
       l.timezone, l.is_active
FROM locations l LEFT JOIN (SELECT location_id, name FROM chg) c ON l.location_id = c.location_id""",
    CHG_CTES))
def q_update_locations(spark, d):
    loc, chg = _change_set(spark, d)
    return J.update_locations(loc, chg.select("location_id", "name"))


@register("attach_repeated_names", oracle("""
SELECT m.id, m.location_id, COALESCE(NULLIF(l.name, ''), CAST(m.location_id AS VARCHAR)) AS location
FROM measurements m LEFT JOIN locations l ON m.location_id = l.location_id"""))
def q_attach_repeated_names(spark, d):
    """O-J9 with metadata landed twice: a reading stays one row."""
    twice = LOC(spark, d).unionByName(LOC(spark, d))
    return J.attach_location_name(M(spark, d).select("id", "location_id"), twice).select("id", "location_id", "location")


@register("update_repeated_keys", oracle("""
SELECT l.location_id, COALESCE(c.name, l.name) AS name, l.city, l.country, l.latitude, l.longitude,
       l.timezone, l.is_active
FROM locations l LEFT JOIN (SELECT location_id, MAX(n) AS name FROM (
  SELECT location_id, name AS n FROM chg UNION ALL SELECT location_id, name || ' 2' FROM chg) x GROUP BY location_id) c
  ON l.location_id = c.location_id""", CHG_CTES))
def q_update_repeated_keys(spark, d):
    """O-M2 with every key changed twice: one row each, the larger change wins."""
    loc, chg = _change_set(spark, d)
    one = chg.select("location_id", "name")
    two = one.withColumn("name", F.concat("name", F.lit(" 2")))
    return J.update_locations(loc, one.unionByName(two))


@register("upsert_without_flag", oracle("""
SELECT * FROM locations l WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.location_id = l.location_id)
UNION ALL SELECT location_id, name, city, country, latitude, longitude, timezone, TRUE AS is_active FROM chg""", CHG_CTES))
def q_upsert_without_flag(spark, d):
    """O-J7: a batch without ``is_active`` stores active locations."""
    loc, chg = _change_set(spark, d)
    return J.upsert(loc, chg.drop("is_active"), ["location_id"], stamp_col=None)


@register("sync_errors", oracle("""
SELECT CASE WHEN c.location_id IS NULL THEN 'errors' WHEN l.location_id IS NULL THEN 'added' ELSE 'updated' END AS sync_status,
       COUNT(*) AS n
FROM (SELECT CASE WHEN country = 'EUROPE' THEN NULL ELSE location_id END AS location_id FROM chg) c
LEFT JOIN locations l ON c.location_id = l.location_id GROUP BY 1""", CHG_CTES))
def q_sync_errors(spark, d):
    """O-J5: records without a key are counted as errors."""
    loc, chg = _change_set(spark, d)
    broken = chg.withColumn("location_id", F.when(F.col("country") != "EUROPE", F.col("location_id")))
    return J.sync_counts(broken, loc)


@register("deactivate_locations", oracle("""
SELECT l.location_id, l.name, l.city, l.country, l.latitude, l.longitude, l.timezone,
       CASE WHEN l.country = 'EUROPE' THEN FALSE ELSE l.is_active END AS is_active
FROM locations l"""))
def q_deactivate(spark, d):
    loc = LOC(spark, d)
    ids = loc.where(F.col("country") == "EUROPE").select("location_id")
    return J.set_active(loc, ids, False)


# ------------------------------------------------------------- sorts / limits
@register("latest_page", oracle("""
SELECT location_id, location, latitude, longitude, parameter, unit, value, measurement_time,
       ROUND(quality_score, 6) AS quality_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, parameter ORDER BY measurement_time DESC, id DESC) AS rn
  FROM measurements WHERE quality_score > 0.5) t
WHERE rn = 1 AND parameter = 'pm10' ORDER BY measurement_time DESC, location_id, parameter LIMIT 100"""))
def q_latest_page(spark, d):
    latest = W.latest_measurements(M(spark, d))
    return rounded(L.latest_page(latest, parameter="pm10", limit=100), "quality_score")


@register("daily_page", oracle("""
SELECT * FROM (
  SELECT location_id, location, parameter, unit,
         CAST(CAST(measurement_time AS DATE) AS TIMESTAMP) AS measurement_date,
         ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
         ROUND(STDDEV_SAMP(value), 6) AS std_value, COUNT(*) AS measurement_count,
         ROUND(AVG(quality_score), 6) AS avg_quality
  FROM measurements WHERE quality_score > 0.5 AND parameter = 'pm25'
  GROUP BY location_id, location, parameter, unit, CAST(measurement_time AS DATE)) x
ORDER BY measurement_date DESC, location_id, parameter, unit, location LIMIT 1000"""))
def q_daily_page(spark, d):
    daily = dates_as_timestamps(A.daily_aggregates(M(spark, d)))
    out = L.daily_page(daily, parameter="pm25", limit=1000)
    return rounded(out, "avg_value", "std_value", "avg_quality")


@register("trend_series", oracle("""
SELECT id, measurement_time, value, parameter FROM measurements
WHERE quality_score > 0.5 AND parameter = 'pm25'
ORDER BY measurement_time DESC, id DESC LIMIT 1000"""))
def q_trend_series(spark, d):
    return L.trend_series(M(spark, d), parameter="pm25")


@register("export_slice", oracle(f"""
SELECT location_id, location, latitude, longitude, parameter, unit, value, measurement_time,
       ROUND(quality_score, 6) AS quality_score
FROM measurements WHERE quality_score > 0.5 AND measurement_time >= TIMESTAMP '2024-01-10'
ORDER BY measurement_time DESC, id DESC LIMIT {fixed.EXPORT_MAX_ROWS}"""))
def q_export_slice(spark, d):
    from aerolith.sources import sinks as K
    return rounded(K.export_slice(M(spark, d), date_from="2024-01-10"), "quality_score")


@register("ordered_locations", oracle("""
SELECT location_id, name, city, country, latitude, longitude, timezone, is_active FROM locations
WHERE is_active ORDER BY country NULLS LAST, city NULLS LAST, name NULLS LAST, location_id"""))
def q_ordered_locations(spark, d):
    return L.order_locations(P.locations_filter(LOC(spark, d)))


@register("first_locations", oracle("""
SELECT location_id, name FROM locations WHERE is_active ORDER BY location_id LIMIT 50"""))
def q_first_locations(spark, d):
    return L.first_locations(P.locations_filter(LOC(spark, d)), 50).select("location_id", "name")


@register("weekday_ordered", oracle("""
SELECT dayname(d) AS weekday, d, COUNT(*) AS n
FROM (SELECT CAST(CAST(datetime AS DATE) AS TIMESTAMP) AS d FROM raw_aq WHERE value >= 0) t
GROUP BY d ORDER BY isodow(d), d"""))
def q_weekday_ordered(spark, d):
    v = P.valid_readings(R(spark, d)).withColumn("d", X.to_day("datetime"))
    days = v.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return dates_as_timestamps(L.by_weekday(days, "d").select(X.weekday_name("d").alias("weekday"), "d", "n"))


@register("newest_first", oracle(f"SELECT {FACT_COLS} FROM measurements ORDER BY measurement_time DESC, id DESC"))
def q_newest_first(spark, d):
    return L.newest_first(M(spark, d)).drop("quality_score")


# ------------------------------------------------------------- sets
@register("location_options", oracle("""
SELECT DISTINCT location_id, location_name FROM (
  SELECT l.location_id, l.name AS location_name FROM locations l WHERE l.is_active) x"""))
def q_location_options(spark, d):
    return L.location_options(A.location_summary(LOC(spark, d), M(spark, d)))


@register("parameter_options", oracle("""
SELECT DISTINCT lower(parameter) AS value FROM raw_aq WHERE parameter IS NOT NULL"""))
def q_parameter_options(spark, d):
    return L.sorted_options(P.load_readings(R(spark, d), include_invalid=True), "parameter")


@register("location_options_fallback", oracle("""
SELECT DISTINCT name AS value FROM locations WHERE name IS NOT NULL
UNION ALL SELECT DISTINCT lower(parameter) AS value FROM raw_aq WHERE parameter IS NOT NULL AND value IS NOT NULL AND value >= 0"""))
def q_location_options_fallback(spark, d):
    """Both branches: no values (the fallback's are taken) and values (they are)."""
    r = P.load_readings(R(spark, d))
    without = L.sorted_options(P.empty_like(r), "location", LOC(spark, d), "name")
    present = L.sorted_options(r, "parameter", LOC(spark, d), "name")
    return without.unionByName(present)


@register("archive_union_live", oracle("""
SELECT location_id, sensors_id, location, datetime, lat, lon, parameter, units, value FROM raw_aq
WHERE datetime < TIMESTAMP '2024-01-20'
UNION ALL
SELECT location_id, sensor_id AS sensors_id, location, measurement_time AS datetime, latitude AS lat,
       longitude AS lon, parameter, unit AS units, value FROM measurements
WHERE measurement_time >= TIMESTAMP '2024-01-20'"""))
def q_archive_union_live(spark, d):
    arch = R(spark, d).where(F.col("datetime") < F.lit("2024-01-20").cast("timestamp_ntz"))
    live = (M(spark, d).where(F.col("measurement_time") >= F.lit("2024-01-20").cast("timestamp_ntz"))
            .select("location_id", F.col("sensor_id").alias("sensors_id"), "location",
                    F.col("measurement_time").alias("datetime"), F.col("latitude").alias("lat"),
                    F.col("longitude").alias("lon"), "parameter", F.col("unit").alias("units"), "value"))
    return L.union_sources(arch.select(*live.columns), live)


@register("ensure_parameter_columns", oracle("""
SELECT location_id, """ + ", ".join(
    f"MAX(CASE WHEN parameter = '{p}' THEN value END) AS {p}" if p in ("pm25", "pm10", "so2", "no2", "humidity")
    else f"CAST(NULL AS DOUBLE) AS {p}" for p in fixed.POLLUTANT_ORDER) + """
FROM measurements GROUP BY location_id"""))
def q_ensure_parameter_columns(spark, d):
    wide = M(spark, d).groupBy("location_id").pivot("parameter", ["pm25", "pm10", "so2", "no2", "humidity"]).agg(F.max("value"))
    return P.ensure_parameter_columns(wide)
