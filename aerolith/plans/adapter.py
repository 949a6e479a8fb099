"""Fixture adapter: measurement facts and location dimension out of the
driver tables (``events``, ``customer``, ``nation``, ``region``).

The Spark side is built with the DataFrame API and the library's own
operators (the quality score is the Column version of O-F8); the oracle side
is the portable SQL text below, run by DuckDB. Both read the whole tables.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import scalars as X
from aerolith.operators import predicates as P

DUP_OFFSET = 1_000_000_000

# Built relations of each session, dropped with it. DataFrames are immutable
# and lazy, so reusing one is reusing a view definition: no data is cached,
# only the file listing and the analysed plan.
_MEMO: WeakKeyDictionary[SparkSession, dict[tuple, DataFrame]] = WeakKeyDictionary()


def _memo(fn):
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        own = _MEMO.setdefault(spark, {})
        key = (sf_dir.rstrip("/"), fn.__name__, args)
        if key not in own:
            own[key] = fn(spark, sf_dir, *args)
        return own[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@_memo
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str, with_copies: bool) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    et = F.col("event_type")
    parameter = (F.when(et == "click", "pm25").when(et == "view", "pm10")
                 .when(et == "purchase", "so2").when(et == "error", "no2")
                 .otherwise("humidity"))
    v = X.nan_to_null("value")
    value = (F.when(F.col("event_id") % 97 == 0, -v)
             .when(F.col("event_id") % 89 == 0, F.lit(None).cast("double"))
             .otherwise(v))
    ident = F.col("event_id")
    if with_copies:
        # exact copies of every 101st event: emitted by the same scan (explode),
        # not by a second scan and join
        n = F.when(F.col("event_id") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        e = e.select("*", F.explode(n).alias("_copy"))
        ident = F.col("event_id") + F.col("_copy") * F.lit(DUP_OFFSET)
    return (e.join(c, e.user_id == c.c_custkey)
            .select(ident.alias("id"),
                    F.col("user_id").alias("location_id"),
                    (F.col("event_id") % 3).alias("sensor_id"),
                    F.col("c_name").alias("location"),
                    (F.col("user_id") % 90).cast("double").alias("latitude"),
                    (-(F.col("user_id") % 180)).cast("double").alias("longitude"),
                    parameter.alias("parameter"),
                    F.when(et == "signup", "pct").otherwise("ug/m3").alias("unit"),
                    value.alias("value"),
                    F.col("ts").alias("measurement_time")))


@_memo
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``base`` relation: one row per event with a customer."""
    return _base(spark, sf_dir, with_copies=False)


@_memo
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All landed rows (``base`` plus exact copies of every 101st event)
    with their quality score; bad rows kept."""
    m0 = _base(spark, sf_dir, with_copies=True)
    return m0.withColumn("quality_score", X.quality_score("parameter", "value"))


@_memo
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean gen 2 fact: O-P6 keep rule over ``scored``."""
    return P.keep_valid_scored(scored(spark, sf_dir))


@_memo
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .select(F.col("c_custkey").alias("location_id"),
                    F.col("c_name").alias("name"),
                    F.col("n_name").alias("city"),
                    F.col("r_name").alias("country"),
                    (F.col("c_custkey") % 90).cast("double").alias("latitude"),
                    (-(F.col("c_custkey") % 180)).cast("double").alias("longitude"),
                    F.lit("UTC").alias("timezone"),
                    (F.col("c_custkey") % 10 != 0).alias("is_active")))


@_memo
def raw_air_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gen 1 fact shape (raw.air_quality) over ``scored``; keeps bad rows."""
    s = scored(spark, sf_dir)
    return s.select(
        "location_id", F.col("sensor_id").alias("sensors_id"), "location",
        F.col("measurement_time").alias("datetime"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        "parameter", F.col("unit").alias("units"), "value",
        F.col("location_id").alias("locationid"),
        X.month_text("measurement_time").alias("month"),
        X.year_number("measurement_time").alias("year"))


def sensor_key(location_id, sensor_id, parameter):
    """Combined sensor key: one sensor per (location, sensor slot, parameter)."""
    p = F.col(parameter) if isinstance(parameter, str) else parameter
    code = (F.when(p == "pm25", 1).when(p == "pm10", 2).when(p == "so2", 3)
            .when(p == "no2", 4).otherwise(5))
    return (F.col(location_id) * 10000 + F.col(sensor_id) * 100 + code).cast("long")


@_memo
def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor metadata frame: one row per combined key."""
    s = scored(spark, sf_dir)
    return (s.select(sensor_key("location_id", "sensor_id", "parameter").alias("sensor_key"),
                     "location_id", "parameter", "unit")
            .distinct())


# ----------------------------------------------------------------------------
# Oracle side: the same relations as portable SQL for DuckDB.
ORACLE_CTES = """
base AS (
  SELECT e.event_id AS id, e.user_id AS location_id, e.event_id % 3 AS sensor_id, c.c_name AS location,
         CAST(e.user_id % 90 AS DOUBLE) AS latitude, CAST(-(e.user_id % 180) AS DOUBLE) AS longitude,
         CASE e.event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'purchase' THEN 'so2'
                           WHEN 'error' THEN 'no2' ELSE 'humidity' END AS parameter,
         CASE WHEN e.event_type = 'signup' THEN 'pct' ELSE 'ug/m3' END AS unit,
         CASE WHEN e.event_id % 97 = 0 THEN -e.value WHEN e.event_id % 89 = 0 THEN NULL ELSE e.value END AS value,
         e.ts AS measurement_time
  FROM events e JOIN customer c ON e.user_id = c.c_custkey
),
m0 AS (
  SELECT * FROM base
  UNION ALL
  SELECT id + 1000000000 AS id, location_id, sensor_id, location, latitude, longitude, parameter, unit, value, measurement_time
  FROM base WHERE id % 101 = 0
),
limits AS (
  SELECT * FROM (VALUES ('pm25', CAST(500 AS DOUBLE)), ('pm10', CAST(600 AS DOUBLE)), ('no2', CAST(200 AS DOUBLE)),
                        ('so2', CAST(1000 AS DOUBLE)), ('o3', CAST(400 AS DOUBLE)), ('co', CAST(50 AS DOUBLE))) AS t(p, hi)
),
scored AS (
  SELECT m0.*, CASE WHEN hi IS NULL THEN CAST(0.5 AS DOUBLE)
                    WHEN value < 0 OR value > hi THEN CAST(0 AS DOUBLE)
                    ELSE CAST(1 AS DOUBLE) - value / hi END AS quality_score
  FROM m0 LEFT JOIN limits ON m0.parameter = limits.p
),
measurements AS (
  SELECT * FROM scored WHERE value IS NOT NULL AND value >= 0 AND quality_score > 0
),
locations AS (
  SELECT c.c_custkey AS location_id, c.c_name AS name, n.n_name AS city, r.r_name AS country,
         CAST(c.c_custkey % 90 AS DOUBLE) AS latitude, CAST(-(c.c_custkey % 180) AS DOUBLE) AS longitude,
         'UTC' AS timezone, c.c_custkey % 10 <> 0 AS is_active
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
raw_aq AS (
  SELECT location_id, sensor_id AS sensors_id, location, measurement_time AS datetime,
         latitude AS lat, longitude AS lon, parameter, unit AS units, value,
         location_id AS locationid, strftime(measurement_time, '%m') AS month,
         CAST(year(measurement_time) AS BIGINT) AS year
  FROM scored
),
sensors AS (
  SELECT DISTINCT CAST(location_id * 10000 + sensor_id * 100 +
                       CASE parameter WHEN 'pm25' THEN 1 WHEN 'pm10' THEN 2 WHEN 'so2' THEN 3
                                      WHEN 'no2' THEN 4 ELSE 5 END AS BIGINT) AS sensor_key,
         location_id, parameter, unit
  FROM scored
)"""


def oracle(body: str, extra_ctes: str = "") -> str:
    """Full oracle statement: adapter CTEs, optional extra CTEs, then ``body``."""
    ctes = ORACLE_CTES + (",\n" + extra_ctes.strip().rstrip(",") if extra_ctes.strip() else "")
    return "WITH" + ctes + "\n" + body.strip()
