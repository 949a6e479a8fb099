"""Latest-per-key family (O-W1 .. O-W6, O-A1, O-A20, O-A28, O-C9 parts).

Three physical shapes, all skew-safe:

* arg-max in two steps (``latest_by_key``): the newest time of each key by a hash aggregation
  of fixed-width columns, then the rows that have it by a broadcast join whose side was
  counted before. No task sorts its input; ties are settled among the few rows left;
* ``max_by(x, order)`` in a hash aggregation where ``x`` and the order have a fixed width:
  ``order_key`` packs a time and an integer into one decimal;
* ``row_number() <= n`` over a window, which Catalyst turns into a
  ``WindowGroupLimit`` applied before the shuffle as well as after it.

Every "latest" takes an explicit tie-break (T7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import predicates as P
from aerolith.session import SMALL_ROWS, written_once


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def order_key(df: DataFrame, order: list[str]) -> Column:
    """One column that orders like ``order``, null where the first of them is. Of a fixed width, so that
    an aggregation by it can hash, for a time, or a time and an integer (nulls of which come first);
    a struct, which makes Spark sort, for other columns."""
    kinds = dict(df.dtypes)
    first = F.col(order[0])
    if len(order) == 1:
        return first
    if len(order) == 2 and kinds[order[0]] in ("timestamp", "timestamp_ntz") and kinds[order[1]] in _INTEGERS:
        # 64 bits each; a null integer counts as one below the least
        micros = F.unix_micros(first.cast("timestamp")).cast("decimal(19,0)")
        low = F.coalesce(F.col(order[1]).cast("decimal(19,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(19,0)"))
        return micros * F.lit(str(1 << 65)).cast("decimal(20,0)") + low
    return F.when(first.isNotNull(), F.struct(*_cols(order)))


def newest_rows(df: DataFrame, keys: list[str], time_col: str, newest: DataFrame) -> DataFrame:
    """The rows of ``df`` at the newest time of their key, ties included. ``newest`` (keys, _newest) is small."""
    held = newest.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], "_newest")
    same = df[time_col] == held["_newest"]
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(held[f"_k_{i}"])
    return df.join(F.broadcast(held), same).select(*df.columns)


def newest_times(df: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """(keys, _newest): the newest time of each key that has one."""
    return df.where(F.col(time_col).isNotNull()).groupBy(*keys).agg(F.max(time_col).alias("_newest"))


def latest_by_key(df: DataFrame, keys: list[str], time_col: str, tie: list[str],
                  cols: list[str] | None = None, most: int = SMALL_ROWS) -> DataFrame:
    """Generic latest row per ``keys`` by (``time_col``, *``tie``) descending.

    Rows whose time is null never win. Output: keys + ``cols``. The newest times are written once and
    counted: up to ``most`` keys, only rows at those times are aggregated whole. Beyond that, and for
    streams, one aggregation carries the rows, for which Spark sorts each task's input by key.
    """
    cols = cols or [c for c in df.columns if c not in keys]
    df = df.select(*dict.fromkeys([*keys, *cols, time_col, *tie]))
    if not df.isStreaming:
        newest = written_once(newest_times(df, keys, time_col), "newest")
        if newest.count() <= most:
            df = written_once(newest_rows(df, keys, time_col, newest), "newest-rows")
    payload = F.struct(*[F.col(c) for c in cols])
    order = F.when(F.col(time_col).isNotNull(), F.struct(*_cols([time_col] + tie)))
    return (df.groupBy(*keys).agg(F.max_by(payload, order).alias("_r"))
            .where(F.col("_r").isNotNull())
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def ranked_latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order) <= n`` - planned
    as ``WindowGroupLimit`` (partial top-n before the exchange)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- gen 1 SQL views
def latest_ranked_sql(raw: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """O-W1 latest row per (location_id, parameter) among valid readings of
    the listed parameters; tie-break value, lat, lon, location descending."""
    params = parameters or fixed.LATEST_PIVOT_PARAMETERS
    v = P.parameter_in(P.valid_readings(raw), params)
    v = v.select("location_id", "location", "lat", "lon", "parameter", "value", "datetime")
    order = [F.col("datetime").desc(), F.col("value").desc(), F.col("lat").desc_nulls_last(),
             F.col("lon").desc_nulls_last(), F.col("location").desc_nulls_last()]
    return ranked_latest(v, ["location_id", "parameter"], order, 1)


def latest_pivot_sql(raw: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """O-A1 view ``latest_param_values_per_location``: one row per
    (location_id, location) with max lat/lon/datetime and one column per
    parameter by conditional aggregation."""
    params = parameters or fixed.LATEST_PIVOT_PARAMETERS
    latest = latest_ranked_sql(raw, params)
    return latest.groupBy("location_id", "location").agg(
        F.max("lat").alias("lat"), F.max("lon").alias("lon"),
        F.max("datetime").alias("datetime"),
        *[F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in params])


# ---------------------------------------------------------------- gen 2 view
LATEST_MEASUREMENT_COLUMNS = ["location", "latitude", "longitude", "unit", "value",
                              "measurement_time", "quality_score"]


def latest_measurements(m: DataFrame, trusted_only: bool = True) -> DataFrame:
    """O-W2 view ``latest_measurements``: latest trusted row per
    (location_id, parameter), tie-break id (``DISTINCT ON`` equivalent)."""
    src = P.trusted(m) if trusted_only else m
    out = latest_by_key(src, ["location_id", "parameter"], "measurement_time", ["id"],
                        LATEST_MEASUREMENT_COLUMNS)
    return out.select("location_id", "location", "latitude", "longitude", "parameter", "unit",
                      "value", "measurement_time", "quality_score")


# ---------------------------------------------------------------- gen 1 pandas path
def latest_rows_pandas(raw: DataFrame) -> DataFrame:
    """O-W5 sort by datetime, ``groupby(location_id, location, parameter)
    .tail(1)``: full latest row per gen 1 key (null keys dropped, T8)."""
    keys = ["location_id", "location", "parameter"]
    v = P.load_readings(raw).dropna(subset=keys)
    tie = [c for c in ("sensors_id", "value", "lat", "lon") if c in v.columns]
    return latest_by_key(v, keys, "datetime", tie)


def latest_wide(raw: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """O-W3 gen 1 dashboard: one wide row per (location_id, location) with
    last lat/lon, newest datetime, the latest value of every parameter of the
    fixed order, the AQI estimate, category and colour.

    One aggregation over the per-key latest rows replaces the reference's
    aggregate + pivot + left merge (O-J4); parameters outside the fixed list
    do not become columns (bounded schema).
    """
    params = parameters or fixed.POLLUTANT_ORDER
    lr = latest_rows_pandas(raw)
    ordk = ("datetime", "parameter")  # over a row per series, no longer over the fact
    wide = lr.groupBy("location_id", "location").agg(
        F.max_by(F.col("lat"), F.when(F.col("lat").isNotNull(), F.struct(*ordk))).alias("lat"),
        F.max_by(F.col("lon"), F.when(F.col("lon").isNotNull(), F.struct(*ordk))).alias("lon"),
        F.max("datetime").alias("datetime"),
        *[F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in params])
    return with_aqi(wide)


def latest_map(raw: DataFrame) -> DataFrame:
    """O-W3 with every parameter: one row per (location_id, location) with the newest
    datetime and a map parameter -> latest value. The schema stays bounded whatever
    parameters are measured; ``latest_wide`` has columns for the listed ones."""
    entries = F.array_sort(F.collect_list(F.struct("parameter", "value")))  # a row per parameter of the location
    return (latest_rows_pandas(raw).groupBy("location_id", "location")
            .agg(F.max("datetime").alias("datetime"), F.map_from_entries(entries).alias("latest")))


def with_aqi(wide: DataFrame, contiguous: bool = False) -> DataFrame:
    """O-F9..O-F11 on a wide row (missing particulate columns read as null)."""
    pm25 = F.col("pm25") if "pm25" in wide.columns else F.lit(None).cast("double")
    pm10 = F.col("pm10") if "pm10" in wide.columns else F.lit(None).cast("double")
    out = wide.withColumn("aqi", X.aqi_estimate(pm25, pm10))
    return (out.withColumn("aqi_category", X.aqi_category("aqi", contiguous))
               .withColumn("aqi_color", X.aqi_color("aqi", contiguous)))


def last_value_pivot(df: DataFrame, index: list[str], parameters: list[str],
                     time_col: str = "datetime", tie: list[str] | None = None,
                     value: str = "value") -> DataFrame:
    """O-A20 ``pivot_table(aggfunc='last')``: last non-null value per
    parameter column, one aggregation with a bounded pivot list."""
    order = F.when(F.col(value).isNotNull(), order_key(df, [time_col] + (tie or [])))
    rows = df.where(F.col("parameter").isNotNull()).withColumn("_order", order)
    return rows.groupBy(*index).agg(*[
        F.max_by(value, F.when(F.col("parameter") == p, F.col("_order"))).alias(p) for p in parameters])


def most_recent_row(wide: DataFrame, time_col: str = "datetime",
                    tie: str = "location_id") -> DataFrame:
    """O-A28 the single newest wide row with its AQI values (top-1)."""
    return wide.orderBy(F.col(time_col).desc_nulls_last(), F.col(tie).desc()).limit(1)


def duplicated_rows(df: DataFrame, keys: list[str], first_by: str = "id") -> DataFrame:
    """O-W4 every row of a duplicated key except the first (by ``first_by``,
    which must be unique). Skew-safe: the first id per key is a partial
    aggregate, joined back on the key (AQE splits a hot key's partition)."""
    firsts = (df.groupBy(*keys).agg(F.min(first_by).alias("_first"),
                                    F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1)
              .select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    joined = df.join(firsts, cond, "inner")
    return joined.where(F.col(first_by) != F.col("_first")).select(*df.columns)


def newest_n_per_location(m: DataFrame, n: int = fixed.PAYLOAD_LATEST_LIMIT,
                          time_col: str = "measurement_time", tie: str = "id") -> DataFrame:
    """O-W6 at most ``n`` newest rows per location."""
    return ranked_latest(m, ["location_id"], [F.col(time_col).desc(), F.col(tie).desc()], n)
