"""Aggregations (O-A1 .. O-A29 except the quality profile family).

Every aggregate here is a ``groupBy().agg()`` with partial (map-side)
aggregation, so a hot key holding a third of the rows is combined inside each
map task before the shuffle. Global bounds are 1-row aggregates used as
scalar subqueries or small joins that AQE converts to broadcasts only after
measuring them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.operators import quantiles as QN
from aerolith.session import written_once


def first_non_null(x: str, *order: str) -> Column:
    """pandas ``first`` (T9): value of the earliest row where ``x`` is not null."""
    return F.min_by(F.col(x), F.when(F.col(x).isNotNull(), F.struct(*[F.col(o) for o in order])))


def last_non_null(x: str, *order: str) -> Column:
    """pandas ``last`` (T9): value of the latest row where ``x`` is not null."""
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.struct(*[F.col(o) for o in order])))


def first_hashed(df: DataFrame, x: str, *order: str) -> Column:
    """``first_non_null`` of a column of ``df`` by an order of a fixed width where there is one, so that
    numbers are aggregated by hash; ``coded`` makes a text a number."""
    return F.min_by(F.col(x), F.when(F.col(x).isNotNull(), W.order_key(df, list(order))))


#: Different texts up to which a column is aggregated by their numbers.
MAX_CODES = 1_000


def coded(df: DataFrame, x: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(``df`` with the texts of ``x`` as numbers, what turns a number into its text again). The vocabulary is
    read by a pass over that column alone; if it is no small one, the texts stay."""
    seen = df.where(F.col(x).isNotNull()).select(x).distinct().limit(MAX_CODES + 1).collect()
    if len(seen) > MAX_CODES:
        return df, lambda c: c
    texts = F.array(*[F.lit(t) for t in sorted(r[0] for r in seen)]).cast("array<string>")
    number = F.when(F.col(x).isNotNull(), F.array_position(texts, F.col(x)).cast("int"))
    return df.withColumn(x, number), lambda c: F.when(c.isNotNull(), F.try_element_at(texts, c))


# --------------------------------------------------------------------- gen 1 daily
def daily_stats_sql(raw: DataFrame) -> DataFrame:
    """O-A2 gen 1 view ``daily_air_quality_stats``: group by ten keys incl.
    lat/lon (a location that moved within a day splits the group, T18)."""
    v = P.valid_readings(raw)
    keyed = v.select("location_id", "location", X.to_day("datetime").alias("measurement_date"),
                     "lat", "lon", "parameter", "units", "value")
    # Weekday columns are functions of the date: group by the date, derive after.
    g = keyed.groupBy("location_id", "location", "measurement_date", "lat", "lon",
                      "parameter", "units").agg(F.avg("value").alias("average_value"))
    d = F.col("measurement_date")
    return g.select("location_id", "location", "measurement_date",
                    X.weekday_number_sql(d).alias("weekday_number"),
                    X.weekday_name(d).alias("weekday"),
                    X.weekend_flag(d).alias("is_weekend"),
                    "lat", "lon", "parameter", "units", "average_value")


def daily_stats_pandas(raw: DataFrame) -> DataFrame:
    """O-A3 gen 1 dashboard daily stats: eight keys, max lat/lon, mean.
    Null keys are dropped like pandas ``groupby`` (T8); the date is a midnight
    timestamp like ``dt.normalize()``."""
    keys = ["location_id", "location", "parameter", "units"]
    v = P.load_readings(raw).dropna(subset=keys + ["datetime"])
    g = (v.withColumn("measurement_date", X.to_midnight("datetime"))
          .groupBy("location_id", "location", "measurement_date", "parameter", "units")
          .agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"),
               F.avg("value").alias("average_value")))
    d = F.col("measurement_date")
    return g.select("location_id", "location", "measurement_date",
                    X.weekday_number_monday0(d).alias("weekday_number"),
                    X.weekday_name(d).alias("weekday"),
                    X.weekend_flag(d).alias("is_weekend"),
                    "parameter", "units", "lat", "lon", "average_value")


# --------------------------------------------------------------------- gen 2 daily
def daily_aggregates(m: DataFrame, trusted_only: bool = True) -> DataFrame:
    """O-A4 view ``daily_aggregates`` over trusted readings (score > 0.5)."""
    src = P.trusted(m) if trusted_only else m
    return (src.withColumn("measurement_date", X.to_day("measurement_time"))
            .groupBy("location_id", "location", "parameter", "unit", "measurement_date")
            .agg(F.avg("value").alias("avg_value"),
                 F.min("value").alias("min_value"),
                 F.max("value").alias("max_value"),
                 F.stddev_samp("value").alias("std_value"),
                 F.count(F.lit(1)).alias("measurement_count"),
                 F.avg("quality_score").alias("avg_quality")))


# --------------------------------------------------------------------- location summaries
def _per_location(m: DataFrame) -> DataFrame:
    """Aggregate-before-join: one row per location from the fact, with the
    distinct parameter count computed as a two-level aggregate."""
    per_param = (m.groupBy("location_id", "parameter")
                  .agg(F.count("id").alias("n_id"), F.max("measurement_time").alias("t_max"),
                       F.min("measurement_time").alias("t_min"),
                       F.sum("quality_score").alias("q_sum"),
                       F.count("quality_score").alias("q_n")))
    return (per_param.groupBy("location_id")
            .agg(F.count("parameter").alias("parameter_count"),
                 F.sum("n_id").alias("total_measurements"),
                 F.max("t_max").alias("last_measurement_time"),
                 F.min("t_min").alias("first_measurement_time"),
                 (F.sum("q_sum") / F.sum("q_n")).alias("avg_quality_score")))


def location_summary(locations: DataFrame, m: DataFrame) -> DataFrame:
    """O-A5 / O-J2 view ``location_summary``: active locations left-joined to
    their measurements (zero-measurement locations kept: count 0, rest null)."""
    agg = _per_location(m).select("location_id", "parameter_count",
                                  "last_measurement_time", "avg_quality_score")
    l = P.locations_filter(locations, active_only=True).select(
        "location_id", F.col("name").alias("location_name"), "city", "country",
        "latitude", "longitude")
    return (l.join(agg, "location_id", "left")
            .withColumn("parameter_count", F.coalesce("parameter_count", F.lit(0)).cast("long")))


def location_statistics(locations: DataFrame, m: DataFrame, location_id: int | None = None) -> DataFrame:
    """O-A6 statistics per location (or for one): distinct parameters,
    ``count(m.id)`` (0 on no match), first/last time, average quality."""
    l = locations if location_id is None else P.by_location_id(locations, location_id)
    mm = m if location_id is None else P.by_location_id(m, location_id)
    agg = _per_location(mm)
    return (l.select("location_id", "name", "city", "country")
            .join(agg, "location_id", "left")
            .select("location_id", "name", "city", "country",
                    F.coalesce("parameter_count", F.lit(0)).cast("long").alias("parameter_count"),
                    F.coalesce("total_measurements", F.lit(0)).cast("long").alias("total_measurements"),
                    "last_measurement_time", "avg_quality_score", "first_measurement_time"))


def location_groups(locations: DataFrame, m: DataFrame) -> DataFrame:
    """O-A7 groups by country, city over active locations: number of locations,
    distinct parameters measured there (from the base join, defect fixed)."""
    l = P.locations_filter(locations, active_only=True).select("location_id", "country", "city")
    lp = m.select("location_id", "parameter").distinct()
    joined = l.join(lp, "location_id", "left")
    return (joined.groupBy("country", "city")
            .agg(F.countDistinct("location_id").alias("location_count"),
                 F.countDistinct("parameter").alias("parameter_count")))


def system_summary(locations: DataFrame, m: DataFrame) -> DataFrame:
    """O-A8 active locations, measurements, distinct parameters, latest time:
    one global aggregate on the fact with the dimension's count as a scalar
    subquery."""
    active = locations.agg(F.count(F.when(F.col("is_active") == F.lit(True), F.lit(1)))).scalar()
    return m.agg(F.count(F.lit(1)).alias("total_measurements"),
                 F.countDistinct("parameter").alias("total_parameters"),
                 F.max("measurement_time").alias("latest_measurement")) \
        .select(active.alias("total_locations"), "total_measurements", "total_parameters",
                "latest_measurement")


def trusted_summary(m: DataFrame, approximate: bool = False) -> DataFrame:
    """O-A9 distinct locations, distinct parameters, rows, latest (trusted).
    The fact is first reduced to a row per (location, parameter), so the exact
    distinct counts run over that small frame; ``approximate`` uses HLL++."""
    per = (P.trusted(m).groupBy("location_id", "parameter")
           .agg(F.count(F.lit(1)).alias("n"), F.max("measurement_time").alias("t")))
    cd = F.approx_count_distinct if approximate else F.countDistinct
    return per.agg(cd("location_id").alias("location_count"), cd("parameter").alias("parameter_count"),
                   F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_measurements"),
                   F.max("t").alias("latest_measurement"))


def quality_by_parameter(m: DataFrame) -> DataFrame:
    """O-A10 count and average score per parameter (all stored rows)."""
    return m.groupBy("parameter").agg(F.count(F.lit(1)).alias("count"),
                                      F.avg("quality_score").alias("avg_quality"))


def quality_overview(m: DataFrame) -> DataFrame:
    """O-A11 unweighted mean of per-parameter means (T20), total rows and the
    number of parameters: a second-level aggregate over O-A10."""
    q = quality_by_parameter(m)
    return q.agg(F.avg("avg_quality").alias("avg_quality"),
                 F.sum("count").cast("long").alias("total_records"),
                 F.count(F.lit(1)).alias("parameters"))


def hourly(m: DataFrame) -> DataFrame:
    """O-A12 hourly mean/min/max/std/count(value)/mean score and the first
    non-null latitude, longitude, unit in time order (tie on id)."""
    h, text = coded(m.withColumn("hour", X.floor_hour("measurement_time")), "unit")
    first = lambda x: first_hashed(h, x, "measurement_time", "id").alias(x)
    return (h.groupBy("location_id", "parameter", "hour")
            .agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
                 F.max("value").alias("max_value"), F.stddev_samp("value").alias("std_value"),
                 F.count("value").alias("count"), F.avg("quality_score").alias("avg_quality"),
                 first("latitude"), first("longitude"), first("unit"))
            .withColumn("unit", text(F.col("unit"))))


def counts_by_parameter(clean: DataFrame) -> DataFrame:
    """O-A14 valid records per parameter (sorted by parameter by the caller)."""
    return clean.groupBy("parameter").agg(F.count(F.lit(1)).alias("count"))


def top_locations_by_count(clean: DataFrame, n: int = fixed.TOP_LOCATIONS,
                           col: str = "location") -> DataFrame:
    """O-A14 / O-L5 top ``n`` locations by valid records, ties by name.
    Null keys are dropped like ``value_counts`` (T8)."""
    return (clean.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()).limit(n))


def overview(raw: DataFrame) -> DataFrame:
    """O-A15 gen 1 overview: rows, distinct locations and parameters, date
    bounds, latest reading and ingestion, and the labels of the parameter
    codes in code order. The code set is bounded by the parameter vocabulary."""
    v = P.load_readings(raw)
    has_ingestion = "ingestion_datetime" in v.columns
    # a row per (location, parameter) first: the distinct counts run over that small frame
    v = v.groupBy("location", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        *[F.max("ingestion_datetime").alias("ingested")] * has_ingestion)
    # codes sorted first, then shown by label (the order a reader sees)
    labels = F.array_join(F.transform(F.array_sort(F.collect_set("parameter")), X.parameter_label), ", ")
    cols = [F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_records"),
            F.countDistinct("location").alias("location_count"),
            F.countDistinct("parameter").alias("parameter_count"),
            X.to_midnight(F.min("first")).alias("min_date"),
            X.to_midnight(F.max("last")).alias("max_date"),
            F.max("last").alias("latest_reading"),
            labels.alias("parameter_labels")]
    if has_ingestion:
        cols.insert(6, F.max("ingested").alias("latest_ingestion"))
    return v.agg(*cols)


def non_null_counts(df: DataFrame, by: str = "parameter") -> DataFrame:
    """O-A18 non-null count of every column per group (null key dropped, T8)."""
    others = [c for c in df.columns if c != by]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        *[F.count(F.col(f"`{c}`")).alias(c) for c in others])


_MOMENTS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def numeric_profile(df: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """O-A19 ``describe()``: count, mean, std, min, 25/50/75 %, max per column
    in long form (one row per column; none for an empty table). Every column is
    profiled in the same two passes, and no row is multiplied by its columns.
    Quartiles are interpolated like pandas; ``method`` picks the quantile
    strategy (see ``quantiles``)."""
    probs, names = [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    rows = df.select(F.lit(0).alias(QN.ALL), *cols)
    if method == "exact":
        s = QN.select(rows, cols, [QN.ALL], probs, _MOMENTS)
        table = s.stats
        quartile = F.map_from_entries(F.collect_list(F.struct(F.col("_j") * len(probs) + F.col("_i"), "_q")))  # three a column
        table = table.withColumn("_quartiles", s.quantiles.select(quartile).scalar())  # one small row
        at = lambda j, i: F.try_element_at("_quartiles", F.lit(j * len(probs) + i))
    else:
        x = rows.select(QN.ALL, *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(cols)])
        table = x.groupBy(QN.ALL).agg(*[a for j in range(len(cols)) for a in (
            F.count(f"_v{j}").alias(f"_n{j}"), QN.quantile_aggregate(F.col(f"_v{j}"), probs, method).alias(f"_q{j}"),
            *[f(f"_v{j}").alias(f"{name}{j}") for name, f in _MOMENTS.items()])])
        at = lambda j, i: F.col(f"_q{j}")[i]
    entry = lambda j, c: F.struct(
        F.lit(c).alias("column"), F.col(f"_n{j}").alias("count"), *[F.col(f"{n}{j}").alias(n) for n in ("mean", "std", "min")],
        *[at(j, i).alias(n) for i, n in enumerate(names)], F.col(f"max{j}").alias("max"))
    return table.select(F.explode(F.array(*[entry(j, c) for j, c in enumerate(cols)])).alias("_e")).select("_e.*")


def mean_matrix(df: DataFrame, x: str, y: str, z: str, x_values: list | None = None) -> DataFrame:
    """O-A21 ``y`` rows by ``x`` columns of mean ``z``. Give ``x_values`` for a
    bounded, single-pass pivot; without them Spark first finds the values."""
    g = df.groupBy(y)
    g = g.pivot(x, x_values) if x_values is not None else g.pivot(x)
    return g.agg(F.avg(z))


def mean_matrix_long(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """O-A21 long form (no bound on the number of ``x`` values)."""
    return df.groupBy(y, x).agg(F.avg(z).alias(f"avg_{z}"))


def map_center(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """O-A24 mean latitude and longitude."""
    return df.agg(F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))


def _box(df: DataFrame, keys: list[str], value: str, method: str) -> DataFrame:
    """min, quartiles, max, count per group; quartiles by ``method``."""
    if method == "exact":  # smallest, largest and number come with the sketches of the first pass
        s = QN.select(df, [value], keys, [0.25, 0.5, 0.75], {"min": F.min, "max": F.max})
        quartiles = s.quantiles.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n)
                                                     for i, n in enumerate(("q1", "median", "q3"))])
        basic = s.stats.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("min0").alias("min"), F.col("max0").alias("max"),
                               F.col("_n0").alias("count"))
        same = reduce(and_, [F.col(f"_k_{c}").eqNullSafe(quartiles[c]) for c in keys])
        return (basic.join(quartiles, same, "left").drop(*[quartiles[c] for c in keys])
                .select(*[F.col(f"_k_{c}").alias(c) for c in keys], "min", "max", "count", "q1", "median", "q3"))
    basic = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"),
                                  F.count(value).alias("count"))
    qs = QN.quantile_columns(df, value, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"], method)
    return basic.join(qs, keys, "left")


def weekday_distribution(daily: DataFrame, value: str = "average_value",
                         date_col: str = "measurement_date", method: str = "exact") -> DataFrame:
    """O-A25 box summary per weekday (min, quartiles, max, count), ordered
    Monday first (O-L8)."""
    d = daily.select(X.weekday_number_monday0(date_col).alias("weekday_number"), X.weekday_name(date_col).alias("weekday"),
                     F.col(value).cast("double").alias(value))
    d = written_once(d, "weekdays")  # daily statistics are an aggregate of the fact: read by both passes, made once
    box = _box(d, ["weekday_number", "weekday"], value, method)
    return box.select("weekday_number", "weekday", "min", "q1", "median", "q3", "max", "count") \
              .orderBy("weekday_number")


def parameter_distribution(m: DataFrame, value: str = "value", method: str = "exact") -> DataFrame:
    """O-A25 per-parameter box summary (the gen 2 box plot)."""
    box = _box(m, ["parameter"], value, method)
    return box.select("parameter", "min", "q1", "median", "q3", "max", "count")


def first_unit(df: DataFrame, by: list[str], unit: str = "units",
               order: tuple[str, ...] = ("datetime",)) -> DataFrame:
    """O-A29 first non-null unit of each series."""
    rows, text = coded(df, unit)
    return rows.groupBy(*by).agg(first_hashed(rows, unit, *order).alias(unit)).withColumn(unit, text(F.col(unit)))
