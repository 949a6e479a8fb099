"""Data-quality operators (O-A13, O-A16, O-A17, O-A22, O-A23, O-A26, O-A27).

Global bounds (newest time, per-parameter quartiles, mean and deviation) are
computed once as small aggregates. A 1-row bound is used as a scalar
subquery. A per-parameter bound frame is written and counted before it is
joined: up to ``session.SMALL_ROWS`` rows it is broadcast and the fact stays
where it is scanned; beyond that the join shuffles, with hot keys split by AQE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import predicates as P
from aerolith.operators import quantiles as QN
from aerolith.session import small_side, written_once

GEN1_DUPLICATE_KEYS = ["location_id", "datetime", "parameter"]


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """O-A16 rows beyond the first on ``keys`` (null keys group together,
    like pandas ``duplicated``): ``sum(count - 1)`` of a partial aggregate."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_records"))


def stale_locations(df: DataFrame, location: str = "location", time_col: str = "datetime",
                    hours: int = fixed.QUALITY_STALE_HOURS) -> DataFrame:
    """O-A17 locations whose newest reading is strictly older than the
    overall newest minus ``hours``. Null locations are dropped (T8), but count
    for the overall newest. One scan of ``df``: a row per location is written,
    and both the bound (a scalar subquery) and the count come from it."""
    return _stale(written_once(df.groupBy(location).agg(F.max(time_col).alias("_last")), "newest-per-location"), location, "_last", hours)


def _stale(per: DataFrame, location: str, last: str, hours: int) -> DataFrame:
    """``stale_locations`` from a written row per location, the null one among them."""
    newest = per.select(F.max(last)).scalar()
    return per.where(F.col(location).isNotNull()).agg(
        F.count(F.when(F.col(last) < X.minus_hours(newest, hours), F.lit(1))).alias("stale_locations"))


def quality_profile(raw: DataFrame, keys: list[str] | None = None,
                    location: str = "location", hours: int = fixed.QUALITY_STALE_HOURS) -> DataFrame:
    """O-A13 one-row profile of the gen 1 fact (invalid rows included):
    total, missing, negative, duplicates (T14 keys), stale locations, latest.
    Two scans of the fact: one per location (all counts and the newest time,
    written as a dimension-sized table), one for the duplicates."""
    r = P.load_readings(raw, include_invalid=True).withColumn("value", X.to_number("value"))
    k = keys or GEN1_DUPLICATE_KEYS
    dup = duplicate_count(r, k).scalar()
    per = written_once(r.groupBy(location).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value").isNull(), F.lit(1))).alias("missing"),
        F.count(F.when(F.col("value") < 0, F.lit(1))).alias("negative"), F.max("datetime").alias("datetime")), "profile")
    stale = _stale(per, location, "datetime", hours).scalar()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    base = per.agg(total("n").alias("total_records"), total("missing").alias("missing_values"),
                   total("negative").alias("negative_values"), F.max("datetime").alias("latest_reading"))
    return base.select("total_records", "missing_values", "negative_values",
                       dup.alias("duplicate_records"), stale.alias("stale_locations"),
                       "latest_reading")


def iqr_bounds(m: DataFrame, value: str = "value", by: str = "parameter",
               factor: float = fixed.OUTLIER_IQR_FACTOR, method: str = "exact") -> DataFrame:
    """Per-group quartiles (linear interpolation, like pandas) and fences.
    ``method``: 'exact' (distributed selection), 'percentile', 'approx'."""
    return _fences(QN.quantile_columns(m, value, [by], [0.25, 0.75], ["q1", "q3"], method), factor)


def _fences(quartiles: DataFrame, factor: float) -> DataFrame:
    return (quartiles
             .withColumn("lower_bound", F.col("q1") - factor * (F.col("q3") - F.col("q1")))
             .withColumn("upper_bound", F.col("q3") + factor * (F.col("q3") - F.col("q1"))))


def outliers_iqr(m: DataFrame, value: str = "value", by: str = "parameter",
                 factor: float = fixed.OUTLIER_IQR_FACTOR, method: str = "exact") -> DataFrame:
    """O-A22 flag values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] of their group."""
    if method == "exact":  # the groups were counted with their sketches: no second count
        quartiles, small = QN.grouped_quantiles(m, value, [by], [0.25, 0.75], ["q1", "q3"])
        b = _fences(quartiles, factor).select(by, "lower_bound", "upper_bound")
        b = F.broadcast(b) if small else b
    else:
        b = small_side(iqr_bounds(m, value, by, factor, method).select(by, "lower_bound", "upper_bound"), "bounds")
    v = F.col(value)
    flag = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    return (m.join(b, by, "left")
            .withColumn("is_outlier", F.coalesce(flag, F.lit(False)))
            .drop("lower_bound", "upper_bound"))


def outliers_zscore(m: DataFrame, value: str = "value", by: str = "parameter",
                    limit: float = fixed.OUTLIER_Z_LIMIT) -> DataFrame:
    """O-A23 flag |z| > 3 with the sample deviation of the group; a zero or
    undefined deviation flags nothing (T24)."""
    s = small_side(m.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")), "bounds")
    z = X.abs_zscore(value, "_mean", "_std")
    return (m.join(s, by, "left")
            .withColumn("is_outlier", F.coalesce(z > F.lit(limit), F.lit(False)))
            .drop("_mean", "_std"))


def outliers(m: DataFrame, method: str = "iqr", **kw) -> DataFrame:
    """Dispatch like the reference: 'iqr' or 'zscore'; anything else raises."""
    if method == "iqr":
        return outliers_iqr(m, **kw)
    if method == "zscore":
        return outliers_zscore(m, **kw)
    raise ValueError(f"Unknown outlier detection method: {method}")


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """O-A26 / O-A27 attach row-count (and other) metrics to a plan that is
    about to run; read them from the Observation after the action."""
    obs = Observation(f"{name}-{uuid.uuid4().hex[:8]}")  # names must be unique per session
    exprs = [F.count(F.lit(1)).alias("rows")] + [e.alias(k) for k, e in metrics.items()]
    return df.observe(obs, *exprs), obs


def metrics(obs: Observation) -> dict:
    """Observed values; a failed observation raises instead of reading as zero."""
    return obs.get
