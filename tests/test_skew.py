"""A hot key holding a third of all rows: results stay whole and equal to an
independent formulation; the plans keep partial aggregation before shuffles."""

import pytest
from pyspark.sql import functions as F

from aerolith.operators import aggregates as A
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.operators import quality as Q
from aerolith.operators import quantiles as QN
from aerolith.plans import adapter as AD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hot(spark):
    m = AD.measurements(spark, SF)
    return m.withColumn("location_id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("location_id")))


def same_rows(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_hot_key_share(hot):
    n, k = hot.count(), hot.where(F.col("location_id") == 7).count()
    assert k >= n / 3 - 50


def test_latest_on_hot_key(spark, hot):
    got = W.latest_measurements(hot)
    ref = W.ranked_latest(P.trusted(hot), ["location_id", "parameter"],
                          [F.col("measurement_time").desc(), F.col("id").desc()], 1)
    assert same_rows(got, ref.select(*got.columns))


def test_newest_n_on_hot_key(spark, hot):
    got = W.newest_n_per_location(hot, 50)
    assert got.where(F.col("location_id") == 7).count() == 50
    assert got.groupBy("location_id").count().where(F.col("count") > 50).count() == 0


def test_duplicates_on_hot_key(spark, hot):
    keys = ["location_id", "measurement_time", "parameter"]
    dup = W.duplicated_rows(hot, keys, "id").count()
    total = Q.duplicate_count(hot, keys).first()[0]
    assert dup == total


def test_daily_on_hot_key_whole(spark, hot):
    d = A.daily_aggregates(hot)
    assert d.agg(F.sum("measurement_count")).first()[0] == P.trusted(hot).count()


def test_quantiles_on_hot_key(spark, hot):
    a = QN.quantile_columns(hot, "value", ["location_id"], [0.5], ["m"], "exact")
    b = QN.quantile_columns(hot, "value", ["location_id"], [0.5], ["m"], "percentile")
    j = a.join(b.withColumnRenamed("m", "m2"), "location_id")
    assert j.where(F.abs(F.col("m") - F.col("m2")) > 1e-9).count() == 0
    assert j.count() == b.count()


def test_invalid_rows(spark):
    s = AD.scored(spark, SF)
    assert P.invalid_rows(s, "value").count() == P.validate_required(s, "value").first().n_missing
