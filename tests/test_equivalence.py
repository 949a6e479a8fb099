"""Equivalence properties between alternative plans of the same operator."""

from pyspark.sql import functions as F

from aerolith.functions import fixed
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.operators import quantiles as QN
from aerolith.plans import adapter as AD

SF = "/root/testdata/sf0.01"


def same_rows(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_window_form_equals_max_by_form(spark):
    """O-W1 (row_number) and O-W2 (max_by) agree on the same keys and tie-break."""
    m = P.trusted(AD.measurements(spark, SF))
    by_agg = W.latest_measurements(AD.measurements(spark, SF))
    ranked = W.ranked_latest(m, ["location_id", "parameter"],
                             [F.col("measurement_time").desc(), F.col("id").desc()], 1)
    assert same_rows(by_agg, ranked.select(*by_agg.columns))


def test_single_aggregation_equals_join_form(spark):
    """O-J4: the wide row from one aggregation equals aggregate + pivot + left join."""
    raw = AD.raw_air_quality(spark, SF)
    lr = W.latest_rows_pandas(raw)
    ordk = F.struct("datetime", "parameter")
    loc = lr.groupBy("location_id", "location").agg(
        F.max_by("lat", F.when(F.col("lat").isNotNull(), ordk)).alias("lat"),
        F.max_by("lon", F.when(F.col("lon").isNotNull(), ordk)).alias("lon"),
        F.max("datetime").alias("datetime"))
    piv = lr.groupBy("location_id", "location").pivot("parameter", fixed.POLLUTANT_ORDER).agg(F.max("value"))
    joined = W.with_aqi(loc.join(piv, ["location_id", "location"], "left"))
    single = W.latest_wide(raw)
    assert same_rows(single, joined.select(*single.columns))


def test_exact_quantiles_equal_percentile(spark):
    m = AD.scored(spark, SF)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    a = {r.parameter: r for r in QN.quantile_columns(m, "value", ["parameter"], probs, names, "exact").collect()}
    b = {r.parameter: r for r in QN.quantile_columns(m, "value", ["parameter"], probs, names, "percentile").collect()}
    assert a.keys() == b.keys()
    for k in a:
        for n in names:
            assert abs(a[k][n] - b[k][n]) < 1e-9, (k, n)


def test_exact_quantiles_tiny_accuracy_still_exact(spark):
    m = AD.scored(spark, SF)
    a = QN.exact_quantiles(m, "value", ["parameter"], [0.25, 0.75], accuracy=50, margin=4)
    b = QN.quantile_columns(m, "value", ["parameter"], [0.25, 0.75], ["q0", "q1"], "percentile")
    got = {r.parameter: (round(r.q0, 9), round(r.q1, 9)) for r in a.collect()}
    want = {r.parameter: (round(r.q0, 9), round(r.q1, 9)) for r in b.collect()}
    assert got == want
