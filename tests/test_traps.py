"""Hand-made edge rows, one per trap of the survey."""

import datetime as dt

import pytest

from aerolith import schemas
from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import aggregates as A
from aerolith.operators import joins as J
from aerolith.operators import latest as W
from aerolith.operators import ordering as L
from aerolith.operators import predicates as P
from aerolith.operators import quality as Q
from aerolith.sources import archive as SA

T0 = dt.datetime(2024, 1, 6, 12, 0, 0)  # a Saturday


def raw_rows(spark, rows):
    """rows: (location_id, location, datetime, lat, lon, parameter, value[, sensors_id])"""
    full = []
    for r in rows:
        loc_id, loc, t, lat, lon, p, v = r[:7]
        sid = r[7] if len(r) > 7 else 1
        full.append((loc_id, sid, loc, t, lat, lon, p, "ug/m3", v, loc_id,
                     None if t is None else f"{t.month:02d}", None if t is None else t.year, T0))
    return spark.createDataFrame(full, schemas.RAW_AIR_QUALITY)


def meas_rows(spark, rows):
    """rows: (id, location_id, parameter, value, time[, score])"""
    out = []
    for r in rows:
        i, loc, p, v, t = r[:5]
        out.append((i, loc, 1, f"L{loc}", 10.0, 20.0, p, "ug/m3", v, t, T0, fixed.SOURCE_NAME, None))
    df = spark.createDataFrame(out, schemas.MEASUREMENTS)
    return df.withColumn("quality_score", X.quality_score("parameter", "value"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_t1_month_text_partitions(spark, tmp_dir):
    t_jan, t_oct = dt.datetime(2024, 1, 2), dt.datetime(2024, 10, 2)
    raw = raw_rows(spark, [(1, "a", t_jan, 1.0, 2.0, "pm25", 5.0), (1, "a", t_oct, 1.0, 2.0, "pm25", 6.0)])
    SA.write_archive(raw, tmp_dir)
    back = SA.read_archive(spark, tmp_dir, [1], "2024-01", "2024-10")
    months = sorted(r["month"] for r in back.collect())
    assert months == ["01", "10"]
    assert dict(back.dtypes)["month"] == "string"
    only_jan = SA.read_archive(spark, tmp_dir, [1], "2024-01", "2024-09")
    assert [r["month"] for r in only_jan.collect()] == ["01"]


def test_t2_offsets_to_utc(spark):
    df = spark.createDataFrame([("2024-01-01T23:30:00-02:00",), ("2024-01-01T10:00:00Z",), ("bad",)], "s string")
    got = [r[0] for r in df.select(X.parse_utc("s")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 1, 30), dt.datetime(2024, 1, 1, 10, 0), None]


def test_t3_t4_weekday_numbering_and_names(spark):
    days = [dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 8)]  # Sat, Sun, Mon
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    rows = df.select(X.weekday_number_sql("t").alias("s"), X.weekday_number_monday0("t").alias("p"),
                     X.weekday_name("t").alias("n"), X.weekend_flag("t").alias("w")).collect()
    assert [(r.s, r.p, r.n, r.w) for r in rows] == [
        (6, 5, "Saturday", 1), (0, 6, "Sunday", 1), (1, 0, "Monday", 0)]


def test_t5_sample_std_single_and_equal(spark):
    m = meas_rows(spark, [(1, 1, "pm25", 10.0, T0), (2, 2, "pm25", 7.0, T0), (3, 2, "pm25", 7.0, T0)])
    rows = {r.location_id: r.std_value for r in A.daily_aggregates(m).collect()}
    assert rows[1] is None and rows[2] == 0.0


def test_t6_nulls_last_ordering(spark):
    loc = spark.createDataFrame([(1, "b", None, "X"), (2, "a", "c1", "X"), (3, "c", "c0", None)],
                                "location_id long, name string, city string, country string")
    ids = [r.location_id for r in L.order_locations(loc).collect()]
    assert ids == [2, 1, 3]


def test_t7_latest_tie_broken_by_id(spark):
    m = meas_rows(spark, [(5, 1, "pm25", 10.0, T0), (9, 1, "pm25", 20.0, T0)])
    assert one(W.latest_measurements(m)).value == 20.0


def test_t8_null_keys_dropped_in_pandas_path(spark):
    raw = raw_rows(spark, [(1, None, T0, 1.0, 2.0, "pm25", 5.0), (1, "a", T0, 1.0, 2.0, "pm25", 6.0)])
    assert A.daily_stats_pandas(raw).count() == 1
    assert A.daily_stats_sql(raw).count() == 2  # SQL keeps the null key


def test_t9_first_last_skip_nulls(spark):
    df = spark.createDataFrame([(1, T0, None, 1), (1, T0 + dt.timedelta(hours=1), 3.0, 2),
                                (1, T0 + dt.timedelta(hours=2), None, 3)], "k long, t timestamp_ntz, x double, id long")
    r = one(df.groupBy("k").agg(A.first_non_null("x", "t", "id").alias("f"),
                                A.last_non_null("x", "t", "id").alias("l")))
    assert r.f == 3.0 and r.l == 3.0


@pytest.mark.parametrize("aqi,label", [(0.0, "Good"), (50.0, "Good"), (50.5, "Hazardous"), (51.0, "Moderate"),
                                       (500.0, "Hazardous"), (500.1, "Hazardous"), (-1.0, "Hazardous"),
                                       (None, "No reading")])
def test_t10_aqi_band_gaps(spark, aqi, label):
    df = spark.createDataFrame([(aqi,)], "a double")
    assert df.select(X.aqi_category("a")).first()[0] == label


def test_t10_contiguous_option(spark):
    df = spark.createDataFrame([(50.5,)], "a double")
    assert df.select(X.aqi_category("a", contiguous=True)).first()[0] == "Good"


def test_t11_aqi_zero_when_particulates_missing(spark):
    df = spark.createDataFrame([(None, None), (None, 12.0), (30.0, 12.0)], "pm25 double, pm10 double")
    got = [r[0] for r in df.select(X.aqi_estimate("pm25", "pm10")).collect()]
    assert got == [0.0, 12.0, 30.0]
    assert df.select(X.aqi_category(X.aqi_estimate("pm25", "pm10"))).first()[0] == "Good"


def test_t12_t13_unknown_parameter_and_max_boundary(spark):
    m = meas_rows(spark, [(1, 1, "humidity", 40.0, T0), (2, 1, "pm25", 500.0, T0), (3, 1, "pm25", 499.0, T0)])
    scores = {r.id: r.quality_score for r in m.collect()}
    assert scores[1] == 0.5 and scores[2] == 0.0 and scores[3] == pytest.approx(0.002)
    kept = {r.id for r in P.keep_valid_scored(m).collect()}
    assert kept == {1, 3}
    assert {r.id for r in P.trusted(P.keep_valid_scored(m)).collect()} == set()


def test_t14_duplicate_keys_default_three(spark):
    raw = raw_rows(spark, [(1, "a", T0, 1.0, 2.0, "pm25", 5.0, 1), (1, "a", T0, 1.0, 2.0, "pm25", 6.0, 2)])
    assert one(Q.duplicate_count(raw, Q.GEN1_DUPLICATE_KEYS)).duplicate_records == 1
    r = one(Q.quality_profile(raw))
    assert r.duplicate_records == 1 and r.total_records == 2


def test_t15_anti_join_null_keys_and_batch_duplicates(spark):
    fact = raw_rows(spark, [(1, "a", T0, 1.0, 2.0, "pm25", 5.0)])
    stage = raw_rows(spark, [(1, "a", T0, 1.0, 2.0, "pm25", 5.0),            # present: skipped
                             (2, "b", T0, 1.0, 2.0, "pm25", 5.0),            # new
                             (2, "b", T0, 1.0, 2.0, "pm25", 5.0),            # same batch: both kept
                             (3, "c", T0, 1.0, 2.0, None, 5.0)])             # null key: always kept
    assert J.insert_if_absent(stage, fact).count() == 3
    assert J.insert_if_absent(stage, fact, time_col="datetime").count() == 3
    assert J.insert_if_absent(stage, fact, dedupe_batch=True).count() == 2


def test_t16_date_to_modes(spark):
    m = meas_rows(spark, [(1, 1, "pm25", 5.0, dt.datetime(2024, 1, 20, 0, 0)),
                          (2, 1, "pm25", 5.0, dt.datetime(2024, 1, 20, 15, 0))])
    mid = m.where(P.optional_filters(date_to="2024-01-20")).count()
    day = m.where(P.optional_filters(date_to="2024-01-20", date_to_mode="inclusive_day")).count()
    assert (mid, day) == (1, 2)


def test_t18_moved_location_splits_sql_group_only(spark):
    raw = raw_rows(spark, [(1, "a", T0, 1.0, 2.0, "pm25", 5.0),
                           (1, "a", T0 + dt.timedelta(hours=1), 1.5, 2.0, "pm25", 7.0)])
    assert A.daily_stats_sql(raw).count() == 2
    r = one(A.daily_stats_pandas(raw))
    assert (r.lat, r.average_value) == (1.5, 6.0)


def test_t19_null_parameter_stays_null(spark):
    raw = raw_rows(spark, [(1, "a", T0, 1.0, 2.0, None, 5.0)])
    assert one(P.load_readings(raw)).parameter is None


def test_t20_mean_of_means(spark):
    m = meas_rows(spark, [(1, 1, "pm25", 0.0, T0), (2, 1, "pm25", 0.0, T0), (3, 1, "humidity", 1.0, T0)])
    r = one(A.quality_overview(m))
    assert r.avg_quality == pytest.approx((1.0 + 0.5) / 2)
    assert r.total_records == 3 and r.parameters == 2


def test_t21_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    got = [r[0] for r in df.select(X.nan_to_null("v")).collect()]
    assert got == [None, 1.0]


def test_t22_id_zero_is_a_filter(spark):
    m = meas_rows(spark, [(1, 0, "pm25", 5.0, T0), (2, 3, "pm25", 5.0, T0)])
    assert m.where(P.optional_filters(location_id=0)).count() == 1


def test_t23_null_value_scores_null(spark):
    m = meas_rows(spark, [(1, 1, "pm25", None, T0), (2, 1, "humidity", None, T0)])
    scores = {r.id: r.quality_score for r in m.collect()}
    assert scores == {1: None, 2: 0.5}
    assert P.keep_valid_scored(m).count() == 0


def test_t24_zero_deviation_not_outlier(spark):
    m = meas_rows(spark, [(1, 1, "pm25", 5.0, T0), (2, 1, "pm25", 5.0, T0), (3, 2, "no2", 1.0, T0)])
    flags = {r.id: r.is_outlier for r in Q.outliers(m, "zscore").collect()}
    assert flags == {1: False, 2: False, 3: False}
    with pytest.raises(ValueError):
        Q.outliers(m, "mad")


def test_stale_boundary_exact_24h(spark):
    newest = dt.datetime(2024, 1, 30, 12, 0)
    rows = [(1, "a", newest, 1.0, 2.0, "pm25", 1.0),
            (2, "b", newest - dt.timedelta(hours=24), 1.0, 2.0, "pm25", 1.0),
            (3, "c", newest - dt.timedelta(hours=24, microseconds=1), 1.0, 2.0, "pm25", 1.0)]
    assert one(Q.stale_locations(raw_rows(spark, rows))).stale_locations == 1


def test_iqr_outlier_flags(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    m = meas_rows(spark, [(i, 1, "pm25", v, T0) for i, v in enumerate(vals)])
    flags = {r.value: r.is_outlier for r in Q.outliers(m, "iqr").collect()}
    assert flags[100.0] is True and not any(flags[v] for v in vals[:4])


def test_overview_labels_in_code_order(spark):
    raw = raw_rows(spark, [(1, "a", T0, 1.0, 2.0, "pb", 1.0), (1, "a", T0, 1.0, 2.0, "NO2", 2.0),
                           (1, "a", T0, 1.0, 2.0, "xyz", 3.0)])
    assert one(A.overview(raw)).parameter_labels == "NO2, Lead (Pb), XYZ"


def test_value_zero_and_above_max(spark):
    m = meas_rows(spark, [(1, 1, "pm25", 0.0, T0), (2, 1, "pm25", 500.01, T0), (3, 1, "co", 50.0, T0)])
    scores = {r.id: r.quality_score for r in m.collect()}
    assert scores == {1: 1.0, 2: 0.0, 3: 0.0}
    assert {r.id for r in P.keep_valid_scored(m).collect()} == {1}


def test_null_location_name_falls_back_to_id(spark):
    m = meas_rows(spark, [(1, 5, "pm25", 1.0, T0), (2, 6, "pm25", 1.0, T0)])
    loc = spark.createDataFrame([(5, None), (6, "")], "location_id long, name string")
    got = {r.location_id: r.location for r in J.attach_location_name(m.drop("location"), loc).collect()}
    assert got == {5: "5", 6: "6"}


def test_requested_months_cross_year_boundary(spark, tmp_dir):
    ids = spark.createDataFrame([(5,)], "location_id long")
    got = sorted((r.year, r.month) for r in SA.requested_partitions(spark, ids, "2023-11", "2024-02").collect())
    assert got == [(2023, "11"), (2023, "12"), (2024, "01"), (2024, "02")]
    raw = raw_rows(spark, [(5, "a", dt.datetime(2023, 12, 31, 23), 1.0, 2.0, "pm25", 1.0)])
    SA.write_archive(raw, tmp_dir)
    missing = sorted(r.month for r in SA.missing_partitions(spark, tmp_dir, ids, "2023-11", "2024-02").collect())
    assert missing == ["01", "02", "11"]
    assert SA.read_archive(spark, tmp_dir, ids, "2023-12", "2023-12", min_partitions=4).rdd.getNumPartitions() == 4
