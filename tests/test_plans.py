"""Plan assertions: pushdown, pruning, group limits, partial aggregation,
no Python in the hot path."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from aerolith.operators import aggregates as A
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.plans import adapter as AD
from aerolith.plans import registry
from aerolith.sources import archive as SA

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF", "FlatMapGroupsInArrow", "MapInArrow")


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def fact_path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("fact"))
    AD.measurements(spark, SF).write.mode("overwrite").parquet(p)
    return p


def test_parameter_filter_pushed_to_scan(spark, fact_path):
    m = spark.read.parquet(fact_path)
    text = plan(P.parameter_in(m, ["pm10", "pm25"]).select("location_id", "value"))
    assert "In(parameter, [pm10,pm25])" in text.split("PushedFilters:")[1].split("\n")[0]
    assert "ReadSchema: struct<location_id:bigint,parameter:string,value:double>" in text


def test_time_filters_pushed(spark, fact_path):
    m = spark.read.parquet(fact_path)
    text = plan(m.where(P.optional_filters(None, "pm25", "2024-01-05", "2024-01-20")))
    assert "GreaterThanOrEqual(measurement_time" in text and "LessThanOrEqual(measurement_time" in text


def test_archive_partition_pruning(spark, tmp_path):
    raw = AD.raw_air_quality(spark, SF)
    SA.write_archive(raw, str(tmp_path))
    df = SA.read_archive(spark, str(tmp_path), [1, 2, 3], "2024-01", "2024-01")
    text = plan(df)
    assert "PartitionFilters: [" in text and "locationid" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_ranked_latest_uses_window_group_limit(spark):
    text = plan(W.newest_n_per_location(AD.measurements(spark, SF), 5))
    assert "WindowGroupLimit" in text


def below_exchange(df):
    """The plan from the first exchange down to the scans."""
    text = plan(df, "simple")
    return text[text.index("Exchange"):]


def test_newest_times_hash_and_newest_rows_stay_where_they_are(spark, fact_path):
    m = spark.read.parquet(fact_path)
    keys = ["location_id", "parameter"]
    newest = W.newest_times(m, keys, "measurement_time")
    below = below_exchange(newest)
    assert "Sort" not in below and "HashAggregate" in below
    rows = plan(W.newest_rows(m, keys, "measurement_time", newest), "simple")
    fact = rows[rows.rindex("BroadcastHashJoin"):].split("BroadcastExchange")[0]
    assert "Sort" not in fact and "Exchange" not in fact


@pytest.mark.parametrize("name", ["latest_measurements", "latest_rows_pandas", "latest_wide", "latest_map"])
def test_latest_reads_the_few_rows_left(spark, fact_path, tmp_path, name):
    """What a latest view aggregates whole is the written rows at the newest times, not the fact."""
    raw = AD.raw_air_quality(spark, SF)
    raw.write.parquet(str(tmp_path / "raw"))
    src = spark.read.parquet(fact_path if name == "latest_measurements" else str(tmp_path / "raw"))
    text = plan(getattr(W, name)(src), "simple")
    scans = [x for x in text.splitlines() if "FileScan" in x]
    assert scans and all("newest-rows" in x for x in scans) and "Window" not in text


def test_first_and_last_values_are_hashed(spark, fact_path):
    m = spark.read.parquet(fact_path)
    v = m.withColumnRenamed("measurement_time", "datetime")
    for df in (W.last_value_pivot(v, ["location_id", "location"], ["pm25", "pm10"], "datetime", ["sensor_id"]),
               A.hourly(m), A.first_unit(m, ["location_id", "parameter"], "unit", ("measurement_time", "id"))):
        text = plan(df, "simple")
        assert "Sort" not in text and "HashAggregate" in text


def test_order_key_orders_like_its_columns(spark):
    times = ["1900-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-02-29 12:00:00.000001", "9999-12-31 23:59:59.999999", None]
    ids = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, None]
    df = spark.createDataFrame([(t, i) for t in times for i in ids], "t string, i bigint").withColumn("t", F.col("t").cast("timestamp_ntz"))
    rows = df.withColumn("k", W.order_key(df, ["t", "i"])).collect()
    assert all((r.k is None) == (r.t is None) for r in rows)
    timed = [r for r in rows if r.t is not None]
    want = sorted(timed, key=lambda r: (r.t, r.i is not None, r.i or 0))
    assert sorted(timed, key=lambda r: r.k) == want and len({r.k for r in timed}) == len(timed)


def test_many_keys_and_ties_give_the_same_latest(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 37).alias("k"), F.expr("if(id % 5 = 0, null, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 11))").alias("t"),
        (F.col("id") % 3).alias("tie"), F.col("id").alias("id"), F.col("id").cast("string").alias("text"))
    rows = rows.unionByName(rows.limit(50).withColumn("k", F.lit(None).cast("bigint")))
    rows = rows.unionByName(rows.limit(9).withColumn("k", F.lit(99)).withColumn("t", F.lit(None).cast("timestamp_ntz")))
    few, many = (W.latest_by_key(rows, ["k"], "t", ["tie", "id"], most=n) for n in (1000, 1))
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    assert few.count() == 38  # a key without a time has no latest row


def test_a_large_vocabulary_stays_text(spark, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 4).alias("g"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id)").alias("t"),
                                  F.expr("if(id < 4, null, cast(id as string))").alias("unit"))
    few = sorted(map(tuple, A.first_unit(rows, ["g"], "unit", ("t",)).collect()))
    monkeypatch.setattr(A, "MAX_CODES", 5)
    assert sorted(map(tuple, A.first_unit(rows, ["g"], "unit", ("t",)).collect())) == few == [(0, "4"), (1, "5"), (2, "6"), (3, "7")]


def test_daily_aggregates_partial_before_exchange(spark):
    text = plan(A.daily_aggregates(AD.measurements(spark, SF)), "simple")
    lines = text.splitlines()
    exch = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    assert any("partial_avg" in l for l in lines[exch:])


def test_dimension_join_broadcast_after_measuring(spark):
    df = A.location_summary(AD.locations(spark, SF), AD.measurements(spark, SF))
    df.collect()
    text = plan(df, "simple")
    assert "isFinalPlan=true" in text and "BroadcastHashJoin" in text


CORE = sorted(n for n, fn in registry.QUERIES.items() if fn.__module__.endswith("queries_core")) \
    if registry.load_all() is None else []


@pytest.mark.parametrize("name", CORE)
def test_no_python_in_plan(spark, name):
    text = plan(E.queries()[name](spark, SF), "extended")
    assert not any(node in text for node in PYTHON_NODES), name


def test_insert_if_absent_pushes_time_range_to_fact(spark, tmp_path):
    from aerolith.operators import joins as J
    raw = AD.raw_air_quality(spark, SF)
    raw.write.mode("overwrite").parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    stage = raw.where(F.col("datetime") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    text = plan(J.insert_if_absent(stage, fact))
    fact_scan = [l for l in text.splitlines() if "PushedFilters" in l and "GreaterThanOrEqual(datetime" in l]
    assert fact_scan and "LessThan(datetime,2024-02-01" in fact_scan[0]


def test_an_old_row_opens_its_own_month_only(spark, tmp_path):
    from aerolith.operators import joins as J
    raw = AD.raw_air_quality(spark, SF)
    raw.write.mode("overwrite").partitionBy("year", "month").parquet(str(tmp_path / "fact"))
    fact = spark.read.schema(raw.schema).parquet(str(tmp_path / "fact"))
    stage = raw.where(F.col("datetime") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    old = stage.limit(1).withColumn("datetime", F.lit("2019-03-05").cast("timestamp_ntz"))
    new = J.insert_if_absent(stage.unionByName(old), fact)
    assert J.stage_months(stage.unionByName(old), "datetime") == [(2019, 3), (2024, 1)]
    assert new.count() == 1


def test_bounds_never_shuffle_the_fact(spark, tmp_path):
    """With a broadcast threshold of 1 KB the fact still is not dealt by its parameter."""
    from aerolith.operators import quality as Q
    AD.scored(spark, SF).write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        for df in (Q.outliers_iqr(m), Q.outliers_zscore(m)):
            text = plan(df)
            assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_missed_bracket_raises(spark):
    from aerolith.operators import quantiles as QN
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    with pytest.raises(Exception, match="bracket"):
        QN.exact_quantiles(df, "x", ["g"], [0.5], ["m"], accuracy=2, margin=0.0).collect()


def test_quantiles_multiply_no_row_of_the_fact(spark, fact_path):
    """Nothing is generated below the exchange; a row meets all columns' and ranks' counters at once."""
    from aerolith.operators import quality as Q
    from aerolith.operators import quantiles as QN
    m = spark.read.parquet(fact_path)
    daily = A.daily_aggregates(m).withColumnRenamed("avg_value", "average_value")
    for df in (A.numeric_profile(m, ["value", "latitude", "quality_score"]), A.parameter_distribution(m), A.weekday_distribution(daily),
               Q.iqr_bounds(m), Q.outliers_iqr(m), QN.exact_quantiles(m, "value", [], [0.5])):
        text = plan(df, "simple")
        for line in [x for x in text.splitlines() if "FileScan" in x]:
            above = text[:text.index(line)]
            path = above[above.rindex("Exchange"):] if "Exchange" in above else above
            assert "Generate" not in path and "Expand" not in path


def test_quantiles_of_several_columns(spark):
    from aerolith.operators import quantiles as QN
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 1000).cast("double").alias("x"),
                                    F.when(F.col("id") % 7 != 0, (F.col("id") % 5).cast("double")).alias("y"), F.lit(None).cast("double").alias("z"),
                                    F.lit(4.0).alias("c"))
    want = {r["column"]: r for r in A.numeric_profile(rows, ["x", "y", "z", "c"], "percentile").collect()}
    got = {r["column"]: r for r in A.numeric_profile(rows, ["x", "y", "z", "c"]).collect()}
    assert got == want and got["z"]["count"] == 0 and got["z"]["p50"] is None and got["c"]["std"] == 0.0
    s = QN.select(rows, ["x", "y"], ["g"], [0.1, 0.9], accuracy=30, margin=4)
    found = {(r.g, r._j, r._i): r._q for r in s.quantiles.collect()}
    for r in rows.groupBy("g").agg(*[F.percentile(c, [0.1, 0.9]).alias(c) for c in "xy"]).collect():
        assert [[found[r.g, j, i] for i in (0, 1)] for j in (0, 1)] == [r.x, r.y]
    assert A.numeric_profile(rows.limit(0), ["x"]).count() == 0


def test_distinct_counts_expand_the_small_frame_only(spark):
    tree = plan(A.trusted_summary(AD.measurements(spark, SF))).split("\n\n")[0]
    below = tree[tree.index("Expand"):]
    assert "Exchange" in below[:below.index("Scan")]  # the fact is reduced before it is expanded
