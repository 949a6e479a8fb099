"""Streaming jobs against their batch twins and the watermark rules."""

import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from aerolith.functions import scalars as X
from aerolith.operators import predicates as P
from aerolith.plans import adapter as AD
from aerolith.streaming import ingest as T
from aerolith.streaming import snapshots as S

SF = "/root/testdata/sf0.001"


def _rec(i, t, v=10.0):
    return {"id": i, "location_id": 1, "sensor_id": 0, "location": "a", "latitude": 1.0, "longitude": 2.0,
            "parameter": "pm25", "unit": "ug/m3", "value": v, "measurement_time": t}


def test_late_row_beyond_watermark_is_dropped(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(_rec(i, f"2024-01-01T{h:02d}:10:00Z"))
                                          for i, h in enumerate([0, 5])))
    s = P.keep_valid_scored(T.read_record_stream(spark, str(src), max_files=1))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = (T.hourly_stream(s, "1 hour").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    # a row for hour 01 arrives after the watermark moved to 04:10
    (src / "2.json").write_text(json.dumps(_rec(9, "2024-01-01T01:30:00Z")))
    q = (T.hourly_stream(s, "1 hour").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    hours = sorted(r.hour.hour for r in spark.read.parquet(out).collect())
    assert hours == [0]  # 05:00 window still open; the 01:30 row was late and dropped


def test_stream_latest_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    T.land_records(AD.scored(spark, SF).drop("quality_score"), src, 3)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=1))
    out = str(tmp_path / "latest")
    T.run_to_table(T.latest_stream(s), out, "complete", checkpoint=str(tmp_path / "ck"))
    from aerolith.operators import latest as W
    batch = W.latest_measurements(AD.measurements(spark, SF))
    got = T.read_snapshot(spark, out)
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_ingest_replay_adds_nothing(spark, tmp_path):
    src, table, ck = str(tmp_path / "src"), str(tmp_path / "t"), str(tmp_path / "ck")
    T.land_records(AD.scored(spark, SF).drop("quality_score"), src, 2)
    T.ingest_insert_if_absent(spark, src, table, ck).awaitTermination()
    n1 = spark.read.parquet(table).count()
    # a fresh checkpoint starts at batch 0 again and is no replay: every file is read
    # again, and the anti-join on the keys keeps the table unchanged
    T.ingest_insert_if_absent(spark, src, table, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(table).count() == n1 == AD.measurements(spark, SF).count()


def test_two_sources_and_the_default_checkpoint(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "a.json").write_text("\n".join(
            json.dumps(_rec(10 * k + i, f"2024-01-0{k}T0{i}:00:00Z")) for i in range(2)))
    table = str(tmp_path / "t")
    for _ in range(2):  # the second round resumes from the checkpoints and reads nothing
        for k in (1, 2):
            T.ingest_insert_if_absent(spark, str(tmp_path / f"s{k}"), table).awaitTermination()
    assert spark.read.parquet(table).count() == 4


def folders(path):
    return sorted(p.name for p in path.iterdir() if not p.name.endswith(".crc"))


def test_readers_see_published_snapshots_only(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "latest")
    T.land_records(AD.scored(spark, SF).drop("quality_score"), src, 6)
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=1))
    T.run_to_table(T.latest_stream(s), out, "update", checkpoint=str(tmp_path / "ck"), keys=["location_id", "parameter"])
    from aerolith.operators import latest as W
    want = W.latest_measurements(AD.measurements(spark, SF))
    got = T.read_snapshot(spark, out)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    (tmp_path / "latest" / "delta-999999999999-half").mkdir()  # written half, never published
    assert T.read_snapshot(spark, out).count() == want.count()


def test_a_keyed_table_stays_small_and_exact(spark, tmp_path):
    """Thirty batches: the files that a batch reads and keeps do not grow, and each key has its newest row."""
    path, want, seen = tmp_path / "t", {}, []
    for n in range(30):
        rows = [(k, None if k % 7 == 3 else f"p{k % 3}", n * 100 + k) for k in range(n % 4, 40, 4)]
        want |= {r[:2]: r[2] for r in rows}
        df = spark.createDataFrame(rows, "k int, p string, v int").coalesce(1)
        if n == 12:  # a batch that failed before its state: its folder goes with the next one
            df.withColumn("_batch", df["v"].cast("bigint")).write.parquet(str(path / "delta-000000000012-lost"))
        S.publish(df, n, str(path), ["k", "p"], owner="one", buckets=4, rounds=4)
        if n in (5, 17):  # the same batch again, as after a failure
            S.publish(df, n, str(path), ["k", "p"], owner="one", buckets=4, rounds=4)
        if n > 8:
            state = json.loads((path / "states" / f"{n:012d}.json").read_text())
            assert len(state["deltas"]) == 4 and len(state["bases"]) == 4
            seen.append(len(folders(path)) + len(folders(path / "states")))
        if n % 7 == 6:
            assert {(r.k, r.p): r.v for r in S.read(spark, str(path)).collect()} == want
    assert max(seen) <= seen[3] + 1 and len(folders(path / "states")) == S.KEPT
    assert not (path / "delta-000000000012-lost").exists()
    got = S.read(spark, str(path)).collect()
    assert {(r.k, r.p): r.v for r in got} == want and len(got) == len(want)


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(6):
        S.publish(spark.range(40).withColumnRenamed("id", "k").withColumn("v", F.lit(n)), n, path, ["k"], buckets=8, rounds=4)
    bases = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("base-")]
    assert bases and all(len([b for b in p.iterdir() if b.name.startswith("_bucket")]) == 2 for p in bases)


def test_a_new_stream_goes_on_with_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda ids, v, n, owner: S.publish(spark.createDataFrame([(i, v) for i in ids], "k int, v int"), n, path, ["k"], owner=owner)
    put([1, 2], 10, 0, "a"), put([2, 3], 11, 1, "a"), put([3, 4], 12, 0, "b")
    assert {r.k: r.v for r in S.read(spark, path).collect()} == {1: 10, 2: 11, 3: 12, 4: 12}
    S.publish(spark.createDataFrame([(9, 1)], "k int, v int"), 1, path, [], complete=True, owner="b")
    assert [tuple(r) for r in S.read(spark, path).collect()] == [(9, 1)]


def write_records(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_null_keys_are_not_doubled_by_a_replay(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "t")
    write_records(src, "1.json", [_rec(1, "2024-01-01T00:00:00Z") | {"sensor_id": None}, _rec(2, "2024-01-01T01:00:00Z")])
    T.ingest_insert_if_absent(spark, str(src), table, str(tmp_path / "ck")).awaitTermination()
    # the append happened, its marker and the stream's commit were lost
    for p in [*(x for x in (tmp_path / "t_commits").rglob("*") if x.is_file()), *(tmp_path / "ck" / "commits").iterdir()]:
        p.unlink()
    T.ingest_insert_if_absent(spark, str(src), table, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_markers_do_not_pile_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "KEPT_MARKERS", 2)
    src, table = tmp_path / "src", str(tmp_path / "t")
    for n in range(5):
        write_records(src, f"{n}.json", [_rec(n, f"2024-01-01T0{n}:00:00Z")])
        T.ingest_insert_if_absent(spark, str(src), table, str(tmp_path / "ck")).awaitTermination()
    markers = [p for p in (tmp_path / "t_commits").rglob("0*") if p.is_file() and not p.name.endswith(".crc")]
    assert sorted(p.name for p in markers) == [f"{n:012d}" for n in (3, 4)]
    assert spark.read.parquet(table).count() == 5


def test_a_table_made_again_is_filled_again(spark, tmp_path):
    src, table = tmp_path / "src", tmp_path / "t"
    write_records(src, "1.json", [_rec(1, "2024-01-01T00:00:00Z")])
    for _ in range(2):
        T.ingest_insert_if_absent(spark, str(src), str(table)).awaitTermination()
        assert spark.read.parquet(str(table)).count() == 1
        table.rename(tmp_path / f"gone-{uuid.uuid4().hex}")


def test_a_stream_leaves_the_session_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    s = T.read_record_stream(spark, str(tmp_path), state_partitions=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert s.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
    assert s.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_correction_reads_open_and_late_hours_only(spark, tmp_path):
    from aerolith.operators import aggregates as A
    src, out = tmp_path / "src", str(tmp_path / "out")
    def run():
        s = P.keep_valid_scored(T.read_record_stream(spark, str(src), max_files=1))
        T.run_to_table(T.hourly_stream(s, "1 hour"), out, "append", checkpoint=str(tmp_path / "ck"))
    rows = [_rec(i, f"2024-01-01T{h:02d}:10:00Z", 10.0 + i) for i, h in enumerate([0, 1, 3, 5, 8])]
    write_records(src, "1.json", rows)
    run()
    assert T.correction_start(spark, out) == dt.datetime(2024, 1, 1, 7)  # the watermark is 07:10
    late = _rec(9, "2024-01-01T03:30:00Z", 50.0)
    write_records(src, "2.json", [late])
    run()
    assert T.correction_start(spark, out) == dt.datetime(2024, 1, 1, 3)
    table = spark.read.schema(T.RECORD_SCHEMA).json(str(src))
    table = table.withColumn("measurement_time", F.to_timestamp("measurement_time").cast("timestamp_ntz"))
    table = table.withColumn("quality_score", X.quality_score("parameter", "value"))
    table.write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    emitted = spark.read.parquet(out)
    fixed = T.close_hours(emitted, table, T.correction_start(spark, out))
    want = A.hourly(table).select(*emitted.columns)
    assert sorted(map(tuple, fixed.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and fixed.count() == 5
    assert "GreaterThanOrEqual(measurement_time,2024-01-01T03:00" in fixed._jdf.queryExecution().toString()
    T.corrected(spark, out)
    assert T.correction_start(spark, out) == dt.datetime(2024, 1, 1, 7)


def test_a_batch_may_end_within_an_arrival(spark, tmp_path):
    """Arrivals of many files, two a batch: no row is behind the watermark, and the hours closed are whole."""
    from aerolith.operators import aggregates as A
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        T.land_records(AD.scored(spark, SF).drop("quality_score"), src, 3)
    finally:
        for k in sizes:
            spark.conf.unset(k)
    files = [p for p in (tmp_path / "src").iterdir() if p.name.startswith("part-")]
    assert len(files) > 8 and len({p.stat().st_mtime_ns // 10**9 for p in files}) == len(files)
    assert [p.name for p in (tmp_path / "src").iterdir() if p.is_dir()] == []
    s = P.keep_valid_scored(T.read_record_stream(spark, src, max_files=2))
    T.run_to_table(T.hourly_stream(s, "1 hour"), out, "append", checkpoint=str(tmp_path / "ck"))
    table = AD.measurements(spark, SF)
    last = table.agg(F.max("measurement_time")).first()[0]
    want = {(r.location_id, r.parameter, r.hour): r["count"] for r in A.hourly(table).collect()
            if r.hour + dt.timedelta(hours=1) <= last - dt.timedelta(hours=1)}
    got = spark.read.parquet(out)
    assert {(r.location_id, r.parameter, r.hour): r["count"] for r in got.collect()} == want
    since = T.correction_start(spark, out)
    assert since == (last - dt.timedelta(hours=1)).replace(minute=0, second=0, microsecond=0)
    assert T.close_hours(got, table, since).count() == A.hourly(table).count()


def test_alerts_rule(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    rows = [_rec(1, "2024-01-01T00:00:00Z", 600.0), _rec(2, "2024-01-01T00:00:00Z", 160.0),
            _rec(3, "2024-01-01T00:00:00Z", 20.0)]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    s = T.read_record_stream(spark, str(src))
    out = str(tmp_path / "alerts")
    T.run_to_table(T.alert_stream(s), out, "append", checkpoint=str(tmp_path / "ck"))
    got = {r.id: r.alert for r in spark.read.parquet(out).collect()}
    assert got == {1: "out_of_range", 2: "aqi_band"}
