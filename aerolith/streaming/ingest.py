"""Structured Streaming jobs (O-T1 .. O-T7).

Landed payload files are the stream source (``readStream`` with an explicit
schema); every query has its own checkpoint under the shared folder named by
``spark.checkpoint.dir``, so a restarted driver or a lost executor resumes
from the last committed batch.

Event time is stored as ``TIMESTAMP_NTZ`` but watermarks need ``TIMESTAMP``:
the session zone is UTC, so the cast keeps the wall clock, and sinks cast
back.

Exactly-once against the fact: ``foreachBatch`` may replay a stream's last batch
after a failure. Each append leaves a marker (checkpoint, batch id) next to the
table; only the last few are kept, so a batch looks at one file name however long
the stream has run. A failure between the append and its marker replays the batch,
and then the anti-join, in which a null key equals a null, makes the replay a
no-op. A second source or a new checkpoint starts at batch 0 again and is
ingested. The default checkpoint is named by source and by the identity of the
table, which is written with it: the same ingest resumes where it stopped, and a
table that was dropped and made again starts anew.

A stream lives in a session of its own, so that the number of its state partitions
is no setting of the session that other queries use.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import aggregates as A
from aerolith.operators import joins as J
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.operators import quality as Q
from aerolith.session import checkpoint_root, path_exists, scratch_path, written_once
from aerolith.streaming import snapshots
from aerolith.streaming.snapshots import Files

# Flat landed measurement records (one JSON object per line).
RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("location_id", T.LongType()),
    T.StructField("sensor_id", T.LongType()), T.StructField("location", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("parameter", T.StringType()), T.StructField("unit", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("measurement_time", T.StringType()),
])


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session like ``spark`` for one stream. The number of state partitions is fixed by the first run of
    a checkpoint; by default there is one for each core of the cluster. Progress of all batches of a run is kept."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    return own


def read_record_stream(spark: SparkSession, path: str, max_files: int | None = None,
                       state_partitions: int | None = None) -> DataFrame:
    """Stream of landed records in a session of its own; time parsed to NTZ, scored (O-F8)."""
    r = stream_session(spark, state_partitions).readStream.schema(RECORD_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.json(path)
    s = (s.withColumn("measurement_time", X.parse_utc("measurement_time"))
          .withColumn("value", X.nan_to_null("value")))
    return s.withColumn("quality_score", X.quality_score("parameter", "value"))


def event_time(df: DataFrame, col: str = "measurement_time", out: str = "event_time") -> DataFrame:
    """NTZ -> TIMESTAMP for watermarking (UTC session: same wall clock)."""
    return df.withColumn(out, F.col(col).cast("timestamp"))


def _checkpoint(spark: SparkSession, checkpoint: str | None, label: str) -> str:
    return checkpoint or scratch_path(spark, f"stream-{label}")


def _table_identity(files: Files) -> str:
    """What tells this table from an earlier one at its path; written once, within the table's folder."""
    name = "_identity"
    if not files.exists(name):
        files.write(name, uuid.uuid4().hex)
    return files.read(name)


def _stable_checkpoint(spark: SparkSession, source: str, table_path: str, identity: str) -> str:
    """The same folder below the shared root for the same source and table."""
    name = hashlib.sha256(f"{source.rstrip('/')}|{table_path.rstrip('/')}|{identity}".encode()).hexdigest()[:16]
    return f"{checkpoint_root(spark).rstrip('/')}/ingest-{name}"


TABLE_SCHEMA = T.StructType([
    *[T.StructField(f.name, T.TimestampNTZType()) if f.name == "measurement_time" else f for f in RECORD_SCHEMA],
    T.StructField("quality_score", T.DoubleType()), T.StructField("batch_id", T.LongType()),
    T.StructField("year", T.LongType()), T.StructField("month", T.StringType()),
])
#: Markers of a stream's appends that are kept: only its last batch can come again.
KEPT_MARKERS = 10


def ingest_insert_if_absent(spark: SparkSession, source: str, table_path: str,
                            checkpoint: str | None = None, keys: list[str] | None = None,
                            trigger_available_now: bool = True):
    """O-T1 incremental ingest: each micro-batch keeps valid rows (O-P6),
    anti-joins them against the table on ``keys`` (narrowed to the batch's
    months, a null equal to a null) and appends. Returns the finished (availableNow) query."""
    keys = keys or ["location_id", "sensor_id", "measurement_time", "parameter"]
    stream = P.keep_valid_scored(read_record_stream(spark, source))
    identity = _table_identity(Files(spark, table_path))
    own = checkpoint or _stable_checkpoint(spark, source, table_path, identity)
    markers = Files(spark, f"{table_path.rstrip('/')}_commits/{hashlib.sha256(f'{own}|{identity}'.encode()).hexdigest()[:16]}")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if markers.exists(f"{batch_id:012d}"):
            return  # replay of a batch whose rows are already in the table
        new = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        if path_exists(spark, table_path):
            existing = batch.sparkSession.read.schema(TABLE_SCHEMA).parquet(table_path)
            new = J.insert_if_absent(new, existing, keys, time_col="measurement_time", null_safe=True)
        out = new.withColumn("year", X.year_number("measurement_time")) \
                 .withColumn("month", X.month_text("measurement_time"))
        (out.hint("rebalance", "year", "month")
            .sortWithinPartitions("year", "month", "location_id", "parameter", "measurement_time")
            .write.mode("append").partitionBy("year", "month").parquet(table_path))
        markers.write(f"{batch_id:012d}", own)
        for old in markers.names("")[:-KEPT_MARKERS]:
            markers.delete(old)

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", own)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="15 minutes")
    return w.start()


def dedupe_stream(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """O-T2 bounded-state dedup on ``keys`` within the watermark delay. A key
    that returns after the watermark is admitted again; rows later than the
    watermark are dropped (the reference would insert them)."""
    s = event_time(stream).withWatermark("event_time", delay)
    return s.dropDuplicatesWithinWatermark(keys)


def hourly_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """O-T3 tumbling hourly aggregate with a watermark (append mode: a window
    is emitted once the watermark passes its end). The batch O-A12 over the
    table remains the correction path for rows later than the watermark."""
    s = event_time(stream).withWatermark("event_time", delay)
    g = s.groupBy("location_id", "parameter", F.window("event_time", "1 hour").alias("w")).agg(
        F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.stddev_samp("value").alias("std_value"),
        F.count("value").alias("count"), F.avg("quality_score").alias("avg_quality"))
    return g.select("location_id", "parameter", F.col("w.start").cast("timestamp_ntz").alias("hour"),
                    "avg_value", "min_value", "max_value", "std_value", "count", "avg_quality")


def close_hours(emitted: DataFrame, table: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """The correction path of O-T3: what the stream emitted for hours before ``since``, and a batch O-A12 over
    the table from there on. ``correction_start`` gives ``since``: the first hour that the stream left open
    or that got a row later than the watermark, so the hours before are final and the table is read from
    that time only (a range on its time, which prunes months and row groups). ``None`` computes all hours."""
    if since is None:
        return A.hourly(table).select(*emitted.columns)
    first = F.lit(since).cast("timestamp_ntz")
    rest = A.hourly(table.where(F.col("measurement_time") >= first)).select(*emitted.columns)
    return emitted.where(F.col("hour") < first).unionByName(rest)


def _event_times(query) -> tuple[dt.datetime | None, dt.datetime | None]:
    """(the last watermark, the earliest event time that was behind the watermark of its batch)."""
    parse = lambda x: dt.datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None)
    mark, late = None, None
    for p in query.recentProgress:
        times = (p if isinstance(p, dict) else json.loads(p.json)).get("eventTime") or {}
        if "watermark" in times:
            mark = max(filter(None, (mark, parse(times["watermark"]))))
        if "min" in times and mark is not None and parse(times["min"]) < mark:
            late = min(filter(None, (late, parse(times["min"]))))
    return mark, late


def _note_event_times(spark: SparkSession, path: str, query) -> None:
    """Keeps, beside an hourly table, its last watermark and the earliest late time since its last correction."""
    mark, late = _event_times(query)
    files = Files(spark, f"{path.rstrip('/')}_times")
    known = json.loads(files.read("now")) if files.exists("now") else {"watermark": None, "late": None}
    as_text = lambda pick, a, b: pick(x for x in (a, b and b.isoformat()) if x) if a or b else None
    files.write("now", json.dumps({"watermark": as_text(max, known["watermark"], mark), "late": as_text(min, known["late"], late)}))


def correction_start(spark: SparkSession, path: str) -> dt.datetime | None:
    """The hour from which ``close_hours`` has work for the hourly table at ``path``: that of its last watermark,
    or of an earlier late row. ``None`` where no run of the stream has noted its times."""
    files = Files(spark, f"{path.rstrip('/')}_times")
    if not files.exists("now"):
        return None
    known = json.loads(files.read("now"))
    times = [dt.datetime.fromisoformat(x) for x in (known["watermark"], known["late"]) if x]
    return min(times).replace(minute=0, second=0, microsecond=0) if known["watermark"] else None


def corrected(spark: SparkSession, path: str) -> None:
    """Notes that the late rows so far are part of a correction that was stored."""
    files = Files(spark, f"{path.rstrip('/')}_times")
    if files.exists("now"):
        files.write("now", json.dumps(json.loads(files.read("now")) | {"late": None}))


def latest_stream(stream: DataFrame) -> DataFrame:
    """O-T4 continuously current latest trusted row per (location, parameter):
    ``max_by`` state, one row per key (update/complete mode)."""
    return W.latest_measurements(stream)


def feed_stream(stream: DataFrame, kind: str = "measurement") -> DataFrame:
    """O-T5 feed of new measurements as JSON envelopes {type, data, timestamp}."""
    data = F.struct("location_id", "location", "parameter", "value", "unit",
                    F.col("measurement_time").cast("string").alias("measurement_time"))
    env = F.struct(F.lit(kind).alias("type"), data.alias("data"),
                   F.current_timestamp().cast("string").alias("timestamp"))
    return stream.select(F.to_json(env).alias("value"))


def alert_stream(stream: DataFrame, min_band: int = 3) -> DataFrame:
    """O-T6 threshold alerts: a known parameter out of its range (score 0),
    or a particulate whose AQI band index is >= ``min_band`` (0 = Good). The
    rule is ours; the reference defines only the envelope."""
    bands = fixed.AQI_BREAKPOINTS
    v = F.col("value")
    idx = None
    for i, b in enumerate(bands):
        cond = (v >= b[0]) & (v <= b[1])
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    band = idx.otherwise(F.lit(len(bands) - 1))
    particulate = F.col("parameter").isin("pm25", "pm10")
    out_of_range = F.col("quality_score") == F.lit(0.0)
    hit = out_of_range | (particulate & v.isNotNull() & (band >= min_band))
    return (stream.where(hit)
            .withColumn("alert", F.when(out_of_range, F.lit("out_of_range"))
                        .otherwise(F.lit("aqi_band")))
            .withColumn("aqi_category", F.when(particulate, X.aqi_category(v))))


def run_to_table(df: DataFrame, path: str, mode: str = "append",
                 checkpoint: str | None = None, label: str = "sink", keys: list[str] | None = None):
    """Run a streaming frame to a Parquet folder (append) or, for update/complete
    aggregates, publish each batch to the keyed table at ``path`` (``snapshots``).
    An append of windows also notes its event times, for ``correction_start``."""
    spark = df.sparkSession
    ck = _checkpoint(spark, checkpoint, label)
    if mode == "append":
        w = df.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        if mode == "update" and not keys:
            raise ValueError("update mode needs the key columns")

        def publish(batch: DataFrame, batch_id: int) -> None:
            snapshots.publish(batch, batch_id, path, keys or [], complete=mode == "complete", owner=ck)
        w = df.writeStream.foreachBatch(publish).outputMode(mode)
    q = w.option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append" and "hour" in df.columns:
        _note_event_times(spark, path, q)
    return q


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The keyed table as the newest batch that ``run_to_table`` published in
    update or complete mode left it."""
    return snapshots.read(spark, path)


def staleness_on_refresh(latest_table: DataFrame, hours: int = fixed.QUALITY_STALE_HOURS) -> DataFrame:
    """O-T7 stale locations over the continuously maintained latest table
    (a scheduled batch; no processing-time timers needed)."""
    return Q.stale_locations(latest_table, "location", "measurement_time", hours)


def _publish(spark: SparkSession, stage: str, path: str) -> None:
    """Moves the files of a finished write below ``path``, in the order of their names. Each gets a later
    modification time than all before it, by a second, which the coarsest file systems tell apart; where
    times can't be set, a file has that of its move."""
    files = Files(spark, path)
    seen = [s.getModificationTime() for s in files.fs.listStatus(files.path(path)) if s.isFile()]
    last = max(seen, default=0)
    for name in Files(spark, stage).names(""):
        if name.startswith("part-"):
            to = files.path(f"{files.root}/{name}")
            if not files.fs.rename(files.path(f"{stage}/{name}"), to):
                raise OSError(f"could not publish {name} below {path}")
            last = max(last + 1000, files.fs.getFileStatus(to).getModificationTime())
            files.fs.setTimes(to, last, -1)
    files.fs.delete(files.path(stage), True)


def land_records(df: DataFrame, path: str, n_files: int = 4) -> None:
    """Land flat records as JSON lines in ``n_files`` arrivals, oldest first. An
    arrival has as many files as its size asks for, each a range of its time.

    The file source processes files in modification-time order, and a batch may end
    within an arrival: so the files of an arrival, too, are published in the order of
    their times. Arrival order is event-time order file by file, as it is for a
    collector landing files every period, and no batch is behind the watermark of one
    before it."""
    out = df.select(*[f.name for f in RECORD_SCHEMA.fields if f.name != "measurement_time"],
                    F.col("measurement_time").alias("_t"),
                    F.date_format(F.col("measurement_time").cast("timestamp"),
                                  "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("measurement_time"))
    out = written_once(out, "records")
    bounds = out.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).first()
    if bounds["lo"] is None:
        return
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) / n_files
    for i in range(n_files):
        start = lo + step * i
        cond = F.col("_t") >= F.lit(start)
        if i + 1 < n_files:
            cond = cond & (F.col("_t") < F.lit(lo + step * (i + 1)))
        stage = f"{path.rstrip('/')}/_arrival-{uuid.uuid4().hex[:12]}"  # hidden from readers by its name
        out.where(cond).repartitionByRange("_t").drop("_t").write.json(stage)
        _publish(out.sparkSession, stage, path)
