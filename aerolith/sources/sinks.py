"""Sinks, writes and views (O-K1 .. O-K13).

Writes are distributed: every task writes its own files and the job commits
them. Appends to a fact are partitioned by year/month behind a ``rebalance``
hint, so AQE splits a hot partition over several tasks and merges small
ones (no one-task-per-partition bottleneck, no small-file storm). Replacing
a table is copy-on-write into a new path; a path being read is never
overwritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.functions import fixed
from aerolith.functions import scalars as X
from aerolith.operators import joins as J
from aerolith.operators import predicates as P
from aerolith.operators import quality as Q
from aerolith.session import path_exists, written_once
from aerolith.sources import archive as SA


# ------------------------------------------------------------------ fact appends
GEN1_FACT_ORDER = ("location_id", "parameter", "datetime")
GEN2_FACT_ORDER = ("location_id", "parameter", "measurement_time")


def append_partitioned(df: DataFrame, path: str, partition_by=("year", "month"),
                       fmt: str = "parquet", sort_within: tuple[str, ...] | None = None) -> dict:
    """O-K1 append rows partitioned by year/month; returns the observed row
    count of the write (O-A26). The observation sits above the rebalance
    exchange, so it reports 0 for an empty write instead of being folded
    away with the empty stage. ``sort_within`` orders each task's rows (no
    extra shuffle) so Parquet row-group statistics can skip by those keys."""
    out = df.hint("rebalance", *partition_by)
    if sort_within:
        out = out.sortWithinPartitions(*partition_by, *sort_within)
    out, obs = Q.observed(out, "appended")
    out.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)
    return obs.get


def append_archive(tagged: DataFrame, path: str) -> dict[str, int]:
    """O-K1 append the stored rows of ``archive.tagged_lines`` and count all of its lines on the same pass:
    the counts sit above the exchange, in the tasks that write, so a task that is run again counts once.
    Returns lines, appended, without_time, corrupt_lines and outside."""
    by = {s: F.count(F.when(F.col("line_status") == s, F.lit(1))) for s in (SA.STORED, SA.WITHOUT_TIME, SA.UNPARSABLE, SA.OUTSIDE)}
    dealt, obs = Q.observed(tagged.hint("rebalance", "year", "month"), "lines", **by)
    rows = dealt.where(F.col("line_status").isin(SA.STORED, SA.WITHOUT_TIME)).drop("line_status", SA.CORRUPT)
    (rows.sortWithinPartitions("year", "month", *GEN1_FACT_ORDER)
         .write.mode("append").partitionBy("year", "month").parquet(path))
    m = {k: int(Q.metrics(obs).get(k) or 0) for k in ("rows", *by)}
    return {"lines": m["rows"], "appended": m[SA.STORED] + m[SA.WITHOUT_TIME], "without_time": m[SA.WITHOUT_TIME],
            "corrupt_lines": m[SA.UNPARSABLE], "outside": m[SA.OUTSIDE]}


def append_plain(df: DataFrame, path: str, fmt: str = "parquet",
                 sort_within: tuple[str, ...] | None = None) -> dict:
    """Append without partition columns (rebalanced), observed like above."""
    out = df.hint("rebalance")
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    out, obs = Q.observed(out, "appended")
    out.write.mode("append").format(fmt).save(path)
    return obs.get


#: What makes two measurements the same one.
NATURAL_KEYS = ("location_id", "sensor_id", "parameter", "measurement_time")


def insert_live_rows(spark: SparkSession, rows: DataFrame, fact_path: str,
                     keys: list[str] | None = None, time_col: str = "datetime") -> int:
    """O-K2 insert rows absent from the fact on the four keys; returns the
    number inserted (observed while writing, no second count).

    The existing fact is narrowed to the batch's months (its partitions) before
    the joins; the batch is computed once (see ``insert_if_absent``)."""
    keys = keys or J.GEN1_INSERT_KEYS
    new = rows
    if path_exists(spark, fact_path):
        fact = spark.read.schema(schemas.RAW_AIR_QUALITY).parquet(fact_path)
        new = J.insert_if_absent(rows, fact, keys, time_col=time_col)
    new = new.select(*[c.name for c in schemas.RAW_AIR_QUALITY.fields])
    return int(append_partitioned(new, fact_path, sort_within=GEN1_FACT_ORDER).get("rows", 0))


def load_measurements(spark: SparkSession, batch: DataFrame, table_path: str,
                      keys: tuple[str, ...] = NATURAL_KEYS, time_col: str = "measurement_time") -> dict:
    """O-K3 insert, ignore conflicts on the primary key; reports inserted and
    skipped separately (the reference counted attempts), and the ``months`` of
    the batch, which are those that a view needs refreshed.

    Rows are told apart by the natural key columns themselves, a null equal to
    a null: the stored ``id`` is a hash and only a value. The table is
    partitioned by year and month and narrowed to the batch's months."""
    once = written_once(batch, "load")
    total = once.count()
    unique = J.dedupe_on_key(once, list(keys))  # a key repeated in the batch is skipped like any other conflict
    new = unique
    if path_exists(spark, table_path):
        target = spark.read.schema(schemas.MEASUREMENTS).parquet(table_path)
        new = J.insert_if_absent(unique, target, list(keys), time_col=time_col, null_safe=True)
    fields = [F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name)
              for f in schemas.MEASUREMENTS.fields]
    dated = new.select(*fields, X.year_number(time_col).alias("year"), X.month_text(time_col).alias("month"))
    inserted = int(append_partitioned(dated, table_path, sort_within=GEN2_FACT_ORDER).get("rows", 0))
    return {"inserted": inserted, "skipped": total - inserted, "months": J.stage_months(once, time_col)}


def load_locations(spark: SparkSession, listing: DataFrame, target: DataFrame,
                   out_path: str) -> DataFrame:
    """O-K4 flatten a listing then upsert into the dimension, written to a new
    path (copy-on-write); returns the new dimension read back."""
    flat = P.flatten_coordinates(listing) if "coordinates" in listing.columns else listing
    flat = flat.withColumn("is_active", F.lit(True))
    up = J.upsert(target, flat, ["location_id"])
    up.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


# ------------------------------------------------------------------ exports
TEXT_TIME_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
def export_slice(m: DataFrame, location_id=None, parameter=None, date_from=None, date_to=None,
                 max_rows: int | None = fixed.EXPORT_MAX_ROWS) -> DataFrame:
    """O-K8 trusted rows with optional filters, newest first, id as tie-break;
    at most ``max_rows`` (``TakeOrderedAndProject``), all with ``None``.
    ``export_truncated`` tells whether the cap leaves rows out."""
    cols = ["location_id", "location", "latitude", "longitude", "parameter", "unit", "value",
            "measurement_time", "quality_score"]
    pred = P.optional_filters(location_id, parameter, date_from, date_to)
    rows = P.trusted(m).where(pred).orderBy(F.col("measurement_time").desc(), F.col("id").desc())
    return (rows if max_rows is None else rows.limit(max_rows)).select(*cols)


def export_truncated(m: DataFrame, location_id=None, parameter=None, date_from=None, date_to=None,
                     max_rows: int = fixed.EXPORT_MAX_ROWS) -> DataFrame:
    """O-K8 one row (matching, exported, truncated): what a capped export leaves out."""
    pred = P.optional_filters(location_id, parameter, date_from, date_to)
    return (P.trusted(m).where(pred).agg(F.count(F.lit(1)).alias("matching"))
            .select("matching", F.least("matching", F.lit(max_rows).cast("long")).alias("exported"),
                    (F.col("matching") > max_rows).alias("truncated")))


def export(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> str:
    """O-K5 .. O-K7 CSV with header / JSON lines / Parquet, written by the
    executors; unsupported formats raise like the reference."""
    if fmt not in fixed.EXPORT_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.write.mode(mode)
    if fmt in ("csv", "json"):
        # text formats default to milliseconds: keep the full microseconds
        w = w.options(**TEXT_TIME_OPTIONS)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def read_export(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    r = spark.read.options(**TEXT_TIME_OPTIONS) if fmt in ("csv", "json") else spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def download_name(location: str, parameter: str, start: str, end: str) -> str:
    """O-K9 / O-F14 file name of a dashboard download (driver-side text)."""
    slug = location.lower().replace(" ", "_").replace("/", "_")
    return f"air_quality_{slug}_{parameter}_{start}_to_{end}.csv"


def dashboard_download(daily: DataFrame, path: str, location: str, parameter: str,
                       start: str, end: str) -> str:
    """O-K9 daily stats for one location/parameter/date range to CSV."""
    sl = P.daily_slice(daily, location, parameter, start, end)
    return export(sl, path, "csv")


# ------------------------------------------------------------------ views / tables
def create_view(spark: SparkSession, name: str, df: DataFrame, materialize_path: str | None = None) -> DataFrame:
    """O-K10 create or replace a named view; with ``materialize_path`` the
    result is written once and the view reads the written copy."""
    if materialize_path:
        df.write.mode("overwrite").parquet(materialize_path)
        df = spark.read.parquet(materialize_path)
    df.createOrReplaceTempView(name.replace(".", "_"))
    return df


@dataclass(frozen=True)
class MonthlyView:
    """O-K10 a materialised view whose every row belongs to one month of the fact: ``build`` makes it from fact
    rows, ``fact_time`` is their time and ``view_time`` the view's. It is stored by year and month, so that
    ``refresh`` computes and replaces the months that a load touched, and reads no other."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    path: str
    fact_time: str = "measurement_time"
    view_time: str = "measurement_date"

    def _dated(self, fact: DataFrame) -> DataFrame:
        return self.build(fact).withColumn("year", X.year_number(self.view_time)).withColumn("month", X.month_text(self.view_time))

    def create(self, fact: DataFrame) -> DataFrame:
        """All months, written and registered. Rows whose time is null have no month and are left out."""
        self._dated(fact.where(F.col(self.fact_time).isNotNull())).hint("rebalance", "year", "month") \
            .write.mode("overwrite").partitionBy("year", "month").parquet(self.path)
        return self.open(fact)

    def refresh(self, fact: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
        """The listed (year, month) anew; partitions of other months are neither read nor written."""
        if months:
            some = J.in_months(fact, self.fact_time, months)
            self._dated(some).hint("rebalance", "year", "month").write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(self.path)
        return self.open(fact)

    def open(self, fact: DataFrame) -> DataFrame:
        """The stored view, registered under its name."""
        df = fact.sparkSession.read.schema(self._dated(fact).schema).parquet(self.path)
        df = df.select(*self.build(fact).columns)
        df.createOrReplaceTempView(self.name.replace(".", "_"))
        return df


def build_views(spark: SparkSession, builders: list[tuple[str, Callable[[], DataFrame]]]) -> list[str]:
    """O-K11 build views in the given (dependency) order; returns the names."""
    names = []
    for name, build in builders:
        create_view(spark, name, build())
        names.append(name.replace(".", "_"))
    return names


TABLES = {
    "raw.air_quality": (schemas.RAW_AIR_QUALITY, ["year", "month"]),
    "raw.measurements": (schemas.MEASUREMENTS, ["year", "month"]),
    "staging.locations": (schemas.LOCATIONS, []),
    "staging.sensors": (schemas.SENSORS, []),
}


def initialize_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """O-K12 namespaces and empty typed tables as Parquet folders under
    ``root``: raw.air_quality, raw.measurements, staging.locations,
    staging.sensors. Existing tables are left alone. Read them back with
    ``read_table`` (explicit schema; an empty partitioned table has no
    files to take a schema from)."""
    out = {}
    for name, (schema, parts) in TABLES.items():
        path = f"{root.rstrip('/')}/{name.replace('.', '/')}"
        if not path_exists(spark, path):  # proven absent; any storage fault raises
            empty = schemas.empty_frame(spark, schema)
            for p, kind in (("year", "long"), ("month", "string")):
                if p in parts and p not in empty.columns:
                    empty = empty.withColumn(p, F.lit(None).cast(kind))
            w = empty.write.mode("errorifexists")
            if parts:
                w = w.partitionBy(*parts)
            w.parquet(path)
        out[name] = path
    return out


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """O-S10 table scan with the fixed schema of ``name`` (partition columns that
    are not part of it are left out)."""
    schema = TABLES[name][0]
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def dated_schema(name: str):
    """The schema of the table ``name`` with its partition columns, by which a reader prunes."""
    schema, parts = TABLES[name]
    for p, kind in (("year", "long"), ("month", "string")):
        if p in parts and p not in schema.fieldNames():
            schema = type(schema)([*schema.fields]).add(p, kind)
    return schema


def first_existing_table(spark: SparkSession, candidates: list[str]) -> str:
    """O-S11 the first of ``candidates`` that exists in the catalog."""
    for name in candidates:
        if spark.catalog.tableExists(name):
            return name
    raise RuntimeError(f"No table found among {candidates}")


def write_location_map(locations: DataFrame, path: str, shard_size: int = 1000) -> None:
    """O-K13 the location map as JSON objects id -> name, one object per
    line. Ids are sharded by ``location_id div shard_size`` so no object (one
    group) holds more than ``shard_size`` entries of a unique key; the
    reference's single map is the case of fewer than ``shard_size`` ids."""
    pairs = locations.select(F.col("location_id").cast("string").alias("k"), F.col("name").alias("v"),
                             F.floor(F.col("location_id") / F.lit(shard_size)).alias("_shard"))
    shards = pairs.groupBy("_shard").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    shards.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def write_location_rows(locations: DataFrame, path: str) -> None:
    """O-K13 row form (JSON lines, splittable) for any size."""
    locations.select("location_id", "name").write.mode("overwrite").json(path)
