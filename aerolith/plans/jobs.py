"""Composite jobs (O-C1 .. O-C9) and the view registry (O-K10, O-K11).

Each job is a short composition of operators; every stage reports metrics
through ``Observation`` (O-A27) rather than extra counting jobs.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import scalars as X
from aerolith.operators import aggregates as A
from aerolith.operators import joins as J
from aerolith.operators import latest as W
from aerolith.operators import predicates as P
from aerolith.operators import quality as Q
from aerolith.session import written_once
from aerolith.sources import archive as SA
from aerolith.sources import payloads as SP
from aerolith.sources import sinks as K


def archive_backfill(spark: SparkSession, archive_base: str, location_map: str, start: str,
                     end: str, fact_path: str, map_whole_file: bool = True, strict_map: bool = True,
                     rejects_path: str | None = None) -> dict:
    """O-C1 location map -> partition selection -> scan -> append, the archive parsed once.

    The result's ``lines`` counts every line read, and ``appended`` (of which ``without_time`` have an
    empty time), ``corrupt_lines`` and ``outside`` add up to it. ``missing_partitions`` are those asked
    for and absent. A location map that is broken raises; with ``strict_map=False`` its broken objects
    are named in ``rejected_map_shards`` and the rest is loaded. Lines that do not parse are kept below
    ``rejects_path`` where that is given."""
    ids = SP.read_location_map(spark, location_map, whole_file=map_whole_file, strict=strict_map).select("location_id")
    ids = written_once(ids, "location-ids")
    shards = [] if strict_map else [r["file_path"] for r in SP.rejected_map_shards(spark, location_map, map_whole_file)
                                    .select("file_path").distinct().orderBy("file_path").limit(NAMED_SHARDS).collect()]
    files = SA.listed_files(spark, archive_base)
    lines = SA.tagged_lines(spark, archive_base, ids, start, end, files)
    if rejects_path is not None:  # two sinks take the lines; an archive of many small files costs most to read
        lines = written_once(lines.hint("rebalance"), "archive-lines")
    found = K.append_archive(lines, fact_path)
    if rejects_path is not None and found["corrupt_lines"]:
        SA.rejected_lines(lines).write.mode("append").parquet(rejects_path)
    missing = SA.missing_partitions(spark, archive_base, ids, start, end, files)
    return {**found, "missing_partitions": missing, "rejected_map_shards": shards}


#: Files with broken location map objects that a load names; ``rejected_map_shards`` has all.
NAMED_SHARDS = 100


def presentation_gen1(raw: DataFrame) -> dict[str, DataFrame]:
    """O-C2 gen 1 presentation views in dependency order."""
    valid = P.valid_readings(raw)
    return {
        "presentation.air_quality": valid,
        "presentation.latest_param_values_per_location": W.latest_pivot_sql(raw),
        "presentation.daily_air_quality_stats": A.daily_stats_sql(raw),
    }


def presentation_gen2(m: DataFrame, locations: DataFrame) -> dict[str, DataFrame]:
    """O-C7 tail / O-K10 gen 2 presentation views."""
    return {
        "presentation.latest_measurements": W.latest_measurements(m),
        "presentation.daily_aggregates": A.daily_aggregates(m),
        "presentation.location_summary": A.location_summary(locations, m),
    }


def monthly_views(root: str) -> dict[str, K.MonthlyView]:
    """O-C7 / O-K10 the gen 2 view whose rows belong to a month, stored below ``root``."""
    path = f"{root.rstrip('/')}/presentation/daily_aggregates"
    return {"presentation.daily_aggregates": K.MonthlyView("presentation.daily_aggregates", A.daily_aggregates, path)}


def register_views(spark: SparkSession, views: dict[str, DataFrame]) -> list[str]:
    """O-K11 register views in their (dependency) order."""
    return K.build_views(spark, [(name, (lambda df=df: df)) for name, df in views.items()])


def live_collection(spark: SparkSession, metadata_path: str, latest_path: str,
                    fact_path: str | None = None, dry_run: bool = False,
                    multiline: bool = True) -> tuple[DataFrame, dict]:
    """O-C3 metadata + latest payloads -> sensor join -> fact rows ->
    insert-if-absent. ``dry_run`` returns the rows without writing. Each payload is
    parsed once. The second result counts rows inserted (observed at the write),
    documents that could not be read, and records with a field set to null or
    without a usable key or time (O-E3)."""
    metadata = SP.landing(spark, "metadata", metadata_path, multiline, once=True)
    latest = SP.landing(spark, "latest", latest_path, multiline, once=True)
    rows = SP.payload_to_raw_rows(SP.latest_rows(spark, latest), SP.sensor_lookup(spark, metadata),
                                  SP.location_metadata(spark, metadata))
    seen = [metadata.counts(), latest.counts()]
    stats = {"inserted": None, "failed_documents": sum(c["failed_documents"] for c in seen),
             "repaired_records": sum(c["repaired"] for c in seen), "rejected_records": sum(c["rejected"] for c in seen)}
    if not dry_run and fact_path is not None:
        stats["inserted"] = K.insert_live_rows(spark, rows, fact_path)
    return rows, stats


def location_sync(spark: SparkSession, listing_path: str, locations: DataFrame, out_path: str,
                  country: str | None = None, city: str | None = None,
                  limit: int | None = None, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """O-C4 listing -> validation -> flatten -> classify (added/updated/errors) ->
    upsert written copy-on-write. Returns (counts by status, new dimension). A
    listing without any usable record raises; records without an id are counted
    as errors and left out, documents that could not be read as failed_documents,
    records whose id is none or that are no object as rejected_records."""
    docs = SP.landing(spark, "locations", listing_path, multiline, once=True)
    listing = SP.locations_listing(spark, docs, country, city, limit)
    check = P.validate_required(listing, "location_id").first()
    if check["n_rows"] == check["n_missing"]:
        raise ValueError("location listing failed validation")
    seen = docs.counts()
    counts = J.sync_counts(listing, locations)
    lost = [(name, n) for name, n in (("failed_documents", seen["failed_documents"]), ("rejected_records", seen["rejected"])) if n]
    if lost:
        counts = counts.unionByName(spark.createDataFrame(lost, counts.schema))
    new_dim = K.load_locations(spark, listing.where(F.col("location_id").isNotNull()), locations, out_path)
    return counts, new_dim


def measurement_collection(spark: SparkSession, payload_path: str, table_path: str,
                           date_from=None, date_to=None, now: dt.datetime | None = None,
                           multiline: bool = True) -> dict:
    """O-C6 measurement payloads (default: the last 24 hours before ``now``)
    -> transform (O-C5) -> insert ignoring conflicts -> metrics (O-A27): records and
    documents of every step, start and end of the run. The payloads are parsed once.

    ``records`` of the documents read = ``extracted`` + ``outside`` (of the range) + ``rejected``;
    ``extracted`` = ``transformed`` + ``filtered``; ``transformed`` = ``loaded`` + ``skipped``.
    ``repaired`` records had a field set to null; ``errors`` are documents that could not be read."""
    started = dt.datetime.now(dt.timezone.utc)
    if date_from is None or date_to is None:
        now = now or dt.datetime.utcnow()
        date_from, date_to = now - dt.timedelta(days=1), now
    docs = SP.landing(spark, "measurements", payload_path, multiline, once=True)
    seen = docs.counts()
    scored = SP.measurement_records(SP.measurement_rows(docs.rows()), keep=False)
    v = F.col("value")
    inside = P.optional_filters(date_from=date_from, date_to=date_to)
    keep = inside & v.isNotNull() & (v >= 0) & (F.col("quality_score") > 0)
    scored, obs = Q.observed(scored, "extracted", inside=F.count(F.when(inside, F.lit(1))), kept=F.count(F.when(keep, F.lit(1))))
    recs = P.keep_valid_scored(scored.where(inside)).withColumn("id", natural_id())
    res = K.load_measurements(spark, recs, table_path)
    m = Q.metrics(obs)
    rows, extracted, kept = (int(m.get(k) or 0) for k in ("rows", "inside", "kept"))
    return {"records": seen["records"], "rejected": seen["rejected"], "repaired": seen["repaired"], "outside": rows - extracted,
            "extracted": extracted, "transformed": kept, "filtered": extracted - kept,
            "loaded": res["inserted"], "skipped": res["skipped"], "months": res["months"], "errors": seen["failed_documents"],
            "started": started, "ended": dt.datetime.now(dt.timezone.utc)}


def natural_id():
    """Id value of a measurement: hash of its natural key (the reference declares
    ``id`` but never sets it). Rows are matched on the key itself, not on this."""
    keys = K.NATURAL_KEYS
    return F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])  # a hash alone skips nulls


def full_pipeline(spark: SparkSession, listing_path: str, payload_path: str, root: str,
                  locations: DataFrame, date_from, date_to, multiline: bool = True) -> dict:
    """O-C7 tables -> location sync -> measurement collection -> views. The new
    dimension goes to a path of its own per run (copy-on-write)."""
    tables = K.initialize_tables(spark, root)
    out = f"{root.rstrip('/')}/staging/locations-{uuid.uuid4().hex[:12]}"
    counts, dim = location_sync(spark, listing_path, locations, out, multiline=multiline)
    stats = measurement_collection(spark, payload_path, tables["raw.measurements"], date_from, date_to,
                                   multiline=multiline)
    m = K.read_table(spark, "raw.measurements", tables["raw.measurements"])
    names = register_views(spark, presentation_gen2(m, dim))
    return {"sync": counts, "collection": stats, "views": names}


def quality_report(raw: DataFrame) -> dict[str, DataFrame]:
    """O-C8 profile + valid counts per parameter + top locations."""
    clean = P.load_readings(raw)
    return {"profile": Q.quality_profile(raw),
            "parameter_counts": A.counts_by_parameter(clean).orderBy("parameter"),
            "location_counts": A.top_locations_by_count(clean)}


def map_layer(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-C9 latest wide rows with coordinates, marker size, and the centre."""
    wide = P.with_coordinates(W.latest_wide(raw), "lat", "lon")
    pts = wide.withColumn("marker_size", X.clip_lower("aqi", 1.0))
    return pts, A.map_center(wide, "lat", "lon")
