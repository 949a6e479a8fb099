"""Joins and set-oriented dimension mutations (O-J1 .. O-J9, O-M1 .. O-M3).

Only equi-joins. No side is forced into a broadcast unless its size is fixed
by construction (a literal lookup table); dimension and batch sides become
broadcasts through AQE once their runtime size is known to be under the
threshold, and stay shuffle joins (with skew splitting) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import scalars as X
from aerolith.session import small_side, written_once

GEN1_INSERT_KEYS = ["location_id", "sensors_id", "datetime", "parameter"]


def insert_if_absent(stage: DataFrame, fact: DataFrame, keys: list[str] | None = None,
                     time_col: str | None = "auto", dedupe_batch: bool = False,
                     null_safe: bool = False) -> DataFrame:
    """O-J1 stage rows with no match in ``fact`` on ``keys`` (NOT EXISTS).

    NULL keys never match, so such rows are always inserted (T15), unless
    ``null_safe``. With ``time_col`` the fact is first narrowed to the months
    that the stage holds (``stage_months``): literals that prune partitions and
    row groups, so one old row opens its own month and not all since. The
    stage's keys are written once; counted and small, they are broadcast and
    the fact is filtered where it is scanned. Larger, the narrowed fact is
    shuffled by the keys. The anti-join runs against at most |stage| keys.
    ``dedupe_batch`` additionally keeps one row per key inside the batch.
    ``time_col='auto'`` narrows by the first timestamp-typed key (a row can only
    match a fact row with the same time); ``None`` anti-joins the full fact.
    """
    keys = keys or GEN1_INSERT_KEYS
    if time_col == "auto":
        types = dict(stage.dtypes)
        time_col = next((k for k in keys if types.get(k, "").startswith("timestamp")), None)
    s = dedupe_on_key(stage, keys) if dedupe_batch else stage  # deterministic row per key
    fk = fact.select(*keys)
    if time_col is not None:
        s = written_once(s, "stage")
        months = stage_months(s, time_col)
        if not months and not null_safe:  # no stage row has a time: none can match
            return s
        fk = in_months(fact, time_col, months, null_safe).select(*keys)
        fk = _matching(fk, small_side(s.select(*keys).distinct(), "stage-keys"), keys, "left_semi", null_safe)
    return _matching(s, fk, keys, "left_anti", null_safe)


def stage_months(stage: DataFrame, time_col: str) -> list[tuple[int, int]]:
    """The distinct (year, month) of a batch's times, in order."""
    t = F.col(time_col)
    rows = stage.where(t.isNotNull()).select(F.year(t).alias("y"), F.month(t).alias("m")).distinct().collect()
    return sorted((r["y"], r["m"]) for r in rows)


def in_months(fact: DataFrame, time_col: str, months: list[tuple[int, int]], nulls: bool = False) -> DataFrame:
    """Fact rows of the listed months: a time range per run of months (it skips row
    groups) and, where the fact has them, its year/month partition columns."""
    runs: list[list[int]] = []
    for y, m in months:
        k = y * 12 + m - 1
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    first = lambda k: F.lit(f"{k // 12:04d}-{k % 12 + 1:02d}-01").cast("timestamp_ntz")
    keep = F.col(time_col).isNull() if nulls else F.lit(False)
    for lo, hi in runs:
        inside = (F.col(time_col) >= first(lo)) & (F.col(time_col) < first(hi))
        if {"year", "month"} <= set(fact.columns):
            ix = F.col("year").cast("long") * 12 + F.col("month").cast("long") - 1
            inside = inside & (ix >= lo) & (ix < hi)
        keep = keep | inside
    return fact.where(keep)


def _matching(left: DataFrame, right: DataFrame, keys: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, keys, how)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"_r_{k}"])
    return left.join(r, cond, how)


def lookup_sensors(rows: DataFrame, sensors: DataFrame, key: str = "sensor_id",
                   order: list[str] | None = None) -> DataFrame:
    """O-J3 inner lookup of sensor metadata; a duplicated sensor id keeps one
    deterministic row (max of ``order``, default all columns) first."""
    other = [c for c in sensors.columns if c != key]
    ordcols = order or other
    dedup = (sensors.groupBy(key)
             .agg(F.max_by(F.struct(*[F.col(c) for c in other]),
                           F.struct(*[F.col(c) for c in ordcols])).alias("_s"))
             .select(key, *[F.col(f"_s.{c}").alias(c) for c in other]))
    return rows.join(dedup, key, "inner")


def attach_location_name(m: DataFrame, locations: DataFrame, name_col: str = "name",
                         out: str = "location") -> DataFrame:
    """O-J9 location name from the dimension, else the id as text."""
    # metadata is landed again by every poll: one name per id, or rows would multiply
    l = locations.groupBy("location_id").agg(F.max(name_col).alias("_name"))
    return (m.join(l, "location_id", "left")
            .withColumn(out, X.name_or_id("_name", "location_id")).drop("_name"))


def classify_existing(incoming: DataFrame, existing: DataFrame,
                      key: str = "location_id") -> DataFrame:
    """O-J5 incoming record already present? -> 'updated' else 'added'; a record
    without its key cannot be stored and is 'errors'. Returns the incoming rows
    with ``sync_status`` (one left join, no N+1)."""
    ek = existing.select(F.col(key).alias("_ek")).distinct()
    return (incoming.join(ek, incoming[key] == ek["_ek"], "left")
            .withColumn("sync_status", F.when(F.col(key).isNull(), F.lit("errors"))
                        .when(F.col("_ek").isNull(), F.lit("added"))
                        .otherwise(F.lit("updated"))).drop("_ek"))


def sync_counts(incoming: DataFrame, existing: DataFrame, key: str = "location_id") -> DataFrame:
    """O-J5 counts per status (one row per status present)."""
    return (classify_existing(incoming, existing, key)
            .groupBy("sync_status").agg(F.count(F.lit(1)).alias("n")))


def dedupe_on_key(batch: DataFrame, key: list[str], prefer: list[Column] | None = None) -> DataFrame:
    """One deterministic row per key: the max of ``prefer`` (default: all
    columns), via partial aggregation."""
    other = [c for c in batch.columns if c not in key]
    pref = prefer or [F.col(c) for c in other]
    payload = F.struct(*[F.col(c) for c in other])
    return (batch.groupBy(*key).agg(F.max_by(payload, F.struct(*pref)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in other]))


def insert_ignore_conflict(batch: DataFrame, target: DataFrame, key: list[str],
                           prefer: list[Column] | None = None) -> DataFrame:
    """O-J6 ``ON CONFLICT DO NOTHING``: rows of the batch whose key is not in
    the target, one per key (the primary key holds after the append)."""
    return dedupe_on_key(batch, key, prefer).join(target.select(*key), key, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: list[str],
           prefer: list[Column] | None = None, stamp_col: str | None = "last_updated",
           now: Column | None = None, defaults: dict | None = None) -> DataFrame:
    """O-J7 copy-on-write upsert: target rows whose key is not in the batch,
    plus the (deduplicated) batch with ``stamp_col`` refreshed. The caller
    writes the result to a new path (never over the path being read)."""
    b = dedupe_on_key(batch, key, prefer)
    for c, value in (defaults if defaults is not None else {"is_active": True}).items():
        if c in target.columns:  # a batch that does not say so adds active locations
            b = b.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in b.columns else F.lit(value))
    if stamp_col is not None and stamp_col in target.columns:
        b = b.withColumn(stamp_col, now if now is not None else X.utc_now())
    kept = target.join(b.select(*key), key, "left_anti")
    return kept.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- dimension mutations
def add_locations(target: DataFrame, batch: DataFrame, key: str = "location_id",
                  check: bool = True) -> DataFrame:
    """O-M1 add new locations; ``is_active`` defaults to true. A key already
    present (or repeated in the batch) is an error, like a primary key."""
    b = batch
    if "is_active" in target.columns:
        if "is_active" in b.columns:
            b = b.withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True)))
        else:
            b = b.withColumn("is_active", F.lit(True))
    if "last_updated" in target.columns:
        b = b.withColumn("last_updated", X.utc_now())
    if check:
        clash = b.select(key).join(target.select(key), key, "left_semi")
        repeated = b.groupBy(key).count().where(F.col("count") > 1)
        if not clash.isEmpty() or not repeated.isEmpty():
            raise ValueError("duplicate location key in add_locations")
    return target.unionByName(b, allowMissingColumns=True)


def update_locations(target: DataFrame, changes: DataFrame, key: str = "location_id",
                     stamp_col: str | None = "last_updated", now: Column | None = None) -> DataFrame:
    """O-M2 partial update: only the columns present in ``changes`` are
    replaced on matching keys, the key itself is immutable and ``stamp_col``
    is refreshed; a change set with no columns besides the key is a no-op."""
    cols = [c for c in changes.columns if c != key and c in target.columns]
    if not cols:
        return target
    # a key repeated in the changes keeps one (the largest) change, not one row each
    ch = dedupe_on_key(changes.select(key, *cols), [key]).select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]) \
                .withColumn("_hit", F.lit(True))
    j = target.join(ch, key, "left")
    hit = F.col("_hit").isNotNull()
    out = []
    for c in target.columns:
        if c in cols:
            out.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif stamp_col is not None and c == stamp_col:
            out.append(F.when(hit, now if now is not None else X.utc_now())
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def set_active(target: DataFrame, ids: DataFrame, active: bool, key: str = "location_id",
               now: Column | None = None) -> DataFrame:
    """O-M3 activate / deactivate a set of ids (O-M2 with ``is_active``)."""
    ch = ids.select(key).distinct().withColumn("is_active", F.lit(active))
    return update_locations(target, ch, key, now=now)
