"""A keyed table that a stream keeps current for years (O-T4): deltas, hash buckets, compaction.

Each micro-batch writes the keys that changed as one delta. Keys belong to hash buckets, and
with every batch a few buckets, in turn, are rewritten from their base and the deltas since,
so that after ``ROUNDS`` batches each bucket has a newer base and older deltas are dropped. A
batch thus writes its own rows and 1 / ``ROUNDS`` of the table; a reader meets one base a
bucket and at most ``ROUNDS`` deltas, and takes the newest row of a key.

What is current is named by a state file, one for each batch, written beside the others and
renamed: readers see published states only. The last ``KEPT`` states stay, with all they name,
so that a reader of an older one can finish; everything else below the table's folder, such
as what a batch left that failed before its state, is deleted by the next batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, ROUNDS, KEPT = 16, 8, 3
_BATCH, _BUCKET = "_batch", "_bucket"


class Files:
    """The file system of a path, whichever it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self.path(f"{self.root}/{name}")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: written under another name, then renamed."""
        own = self.path(f"{self.root}/{name}.{uuid.uuid4().hex[:8]}.tmp")
        stream = self.fs.create(own, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self.path(f"{self.root}/{name}"), False)
        if not self.fs.rename(own, self.path(f"{self.root}/{name}")):
            raise OSError(f"could not publish {name} below {self.root}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def _states(files: Files) -> list[str]:
    return [n for n in files.names("states") if n.endswith(".json")]


def _state(files: Files, below: int | None = None) -> dict | None:
    """The newest state, or the newest before ``below``."""
    for name in reversed(_states(files)):
        if below is None or int(name.split(".")[0]) < below:
            return json.loads(files.read(f"states/{name}"))
    return None


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _merged(spark: SparkSession, root: str, state: dict, keys: list[str], only: list[int] | None = None) -> DataFrame | None:
    """The newest row of each key with its batch, of all buckets or some."""
    buckets = state["buckets"]
    bases = {int(b): x for b, x in state["bases"].items() if only is None or int(b) in only}
    parts = []
    if bases:
        parts.append(spark.read.schema(state["schema"]).parquet(*[f"{root}/{x['path']}" for x in bases.values()]))
    since = F.create_map(*[F.lit(x) for b, v in bases.items() for x in (b, v["batch"])]) if bases else None
    for d in state["deltas"]:
        own, at = spark.read.schema(state["schema"]).parquet(f"{root}/{d['path']}"), _bucket(keys, buckets)
        if only is not None:
            own = own.where(at.isin(only))
        if since is not None:  # a base holds what the deltas up to its batch held
            own = own.where(F.coalesce(F.col(_BATCH) > F.try_element_at(since, at), F.lit(True)))
        parts.append(own)
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), _BATCH).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def publish(batch: DataFrame, batch_id: int, path: str, keys: list[str], complete: bool = False, owner: str = "",
            buckets: int = BUCKETS, rounds: int = ROUNDS) -> None:
    """Makes ``batch`` part of the table: its rows replace those of their keys, or with ``complete`` all
    rows. States are numbered on, whatever the batch's own number: a new ``owner`` (the stream's
    checkpoint) starts at 0 again and goes on with the table. The owner's last batch, run again, starts
    from the state before it and publishes the same."""
    spark, root = batch.sparkSession, path.rstrip("/")
    files = Files(spark, root)
    now = _state(files)
    again = now is not None and (now["owner"], now["owner_batch"]) == (owner, batch_id)
    seq = now["batch"] + (not again) if now else 0
    tag = f"{seq:012d}-{uuid.uuid4().hex[:8]}"
    rows = batch.withColumn(_BATCH, F.lit(seq).cast("bigint"))
    before = None if complete else _state(files, below=seq)
    state = {"batch": seq, "owner": owner, "owner_batch": batch_id, "buckets": before["buckets"] if before else buckets, "keys": keys,
             "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema),
             "bases": dict(before["bases"]) if before else {}, "deltas": list(before["deltas"]) if before else []}
    if complete:
        rows.write.parquet(f"{root}/base-{tag}")
        state["bases"] = {"0": {"batch": seq, "path": f"base-{tag}"}}
        state["buckets"] = 1
    else:
        rows.write.parquet(f"{root}/delta-{tag}")
        state["deltas"].append({"batch": seq, "path": f"delta-{tag}"})
        due = [b for b in range(state["buckets"]) if b % rounds == seq % rounds]
        merged = _merged(spark, root, state, keys, due)
        (merged.withColumn(_BUCKET, _bucket(keys, state["buckets"])).hint("rebalance", _BUCKET)
         .write.partitionBy(_BUCKET).parquet(f"{root}/base-{tag}"))
        held = {n.split("=")[1] for n in files.names(f"base-{tag}") if n.startswith(f"{_BUCKET}=")}
        for b in map(str, due):  # a bucket without a key has no folder, and nothing to read
            if b in held:
                state["bases"][b] = {"batch": seq, "path": f"base-{tag}/{_BUCKET}={b}"}
        # each bucket has been rewritten since: what older deltas held is in the bases
        state["deltas"] = [d for d in state["deltas"] if d["batch"] > seq - rounds]
    files.write(f"states/{seq:012d}.json", json.dumps(state))
    _forget(files)


def _forget(files: Files) -> None:
    """Deletes old states and all that no kept state names. Only the writer of the table calls it."""
    names = _states(files)
    for name in names[:-KEPT]:
        files.delete(f"states/{name}")
    used = set()
    for name in names[-KEPT:]:
        s = json.loads(files.read(f"states/{name}"))
        used |= {x["path"].split("/")[0] for x in [*s["bases"].values(), *s["deltas"]]}
    for name in files.names(""):
        if name.startswith(("base-", "delta-")) and name not in used:
            files.delete(name)
    for name in files.names("states"):
        if name.endswith(".tmp"):
            files.delete(f"states/{name}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as the newest published batch left it."""
    root = path.rstrip("/")
    state = _state(Files(spark, root))
    if state is None:
        raise FileNotFoundError(f"no snapshot is published below {path}")
    if not state["deltas"]:
        return spark.read.schema(state["schema"]).parquet(*[f"{root}/{x['path']}" for x in state["bases"].values()]).drop(_BATCH)
    return _merged(spark, root, state, state["keys"]).drop(_BATCH)
