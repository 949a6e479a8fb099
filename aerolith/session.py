"""Session construction and shared-folder resolution.

The session is pinned to UTC in exactly one place: facts are stored as
``TIMESTAMP_NTZ`` holding UTC wall-clock time, and every parse/format/truncate
goes through the session zone.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    app_name: str = "aerolith",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings every operator assumes.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    AQE is on so joins against dimensions and per-parameter bounds become
    broadcasts only after their runtime size has been measured, and skewed
    shuffle partitions are split.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # size post-shuffle partitions by bytes (advisory size), not by core count
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Partition discovery must not turn month=01 into the integer 1.
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names storage every executor can reach, and it
    is only read here; without it a cluster session is refused, because each
    machine would write to its own disk. Only a ``local`` master (tests, a
    laptop) gets a fresh scratch folder, registered once for the session.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        root = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to shared storage for master {master}")
        root = tempfile.mkdtemp(prefix="aerolith-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique folder below the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder or file is there, asked of its own file system; a
    storage or permission fault raises instead of reading as absence."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full)


def written_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared root and read back: it is computed once,
    and the planner knows its size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a written bounds or key table may be broadcast.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, label: str, most: int = SMALL_ROWS) -> DataFrame:
    """A join side that is computed once and broadcast only if its counted rows
    are at most ``most``; larger, it stays a shuffle side whose hot keys AQE splits."""
    once = written_once(df, label)
    return F.broadcast(once) if once.count() <= most else once
