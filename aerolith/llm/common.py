"""Small helpers shared by the operators: reading a table, staging a result in
the shared folder, and walking Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.session import scratch_path

#: The white space of the word contracts: words are ``[^\\x20\\x09-\\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: lineage ends
    there, and the planner knows the size of what it reads."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text, row_key, *extra) with a null text as the empty one.

    ``row_key`` tells rows apart that repeat a doc_id with another text; rows that
    are equal in both share it, and every result of theirs is equal too.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _row_key().alias("row_key"), *extra)


def _row_key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def rows_of(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` that are in ``keys`` (doc_id, row_key), or with ``left_anti`` the
    others. All columns stay; a null doc_id equals a null one."""
    own = free_name(docs, "key")
    tagged = docs.withColumn(own, _row_key())
    same = (tagged[own] == keys["row_key"]) & tagged["doc_id"].eqNullSafe(keys["doc_id"])
    return tagged.join(keys, same, how).drop(own)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made of it that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's number in ``order``, from 1. Rows are dealt by ranges of the order,
    sorted and numbered within a range, and the sizes of the ranges before are added, so no task
    sees more than a range. Rows equal in the whole order are numbered in any way."""
    at, part, base = (free_name(df, x) for x in ("at", "part", "base"))
    dealt = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    split = dealt.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = split.groupBy(part).agg(F.count(F.lit(1)).alias(base))  # a row per range
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    return split.join(F.broadcast(bases), part).select(*df.columns, (F.col(at) + F.col(base) + 1).alias(name))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``most`` bytes of ``column``
    (one row at least), so that a task's working arrays stay bounded."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        lo, held = 0, 0
        for i, n in enumerate(sizes):
            if i > lo and held + n > most:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += int(n)
        if lo < batch.num_rows:
            yield batch.slice(lo)
