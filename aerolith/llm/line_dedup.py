"""Site-relative line deduplication [native].

A line is boilerplate of a host if more than ``ratio`` of the host's pages hold it, and
more than one page does. Boilerplate lines are dropped; all others stay in order.

Defined results: a null text is returned as null with no lines; a null host is no site,
so its rows lose nothing; blank lines are kept and never counted; lines are compared
without white space at their ends; repeated rows are pages of their own; an empty table
gives no rows; other columns of the input are returned unchanged, whatever their names:
only columns named like the two that are added (``counts``) are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import free_name, staged

RATIO = 0.1
#: A line of one page repeats nowhere.
MIN_PAGES = 2


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")))


_BLANK = r"^[ \t\r]*$"


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): digests of each host's boilerplate lines.

    Lines are counted by a 128-bit digest with partial aggregation, so a line of a third of
    all pages costs one row per task. A host's array holds at most (mean lines a page) /
    ``ratio`` digests, however many pages the host has.
    """
    src = pages.where(F.col(host).isNotNull())
    totals = src.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(
        F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_BLANK)), _key))
    counts = (src.select(F.col(host).alias("host"), F.explode(keys).alias("line"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_pages))
    return (counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
            .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``pages`` with the text cleaned, and the lines it had and lost in the columns ``counts``.

    The boilerplate table is written first: Spark then knows its size, broadcasts it
    below the session's threshold and otherwise joins with skewed hosts split.
    """
    table = staged(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    own, lines, split, kept = (free_name(pages, x) for x in ("host", "lines", "split", "kept"))
    held = table.select(F.col("host").alias(own), F.col("lines").alias(lines))
    out = pages.join(held, F.col(host) == F.col(own), "left").drop(own)
    out = out.withColumn(split, F.split(text, "\n"))
    stays = F.filter(split, lambda x: ~F.array_contains(lines, _key(x)) | x.rlike(_BLANK))
    out = out.withColumn(kept, F.when(F.col(lines).isNull(), F.col(split)).otherwise(stays))
    return out.select(
        *[F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in pages.columns if c not in counts],
        F.greatest(F.size(split), F.lit(0)).cast("long").alias(counts[0]),
        F.greatest(F.size(split) - F.size(kept), F.lit(0)).cast("long").alias(counts[1]))
