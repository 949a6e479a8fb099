"""Connected components of a link table as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import staged


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the undirected links.

    Each round gives a node the smallest label among its neighbours (a partial
    aggregation, so a node with many links costs one row per task) and then the label
    of that label, which halves the distance to the root. Rounds are cut by written
    tables; the driver sees one count per round.
    """
    both = staged(links.select(F.col(a).alias("node"), F.col(b).alias("other"))
                  .union(links.select(F.col(b), F.col(a))).where("node <> other").distinct(), "links")
    labels = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "root"), "other")
                .groupBy("node").agg(F.min("root").alias("near")))
        best = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = staged(best.join(jump, "root", "left")
                     .select("node", F.coalesce("far", "root").alias("root"), "was"), "labels")
        labels = nxt.select("node", "root")
        if nxt.where("root <> was").isEmpty():
            return labels
