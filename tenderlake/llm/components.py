"""Connected components of links between documents, by joins alone.

Each round takes every node's smallest neighbour as its parent, shortens the parent chains by joining them with themselves
until they end at roots, and contracts the links to links between roots. Tables go to the shared folder between steps, so
lineage stays short; nothing is gathered on the driver, and the joins are plain ones, whose hot keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tidy, written


def connected(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node, component (smallest node reachable), for nodes with a link to another node."""
    with tidy() as kept:
        ends = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
        edges = written(ends, "links")
        total = None
        while not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            table = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "parents")
            parent, done = table, False
            while not done:
                up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
                jumped = written(parent.join(up, "root").select("node", "root", "top"), "jumps")
                done = jumped.where("root <> top").isEmpty()
                forget(table)
                table, parent = jumped, jumped.select("node", F.col("top").alias("root"))
            step = parent.select(F.col("node").alias("component"), F.col("root"))
            both = step.select(F.col("component").alias("node"), F.col("root").alias("component")) if total is None else total.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            left, right = parent.select(F.col("node").alias("u"), F.col("root").alias("ru")), parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
            again = edges.join(left, "u").join(right, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
            old, total, edges = (total, edges, table), written(both, "components"), written(again, "links")
            forget(*[df for df in old if df is not None])
        if total is None:
            total = written(edges.select(F.col("u").alias("node"), F.col("u").alias("component")), "components")
        kept(total)
        return total
