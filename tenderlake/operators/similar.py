"""Names that are alike, and the groups they make up: what a greedy choice of one rule among similar ones can be told from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_similarity
from ..sources.shared import written


def alike(a: Column, b: Column, threshold: float) -> Column:
    return (a == b) | a.contains(b) | b.contains(a) | (name_similarity(a, b) > threshold)


def _rarest(tokens: DataFrame) -> DataFrame:
    """tokens (doc, node, token) with place: 1 for a name's token that the fewest names of its document have."""
    often = tokens.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("doc", "node").orderBy("often", "token"))
    return tokens.join(often, ["doc", "token"]).withColumn("place", place)


def similar_names(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of nodes of a document whose names (doc, node, name, distinct in each document) are alike: one holds the other, or their
    sets of characters have a Jaccard similarity above threshold. Candidates share a token that is rare in the document: for
    similarity one of the first s - ceil(threshold * s) + 1 characters by rarity of each side (a prefix filter), for holding the
    rarest pair of characters of the shorter name, which the longer must have."""
    chars = names.select("doc", "node", F.array_distinct(F.split("name", "")).alias("set")).select("doc", "node", F.size("set").alias("s"), F.explode("set").alias("token"))
    rare = _rarest(chars.select("doc", "node", "token")).join(chars.select("doc", "node", "s").distinct(), ["doc", "node"])
    first = rare.where(F.col("place") <= F.col("s") - F.ceil(F.col("s") * threshold) + 1).select("doc", "token", "node", "s")
    a, b = (first.select("doc", "token", F.col("node").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    near = a.join(b, ["doc", "token"]).where((F.col("a") < F.col("b")) & (F.least("s_a", "s_b") >= F.greatest("s_a", "s_b") * threshold)).select("doc", "a", "b")

    n = F.length("name")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(F.col("name"), i, F.lit(2)))
    all_ = F.array_distinct(F.concat(F.array(F.lit("")), F.split("name", ""), pieces))
    grams = names.select("doc", "node", F.explode(pieces).alias("token")).distinct()  # an empty name's is the empty one
    needle = _rarest(grams).where("place = 1").select("doc", "token", F.col("node").alias("x"))
    hay = names.select("doc", F.col("node").alias("y"), F.explode(all_).alias("token")).join(needle.select("doc", "token").distinct(), ["doc", "token"], "left_semi")
    held = needle.join(hay, ["doc", "token"]).where("x <> y").select("doc", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    pairs = near.unionByName(held).distinct()
    for side in "ab":
        pairs = pairs.join(names.select("doc", F.col("node").alias(side), F.col("name").alias(f"name_{side}")), ["doc", side])
    return pairs.where(alike(F.col("name_a"), F.col("name_b"), threshold)).select("a", "b")


def groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, grp: the smallest node that pairs (a, b) lead to, by rounds in which every node takes the smallest group of its
    neighbours and then its group's group. Each round is a table; the driver sees whether there was a change."""
    both = written(pairs.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("near"))))
    now = written(nodes.select("node", F.col("node").alias("grp")))
    while True:
        least = both.join(now.select(F.col("node").alias("near"), F.col("grp").alias("g")), "near").groupBy("node").agg(F.min("g").alias("g"))
        low = now.join(least, "node", "left").select("node", F.least("grp", F.coalesce("g", "grp")).alias("grp"), F.col("grp").alias("was"))
        up = low.select(F.col("node").alias("grp"), F.col("grp").alias("top"))
        after = written(low.join(up, "grp").select("node", F.col("top").alias("grp"), "was"))
        if after.where("grp <> was").isEmpty():
            return after.select("node", "grp")
        now = after.select("node", "grp")
