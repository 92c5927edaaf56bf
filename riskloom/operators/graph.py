"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .stages import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root) for every node of an undirected edge list: root is the smallest node that links reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is a partial aggregate and an equi-join,
    so that a node with very many links is pre-aggregated and its join can be split; each round is written. It ends when all components are stars around their smallest node.
    """
    links = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), name)
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(low.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), name)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(links: DataFrame) -> bool:
    """Every node has one link to a smaller node, which has none itself."""
    larger = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"))
    return larger.where("n > 1").limit(1).isEmpty() and links.join(larger, F.col("v") == F.col("node"), "left_semi").limit(1).isEmpty()
