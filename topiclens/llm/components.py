"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges`` (``a, b``).

    Alternating large-star and small-star steps turn every component into a star around its
    smallest node. A step hangs each node's neighbours under the smallest of them, so edges
    never multiply; the minima are partial aggregates and the joins back to a hot node can be
    split. Rounds are written to the shared folder; only a flag reaches the driver.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = cut_lineage(links.distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # large star: neighbours above u go to the smallest node around u
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        # small star: neighbours below u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = cut_lineage(hung.union(least.select("u", F.col("low").alias("v"))).filter("u <> v").distinct())
        changed = small.join(links, ["u", "v"], "left_anti").limit(1).count() or small.count() != links.count()
        links = small
        if not changed:
            break
    star = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
