"""Connected components of a link table, by star contraction.

Large-star and small-star steps alternate until all links form stars
(Kiveris et al., Connected Components in MapReduce and Beyond): every node's
larger neighbours, then its smaller ones, are tied to the smallest node it
knows. Each step is a partial aggregate and a join; the node-to-minimum side is
a written table, so a hub's rows can be split between tasks. Links and nodes
stay distributed; only the answer whether all are stars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgate.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b; any direction, repeats and self links allowed, nulls
    left out) to (node, component): every node that has a link to another one,
    with the smallest node it can reach, itself included."""
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    # done when every larger end has one link, to a node that is no larger end
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(near, "a").select(
            F.col("v").alias("a"), F.col("m").alias("b")
        )
        large = cut(large.where(F.col("a") != F.col("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = edges
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(old, near, large)
    member = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return member.unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()
