"""Connected components of links, by rounds of large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _toward_smallest(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("least"))
    least = least.select("centre", F.least("centre", "least").alias("least"))
    met = both.join(least, F.col("u") == F.col("centre"))
    if larger:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("least").alias("v")).union(met.select("u", F.col("least").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; the component is its smallest node.

    Rounds go on until no link changes; each round's links are written, so a lost executor repeats one round only. Hot
    nodes are rows of plain joins and aggregates that Spark can split; nothing is collected but two numbers per round.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links"
    )
    # Every (u, v) has u > v, as small-star needs it and both kinds leave it.
    before = None
    while True:  # every round but the last changes links; rounds are few, as each about halves the distances
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == before:
            break
        if now.n == 0:
            break
        before = (now.n, now.h)
        edges = stage(_toward_smallest(_toward_smallest(edges, larger=True), larger=False), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
