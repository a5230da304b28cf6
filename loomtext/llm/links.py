"""Connected components of a table of links, by alternating large and small stars.

Every round hangs neighbours on the smallest node in sight: first the larger neighbours of each node, then the smaller ones.
Only minima by node are aggregated (in part before the shuffle) and joined back, so a node with very many links costs
rows, never a group in one task; rounds grow with the logarithm of the longest chain. Each round is written to the
shared folder and the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import Scratch


def _hang(directed: DataFrame) -> DataFrame:
    """directed(u, v) with the least of each u's own neighbours as m."""
    return directed.join(directed.groupBy("u").agg(F.min("v").alias("m")), "u")


def _tidy(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the component's smallest node, itself included) of every node in edges(u, v).

    Null ends, links from a node to itself and repeated links are dropped; no links give an empty table.
    """
    edges = scratch.cut(_tidy(edges), f"{name}-0")
    k = 0
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        edges_large = scratch.cut(_tidy(large), f"{name}-{k}-large")
        hung = _hang(edges_large)
        small = hung.select("u", F.col("m").alias("v")).union(hung.select(F.col("v").alias("u"), F.col("m").alias("v")))
        k += 1
        edges = scratch.cut(_tidy(small), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-{k - 1}-large")
        # Done once every node hangs on one root, and no root hangs on another node.
        up = edges.groupBy("u").agg(F.count("*").alias("n"))
        roots = edges.select("v").distinct()
        if up.where("n > 1").isEmpty() and up.join(roots, up["u"] == roots["v"], "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
