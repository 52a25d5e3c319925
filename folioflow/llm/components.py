"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step turns the neighbourhood of every node into a star around the smallest node that it knows; the
graph becomes a forest of stars in a number of rounds that grows with the logarithm of its size. Steps
are aggregations and equi-joins: no neighbourhood is ever gathered in one place, because the edges of a
node with a large share of all edges are met by a broadcast of its row, and the edges of a round are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import HEAVY_ROWS, heavy_join, materialise


def _stars(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step over edges (u, v). ``few``: no node can have a large share of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")).select("u", F.least("u", "m").alias("m"), "edges")
    if few:
        joined = both.join(smallest, "u")
    else:
        smallest = materialise(smallest, "smallest")
        joined = heavy_join(both, smallest, "u", "edges", "inner")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v) that is not the smallest of its component; component is the smallest."""
    current = materialise(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    while True:
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not row["n"] or (row["n"], row["h"]) == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = (row["n"], row["h"])
        few = row["n"] <= HEAVY_ROWS // 2  # a step at most doubles the edges
        current = materialise(_stars(current, True, few), "large-star")
        current = materialise(_stars(current, False, few), "small-star")
