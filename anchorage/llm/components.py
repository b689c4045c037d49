"""Connected components of an edge table, without any collection of edges or labels in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges(a, b), any orderable type -> (node, component): component is the least node reachable from node.

    Alternates large-star and small-star steps until the edge set stands still. Each step keeps at most one edge per
    old edge, so the table never grows. Least neighbours are written before they are joined, so that a node with a great
    many edges can be split over tasks. Roots and isolated nodes have no row: their component is themselves. Self loops,
    repeated edges and edges with a null end count for nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.put(e.where("a is not null and b is not null and a <> b").distinct())
    seen = None
    while not e.isEmpty():
        both = e.union(e.select("v", "u")).toDF("n", "m")
        low = scratch.put(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low")))
        large = scratch.put(both.join(low, "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct())
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(least, "u")
        small = small.select("u", "low").union(small.where("v <> low").select("v", "low")).toDF("u", "v").distinct()
        new = scratch.put(small)
        for used in (e, low, large, least):
            scratch.drop(used)
        e = new
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.toDF("node", "component")
        seen = mark
    return e.toDF("node", "component")
