"""Connected components of an edge table, without bringing edges or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    A round points every node to the least of itself and its neighbours, follows these pointers to
    their ends by jumping, and contracts the edges to the ends; nodes shrink at least to those that
    no neighbour undercuts. Neighbour minima are sums that combine on the map side, and the joins on
    a hub's id have plain exchanges on both sides, which adaptive execution splits.
    """
    steps: list[DataFrame] = []
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left = scratch.save(ends, "edges")
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        to = scratch.save(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "to")
        while True:
            ahead = to.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = scratch.save(to.join(ahead, F.col("root") == F.col("_n"), "left").select(
                "node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("moved")), "jumped")
            moved = not jumped.where("moved").isEmpty()
            to = jumped.drop("moved")
            if not moved:
                break
        steps.append(to)
        a, b = (to.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        near = left.join(a, "a").select("b", "ra").join(b, "b").where("ra <> rb")
        left = scratch.save(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    found = steps[0]
    for to in steps[1:]:
        ahead = to.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = found.join(ahead, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return scratch.save(found, "roots")
