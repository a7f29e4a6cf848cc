"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its smallest node.

    Alternating star contraction: the large star hangs a node's larger neighbours on its smallest
    one, the small star its smaller ones.  Every round is two aggregations and two joins, the number of rounds
    grows with the logarithm of the longest chain.  A hub's links are spread by its neighbours:
    only minima are aggregated per node, with partial sums, and nobody gathers a neighbour list.
    """
    parts = work.parts(edges.count())
    step = work.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0", parts)
    n = 0
    while True:
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = work.write(small.where("a != b").distinct(), f"{name}-{n + 1}", parts)
        same = step.count() == new.count() and new.join(step, ["a", "b"], "left_anti").isEmpty()
        work.drop(f"{name}-{n}")
        step, n = new, n + 1
        if same:
            break
    out = step.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(step.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
