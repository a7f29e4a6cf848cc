"""Walks over many small graphs at once, each to its end: breadth-first distances and connected components.

Graphs of up to ``GATHER`` edges, as traces are, are walked whole, one at a time, by an Arrow function.  Larger ones are walked by joins, a round a
step, so that none is ever gathered into one task.  Components need joins only, and rounds that grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

GATHER = 100_000


def _walk(key: tuple[pa.Scalar, ...], starts: pa.Table, edges: pa.Table) -> pa.Table:
    onward: dict[str, list[str]] = {}
    for a, b in zip(edges["src"].to_pylist(), edges["dst"].to_pylist(), strict=True):
        onward.setdefault(a, []).append(b)
    steps = dict.fromkeys(starts["node_id"].to_pylist(), 0)
    front, n = list(steps), 0
    while front:
        n += 1
        front = list(dict.fromkeys(b for a in front for b in onward.get(a, ()) if b not in steps))
        steps.update(dict.fromkeys(front, n))
    graph = pa.array([key[0].as_py()] * len(steps), pa.string())
    return pa.table({"graph_id": graph, "node_id": pa.array(list(steps), pa.string()), "steps": pa.array(list(steps.values()), pa.int32())})


def distances(starts: DataFrame, edges: DataFrame, gather: int = GATHER) -> DataFrame:
    """(graph_id, node_id, steps): the fewest steps along ``edges(graph_id, src, dst)`` to every node that ``starts(graph_id, node_id)`` reach."""
    ensure_checkpoint_dir(edges.sparkSession)
    starts = starts.select("graph_id", "node_id").distinct()
    edges = edges.where("src <> dst").select("graph_id", "src", "dst").distinct().checkpoint()
    size = edges.groupBy("graph_id").count()
    large = size.where(F.col("count") > gather).select("graph_id")
    schema = "graph_id string, node_id string, steps int"
    if large.isEmpty():
        return starts.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInArrow(_walk, schema)
    part = lambda df, how: df.join(large, "graph_id", how)
    small = part(starts, "left_anti").groupBy("graph_id").cogroup(part(edges, "left_anti").groupBy("graph_id")).applyInArrow(_walk, schema)
    return small.unionByName(_rounds(part(starts, "left_semi"), part(edges, "left_semi")))


def _rounds(starts: DataFrame, edges: DataFrame) -> DataFrame:
    done = front = starts.withColumn("steps", F.lit(0)).checkpoint()
    n = 0
    while not front.isEmpty():
        n += 1
        step = edges.join(front.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id")).distinct()
        front = step.join(done, ["graph_id", "node_id"], "left_anti").withColumn("steps", F.lit(n)).checkpoint()
        done = done.unionByName(front)
        done = done.checkpoint() if n % 16 == 0 else done  # the plan stays short
    return done


def components(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, smallest) for every node of ``edges(graph_id, src, dst)``: the smallest node connected with it, in either direction.

    Alternating star contraction, until a round changes nothing: the large star hangs a node's larger neighbours on its
    smallest one, the small star its smaller ones.  Only minima are aggregated, so nobody gathers a neighbour list.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.where("src <> dst").select("graph_id", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct().checkpoint()
    g = "graph_id"
    while True:
        both = links.union(links.select(g, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(g, "a").agg(F.min("b").alias("m")).select(g, "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, [g, "a"]).select(g, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(g, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [g, "a"]).select(g, F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(g, "a", F.col("m").alias("b")))
        new = small.where("a <> b").distinct().checkpoint()
        if new.count() == links.count() and new.join(links, [g, "a", "b"], "left_anti").isEmpty():
            break
        links = new
    leaf = new.select(g, F.col("a").alias("node_id"), F.col("b").alias("smallest"))
    return leaf.union(new.select(g, F.col("b").alias("node_id"), F.col("b").alias("smallest")).distinct())
