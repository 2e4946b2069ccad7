"""Graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.sources.scratch import parts_of, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component = smallest node reachable): labels take the least of their neighbours' and then of their label's own."""
    edges = written(edges.select("src", "dst"))
    n = parts_of(edges.sparkSession, 2 * edges.count())
    e = written(edges.union(edges.select("dst", "src")).repartition(n, "src", "dst").distinct())
    labels = written(e.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    for _ in range(max_rounds):
        near = e.repartition(n, "dst").join(labels.repartition(n, "node"), F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("over"))
        step = written(step.join(jump, "to").select("node", F.least("to", "over").alias("next"), (F.least("to", "over") != F.col("component")).alias("moved")))
        labels = step.select("node", F.col("next").alias("component"))
        if step.filter("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def power_iteration(edges: DataFrame, steps: int, cut_every: int = 10) -> DataFrame:
    """(node, mass) after ``steps`` steps from the uniform distribution; each step is an edge join and a sum."""
    edges = written(edges)
    nodes = edges.select(F.col("src").alias("node")).distinct()
    mass = nodes.crossJoin(F.broadcast(nodes.agg((F.lit(1.0) / F.count(F.lit(1))).alias("mass"))))  # one row
    for i in range(steps):
        mass = edges.join(mass, edges["src"] == mass["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("weight")).alias("mass"))
        if (i + 1) % cut_every == 0:
            mass = written(mass)
    return mass


def with_loops(edges: DataFrame) -> DataFrame:
    """Self loops that make each node's weights sum to 1."""
    loops = edges.groupBy("src").agg((1 - F.sum("weight")).alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    return edges.unionByName(loops)
