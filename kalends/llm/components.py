"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, follows those hooks to their ends by pointer doubling,
    and contracts the edges. Nodes that stay are local minima, at most half of those with an edge, so rounds are
    logarithmic. All state is in tables; only two counts a round reach the driver. Edges may repeat, point either
    way, join a node with itself or hold nulls (such edges are dropped).
    """
    edges = scratch.write(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = scratch.write(hooks.join(ends, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "hooks")
            still = jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "up")
            if still:
                break
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "up")
            labels = scratch.write(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        one, other = hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = scratch.write(edges.join(one, "a").join(other, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
