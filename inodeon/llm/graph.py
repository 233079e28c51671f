"""Connected components by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list ``(a, b)``; the root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, jumps two pointers and replaces both ends of every edge
    by what they were hooked to. That keeps connectivity and at least removes all local maxima, so the
    edge list shrinks quickly; chains halve several times a round. All steps are partial aggregates and equi-joins on
    narrow rows. An empty edge list gives an empty result; self-loops and repeated edges change nothing.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        hooks = cut(hooks)
        for _ in range(2):
            step = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(step, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        hooks = cut(hooks)
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = cut(labels)
        edges = (
            edges.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(hooks.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        edges = cut(edges)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
