"""Connected components of a graph given as edges, by repeated contraction; nothing is collected.

Defined cases: an edge from a node to itself or with a null end says nothing; repeated and turned edges are one; an empty
table gives an empty one. Nodes are of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut


def doubled(hook: DataFrame) -> DataFrame:
    """hook (node, to) with every `to` at the end of its chain, by pointer doubling: a chain of n needs log2(n) joins."""
    while True:
        up = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
        hook = cut(hook.join(up, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hook")
        if hook.where("moved").isEmpty():
            return hook.select("node", "to")
        hook = hook.select("node", "to")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the same for all nodes of a component and one of them.

    Each round every node hooks onto its least neighbour, chains of hooks are followed to their ends, and the graph
    shrinks to these: a path of any length is one round. The least neighbour is an aggregate with map-side combining and
    edges meet it in a plain join, so a hub is no hot task.
    """
    edges = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = doubled(cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).where("to < node"), "hook"))
        rounds.append(hook)
        ends = edges.join(hook.withColumnsRenamed({"node": "a", "to": "to_a"}), "a", "left").join(hook.withColumnsRenamed({"node": "b", "to": "to_b"}), "b", "left")
        ends = ends.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a != b")
        edges = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node hooks in one round, and what it hooked onto may hook in a later one: rounds are few, a path is one
    nodes = rounds[0].select("node").union(rounds[0].select("to"))
    for hook in rounds[1:]:
        nodes = nodes.union(hook.select("node")).union(hook.select("to"))
    at = nodes.distinct().withColumn("root", F.col("node"))
    for hook in rounds:
        at = at.join(hook.withColumnsRenamed({"node": "root", "to": "_to"}), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return at
