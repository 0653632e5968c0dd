"""Which nodes of graphs are needed, by joins of what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.checkpoints import settled


def producers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, made): edges (graph, node, needs) from nodes (graph, node, inputs, outputs), and made (graph, name, node).

    An input without a name, or that no node makes, leads nowhere. If several nodes make one name the last node does.
    """
    made = nodes.select("graph", "node", F.explode("outputs").alias("name")).groupBy("graph", "name").agg(F.max("node").alias("node"))
    asks = nodes.select("graph", "node", F.explode("inputs").alias("name")).where("name != ''")
    edges = asks.join(made.withColumnRenamed("node", "needs").hint("merge"), ["graph", "name"]).select("graph", "node", "needs").distinct()
    return edges, made


def reachable(edges: DataFrame, starts: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(graph, node) of all nodes that starts (graph, node) need, themselves included; edges have (graph, node, needs).

    Only what the last round found is joined with the edges, and what was known already goes by an anti-join; so a node
    is followed once, cycles end, and there are as many rounds as the longest of the shortest ways. `rounds` takes how
    many nodes each round found. Joins are merges of what is dealt by node: nothing goes through the driver.
    """
    edges = settled(edges.where("node is not null and needs is not null").select("graph", "node", "needs").distinct())
    new = settled(starts.where("node is not null").select("graph", "node").distinct())
    known = new
    while (count := new.count()) > 0:
        if rounds is not None:
            rounds.append(count)
        next_ = new.join(edges.hint("merge"), ["graph", "node"]).select("graph", F.col("needs").alias("node")).distinct()
        new = settled(next_.join(known.hint("merge"), ["graph", "node"], "left_anti"))
        known = settled(known.unionByName(new))
    return known
