"""Connected components by hooking and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the component's least node.

    In each round every node that has a smaller neighbour takes the least as its parent, chains are halved until all
    point to their roots, and the edges are rewritten between roots. At least half of the nodes with edges go in a round,
    so the rounds grow with the logarithm of the longest path. Minima are taken map-side; joins on a hub are
    inner or left joins whose hot side Spark splits.
    """
    edges = cut(_oriented(edges))
    labels = cut(edges.select(F.col("hi").alias("node")).union(edges.select(F.col("lo").alias("node"))).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        parents = cut(edges.groupBy("hi").agg(F.min("lo").alias("up")))
        while True:
            above = parents.select(F.col("hi").alias("_hi"), F.col("up").alias("_up"))
            jumped = cut(parents.join(above, parents["up"] == above["_hi"], "left").select("hi", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")))
            parents = jumped.select("hi", "up")
            if jumped.where("moved").isEmpty():
                break
        labels = cut(_moved(labels, "root", parents))
        edges = cut(_oriented(_moved(_moved(edges, "hi", parents), "lo", parents).select(F.col("hi").alias("a"), F.col("lo").alias("b"))))
    return labels


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _moved(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("hi").alias("_hi"), F.col("up").alias("_up"))
    return rows.join(up, rows[column] == up["_hi"], "left").withColumn(column, F.coalesce("_up", column)).drop("_hi", "_up")
