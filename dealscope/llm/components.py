"""Connected components of a graph whose edges stay in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import durable


def _undirected(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every end of an edge (a, b) the least node it is connected with; ends are not null.

    Each round merges every node into the first of its neighbours and itself in a hashed order, and draws the
    edges between what is left, each once. Edges and nodes that remain shrink by a fraction per round, so rounds
    grow with the logarithm of the graph. Rounds are written to the shared folder; only the number of edges left
    reaches the driver. Hubs are summed before they are shuffled, and the joins read written tables, whose large
    keys Spark can split.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    rest = durable(edges.where(F.col("a") != F.col("b")).select(*_undirected(F.col("a"), F.col("b"))).distinct())
    labels, nodes = None, 0
    while left := rest.count():
        both = rest.union(rest.select("b", "a"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        into = durable(first.select(F.col("a").alias("node"), F.least("first", order("a"))["node"].alias("into")), left)
        if labels is None:
            labels, nodes = into.withColumnRenamed("into", "root"), into.count()
        else:
            step = into.select(F.col("node").alias("root"), "into")
            labels = durable(labels.join(step, "root", "left").select("node", F.coalesce("into", "root").alias("root")), nodes)
        merged = rest.join(into.withColumnsRenamed({"node": "a", "into": "x"}), "a")
        merged = merged.join(into.withColumnsRenamed({"node": "b", "into": "y"}), "b").where(F.col("x") != F.col("y"))
        rest = durable(merged.select(*_undirected(F.col("x"), F.col("y"))).distinct(), left)
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = durable(labels.groupBy("root").agg(F.min("node").alias("least")), nodes)
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
