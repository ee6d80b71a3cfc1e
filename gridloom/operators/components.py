"""Connected components by hooking and pointer jumping, on written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


def _lesser(a: Column, b: Column) -> Column:
    return F.when(a < b, a).otherwise(b)


def _flattened(parents: DataFrame, rows: int) -> DataFrame:
    """``node, root`` from ``node, parent`` (a forest): every pointer is replaced by its target's until none moves."""
    now = parents.select("node", F.col("parent").alias("root"))
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = written(now.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "pointers", rows)
        now = step.select("node", "root")
        if step.where("moved").isEmpty():
            return now


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node of ``edges`` that is not a root; a root is its component's least node.

    Works on any ordered column type (numbers, strings, structs). In each round every node hooks onto its least
    neighbour if that is smaller, chains of hooks are flattened by pointer jumping, and the edges are moved to the roots;
    those inside a component leave. The number of joins grows with the logarithm of the component size, not with its
    diameter. The driver learns row counts only.
    """
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    links = written(links.select(_lesser(F.col("x"), F.col("y")).alias("x"), F.when(F.col("x") < F.col("y"), F.col("y")).otherwise(F.col("x")).alias("y")).distinct(), "links")
    labels: DataFrame | None = None
    while rows := links.count():
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooks = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("parent")).where("parent < node")
        roots = _flattened(written(hooks, "hooks", 2 * rows), 2 * rows)
        if labels is None:
            labels = roots
        else:
            # Old roots that moved: their members follow, and they become members themselves.
            moved = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = written(moved.unionByName(roots), "labels")
        to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        inner = links.join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("x_", "x").alias("p"), F.coalesce("y_", "y").alias("q")).where("p != q")
        new = written(inner.select(_lesser(F.col("p"), F.col("q")).alias("x"), F.when(F.col("p") < F.col("q"), F.col("q")).otherwise(F.col("p")).alias("y")).distinct(), "links", rows)
        discard(links)
        links = new
    return links.select(F.col("x").alias("node"), F.col("y").alias("root")) if labels is None else labels


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """``nodes`` with a column ``root``: the least node of each one's component, itself if it has no edge."""
    found = stars(edges, a, b).select(F.col("node").alias("node_"), F.col("root").alias("root_"))
    return nodes.join(found, F.col(node) == F.col("node_"), "left").select(*nodes.columns, F.coalesce("root_", node).alias("root"))
