"""Graphs as two tables, ``nodes`` (keys, node, ord, ...) and ``edges`` (keys, src, dst, ...), many in one pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidNodeId

Keys = Sequence[str]


def canonical(edges: DataFrame, nodes: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """Undirected edges once each: the end that comes first (by ``ord`` of ``nodes``, else by value) is ``src``."""
    keys = list(keys)
    if nodes is None:
        return edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    place = lambda end: nodes.select(*keys, F.col("node").alias(end), F.col("ord").alias(f"{end}_ord"))
    rows = edges.select(*keys, "src", "dst").join(place("src"), [*keys, "src"]).join(place("dst"), [*keys, "dst"])
    first = F.col("src_ord") <= F.col("dst_ord")
    return rows.select(*keys, F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst")).distinct()


def adjacency(edges: DataFrame, keys: Keys = (), symmetric: bool = False) -> DataFrame:
    """True entries of the adjacency matrix, ``keys, i, j``; with ``symmetric`` those of its transpose too."""
    keys = list(keys)
    out = edges.select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"))
    if symmetric:
        out = out.unionByName(edges.select(*keys, F.col("dst").alias("i"), F.col("src").alias("j")))
    return out.distinct()


def weighted_adjacency(edges: DataFrame, weight: str, keys: Keys = ()) -> DataFrame:
    """Symmetric weights ``keys, i, j, weight``: the larger one where both directions have one."""
    keys = list(keys)
    both = edges.select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), weight).unionByName(edges.select(*keys, F.col("dst").alias("i"), F.col("src").alias("j"), weight))
    return both.groupBy(*keys, "i", "j").agg(F.max(weight).alias("weight"))


class Graph:
    """A directed graph. Nodes and edges are sets; adding what is there changes nothing."""

    directed = True

    def __init__(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, adjacency: DataFrame | None = None, keys: Keys = ()) -> None:
        """``edges`` (src, dst) win over ``adjacency`` (i, j); nodes are taken from the edges where they are not given.

        An edge to a node that is not among given nodes raises ``InvalidNodeId``.
        """
        self.keys = list(keys)
        if edges is None and adjacency is not None:
            edges = adjacency.select(*self.keys, F.col("i").alias("src"), F.col("j").alias("dst"))
        self._given = nodes
        if edges is not None:
            ends = edges.select(*self.keys, F.col("src").alias("node")).union(edges.select(*self.keys, F.col("dst").alias("node"))).distinct()
            if nodes is None:
                nodes = ends
            elif not ends.join(nodes, [*self.keys, "node"], "left_anti").isEmpty():
                raise InvalidNodeId("an edge has an end that is not a node")
        if nodes is None:
            raise InvalidNodeId("a graph needs nodes or edges")
        self.nodes = nodes
        self.edges = self._set(edges) if edges is not None else nodes.select(*self.keys, F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)

    def _set(self, edges: DataFrame) -> DataFrame:
        return edges.dropDuplicates([*self.keys, "src", "dst"])

    def n_nodes(self) -> int:
        return self.nodes.count()

    def adjacency(self) -> DataFrame:
        return adjacency(self.edges, self.keys, symmetric=not self.directed)

    def add_nodes(self, nodes: DataFrame) -> Graph:
        return type(self)(self.nodes.unionByName(nodes, allowMissingColumns=True).dropDuplicates([*self.keys, "node"]), self.edges, keys=self.keys)

    def add_edges(self, edges: DataFrame) -> Graph:
        """The graph with more edges; ends that are no nodes yet become nodes."""
        ends = edges.select(*self.keys, F.col("src").alias("node")).union(edges.select(*self.keys, F.col("dst").alias("node")))
        nodes = self.nodes.unionByName(ends, allowMissingColumns=True).dropDuplicates([*self.keys, "node"])
        return type(self)(nodes, self.edges.unionByName(edges, allowMissingColumns=True), keys=self.keys)

    def remove_edges(self, edges: DataFrame) -> Graph:
        gone = edges if self.directed else canonical(edges, keys=self.keys)
        return type(self)(self.nodes, self.edges.join(gone, [*self.keys, "src", "dst"], "left_anti"), keys=self.keys)

    def reset(self) -> Graph:
        return type(self)(self.nodes.limit(0), self.edges.limit(0), keys=self.keys)


class UGraph(Graph):
    """An undirected graph: each edge once, its smaller end first (by ``ord`` where nodes have one)."""

    directed = False

    def _set(self, edges: DataFrame) -> DataFrame:
        ordered = self._given if self._given is not None and "ord" in self._given.columns else None
        return canonical(edges, ordered, self.keys)
