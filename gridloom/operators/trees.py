"""Trees as tables of (tree, node, parent), many in one table: closures, paths, leaves, cuts, common ancestors.

Ancestor closures double their reach in every round (a row knows its ancestor 2^k steps up), so a tree of depth ``d``
takes ``log2 d`` joins. The rounds end when no row has further to go; each is a written table.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GridloomWarning, InvalidTree, UnknownNodeProperty, UnreachableAncestor, UnrelatedNode
from ..storage import written

Keys = Sequence[str]

#: Rounds of doubling before a tree counts as cyclic.
MAX_ROUNDS = 24


def complete(parents: DataFrame | None, children: DataFrame | None, keys: Keys = ()) -> DataFrame:
    """One table ``keys, node, parent`` from either form: rows (node, parent), or (node, child).

    If both are given every child must have that parent among ``parents``, else ``InvalidTree`` is raised.
    """
    keys = list(keys)
    if parents is None and children is None:
        raise InvalidTree("a tree needs parents or children")
    if children is None:
        return parents.select(*keys, "node", "parent").distinct()
    turned = children.select(*keys, F.col("child").alias("node"), F.col("node").alias("parent")).distinct()
    if parents is None:
        return turned
    own = parents.select(*keys, "node", "parent").distinct()
    if not turned.join(own, [*keys, "node", "parent"], "left_anti").isEmpty():
        raise InvalidTree("a child does not have the parent whose child it is")
    return own


def closure(tree: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, node, anc, depth``: every node with each of its ancestors and itself (depth 0)."""
    keys = list(keys)
    edges = tree.where("parent is not null").select(*keys, "node", F.col("parent").alias("anc"))
    nodes = edges.select(*keys, "node").union(edges.select(*keys, F.col("anc").alias("node"))).distinct()
    near = edges.withColumn("depth", F.lit(1).cast("long"))
    out = written(nodes.select(*keys, "node", F.col("node").alias("anc"), F.lit(0).cast("long").alias("depth")).unionByName(near), "closure")
    jump = written(near, "jump")
    for _ in range(MAX_ROUNDS):
        # Every row of ``jump`` spans 2^k steps and ``out`` knows all shorter ones, so both double.
        step = jump.select(*keys, F.col("node").alias("anc"), F.col("anc").alias("far_"), F.col("depth").alias("more_"))
        jump = written(jump.join(step, [*keys, "anc"]).select(*keys, "node", F.col("far_").alias("anc"), (F.col("depth") + F.col("more_")).alias("depth")), "jump")
        if jump.isEmpty():
            return out
        far = jump.select(*keys, "node", F.col("anc").alias("mid_"), F.col("depth").alias("d_"))
        known = out.select(*keys, F.col("node").alias("mid_"), "anc", "depth")
        out = written(out.unionByName(far.join(known, [*keys, "mid_"]).select(*keys, "node", "anc", (F.col("d_") + F.col("depth")).alias("depth"))), "closure")
    raise InvalidTree(f"a node is its own ancestor, or the tree is deeper than 2^{MAX_ROUNDS}")


def roots(tree: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, node, root`` of every node."""
    return closure(tree, keys).groupBy(*keys, "node").agg(F.max_by("anc", "depth").alias("root"))


def root_path(tree: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, node, path``: the nodes from each node up to its root."""
    steps = closure(tree, keys).groupBy(*keys, "node").agg(F.array_sort(F.collect_list(F.struct("depth", "anc"))).alias("s_"))
    return steps.select(*keys, "node", F.transform("s_", lambda s: s["anc"]).alias("path"))


def path_to(tree: DataFrame, targets: DataFrame, keys: Keys = (), strict: bool = True) -> DataFrame:
    """``keys, node, target, path``: the nodes from ``node`` up to ``target``; a node without a parent has an empty path.

    A target that is no ancestor raises ``UnreachableAncestor`` if ``strict``, else its path is null.
    """
    keys = list(keys)
    known = closure(tree, keys)
    has_parent = tree.where("parent is not null").select(*keys, "node").distinct().withColumn("up_", F.lit(True))
    goal = targets.select(*keys, "node", "target").join(known.select(*keys, "node", F.col("anc").alias("target"), F.col("depth").alias("goal_")), [*keys, "node", "target"], "left").join(has_parent, [*keys, "node"], "left")
    if strict and not goal.where("goal_ is null and up_").isEmpty():
        raise UnreachableAncestor("a target is no ancestor of its node")
    steps = goal.join(known, [*keys, "node"], "left").where("depth <= goal_").groupBy(*keys, "node", "target").agg(F.array_sort(F.collect_list(F.struct("depth", "anc"))).alias("s_"))
    out = goal.join(steps, [*keys, "node", "target"], "left")
    path = F.when(F.col("up_").isNull(), F.array().cast(dict(tree.select(F.array("node").alias("a")).dtypes)["a"])).otherwise(F.transform("s_", lambda s: s["anc"]))
    return out.select(*keys, "node", "target", path.alias("path"))


def leaves(tree: DataFrame, keys: Keys = (), prop: DataFrame | None = None) -> DataFrame:
    """``keys, node, leaf``: the leaves below every node.

    With ``prop`` (keys, node, flag) only nodes whose flag is true count: a leaf is a true node without a true child,
    reached through true nodes; a missing flag counts as false.
    """
    keys = list(keys)
    if prop is not None:
        true = prop.where("flag").select(*keys, "node").distinct()
        tree = tree.join(true, [*keys, "node"], "left_semi").join(true.withColumnRenamed("node", "parent"), [*keys, "parent"], "left_semi")
        known = closure(tree, keys).unionByName(true.select(*keys, "node", F.col("node").alias("anc"), F.lit(0).cast("long").alias("depth"))).distinct()
    else:
        known = closure(tree, keys)
    inner = tree.where("parent is not null").select(*keys, F.col("parent").alias("node")).distinct()
    return known.join(inner, [*keys, "node"], "left_anti").select(*keys, F.col("anc").alias("node"), F.col("node").alias("leaf"))


def cut(tree: DataFrame, prop: DataFrame, threshold: float, keys: Keys = ()) -> DataFrame:
    """``keys, node``: the roots, and all nodes reached from them through values of ``threshold`` or more.

    ``prop`` has keys, node, value; a node without a value is excluded. A node is in the cut if every node on its path
    but the root has a value that large.
    """
    keys = list(keys)
    known = closure(tree, keys)
    good = prop.where(F.col("value") >= threshold).select(*keys, F.col("node").alias("anc")).distinct().withColumn("good_", F.lit(1))
    flag = F.coalesce("good_", F.lit(0))
    passed = known.join(good, [*keys, "anc"], "left").groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("all_"), F.max_by(flag, "depth").alias("top_"), F.sum(flag).alias("sum_"))
    return passed.where(F.col("sum_") - F.col("top_") == F.col("all_") - 1).select(*keys, "node")


def cut_property(nodes: DataFrame, tree: DataFrame, name: str, value: str, threshold: float, keys: Keys = ()) -> DataFrame:
    """``nodes`` with a boolean column ``name``: whether the cut on column ``value`` has the node."""
    if value not in nodes.columns:
        raise UnknownNodeProperty(f"no node property {value!r}")
    found = cut(tree, nodes.select(*keys, "node", F.col(value).alias("value")), threshold, keys).withColumn("in_", F.lit(True))
    return nodes.join(found, [*keys, "node"], "left").withColumn(name, F.coalesce("in_", F.lit(False))).drop("in_")


def common_ancestors(tree: DataFrame, pairs: DataFrame, keys: Keys = (), strict: bool = True) -> DataFrame:
    """``keys, a, b, lca, d_a, d_b`` of pairs: the nearest node above or equal to both, and the steps to it.

    Pairs without one, and pairs with a root (which has no parent), raise ``UnrelatedNode`` if ``strict``, else go.
    """
    keys = list(keys)
    known = closure(tree, keys)
    child = tree.where("parent is not null").select(*keys, "node").distinct()
    pairs = pairs.select(*keys, "a", "b").distinct()
    usable = pairs.join(child.withColumnRenamed("node", "a"), [*keys, "a"], "left_semi").join(child.withColumnRenamed("node", "b"), [*keys, "b"], "left_semi")
    up = lambda side: known.select(*keys, F.col("node").alias(side), "anc", F.col("depth").alias(f"d_{side}"))
    met = usable.join(up("a"), [*keys, "a"]).join(up("b"), [*keys, "b", "anc"])
    out = met.groupBy(*keys, "a", "b").agg(F.min_by(F.struct("anc", "d_a", "d_b"), F.col("d_a") + F.col("d_b")).alias("m")).select(*keys, "a", "b", F.col("m.anc").alias("lca"), "m.d_a", "m.d_b")
    if strict and not pairs.join(out, [*keys, "a", "b"], "left_anti").isEmpty():
        raise UnrelatedNode("a pair has no common ancestor, or one of its nodes is a root")
    return out


def edge_distance(tree: DataFrame, pairs: DataFrame, keys: Keys = (), strict: bool = True) -> DataFrame:
    """``keys, a, b, edge_dist, hops``: nodes on the path between two nodes, and the edges (one less)."""
    met = common_ancestors(tree, pairs, keys, strict)
    return met.select(*keys, "a", "b", (F.col("d_a") + F.col("d_b") + 1).alias("edge_dist"), (F.col("d_a") + F.col("d_b")).alias("hops"))


def weighted_distance(tree: DataFrame, pairs: DataFrame, weights: DataFrame, keys: Keys = (), strict: bool = True) -> DataFrame:
    """``keys, a, b, weighted_dist``: the weights (keys, node, weight) on the path without its ends, summed.

    A node on a path without a weight raises ``UnknownNodeProperty`` if ``strict``, else it makes the sum null.
    """
    keys = list(keys)
    met = common_ancestors(tree, pairs, keys, strict)
    known = closure(tree, keys)
    side = lambda s: met.join(known.select(*keys, F.col("node").alias(s), F.col("anc").alias("on"), "depth"), [*keys, s]).where(F.col("depth") <= F.col(f"d_{s}")).select(*keys, "a", "b", "on")
    inner = side("a").unionByName(side("b")).distinct().where("on != a and on != b").join(weights.select(*keys, F.col("node").alias("on"), "weight"), [*keys, "on"], "left")
    sums = inner.groupBy(*keys, "a", "b").agg(F.sum("weight").alias("s_"), F.count_if(F.col("weight").isNull()).alias("missing_"))
    if strict and not sums.where("missing_ > 0").isEmpty():
        raise UnknownNodeProperty("a node on a path has no weight")
    out = met.select(*keys, "a", "b").join(sums, [*keys, "a", "b"], "left")
    return out.select(*keys, "a", "b", F.when(F.coalesce("missing_", F.lit(0)) > 0, F.lit(None)).otherwise(F.coalesce("s_", F.lit(0.0))).cast("double").alias("weighted_dist"))


class Tree:
    """One tree, or many under ``keys``, with node properties as columns of ``nodes``."""

    def __init__(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, parents: DataFrame | None = None, children: DataFrame | None = None, keys: Keys = ()) -> None:
        """``edges`` has (parent, child) and wins over the other forms, with a warning."""
        self.keys = list(keys)
        if edges is not None:
            if parents is not None or children is not None:
                warnings.warn("edges are given, so parents and children are ignored", GridloomWarning, stacklevel=2)
            self.table = edges.select(*self.keys, F.col("child").alias("node"), "parent").distinct()
        else:
            self.table = complete(parents, children, self.keys)
        own = self.table.select(*self.keys, "node").union(self.table.select(*self.keys, F.col("parent").alias("node"))).distinct()
        self.nodes = own if nodes is None else own.join(nodes, [*self.keys, "node"], "full")

    @property
    def parents(self) -> DataFrame:
        return self.table.select(*self.keys, "node", "parent")

    @property
    def children(self) -> DataFrame:
        return self.table.groupBy(*self.keys, F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("node")).alias("children"))

    def add_edges(self, edges: DataFrame) -> Tree:
        """A tree with more (parent, child) rows."""
        more = edges.select(*self.keys, F.col("child").alias("node"), "parent")
        return Tree(nodes=self.nodes, parents=self.table.unionByName(more), keys=self.keys)

    def root(self) -> DataFrame:
        return roots(self.table, self.keys)

    def root_path(self) -> DataFrame:
        return root_path(self.table, self.keys)

    def leaves(self, prop: str | None = None) -> DataFrame:
        return leaves(self.table, self.keys, None if prop is None else self.nodes.select(*self.keys, "node", F.col(prop).alias("flag")))

    def cut_on_property(self, name: str, prop: str, threshold: float) -> Tree:
        """The tree with a boolean node property ``name``."""
        out = Tree(parents=self.table, keys=self.keys)
        out.nodes = cut_property(self.nodes, self.table, name, prop, threshold, self.keys)
        return out

    def common_ancestor(self, pairs: DataFrame) -> DataFrame:
        return common_ancestors(self.table, pairs, self.keys)

    def edge_dist(self, pairs: DataFrame) -> DataFrame:
        return edge_distance(self.table, pairs, self.keys)

    def weighted_dist(self, pairs: DataFrame, weights: DataFrame | str) -> DataFrame:
        """Weights are a table (keys, node, weight) or the name of a node property."""
        if isinstance(weights, str):
            if weights not in self.nodes.columns:
                raise UnknownNodeProperty(f"no node property {weights!r}")
            weights = self.nodes.select(*self.keys, "node", F.col(weights).alias("weight"))
        return weighted_distance(self.table, pairs, weights, self.keys)
