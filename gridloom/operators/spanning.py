"""Minimum spanning forests by Borůvka rounds, and the binary merge tree of their edges."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .components import stars

Keys = Sequence[str]


def spanning_forest(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """The minimum spanning forest of ``keys, src, dst, weight``, edges tied by ``least(src, dst), greatest(src, dst)``.

    In each round every component takes its lightest edge outward and the components joined by them become one, so
    their number at least halves. Edges inside a component leave the table. Ties are total, so the forest is unique.
    """
    keys = list(keys)
    node = lambda c: F.struct(*keys, F.col(c)) if keys else F.struct(F.col(c))
    rank = F.struct("weight", F.col("src").alias("s"), F.col("dst").alias("d"))
    base = edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src != dst")
    base = base.groupBy(*keys, "src", "dst").agg(F.min("weight").alias("weight"))
    field = "struct<" + ",".join(f"`{k}`:{t}" for k, t in dict(base.select(*keys, F.col("src").alias("n")).dtypes).items()) + ">"
    named = lambda c: node(c).cast(field)
    left = written(base.select(*keys, "src", "dst", "weight", named("src").alias("a"), named("dst").alias("b")), "forest-edges")
    taken: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("c"), rank.alias("r"), *keys).unionByName(left.select(F.col("b").alias("c"), rank.alias("r"), *keys))
        best = written(ends.groupBy("c", *keys).agg(F.min("r").alias("r")).select(*keys, F.col("r.s").alias("src"), F.col("r.d").alias("dst"), F.col("r.weight").alias("weight")).distinct(), "forest-best")
        taken = best if taken is None else taken.unionByName(best)
        chosen = best.join(left.drop("weight"), [*keys, "src", "dst"]).select("a", "b")
        root = stars(chosen)
        to = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select(*keys, "src", "dst", "weight", F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")).where("a != b")
        left = written(moved, "forest-edges")
    return base.limit(0) if taken is None else taken.select(*keys, "src", "dst", "weight")


def merge_tree(forest: DataFrame, sizes: DataFrame, keys: Keys = ()) -> DataFrame:
    """The merge tree of a spanning forest: ``keys, node, left, right, weight, size``, a row a merge.

    Edges are taken by weight (then ends). Inner nodes are numbered from twice the number of edges on, or after the
    largest leaf where leaves have such numbers. ``sizes`` has keys, node, size of the leaves. Merging is a sequence, so each graph is one Arrow group; graphs run in parallel.
    """
    keys = list(keys)
    if not keys:
        return merge_tree(forest.withColumn("g_", F.lit(0)), sizes.withColumn("g_", F.lit(0)), ["g_"]).drop("g_")
    types = dict(forest.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", node long, left long, right long, weight double, size double"

    def run(key: tuple, edges: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["weight", "src", "dst"], kind="stable")
        top: dict[int, int] = {}
        size = dict(zip(leaves["node"], leaves["size"].astype(float), strict=True))

        def root(n: int) -> int:
            path = []
            while n in top:
                path.append(n)
                n = top[n]
            for p in path[:-1]:
                top[p] = n
            return n

        out, new = [], max(2 * len(edges), int(max(leaves["node"].max(), edges["src"].max(), edges["dst"].max())) + 1) if len(edges) else 0
        for a, b, w in zip(edges["src"], edges["dst"], edges["weight"], strict=True):
            ra, rb = root(a), root(b)
            top[ra] = top[rb] = new
            size[new] = size[ra] + size[rb]
            out.append((*key, new, ra, rb, float(w), size[new]))
            new += 1
        return pd.DataFrame(out, columns=[*keys, "node", "left", "right", "weight", "size"])

    return forest.groupBy(*keys).cogroup(sizes.groupBy(*keys)).applyInPandas(run, schema)


def tree_of_merges(merges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, node, parent`` of a merge tree: each merge is the parent of its own two parts."""
    return merges.select(*keys, F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
