"""Categorical regions: binned patches to lattices, components, contours and polygons.

Every patch adds its four corners to the lattice of its class; corners one interval apart (8 neighbours) are linked,
so patches with a gap of one patch, or touching by a corner, fall into one region. A region's contour points have
fewer than 8 neighbours; a wall follower in four directions traces the outer loop from the lowest, then leftmost, one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BottomLeftNotFound, InvalidArgument, NextPointNotFound, NoPathFound
from ..storage import written
from .components import stars

Keys = Sequence[str]

#: Steps to the 8 neighbours.
AROUND = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))
#: Colours that a class may use (fixed number).
PALETTE_SIZE = 18


def corners(patches: DataFrame, keys: Keys, layer: str = "category") -> DataFrame:
    """Distinct lattice nodes ``keys, layer, x, y`` of patches (keys, layer, x, y, interval)."""
    corner = F.explode(F.array(*[F.struct((F.col("x") + F.col("interval") * a).alias("x"), (F.col("y") + F.col("interval") * b).alias("y")) for a in (0, 1) for b in (0, 1)]))
    return patches.select(*keys, F.col(layer).alias("layer"), corner.alias("c")).select(*keys, "layer", "c.x", "c.y").distinct()


def lattice_edges(nodes: DataFrame, keys: Keys, interval: int) -> DataFrame:
    """Directed edges ``keys, layer, x, y, x2, y2`` between nodes that are neighbours."""
    step = F.explode(F.array(*[F.struct((F.col("x") + interval * a).alias("x2"), (F.col("y") + interval * b).alias("y2")) for a, b in AROUND]))
    asked = nodes.select(*keys, "layer", "x", "y", step.alias("o")).select(*keys, "layer", "x", "y", "o.x2", "o.y2")
    there = nodes.select(*keys, "layer", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return asked.join(there, [*keys, "layer", "x2", "y2"]).select(*keys, "layer", "x", "y", "x2", "y2")


def segments(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Nodes with their region: ``keys, layer, x, y, seg_y, seg_x`` (its least node by y, then x)."""
    node = lambda x, y: F.struct(*keys, "layer", F.col(y).alias("y"), F.col(x).alias("x"))
    found = stars(edges.select(node("x", "y").alias("a"), node("x2", "y2").alias("b"))).select(F.col("node").alias("n_"), "root")
    rows = nodes.withColumn("n_", node("x", "y")).join(found, "n_", "left").withColumn("root", F.coalesce("root", "n_"))
    return rows.select(*keys, "layer", "x", "y", F.col("root.y").alias("seg_y"), F.col("root.x").alias("seg_x"))


def contour_points(labelled: DataFrame, edges: DataFrame, keys: Keys, neighbours: int = 8) -> DataFrame:
    """The labelled nodes with fewer than ``neighbours`` neighbours."""
    degree = edges.groupBy(*keys, "layer", "x", "y").agg(F.count("*").alias("degree"))
    rows = labelled.join(degree, [*keys, "layer", "x", "y"], "left")
    return rows.where(F.coalesce("degree", F.lit(0)) < neighbours).drop("degree")


def bottom_left(points: set[tuple[int, int]]) -> tuple[int, int]:
    """The lowest point (largest y), the leftmost of equals."""
    if not points:
        raise BottomLeftNotFound("a contour without points")
    return min(points, key=lambda p: (-p[1], p[0]))


def trace(points: set[tuple[int, int]], interval: int) -> list[tuple[int, int]]:
    """The loop from the bottom left point, facing up, that turns left where it can, then goes on, right, or back."""
    start = bottom_left(points)
    at, facing, path, seen = start, (0, -interval), [start], set()
    while True:
        dx, dy = facing
        for way in ((dy, -dx), (dx, dy), (-dy, dx), (-dx, -dy)):
            if (at[0] + way[0], at[1] + way[1]) in points:
                at, facing = (at[0] + way[0], at[1] + way[1]), way
                break
        else:
            raise NextPointNotFound(f"nothing to go to from {at}")
        if at == start:
            return path
        if (at, facing) in seen:
            raise NoPathFound("the walk does not return to its start")
        seen.add((at, facing))
        path.append(at)


def polygons(contours: DataFrame, keys: Keys, interval: int, by_part: bool = False) -> DataFrame:
    """One traced loop a region: ``keys, layer, seg_y, seg_x, xs, ys, complete, problem``.

    ``complete`` tells whether the loop spans the contour's bounding box; regions that hang together by a corner only
    are traced in part, unless ``by_part`` splits them into pieces that the walk can reach. A region that cannot be
    traced has null points and says why.
    """
    keys = list(keys)
    types = dict(contours.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "layer"]) + ", seg_y long, seg_x long, xs array<long>, ys array<long>, complete boolean, problem string"

    def pieces(points: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
        out, left = [], set(points)
        while left:
            todo, part = [left.pop()], set()
            while todo:
                p = todo.pop()
                part.add(p)
                for a, b in ((interval, 0), (-interval, 0), (0, interval), (0, -interval)):
                    q = (p[0] + a, p[1] + b)
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            out.append(part)
        return sorted(out, key=lambda s: min((y, x) for x, y in s))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = set(zip(pdf["x"].astype(int).tolist(), pdf["y"].astype(int).tolist(), strict=True))
        out = []
        for part in pieces(points) if by_part else [points]:
            try:
                path = trace(part, interval)
                span = lambda ps: (min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps))
                out.append((*key, [p[0] for p in path], [p[1] for p in path], span(path) == span(part), None))
            except (NoPathFound, NextPointNotFound, BottomLeftNotFound) as e:
                out.append((*key, None, None, False, str(e)))
        return pd.DataFrame(out, columns=[*keys, "layer", "seg_y", "seg_x", "xs", "ys", "complete", "problem"])

    cast = contours.withColumn("seg_y", F.col("seg_y").cast("long")).withColumn("seg_x", F.col("seg_x").cast("long"))
    return cast.groupBy(*keys, "layer", "seg_y", "seg_x").applyInPandas(run, schema)


def annotations(shapes: DataFrame, slides: DataFrame, classes: Mapping[int, tuple[str, str]], author: str, date: str = "", key: str = "slide") -> DataFrame:
    """One JSON document a slide: ``slide, document``; points are percent of its width and height (level 0).

    ``classes`` maps a layer to its name and colour. Shapes are numbered by their place (y, then x) in the layer.
    """
    if len(classes) > PALETTE_SIZE:
        raise InvalidArgument(f"at most {PALETTE_SIZE} classes have a colour")
    names = F.create_map(*[F.lit(v) for k, (name, _) in classes.items() for v in (k, name)])
    colours = F.create_map(*[F.lit(v) for k, (_, colour) in classes.items() for v in (k, colour)])
    rows = shapes.where("xs is not null").join(slides.where("level = 0").select(F.col("slide").alias(key), "width", "height"), key)
    point = lambda x, y: F.struct((x / F.col("width") * 100).alias("x"), (y / F.col("height") * 100).alias("y"), F.lit("written").alias("status"))
    rows = rows.withColumn("points", F.zip_with("xs", "ys", point)).withColumn("name", F.try_element_at(names, F.col("layer"))).withColumn("color", F.try_element_at(colours, F.col("layer")))
    rows = rows.withColumn("label", F.concat_ws("_", F.lit(author), "name"))
    layers = rows.groupBy(key, "layer", "label", "color").agg(F.array_sort(F.collect_list(F.struct("seg_y", "seg_x", "points"))).alias("s"))
    shape = lambda s, i: F.struct(s["points"].alias("points"), i.cast("string").alias("id"), F.lit(author).alias("author"), F.col("label").alias("text"), F.col("color"), F.col("label"), F.lit(date).alias("date"))
    layers = layers.select(key, F.struct("layer", F.col("label").alias("id"), "color", F.transform("s", shape).alias("shapes")).alias("l"))
    found = layers.groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("l"))
    plain = F.transform("l", lambda v: F.struct(v["id"].alias("id"), v["color"].alias("color"), v["shapes"].alias("shapes")))
    return found.select(key, F.to_json(F.struct(F.col(key).alias("slide_id"), plain.alias("layers"))).alias("document"))


def region_tables(patches: DataFrame, keys: Keys, interval: int, layer: str = "category") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lattice nodes with their regions, lattice edges, and contour points."""
    nodes = written(corners(patches.withColumn("interval", F.lit(interval)), keys, layer), "lattice")
    edges = written(lattice_edges(nodes, keys, interval), "lattice-edges")
    labelled = written(segments(nodes, edges, keys), "regions")
    return labelled, edges, contour_points(labelled, edges, keys)
