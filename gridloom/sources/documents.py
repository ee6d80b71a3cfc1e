"""JSON documents: annotations, nuclei, trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidNodeProps
from ..functions import paths as P
from ..operators.components import components
from ..operators.masks import in_polygon
from ..operators.neighbours import near_points
from ..schema import ANNOTATION, NUCLEI, TREE


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of annotation files: ``slide_id, layer, shape, xs, ys`` (percent)."""
    docs = spark.read.option("multiLine", True).schema(ANNOTATION).json(path)
    layers = docs.select("slide_id", F.explode("layers").alias("l")).select("slide_id", F.col("l.id").alias("layer"), F.posexplode("l.shapes").alias("shape", "s"))
    return layers.select("slide_id", "layer", "shape", F.col("s.points.x").alias("xs"), F.col("s.points.y").alias("ys"))


def annotated(shapes: DataFrame, label: str, x: Column, y: Column) -> DataFrame:
    """Shapes of a layer (any case) with ``inside``: whether the point (percent) lies in them."""
    return shapes.where(F.lower("layer") == label.lower()).withColumn("inside", in_polygon(x, y, F.col("xs"), F.col("ys")))


def annotation_mask(shapes: DataFrame, label: str, cells: DataFrame) -> DataFrame:
    """Cells (slide_id, i, j, mask_height, mask_width) whose corner lies in any shape of the layer."""
    wanted = shapes.where(F.lower("layer") == label.lower()).select("slide_id", "xs", "ys")
    rows = cells.join(wanted, "slide_id")
    inside = in_polygon(F.col("j") / F.col("mask_width") * 100, F.col("i") / F.col("mask_height") * 100, F.col("xs"), F.col("ys"))
    return rows.where(inside).select(*cells.columns).distinct()


def read_nuclei(spark: SparkSession, path: str) -> DataFrame:
    """Nuclei of slide files: ``file, nucleus, x, y``."""
    docs = spark.read.option("multiLine", True).schema(NUCLEI).json(path).select(F.col("_metadata.file_path").alias("file"), F.explode("nuc").alias("nucleus", "n"))
    return docs.select("file", "nucleus", F.get("n.centroid", F.lit(0)).alias("x"), F.get("n.centroid", F.lit(1)).alias("y"), F.col("n.contour").alias("contour"))


def nuclei_graph(nuclei: DataFrame, k: int = 5, dmax: float = 500.0) -> DataFrame:
    """The neighbour graph of each file's nuclei: ``file, src, dst, dist``."""
    return near_points(nuclei, "nucleus", "x", "y", k, dmax, ["file"])


def read_nuclei_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nuclei of tile files named ``x_y_level``: contours moved to the slide's pixels, ``folder, nucleus, contour``."""
    nuclei = read_nuclei(spark, folder)
    name = P.base_name(F.col("file"))
    part = lambda k: F.get(F.split(name, "_"), F.lit(k)).cast("double")
    moved = F.transform("contour", lambda p: F.array(p[0] + part(0), p[1] + part(1)))
    return nuclei.select(P.folder(F.col("file")).alias("folder"), F.concat_ws("/", name, "nucleus").alias("nucleus"), moved.alias("contour"))


def dissolve(nuclei: DataFrame, keys: Sequence[str] = ("folder",), cell: float = 256.0) -> DataFrame:
    """Overlapping contours as one nucleus: ``keys, nucleus, x, y, parts`` (whole-number centroid of the union).

    Bounding boxes meet in grid cells; contours whose pixels meet become one component, and the centroid is that of
    the union of their pixels.
    """
    keys = list(keys)
    xs, ys = (F.transform("contour", lambda p: p[0]), F.transform("contour", lambda p: p[1]))
    box = nuclei.select(*keys, "nucleus", "contour", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    placed = box.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    other = placed.select(*keys, "cx", "cy", *[F.col(c).alias(f"{c}_") for c in ("nucleus", "contour", "x0", "y0", "x1", "y1")])
    pairs = placed.join(other, [*keys, "cx", "cy"]).where("nucleus < nucleus_ and x0 <= x1_ and x0_ <= x1 and y0 <= y1_ and y0_ <= y1").dropDuplicates([*keys, "nucleus", "nucleus_"])

    @F.pandas_udf("boolean")
    def meet(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([not _raster(x).isdisjoint(_raster(y)) for x, y in zip(a, b, strict=True)])

    node = lambda n: F.struct(*keys, F.col(n).alias("nucleus"))
    edges = pairs.where(meet("contour", "contour_")).select(node("nucleus").alias("a"), node("nucleus_").alias("b"))
    named = components(nuclei.withColumn("node", node("nucleus")), edges)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.array(sorted(set().union(*map(_raster, pdf["contour"]))))
        x, y = cells.mean(axis=0).astype(int) if len(cells) else (0, 0)
        return pd.DataFrame([(*key, int(x), int(y), len(pdf))], columns=[*keys, "nucleus", "x", "y", "parts"])

    types = dict(nuclei.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", nucleus string, x int, y int, parts int"
    return named.select(*keys, F.col("root.nucleus").alias("nucleus"), "contour").groupBy(*keys, "nucleus").applyInPandas(run, schema)


def _raster(contour) -> set[tuple[int, int]]:
    """Pixels whose centre lies in a contour, and its corners' pixels."""
    points = np.asarray([list(p) for p in contour], float).reshape(-1, 2)
    out = {(int(x), int(y)) for x, y in points}
    if len(points) < 3:
        return out
    a, b = points, np.roll(points, -1, axis=0)
    for y in range(int(np.floor(points[:, 1].min())), int(np.ceil(points[:, 1].max())) + 1):
        for at in (y - 1e-9, y + 1e-9):  # a little below and above, so that the first and the last line both count
            hit = (a[:, 1] > at) != (b[:, 1] > at)
            xs = np.sort(a[hit, 0] + (at - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
            for left, right in zip(xs[::2], xs[1::2], strict=False):
                out.update((x, y) for x in range(int(np.ceil(left - 1e-6)), int(np.floor(right + 1e-6)) + 1))
    return out


def tree_document(tree: DataFrame, props: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON document a tree: ``keys, document`` with nodes, parents, children and node properties.

    ``props`` has keys, node, name, value (a number); other value types raise ``InvalidNodeProps``.
    """
    keys = list(keys)
    text = lambda c: F.col(c).cast("string")
    rows = tree.select(*keys, text("node").alias("node"), text("parent").alias("parent"))
    every = rows.select(*keys, "node").union(rows.select(*keys, F.col("parent"))).where("node is not null").distinct()
    group = (lambda df: df.groupBy(*keys)) if keys else (lambda df: df.groupBy(F.lit(0).alias("g_")))
    names = group(every).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    up = group(rows.where("parent is not null")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "parent")))).alias("parents"))
    down = rows.where("parent is not null").groupBy(*keys, "parent").agg(F.array_sort(F.collect_list("node")).alias("c"))
    down = group(down).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parent", "c")))).alias("children"))
    on = keys or ["g_"]
    out = names.join(up, on, "left").join(down, on, "left")
    if props is not None:
        if dict(props.dtypes)["value"] in ("string", "binary"):
            raise InvalidNodeProps("node properties are numbers or booleans")
        each = props.groupBy(*keys, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(text("node").alias("node"), F.col("value").cast("double").alias("value"))))).alias("m"))
        out = out.join(group(each).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("m").getField("m").alias("m"))), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).alias("nodeprops")), on, "left")
    fields = [c for c in out.columns if c not in on]
    return out.select(*keys, F.to_json(F.struct(*fields)).alias("document"))


def read_trees(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, node, parent`` and ``file, node, name, value`` of tree files."""
    docs = spark.read.option("multiLine", True).schema(TREE).json(path).withColumn("file", F.col("_metadata.file_path"))
    tree = docs.select("file", F.explode("parents").alias("node", "parent"))
    props = docs.select("file", F.explode("nodeprops").alias("name", "m")).select("file", "name", F.explode("m").alias("node", "value"))
    return tree, props.select("file", "node", "name", "value")
