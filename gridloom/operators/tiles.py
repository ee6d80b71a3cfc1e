"""Patch grids over slide pyramids, flat and hierarchical, as lazy tables.

Slides come as one row a level (``schema.SLIDES``). Grids are made by exploding number sequences, so a plan without
masks or pixel filters has no shuffle at all. Counts are ``trunc((side - patch) / step) + 1`` on each axis with
``step = patch + interval``; fractional downsamples are truncated wherever they meet a coordinate.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, UnknownLevelError
from .masks import dilated

Pair = int | tuple[int, int]
Filter = Callable[[DataFrame], DataFrame]


def pair(value: Pair | Mapping[str, int]) -> tuple[int, int]:
    """A number stands for both axes; a mapping with x and y is taken too, with a warning."""
    if isinstance(value, Mapping):
        warnings.warn("give a pair instead of a mapping", DeprecationWarning, stacklevel=2)
        return int(value["x"]), int(value["y"])
    return (int(value), int(value)) if isinstance(value, (int, float)) else (int(value[0]), int(value[1]))


def steps(side: Column, patch: int, interval: int) -> Column:
    """Number of grid places on an axis."""
    if patch + interval <= 0:
        raise InvalidArgument("the interval must be larger than minus the patch side")
    return ((side.cast("double") - patch) / (patch + interval)).cast("long") + 1


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def regular_grid(df: DataFrame, width: str, height: str, patch: Pair, interval: Pair = 0) -> DataFrame:
    """One row a grid place: ``row, col``, ``gx, gy`` (pixels) and ``k`` (from 1, row by row)."""
    (px, py), (ix, iy) = pair(patch), pair(interval)
    nx, ny = steps(F.col(width), px, ix), steps(F.col(height), py, iy)
    out = df.withColumn("nx_", nx).withColumn("row", F.explode(_places(ny))).withColumn("col", F.explode(_places(F.col("nx_"))))
    out = out.withColumn("gx", F.col("col") * (px + ix)).withColumn("gy", F.col("row") * (py + iy))
    return out.withColumn("k", F.col("row") * F.col("nx_") + F.col("col") + 1).drop("nx_")


def window_grid(df: DataFrame, height: str, width: str, patch: int, step: int) -> DataFrame:
    """Windows ``i, j`` for dense segmentation: one more on each axis than ``regular_grid`` has; the last are clipped."""
    n = lambda side: ((F.col(side).cast("double") - (patch - step)) / step).cast("long") * step + 1
    places = lambda end: F.when(end > 0, F.sequence(F.lit(0).cast("long"), end - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("i", F.explode(places(n(height)))).withColumn("j", F.explode(places(n(width))))


def masked_grid(df: DataFrame, mask: DataFrame, width: str, height: str, patch: Pair, interval: Pair = 0, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """The grid places that the slide's mask covers; ``k`` counts these, row by row.

    ``mask`` has ``keys``, ``i, j`` of every true cell and ``mask_height, mask_width``. A grid place takes the cell
    whose centre is nearest: ``floor((place + 0.5) * mask side / grid side)``. ``k`` is the number of true places in
    the rows above, from one count a row, plus the place within its row, so no task sorts a whole slide.
    """
    (px, py), (ix, iy) = pair(patch), pair(interval)
    shape = mask.groupBy(*keys).agg(F.max("mask_height").alias("mh_"), F.max("mask_width").alias("mw_"))
    grid = regular_grid(df, width, height, patch, interval).drop("k").join(shape, list(keys))
    nearest = lambda place, n, cells: F.floor((F.col(place) + 0.5) * F.col(cells) / n).cast("long")
    grid = grid.withColumn("i", nearest("row", steps(F.col(height), py, iy), "mh_")).withColumn("j", nearest("col", steps(F.col(width), px, ix), "mw_"))
    kept = grid.join(mask.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct(), [*keys, "i", "j"], "left_semi").drop("i", "j", "mh_", "mw_")
    rows = kept.groupBy(*keys, "row").agg(F.count("*").alias("n_"))
    above = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(*keys, "row", above.alias("above_"))
    inside = F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col"))
    return kept.withColumn("k", inside).join(rows, [*keys, "row"]).withColumn("k", (F.col("k") + F.col("above_")).cast("long")).drop("above_")


def at_level(slides: DataFrame, level: int) -> DataFrame:
    """The slides' rows of one level."""
    return slides.where(F.col("level") == level)


def _patch_columns(level: int, size: tuple[int, int], mag: Column, x: Column, y: Column, ident: Column, parent: Column) -> list[Column]:
    return [
        ident.alias("id"), F.concat("slide", ident).alias("global_id"), x.cast("int").alias("x"), y.cast("int").alias("y"),
        F.lit(level).alias("level"), (size[0] * mag).cast("int").alias("dx"), (size[1] * mag).cast("int").alias("dy"),
        F.lit(size[0]).alias("size_x"), F.lit(size[1]).alias("size_y"), parent.alias("parent"),
    ]


def root_patches(slides: DataFrame, level: int, patch: Pair, interval: Pair = 0, offset: Pair = 0, mask: DataFrame | None = None) -> DataFrame:
    """Patches of one level: ``slide`` and the columns of ``schema.PATCHES``; ids ``#1, #2, ...`` row by row."""
    size, (ox, oy) = pair(patch), pair(offset)
    rows = at_level(slides, level)
    grid = masked_grid(rows, mask, "width", "height", patch, interval) if mask is not None else regular_grid(rows, "width", "height", patch, interval)
    mag = F.col("downsample").cast("long")
    ident = F.concat(F.lit("#"), F.col("k"))
    return grid.select("slide", *_patch_columns(level, size, mag, F.col("gx") * mag + ox, F.col("gy") * mag + oy, ident, F.lit(None).cast("string")))


def child_patches(parents: DataFrame, slides: DataFrame, level: int, patch: Pair, interval: Pair = 0) -> DataFrame:
    """Patches of ``level`` inside each of ``parents``; ids are the parent's and ``#1, #2, ...`` in the parent's grid."""
    size = pair(patch)
    downsample = at_level(slides, level).select(F.col("slide").alias("slide_"), F.col("downsample").cast("long").alias("mag_"))
    rows = parents.select("slide", F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), "dx", "dy")
    rows = rows.join(downsample, F.col("slide") == F.col("slide_")).drop("slide_")
    rows = rows.withColumn("w_", (F.col("dx") / F.col("mag_")).cast("long")).withColumn("h_", (F.col("dy") / F.col("mag_")).cast("long"))
    grid = regular_grid(rows, "w_", "h_", patch, interval)
    mag = F.col("mag_")
    ident = F.concat("pid", F.lit("#"), F.col("k"))
    return grid.select("slide", *_patch_columns(level, size, mag, F.col("gx") * mag + F.col("px"), F.col("gy") * mag + F.col("py"), ident, F.col("pid")))


def standard_filters(filters: object, top: int, low: int) -> dict[int, list[Filter]]:
    """Filters by level: a single one or a list holds for every level; a mapping gives each level its own."""
    levels = range(low, top + 1)
    if filters is None:
        return {k: [] for k in levels}
    if isinstance(filters, Mapping):
        if unknown := set(filters) - set(levels):
            raise UnknownLevelError(f"levels {sorted(unknown)} are outside {low}..{top}")
        return {k: list(filters.get(k, ())) for k in levels}
    given = list(filters) if isinstance(filters, (list, tuple)) else [filters]
    return {k: list(given) for k in levels}


def hierarchy(slides: DataFrame, top: int, low: int, patch: Pair, interval: Pair = 0, offset: Pair = 0, mask: DataFrame | None = None, filters: object = None) -> DataFrame:
    """Patches from level ``top`` down to ``low``; the children of a level lie in the patches that its filters keep.

    Ids are given before the filters, so they have gaps after them. The result is one lazy table; a level on which
    nothing is left ends the descent.
    """
    if top < low:
        raise InvalidArgument("the top level must not lie below the low level")
    by_level = standard_filters(filters, top, low)
    out, kept = None, None
    for level in range(top, low - 1, -1):
        kept = root_patches(slides, level, patch, interval, offset, mask) if kept is None else child_patches(kept, slides, level, patch, interval)
        for keep in by_level[level]:
            kept = keep(kept)
        out = kept if out is None else out.unionByName(kept)
    return out


def sample_positions(df: DataFrame, keys: tuple[str, ...], width: str, height: str, patch: Pair, n: int, seed: int = 0, mask: DataFrame | None = None) -> DataFrame:
    """``n`` random patch positions ``i, j`` (and ``k`` from 1) of each image; draws are hashes of seed, keys and number.

    Without a mask the draws are with replacement, ``n`` hashes an image. With ``mask`` (keys, i, j of true cells) they
    are without: the patch's centre is a true cell, half a patch and one from the border, the first ``n`` in hash order.
    """
    px, py = pair(patch)
    if mask is None:
        rows = df.where((F.col(width) >= px) & (F.col(height) >= py)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, "k").cast("binary")), 1, 12), 16, 10).cast("long")
        across, down = F.col(width).cast("long") - px + 1, F.col(height).cast("long") - py + 1
        return rows.withColumn("i", F.floor(draw / across) % down).withColumn("j", draw % across)
    hx, hy = px // 2, py // 2
    rows = df.join(mask.select(*keys, "i", "j"), list(keys))
    inner = (F.col("i") >= hy + 1) & (F.col("j") >= hx + 1) & (F.col("i") < F.col(height) - hy - 1) & (F.col("j") < F.col(width) - hx - 1)
    rows = rows.where(inner).withColumn("i", (F.col("i") - hy).cast("long")).withColumn("j", (F.col("j") - hx).cast("long"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, "i", "j").cast("binary"))
    ranked = rows.withColumn("order_", order).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("order_", "i", "j")))
    return ranked.where(F.col("k") <= n).drop("order_")


def preview_shapes(patches: DataFrame, slides: DataFrame, min_res: int = 512, cell: int = 20) -> DataFrame:
    """``slide_, s_, rows_, cols_``: scale and size of the thumbnails on which the patches are outlined."""
    base = at_level(slides, 0).select(F.col("slide").alias("slide_"), F.col("width").alias("w_"), F.col("height").alias("h_"))
    least = patches.groupBy("slide").agg(F.min(F.least("dx", "dy")).alias("side_"))
    scale = F.least(F.lit(1.0), F.greatest(F.lit(float(min_res)) / F.least("w_", "h_"), F.lit(float(cell)) / F.col("side_")))
    return base.join(least, F.col("slide") == F.col("slide_")).select("slide_", scale.alias("s_"), F.bround(F.col("h_") * scale).cast("long").alias("rows_"), F.bround(F.col("w_") * scale).cast("long").alias("cols_"))


def outline_pixels(patches: DataFrame, slides: DataFrame, min_res: int = 512, thickness: int = 2, cell: int = 20) -> DataFrame:
    """Thumbnail pixels ``slide, i, j`` that the patches' outlines cover, each once.

    The thumbnail's shorter side has ``min_res`` pixels at least, and enough for a patch side of ``cell`` pixels. An
    outline is its four edges, thickened to an odd width by a disk.
    """
    shape = preview_shapes(patches, slides, min_res, cell)
    rows = patches.join(shape, F.col("slide") == F.col("slide_"))
    edge = lambda v, limit: F.least(F.greatest(F.bround(v * F.col("s_")).cast("long"), F.lit(0)), F.col(limit) - 1)
    rows = rows.select("slide", "rows_", "cols_", edge(F.col("y"), "rows_").alias("top"), edge(F.col("y") + F.col("dy"), "rows_").alias("bottom"), edge(F.col("x"), "cols_").alias("left"), edge(F.col("x") + F.col("dx"), "cols_").alias("right"))
    across, down = F.sequence("left", "right"), F.sequence("top", "bottom")
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    line = F.concat(
        F.transform(across, lambda j: at(F.col("top"), j)), F.transform(across, lambda j: at(F.col("bottom"), j)),
        F.transform(down, lambda i: at(i, F.col("left"))), F.transform(down, lambda i: at(i, F.col("right"))),
    )
    pixels = rows.select("slide", "rows_", "cols_", F.inline(line)).distinct()
    pixels = dilated(pixels, ["slide", "rows_", "cols_"], thickness // 2)
    return pixels.where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < F.col("rows_")) & (F.col("j") < F.col("cols_"))).select("slide", "i", "j").distinct()
