"""Masks as tables of true cells: Otsu thresholds, small-object removal, thumbnail filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import usable_thumbnail
from ..storage import written
from .components import stars

#: Neighbours of a cell that are looked at once (the others look back).
HALF_NEIGHBOURS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}


def histogram(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, v, n``: how often each value occurs."""
    return values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def otsu(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Otsu's threshold of each group of a histogram (keys, v, n): ``keys, threshold``.

    The threshold is the value whose split (up to it, above it) has the largest variance between the two sides; the
    smallest of equals. A single value is its own threshold. Only the histogram, not the pixels, is sorted.
    """
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    sums = bars.withColumn("w", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("n") * F.col("v")).over(upto))
    sums = sums.withColumn("all_w", F.sum("n").over(whole)).withColumn("all_s", F.sum(F.col("n") * F.col("v")).over(whole))
    w, s, total, moment = (F.col(c).cast("double") for c in ("w", "s", "all_w", "all_s"))
    # Between-class variance times the squared total: (S w - s W)^2 / (w (W - w)).
    spread = F.when(total > w, (moment * w - s * total) * (moment * w - s * total) / (w * (total - w))).otherwise(F.lit(-1.0))
    best = F.max(F.struct(spread.alias("spread"), (-F.col("v")).alias("v"))).alias("best")
    return sums.groupBy(*keys).agg(best).select(*keys, (-F.col("best.v")).alias("threshold"))


def labels(cells: DataFrame, keys: Sequence[str], connectivity: int = 4) -> DataFrame:
    """Cells with ``root``: the least cell (i, j) of each one's component within its keys."""
    cell = F.struct(*keys, "i", "j")
    base = cells.select(*keys, "i", "j").distinct()
    other = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in HALF_NEIGHBOURS[connectivity]]))
    looked = base.select(*keys, cell.alias("a"), other.alias("o")).select(*keys, "a", F.col("o.i").alias("i"), F.col("o.j").alias("j"))
    edges = looked.join(base, [*keys, "i", "j"]).select("a", cell.alias("b"))
    found = stars(edges).select(F.col("node").alias("cell_"), "root")
    out = base.withColumn("cell_", cell).join(found, "cell_", "left")
    return out.select(*keys, "i", "j", F.coalesce("root", "cell_").alias("root"))


def remove_small_objects(cells: DataFrame, keys: Sequence[str], percent: float = 10, avoid_overmask: bool = True, factor: float = 1.0, connectivity: int = 4) -> DataFrame:
    """The cells of components that are large enough, mask by mask.

    The least size is ``int(factor * area * percent / 100)``. While that would erase ``percent`` of the mask or more, it
    is lowered by a fifth. Component sizes do not change between tries, so they are counted once; the tries are a
    sequence of least sizes tested against them, and the first one that erases little enough holds.
    """
    found = written(labels(cells, keys, connectivity), "mask-labels")
    sizes = written(found.groupBy(*keys, "root").agg(F.count("*").alias("size")), "mask-sizes")
    area = sizes.groupBy(*keys).agg(F.sum("size").alias("area"))
    tries = [F.struct(F.lit(k).alias("k"), (F.lit(f) * F.col("area") * percent / 100).cast("long").alias("least")) for k, f in enumerate(_factors(factor if avoid_overmask else None, factor))]
    each = area.select(*keys, "area", F.explode(F.array(*tries)).alias("t")).select(*keys, "area", "t.k", "t.least")
    left = each.join(sizes, list(keys)).groupBy(*keys, "area", "k", "least").agg(F.sum(F.when(F.col("size") >= F.col("least"), F.col("size")).otherwise(0)).alias("left"))
    erased = 100 - F.col("left") / F.col("area") * 100
    fine = left.where((erased < percent) | (F.col("least") < 1) | F.lit(not avoid_overmask))
    least = fine.groupBy(*keys).agg(F.min_by("least", "k").alias("least"))
    large = sizes.join(least, list(keys)).where(F.col("size") >= F.col("least")).select(*keys, "root")
    return found.join(large, [*keys, "root"], "left_semi").select(*keys, "i", "j")


def _factors(start: float | None, only: float) -> list[float]:
    """The factors that are tried: each 0.8 of the one before, until no mask of 2**40 cells has a least size of 1."""
    if start is None:
        return [only]
    out = [start]
    while out[-1] * 2.0**40 >= 1 and len(out) < 160:
        out.append(out[-1] * 0.8)
    return out


def disk(radius: int) -> list[tuple[int, int]]:
    """The cells (rows, columns from the middle) of a disk."""
    span = range(-radius, radius + 1)
    return [(a, b) for a in span for b in span if a * a + b * b <= radius * radius]


def dilated(cells: DataFrame, keys: Sequence[str], radius: int, shape: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The cells that a disk (or the given cells) round any true cell covers, each once; borders are not known here."""
    around = list(shape) if shape is not None else disk(radius)
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around]))
    moved = cells.select(*keys, "i", "j", offsets.alias("o"))
    return moved.select(*keys, (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j")).distinct()


def tissue_mask(pixels: DataFrame, keys: Sequence[str], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Tissue cells of stained thumbnails (keys, i, j, r, g, b), small objects removed."""
    return remove_small_objects(pixels.where(usable_thumbnail(F.col(r), F.col(g), F.col(b))).select(*keys, "i", "j"), keys)


def fluorescent_mask(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Cells of fluorescent thumbnails (keys, i, j, value) above the second of two Otsu thresholds.

    The first threshold finds the scanned, brighter pixels; they count as 0 for the second. The input is not changed.
    """
    bars = written(histogram(pixels, keys, value), "mask-bars")
    first = otsu(bars, keys).withColumnRenamed("threshold", "first_")
    dimmed = bars.join(first, list(keys)).select(*keys, F.when(F.col("v") > F.col("first_"), F.lit(0)).otherwise(F.col("v")).alias("v"), "n")
    second = otsu(dimmed.groupBy(*keys, "v").agg(F.sum("n").alias("n")), keys).withColumnRenamed("threshold", "second_")
    limits = first.join(second, list(keys))
    cells = pixels.join(limits, list(keys)).where((F.col(value) <= F.col("first_")) & (F.col(value) > F.col("second_")))
    return remove_small_objects(cells.select(*keys, "i", "j"), keys)


def all_of(masks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Cells that every mask has."""
    out = masks[0].select(*keys, "i", "j").distinct()
    for m in masks[1:]:
        out = out.join(m.select(*keys, "i", "j"), [*keys, "i", "j"], "left_semi")
    return out


def in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a point lies inside a polygon given by two arrays: an odd number of its edges cross the ray to the right."""
    n = F.size(xs)
    crossing = lambda k: _crosses(x, y, F.get(xs, k), F.get(ys, k), F.get(xs, (k + 1) % n), F.get(ys, (k + 1) % n))
    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + F.when(crossing(k), 1).otherwise(0)) % 2 == 1).otherwise(F.lit(False))


def _crosses(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
