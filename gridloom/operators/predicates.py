"""Filters on patch pixels and values, and the registries that name them.

Predicates on exploded or array pixels are column expressions. Filters on decoded images are callables from an array
to a boolean; several of them run in one Arrow UDF, so the cheap ones spare the dear ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OutOfBound, UnknownFilterError

ImageFilter = Callable[[np.ndarray], bool]


def has_signal(values: Column, tolerance: float = 1) -> Column:
    """Whether any value of an array is above the tolerance."""
    return F.exists(values, lambda v: v > tolerance)


def has_significant_signal(values: Column, share: float = 0.5, tolerance: float = 1) -> Column:
    """Whether more than ``share`` of the array's values are above the tolerance."""
    return F.size(F.filter(values, lambda v: v > tolerance)) > share * F.size(values)


def significant_groups(pixels: DataFrame, keys: Sequence[str], value: str, share: float = 0.5, tolerance: float = 1) -> DataFrame:
    """The patches (keys) of exploded pixels of which more than ``share`` are above the tolerance."""
    counts = pixels.groupBy(*keys).agg(F.count_if(F.col(value) > tolerance).alias("above"), F.count(F.col(value)).alias("pixels"))
    return counts.where(F.col("above") > share * F.col("pixels"))


def signal_filter(channel: int = 0, tolerance: float = 1) -> ImageFilter:
    return lambda image: bool((image[..., channel] > tolerance).any())


def significant_signal_filter(channel: int = 0, share: float = 0.5, tolerance: float = 1) -> ImageFilter:
    return lambda image: bool((image[..., channel] > tolerance).sum() > share * image.shape[0] * image.shape[1])


def lightness(image: np.ndarray) -> np.ndarray:
    """L* of an H x W x 3 image; bytes, or floats from 0 to 1."""
    rgb = image[..., :3] / 255.0 if image.dtype == np.uint8 else image[..., :3].astype(float)
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    y = linear @ np.array([0.212671, 0.715160, 0.072169])
    return 116 * np.where(y > 0.008856, np.cbrt(y), 7.787 * y + 16 / 116) - 16


def tissue_filter(black: float = 5, white: float = 90) -> ImageFilter:
    """Any pixel with a lightness strictly between the tolerances."""

    def keep(image: np.ndarray) -> bool:
        light = lightness(image)
        return bool(((light > black) & (light < white)).any())

    return keep


class Registry(dict[str, ImageFilter]):
    """Named filters; users may add their own."""

    def resolve(self, given: str | ImageFilter) -> ImageFilter:
        if callable(given):
            return given
        if isinstance(given, str) and given in self:
            return self[given]
        raise UnknownFilterError(f"no filter {given!r}; there are {sorted(self)}")


#: Names as users know them (fixed values).
IMAGE_FILTERS = Registry({"has-dapi": signal_filter(), "has-significant-dapi": significant_signal_filter(), "has-tissue-he": tissue_filter()})


def passes(image: np.ndarray, filters: Sequence[str | ImageFilter], registry: Registry = IMAGE_FILTERS) -> bool:
    """Whether an image passes all filters; the first that fails ends it."""
    return all(f(image) for f in [registry.resolve(f) for f in filters])


def image_predicate(filters: Sequence[str | ImageFilter], height: int, width: int, channels: int = 3, registry: Registry = IMAGE_FILTERS):
    """An Arrow UDF over raw image bytes that applies all filters in one go."""
    chain = [registry.resolve(f) for f in filters]

    @F.pandas_udf("boolean")
    def keep(images: pd.Series) -> pd.Series:
        shaped = (np.frombuffer(b, np.uint8).reshape(height, width, channels) for b in images)
        return pd.Series([all(f(a) for f in chain) for a in shaped], dtype=bool)

    return keep


def category(value: Column, bins: Mapping[int, tuple[float, float]]) -> Column:
    """The first bin with ``low <= value < high``, in the mapping's order; null outside all."""
    out = F.lit(None).cast("int")
    for name, (low, high) in reversed(list(bins.items())):
        out = F.when((value >= low) & (value < high), F.lit(name).cast("int")).otherwise(out)
    return out


def category_of(value: float, bins: Mapping[int, tuple[float, float]]) -> int:
    """The same for one number; raises ``OutOfBound`` outside all bins."""
    for name, (low, high) in bins.items():
        if low <= value < high:
            return name
    raise OutOfBound(f"{value} is in none of {dict(bins)}")


def categorized(df: DataFrame, column: str, bins: Mapping[int, tuple[float, float]], name: str = "category") -> DataFrame:
    """Rows with their bin; those outside all bins go."""
    return df.withColumn(name, category(F.col(column), bins)).where(F.col(name).isNotNull())
