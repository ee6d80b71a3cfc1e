"""Colour spaces as column expressions: sRGB bytes to CIE L*a*b* (D65)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnknownMethodError

#: Linear sRGB to XYZ, and the D65 white.
XYZ_OF_RGB = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def _linear(byte: Column) -> Column:
    v = byte.cast("double") / 255
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L*, a*, b* of sRGB bytes."""
    rgb = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(XYZ_OF_RGB, WHITE, strict=True):
        t = sum((c * k for c, k in zip(rgb, row, strict=True)), F.lit(0.0)) / white
        f.append(F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def tissue_rgb(r: Column, g: Column, b: Column, black: float = 0, white: float = 230) -> Column:
    """Whether any channel lies strictly between the tolerances."""
    return reduce(or_, [(c > black) & (c < white) for c in (r, g, b)])


def tissue_lab(r: Column, g: Column, b: Column, black: float = 5, white: float = 90) -> Column:
    """Whether the lightness lies strictly between the tolerances."""
    light = lab(r, g, b)[0]
    return (light > black) & (light < white)


def tissue(r: Column, g: Column, b: Column, black: float, white: float, method: str = "lab") -> Column:
    """Tissue by the named method: ``rgb`` or ``lab``."""
    methods = {"rgb": tissue_rgb, "lab": tissue_lab}
    if method not in methods:
        raise UnknownMethodError(f"no tissue method {method!r}; there are {sorted(methods)}")
    return methods[method](r, g, b, black, white)


def usable_thumbnail(r: Column, g: Column, b: Column) -> Column:
    """Thumbnail pixels that are tissue: neither background nor red or blue pen (``&`` binds before ``|``)."""
    l, a, y = lab(r, g, b)  # noqa: E741
    return ((a > 10) | ((a > 5) & (y > -10) & (l > 40))) & ((a < 50) | (y < 90)) & (l < 95) & (l > 10)
