"""Integer pixel coordinates as column expressions.

Every operand is made an integer first, so a factor of 2.5 scales by 2; division truncates toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = Column | int | float | str


def whole(value: Operand) -> Column:
    """The operand as an integer, its fraction cut off."""
    if isinstance(value, (int, float)):
        return F.lit(int(value)).cast("long")
    return (F.col(value) if isinstance(value, str) else value).cast("double").cast("long")


def add(a: Operand, b: Operand) -> Column:
    return whole(a) + whole(b)


def subtract(a: Operand, b: Operand) -> Column:
    return whole(a) - whole(b)


def times(a: Operand, b: Operand) -> Column:
    return whole(a) * whole(b)


def over(a: Operand, b: Operand) -> Column:
    """Division toward zero, of integers; ``/`` and ``//`` are the same on coordinates."""
    return (whole(a) / whole(b)).cast("long")


def negative(a: Operand) -> Column:
    return -whole(a)


def point(x: Operand, y: Operand | None = None) -> Column:
    """A coordinate as a struct; a single number stands for both axes."""
    return F.struct(whole(x).alias("x"), whole(x if y is None else y).alias("y"))


def relative(x: Operand, y: Operand, width: Operand, height: Operand) -> tuple[Column, Column]:
    """A position as shares of the width and height."""
    as_double = lambda v: (F.lit(v) if isinstance(v, (int, float)) else F.col(v) if isinstance(v, str) else v).cast("double")
    return as_double(x) / as_double(width), as_double(y) / as_double(height)


def if_none(value: Column, default: Operand) -> Column:
    """The value, or the default where it is null."""
    return F.coalesce(value, F.lit(default) if not isinstance(default, Column) else default)
