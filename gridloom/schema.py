"""Schemas of the relations that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row a patch. x, y, dx, dy are level-0 pixels, size_x and size_y pixels of the patch's own level.
PATCHES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("global_id", T.StringType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("dx", T.IntegerType()),
    T.StructField("dy", T.IntegerType()),
    T.StructField("size_x", T.IntegerType()),
    T.StructField("size_y", T.IntegerType()),
    T.StructField("parent", T.StringType()),
])

#: One row a pyramid level of a slide.
SLIDES = T.StructType([
    T.StructField("slide", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("downsample", T.DoubleType()),
])

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("status", T.StringType())])
_SHAPE = T.StructType([T.StructField("points", T.ArrayType(_POINT))] + [T.StructField(n, T.StringType()) for n in ("id", "author", "text", "color", "label", "date")])

#: An annotation document; points are percent of the slide's width and height.
ANNOTATION = T.StructType([
    T.StructField("slide_id", T.StringType()),
    T.StructField("layers", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("color", T.StringType()), T.StructField("shapes", T.ArrayType(_SHAPE))]))),
])

_NUCLEUS = T.StructType([T.StructField("centroid", T.ArrayType(T.DoubleType())), T.StructField("contour", T.ArrayType(T.ArrayType(T.DoubleType())))])

#: A document of detected nuclei by id.
NUCLEI = T.StructType([T.StructField("nuc", T.MapType(T.StringType(), _NUCLEUS))])

#: A tree as one document; properties are name -> key -> number.
_PROPS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
TREE = T.StructType([
    T.StructField("nodes", T.ArrayType(T.StringType())),
    T.StructField("parents", T.MapType(T.StringType(), T.StringType())),
    T.StructField("children", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("nodeprops", _PROPS),
    T.StructField("edgeprops", _PROPS),
])
