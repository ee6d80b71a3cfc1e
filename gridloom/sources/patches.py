"""The patch relation on disk: reading, labels, predictions, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LevelNotFoundError, UnknownColumnError
from ..functions import paths as P
from ..schema import PATCHES


def read_patches(spark: SparkSession, paths: str | Sequence[str], extra: Sequence[tuple[str, str]] = (), file_name: str | None = None) -> DataFrame:
    """Patch files as one table, with ``slide_folder``; the word None at a root is null. ``extra`` are (name, type) of
    label and prediction columns. Columns are found by header, in any order. With ``file_name``, the files of that name
    at any depth below ``paths``."""
    schema = T.StructType([*PATCHES.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in extra)])
    raw = spark.read.option("header", True).option("nullValue", "None").option("enforceSchema", False)
    if file_name is not None:
        raw = raw.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
    names = raw.csv(paths if isinstance(paths, str) else list(paths)).columns
    known = {f.name: f for f in schema.fields}
    read = raw.schema(T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])).csv(paths if isinstance(paths, str) else list(paths))
    return read.withColumn("slide_folder", P.folder(F.col("_metadata.file_path")))


def with_label(patches: DataFrame, level: int | None = None, column: str | None = None) -> DataFrame:
    """Patches of one level with ``label``: the named column, or null where it does not exist."""
    rows = patches if level is None else patches.where(F.col("level") == level)
    label = F.col(column) if column is not None and column in patches.columns else F.lit(None).cast("string")
    return rows.withColumn("label", label)


def predicted(patches: DataFrame, level: int, column: str) -> DataFrame:
    """``x, y, interval, value, author``: the predictions of one level."""
    if column not in patches.columns:
        raise UnknownColumnError(f"no column {column!r}")
    return patches.where(F.col("level") == level).select(*[c for c in ("slide",) if c in patches.columns], "x", "y", F.col("dx").alias("interval"), F.col(column).alias("value"), F.lit(column).alias("author"))


def need_level(patches: DataFrame, level: int) -> DataFrame:
    out = patches.where(F.col("level") == level)
    if out.isEmpty():
        raise LevelNotFoundError(f"no patches at level {level}")
    return out


def with_predictions(patches: DataFrame, predictions: DataFrame, column: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Patches with ``column`` updated from predictions (keys, value); ids that are new are added, others keep theirs."""
    new = predictions.select(*keys, F.col("value").alias("value_"))
    old = F.col(column) if column in patches.columns else F.lit(None).cast(dict(predictions.dtypes)["value"])
    rows = patches.withColumn(column, old).join(new, list(keys), "full")
    return rows.withColumn(column, F.coalesce("value_", column)).drop("value_")


def write_patches(patches: DataFrame, path: str, by: Sequence[str] = ("slide",), mode: str = "errorifexists") -> None:
    """Patch files, one folder a slide, coarse levels first within a file; null parents are written as None."""
    named = [c for c in by if c in patches.columns]
    rows = patches.repartition(*named).sortWithinPartitions(*named, F.desc("level"), "y", "x") if named else patches.sortWithinPartitions(F.desc("level"), "y", "x")
    writer = rows.write.mode(mode).option("header", True).option("nullValue", "None")
    (writer.partitionBy(*named) if named else writer).csv(path)


def wide_features(features: DataFrame, size: int, vector: str = "features") -> DataFrame:
    """``id, level, x, y`` and the vector's parts as columns "0", "1", ..."""
    return features.select("id", "level", "x", "y", *[F.get(vector, F.lit(k)).alias(str(k)) for k in range(size)])


def write_features(features: DataFrame, path: str, size: int, vector: str = "features", mode: str = "errorifexists") -> None:
    wide_features(features, size, vector).write.mode(mode).option("header", True).csv(path)
