"""Patch files as a stream: new files are read as they come, predictions counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PATCHES


def patch_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """Patches of the files that appear under ``path``."""
    return spark.readStream.schema(PATCHES).option("header", True).option("nullValue", "None").option("maxFilesPerTrigger", files_a_trigger).csv(path)


def level_counts(stream: DataFrame) -> DataFrame:
    """Patches so far by level."""
    return stream.groupBy("level").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame) -> DataFrame:
    """Each patch once, however often its file comes."""
    return stream.dropDuplicates(["global_id"])
