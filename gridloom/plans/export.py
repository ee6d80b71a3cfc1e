"""From float predictions to annotation documents, all slides in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions
from ..operators.predicates import categorized
from ..sources.patches import predicted


def export_annotations(patches: DataFrame, slides: DataFrame, level: int, task: str, bins: Mapping[int, tuple[float, float]], classes: Mapping[int, tuple[str, str]], interval: int, out: str | None = None) -> DataFrame:
    """``slide, document`` for the predictions of column ``task``; written as one text file a slide if asked."""
    rows = categorized(predicted(patches, level, task), "value", bins).select("slide", "category", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    _, _, contours = regions.region_tables(rows, ["slide"], interval)
    found = regions.annotations(regions.polygons(contours, ["slide"], interval), slides, classes, task)
    if out is not None:
        found.repartition("slide").write.partitionBy("slide").text(out)
    return found
