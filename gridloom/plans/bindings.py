"""The library's relations, derived from the general tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_slides(spark: SparkSession, sf_dir: str, levels: int = 1) -> DataFrame:
    """Every part as a slide of ``levels`` levels; level 0 has the full size, each further one half of it."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "p_size")
    size = lambda side: (F.col("p_size") * side * F.expr(f"shiftleft(1, {levels - 1} - level)")).cast("long")
    return rows.select("slide", "level", size(7).alias("width"), size(5).alias("height"), F.expr("shiftleft(1, level)").cast("double").alias("downsample"))


def event_cells(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Events above a value as cells of a 40 x 15 mask for each event type."""
    rows = table(spark, sf_dir, "events").where(F.col("value") > least)
    return rows.select(F.col("event_type").alias("slide"), (F.col("event_id") % 40).alias("i"), (F.col("user_id") % 15).alias("j")).distinct()


def event_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as patches of side 10 with a value."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("slide"), (F.col("user_id") % 15 * 10).alias("x"), (F.col("event_id") % 40 * 10).alias("y"), "value")


def turn_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation as a binary heap: turn n hangs below turn (n - 1) div 2."""
    turns = table(spark, sf_dir, "conversations").where("turn > 0")
    return turns.select("conv_id", F.col("turn").alias("node"), F.expr("(turn - 1) div 2").alias("parent")).distinct()


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as a data set: tag is the quality, place the document's number."""
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("tag"), F.col("doc_id").alias("ord"))
