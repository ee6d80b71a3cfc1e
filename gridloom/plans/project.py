"""A project of patch files: listing, slide-level splits, features, batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets
from ..operators.semantic import Model, extract_features
from ..sources import discovery, patches, slides


@dataclass
class Project:
    """Patch folders under one root, and their slides under another."""

    spark: SparkSession
    project_root: str
    slide_root: str
    extensions: Sequence[str] = (".mrxs", ".svs")

    def folders(self) -> DataFrame:
        """``folder, slide_path`` of the patch folders that have a slide; the others are in ``missing``."""
        return self._found().where("slide_path is not null")

    def missing(self) -> DataFrame:
        return discovery.missing_slides(self._found())

    def _found(self) -> DataFrame:
        own = discovery.get_files(self.spark, self.project_root, [".csv"])
        folders = discovery.need_patches(discovery.patch_folders(own))
        return discovery.slide_files(folders, discovery.get_files(self.spark, self.slide_root), self.project_root, self.slide_root, self.extensions)

    def list_patches(self, level: int | None = None, column: str | None = None, extra: Sequence[tuple[str, str]] = ()) -> DataFrame:
        """All slides' patches in one scan, from folders at any depth, with ``slide_path`` and ``label``."""
        rows = patches.with_label(patches.read_patches(self.spark, self.project_root, extra, discovery.PATCH_FILE), level, column)
        plain = lambda c: F.regexp_replace(F.col(c), "^file:/*", "/")
        folders = self.folders().select(plain("folder").alias("f_"), "slide_path")
        return rows.join(folders, plain("slide_folder") == F.col("f_")).drop("f_")

    def random_split(self, ratio: float = 0.3, seed: int = 0) -> DataFrame:
        """The slides with ``split``: whole slides, ``int(ratio * n)`` of them validation."""
        return datasets.group_split(self.folders(), "slide_path", ratio, seed)

    def extract_features(self, model: Model, level: int, backend: str | slides.Opener = "procedural", size: tuple[int, int] = (224, 224), prepare: Model | None = None) -> DataFrame:
        """Patches of a level with the model's features of their pixels (arrays of patch, row, column, colour), which
        ``prepare`` may change first."""
        rows = self.list_patches(level).withColumn("slide", F.col("slide_path"))
        return extract_features(slides.with_pixels(rows, "", backend, size), "pixels", model, shape=(size[1], size[0], 3), prepare=prepare).drop("pixels")


def training_batches(patches_: DataFrame, size: int, prepare: Model | None = None, backend: str | slides.Opener = "procedural", keep_last: bool = True) -> Iterator[tuple[np.ndarray, list]]:
    """Pixels (patch, row, column, colour) and labels of labelled patches, batch by batch; ``slide`` is the file's path.

    Pixels are read in the workers and passed on in the order of the rows' partitions; ``prepare`` gets whole batches.
    """
    rows = slides.with_pixels(patches_, "", backend).select("pixels", "size_x", "size_y", "label")
    for batch in iter_batches(rows, size, keep_last):
        images = np.stack([np.frombuffer(r["pixels"], np.uint8).reshape(r["size_y"], r["size_x"], 3) for r in batch])
        yield prepare(images) if prepare else images, [r["label"] for r in batch]


def iter_batches(df: DataFrame, size: int, keep_last: bool = True) -> Iterator[list]:
    """Batches of rows for a training loop, partition by partition; the next one is fetched meanwhile."""
    batch: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch and keep_last:
        yield batch
