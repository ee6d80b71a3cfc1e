"""Tiling of slides and folders of slides, flat and hierarchical, as configured pipelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, UnknownLevelError
from ..operators import tiles
from ..operators.predicates import image_predicate
from ..operators.tiles import Filter, Pair
from ..sources import discovery, patches, slides
from ..sources.slides import Opener
from ..storage import written


def pixel_filter(filters: Sequence, size: tuple[int, int], folder: str = "", backend: str | Opener = "procedural") -> Filter:
    """A table filter that reads each patch's pixels and applies image filters (names or callables) to them."""
    keep = image_predicate(list(filters), size[1], size[0])

    def run(df: DataFrame) -> DataFrame:
        return slides.with_pixels(df, folder, backend).where(keep("pixels")).drop("pixels")

    return run


@dataclass
class Patchifier:
    """Settings for the patches of one level. Filters get and return tables of patches.

    ``silence``: 0 reads pixels for filters and writes them, 1 reads them for filters only, 2 reads none.
    """

    level: int
    patch: Pair
    interval: Pair = 0
    offset: Pair = 0
    filters: list[Filter] = field(default_factory=list)
    mask: Callable[[DataFrame], DataFrame] | None = None
    silence: int = 2
    backend: str | Opener = "procedural"

    def __post_init__(self) -> None:
        if self.silence not in (0, 1, 2):
            raise InvalidArgument("silence is 0, 1 or 2")
        self.filters = list(self.filters)

    def add_filter(self, keep: Filter) -> None:
        self.filters.append(keep)

    def patchify(self, table: DataFrame) -> DataFrame:
        """Patches of a table of slides."""
        out = tiles.root_patches(table, self.level, self.patch, self.interval, self.offset, self.mask(table) if self.mask else None)
        if self.silence < 2:
            for keep in self.filters:
                out = keep(out)
        return out

    def patchify_folder(self, spark: SparkSession, folder: str, out: str | None = None, extensions: Sequence[str] = (".mrxs",), recurse: bool = True, folders: Sequence[str] | None = None) -> DataFrame:
        """Patches of all slides of a folder, in one job; ``slide`` is the path below the folder.

        Written, if asked: patch files, images at silence 0, and the slides that could not be opened, with the errors.
        """
        return _of_folder(self, spark, folder, out, extensions, recurse, folders)


@dataclass
class HierarchicalPatchifier:
    """Settings for the patches of several levels; each level has filters of its own."""

    top: int
    low: int
    patch: Pair
    interval: Pair = 0
    offset: Pair = 0
    filters: object = None
    mask: Callable[[DataFrame], DataFrame] | None = None
    silence: int = 2
    backend: str | Opener = "procedural"

    def __post_init__(self) -> None:
        self.by_level = tiles.standard_filters(self.filters, self.top, self.low)

    def add_filter(self, keep: Filter, level: int | Sequence[int] | None = None) -> None:
        """For one level, several, or all."""
        levels = list(self.by_level) if level is None else [level] if isinstance(level, int) else list(level)
        if unknown := set(levels) - set(self.by_level):
            raise UnknownLevelError(f"levels {sorted(unknown)} are outside {self.low}..{self.top}")
        for k in levels:
            self.by_level[k].append(keep)

    def patchify(self, table: DataFrame) -> DataFrame:
        return tiles.hierarchy(table, self.top, self.low, self.patch, self.interval, self.offset, self.mask(table) if self.mask else None, self.by_level)

    def patchify_folder(self, spark: SparkSession, folder: str, out: str | None = None, extensions: Sequence[str] = (".mrxs",), recurse: bool = True, folders: Sequence[str] | None = None) -> DataFrame:
        """As ``Patchifier.patchify_folder``."""
        return _of_folder(self, spark, folder, out, extensions, recurse, folders)


def folder_slides(spark: SparkSession, folder: str, extensions: Sequence[str], recurse: bool, folders: Sequence[str] | None, backend: str | Opener) -> DataFrame:
    """The slides of a folder as ``slides.opened`` gives them, named by their path below it; each is opened once."""
    files = discovery.get_files(spark, folder, extensions, recurse, folders).select(F.col("rel").alias("slide"), "path")
    return written(slides.opened(files.repartition("slide"), backend), "slides")


def _of_folder(settings: Patchifier | HierarchicalPatchifier, spark: SparkSession, folder: str, path: str | None, extensions: Sequence[str], recurse: bool, folders: Sequence[str] | None) -> DataFrame:
    found = folder_slides(spark, folder, extensions, recurse, folders, settings.backend)
    out = settings.patchify(slides.readable(found))
    if path is not None:
        patches.write_patches(out, f"{path}/patches")
        slides.unreadable(found).write.option("header", True).csv(f"{path}/unreadable")
        if settings.silence == 0:
            slides.png_files(slides.with_pixels(out, folder, settings.backend)).write.parquet(f"{path}/images")
    return out

