"""Slide pyramids: an interface for readers, a procedural slide, pixel access per patch, and a Spark data source.

A reader is any object with ``levels`` (width, height, downsample of each level) and ``read_region``. What opens a path is
given itself, or by the name under which it is in ``BACKENDS`` on the driver; it goes to the workers with the plan.
Pixels are read there, slide by slide, with few open readers a worker. A slide is named by its path below the folder it
was found in, so slides of one name in several folders stay apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import UnknownMethodError
from ..schema import SLIDES
from .images import png


class Reader(Protocol):
    levels: Sequence[tuple[int, int, float]]

    def read_region(self, x: int, y: int, level: int, width: int, height: int) -> np.ndarray:
        """RGBA bytes of a region; x and y are level-0 pixels, pixels outside the slide are transparent black."""


@dataclass(frozen=True)
class ProceduralSlide:
    """A slide whose pixels follow from its name and their place: halving levels, tissue in disks on white."""

    name: str
    width: int = 4096
    height: int = 3072
    count: int = 5

    @property
    def levels(self) -> list[tuple[int, int, float]]:
        return [(self.width >> k, self.height >> k, float(1 << k)) for k in range(self.count)]

    def read_region(self, x: int, y: int, level: int, width: int, height: int) -> np.ndarray:
        scale = 1 << level
        xs, ys = x + np.arange(width) * scale, y + np.arange(height) * scale
        inside = ((ys >= 0) & (ys < self.height))[:, None] & ((xs >= 0) & (xs < self.width))[None, :]
        phase = zlib.crc32(self.name.encode()) % 97
        field = np.sin((xs[None, :] + 31 * phase) / 310) + np.cos((ys[:, None] + 17 * phase) / 270)
        out = np.zeros((height, width, 4), np.uint8)
        out[...] = np.where((field > 0.6)[..., None], np.array([154, 120, 156, 255], np.uint8), np.array([255, 255, 255, 255], np.uint8))
        out[~inside] = 0
        return out


Opener = Callable[[str], Reader]

#: What opens a path, by name.
BACKENDS: dict[str, Opener] = {"procedural": ProceduralSlide}
_OPEN: dict[tuple[Opener, str], Reader] = {}


def opener(backend: str | Opener) -> Opener:
    """What opens a path under ``backend``; a name that is not registered is an error."""
    if callable(backend):
        return backend
    if backend not in BACKENDS:
        raise UnknownMethodError(f"no backend {backend!r} among {sorted(BACKENDS)}")
    return BACKENDS[backend]


def open_slide(path: str, backend: str | Opener = "procedural") -> Reader:
    """An open reader, kept in this process for the next one who asks."""
    key = opener(backend), path
    if key not in _OPEN:
        if len(_OPEN) > 32:
            _OPEN.clear()
        _OPEN[key] = key[0](path)
    return _OPEN[key]


def opened(files: DataFrame, backend: str | Opener = "procedural") -> DataFrame:
    """``schema.SLIDES`` rows and ``error`` of ``slide, path``, opened in the workers; a slide that cannot be opened has
    one row, with the error in place of its levels."""
    opens = opener(backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for slide, path in zip(pdf["slide"], pdf["path"], strict=True):
                try:
                    rows += [(slide, k, w, h, d, None) for k, (w, h, d) in enumerate(open_slide(path, opens).levels)]
                except Exception as e:  # noqa: BLE001 - whatever a reader of a file format raises is reported
                    rows.append((slide, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*SLIDES.names, "error"]).astype({"level": "Int32", "width": "Int64", "height": "Int64", "downsample": "float64"})

    return files.select("slide", "path").mapInPandas(run, T.StructType([*SLIDES.fields, T.StructField("error", T.StringType())]))


def readable(found: DataFrame) -> DataFrame:
    """The slides of ``opened`` that could be opened, as ``schema.SLIDES``."""
    return found.where("error is null").drop("error")


def unreadable(found: DataFrame) -> DataFrame:
    """``slide, error`` of the others."""
    return found.where("error is not null").select("slide", "error")


def slide_table(spark: SparkSession, paths: Sequence[str], backend: str | Opener = "procedural") -> DataFrame:
    """``schema.SLIDES`` rows of some slides by path, named by their file; one that cannot be opened has none."""
    return readable(opened(spark.createDataFrame([(p.rsplit("/", 1)[-1], p) for p in paths], "slide string, path string"), backend))


def best_level(slides: DataFrame, downsample: float) -> DataFrame:
    """``slide, level``: the last level whose downsample is not larger."""
    return slides.where(F.col("downsample") <= downsample).groupBy("slide").agg(F.max_by("level", "downsample").alias("level"))


def with_pixels(patches: DataFrame, folder: str = "", backend: str | Opener = "procedural", size: tuple[int, int] | None = None, errors: str | None = None) -> DataFrame:
    """Patches with ``pixels`` (RGB bytes, row by row), read in the workers from the file ``slide`` below ``folder``.

    Patches that cannot be read are left out; with ``errors``, they stay, without pixels, and a column of that name says why.

    Patches are dealt by slide and place, so a worker opens few slides and a large slide is read by many.
    """
    names = patches.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema.fields) + ", pixels binary" + (f", `{errors}` string" if errors else "")
    opens, base = opener(backend), folder.rstrip("/") + "/" if folder else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, said = [], []
            for slide, x, y, level, own_w, own_h in pdf[["slide", "x", "y", "level", "size_x", "size_y"]].itertuples(index=False):
                try:
                    w, h = size or (int(own_w), int(own_h))
                    out.append(open_slide(base + slide, opens).read_region(int(x), int(y), int(level), w, h)[..., :3].tobytes())
                    said.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a reader of a file format raises is reported
                    out.append(None)
                    said.append(f"{type(e).__name__}: {e}")
            found = pdf[names].assign(pixels=out)
            yield found.assign(**{errors: said}) if errors else found[[s is None for s in said]]

    return patches.repartition("slide", F.floor(F.col("y") / 8192)).mapInPandas(run, schema)


def thumbnail(reader: Reader, side: int = 512) -> np.ndarray:
    """RGB of the whole slide, no side longer than ``side``: the best level, on white, then every n-th pixel."""
    width, height, _ = reader.levels[0]
    factor = max(width, height) / side
    level = max((k for k, (_, _, d) in enumerate(reader.levels) if d <= max(1.0, factor)), default=0)
    w, h, _ = reader.levels[level]
    image = reader.read_region(0, 0, level, w, h).astype(np.uint16)
    alpha = image[..., 3:] // 255
    image = (image[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    scale = min(1.0, side / max(w, h))
    rows, cols = ((np.arange(max(1, int(n * scale))) + 0.5) * n / max(1, int(n * scale)) for n in (h, w))
    return image[rows.astype(int)][:, cols.astype(int)]


def resized(reader: Reader, rows: int, cols: int) -> np.ndarray:
    """RGB of the whole slide in ``rows`` by ``cols`` pixels: from the best level, on white, the nearest pixel of each."""
    width, height, _ = reader.levels[0]
    factor = min(width / cols, height / rows)
    level = max((k for k, (_, _, d) in enumerate(reader.levels) if d <= max(1.0, factor)), default=0)
    w, h, _ = reader.levels[level]
    image = reader.read_region(0, 0, level, w, h).astype(np.uint16)
    alpha = image[..., 3:] // 255
    image = (image[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return image[((np.arange(rows) + 0.5) * h / rows).astype(int)][:, ((np.arange(cols) + 0.5) * w / cols).astype(int)]


def thumbnail_pixels(spark: SparkSession, paths: Sequence[str], side: int = 512, backend: str | Opener = "procedural") -> DataFrame:
    """``slide, i, j, r, g, b, mask_height, mask_width`` of the slides' thumbnails."""
    opens = opener(backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                image = thumbnail(open_slide(path, opens), side)
                h, w = image.shape[:2]
                i, j = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"slide": path.rsplit("/", 1)[-1], "i": i, "j": j, **{c: image[..., k].ravel().astype(int) for k, c in enumerate("rgb")}, "mask_height": h, "mask_width": w})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, "slide string, i long, j long, r int, g int, b int, mask_height int, mask_width int")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``path, content`` as single files below the mounted folder ``root``, in the workers: ``path, bytes``.

    All workers must reach ``root`` under that path. A file is written beside its place and then moved there, so a task
    that runs twice leaves one whole file. Nothing is written before an action on the result.
    """
    import os

    base = root.removeprefix("file://").rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = f"{base}/{path}"
                os.makedirs(os.path.dirname(name), exist_ok=True)
                part = f"{name}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, name)
            yield pd.DataFrame({"path": pdf["path"], "bytes": pdf["content"].map(len)})

    return files.select("path", "content").mapInPandas(run, "path string, bytes long")


def png_files(patches: DataFrame) -> DataFrame:
    """``path, content`` of patches with pixels: ``slide/level_k/x_y_level.png``."""

    @F.pandas_udf("binary")
    def encode(pixels: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([png(np.frombuffer(p, np.uint8).reshape(b, a, 3)) for p, a, b in zip(pixels, w, h, strict=True)])

    name = F.format_string("%s/level_%d/%d_%d_%d.png", "slide", "level", "x", "y", "level")
    return patches.select(name.alias("path"), encode("pixels", "size_x", "size_y").alias("content"))


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _SlideReader(DataSourceReader):
    def __init__(self, options: dict[str, str], opens: Opener) -> None:
        self.opens = opens
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        for k, (w, h, d) in enumerate(open_slide(path, self.opens).levels):
            yield path.rsplit("/", 1)[-1], k, w, h, d


class SlideSource(DataSource):
    """``spark.read.format("slides").option("paths", "a,b").load()``: a row a level, a partition a slide."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self):
        return SLIDES

    def reader(self, schema) -> DataSourceReader:
        return _SlideReader(dict(self.options), ProceduralSlide)


def slide_source(backend: str | Opener, format_name: str) -> type[DataSource]:
    """A source like ``SlideSource`` under a name of its own, for another reader, which goes to the workers with it."""
    opens = opener(backend)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self):
            return SLIDES

        def reader(self, schema) -> DataSourceReader:
            return _SlideReader(dict(self.options), opens)

    return Source
