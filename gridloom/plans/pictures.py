"""Pictures as files: previews of patches on slides, and coarse segmentations of the images of a folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles
from ..operators.semantic import Model
from ..sources import discovery, images, slides


def previews(patches: DataFrame, table: DataFrame, folder: str = "", backend: str | slides.Opener = "procedural", min_res: int = 512, colour: tuple[int, int, int] = (255, 255, 0), thickness: int = 2, cell: int = 20) -> DataFrame:
    """``path, content``: a PNG file for each slide of ``patches``, its thumbnail with the patches' outlines."""
    opens, base = slides.opener(backend), folder.rstrip("/") + "/" if folder else ""
    pixels = tiles.outline_pixels(patches, table, min_res, thickness, cell)
    shapes = tiles.preview_shapes(patches, table, min_res, cell)
    lines = pixels.groupBy("slide").agg(F.collect_list(F.shiftleft(F.col("i").cast("long"), 32) + F.col("j")).alias("at"))  # as many as the thumbnail has pixels
    rows = shapes.select(F.col("slide_").alias("slide"), "rows_", "cols_").join(lines, "slide", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for slide, h, w, at in pdf[["slide", "rows_", "cols_", "at"]].itertuples(index=False):
                image = slides.resized(slides.open_slide(base + slide, opens), int(h), int(w))
                if at is not None:
                    at = np.asarray(at, np.int64)
                    image[at >> 32, at & 0xFFFFFFFF] = colour
                out.append((f"{slide}.png", images.png(image)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


def coarse_files(spark: SparkSession, folder: str, level: int, model: Model, context: int, channels: bool = False, decode=images.decode) -> DataFrame:
    """``path, content``: a TIFF file ``{name}_semantic.tiff`` for each image in ``folder/level_k``, whose pixels are the
    labels of the windows that they lie in; with ``channels``, of each channel by itself. The last windows of a row or
    column that are not whole have label 0."""
    found = discovery.images_in_folder(spark, f"{folder.rstrip('/')}/level_{level}", forbidden=("thumbnail", "semantic"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decode(content)
                name = path.rsplit("/", 1)[-1].rpartition(".")[0]
                out.append((f"{name}_semantic.tiff", images.tiff(_segmented(image.reshape(*image.shape[:2], -1), model, context, channels))))
            yield pd.DataFrame(out, columns=["path", "content"])

    return images.contents(found).mapInPandas(run, "path string, content binary")


def _segmented(image: np.ndarray, model: Model, context: int, channels: bool) -> np.ndarray:
    h, w, n = image.shape
    rows, cols = h // context, w // context
    parts = [image[..., c : c + 1] for c in range(n)] if channels else [image]
    out = np.zeros((h, w, len(parts)), np.uint8)
    for k, part in enumerate(parts):
        if rows and cols:
            cut = part[: rows * context, : cols * context].reshape(rows, context, cols, context, -1).astype(float)
            found = np.asarray(model(cut.swapaxes(1, 2).reshape(rows * cols, -1))).reshape(rows, cols)
            out[: rows * context, : cols * context, k] = np.kron(found, np.ones((context, context), np.uint8))
    return out if channels else out[..., 0]
