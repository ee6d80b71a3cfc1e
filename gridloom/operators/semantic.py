"""Window predictions on images and patches: coarse segmentations, descriptions, features, by models that users give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import window_grid

Model = Callable[[np.ndarray], np.ndarray]


def nearest_prototype(vector: Column, prototypes: list[list[float]]) -> Column:
    """The number of the nearest prototype by squared distance, the first of equals; stays in the JVM."""
    squared = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(c)) for c in p]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x) for p in prototypes]
    best = F.least(*squared) if len(squared) > 1 else squared[0]
    out = F.lit(None).cast("int")
    for k, d in reversed(list(enumerate(squared))):
        out = F.when(d == best, F.lit(k)).otherwise(out)
    return out


def predict(df: DataFrame, vector: str, model: Model, name: str = "label", kind: str = "int", shape: tuple[int, ...] | None = None, prepare: Model | None = None) -> DataFrame:
    """``df`` with the model's prediction for each vector, a batch at a time; ``kind`` may be an array type.

    A vector is an array of numbers or a string of bytes; ``shape`` is that of one, ``prepare`` changes a batch first.
    Rows without a vector have no prediction.
    """
    wide = kind.startswith("array")

    def one(v: object) -> np.ndarray:
        raw = np.frombuffer(v, np.uint8) if isinstance(v, bytes | bytearray | memoryview) else np.asarray(v, float)
        return raw.reshape(shape) if shape else raw.astype(float)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out = pd.Series([None] * len(part), dtype=object)
            there = [i for i, v in enumerate(part) if v is not None]
            if there:
                stack = np.stack([one(part.iloc[i]) for i in there])
                found = np.asarray(model(prepare(stack) if prepare else stack))
                for i, value in zip(there, found.reshape(len(there), -1) if wide else found.tolist(), strict=True):
                    out.iloc[i] = value
            yield out

    return df.withColumn(name, run(F.col(vector)))


def windows(images: DataFrame, context: int, step: int | None = None, channels: bool = False) -> DataFrame:
    """Windows of images (image, height, width, channels, pixels as an array): ``image, i, j, window``; with
    ``channels`` one row for each ``channel`` too. The last windows of a row or column are clipped and left out."""
    rows = window_grid(images, "height", "width", context, step or context).where((F.col("i") + context <= F.col("height")) & (F.col("j") + context <= F.col("width")))
    stride = F.col("width") * F.col("channels")
    line = lambda di: F.slice("pixels", (F.col("i") + di) * stride + F.col("j") * F.col("channels") + 1, F.lit(context) * F.col("channels"))
    rows = rows.withColumn("window", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(context - 1)), line)))
    if channels:
        rows = rows.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
        rows = rows.withColumn("window", F.filter("window", lambda _, k: k % F.col("channels") == F.col("channel")))
    return rows.select("image", "i", "j", *(["channel"] if channels else []), "window")


def coarse(images: DataFrame, context: int, model: Model) -> DataFrame:
    """A label for each window of each image."""
    return predict(windows(images, context), "window", model).drop("window")


def coarse_channels(images: DataFrame, context: int, model: Model) -> DataFrame:
    """A label for each window and channel."""
    return predict(windows(images, context, channels=True), "window", model).drop("window")


def describe_channels(images: DataFrame, context: int, model: Model, regions: bool = False) -> DataFrame:
    """A vector for each window and channel; with ``regions`` the window's number (from 0, row by row) too."""
    out = predict(windows(images, context, channels=True), "window", model, "description", "array<double>").drop("window")
    if not regions:
        return out
    across = images.select("image", F.ceil(F.col("width") / context).alias("across_"))
    return out.join(across, "image").withColumn("region", (F.col("i") / context * F.col("across_") + F.col("j") / context).cast("long")).drop("across_")


def painted(labels: DataFrame, context: int) -> DataFrame:
    """Window labels as pixel labels ``image, y, x, label``."""
    side = F.sequence(F.lit(0), F.lit(context - 1))
    rows = labels.withColumn("a", F.explode(side)).withColumn("b", F.explode(side))
    return rows.select("image", (F.col("i") + F.col("a")).alias("y"), (F.col("j") + F.col("b")).alias("x"), *[c for c in labels.columns if c not in ("image", "i", "j")])


def extract_features(patches: DataFrame, pixels: str, model: Model, name: str = "features", shape: tuple[int, ...] | None = None, prepare: Model | None = None) -> DataFrame:
    """Patches with the model's feature vector of their pixels (bytes or numbers); a map of features is laid out flat."""
    return predict(patches, pixels, model, name, "array<double>", shape, prepare)


def coarse_patches(patches: DataFrame, context: int, model: Model, channels: int = 3) -> DataFrame:
    """Patches with ``labels``: one byte a pixel, the model's label of the window it lies in; written like any column.

    ``patches`` has ``pixels`` (bytes, row by row) and ``size_x, size_y``. All windows of a patch are predicted at once.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema.fields if f.name != "pixels") + ", labels binary"
    names = [c for c in patches.columns if c != "pixels"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, w, h in zip(pdf["pixels"], pdf["size_x"], pdf["size_y"], strict=True):
                image = np.frombuffer(raw, np.uint8).reshape(h, w, channels).astype(float)
                rows, cols = h // context, w // context
                cut = image[: rows * context, : cols * context].reshape(rows, context, cols, context, channels)
                labels = np.zeros((h, w), np.uint8)
                if rows and cols:
                    found = np.asarray(model(cut.swapaxes(1, 2).reshape(rows * cols, -1))).reshape(rows, cols)
                    labels[: rows * context, : cols * context] = np.kron(found, np.ones((context, context), np.uint8))
                out.append(labels.tobytes())
            yield pdf[names].assign(labels=out)

    return patches.mapInPandas(run, schema)
