"""Finding files and joining slides to their patch folders, as tables of paths.

Listing goes through Spark's file reader, so any store that Spark can read will do; only paths are read, no contents.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyProjectError, PatchesNotFoundError, SlideNotFoundError
from ..functions import paths as P
from . import images

PATCH_FILE = "patches.csv"


def _listed(spark: SparkSession, root: str, recurse: bool) -> DataFrame:
    """``path`` (local ones without a scheme) and ``rel`` (below the root) of all files that are not hidden; or ``path, rel,
    whole`` of what is in the root itself, where a folder with files is one row and is ``whole``.

    The paths are those of Spark's file index, which has empty files too; the driver has them as one string.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)._jdf.inputFiles()
    text = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", found)  # a line break in a name is encoded
    listed = spark.createDataFrame(pa.table({"uri": pa.array(text.split("\n") if text else [], pa.string())}))
    files = listed.select(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("path"))
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    base = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    files = files.withColumn("rel", F.regexp_replace(F.expr(f"substring(path, instr(path, '{base}') + {len(base)})"), "^/", ""))
    files = files.where(~P.hidden(F.col("rel")))
    if recurse:
        return files
    top = F.regexp_extract("rel", "^[^/]+", 0)
    return files.select(F.expr("substring(path, 1, length(path) - length(rel))").alias("root"), top.alias("rel"), F.contains("rel", F.lit("/")).alias("whole")).distinct().select(F.concat("root", "rel").alias("path"), "rel", "whole")


def get_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, recurse: bool = True, folders: Sequence[str] | None = None) -> DataFrame:
    """``path, rel`` of files by extension (any case). ``folders`` names the top folders to enter; then files at the
    top are left out unless "." is named. Without ``recurse`` no folder is entered, and one whose name has an extension that
    is asked for is one file, as a table of several parts or a slide of several files is."""
    files = _listed(spark, root, recurse)
    if extensions is not None:
        files = files.where(P.has_extension(F.col("path"), extensions))
    if not recurse:
        return (files.where("not whole") if extensions is None else files).select("path", "rel")
    if folders is not None:
        top = F.regexp_extract("rel", "^([^/]+)/", 1)
        files = files.where(top.isin([f for f in folders if f != "."]) | ((top == "") & F.lit("." in folders)))
    return files


def slides_in_folder(spark: SparkSession, folder: str, extensions: Sequence[str] = (".mrxs",)) -> DataFrame:
    """Slides of one folder, files or folders themselves, by their (case-sensitive) ending; one row for each that fits."""
    files = _listed(spark, folder, False)
    fits = F.explode(F.filter(F.array(*[F.when(F.col("path").endswith(e), F.lit(e)) for e in extensions]), lambda e: e.isNotNull()))
    return files.select("path", "rel", fits.alias("ending")).withColumn("slide", P.base_name(F.col("path")))


def images_in_folder(spark: SparkSession, folder: str, allowed: Sequence[str] = (".png", ".jpg", ".jpeg", ".tif", ".tiff"), forbidden: Sequence[str] = ("thumbnail",), seed: int | None = None, limit: int | None = None) -> DataFrame:
    """Image files by ending, without those whose name has a forbidden part; shuffled under a seed, limited if asked."""
    files = _listed(spark, folder, False).where("not whole").drop("whole").where(P.ends_with(F.col("path"), allowed))
    for part in forbidden:
        files = files.where(~P.file_name(F.col("path")).contains(part))
    if seed is not None:
        files = files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "rel").cast("binary")))
    return files.limit(limit) if limit is not None else files


def decoded_images(files: DataFrame, decode=images.decode, schema: str = "path string, height int, width int, channels int, pixels binary") -> DataFrame:
    """Images of a table with ``path, content`` (``images.contents`` reads them), decoded in the workers by a function from
    bytes to an array; the one given here reads PNG and plain TIFF files."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            arrays = [decode(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "height": [a.shape[0] for a in arrays], "width": [a.shape[1] for a in arrays], "channels": [a.shape[2] if a.ndim > 2 else 1 for a in arrays], "pixels": [a.tobytes() for a in arrays]})

    return files.mapInPandas(run, schema)


def level_folders(files: DataFrame, level: int, limit: int | None = None) -> DataFrame:
    """``slide, folder`` of the slides that have files in a ``level_{k}`` folder."""
    found = files.select(F.regexp_extract("path", rf"^(.*/([^/]+)/level_{level})/[^/]+$", 1).alias("folder"), F.regexp_extract("path", rf"/([^/]+)/level_{level}/[^/]+$", 1).alias("slide")).where("folder != ''").distinct()
    return found.orderBy("slide").limit(limit) if limit is not None else found


def patch_folders(files: DataFrame) -> DataFrame:
    """Folders with a patch file, none of them below another one."""
    own = files.where(P.file_name(F.col("path")) == PATCH_FILE).select(P.folder(F.col("path")).alias("folder")).distinct()
    above = own.select(F.col("folder").alias("own_"), F.explode(F.expr("transform(sequence(1, size(split(folder, '/')) - 1), n -> array_join(slice(split(folder, '/'), 1, n), '/'))")).alias("folder"))
    nested = above.join(own, "folder", "left_semi").select(F.col("own_").alias("folder"))
    return own.join(nested, "folder", "left_anti")


def patch_file(folders: DataFrame, files: DataFrame, folder: str) -> str:
    """The patch file of one folder; raises where the folder or the file is missing."""
    if folders.where(F.col("folder") == folder).isEmpty() and files.where(F.col("path").startswith(folder.rstrip("/") + "/")).isEmpty():
        raise SlideNotFoundError(f"no folder {folder}")
    if files.where(F.col("path") == f"{folder.rstrip('/')}/{PATCH_FILE}").isEmpty():
        raise PatchesNotFoundError(f"no {PATCH_FILE} in {folder}")
    return f"{folder.rstrip('/')}/{PATCH_FILE}"


def slide_files(folders: DataFrame, files: DataFrame, project_root: str, slide_root: str, extensions: Sequence[str] = (".mrxs", ".svs")) -> DataFrame:
    """``folder, slide_path``: each patch folder's slide, under the other root; the first extension there is wins.

    Folders without a slide have none; ``missing_slides`` lists them.
    """
    wanted = folders.withColumn("stem", P.moved(F.col("folder"), project_root, slide_root))
    rank = F.lit(None).cast("int")
    stem = F.lit(None).cast("string")
    for k, e in reversed(list(enumerate(extensions))):
        fits = F.col("path").endswith(e)
        rank, stem = F.when(fits, F.lit(k)).otherwise(rank), F.when(fits, F.expr(f"substring(path, 1, length(path) - {len(e)})")).otherwise(stem)
    there = files.select(F.col("path"), stem.alias("stem"), rank.alias("rank_")).where("rank_ is not null").groupBy("stem").agg(F.min_by("path", "rank_").alias("slide_path"))
    return wanted.join(there, "stem", "left").select("folder", "slide_path")


def missing_slides(found: DataFrame) -> DataFrame:
    return found.where("slide_path is null").select("folder")


def need_patches(folders: DataFrame) -> DataFrame:
    """The folders themselves; raises ``EmptyProjectError`` if there are none."""
    if folders.isEmpty():
        raise EmptyProjectError("the project has no patch file")
    return folders
