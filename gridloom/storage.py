"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import NoSharedFolder

#: Rows of a file where the caller knows how many rows a table has.
ROWS_A_FILE = 1 << 20
#: Row groups of intermediates are small, so that a writer holds little in memory.
GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and everything
    runs in one process (tests). On a cluster a local folder would be another one on each machine, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
    return (where or f"file://{tempfile.gettempdir()}/gridloom-shared").rstrip("/")


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``, a bound on the number of rows, keeps small tables from becoming one tiny file a shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1)
    out.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tree(spark: SparkSession, path: str, erase: bool | None = None, ask: Callable[[str], str] = input, ignore_errors: bool = True) -> bool:
    """Remove a folder with all below it if ``erase`` is true, or if it is not given and the answer to a question is y."""
    while erase is None:
        erase = {"y": True, "n": False}.get(ask(f"Delete {path} and all that is in it? y/n ").strip().lower())
    if erase:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            if not ignore_errors:
                raise
    return erase


def discard(df: DataFrame) -> None:
    """Remove the files behind a ``written`` table once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
