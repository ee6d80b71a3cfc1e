"""Row numbers over whole tables or few large groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

_PLACE = (1 << 33) - 1  # monotonically_increasing_id keeps the place within a partition in its low 33 bits


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "r_") -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row within its keys, by ``order``.

    Rows are sorted by range over the cluster and written; a row's number is its place in its range plus the sizes of
    the ranges before it (one number a range), less the number at which its keys start (one number a key).
    """
    by = [f"o{i}_" for i in range(len(order))]
    rows = df.withColumns({b: F.col(o) if isinstance(o, str) else o for b, o in zip(by, order, strict=True)})
    rows = rows.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by).drop(*by)
    rows = written(rows.withColumn("m_", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("m_", 33)
    sizes = rows.groupBy(part.alias("p_")).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("p_", before.alias("before_")))  # one row a range
    rows = rows.join(offsets, part == F.col("p_")).withColumn("g_", F.col("before_") + F.col("m_").bitwiseAND(_PLACE) + 1).drop("m_", "p_", "before_")
    if not keys:
        return rows.withColumnRenamed("g_", name)
    starts = rows.groupBy(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)]).agg(F.min("g_").alias("s_"))
    same = [F.col(k).eqNullSafe(F.col(f"k{i}_")) for i, k in enumerate(keys)]
    out = rows.join(starts, same)
    return out.select(*df.columns, (F.col("g_") - F.col("s_") + 1).alias(name))
