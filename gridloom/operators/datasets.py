"""Training-set operators on tables with a tag, an order and optionally a split.

A data set is a table with ``tag`` (its class), ``ord`` (its place, which clip, split and batch respect) and, once it
is split, ``split``; every operator then works within each split by partitioning on it, in one plan. Random orders are
hash orders under a seed, so they can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidDatasetError, InvalidSplitError, TagNotFoundError
from .ranking import numbered

Sections = Mapping[str, float] | Sequence[float]
Operator = Callable[[DataFrame], DataFrame]


def _within(df: DataFrame) -> list[str]:
    if not {"tag", "ord"} <= set(df.columns):
        raise InvalidDatasetError("a data set has the columns tag and ord")
    return ["split"] if "split" in df.columns else []


def hash_order(seed: int, *columns: str | Column) -> Column:
    """A reproducible random key: the md5 of seed and columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns).cast("binary"))


def info(df: DataFrame) -> DataFrame:
    """Rows of each tag: ``tag, n``."""
    return df.groupBy(*_within(df), "tag").agg(F.count("*").alias("n"))


def ratio_info(df: DataFrame) -> DataFrame:
    """Share of each tag: ``tag, ratio``."""
    keys = _within(df)
    counts = info(df)
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(*keys, "tag", (F.col("n") / total).alias("ratio"))


def class_data(df: DataFrame, tag: object) -> DataFrame:
    """Rows of one tag; raises ``TagNotFoundError`` if there are none."""
    out = df.where(F.col("tag") == tag)
    if out.isEmpty():
        raise TagNotFoundError(f"no row has the tag {tag!r}")
    return out


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """A random permutation within each split; ``ord`` is the new place."""
    return numbered(df, _within(df), [hash_order(seed, "ord"), "ord"]).withColumn("ord", F.col("r_")).drop("r_")


def clean(df: DataFrame, dtype: str | None = None, rm: Sequence[object] = ()) -> DataFrame:
    """Rows whose tag is of the type (castable to it, and not null) and not among ``rm``."""
    _within(df)
    out = df.where(F.col("tag").isNotNull())
    if dtype is not None:
        out = out.where(F.col("tag").try_cast(dtype).isNotNull())
    return out.where(~F.col("tag").isin(list(rm))) if rm else out


def balance(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Every tag padded to the size of the largest by repeating its rows: originals first, then the copies.

    Of the ``lack`` copies each row gets ``lack div n``, the first ``lack mod n`` in (shuffled) order one more. Places
    of copies follow all originals. Counts are aggregated and joined back, so a large class is not sorted for them.
    """
    keys = _within(df)
    counts = df.groupBy(*keys, "tag").agg(F.count("*").alias("n_"))
    most = counts.groupBy(*keys).agg(F.max("n_").alias("most_"), F.sum("n_").alias("all_")) if keys else counts.agg(F.max("n_").alias("most_"), F.sum("n_").alias("all_"))
    counts = counts.join(F.broadcast(most), keys) if keys else counts.join(F.broadcast(most))  # a row a split
    rows = numbered(df, [*keys, "tag"], [*([hash_order(seed, "ord")] if seed is not None else []), "ord"]).join(counts, [*keys, "tag"])
    lack = F.col("most_") - F.col("n_")
    more = F.expr("(most_ - n_) div n_") + F.when(F.col("r_") <= lack % F.col("n_"), 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), more.cast("long")))).select(*df.columns, "copy")


def fair(df: DataFrame, dtype: str | None = None, rm: Sequence[object] = (), seed: int = 0) -> DataFrame:
    """Clean, balance, shuffle; copies are told apart by their number."""
    even = balance(clean(df, dtype, rm), seed)
    return numbered(even, _within(df), [hash_order(seed, "ord", "copy"), "ord", "copy"]).withColumn("ord", F.col("r_")).drop("r_", "copy")


def clip(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each split, by place."""
    keys = _within(df)
    if not keys:
        return df.orderBy("ord").limit(n)
    return numbered(df, keys, ["ord"]).where(F.col("r_") <= n).drop("r_")


def section_list(sections: Sections) -> list[tuple[str, float]]:
    """Named sections; a sequence is named by its places. The shares must sum to one (within 1e-9)."""
    if isinstance(sections, Mapping):
        out = [(str(k), float(v)) for k, v in sections.items()]
    elif isinstance(sections, (list, tuple)):
        out = [(str(k), float(v)) for k, v in enumerate(sections)]
    else:
        raise InvalidSplitError("sections are a mapping or a sequence of shares")
    if abs(sum(v for _, v in out) - 1) > 1e-9:
        raise InvalidSplitError(f"the shares of {out} do not sum to one")
    return out


def split(df: DataFrame, sections: Sections) -> DataFrame:
    """Stratified contiguous slices: of each tag's ``n`` rows, ``int(share * n)`` go to each section in turn.

    Rows beyond the last section's end, which the truncation leaves over, go.
    """
    _within(df)
    named = section_list(sections)
    rows = numbered(df, ["tag"], ["ord"]).withColumn("r_", F.col("r_") - 1).join(df.groupBy("tag").agg(F.count("*").alias("n_")), "tag")
    name, start = F.lit(None).cast("string"), F.lit(0).cast("long")
    bounds = []
    for section, share in named:
        end = start + (F.lit(share) * F.col("n_")).cast("long")
        bounds.append((section, end))
        start = end
    for section, end in reversed(bounds):
        name = F.when(F.col("r_") < end, section).otherwise(name)
    return rows.withColumn("split", name).where("split is not null").select(*[c for c in df.columns if c != "split"], "split")


def batch(df: DataFrame, size: int, keep_last: bool = False, payload: Sequence[str] | None = None) -> DataFrame:
    """Consecutive batches by place: ``batch, rows`` (an array of structs in order); a short last one only if asked."""
    keys = _within(df)
    columns = list(payload or [c for c in df.columns if c not in ("ord", *keys)])
    rows = numbered(df, keys, ["ord"]).withColumn("batch", F.floor((F.col("r_") - 1) / size))
    out = rows.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("r_", *columns))).alias("rows"))
    out = out.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns])))
    return out if keep_last else out.where(F.size("rows") == size)


def group_split(df: DataFrame, group: str, share: float = 0.3, seed: int = 0) -> DataFrame:
    """A split by whole groups: the first ``int(share * n)`` groups in hash order are ``validation``, others ``training``."""
    groups = df.select(group).distinct()
    rank = F.row_number().over(Window.orderBy(hash_order(seed, F.col(group).cast("string")), group))
    count = groups.agg(F.count("*").alias("n_"))
    named = groups.withColumn("r_", rank).join(F.broadcast(count)).select(group, F.when(F.col("r_") <= (F.lit(share) * F.col("n_")).cast("long"), "validation").otherwise("training").alias("split"))  # one row is broadcast
    return df.join(named, group)


def pre(*operators: Operator) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """A decorator that applies operators, the first one first, before the decorated consumer of a data set."""

    def wrap(consumer: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(df: DataFrame, *args: object, **kwargs: object) -> DataFrame:
            for op in operators:
                df = df.transform(op)
            return consumer(df, *args, **kwargs)

        return run

    return wrap


def post(*operators: Operator) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """A decorator that applies operators, the first one first, to what the decorated creator returns."""

    def wrap(creator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(*args: object, **kwargs: object) -> DataFrame:
            df = creator(*args, **kwargs)
            for op in operators:
                df = df.transform(op)
            return df

        return run

    return wrap


def _named(op: Callable[..., DataFrame], *args: object, **kwargs: object) -> Operator:
    return lambda df: op(df, *args, **kwargs)


def pre_shuffle(seed: int = 0):
    return pre(_named(shuffle, seed))


def pre_balance(seed: int | None = None):
    return pre(_named(balance, seed))


def pre_split(sections: Sections):
    return pre(_named(split, sections))


def pre_clip(n: int):
    return pre(_named(clip, n))


def pre_batch(size: int, keep_last: bool = False):
    return pre(_named(batch, size, keep_last))


def pre_clean(dtype: str | None = None, rm: Sequence[object] = ()):
    return pre(_named(clean, dtype, rm))


def pre_be_fair(dtype: str | None = None, rm: Sequence[object] = (), seed: int = 0):
    return pre(_named(fair, dtype, rm, seed))


def post_shuffle(seed: int = 0):
    return post(_named(shuffle, seed))


def post_balance(seed: int | None = None):
    return post(_named(balance, seed))


def post_split(sections: Sections):
    return post(_named(split, sections))


def post_clip(n: int):
    return post(_named(clip, n))


def post_clean(dtype: str | None = None, rm: Sequence[object] = ()):
    return post(_named(clean, dtype, rm))


def post_be_fair(dtype: str | None = None, rm: Sequence[object] = (), seed: int = 0):
    return post(_named(fair, dtype, rm, seed))
