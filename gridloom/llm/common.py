"""Shared helpers: table access, bounded Arrow batches, byte-level word hashes, a Bloom filter of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import discard, shared_dir, written

__all__ = ["Bloom", "bounded", "discard", "fresh", "joined_bytes", "lower_table", "map_batches", "mix64", "parted", "shared_dir", "table", "texts", "word_hashes", "written"]

#: Rows and bytes that one Arrow batch may hold on its way to Python.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader only."""
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; one batch in, at most one batch out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null read as the empty string."""
    return [x or "" for x in column.to_pylist()]


#: Multiplier of the polynomial word hash and the two of the finaliser (fixed odd values).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = _powers(1 << 16)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = _powers(1 << (n - 1).bit_length())
    return _POWERS


#: Bytes that are hashed at a time; words are never cut.
CHUNK = 1 << 18


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of word bytes in ``data``.

    ``is_word`` has one flag for each byte value. The hash of a run is a polynomial over its bytes, taken from
    prefix sums modulo 2**64 and finalised, so the whole array is hashed without a Python loop over words.
    """
    if len(data) <= CHUNK:
        return _word_hashes(data, is_word)
    found, at = [], 0
    while at < len(data):
        stop = min(at + CHUNK, len(data))
        while stop < len(data) and is_word[data[stop - 1]]:
            gap = np.flatnonzero(~is_word[data[stop : stop + CHUNK]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + CHUNK, len(data))
        starts, ends, hashes = _word_hashes(data[at:stop], is_word)
        found.append((starts + at, ends + at, hashes))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flag = is_word[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix64(raw ^ ((ends - starts).astype(np.uint64) * _MIX1))


class Bloom:
    """A Bloom filter of one fixed size (8 MB), so that what is broadcast does not grow with the input.

    Its bits are three disjoint parts of a 64-bit hash. Spark combines them word by word; the driver receives at most
    the filter itself. A filter that is overfull only passes more than it need.
    """

    BITS, HASHES = 1 << 26, 3

    def __init__(self, words: np.ndarray) -> None:
        self.bytes = words.view(np.uint8)

    @classmethod
    def of(cls, df: DataFrame, hash_col: str) -> Bloom:
        bit = F.explode(F.array(*[F.shiftrightunsigned(hash_col, 19 * k).bitwiseAND(cls.BITS - 1) for k in range(cls.HASHES)]))
        words = df.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        out = np.zeros(cls.BITS // 64, np.int64)
        out[words["word"].to_numpy()] = words["bits"].to_numpy()
        return cls(out)

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes (uint64) that may be in the filter."""
        at = np.arange(len(hashes))
        for k in range(self.HASHES):
            bit = ((hashes[at] >> np.uint64(19 * k)) & np.uint64(self.BITS - 1)).astype(np.int64)
            at = at[(self.bytes[bit >> 3] >> (bit & 7)) & 1 == 1]
        return at


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores as long as ``df`` has such a column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parted(df: DataFrame, keys: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose hash ``own`` may be among the hashes of ``keys`` (one column), and all others.

    Both read ``df``, neither shuffles it: a Bloom filter of fixed size goes to the workers.
    """
    bloom = df.sparkSession.sparkContext.broadcast(Bloom.of(keys, keys.columns[0]))
    name = fresh(df, "key")
    keyed = df.withColumn(name, own)

    def among(batch: pa.RecordBatch) -> np.ndarray:
        found = np.zeros(batch.num_rows, bool)
        found[bloom.value.passed(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))] = True
        return found

    some = map_batches(keyed, lambda batch: batch.filter(pa.array(among(batch))), keyed.schema)
    rest = map_batches(keyed, lambda batch: batch.filter(pa.array(~among(batch))), keyed.schema)
    return some.drop(name), rest.drop(name)


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and leaves every other byte."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def joined_bytes(column: pa.Array, zero: bytes = b"\0") -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column with a zero byte after each row, and each row's start (one more at the end).

    ``zero`` stands for the zero characters of the texts; 0xFF, which UTF-8 never has, tells them from the ends of rows.
    """
    parts = [x.encode().replace(b"\0", zero) for x in texts(column)]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8) if parts else np.empty(0, np.uint8)
    return data, np.concatenate(([0], np.cumsum(sizes)))
