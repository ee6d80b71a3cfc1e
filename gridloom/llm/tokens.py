r"""Token counts from distinct pre-tokens, as the tokenizers library would give them.

The distinct pre-tokens of the whole table come from one aggregation, and the pieces of each are counted once. Counts
are then joined to the documents' pre-token frequencies and summed; the ids of a document are never built. The join is
split by frequency: the counts of the most frequent pre-tokens, at most ``HEAD`` of them and ``HEAD_BYTES`` in all, go to
the workers, where they cover most of every document; what is left of a document is joined by shuffle, in which no
pre-token is frequent any more.

Defined cases: null text counts as the empty text (0 bytes, 0 tokens); special strings inside a text count as one
token each, as the library's default does; rows with the same or a null id are counted each for itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts, written

#: Pre-tokens longer than this many characters are given to the model directly, without a second regex pass; those of
#: more bytes are always joined by shuffle.
LONG_PIECE = 4096

#: Most pre-tokens whose counts go to the workers, and their UTF-8 bytes in all.
HEAD, HEAD_BYTES = 1 << 18, 16 << 20

#: Distinct pre-tokens, and their characters, that a worker gathers before it passes them on.
HELD, HELD_CHARS = 1 << 19, 32 << 20

#: The byte-level pre-token pattern (fixed value), with white space spelled out as Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte value: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PieceCounter:
    """Counts the pieces of pre-tokens by one tokenizer file (``.json`` of the byte-level kind)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without prefix space or normalizer is needed")
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(_PATTERN)
        self.chars = _byte_chars()

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it holds."""
        if not self.special or not (found := self.special.findall(text)):
            return self.pieces.findall(text), 0
        return [p for part in self.special.split(text) for p in self.pieces.findall(part)], len(found)

    def count(self, distinct: list[str]) -> list[int]:
        """Pieces of each distinct pre-token."""
        short = [p for p in distinct if len(p) <= LONG_PIECE]
        found = dict(zip(short, (len(e.ids) for e in self.tokenizer.encode_batch_fast(short, add_special_tokens=False)), strict=True))
        return [found[p] if p in found else len(self.tokenizer.model.tokenize("".join(self.chars[b] for b in p.encode()))) for p in distinct]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def distinct_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``piece, n, tokens``: every distinct pre-token of the texts, in how many of them it is, and its pieces; written."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, chars = counter(tokenizer_path), Counter(), 0

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.large_string()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in texts(batch.column(0)):
                found = set(own.split(text)[0])
                chars += sum(len(p) for p in found if p not in held)
                held.update(found)
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield passed()
                    held, chars = Counter(), 0
        if held:
            yield passed()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter(tokenizer_path).count(batch.column(0).to_pylist()), pa.int64())], ["piece", "n", "tokens"])

    found = docs.select("text").mapInArrow(gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return written(map_batches(found, count, "piece string, n long, tokens long"), "pieces")


def head_of(pieces: DataFrame) -> dict[str, int]:
    """Tokens of the most frequent pre-tokens, as many steps of frequency as ``HEAD`` and ``HEAD_BYTES`` hold."""
    step, size = F.floor(F.log2("n") * 16).cast("int"), F.octet_length("piece")
    short = pieces.where(size <= LONG_PIECE)
    sums = short.groupBy(step.alias("step")).agg(F.count("*").alias("pieces"), F.sum(size).alias("bytes")).orderBy(F.desc("step"))
    least, held, total = None, 0, 0
    for r in sums.collect():  # 16 steps for each doubling of the frequency
        held, total = held + r["pieces"], total + r["bytes"]
        if held > HEAD or total > HEAD_BYTES:
            break
        least = r["step"]
    if least is None:
        return {}
    found = short.where(step >= least).select("piece", "tokens").toArrow()
    return dict(zip(found["piece"].to_pylist(), found["tokens"].to_pylist(), strict=True))


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = distinct_pieces(docs, tokenizer_path)
    head = df.sparkSession.sparkContext.broadcast(head_of(pieces))  # of a size that HEAD and HEAD_BYTES bound
    kind = dict(docs.dtypes)["id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, known = counter(tokenizer_path), head.value
        sums, rest = [], []
        for text in texts(batch.column(2)):
            found, special = own.split(text)
            tokens = [known.get(p, 0) for p in found]  # every pre-token has a piece, so 0 is one of the others
            sums.append(sum(tokens) + special)
            rest.append(Counter(p for p, n in zip(found, tokens, strict=True) if not n) if 0 in tokens else {})
        ends = [0]
        for r in rest:
            ends.append(ends[-1] + len(r))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(parts)), of)) for parts, of in ((rest, pa.string()), ((r.values() for r in rest), pa.int32()))]
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], sizes, pa.array(sums, pa.int64()), *lists], ["rid", "id", "n_bytes", "known", "rest", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    rows = written(map_batches(numbered, run, f"rid long, id {kind}, n_bytes long, known long, rest array<string>, times array<int>"), "piece-rows")  # the row numbers are fixed from here on
    others = rows.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("piece"), F.col("x.times").alias("times"))
    sums = others.join(pieces.select("piece", "tokens"), "piece").groupBy("rid").agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0).cast("long"))
    return rows.select("rid", "id", "n_bytes", "known").join(sums, "rid", "left").select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
