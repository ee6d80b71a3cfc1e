"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words under a fixed mask and ignores those between, so a passage is still hit when some of its words
were exchanged. Seeds of all benchmark items and all documents are joined by hash; around each hit the document and
the item are compared word by word on the hit's diagonal, and the best segment (one point a match, two off for a
mismatch) counts as an overlap if ``IDENTITY`` of its words match and at least ``LEAST_MATCHES`` do, or that share of a
shorter item. Where it does not, the longest stretch of the diagonal with that share of matches is asked, which has
enough matches if any such stretch has. Items of fewer than ``FULL_SEARCH`` words are also sought by runs of words so short that any accepted overlap has one
unchanged; those under ``SHORTEST`` words are not sought.

Document seeds are first held against a Bloom filter of the benchmark's seeds. The filter has one fixed size, so what
is broadcast does not grow. Only runs of hits leave the workers, each with the words around it.

Words are runs of ASCII letters and digits and of all bytes beyond ASCII, with A-Z in lower case.

Defined cases: null or empty texts have no seeds; a null id is kept as such; rows with the same id are told apart by
their text; repeated rows give one result row; an empty table, or an empty benchmark, gives an empty result; other
columns are ignored (``clean`` keeps them as they are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, fresh, joined_bytes, lower_table, map_batches, mix64, parted, word_hashes, written

#: Masks (fixed): 1 is a word that counts, 0 one that is ignored.
MASKS = ("110110101", "1110010011", "101001100101", "11010001011", "1100101010001")
SHORTEST, IDENTITY, LEAST_MATCHES = 5, 0.8, 13
#: Items of fewer words are searched for every accepted overlap.
FULL_SEARCH = 15
#: Hits closer than this many words make one run; a run carries as many words on either side as the longest item has.
GAP = 16

_LOWER = lower_table()
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_MASKS = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]
_SPANS = [len(m) for m in MASKS]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows of a batch, and the first word of each row (one more at the end)."""
    data, rows = joined_bytes(column)
    starts, _, hashes = word_hashes(_LOWER[data], _WORD)
    return hashes, np.searchsorted(starts, rows)


def _seed(hashes: np.ndarray, offsets: np.ndarray, span: int, salt: int) -> np.ndarray:
    """Seed hash of a mask at every place where it fits in ``hashes``."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1, np.uint64)
    for k in offsets:
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix64(out)


def seeds(hashes: np.ndarray, first: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places, seed hashes, span) for each mask, and for all runs of words of the ``lengths``."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    plan = [(m, s, i) for i, (m, s) in enumerate(zip(_MASKS, _SPANS, strict=True))] + [(np.arange(n), n, 100 + n) for n in lengths]
    for offsets, span, salt in plan:
        found = _seed(hashes, offsets, span, salt)
        places = np.flatnonzero(owner[: len(found)] == owner[span - 1 : span - 1 + len(found)]) if len(found) else np.empty(0, np.int64)
        out.append((places, found[places], span))
    return out


def part(item_words: int) -> int:
    """Words of the longest run that every accepted overlap of a short item has unchanged: with ``k`` words exchanged or
    missing, one of ``k + 1`` parts of the item is whole."""
    missing = next(k for k in range(item_words, -1, -1) if accepted(item_words - k, item_words - k, item_words))
    return item_words // (missing + 1)


def item_tables(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The items' words ``item, words`` and seeds ``hash, item, at``, both written."""
    kind = dict(benchmark.dtypes)[item_col]

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = tokens(batch.column(1))
        own = [hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["item", "words"])

    def seeded(batch: pa.RecordBatch) -> pa.RecordBatch:
        item, at, hashes = [], [], []
        for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(own, np.uint64)
            short = (part(len(own)),) if SHORTEST <= len(own) < FULL_SEARCH else ()
            for places, found, _ in seeds(own, np.array([0, len(own)]), short):
                item += [name] * len(places)
                at.append(places)
                hashes.append(found.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(item, batch.schema.field(0).type), pa.array(np.concatenate(at).astype(np.int64))], ["hash", "item", "at"])

    items = written(map_batches(benchmark.select(F.col(item_col).alias("item"), text_col), words, f"item {kind}, words binary").dropDuplicates(), "benchmark-words")
    return items, written(map_batches(items, seeded, f"hash long, item {kind}, at long"), "benchmark-seeds")


def overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that overlap: ``id_col, item_col, doc_word, item_word, n_words, n_matches``
    (the best overlap), and ``text_key``, the hash of the document's text."""
    items, item_seeds = item_tables(benchmark, item_col, item_text_col)
    known = documents.sparkSession.sparkContext.broadcast(Bloom.of(item_seeds, "hash"))  # of fixed size
    size = F.expr("octet_length(words) div 8")
    sizes = items.where((size >= SHORTEST) & (size < FULL_SEARCH)).select(size).distinct().collect()  # fewer than FULL_SEARCH
    short = tuple(sorted({part(int(r[0])) for r in sizes}))
    reach = int(items.agg(F.max(size)).first()[0] or 0)
    kind = dict(documents.dtypes)[id_col]

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, first = tokens(batch.column(2))
        bloom = known.value
        at, found, spans = [], [], []
        for places, own, span in seeds(hashes, first, short):
            passed = bloom.passed(own)
            at.append(places[passed])
            found.append(own[passed])
            spans.append(np.full(len(passed), span))
        at, found, spans = map(np.concatenate, (at, found, spans))
        if not len(at):
            return None
        order = np.argsort(at, kind="stable")
        at, found, spans = at[order], found[order].view(np.int64), spans[order]
        owner = np.searchsorted(first, at, side="right") - 1
        cuts = np.flatnonzero((np.diff(at) > GAP) | (np.diff(owner) != 0)) + 1
        rows, begin, words, seed_hash, seed_at = [], [], [], [], []
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            row = owner[a]
            low, high = max(first[row], at[a] - reach), min(first[row + 1], int((at[a:b] + spans[a:b]).max()) + reach)
            rows.append(row)
            begin.append(low - first[row])
            words.append(hashes[low:high].tobytes())
            seed_hash.append(found[a:b])
            seed_at.append(at[a:b] - first[row])
        taken = pa.array(rows, pa.int64())
        lists = lambda parts: pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(begin, pa.int64()), pa.array(words, pa.binary()), lists(seed_hash), lists(seed_at)],
            ["id", "text_key", "begin", "words", "seed_hash", "seed_at"],
        )

    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), text_col)
    runs = map_batches(docs, hits, f"id {kind}, text_key long, begin long, words binary, seed_hash array<long>, seed_at array<long>")
    runs = written(runs.withColumn("run", F.monotonically_increasing_id()), "seed-runs")  # the run numbers are fixed from here on
    each = runs.select("run", F.explode(F.arrays_zip("seed_hash", "seed_at")).alias("s")).select("run", F.col("s.seed_hash").alias("hash"), F.col("s.seed_at").alias("place"))
    diagonals = each.join(item_seeds, "hash").select("run", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    pairs = diagonals.join(runs.select("run", "id", "text_key", "begin", F.col("words").alias("around")), "run").join(items, "item")
    pairs = pairs.select("id", "text_key", "item", "begin", "around", "words", "shift")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, out = [], []
        columns = [batch.column(i).to_pylist() for i in range(3, 7)]
        for i, (begin, around, words, shift) in enumerate(zip(*columns, strict=True)):
            diagonal = np.frombuffer(around, np.uint64), np.frombuffer(words, np.uint64), shift - begin
            best = segment(*diagonal)
            if best and not accepted(best[2], best[3], len(words) // 8):
                best = stretch(*diagonal)
            if best and accepted(best[2], best[3], len(words) // 8):
                keep.append(i)
                out.append((best[0] + begin, *best[1:]))
        if not keep:
            return None
        taken = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(k).take(taken) for k in range(3)] + [pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["id", "text_key", "item", "doc_word", "item_word", "n_words", "n_matches"])

    kept = map_batches(pairs, verify, f"id {kind}, text_key long, item {dict(items.dtypes)['item']}, doc_word long, item_word long, n_words long, n_matches long")
    best = F.max(F.struct("n_matches", "n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    kept = kept.groupBy("id", "text_key", "item").agg(best)
    return kept.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"), "b.n_words", "b.n_matches", "text_key")


def segment(around: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """Best segment on a diagonal: (first word in ``around``, first word of the item, words, matches)."""
    low, high = max(0, -shift), min(len(words), len(around) - shift)
    if high <= low:
        return None
    same = around[low + shift : high + shift] == words[low:high]
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    least = np.minimum.accumulate(score)
    end = int((score - least).argmax())
    if end == 0:
        return None
    start = int(np.flatnonzero(score[:end] == least[end])[-1])
    return low + start + shift, low + start, end - start, int(same[start:end].sum())


def stretch(around: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """Longest stretch of a diagonal of which ``IDENTITY`` matches, without mismatches at its ends, as ``segment`` gives it."""
    low, high = max(0, -shift), min(len(words), len(around) - shift)
    if high <= low:
        return None
    same = around[low + shift : high + shift] == words[low:high]
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))  # not falling where four of five words match
    begin = np.searchsorted(-np.minimum.accumulate(score), -score)  # the first place with no higher score
    end = int((np.arange(len(score)) - begin).argmax())
    hits = np.flatnonzero(same[begin[end] : end]) + begin[end]
    if not len(hits):
        return None
    start, end = int(hits[0]), int(hits[-1]) + 1
    return low + start + shift, low + start, end - start, len(hits)


def accepted(n: int, matches: int, item_words: int) -> bool:
    return matches >= IDENTITY * n and matches >= min(LEAST_MATCHES, IDENTITY * item_words)


def clean(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns unchanged, without those in ``found`` (a result of ``overlaps``)."""
    id_, key_ = fresh(documents, "id_"), fresh(documents, "key_")
    bad = written(found.select(F.col(id_col).alias(id_), F.col("text_key").alias(key_)).distinct(), "overlapping")
    some, rest = parted(documents, bad.select(F.xxhash64(id_, key_)), F.xxhash64(id_col, F.xxhash64(text_col)))
    return rest.unionByName(some.join(bad, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(key_)), "left_anti"))
