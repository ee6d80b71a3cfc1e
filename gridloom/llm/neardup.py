"""Near-duplicate documents by a MinHash LSH forest.

Texts with the same words become one class first, so copies cost one row from there on. Every class gets a signature of
``VALUES`` minima, one byte each, and a second byte of those that begin an order. The forest has ``TREES`` orders of the
classes: order ``t`` sorts by the signature rotated by ``t * VALUES / TREES`` places, its first ``LEAST_DEPTH`` values by
both bytes, so that unlike texts seldom share a prefix in a table of any size. Neighbours in an order that share that
prefix are candidates. Of a longer run only the ``REACH`` nearest on either side are taken at first. Orders are sorted by
range over the cluster, so a dense region is spread over tasks; the rows at the ends of the ranges are linked in a
second pass.

Candidates whose signatures agree far below the threshold go. The others are confirmed on full shingle sets, in rounds:
each class with its most similar smaller partners first, then all pairs that still lie between components. The runs
longer than ``REACH`` covers that still hold several components are then compared in full, block by block, so that no
pair with a common prefix goes unseen: pairs between components whose signatures agree up to ``DEVIATIONS`` below the
threshold are counted on sets of 32-bit hashes, which never counts too little, and a spanning forest of those that meet
the threshold is confirmed. Components come from hooking and pointer jumping on written tables.

Words are runs of anything but ASCII white space, with A-Z in lower case; shingles are distinct runs of ``size`` words,
the whole sequence if there are fewer.

Defined cases: a text that is null or has no word has no shingles and is linked with nothing; repeated rows and copies
share a component; a null id takes part but names no component unless the component has no other id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import stars
from .common import Bloom, discard, fresh, joined_bytes, lower_table, map_batches, mix64, parted, word_hashes, written

VALUES, TREES, REACH, LEAST_DEPTH = 128, 16, 4, 3
#: Bytes that a row of an order carries as its sort key, and those that neighbours share at least.
CARRIED, PREFIX = 64, 2 * LEAST_DEPTH
#: Signatures may agree this much less than the threshold before a candidate goes (four deviations at 0.8).
SLACK = 0.2
#: Pairs of a class that are confirmed in the first round.
FIRST_PARTNERS = 3
#: Rows of an order that a worker compares at a time.
WINDOW_ROWS = 8192
#: How many deviations below the threshold signatures may agree where long runs are compared in full; shingles of a block
#: of classes there, about, and what a class counts at least; pairs after which a worker reduces them to their forest.
DEVIATIONS, BLOCK, LEAST_WEIGHT, FOREST_PAIRS = 4.5, 1 << 19, 256, 1 << 18

_LOWER = lower_table()
_WORD = np.ones(256, bool)
_WORD[[0, 9, 10, 11, 12, 13, 32]] = False  # a zero byte ends a row of joined_bytes
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(column: pa.Array, size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted distinct shingle hashes of every row, and a 128-bit digest of its words (empty without words)."""
    data, rows = joined_bytes(column, b"\xff")
    starts, _, hashes = word_hashes(_LOWER[data], _WORD)
    first = np.searchsorted(starts, rows)
    runs = hashes.copy()
    n = len(hashes) - size + 1
    if n > 0:
        runs = np.zeros(n, np.uint64)
        for k in range(size):
            runs = mix64(runs * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n] + np.uint64(k))
    sets, digests = [], []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(mix64(np.array([np.bitwise_xor.reduce(mix64(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
        digests.append(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else b"")
    return sets, digests


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of each of ``VALUES`` minima for every set that is not empty, then a second one of those that begin an order."""
    out = np.zeros((len(sets), VALUES + TREES * LEAST_DEPTH), np.uint8)
    step = VALUES // TREES
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        low = (flat >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        for j in range(VALUES):
            least = np.minimum.reduceat(low * _FACTORS[j] + _SHIFTS[j], starts)
            least ^= least >> np.uint32(15)
            least *= np.uint32(0x9E3779B1)
            out[full, j] = least >> np.uint32(24)
            if j % step < LEAST_DEPTH:
                out[full, VALUES + j // step * LEAST_DEPTH + j % step] = (least >> np.uint32(16)) & np.uint32(255)
    return out


def _prefix(t: int) -> Column:
    """What the rows of a run of order ``t`` have in common."""
    return F.concat(F.substring("sig", t * (VALUES // TREES) + 1, LEAST_DEPTH), F.substring("sig", VALUES + t * LEAST_DEPTH + 1, LEAST_DEPTH))


def _prefixes(sig: np.ndarray) -> np.ndarray:
    """The same for all orders, of signatures in rows."""
    first, second = sig[:, :VALUES].reshape(len(sig), TREES, -1)[:, :, :LEAST_DEPTH], sig[:, VALUES:].reshape(len(sig), TREES, -1)
    return np.concatenate([first, second], axis=2)


def classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, text_key, class, n_shingles) of every row, and ``nodes`` (class, sig, n_shingles, least) of every class."""
    kind = dict(docs.dtypes)["id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, digests = shingles(batch.column(2), size)
        sigs = signatures(sets)
        names = pa.array([d or None for d in digests], pa.binary())
        sig = pa.array([s.tobytes() if d else None for s, d in zip(sigs, digests, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array([len(s) for s in sets], pa.int64()), sig], ["id", "text_key", "class", "n_shingles", "sig"])

    each = written(map_batches(docs.select("id", "text_key", "text"), run, f"id {kind}, text_key long, class binary, n_shingles long, sig binary"), "dup-rows")
    nodes = written(each.where("class is not null").groupBy("class", "sig", "n_shingles").agg(F.min("id").alias("least")), "dup-nodes")
    members = written(each.drop("sig"), "dup-members")
    discard(each)
    return members, nodes


def _neighbours(rows: list[tuple[np.ndarray, np.ndarray, list[bytes]]], fresh: int, least: float) -> tuple[list[bytes], list[bytes], list[int]]:
    """Candidate pairs among sorted rows (tree, carried values, class); one side at least is of the last ``fresh``."""
    tree, sig = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    names = [c for r in rows for c in r[2]]
    first, second, agree = [], [], []
    n = len(names)
    for k in range(1, min(REACH, n - 1) + 1):
        at = np.arange(max(0, n - fresh - k), n - k)
        at = at[(tree[at] == tree[at + k]) & (sig[at, :PREFIX] == sig[at + k, :PREFIX]).all(axis=1)]
        same = (sig[at] == sig[at + k]).sum(axis=1)
        good = same >= least * CARRIED
        first += at[good].tolist()
        second += (at[good] + k).tolist()
        agree += same[good].tolist()
    return [names[i] for i in first], [names[i] for i in second], agree


def _linker(least: float):
    """Links the sorted rows of one range; the first and last rows are passed on as well, for the second pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        waiting: list[pa.RecordBatch] = []
        head, tail = [], None

        def pairs(part: pa.Table) -> pa.RecordBatch:
            nonlocal held, tail
            tree = part["tree"].to_numpy()
            sig = np.frombuffer(b"".join(part["key"].to_pylist()), np.uint8).reshape(-1, CARRIED)
            names = part["class"].to_pylist()
            a, b, agree = _neighbours([*held, (tree, sig, names)], len(names), least)
            old = held
            joined = [np.concatenate([r[i] for r in [*old, (tree, sig)]]) for i in (0, 1)]
            every = [c for r in old for c in r[2]] + names
            held = [(joined[0][-REACH:], joined[1][-REACH:], every[-REACH:])]
            for i in range(min(REACH - len(head), len(names))):
                head.append((int(tree[i]), sig[i].tobytes(), names[i]))
            tail = held[0]
            return _rows([(x, y, s, None, None) if x < y else (y, x, s, None, None) for x, y, s in zip(a, b, agree, strict=True)])

        def _rows(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["a", "b", "agree", "tree", "key"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= WINDOW_ROWS:
                yield pairs(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield pairs(pa.Table.from_batches(waiting))
        if tail is not None:
            ends = {*head, *((int(t), s.tobytes(), c) for t, s, c in zip(*tail, strict=True))}
            yield _rows([(c, None, None, t, s) for t, s, c in ends])

    return run


def candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs of classes ``a < b`` that are neighbours in some order, with how many carried values agree."""
    twice = F.concat(*[F.substring("sig", 1, VALUES)] * 2)
    step, key = VALUES // TREES, F.lit(None)
    for t in range(TREES):
        key = F.when(F.col("tree") == t, F.concat(_prefix(t), F.substring(twice, t * step + LEAST_DEPTH + 1, CARRIED - PREFIX))).otherwise(key)
    orders = nodes.select("class", "sig", F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree")).select("tree", key.alias("key"), "class")
    schema = "a binary, b binary, agree int, tree int, key binary"
    link = _linker(threshold - SLACK)
    spread = orders.repartitionByRange("tree", "key", "class").sortWithinPartitions("tree", "key", "class")
    found = written(spread.mapInArrow(link, schema), "dup-pairs")
    ends = found.where("b is null").select("tree", "key", F.col("a").alias("class"))  # 2 * REACH rows of a range
    between = ends.repartition(1).sortWithinPartitions("tree", "key", "class").mapInArrow(link, schema)
    every = found.select("a", "b", "agree").where("b is not null").unionByName(between.select("a", "b", "agree").where("b is not null"))
    return every.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def confirmed(pairs: DataFrame, sets: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold (numerator and denominator of the similarity)."""
    up, down = threshold
    one = sets.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = sets.select(F.col("class").alias("b"), F.col("text").alias("text_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, _ = shingles(batch.column(2), size)
        right, _ = shingles(batch.column(3), size)
        keep = []
        for x, y in zip(left, right, strict=True):
            common = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(down * common >= up * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b"), run, "a binary, b binary")


def with_roots(roots: DataFrame) -> DataFrame:
    """``node, root`` of all that is linked, the roots included."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with ``root_a`` and ``root_b`` (null for a class without links)."""
    tops = with_roots(roots)
    of = lambda side: tops.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not root_a <=> root_b or root_a is null")


def long_runs(nodes: DataFrame) -> DataFrame:
    """``tree, prefix, class, n_shingles`` of the runs in which some classes lie farther apart than ``REACH``."""
    prefixes = F.array(*map(_prefix, range(TREES)))
    places = nodes.select("class", "n_shingles", F.posexplode(prefixes).alias("tree", "prefix"))
    long = places.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > REACH + 1).select("tree", "prefix")
    return written(places.join(long, ["tree", "prefix"]), "dup-runs")


def mixed_runs(runs: DataFrame, tops: DataFrame) -> DataFrame:
    """The classes of the long runs that hold several components, in each two blocks that meet: ``tree, prefix, x, y, own, class, root``.

    The classes of a run's largest component and those of all others are dealt to blocks by hash. Each block of the others
    meets every block, so pairs inside the largest component cost nothing.
    """
    keys = ["tree", "prefix"]
    placed = written(runs.join(tops.select(F.col("node").alias("class"), "root"), "class", "left").select(*keys, "class", "n_shingles", F.coalesce("root", "class").alias("root")), "dup-placed")
    parts = placed.groupBy(*keys, "root").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST_WEIGHT))).alias("n"))
    mixed = parts.groupBy(*keys).agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("most.n < n")
    mixed = mixed.select(*keys, F.col("most.root").alias("top"), F.ceil(F.col("most.n") / BLOCK).alias("inner"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("outer"))
    part = F.xxhash64("class")
    own = F.when(F.col("root") == F.col("top"), F.col("outer") + F.pmod(part, F.col("inner"))).otherwise(F.pmod(part, F.col("outer")))
    partners = F.when(F.col("root") == F.col("top"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    dealt = placed.join(mixed, keys).select(*keys, "class", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), partners - 1)).alias("other"))
    return dealt.select(*keys, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "root")


class _Blocks:
    """Two blocks of a run (one, if they are the same) whose pairs are compared."""

    def __init__(self, rows: pa.Table, threshold: tuple[int, int]) -> None:
        self.up, self.down = threshold
        share = self.up / self.down
        self.least = VALUES * (share - DEVIATIONS * (share * (1 - share) / VALUES) ** 0.5)
        tree, x, y = (rows[c][0].as_py() for c in ("tree", "x", "y"))
        own, self.sizes = rows["own"].to_numpy(), rows["n_shingles"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(own), -1)
        self.sig, self.earlier = np.ascontiguousarray(sig[:, :VALUES]), _prefixes(sig)[:, :tree]
        self.roots = np.unique(np.array([r.hex() for r in rows["root"].to_pylist()]), return_inverse=True)[1]
        self.one, self.two, self.same = np.flatnonzero(own == x), np.flatnonzero(own == y), x == y

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with those of other components that may be as similar; a pair comes once."""
        for i in self.one:
            at = self.two[self.two > i] if self.same else self.two
            at = at[self.roots[at] != self.roots[i]]
            at = at[self.down * np.minimum(self.sizes[at], self.sizes[i]) >= self.up * np.maximum(self.sizes[at], self.sizes[i])]
            at = at[(self.sig[at] == self.sig[i]).sum(axis=1) >= self.least]
            at = at[~(self.earlier[at] == self.earlier[i]).all(axis=2).any(axis=1)]  # an earlier order has these in one run
            if len(at):
                yield i, at

    def forest(self, pairs: np.ndarray) -> np.ndarray:
        """The pairs (rows of a table) that join components which those before do not."""
        roots, keep = self.roots.copy(), []
        left = np.arange(len(pairs))
        while len(left := left[roots[pairs[left, 0]] != roots[pairs[left, 1]]]):
            a, b = pairs[left[0]]
            keep.append(left[0])
            roots[roots == roots[b]] = roots[a]
        return pairs[keep]


def active(met: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The rows of ``met`` (a result of ``mixed_runs``) that have a partner by signatures."""
    keys = ["tree", "prefix", "x", "y"]

    def run(rows: pa.Table) -> pa.Table:
        seen = np.zeros(rows.num_rows, bool)
        for i, at in _Blocks(rows, threshold).partners():
            seen[i] = True
            seen[at] = True
        return rows.select([*keys, "own", "class", "root"]).filter(pa.array(seen))

    rows = met.join(nodes.select("class", "n_shingles", "sig"), "class").select(*keys, "own", "class", "root", "n_shingles", "sig")
    return written(rows.groupBy(*keys).applyInArrow(run, met.select(*keys, "own", "class", "root").schema), "dup-active")


def hashed_sets(wanted: DataFrame, nodes: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """``class, n_shingles, sig, set`` of the classes in ``wanted``; the set as 32-bit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for s in shingles(batch.column(3), size)[0]]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["class", "n_shingles", "sig", "set"])

    rows = nodes.join(wanted, "class", "left_semi").join(sets, "class").select("class", "n_shingles", "sig", "text")
    return written(map_batches(rows, run, "class binary, n_shingles long, sig binary, set binary"), "dup-sets")


def run_pairs(some: DataFrame, hashed: DataFrame, threshold: tuple[int, int], forest: bool) -> DataFrame:
    """Pairs ``a, b`` of classes in one long run and different components that meet the threshold on hashed sets.

    With ``forest``, of each two blocks only the pairs of a spanning forest between components; otherwise all.
    """
    keys = ["tree", "prefix", "x", "y"]

    def run(rows: pa.Table) -> pa.Table:
        blocks, names = _Blocks(rows, threshold), rows["class"].to_pylist()
        sets = [np.frombuffer(s, np.uint32) for s in rows["set"].to_pylist()]
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(flat, np.cumsum(blocks.sizes)[:-1])
        mark = np.zeros(len(values), np.int64)
        found, held = [np.empty((0, 2), np.int64)], 0
        for i, at in blocks.partners():
            mark[ids[i]] = 1
            common = np.add.reduceat(mark[np.concatenate([ids[j] for j in at])], np.concatenate(([0], np.cumsum(blocks.sizes[at])[:-1])))
            mark[ids[i]] = 0
            at = at[blocks.down * common >= blocks.up * (blocks.sizes[at] + blocks.sizes[i] - common)]
            found.append(np.stack([np.full(len(at), i), at], axis=1))
            held += len(at)
            if forest and held >= FOREST_PAIRS:
                found, held = [blocks.forest(np.concatenate(found))], 0
        pairs = np.concatenate(found)
        pairs = blocks.forest(pairs) if forest else pairs
        ends = [[fn(names[i], names[j]) for i, j in pairs] for fn in (min, max)]
        return pa.table([pa.array(x, pa.binary()) for x in ends], ["a", "b"])

    return some.join(hashed, "class").groupBy(*keys).applyInArrow(run, "a binary, b binary")


def group(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept, text_key`` for every row; ``text_key`` is the hash of its text."""
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    members, nodes = classes(docs, size)
    pairs = written(candidates(nodes, threshold[0] / threshold[1]), "dup-candidates")

    runs = long_runs(nodes)

    # Texts of the classes that occur in a pair or a long run, one row each: a Bloom filter keeps all others in their workers.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(runs.select("class")).distinct().join(nodes.select("class", "least"), "class")
    wanted = wanted.select(F.col("class").alias("class_"), F.col("least").alias("least_"))
    some = members.join(wanted, (F.col("class") == F.col("class_")) & F.col("id").eqNullSafe(F.col("least_")), "left_semi")
    some = written(some.groupBy("class").agg(F.max(F.struct("id", "text_key")).alias("one")).select("class", F.col("one.id").alias("id_"), F.col("one.text_key").alias("key_")), "dup-wanted")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(some.select(F.xxhash64("id_", "key_").alias("key")), "key"))  # of fixed size
    keyed = docs.withColumn("key", F.xxhash64("id", "text_key"))

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.take(pa.array(bloom.value.passed(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))))

    full = map_batches(keyed, passed, keyed.schema).join(some.withColumn("key", F.xxhash64("id_", "key_")), "key")
    sets = written(full.where(F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))).dropDuplicates(["key", "class"]).select("class", "text"), "dup-texts")

    # Links are confirmed in rounds: for each class its most similar partners first, then all pairs that are left between
    # components. Most pairs fall inside a component before their turn.
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))  # at most 2 * REACH * TREES rows
    first = written(pairs.withColumn("r", rank).where(F.col("r") <= FIRST_PARTNERS).drop("r"), "dup-turn")
    roots = stars(confirmed(first, sets, size, threshold))
    left = written(between(pairs.join(first, ["a", "b"], "left_anti"), roots).select("a", "b", "agree"), "dup-turn")
    roots = stars(written(confirmed(left, sets, size, threshold), "dup-links").unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))

    # Long runs: a forest joins all that belongs together unless a pair of it fails on the full sets; then all are asked.
    hashed = None
    for forest in (True, False):
        some = active(mixed_runs(runs, with_roots(roots)), nodes, threshold)
        hashed = hashed or hashed_sets(some.select("class").distinct(), nodes, sets, size)
        asked = written(run_pairs(some, hashed, threshold, forest).distinct(), "dup-turn")
        more = written(confirmed(asked, sets, size, threshold), "dup-links")
        if not more.isEmpty():
            roots = stars(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        if asked.count() == more.count():
            break
    tops = with_roots(roots)
    named = nodes.select(F.col("class").alias("node"), "least")
    grouped = tops.join(named, "node")
    least = grouped.groupBy("root").agg(F.min("least").alias("top"))
    names = grouped.join(least, "root").select(F.col("node").alias("class"), "top")
    # Written, so that the last join has two plain sides and Spark can split the classes with very many copies.
    final = written(nodes.select("class", "least").join(names, "class", "left").select("class", F.coalesce("top", "least").alias("component_id")), "dup-final")
    out = members.join(final, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), "text_key").withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col, "n_shingles", "component_id", "kept", "text_key")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``groups`` keeps; one of repeated rows.

    Only the rows that may go or are repeated meet ``groups`` in a shuffle; all others stay where they are.
    """
    id_, key_, kept_ = (fresh(docs, c) for c in ("id_", "key_", "kept_"))
    special = groups.groupBy(F.col(id_col).alias(id_), F.col("text_key").alias(key_)).agg(F.bool_or("kept").alias(kept_), F.count("*").alias("n"))
    special = written(special.where(~F.col(kept_) | (F.col("n") > 1)).drop("n"), "dup-special")
    some, rest = parted(docs, special.select(F.xxhash64(id_, key_)), F.xxhash64(id_col, F.xxhash64(text_col)))
    met = some.join(special, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(key_)), "left")
    once = met.where(kept_).dropDuplicates([id_, key_]).unionByName(met.where(F.col(kept_).isNull()))
    return rest.unionByName(once.drop(id_, key_, kept_))
