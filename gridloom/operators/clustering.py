"""Agglomerative clustering along the links of a graph.

Every step merges the linked pair with the least criterion (squared distance over link strength). Merges depend on
each other, so a graph is one Arrow group with a heap of its own; graphs run in parallel. Once no link is left all
clusters are linked, and each keeps its nearest one: memory is in proportion to their number, not to their pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import closure

Criterion = Callable[[float, float], float]


def ratio(distance: float, strength: float) -> float:
    return distance / strength


class _Linked:
    """Clusters of which all are linked with strength 1, in the order of their numbers.

    Distances are those of the centres, which the recurrence of centroids equals, and any mean of ones is 1. Each cluster
    has the least criterion to a later one (``near``, ``who``). Where that one is gone, or not known yet, ``near`` is no more
    than the least, and the cluster's row is compared only when it comes to the front. Under ``ratio`` a product of the
    centres less their mean (``f``, squared lengths ``q``) tells which distances matter; those are taken exactly.
    """

    def __init__(self, numbers: Sequence[int], centres: Sequence[np.ndarray], people: Sequence[int], criterion: Criterion) -> None:
        n = len(numbers)
        self.criterion, self.n = criterion, n
        self.number, self.people = np.resize(np.asarray(numbers), 2 * n), np.resize(np.asarray(people), 2 * n)
        self.x = np.concatenate([np.stack(list(centres)), np.zeros((n, len(centres[0])))])
        self.near, self.who, self.alive = np.full(2 * n, np.inf), np.full(2 * n, -1), np.arange(2 * n) < n
        with np.errstate(all="ignore"):
            self.mean = self.x[:n].mean(axis=0)
            self.f = self.x - self.mean
            self.q = np.where(self.alive, (self.f**2).sum(axis=1), np.inf)
        self.error = 8 * (self.x.shape[1] + 8) * np.finfo(float).eps
        self.quick = criterion is ratio and bool((self.q[:n] < 1e300).all())
        for k in range(n - 1):
            self._compare(k)

    def _values(self, at: int, start: int, stop: int) -> np.ndarray:
        d = ((self.x[start:stop] - self.x[at]) ** 2).sum(axis=1)
        values = d if self.criterion is ratio else np.array([self.criterion(v, 1.0) for v in d.tolist()], float)
        return np.where(self.alive[start:stop] & ~np.isnan(values), values, np.inf)

    def _about(self, at: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and their greatest errors; infinite for clusters that are gone."""
        q = self.q[start:stop] + self.q[at]
        return q - 2 * (self.f[start:stop] @ self.f[at]), self.error * q

    def _exact(self, at: int, others: np.ndarray) -> np.ndarray:
        return ((self.x[others] - self.x[at]) ** 2).sum(axis=1)

    def _compare(self, k: int) -> None:
        others = np.arange(k + 1, self.n)
        if self.quick and len(others):
            about, error = self._about(k, k + 1, self.n)
            with np.errstate(invalid="ignore"):
                others = np.flatnonzero(about - error <= (about + error).min()) + k + 1
            values = self._exact(k, others)
        else:
            values = self._values(k, k + 1, self.n)
        self.who[k] = others[values.argmin()] if len(values) else k
        self.near[k] = values.min(initial=np.inf)

    def _pack(self) -> None:
        kept = np.flatnonzero(self.alive[: self.n])
        place = np.full(self.n, -1)
        place[kept] = np.arange(len(kept))
        who = self.who[kept]
        for a in (self.number, self.people, self.x, self.near, self.f, self.q):
            a[: len(kept)] = a[kept]
        self.who[: len(kept)] = np.where(who < 0, -1, place[who])
        self.n = len(kept)
        self.alive[:] = np.arange(len(self.alive)) < self.n

    def merge(self, c: int) -> tuple[int, int, float, int]:
        """Merge the least pair, ties by number, into cluster ``c``."""
        if self.alive[: self.n].sum() * 2 < self.n:
            self._pack()
        i = int(self.near[: self.n].argmin())
        while self.alive[i] and self.who[i] < 0:
            self._compare(i)
            i = int(self.near[: self.n].argmin())
        j = int(self.who[i])
        if np.isinf(self.near[i]):
            i, j = (int(k) for k in np.flatnonzero(self.alive[: self.n])[:2])
        value = float(self.criterion(float(((self.x[j] - self.x[i]) ** 2).sum()), 1.0))
        size = int(self.people[i] + self.people[j])
        out = (int(self.number[i]), int(self.number[j]), value, size)
        at = self.n
        self.x[at] = self.x[i] + self.people[j] / size * (self.x[j] - self.x[i])  # equal centres stay what they are
        self.number[at], self.people[at], self.near[at], self.who[at] = c, size, np.inf, at
        self.f[at] = self.x[at] - self.mean
        self.q[at] = (self.f[at] ** 2).sum()
        self.alive[[i, j]], self.near[[i, j]], self.q[[i, j]], self.alive[at] = False, np.inf, np.inf, True
        self.n += 1
        who, near = self.who[:at], self.near[:at]
        who[(who == i) | (who == j)] = -1
        if self.quick:
            about, error = self._about(at, 0, at)
            with np.errstate(invalid="ignore"):
                others = np.flatnonzero(about - error < near)
            values = self._exact(at, others)
        else:
            others, values = np.arange(at), self._values(at, 0, at)
        less = values < near[others]
        near[others[less]], who[others[less]] = values[less], at
        return out


def dendrogram(vectors: np.ndarray, edges: Sequence[tuple[int, int, float]], criterion: Criterion = ratio) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, criterion, size) of nodes 0..n-1; the merge at step ``t`` is node ``n + t``.

    ``edges`` have squared distances. When clusters i and j become c, its distance to a neighbour k follows from
    theirs by the centroid recurrence, or from the centroids where one is not known; its strength is their mean
    weighted by population. When no link is left, all remaining clusters are linked with strength 1.
    """
    n = len(vectors)
    centre: dict[int, np.ndarray] = dict(enumerate(vectors.astype(float)))
    people = dict.fromkeys(range(n), 1)
    links: dict[int, dict[int, tuple[float, float]]] = {k: {} for k in range(n)}
    heap: list[tuple[float, int, int]] = []

    def join(a: int, b: int, distance: float, strength: float) -> None:
        links[a][b] = links[b][a] = (distance, strength)
        heapq.heappush(heap, (criterion(distance, strength), min(a, b), max(a, b)))

    for a, b, distance in edges:
        if a != b and b not in links[a]:
            join(a, b, distance, 1.0)
    out: list[tuple[int, int, float, int]] = []
    for c in range(n, 2 * n - 1):
        while heap and not (heap[0][1] in links and heap[0][2] in links[heap[0][1]]):
            heapq.heappop(heap)
        if not heap:
            left = sorted(links)
            rest = _Linked(left, [centre[k] for k in left], [people[k] for k in left], criterion)
            return out + [rest.merge(k) for k in range(c, 2 * n - 1)]
        value, i, j = heapq.heappop(heap)
        size = people[i] + people[j]
        wi, wj = people[i] / size, people[j] / size
        own, other = links.pop(i), links.pop(j)
        between = own[j][0]
        out.append((i, j, value, size))
        people[c], centre[c], links[c] = size, wi * centre[i] + wj * centre[j], {}
        for k in sorted((own.keys() | other.keys()) - {i, j}):
            links[k].pop(i, None)
            links[k].pop(j, None)
            to_i, to_j = own.get(k), other.get(k)
            if to_i and to_j:
                distance = wi * to_i[0] + wj * to_j[0] - wi * wj * between
            else:
                distance = float(((centre[c] - centre[k]) ** 2).sum())
            join(c, k, distance, wi * (to_i[1] if to_i else 0) + wj * (to_j[1] if to_j else 0))
        del centre[i], centre[j]
    return out


def agglomerate(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), criterion: Criterion = ratio) -> DataFrame:
    """Dendrograms ``keys, step, left, right, distance, size`` of graphs.

    ``nodes`` has keys, node, vector; ``edges`` has keys, src, dst and optionally weight (a distance; squared here).
    ``left`` and ``right`` number the nodes by their order in the graph, then the merges.
    """
    keys = list(keys)
    if not keys:
        return agglomerate(nodes.withColumn("g_", F.lit(0)), edges.withColumn("g_", F.lit(0)), ["g_"], criterion).drop("g_")
    weighted = "weight" in edges.columns
    types = dict(nodes.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", step int, left int, right int, distance double, size int"

    def run(key: tuple, points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("node")
        place = {v: i for i, v in enumerate(points["node"])}
        vectors = np.stack([np.asarray(v, float) for v in points["vector"]]) if len(points) else np.zeros((0, 1))
        pairs: dict[tuple[int, int], float] = {}
        for row in links.sort_values(["src", "dst"]).itertuples():
            a, b = sorted((place[row.src], place[row.dst]))
            if a != b:
                pairs.setdefault((a, b), row.weight**2 if weighted else float(((vectors[a] - vectors[b]) ** 2).sum()))
        found = dendrogram(vectors, [(a, b, d) for (a, b), d in pairs.items()], criterion)
        return pd.DataFrame([(*key, t, *row) for t, row in enumerate(found)], columns=[*keys, "step", "left", "right", "distance", "size"])

    return nodes.select(*keys, "node", "vector").groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(run, schema)


def as_tree(merges: DataFrame, n_nodes: int, keys: Sequence[str] = ()) -> DataFrame:
    """A dendrogram as ``keys, node, parent, distance, size`` (distance and size are the parent's merge)."""
    rows = merges.withColumn("parent", F.col("step") + n_nodes)
    return rows.select(*keys, F.explode(F.array("left", "right")).alias("node"), "parent", F.sqrt("distance").alias("distance"), "size")


def centroids(merges: DataFrame, nodes: DataFrame, n_nodes: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node, population, centroid`` of every cluster: the mean of the vectors below it.

    ``nodes`` has keys, node (its number from 0) and vector.
    """
    keys = list(keys)
    below = closure(as_tree(merges, n_nodes, keys).select(*keys, F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent")), keys)
    parts = below.join(nodes.select(*keys, F.col("node").cast("long").alias("node"), F.posexplode("vector").alias("k", "v")), [*keys, "node"])
    means = parts.groupBy(*keys, "anc", "k").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return means.groupBy(*keys, F.col("anc").alias("node")).agg(F.max("n").alias("population"), F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("centroid"))
