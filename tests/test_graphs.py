"""Graphs, trees, spanning forests, clusterings against small independent versions."""

from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from gridloom.errors import InvalidNodeId, InvalidTree, UnknownNodeProperty, UnrelatedNode
from gridloom.operators import clustering, components, graphs, neighbours, spanning, trees
from gridloom.operators.graphs import Graph, UGraph
from gridloom.operators.trees import Tree


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_graph_constructor(spark):
    edges = _edges(spark, [(1, 3), (1, 2), (2, 1)])
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3)], "node long")
    g = Graph(nodes, edges)
    assert g.n_nodes() == 3 and g.edges.count() == 3
    assert Graph(edges=edges).n_nodes() == 3
    with pytest.raises(InvalidNodeId):
        Graph(nodes.where("node < 3"), edges)
    matrix = spark.createDataFrame([(0, 1), (2, 0)], "i long, j long")
    assert {(r.src, r.dst) for r in Graph(adjacency=matrix).edges.collect()} == {(0, 1), (2, 0)}
    assert Graph(edges=edges, adjacency=matrix).edges.count() == 3  # edges win
    assert g.add_edges(_edges(spark, [(1, 3), (7, 8)])).n_nodes() == 5
    assert g.remove_edges(_edges(spark, [(1, 3)])).edges.count() == 2
    assert g.reset().n_nodes() == 0


def test_undirected_graph(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "node long, ord long")
    g = UGraph(nodes, _edges(spark, [(1, 3), (1, 2), (2, 1)]))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(3, 1), (2, 1)}  # by place, not by value
    assert {(r.i, r.j) for r in g.adjacency().collect()} == {(3, 1), (1, 3), (2, 1), (1, 2)}
    plain = UGraph(edges=_edges(spark, [(1, 3), (1, 2), (2, 1)]))
    assert {(r.src, r.dst) for r in plain.edges.collect()} == {(1, 2), (1, 3)}


def test_tree_forms(spark):
    parents = spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "node long, parent long")
    children = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "node long, child long")
    wrong = spark.createDataFrame([(1, 3)], "node long, child long")
    for form in ({"parents": parents}, {"children": children}, {"parents": parents, "children": children}):
        assert Tree(**form).parents.count() == 3
    with pytest.raises(InvalidTree):
        Tree(parents=parents, children=wrong)
    edges = spark.createDataFrame([(1, 4), (2, 1)], "parent long, child long")
    with pytest.warns(UserWarning):
        tree = Tree(edges=edges, parents=parents)
    assert {(r.node, r.parent) for r in tree.parents.collect()} == {(4, 1), (1, 2)}
    with pytest.raises(InvalidTree):
        Tree()


def test_tree_queries(spark):
    rng = random.Random(3)
    up = {n: rng.randrange(max(0, n - 3), n) for n in range(1, 60)}
    tree = Tree(parents=spark.createDataFrame(list(up.items()), "node long, parent long"))

    def path(n):
        out = [n]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out

    assert {r.node: r.path for r in tree.root_path().collect()} == {n: path(n) for n in range(60)}
    assert {r.root for r in tree.root().collect()} == {0}
    inner = set(up.values())
    assert {(r.node, r.leaf) for r in tree.leaves().collect()} == {(a, n) for n in range(60) if n not in inner for a in path(n)}
    pairs = [(a, b) for a, b in itertools.combinations(range(1, 60), 2) if rng.random() < 0.1]
    found = {(r.a, r.b): r.edge_dist for r in tree.edge_dist(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        pa, pb = path(a), path(b)
        met = next(n for n in pa if n in pb)
        assert found[a, b] == pa.index(met) + pb.index(met) + 1
    with pytest.raises(UnrelatedNode):
        tree.common_ancestor(spark.createDataFrame([(0, 5)], "a long, b long")).collect()
    with pytest.raises(UnknownNodeProperty):
        tree.cut_on_property("cut", "size", 1)
    values = {n: rng.random() for n in range(60) if n % 7}
    nodes = spark.createDataFrame(list(values.items()), "node long, size double")
    marked = Tree(nodes=nodes, parents=tree.parents).cut_on_property("cut", "size", 0.3)
    want = {n for n in range(60) if all(values.get(m, -1) >= 0.3 for m in path(n)[:-1])}
    assert {r.node for r in marked.nodes.where("cut").collect()} == want
    with pytest.raises(InvalidTree):
        trees.closure(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_path_to_and_flagged_leaves(spark):
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 3)], "node long, parent long")
    got = trees.path_to(tree, spark.createDataFrame([(5, 2), (4, 3), (1, 1)], "node long, target long"), strict=False)
    assert {r.node: r.path for r in got.collect()} == {5: [5, 3, 2], 4: None, 1: []}
    flags = spark.createDataFrame([(1, True), (2, True), (3, True), (5, False)], "node long, flag boolean")
    assert {(r.node, r.leaf) for r in trees.leaves(tree, prop=flags).collect()} == {(1, 3), (2, 3), (3, 3)}


def test_components_and_spanning_forest(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(9) / 2) for _ in range(90)]
    root: dict[int, int] = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    want = []
    best: dict[tuple[int, int], float] = {}
    for a, b, w in edges:
        if a != b:
            best[min(a, b), max(a, b)] = min(w, best.get((min(a, b), max(a, b)), 99.0))
    for (a, b), w in sorted(best.items(), key=lambda e: (e[1], e[0])):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            want.append((a, b, w))
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    forest = spanning.spanning_forest(frame)
    assert sorted(tuple(r) for r in forest.collect()) == sorted(want)
    stars = components.stars(frame, "src", "dst")
    assert {r.node: r.root for r in stars.collect()} == {n: find(n) for n in root if find(n) != n}
    sizes = spark.createDataFrame([(n, 1.0) for n in range(60)], "node long, size double")
    merges = sorted(tuple(r) for r in spanning.merge_tree(forest, sizes).collect())
    assert len(merges) == len(want) and merges[0][0] == 2 * len(want)
    assert sorted(m[3] for m in merges) == sorted(w for *_, w in want)
    links = {(r.node, r.parent) for r in spanning.tree_of_merges(spanning.merge_tree(forest, sizes)).collect()}
    assert links == {(c, m[0]) for m in merges for c in (m[1], m[2])}
    assert spanning.spanning_forest(frame.limit(0)).count() == 0


def test_merges_follow_the_least_criterion():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(12, 3))
    chain = [(i, i + 1, float(((points[i] - points[i + 1]) ** 2).sum())) for i in range(11) if i != 5]
    got = clustering.dendrogram(points, chain)
    assert len(got) == 11 and got[0][2] == min(d for *_, d in chain) and got[-1][3] == 12
    assert sorted(n for a, b, *_ in got for n in (a, b)) == list(range(22))
    # The pieces 0..5 and 6..11 have no link, so they meet last, at the distance of their centres.
    assert np.isclose(got[-1][2], ((points[:6].mean(axis=0) - points[6:].mean(axis=0)) ** 2).sum())


def _plain_merges(points, edges, criterion):
    """All links in a table, the least searched anew in every step."""
    n = len(points)
    centre, people, links = dict(enumerate(points)), dict.fromkeys(range(n), 1), {}
    for a, b, d in edges:
        links.setdefault((min(a, b), max(a, b)), (d, 1.0))
    out = []
    for c in range(n, 2 * n - 1):
        if not links:
            links = {(a, b): (float(((centre[a] - centre[b]) ** 2).sum()), 1.0) for a, b in itertools.combinations(sorted(centre), 2)}
        i, j = min(links, key=lambda e: (criterion(*links[e]), e))
        size = people[i] + people[j]
        out.append((i, j, criterion(*links[i, j]), size))
        wi, wj, between = people[i] / size, people[j] / size, links[i, j][0]
        people[c], centre[c] = size, wi * centre.pop(i) + wj * centre.pop(j)
        of = {k: [links.pop((min(k, e), max(k, e)), None) for e in (i, j)] for k in list(centre) if k != c}
        del links[i, j]
        for k, (to_i, to_j) in of.items():
            if to_i and to_j:
                links[k, c] = (wi * to_i[0] + wj * to_j[0] - wi * wj * between, wi * to_i[1] + wj * to_j[1])
            elif to_i or to_j:
                links[k, c] = (float(((centre[c] - centre[k]) ** 2).sum()), wi * to_i[1] if to_i else wj * to_j[1])
    return out


@pytest.mark.parametrize("criterion", [clustering.ratio, lambda d, s: d**0.5 / s, lambda d, s: -d * s])
def test_merges_by_force(criterion):
    """Pieces, single nodes and copies, until few links are left, and then all."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 12, 40):
        points = rng.normal(size=(n, 3))
        if criterion is clustering.ratio:
            points[n // 2 : n // 2 + 5] = points[n // 2]
        edges = [(int(a), int(b), float(((points[a] - points[b]) ** 2).sum())) for a, b in rng.integers(0, n, (n // 2, 2)) if a != b]
        got, want = clustering.dendrogram(points, edges, criterion), _plain_merges(points, edges, criterion)
        assert [(a, b, size) for a, b, _, size in got] == [(a, b, size) for a, b, _, size in want]
        assert np.allclose([m[2] for m in got], [m[2] for m in want], atol=1e-12)


def test_merges_without_links_hold_no_pairs():
    """Of 600 nodes without a link, the 179,700 pairs are not held at once (they took over 50 MB)."""
    points = np.random.default_rng(9).normal(size=(600, 4))
    tracemalloc.start()
    try:
        assert clustering.dendrogram(points, [])[-1][3] == 600
        assert tracemalloc.get_traced_memory()[1] < 5e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("shift", "digits"), [(0, 9), (0, 0), (1e7, 9)])
def test_nearest_by_force(monkeypatch, shift, digits):
    """Ties, copies, vectors far from the origin and those that are not finite, in strips and parts of any size."""
    rng = np.random.default_rng(10)
    x, y = (np.round(rng.normal(size=(n, 5)), digits) + shift for n in (90, 120))
    y[:40], y[60:90], x[7], y[100], y[101, 2] = x[:40], y[3], np.nan, 1e200, np.inf
    with np.errstate(all="ignore"):
        d = sum((x[:, c, None] - y[None, :, c]) ** 2 for c in range(5))
    d[np.arange(90), np.arange(90)] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    want = [(i, int(j), d[i, j]) for i in range(90) for j in order[i] if np.isfinite(d[i, j])]
    for strip, pairs in ((512, 1 << 16), (7, 50)):
        monkeypatch.setattr(neighbours, "STRIP", strip)
        monkeypatch.setattr(neighbours, "PAIRS", pairs)
        assert list(zip(*(v.tolist() for v in neighbours.nearest(x, np.arange(90), y, np.arange(120), 4)), strict=True)) == want


def test_neighbours_bring_few_candidates(spark):
    """1,200 vectors are three blocks, each pair of which is one group: no block goes to every other with a copy of both."""
    rows = spark.createDataFrame([(i, [float(i * i % 1201), float(i % 7)]) for i in range(1200)], "id long, v array<float>")
    near = neighbours.knn(rows, "id", "v", 2)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and near.count() == 2400


def test_cluster_centroids(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(6, 2))
    nodes = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "node long, vector array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    merges = clustering.agglomerate(nodes, edges)
    assert [tuple(r)[1:3] for r in merges.orderBy("step").collect()] == [m[:2] for m in clustering.dendrogram(points, [(i, i + 1, float(((points[i] - points[i + 1]) ** 2).sum())) for i in range(5)])]
    found = {r.node: (r.population, r.centroid) for r in clustering.centroids(merges, nodes, 6).collect()}
    assert found[10][0] == 6 and np.allclose(found[10][1], points.mean(axis=0)) and np.allclose(found[2][1], points[2])


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 100, size=(80, 2))
    rows = spark.createDataFrame([(i, [float(v) for v in p], float(p[0]), float(p[1])) for i, p in enumerate(points)], "id long, v array<double>, x double, y double")
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(80) for j in np.argsort(d[i], kind="stable")[:3]}
    assert {(r.src, r.dst) for r in neighbours.knn(rows, "id", "v", 3, block=16).collect()} == want
    near = {(i, j) for i, j in want if d[i, j] <= 64} | {(j, i) for i, j in want if d[i, j] <= 64}
    assert {(r.src, r.dst) for r in neighbours.near_points(rows, "id", "x", "y", 3, 8.0).collect()} == near
    picked = [r.id for r in neighbours.farthest_points(rows, "id", "v", 6, 0).orderBy("step").collect()]
    expect, least = [0], d[0].copy()
    least[0] = 0
    while len(expect) < 6:
        expect.append(int(least.argmax()))
        least = np.minimum(least, np.where(np.isinf(d[expect[-1]]), 0, d[expect[-1]]))
    assert picked == expect
    both = [r.id for r in neighbours.farthest_and_random(rows, "id", "v", 0.1, 0.2).collect()]
    assert len(both) == len(set(both)) == 8 + 16
    assert graphs.weighted_adjacency(spark.createDataFrame([(1, 2, 1.0), (2, 1, 3.0)], "src long, dst long, w double"), "w").count() == 2


@pytest.mark.parametrize("candidates", [1, 7, 1024])
def test_farthest_points_by_force(spark, monkeypatch, candidates):
    """However few candidates a round has, and with ties, repeated points and points without a vector."""
    monkeypatch.setattr(neighbours, "CANDIDATES", candidates)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 6, (60, 3)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    n = 14 if candidates == 1 else 61
    d, want = np.full(60, np.inf), []
    while len(want) < n and (not want or d.max() > 0):
        want.append(0 if not want else int(d.argmax()))
        d = np.minimum(d, ((points - points[want[-1]]) ** 2).sum(axis=1))
    assert [r.id for r in neighbours.farthest_points(frame, "id", "v", n).orderBy("step").collect()] == want
    assert neighbours.farthest_points(frame.limit(0), "id", "v", 3).count() == 0
