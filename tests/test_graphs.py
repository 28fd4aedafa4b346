"""Topology, clustering, coresets and small-sample tests against plain forms."""

import itertools
import math

import numpy as np
import pytest

from voxara.operators import clustering, matrices, topology, tracks
from voxara.operators import statistics as st


def _matrix(n, density, seed, binary=False):
    rng = np.random.default_rng(seed)
    w = np.triu((rng.random((n, n)) < density) * (1 if binary else rng.integers(1, 5, (n, n)) / 4), 1)
    return w + w.T


def _edges(spark, mats):
    rows = [(s, i, j, float(w[i, j])) for s, w in mats.items() for i, j in np.argwhere(w).tolist()]
    return spark.createDataFrame(rows, "subject long, i int, j int, w double")


def _paths(length, s, t):
    """All simple paths with their lengths."""
    n, out = len(length), []

    def go(path, far):
        if path[-1] == t:
            out.append((far, tuple(path)))
            return
        for v in range(n):
            if v not in path and np.isfinite(length[path[-1], v]):
                go([*path, v], far + length[path[-1], v])

    go([s], 0.0)
    return out


def _between(length):
    n = len(length)
    b, d = np.zeros(n), np.full((n, n), np.inf)
    for s, t in itertools.permutations(range(n), 2):
        found = _paths(length, s, t)
        if found:
            d[s, t] = min(f for f, _ in found)
            short = [p for f, p in found if math.isclose(f, d[s, t], rel_tol=1e-12)]
            for p in short:
                b[list(p[1:-1])] += 1 / len(short)
    return b, d


@pytest.mark.parametrize("weighted", [True, False])
def test_node_measures(spark, weighted):
    mats = {1: _matrix(7, 0.5, 1, not weighted), 2: _matrix(7, 0.35, 2, not weighted), 3: _matrix(7, 1.0, 3, not weighted)}
    got = {(r.subject, r.node): r for r in topology.node_paths(_edges(spark, mats), 7, weighted).collect()}
    assert len(got) == 21
    for s, w in mats.items():
        b, d = _between(np.where(w > 0, 1 / np.where(w > 0, w, 1), np.inf))
        for v in range(7):
            r, near = got[s, v], np.flatnonzero(w[v])
            assert r.betweenness == pytest.approx(b[v] / 30) and r.efficiency == pytest.approx((1 / d[v][np.isfinite(d[v])]).sum() / 6)
            inner = w[np.ix_(near, near)]
            _, e = _between(np.where(inner > 0, 1 / np.where(inner > 0, inner, 1), np.inf))
            k, scale = len(near), np.outer(w[v, near], w[v, near]) if weighted else 1
            local = (np.cbrt(scale / e) if weighted else 1 / e) if k > 1 else np.zeros(1)
            assert r.local_efficiency == pytest.approx(np.where(np.isfinite(local), local, 0).sum() / (k * (k - 1)) if k > 1 else 0)


def test_closed_weights_are_lengths():
    w = np.array([[0, 1.0, 2.5], [1, 0, 1], [2.5, 1, 0]])
    d = topology.all_distances(np.where(w > 0, w, np.inf))
    assert d[0, 2] == 2 and topology.betweenness(np.where(np.eye(3) > 0, np.inf, d), d).tolist() == [0, 1, 0]  # 0-1-2 and the closed edge 0-2 tie


def test_grids_of_densities(spark):
    m = _edges(spark, {1: _matrix(7, 1.0, 4), 2: _matrix(7, 1.0, 5)})
    got = topology.node_grid(m, 7, [0.3, 0.7]).collect()
    assert len(got) == 2 * 2 * 7 and {r.density for r in got} == {0.3, 0.7}
    assert {(r.subject, r.density) for r in topology.module_grid(m, 7, [0.3, 0.7], restarts=5).collect()} == {(s, d) for s in (1, 2) for d in (0.3, 0.7)}


def test_communities_reach_the_best_partition(spark):
    mats = {s: _matrix(6, 0.6, s) for s in (11, 12, 13)}
    got = {r.subject: r.modularity for r in matrices.communities(_edges(spark, mats), 6).collect()}
    for s, w in mats.items():
        total, k = w.sum(), w.sum(1)
        best = max((((w - np.outer(k, k) / total) * (np.array(p)[:, None] == np.array(p))).sum() / total) for p in itertools.product(range(6), repeat=6) if all(p[i] <= max(p[:i], default=-1) + 1 for i in range(6)))
        assert got[s] == pytest.approx(best)


# Ward
def _ward(d):
    """One merge at a time, by Lance and Williams."""
    n = len(d)
    d2, size, alive, out = d.astype(float) ** 2, np.ones(n), list(range(n)), []
    while len(alive) > 1:
        a, b = min(itertools.combinations(alive, 2), key=lambda p: (d2[p], p))
        out.append((a, b, math.sqrt(d2[a, b]), int(size[a] + size[b])))
        for k in alive:
            if k not in (a, b):
                d2[a, k] = d2[k, a] = ((size[a] + size[k]) * d2[a, k] + (size[b] + size[k]) * d2[b, k] - size[k] * d2[a, b]) / (size[a] + size[b] + size[k])
        size[a] += size[b]
        alive.remove(b)
    return out


def _index(x, label):
    n, k = len(x), len(set(label))
    if not 1 < k < n:
        return None
    parts = [x[label == c] for c in sorted(set(label))]
    within = sum(((p - p.mean(0)) ** 2).sum() for p in parts)
    return sum(len(p) * ((p.mean(0) - x.mean(0)) ** 2).sum() for p in parts) / (k - 1) / (within / (n - k))


def test_ward_and_its_cuts(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(13, 4)) + 3 * rng.integers(0, 3, (13, 1))
    rows = [(i, f"f{f}", float(x[i, f])) for i in range(13) for f in range(4)]
    merges, members, index = clustering.hierarchical(spark.createDataFrame(rows, "subject long, feature string, y double"))
    z = (x - x.mean(0)) / x.std(0)
    expected = _ward(((z[:, None] - z) ** 2).mean(2))
    got = sorted(map(tuple, merges.collect()), key=lambda m: m[2])
    assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in expected]
    assert [d for _, _, d, _ in got] == pytest.approx([d for _, _, d, _ in expected])
    indexes, table = {r.clusters: r["index"] for r in index.collect()}, {}
    for r in members.collect():
        assert (r.clusters, r.subject) not in table
        table[r.clusters, r.subject] = r.cluster
    for k in range(1, 14):
        label = np.arange(13)
        for a, b, _, _ in expected[: 13 - k]:
            label[label == label[b]] = label[a]
        assert [table[k, s] for s in range(13)] == label.tolist()
        assert indexes[k] == (None if k in (1, 13) else pytest.approx(_index(z, label)))
    assert {r.clusters for r in clustering.assignments(merges, 3).collect()} == {1, 2, 3}


def test_ward_of_ties_and_of_none(spark):
    pairs = [(a, b, 1.0) for a, b in itertools.combinations(range(6), 2)]
    df = spark.createDataFrame(pairs, "a long, b long, distance double")
    assert sorted(m.size for m in clustering.ward(df).collect())[-1] == 6
    assert clustering.ward(df.where("false")).count() == 0


# Tracks
def test_coreset_takes_rare_streamlines(spark):
    rows = [(0, s, q, q + 0.5, 0.5, 0.5) for s in range(30) for q in range(5)] + [(0, 100 + s, q, q + 0.5, s + 2.5, 0.5) for s in range(4) for q in range(5)]
    points = spark.createDataFrame(rows, "subject long, streamline long, seq long, x double, y double, z double")
    got = tracks.coreset(points, 50).collect()
    assert len(got) == 17 and len({r.draw for r in got}) == 1
    assert sum(r.streamline >= 100 for r in got) >= 3  # they alone visit their voxels
    seen = {(q, 0 if r.streamline < 100 else r.streamline) for r in got for q in range(5)}
    assert got[0].covered == pytest.approx(len(seen) / 25)
    assert tracks.coreset(points, 1).count() == 0


# Small samples
@pytest.mark.parametrize(("na", "nb"), [(1, 1), (3, 4), (5, 2), (6, 6)])
def test_exact_distribution(na, nb):
    us = [sum(r) - nb * (nb - 1) // 2 for r in itertools.combinations(range(na + nb), nb)]
    upper = st._exact_upper(na, nb)
    assert upper == pytest.approx([sum(u >= k for u in us) / len(us) for k in range(na * nb + 1)])


def test_small_groups_are_exact_and_ties_are_not(spark):
    y = {"clear": ([1, 2, 3, 4], [5, 6, 7, 8, 9]), "mixed": ([1, 4, 6], [2, 3, 5]), "tied": ([1, 1, 2], [2, 3, 3]), "alone": ([], [1, 2]), "large": (list(range(10)), [x + 0.5 for x in range(9)])}
    rows = [(f, g, float(v)) for f, (a, b) in y.items() for g, vs in (("a", a), ("b", b)) for v in vs] + [("clear", "a", None), ("clear", "c", 3.0)]
    got = {r.feature: r for r in st.mann_whitney_full(spark.createDataFrame(rows, "feature string, group string, y double"), "a", "b").collect()}
    assert got["clear"].p == pytest.approx(2 / math.comb(9, 4)) and got["clear"].u == 20 and got["clear"].effect_trend == got["clear"].effect == -1
    assert got["mixed"].p == pytest.approx(1.0) and got["mixed"].q == 1 and got["mixed"].effect_trend == 0
    assert got["tied"].p != pytest.approx(2 * st._exact_upper(3, 3)[8]) and set(got) == set(y)
    assert got["clear"].q == pytest.approx(got["clear"].p * sum(r.p is not None and r.p < 1 for r in got.values()))


def test_normality_levels(spark):
    rng = np.random.default_rng(2)
    rows = [("normal", float(v)) for v in rng.normal(size=100)] + [("skewed", float(v)) for v in rng.exponential(size=100)] + [("skewed", None)]
    got = {r.feature: r for r in st.normality(spark.createDataFrame(rows, "feature string, y double")).collect()}
    assert got["normal"].p > 0.05 and got["normal"].log_p == 0
    assert got["skewed"].p == 0.01 and got["skewed"].log_p == pytest.approx(2) and got["skewed"].n == 100
