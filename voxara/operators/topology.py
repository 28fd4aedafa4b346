"""Node measures of connectomes: betweenness and efficiencies from all shortest paths.

A connectome has n nodes, so one subject's matrix (at one density) is the unit
of work, dealt over the cluster. Inside, steps run over nodes, each for all
sources at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxara.operators.batches import spread
from voxara.operators.matrices import _keyed, _unkeyed, binarize, communities, from_upper, normalise, prune


def all_distances(length: np.ndarray) -> np.ndarray:
    """Shortest distances for lengths between nodes; infinite where there is no edge."""
    d = length.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k], out=d)
    return d


def betweenness(length: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums over ordered pairs of the shares of shortest paths through each node, by dependencies of sources.

    Nodes come in the order of their distance, a step for all sources together:
    first numbers of paths outward, then dependencies back.
    """
    n = len(d)
    order = np.argsort(d, axis=1, kind="stable")
    paths, rows, before = np.eye(n), np.arange(n), []
    for r in range(1, n):
        t = order[:, r]
        far = d[rows, t]
        step = length[:, t].T
        with np.errstate(invalid="ignore"):
            on = np.isfinite(far)[:, None] & np.isfinite(step) & (d < far[:, None]) & np.isclose(d + step, far[:, None], rtol=1e-10, atol=0)
        before.append(on)
        paths[rows, t] = np.where(np.isfinite(far), (on * paths).sum(1), paths[rows, t])
    carried = np.zeros((n, n))
    for r in range(n - 1, 0, -1):
        t = order[:, r]
        share = np.divide(1 + carried[rows, t], paths[rows, t], out=np.zeros(n), where=paths[rows, t] > 0)
        carried += before[r - 1] * paths * share[:, None]
    np.fill_diagonal(carried, 0)
    return carried.sum(0)


def local_efficiency(w: np.ndarray, weighted: bool) -> np.ndarray:
    """Efficiency among each node's neighbours, on paths within them; weights count by the cube root of triangles."""
    out = np.zeros(len(w))
    for u in range(len(w)):
        near = np.flatnonzero(w[u])
        k = len(near)
        if k < 2:
            continue
        inner = w[np.ix_(near, near)]
        d = all_distances(np.divide(1.0, inner, out=np.full(inner.shape, np.inf), where=inner > 0))
        e = np.divide(1.0, d, out=np.zeros_like(d), where=(d > 0) & np.isfinite(d))
        total = np.cbrt(np.outer(w[u, near], w[u, near]) * e) if weighted else e
        out[u] = total.sum() / (k * (k - 1))
    return out


def node_paths(m: DataFrame, n: int, weighted: bool = True, closure: bool = False) -> DataFrame:
    """Betweenness and efficiencies of every node of each subject's symmetric matrix (subject, i, j, w).

    Lengths are 1 / w, or 1 for binary matrices. ``closure`` takes weights as
    lengths, and the shortest distances between all pairs as the edges that
    paths go along. Betweenness is divided by (n - 1)(n - 2). Nodes without an
    edge have 0. Returns subject, node, betweenness, local_efficiency and
    efficiency (mean of inverse distances to all others).
    """

    def measure(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((n, n))
        held = edges[(edges.w > 0) & (edges.i != edges.j)]
        w[held.i, held.j] = held.w if weighted else 1.0
        length = np.divide(1.0, w, out=np.full((n, n), np.inf), where=w > 0)
        d = all_distances(length)
        inverse = np.divide(1.0, d, out=np.zeros_like(d), where=(d > 0) & np.isfinite(d))
        if closure:
            d = all_distances(np.where(w > 0, w, np.inf))
            length = np.where(np.eye(n) > 0, np.inf, d)
        b = betweenness(length, d) / max(1, (n - 1) * (n - 2))
        return pd.DataFrame({"subject": key[0], "node": np.arange(n, dtype=np.int32), "betweenness": b, "local_efficiency": local_efficiency(w, weighted), "efficiency": inverse.sum(1) / max(1, n - 1)})

    return spread(m, "subject").groupBy("subject").applyInPandas(measure, "subject long, node int, betweenness double, local_efficiency double, efficiency double")


def _pruned(m: DataFrame, n: int, densities: list[float], weighted: bool) -> DataFrame:
    """Every subject's matrix at every density, scaled or binary, under one key."""
    edges = from_upper(reduce(lambda a, b: a.unionByName(b), [_keyed(prune(m.where("i < j"), d), d) for d in densities]))
    scaled = normalise(edges, n) if weighted else binarize(edges)
    return scaled.where("w > 0")


def node_grid(m: DataFrame, n: int, densities: list[float], weighted: bool = True) -> DataFrame:
    """Node measures of each subject's matrix pruned to each density: subject, density, node and what node_paths has."""
    return _unkeyed(node_paths(_pruned(m, n, densities, weighted), n, weighted))


def module_grid(m: DataFrame, n: int, densities: list[float], weighted: bool = True, restarts: int = 100) -> DataFrame:
    """Modularity of the best of many seeded searches at each density: subject, density, modules, modularity."""
    from pyspark.sql import functions as F

    found = communities(_pruned(m, n, densities, weighted), n, restarts)
    return _unkeyed(found.groupBy("subject").agg(F.countDistinct("module").alias("modules"), F.max("modularity").alias("modularity")))
