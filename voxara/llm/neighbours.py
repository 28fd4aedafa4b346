"""Approximate nearest neighbours by learned partitions (operator 11).

A bounded sample of vectors gives a graph of nearest neighbours. The graph is
cut into parts of equal size that keep neighbours together: halves along
principal axes first, then swaps between parts that raise the number of
neighbours at home. A small network learns which parts hold a vector's
neighbours. It gives every vector of the table its part, and a query its most
probable parts; how many a query probes is the least number that reaches
``RECALL`` for sampled vectors that took no part in the fit. Parts are cut into
blocks and a part's queries into tiles; each tile meets each block of its part
once, and exact distances rank what they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxara.llm.common import drop, lean, stored
from voxara.llm.vectors import _valid

#: Vectors the model is fitted on, at most; a quarter of them are held out to find the number of probes.
SAMPLE = 8192
#: Sampled vectors of a part, and parts at most; vectors of a block and queries of a tile, about.
PART, PARTS, BLOCK, TILE = 96, 64, 2048, 512
#: Neighbours in the graph; hidden units and passes of the network; the recall that the probes have to reach.
DEGREE, HIDDEN, PASSES, RECALL = 16, 128, 30, 0.95


@dataclass
class Router:
    """The network of one vector length: scores of the parts, and how many a query probes."""

    centre: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(0, (x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1).astype(np.int32)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable").astype(np.int32)


def _matrix(raws: list[bytes], dims: np.ndarray) -> np.ndarray:
    """Vectors of one length in double precision."""
    return np.stack([np.frombuffer(r, np.float32 if d > 0 else np.float64).astype(np.float64) for r, d in zip(raws, dims, strict=True)])


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by products; good to rounding."""
    return np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T)


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest in x of each row of q."""
    return np.concatenate([np.argpartition(_squares(q[i : i + 1024], x), k - 1, axis=1)[:, :k] for i in range(0, len(q), 1024)])


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts (a power of two) by medians along each group's first principal axis."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        cut = []
        for g in groups:
            y = x[g] - x[g].mean(0)
            _, axes = np.linalg.eigh(y.T @ y)
            order = g[np.argsort(y @ axes[:, -1], kind="stable")]
            cut += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = cut
    label = np.zeros(len(x), np.int64)
    for k, g in enumerate(groups):
        label[g] = k
    return label


def balanced_parts(near: np.ndarray, label: np.ndarray, parts: int, rounds: int = 30) -> np.ndarray:
    """Labels after swaps: pairs of vectors change places between two parts while that brings neighbours home, so sizes stay."""
    n, rng = len(near), np.random.default_rng(0)
    u = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    v = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    label = label.copy()
    for _ in range(rounds):
        held = np.bincount(u * parts + label[v], minlength=n * parts).reshape(n, parts)
        home = held[np.arange(n), label]
        held[np.arange(n), label] = -1
        best, gain = held.argmax(1), held.max(1) - home
        # Some stay for a round, so that neighbours don't pass each other for ever.
        want = np.flatnonzero((gain > 0) & (rng.random(n) < 0.7))
        key = label[want] * parts + best[want]
        order = np.lexsort((-gain[want], key))
        want, key = want[order], key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        back = np.bincount(key, minlength=parts * parts)[key % parts * parts + key // parts]
        go = want[place < back]
        label[go] = best[go]
        if len(go) < 0.002 * n:
            break
    return label


def _network(x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """One hidden layer, fitted to the distributions over parts by Adam."""
    rng = np.random.default_rng(1)
    layers = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, target.shape[1])) / np.sqrt(HIDDEN), np.zeros(target.shape[1])]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(PASSES):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            a, y = x[order[i : i + 256]], target[order[i : i + 256]]
            h = np.maximum(0, a @ layers[0] + layers[1])
            z = h @ layers[2] + layers[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - y) / len(a)
            back = (g @ layers[2].T) * (h > 0)
            t += 1
            for p, d, m, s in zip(layers, (a.T @ back, back.sum(0), h.T @ g, g.sum(0)), first, second, strict=True):
                d = d + 1e-4 * p
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(x: np.ndarray, neighbours: int) -> Router:
    """The router of a sample of distinct vectors; one part for all where the sample is small."""
    centre, scale = x.mean(0), float(x.std()) or 1.0
    parts = 1
    while parts < PARTS and len(x) // (2 * parts) >= PART:
        parts *= 2
    if parts == 1:
        return Router(centre, scale, [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    seen, held = x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :]
    near = _nearest(seen, seen, DEGREE + 1)
    near = np.stack([np.append(r[r != i], r[:0])[:DEGREE] for i, r in enumerate(near)])
    label = balanced_parts(near, halved(seen, parts), parts)
    target = np.bincount((np.arange(len(seen))[:, None] * parts + label[near]).ravel(), minlength=len(seen) * parts).reshape(-1, parts).astype(float)
    target[np.arange(len(seen)), label] += DEGREE / 4
    router = Router(centre, scale, _network((seen - centre) / scale, target / target.sum(1, keepdims=True)), parts)
    # Probes: the least number that finds enough of the held-out vectors' neighbours among the whole sample.
    k = min(neighbours + 1, len(x))
    true = router.part(x)[_nearest(held, x, k)]
    place = np.empty((len(held), parts), np.int64)
    np.put_along_axis(place, router.ranked(held), np.arange(parts)[None].repeat(len(held), 0), 1)
    needed = np.take_along_axis(place, true.astype(np.int64), 1)
    router.probes = next(p for p in range(1, parts + 1) if (needed < p).mean() >= RECALL)
    return router


def _routers(distinct: DataFrame, neighbours: int) -> dict[int, Router]:
    """A router for each vector length of the sample."""
    rows = distinct.select("h1", "h2", "raw", "dim").orderBy("h1", "h2").limit(SAMPLE).collect()
    dims = np.array([r["dim"] for r in rows], int)
    return {int(d): fit(_matrix([rows[i]["raw"] for i in np.flatnonzero(np.abs(dims) == d)], dims[np.abs(dims) == d]), neighbours) for d in np.unique(np.abs(dims))}


def _routed(vectors: DataFrame, routers: dict[int, Router], every: bool) -> DataFrame:
    """The rows with ``length`` and ``part``: the part of each, or all the parts that it probes."""
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            raws = b.column("raw").to_pylist()
            rows, parts = [], []
            for d in np.unique(np.abs(dims)):
                at = np.flatnonzero(np.abs(dims) == d)
                router = routers.get(int(d))
                if router is None:  # a length outside the sample has one part
                    rows.append(at)
                    parts.append(np.zeros(len(at), np.int32))
                    continue
                x = _matrix([raws[i] for i in at], dims[at])
                got = router.ranked(x)[:, : router.probes] if every else router.part(x)[:, None]
                rows.append(np.repeat(at, got.shape[1]))
                parts.append(got.ravel())
            if rows:
                at = pa.array(np.concatenate(rows))
                out = [b.column(n).take(at) for n in names]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.abs(dims).astype(np.int32)).take(at), pa.array(np.concatenate(parts))], names=[*names, "length", "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(lean(run), f"{schema}, length int, part int")


def _ranked(neighbours: int):
    """The nearest of one block to each query of one tile."""
    keep = neighbours + 1

    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bool, int, float]] = []
        if tile.num_rows and block.num_rows:
            q = _matrix(tile.column("raw").to_pylist(), tile.column("dim").to_numpy())
            x = _matrix(block.column("raw").to_pylist(), block.column("dim").to_numpy())
            ids = block.column("ids").to_pylist()
            own = {k: i for i, k in enumerate(zip(block.column("h1").to_pylist(), block.column("h2").to_pylist(), strict=True))}
            size = 1 + np.abs(x).max()
            squares = _squares(q, x)
            # What rounding could still put among the nearest is measured again.
            slack = 1e-12 * x.shape[1] * np.maximum(size, 1 + np.abs(q).max(1)) ** 2
            cut = (np.partition(squares, keep - 1, axis=1)[:, keep - 1] if len(x) > keep else squares.max(1)) + slack
            for i, key in enumerate(zip(tile.column("h1").to_pylist(), tile.column("h2").to_pylist(), strict=True)):
                at = np.flatnonzero(squares[i] <= cut[i])
                gap = x[at] - q[i]
                distance = np.sqrt((gap * gap).sum(1))
                found = sorted((d, v, int(j)) for d, j in zip(distance.tolist(), at, strict=True) for v in ids[j])[:keep]
                out += [(*key, own.get(key) == j, v, d) for d, v, j in found]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h1", "h2", "own", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 100, neighbours: int = 10) -> DataFrame:
    """The nearest found to each query: rows whose vec_id is divisible by ``every``, against all other rows.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a vec_id, take no part. Vectors of different length have no
    distance and never meet. Rows equal in vec_id and vector count once; rows
    that share a vec_id but not the vector are rows of their own, as queries
    too, and each other's candidates. Ties go to the smaller vec_id. An empty
    table has an empty result. Of equal vectors only the smallest ids can be
    among the nearest, one more than ``neighbours``; so many are carried.

    Returns query_id, rank, vec_id, score: Euclidean distance in double precision.
    """
    valid = stored(_valid(vectors).withColumn("h1", F.xxhash64("dim", "raw")).withColumn("h2", F.xxhash64("raw", F.lit(1), "dim")), "vectors")
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    lowest = valid.dropDuplicates(["h1", "h2", "vec_id"]).withColumn("nth", first).where(F.col("nth") <= neighbours + 1)
    distinct = stored(lowest.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("raw").alias("raw"), F.first("dim").alias("dim")), "distinct")
    routers = _routers(distinct, neighbours)
    placed = stored(_routed(distinct, routers, False), "placed")
    asked = valid.where(F.col("vec_id") % every == 0)
    queries = asked.groupBy("h1", "h2").agg(F.first("raw").alias("raw"), F.first("dim").alias("dim"))
    probes = stored(_routed(queries, routers, True), "probes")
    # Numbers of blocks and tiles: one row for each part and vector length.
    sizes = placed.groupBy("length", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tiles = probes.groupBy("length", "part").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    grid = sizes.join(tiles, ["length", "part"])
    number = lambda n: F.pmod(F.xxhash64("h2", "h1"), F.col(n)).cast("int")
    left = probes.join(grid, ["length", "part"]).withColumn("tile", number("tiles")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = placed.join(grid, ["length", "part"]).withColumn("block", number("blocks")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["length", "part", "tile", "block"]
    met = left.select(*keys, "h1", "h2", "raw", "dim").groupBy(*keys).cogroup(right.select(*keys, "h1", "h2", "ids", "raw", "dim").groupBy(*keys))
    met = met.applyInArrow(_ranked(neighbours), "h1 long, h2 long, own boolean, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("score", "vec_id", "own"))
    found = stored(met.withColumn("nth", best).where(F.col("nth") <= neighbours + 1), "found")
    lists = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "own"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id")))), 1, neighbours)
    answers = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(lists, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("rank", "hit"))
    out = stored(answers.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score"), "nearest")
    drop(valid, distinct, placed, probes, found)
    return out
