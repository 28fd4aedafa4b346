"""Embedding near-duplicates by an epsilon grid order join (operator 4).

Unit vectors with cosine c or more lie within eps = sqrt(2 - 2c) of each other.
Vectors are rotated to principal axes (fitted on a bounded sample; any rotation
keeps distances, so this only helps pruning) and sorted by their cells of width
eps along the leading axes. The sorted sequence is cut into blocks, and pairs of
intervals are refined from the whole sequence down to blocks, dropping pairs
whose bounding boxes are more than eps apart; within a pair of blocks the same
goes on down to small tiles, which are multiplied out in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import lean, stored
from voxara.llm.links import components

COSINE = 0.9
#: Vectors the axes are fitted on, at most; axes of the grid; vectors of a block and of a tile; children of an interval.
SAMPLE, AXES, BLOCK, LEAF, FAN = 4096, 8, 2048, 256, 16


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id and the raw vector as bytes of doubles; null, zero and non-finite vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raws, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if v is None or i is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    # Single precision holds values that came in single precision exactly.
                    short = x.astype(np.float32)
                    same = np.isfinite(short).all() and (short == x).all()
                    raws.append(short.tobytes() if same else x.tobytes())
                    dims.append(len(x) if same else -len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "raw", "dim"])

    return vectors.select("vec_id", "embedding").mapInArrow(lean(run), "vec_id long, raw binary, dim int")


def _units(raws: list[bytes], dims: list[int]) -> np.ndarray:
    """Unit vectors in double precision; all of one length."""
    x = np.stack([np.frombuffer(r, np.float32 if d > 0 else np.float64).astype(np.float64) for r, d in zip(raws, dims, strict=True)])
    x /= np.abs(x).max(1, keepdims=True)  # squares of large components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each vector length, from a sample of bounded size."""
    rows = distinct.orderBy("h1", "h2").limit(SAMPLE).select("raw", "dim").collect()
    found = {}
    for d in {abs(r["dim"]) for r in rows}:
        x = _units(*map(list, zip(*[(r["raw"], r["dim"]) for r in rows if abs(r["dim"]) == d], strict=True)))
        _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and d > 1 else np.eye(d))
        found[d] = np.ascontiguousarray(np.atleast_2d(axes)[:, ::-1])
    return found


def _rotated(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    own = axes.get(units.shape[1])
    return units if own is None else units @ own


def _cells(distinct: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """The vectors with their grid cells along the leading axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, dims = b.column("raw").to_pylist(), np.array(b.column("dim").to_pylist())
            cells = np.zeros((len(raws), AXES), np.int32)
            for d in np.unique(np.abs(dims)):
                at = np.flatnonzero(np.abs(dims) == d)
                y = _rotated(_units([raws[i] for i in at], dims[at].tolist()), axes)[:, :AXES]
                cells[at, : y.shape[1]] = np.floor(y / eps)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copies"), b.column("raw"), b.column("dim"), pa.array(np.abs(dims).astype(np.int32)), *[pa.array(cells[:, k]) for k in range(AXES)]], names=["id", "copies", "raw", "dim", "length", *[f"c{k}" for k in range(AXES)]])

    return distinct.select("id", "copies", "raw", "dim").mapInArrow(lean(run), "id long, copies long, raw binary, dim int, length int, " + ", ".join(f"c{k} int" for k in range(AXES)))


_BOX = [f"{side}{k}" for side in ("lo", "hi") for k in range(AXES)]


def _blocks(cells: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """The sequence in grid order, cut into blocks with bounding boxes: part, block, size, ids, copies, raws, dims, box."""
    order = ["length", *[f"c{k}" for k in range(AXES)], "id"]

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            raws, dims = rows.column("raw").to_pylist(), rows.column("dim").to_pylist()
            y = _rotated(_units(raws, dims), axes)[:, :AXES]
            y = np.pad(y, ((0, 0), (0, AXES - y.shape[1])))
            out = [[part], [number], [abs(dims[0])], [rows.column("id").to_pylist()], [rows.column("copies").to_pylist()], [raws], [dims], *[[v] for v in (*y.min(0).tolist(), *y.max(0).tolist())]]
            number += 1
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), *[pa.float64()] * len(_BOX)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["part", "block", "length", "ids", "copies", "raws", "dims", *_BOX])

        for b in batches:
            while b.num_rows:
                lengths = b.column("length").to_numpy()
                if held and held[0].column("length")[0].as_py() != lengths[0]:
                    yield block(pa.Table.from_batches(held))
                    held = []
                room = BLOCK - sum(x.num_rows for x in held)
                n = min(room, int(np.searchsorted(lengths, lengths[0], "right")))
                held.append(b.slice(0, n))
                b = b.slice(n)
                if n == room:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    schema = "part int, block int, length int, ids array<bigint>, copies array<bigint>, raws array<binary>, dims array<int>, " + ", ".join(f"{c} double" for c in _BOX)
    return cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(cut_blocks), schema)


def _near_blocks(boxes: DataFrame, n: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of block numbers whose boxes are within eps, refined level by level."""
    levels = 1
    while FAN**levels < n:
        levels += 1
    spark = boxes.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for level in range(levels - 1, -1, -1):
        nodes = boxes.groupBy("length", F.floor(F.col("number") / FAN**level).alias("node")).agg(*[(F.min(c) if c.startswith("lo") else F.max(c)).alias(c) for c in _BOX])
        sides = [nodes.select(F.floor(F.col("node") / FAN).alias(f"{s}_"), F.col("node").alias(f"{s}2"), F.col("length").alias(f"{s}_length"), *[F.col(c).alias(f"{s}{c}") for c in _BOX]) for s in "ab"]
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"alo{k}") - F.col(f"bhi{k}"), F.col(f"blo{k}") - F.col(f"ahi{k}")), 2) for k in range(AXES)), F.lit(0.0))
        met = pairs.join(sides[0], F.col("a") == F.col("a_")).join(sides[1], F.col("b") == F.col("b_"))
        near = met.where((F.col("a2") <= F.col("b2")) & (F.col("a_length") == F.col("b_length")) & (gap <= eps * eps))
        pairs = stored(near.select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "block_pairs")
    return pairs


def _join_tiles(x: np.ndarray, y: np.ndarray, same: bool, cosine: float, eps: float, axes: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with at least the cosine; intervals are halved while their boxes may meet."""
    rx, ry = _rotated(x, axes), _rotated(y, axes)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(rx[a0:a1].min(0) - ry[b0:b1].max(0), ry[b0:b1].min(0) - rx[a0:a1].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            todo += [(p, q, r, s) for p, q in ((a0, am), (am, a1)) for r, s in ((b0, bm), (bm, b1)) if q > p and s > r]
            continue
        i, j = np.nonzero(x[a0:a1] @ y[b0:b1].T >= cosine)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable, for indexes linked by the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links, classes and the kept vector of each class.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing; vectors of different length link with nothing of another length.
    Equal vectors are joined once and counted. A null vec_id has a row with no
    link and itself (null) as its component. Rows that repeat a vec_id count as
    vectors of their own.

    Returns vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    # A small margin keeps rounding from pruning; the products decide.
    eps = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-12
    valid = stored(_valid(vectors).withColumn("h1", F.xxhash64("dim", "raw")).withColumn("h2", F.xxhash64("raw", F.lit(1), "dim")), "vectors")
    distinct = stored(valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"), F.first("dim").alias("dim")), "distinct")
    axes = _axes(distinct)
    blocks = stored(_blocks(_cells(distinct, axes, eps), axes), "blocks")
    # One count per partition numbers the blocks along the sequence.
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "part int, start long")
    numbered = blocks.join(offsets, "part").withColumn("number", F.col("start") + F.col("block"))
    pairs = _near_blocks(numbered.select("number", "length", *_BOX), total, eps)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                same = r["a"] == r["b"]
                x = _units(r["a_raws"], r["a_dims"])
                y = x if same else _units(r["b_raws"], r["b_dims"])
                found = list(_join_tiles(x, y, same, cosine, eps, axes))
                if not found:
                    continue
                i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                ids = np.array(r["a_ids"] + ([] if same else r["b_ids"]), np.int64)
                copies = np.array(r["a_copies"] + ([] if same else r["b_copies"]), np.int64)
                j = j if same else j + len(x)
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                label = _forest(i, j, len(ids))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(links[hit].astype(np.int64))], names=["id", "other", "n"])

    side = lambda s: numbered.select(F.col("number").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "copies", "raws", "dims")])
    joined = stored(pairs.repartition(F.col("a"), F.col("b")).join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(join), "id long, other long, n long"), "joined")
    counts = joined.groupBy("id").agg(F.sum("n").alias("n"))
    component = components(joined.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = distinct.join(counts, "id", "left").join(component, "id", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = valid.join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    # Vectors that link with nothing have no valid row; a repeated vec_id keeps its rows apart by validity.
    usable = "embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(embedding, x -> x <> 0)"
    lone = vectors.where(f"not coalesce({usable}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
