"""Blocks with halos: numerical kernels over neighbourhoods, from long voxel tables and back.

Every voxel goes to its own block and to those whose halo it lies in. A block
with its halo is one dense array, bounded by the block's size whatever the
image; the kernel's values of the inner part come out as rows. So the one
shuffle is that of the voxels, and no second one puts the parts together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.batches import by_groups

AXES = ("i", "j", "k")
Kernel = Callable[..., np.ndarray]
#: Values of arrays that go to a kernel at once, about; one block, slice or volume at least.
CELLS = 1 << 16


def _near_blocks(axis: str, n: int, block: int, halo: int) -> F.Column:
    """The numbers of the blocks along an axis that hold a voxel, halo included."""
    last = (n - 1) // block
    return F.sequence(F.greatest(F.floor((F.col(axis) - halo) / block), F.lit(0)), F.least(F.floor((F.col(axis) + halo) / block), F.lit(last))).cast("array<int>")


def by_blocks(img: DataFrame, shape: dict[str, int], halo: int, kernel: Kernel, block: int = 32, pad: str = "reflect", maps: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(a, inside, **maps)`` on each block with ``halo`` more voxels on every side.

    ``img`` has subject, i, j, k, value, and t where there are volumes; then
    ``shape`` has t too and ``a`` is four-dimensional. ``inside`` tells which
    voxels lie in the image; beyond it ``a`` is filled as numpy's pad mode says,
    with zeros for "constant". Further columns that depend on the voxel alone
    come by name as ``maps``. Voxels without a row, or with a null, are 0; of
    rows that repeat a voxel any one holds. Rows outside the shape are left out.
    The kernel returns an array of the same first three dimensions, with or
    without volumes, of which only the inner part counts. Blocks without any
    voxel, halo included, have no rows.

    Blocks of the same place in several images go together: after the first
    three dimensions ``a`` and the maps have one more, of the images, which
    the kernel keeps. ``inside`` is the same for all. ``one_by_one`` makes such
    a kernel of one that knows a single block.
    """
    deep, n_t = "t" in shape, shape.get("t", 1)
    size = np.array([shape[a] for a in AXES])
    inside = F.lit(True)
    for a, n in shape.items():
        inside = inside & F.col(a).between(0, n - 1)
    named = img.where(inside).select("subject", *[F.col(a).cast("int").alias(a) for a in AXES], *([F.col("t").cast("int").alias("t")] if deep else []), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("value", *maps)])
    for a in AXES:
        named = named.withColumn(f"block_{a}", F.explode(_near_blocks(a, shape[a], block, halo)))
    subject_type = dict(named.dtypes)["subject"]

    blocks = [f"block_{a}" for a in AXES]

    def run(rows: pa.Table, which: np.ndarray, one: np.ndarray) -> pa.Table:
        first = np.array([rows.column(b)[0].as_py() for b in blocks]) * block
        last = np.minimum(first + block, size)
        low, high = np.maximum(first - halo, 0), np.minimum(last + halo, size)
        at = (*[rows.column(a).to_numpy() - lo for a, lo in zip(AXES, low, strict=True)], which)
        edges = list(zip(low - (first - halo), last + halo - high, strict=True))

        def dense(column: str, volumes: bool) -> np.ndarray:
            a = np.zeros((*(high - low), len(one), n_t) if volumes else (*(high - low), len(one)))
            a[(*at, rows.column("t").to_numpy()) if volumes else at] = rows.column(column).to_numpy()
            return np.pad(a, [*edges, *[(0, 0)] * (a.ndim - 3)], mode=pad)

        known = np.pad(np.ones(tuple(high - low), bool), edges, constant_values=False)
        got = kernel(dense("value", deep), known, **{m: dense(m, False) for m in maps})
        # Images first, then the place, then volumes.
        inner = np.ascontiguousarray(np.moveaxis(got[tuple(slice(halo, halo + n) for n in last - first)], 3, 0), np.float64)
        grid = np.indices(inner.shape[1:]).reshape(inner.ndim - 1, -1)
        n = grid.shape[1]
        columns = [np.tile((grid[k] + (first[k] if k < 3 else 0)).astype(np.int32), len(one)) for k in range(inner.ndim - 1)]
        subject = rows.column("subject").take(pa.array(np.repeat(one, n)))
        return pa.table([subject, *map(pa.array, columns), pa.array(inner.ravel())], names=["subject", *AXES, *(["t"] if inner.ndim == 5 else []), "value"])

    # A kernel tells whether volumes stay by what it returns; it is asked once, on zeros.
    around = [2 * halo + 1] * 3
    probe = kernel(np.zeros((*around, 1, n_t) if deep else (*around, 1)), np.ones(around, bool), **{m: np.zeros((*around, 1)) for m in maps})
    schema = f"subject {subject_type}, i int, j int, k int, {'t int, ' if probe.ndim == 5 else ''}value double"
    most = max(1, CELLS // (int(np.prod(np.minimum(size, block) + 2 * halo)) * n_t))
    return by_groups(named, ["subject", *blocks], run, schema, most, tuple(blocks))


def one_by_one(kernel: Kernel) -> Kernel:
    """A kernel of many images' blocks, from one of a single block."""

    def run(a: np.ndarray, inside: np.ndarray, **maps: np.ndarray) -> np.ndarray:
        return np.stack([kernel(np.ascontiguousarray(a[:, :, :, n]), inside, **{m: np.ascontiguousarray(v[..., n]) for m, v in maps.items()}) for n in range(a.shape[3])], 3)

    return run


def box_sums(a: np.ndarray, width: int) -> np.ndarray:
    """Sums over windows of ``width`` along the first three axes, where a whole window fits."""
    for axis in range(3):
        run = np.cumsum(a, axis=axis, dtype=float)
        run = np.concatenate([np.zeros_like(run.take([0], axis)), run], axis)
        n = run.shape[axis]
        a = run.take(range(width, n), axis) - run.take(range(n - width), axis)
    return a


def moved(a: np.ndarray, by: tuple[int, int, int], halo: int) -> np.ndarray:
    """The part of ``a`` without the halo, moved by as many voxels."""
    return a[tuple(slice(halo + d, n - halo + d) for d, n in zip(by, a.shape, strict=False))]


def _filled(a: np.ndarray, halo: int) -> np.ndarray:
    """An array with a halo around it again; what stands there doesn't count."""
    return np.pad(a, [(halo, halo)] * 3 + [(0, 0)] * (a.ndim - 3))


def box_mean(img: DataFrame, shape: dict[str, int], radius: int = 1, block: int = 32) -> DataFrame:
    """Mean of each voxel's neighbourhood within the image."""

    def kernel(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        here = inside.astype(float)[(..., *[None] * (a.ndim - 3))]
        return _filled(box_sums(a * here, 2 * radius + 1) / np.maximum(box_sums(here, 2 * radius + 1), 1), radius)

    return by_blocks(img, shape, radius, kernel, block, "constant")
