"""Free-water correction: the whole chain, and its spatially regularised form.

A tensor field is six factors per voxel (w1, w2, w3 scales, w4, w5, w6 shears).
The regularised form moves it down the area of the surface that the field spans
in space and factors, under the metric that is the same for all tensors up to
change of basis. Its steps need neighbours: each is one exchange of halos, and
the field is written between steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.lineage import cut, written
from voxara.operators import images, kernels, tensor
from voxara.operators.batches import spread
from voxara.operators.slabs import AXES, _filled, by_blocks, moved

VOXEL = ["subject", *AXES]
#: Volumes, at most, whose signals are aggregated in columns of their own.
FEW = 63


def feature_metric(w: np.ndarray) -> np.ndarray:
    """The metric on factors (last axis) that a change of basis leaves as it is: (..., 6, 6)."""
    a, b, c, f = w[..., 0], w[..., 1], w[..., 2], w[..., 5]
    h = np.zeros((*w.shape[:-1], 6, 6))
    for n, x in enumerate((a, b, c)):
        h[..., n, n] = 1 / (x * x)
    h[..., 3, 3] = 2 * a * (1 / b + f * f / c)
    h[..., 4, 4] = 2 * a / c
    h[..., 5, 5] = 2 * b / c
    h[..., 3, 4] = h[..., 4, 3] = -2 * a * f / c
    return h


def metric_slopes(w: np.ndarray) -> np.ndarray:
    """Derivatives of the metric: [..., k, i, j] is that of h[i, j] along factor k."""
    a, b, c, f = w[..., 0], w[..., 1], w[..., 2], w[..., 5]
    d = np.zeros((*w.shape[:-1], 6, 6, 6))
    for n, x in enumerate((a, b, c)):
        d[..., n, n, n] = -2 / x**3
    shear = {0: 2 * (1 / b + f * f / c), 1: -2 * a / b**2, 2: -2 * a * f * f / c**2, 5: 4 * a * f / c}
    mixed = {0: -2 * f / c, 2: 2 * a * f / c**2, 5: -2 * a / c}
    for k, v in shear.items():
        d[..., k, 3, 3] = v
    for k, v in mixed.items():
        d[..., k, 3, 4] = d[..., k, 4, 3] = v
    d[..., 0, 4, 4], d[..., 2, 4, 4] = 2 / c, -2 * a / c**2
    d[..., 1, 5, 5], d[..., 2, 5, 5] = 2 / c, -2 * b / c**2
    return d


def connection(w: np.ndarray) -> np.ndarray:
    """Christoffel symbols [..., i, j, k] of the metric."""
    d = metric_slopes(w)
    lower = (np.einsum("...jlk->...ljk", d) + np.einsum("...kjl->...ljk", d) - d) / 2
    return (np.linalg.inv(feature_metric(w)) @ lower.reshape(*lower.shape[:-2], 36)).reshape(lower.shape)


def _slopes(a: np.ndarray, halo: int, inside: np.ndarray) -> np.ndarray:
    """Next less previous along each axis, [..., axis], without the halo; 0 where either lies outside the image."""
    out = []
    for axis in range(3):
        step = tuple(int(n == axis) for n in range(3))
        back = tuple(-s for s in step)
        both = moved(inside, step, halo) & moved(inside, back, halo)
        out.append((moved(a, step, halo) - moved(a, back, halo)) * both[(..., *[None] * (a.ndim - 3))])
    return np.stack(out, -1)


def regular_kernel(w: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The gradient of the regulariser (six factors) and the determinant of the induced metric; the halo is two voxels."""
    valid = inside[(..., *[None] * (w.ndim - 4))] & (w[..., :3] > 0).all(-1)
    safe = np.where(valid[..., None], w, np.array([1.0, 1, 1, 0, 0, 0]))
    slope = _slopes(w, 1, inside)  # one voxel of halo is left
    near, known = moved(safe, (0, 0, 0), 1), moved(valid, (0, 0, 0), 1)
    induced = np.eye(3) + slope.swapaxes(-1, -2) @ feature_metric(near) @ slope
    determinant = np.where(known, np.linalg.det(induced), 0)
    usable = known & np.isfinite(determinant) & (determinant > 0)
    inverse = np.linalg.inv(np.where(usable[..., None, None], induced, np.eye(3)))
    flow = np.einsum("...mn,...in->...mi", inverse, slope) * np.sqrt(np.where(usable, determinant, 0))[..., None, None]
    both = slope @ inverse @ slope.swapaxes(-1, -2)
    curved = np.einsum("...ijk,...jk->...i", connection(near), both) * usable[..., None]
    here = moved(inside, (0, 0, 0), 1)
    root = np.sqrt(np.where(usable, determinant, np.inf))
    total = moved(curved, (0, 0, 0), 1)
    for axis in range(3):
        total = total + _slopes(flow[..., axis, :], 1, here)[..., axis] / moved(root, (0, 0, 0), 1)[..., None]
    return _filled(np.concatenate([np.where(moved(usable, (0, 0, 0), 1)[..., None], total, 0), moved(np.where(usable, determinant, 0), (0, 0, 0), 1)[..., None]], -1), 2)


def long_factors(t: DataFrame) -> DataFrame:
    """Tensors of voxels as a long table of factors: t from 0 to 5."""
    f = tensor.to_factors(t)
    return f.select(*VOXEL, F.posexplode(F.array(*[F.col(f"w{n}") for n in range(1, 7)])).alias("t", "value"))


def regulariser(factors: DataFrame, shape: dict[str, int], block: int = 32) -> DataFrame:
    """Gradient of the regulariser in each voxel with factors (t from 0 to 5), and the determinant of the induced metric (t = 6)."""
    out = by_blocks(factors, shape | {"t": 6}, 2, regular_kernel, block, "constant")
    return out.join(factors.select(VOXEL).distinct(), VOXEL, "left_semi")


def factor_jacobian(w: np.ndarray) -> np.ndarray:
    """Derivatives of xx, xy, yy, xz, yz, zz (rows) along the factors (columns)."""
    a, b, d, e, f = w[..., 0], w[..., 1], w[..., 3], w[..., 4], w[..., 5]
    j = np.zeros((*w.shape[:-1], 6, 6))
    for row, terms in enumerate(({0: 1}, {0: d, 3: a}, {0: d * d, 1: 1, 3: 2 * a * d}, {0: e, 4: a}, {0: d * e, 1: f, 3: a * e, 4: a * d, 5: b}, {0: e * e, 1: f * f, 2: 1, 4: 2 * a * e, 5: 2 * b * f})):
        for column, value in terms.items():
            j[..., row, column] = value
    return j


def factors_to_tensor(w: np.ndarray) -> np.ndarray:
    a, b, c, d, e, f = np.moveaxis(w, -1, 0)
    return np.stack([a, a * d, b + a * d * d, a * e, a * d * e + b * f, c + a * e * e + b * f * f], -1)


def data_slope(w: np.ndarray, signal: np.ndarray, x: np.ndarray, bvals: np.ndarray, fraction: np.ndarray, water: float = 3e-3) -> np.ndarray:
    """Gradient along the factors of half the squared error of the two-compartment model, for a tissue fraction as given but for its factor."""
    tissue = np.exp(factors_to_tensor(w) @ x.T)
    error = fraction[..., None] * tissue + (1 - fraction)[..., None] * np.exp(-bvals * water) - signal
    return np.einsum("...p,...pq->...q", (error * tissue) @ x, factor_jacobian(w))


def regularised(voxels: DataFrame, bvals: list[float], bvecs: list[list[float]], shape: dict[str, int], steps: int = 10, weight: float = 1e-3, step_size: float = 1e-7, low: float = 1e-4, block: int = 32) -> DataFrame:
    """Descent on data and regulariser together.

    ``voxels`` has subject, i, j, k, signal (by b0, without b = 0), fraction (of
    tissue, held fixed) and xx to zz. Each step exchanges halos once and is
    written. Scales are held at ``low`` or more. Returns the voxel and xx to zz.
    """
    x = kernels.design_matrix(np.array(bvals, float), np.array(bvecs, float))[:, :6]
    b = np.array(bvals, float)
    names = [f"w{n}" for n in range(1, 7)]
    fixed = voxels.select(*VOXEL, "signal", "fraction")
    field = cut(tensor.to_factors(voxels.select(*VOXEL, *tensor.TENSOR)))
    kind = dict(voxels.dtypes)["subject"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            w = np.column_stack([batch.column(n).to_numpy() for n in names])
            g = kernels._matrix(batch, "slope")
            s, f = kernels._matrix(batch, "signal"), batch.column("fraction").to_numpy()
            new = w - step_size * (np.nan_to_num(data_slope(w, s, x, b, f)) - weight * np.nan_to_num(g))
            new[:, :3] = np.maximum(new[:, :3], low)
            yield pa.RecordBatch.from_arrays([*[batch.column(v) for v in VOXEL], *[pa.array(np.ascontiguousarray(new[:, n])) for n in range(6)]], names=[*VOXEL, *names])

    for _ in range(steps):
        long = field.select(*VOXEL, F.posexplode(F.array(*names)).alias("t", "value"))
        slope = regulariser(long, shape, block).where("t < 6").groupBy(*VOXEL).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s")).select(*VOXEL, F.col("s.value").alias("slope"))
        field = cut(field.join(slope, VOXEL).join(fixed, VOXEL).mapInArrow(run, f"subject {kind}, i int, j int, k int, " + ", ".join(f"{n} double" for n in names)))
    return tensor.from_factors(field)


def initial_fraction(voxels: DataFrame, b: float, wm_b0: str, csf_b0: str, lmin: float = 1e-4, lmax: float = 2.5e-3, md: float = 6e-4, water: float = 3e-3, interpolate: bool = True) -> DataFrame:
    """Adds ``fraction``, the first estimate of tissue, from b0, the least and greatest attenuation (low, high) and md.

    The estimate from the b = 0 signal is held between those that the bounds of
    diffusivity allow, then mixed with that from the mean diffusivity, the more
    the higher it is.
    """
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    decay = F.exp(F.lit(-b * water))
    bound = lambda s, d: clip((F.col(s) - decay) / (F.exp(F.lit(-b * d)) - decay), 0.0, 1.0)
    alpha = clip(1 - F.log(F.col("b0") / F.col(wm_b0) + 1e-12) / F.log(F.col(csf_b0) / F.col(wm_b0)), 0.0, 1.0)
    by_md = clip((F.exp(-b * F.col("md")) - decay) / (F.exp(F.lit(-b * md)) - decay), 0.01, 0.99)
    # Where the bounds cross, the upper one holds.
    held = F.least(F.greatest(F.col("alpha"), bound("high", lmin)), bound("low", lmax))
    mixed = F.pow(held, 1 - F.col("alpha")) * F.pow(by_md, F.col("alpha")) if interpolate else held
    out = voxels.withColumn("alpha", alpha).withColumn("fraction", mixed)
    return out.withColumn("fraction", F.when(F.col("fraction").isNull() | F.isnan("fraction"), 0.5).otherwise(clip(F.col("fraction"), 0.05, 0.99))).drop("alpha")


def packed_signals(dwi: DataFrame, n: int) -> DataFrame:
    """Each voxel's signals of volumes 0 to n - 1 as one array, from (subject, i, j, k, t, value).

    A volume without a row, or with a null, is 0; volumes beyond are left out.
    Rows that repeat a voxel's volume, or have none, raise an error.
    """
    t, value = F.col("t").cast("int"), F.col("value").cast("double")
    if n > FEW:
        packed = dwi.groupBy(*VOXEL).agg(F.map_from_entries(F.collect_list(F.struct(t.alias("t"), value.alias("value")))).alias("m"))
        return packed.select(*VOXEL, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.coalesce(F.col("m")[t], F.lit(0.0))).alias("signal"))
    # Sums of fixed size are aggregated by hash, without a sort and an object for every voxel.
    within = t.between(0, n - 1)
    bit = F.when(within, F.call_function("shiftleft", F.lit(1).cast("long"), t))
    packed = dwi.groupBy(*VOXEL).agg(*[F.max(F.when(t == k, value)).alias(f"s{k}") for k in range(n)], F.count(F.when(within | t.isNull(), 1)).alias("rows"), F.bit_or(bit).alias("seen"))
    single = F.col("rows") == F.coalesce(F.bit_count("seen"), F.lit(0))
    signal = F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) for k in range(n)])
    return packed.select(*VOXEL, F.when(single, signal).otherwise(F.raise_error(F.lit("rows repeat a volume of a voxel, or have none"))).alias("signal"))


def run_fernet(dwi: DataFrame, brain: DataFrame, bvals: list[float], bvecs: list[list[float]], erode: int = 8, fa_above: float = 0.7, trace_above: float = 0.0085, wm_percentile: float = 5, csf_percentile: float = 95, exclude: DataFrame | None = None, steps: int = 50, weight: float = 100.0, step_size: float = 1e-7) -> DataFrame:
    """From (subject, i, j, k, t, value) and a mask to the corrected maps, one row per voxel of the mask.

    Tissue references are percentiles of the b = 0 signal in each subject's
    white matter and fluid; a subject without either has no rows. Returns the
    voxel, init_fraction, free_water, xx to zz and fa, tr, ax, rad of the
    corrected tensor, and difference_fa.

    Signals are packed and fitted once and written in the shared folder: the
    references of a subject need all its voxels before any can be corrected.
    """
    n = len(bvals)
    zero, weighted = [t for t in range(n) if bvals[t] == 0], [t for t in range(n) if bvals[t] > 0]
    # Kernels know a voxel by one number.
    number = ((F.col("i").cast("long") * 2**20 + F.col("j")) * 2**20 + F.col("k")).alias("voxel")
    place = {"i": F.shiftright("voxel", 40).cast("int"), "j": (F.shiftright("voxel", 20) % 2**20).cast("int"), "k": (F.col("voxel") % 2**20).cast("int")}
    packed = packed_signals(dwi, n).join(brain.where("value > 0").select(VOXEL), VOXEL, "left_semi").select("subject", number, "signal")
    plain = tensor.scalars(kernels.fit_tensors(spread(packed, "subject", "voxel"), bvals, bvecs, keep=("signal",)))
    b0 = sum((F.col("signal")[t] for t in zero), F.lit(0.0)) / len(zero)
    ratio = lambda t: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce(F.try_divide(F.col("signal")[t], F.col("b0")), F.lit(1e-6))))
    based = written(plain.withColumn("b0", b0).select("subject", "voxel", "b0", "fa", "md", "tr", F.array(*map(ratio, weighted)).alias("signal")))
    # Tissue as by images.tissue_rois, but for the mask itself, which all these voxels lie in.
    white, fluid = F.col("fa") > fa_above, F.col("tr") > trace_above
    marked = based.where(white | fluid).withColumns(place)
    if erode:
        marked = marked.join(images.erode(brain, "NN1", erode).select(VOXEL), VOXEL, "left_semi")
    if exclude is not None:
        marked = marked.join(exclude.where("value <> 0").select(VOXEL), VOXEL, "left_anti")
    near = lambda roi, p: F.percentile(F.when(roi, F.col("b0")), F.lit(p / 100))
    # Written too, so that its size is known: where it is small, voxels needn't be shuffled to meet it.
    levels = written(marked.groupBy("subject").agg(near(white, wm_percentile).alias("wm_b0"), near(fluid, csf_percentile).alias("csf_b0")).where("wm_b0 is not null and csf_b0 is not null"))
    ready = based.join(levels, "subject").withColumn("low", F.array_min("signal")).withColumn("high", F.array_max("signal"))
    b_weighted, v_weighted = [float(bvals[t]) for t in weighted], [bvecs[t] for t in weighted]
    start = initial_fraction(ready, max(b_weighted), "wm_b0", "csf_b0").select("subject", "voxel", "signal", "fraction", F.col("fa").alias("plain_fa"))
    # The descent holds eigenvalues within its bounds before its first step.
    final = kernels.free_water(start, b_weighted, v_weighted, steps, weight, step_size, keep=("fraction", "plain_fa"))
    out = tensor.scalars(final.withColumn("corrected", F.struct(*tensor.TENSOR)))
    return out.withColumns(place).select(*VOXEL, F.col("fraction").alias("init_fraction"), "free_water", *[F.col(f"corrected.{c}").alias(c) for c in tensor.TENSOR], "fa", "tr", "ax", "rad", (F.col("fa") - F.col("plain_fa")).alias("difference_fa"))
