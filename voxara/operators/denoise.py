"""Denoising of volumes: noise levels, non-local means, local principal components, Gibbs ringing.

Long tables (subject, i, j, k, t, value); neighbourhoods come as blocks with
halos, slices and voxels as groups. A voxel without a row counts as 0.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.batches import by_groups, scattered
from voxara.operators.slabs import AXES, CELLS, _filled, box_sums, by_blocks, moved, one_by_one

VOXEL = ["subject", *AXES]


def magnitude_variance(coils: int) -> float:
    """Variance of pure noise of so many coils, as a share of the variance in one channel; 1 for Gaussian noise (0 coils)."""
    return 1.0 if coils == 0 else 2 * coils - 2 * math.exp(2 * (math.lgamma(coils + 0.5) - math.lgamma(coils)))


def noise_sigma(img: DataFrame, shape: dict[str, int], coils: int = 0) -> DataFrame:
    """Deviation of the noise in each volume, from the difference of voxels and their six neighbours.

    Voxels that are 0 in the first volume don't count. Neighbours beyond the
    image are the voxels at its border. One shuffle by voxel: each value goes to
    its neighbours. Returns subject, t, sigma.
    """
    steps = [(a, d) for a in AXES for d in (-1, 1)]
    # A voxel at a border is its own neighbour there: its value comes back in place of one from outside.
    spread = [F.struct(*[F.lit(d if a == b else 0).alias(b) for b in AXES], F.lit(0.0).alias("own"), F.lit(1.0).alias("near")) for a, d in steps]
    edge = sum(((F.col(a) == 0).cast("double") + (F.col(a) == shape[a] - 1).cast("double") for a in AXES), F.lit(0.0))
    own = F.struct(*[F.lit(0).alias(b) for b in AXES], F.lit(1.0).alias("own"), edge.alias("near"))
    sent = scattered(img, *VOXEL, "t").select(*VOXEL, "t", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.explode(F.array(own, *spread)).alias("d"))
    sent = sent.select("subject", *[(F.col(a) + F.col(f"d.{a}")).cast("int").alias(a) for a in AXES], "t", (F.col("value") * F.col("d.own")).alias("own"), (F.col("value") * F.col("d.near")).alias("near"))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(0, shape[a] - 1)
    summed = sent.where(inside).groupBy(*VOXEL, "t").agg(F.sum("own").alias("own"), F.sum("near").alias("near"))
    # Every voxel of the first volume counts in all volumes, where it has no row and no neighbour as a difference of 0.
    first = img.where("t = 0 and value <> 0").select(VOXEL)
    sizes = first.groupBy("subject").agg(F.count("*").alias("n"))
    gaps = summed.join(first, VOXEL, "left_semi").groupBy("subject", "t").agg(F.sum(F.pow(F.col("own") - F.col("near") / 6, 2) * (6 / 7)).alias("s"))
    return gaps.join(sizes, "subject").select("subject", "t", F.sqrt(F.col("s") / F.col("n") / magnitude_variance(coils)).alias("sigma"))


def nlmeans_kernel(a: np.ndarray, sigma: float | np.ndarray, patch: int, reach: int, rician: bool) -> np.ndarray:
    """Means over voxels within ``reach - patch``, weighted by the likeness of their patches; sums over patches by running sums."""
    far = reach - patch
    here = moved(a, (0, 0, 0), far)  # with what the patches need around the inner part
    total = np.zeros(tuple(n - 2 * reach for n in a.shape[:3]) + a.shape[3:])
    squares = np.zeros_like(total)
    scale = math.sqrt(2) * np.square(sigma) * (2 * patch + 1) ** 3
    for step in itertools.product(range(-far, far + 1), repeat=3):
        gap = here - moved(a, step, far)
        w = np.exp(-box_sums(gap * gap, 2 * patch + 1) / scale)
        x = moved(a, step, reach)
        total += w
        squares += w * x * x
    mean = squares / np.maximum(total, 1e-300)
    return np.sqrt(np.maximum(mean - (2 * np.square(sigma) if rician else 0), 0))


def nlmeans(img: DataFrame, shape: dict[str, int], sigma: float | list[float], patch: int = 1, reach: int = 5, rician: bool = True, mask: DataFrame | None = None, block: int = 32) -> DataFrame:
    """Non-local means of every volume, with one deviation of noise for all or one for each volume.

    The image is mirrored at its borders. Voxels outside the mask (value above
    0) come out as 0; without a mask all count.
    """
    level = np.asarray(sigma, float)
    if not (level > 0).all():
        raise ValueError("sigma must be positive")
    out = by_blocks(img, shape, reach, lambda a, inside: _filled(nlmeans_kernel(a, level, patch, reach, rician), reach), block)
    if mask is None:
        return out
    kept = mask.where("value > 0").select(*VOXEL, F.lit(True).alias("kept"))
    return out.join(kept, VOXEL, "left").withColumn("value", F.when(F.col("kept"), F.col("value")).otherwise(0.0)).drop("kept")


def _noise_edge(values: np.ndarray, samples: int) -> np.ndarray:
    """Variance of the noise for rows of rising eigenvalues: the largest set that a Marchenko-Pastur spectrum may hold."""
    values = values[:, -(samples - 1) :] if values.shape[1] > samples - 1 else values
    n = values.shape[1]
    running = np.cumsum(values, axis=1) / np.arange(1, n + 1)
    spread = values - values[:, :1] - 4 * np.sqrt(np.arange(1, n + 1) / samples) * running
    # From the top, eigenvalues go while they spread too far: the first that doesn't is the edge.
    fits = spread[:, ::-1] <= 0
    edge = n - 1 - np.argmax(fits, axis=1)
    return running[np.arange(len(values)), np.where(fits.any(1), edge, 0)]


def pca_kernel(a: np.ndarray, inside: np.ndarray, radius: int, tau: float | None, sigma: np.ndarray | None = None) -> np.ndarray:
    """Every whole patch loses the components below the noise; a voxel's patches are averaged, those of few components weighing more."""
    width, n_t = 2 * radius + 1, a.shape[3]
    samples = width**3
    factor = 1 + math.sqrt(n_t / samples) if tau is None else tau
    total, weight = np.zeros_like(a), np.zeros(a.shape[:3])
    windows = np.lib.stride_tricks.sliding_window_view(a, (width,) * 3, axis=(0, 1, 2))
    whole = np.lib.stride_tricks.sliding_window_view(inside, (width,) * 3, axis=(0, 1, 2)).all((3, 4, 5))
    for i in range(whole.shape[0]):
        at = np.argwhere(whole[i])
        for start in range(0, len(at), 256):
            j, k = at[start : start + 256].T
            x = windows[i, j, k].reshape(len(j), n_t, samples)
            mean = x.mean(2, keepdims=True)
            x = x - mean
            values, vectors = np.linalg.eigh(x @ x.transpose(0, 2, 1) / samples)
            noise = _noise_edge(values, samples) if sigma is None else np.square(sigma[i + radius, j + radius, k + radius])
            signal = values >= (factor * factor * noise)[:, None]
            kept = vectors * signal[:, None, :]
            x = kept @ (kept.transpose(0, 2, 1) @ x) + mean
            share = 1.0 / (1 + signal.sum(1))
            x = (x * share[:, None, None]).transpose(0, 2, 1).reshape(len(j), width, width, width, n_t)
            for d in itertools.product(range(width), repeat=3):
                place = (np.full(len(j), i + d[0]), j + d[1], k + d[2])
                total[place] += x[:, d[0], d[1], d[2]]  # no two patches of a batch have the same voxel at the same place
                weight[place] += share
    return np.maximum(np.where(weight[..., None] > 0, total / np.maximum(weight, 1e-300)[..., None], a), 0)


def mppca(img: DataFrame, shape: dict[str, int], radius: int = 2, block: int = 16) -> DataFrame:
    """Local principal components, the noise taken from each patch's own spectrum. Values come out as 0 or more.

    Images too small for a whole patch stay as they are.
    """
    return by_blocks(img, shape, 2 * radius, one_by_one(lambda a, inside: pca_kernel(a, inside, radius, None)), block, "constant")


def lpca(img: DataFrame, sigma: DataFrame, shape: dict[str, int], radius: int = 2, tau: float = 2.3, block: int = 16) -> DataFrame:
    """Local principal components below ``tau`` deviations of the noise go; ``sigma`` is a map of it (subject, i, j, k, value)."""
    joined = img.join(sigma.select(*VOXEL, F.col("value").alias("sigma")), VOXEL, "left")
    return by_blocks(joined, shape, 2 * radius, one_by_one(lambda a, inside, sigma: pca_kernel(a, inside, radius, tau, sigma)), block, "constant", ("sigma",))


def _least_component(img: DataFrame, shape: dict[str, int]) -> DataFrame:
    """Each voxel's part along the volumes' direction of least variance: (subject, i, j, k, value)."""
    n = shape["i"] * shape["j"] * shape["k"]
    packed = img.groupBy(*VOXEL).agg(F.collect_list(F.struct("t", F.col("value").cast("double").alias("v"))).alias("x"))
    pairs = packed.select("subject", F.explode("x").alias("a"), "x").select("subject", F.col("a.t").alias("a"), F.col("a.v").alias("v"), F.explode("x").alias("b"))
    products = pairs.where("a <= b.t").groupBy("subject", "a", F.col("b.t").alias("b")).agg(F.sum(F.col("v") * F.col("b.v")).alias("s"))
    sums = img.groupBy("subject", F.col("t").alias("a")).agg(F.sum("value").alias("s")).withColumn("b", F.lit(-1))
    n_t = shape["t"]

    def least(key: tuple, rows: pa.Table) -> pa.Table:
        a, b, s = (rows.column(c).to_numpy() for c in ("a", "b", "s"))
        mean, cross = np.zeros(n_t), np.zeros((n_t, n_t))
        mean[a[b < 0]] = s[b < 0] / n
        cross[a[b >= 0], b[b >= 0]] = s[b >= 0] / n
        cross = np.triu(cross) + np.triu(cross, 1).T - np.outer(mean, mean)
        _, vectors = np.linalg.eigh(cross)
        w = vectors[:, 0]
        w = w * np.sign(w[np.abs(w).argmax()])
        return pa.table([pa.array([key[0].as_py()] * n_t, key[0].type), pa.array(np.arange(n_t, dtype=np.int32)), pa.array(w), pa.array([float(mean @ w)] * n_t)], names=["subject", "t", "w", "shift"])

    kind = dict(img.dtypes)["subject"]
    table = sums.select("subject", "a", "b", "s").unionByName(products.select("subject", "a", "b", "s"))
    directions = table.groupBy("subject").applyInArrow(least, f"subject {kind}, t int, w double, shift double")
    part = img.join(directions, ["subject", "t"]).groupBy(*VOXEL).agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    shifts = directions.select("subject", "shift").distinct()
    # The shift is that of every voxel, those without a row too; local differences don't see it, the border of the sparse part does.
    return part.join(shifts, "subject").select(*VOXEL, (F.col("s") - F.col("shift")).alias("value"))


def _bessel_scaled(order: int, x: np.ndarray) -> np.ndarray:
    """exp(-x) I(x) of order 0 or 1, by the trapezoid rule on its integral, which converges as fast as any power."""
    angle = np.linspace(0, np.pi, 257)
    f = np.exp(x[..., None] * (np.cos(angle) - 1)) * (np.cos(angle) if order else 1)
    return (f[..., :-1] + f[..., 1:]).mean(-1) / 2


def rician_bias(snr: np.ndarray) -> np.ndarray:
    """Variance of a magnitude as a share of the channel's, by signal to noise; 1 where that is high."""
    s = np.minimum(snr, 37.4) ** 2
    inner = (2 + s) * _bessel_scaled(0, s / 4) + s * _bessel_scaled(1, s / 4)
    return np.where(snr > 37.4, 1.0, 2 + s - np.pi / 8 * inner**2)


def pca_noise_map(img: DataFrame, shape: dict[str, int], volumes: list[int] | None = None, correct_bias: bool = True, smooth: float | None = 3.0, block: int = 32) -> DataFrame:
    """Local deviation of the noise: that of the volumes' least component among neighbours.

    ``volumes`` are those to look at (those without weighting, where there are
    several); all by default. The least component is found from sums over the
    whole image. Returns subject, i, j, k, value.
    """
    chosen = img if volumes is None else img.where(F.col("t").isin(volumes))
    renumbered = {t: n for n, t in enumerate(sorted(volumes))} if volumes is not None else None
    if renumbered is not None:
        chosen = chosen.withColumn("t", F.create_map(*[F.lit(x).cast("int") for p in renumbered.items() for x in p])[F.col("t").cast("int")])
    shape3 = {a: shape[a] for a in AXES}
    least = _least_component(chosen, shape3 | {"t": len(volumes) if volumes is not None else shape["t"]})
    level = chosen.groupBy(*VOXEL).agg((F.sum("value") / (len(volumes) if volumes is not None else shape["t"])).alias("mean"))
    joined = least.join(level, VOXEL)

    def kernel(a: np.ndarray, inside: np.ndarray, mean: np.ndarray) -> np.ndarray:
        # Whole neighbourhoods have a mean; a voxel's variance is that about the means of those that hold it.
        whole = box_sums(inside.astype(float), 3) > 26.5
        centre, height = box_sums(a, 3) / 27, box_sums(mean, 3) / 27
        x = a[2:-2, 2:-2, 2:-2]
        count, square, tall = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape)
        for d in itertools.product((-1, 0, 1), repeat=3):
            ok = moved(whole, d, 1)
            count += ok
            square += np.where(ok, (x - moved(centre, d, 1)) ** 2, 0)
            tall += np.where(ok, moved(height, d, 1), 0)
        variance = square / np.maximum(count, 1)
        if correct_bias:
            with np.errstate(divide="ignore", invalid="ignore"):
                snr = np.where(variance > 0, tall / np.maximum(count, 1) / np.sqrt(np.maximum(variance, 1e-300)), np.inf)
            variance = variance / rician_bias(np.maximum(snr, 0))
        return _filled(variance, 2)

    variance = by_blocks(joined, shape3, 2, one_by_one(kernel), block, "constant", ("mean",))
    if smooth is not None:
        reach = int(4 * smooth + 0.5)
        weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * smooth * smooth))
        weights /= weights.sum()

        def blur(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
            for axis in range(3):
                a = np.apply_along_axis(np.convolve, axis, a, weights, "valid")
            return _filled(a, reach)

        variance = by_blocks(variance, shape3, reach, blur, block, "symmetric")
    return variance.withColumn("value", F.sqrt(F.greatest(F.col("value"), F.lit(0.0))))


def _variation(x: np.ndarray, n: int) -> np.ndarray:
    """The lesser of the total variations over n differences before and after each place along the last axis, the line taken as a ring."""
    gap = np.abs(np.roll(x, 1, -1) - x)
    before = sum(np.roll(gap, m, -1) for m in range(n))
    after = sum(np.roll(gap, -m - 1, -1) for m in range(n))
    return np.minimum(before, after)


def _unrung_lines(x: np.ndarray, n_points: int, shifts: np.ndarray) -> np.ndarray:
    """Lines (last axis) taken at the sub-voxel shifts with the least variation around, and interpolated back."""
    best = [_variation(x, n_points) for _ in range(2)]
    value, shift = [x.copy(), x.copy()], [np.zeros(x.shape), np.zeros(x.shape)]
    spectrum, frequency = np.fft.fft(x, axis=-1), np.fft.fftfreq(x.shape[-1])
    if x.shape[-1] % 2 == 0:
        spectrum[..., x.shape[-1] // 2] = 0  # it has no sub-voxel shift of its own
    for s in shifts:
        for side, sign in enumerate((1, -1)):
            y = np.abs(np.fft.ifft(spectrum * np.exp(2j * np.pi * sign * s * frequency), axis=-1))
            v = _variation(y, n_points)
            lower = v < best[side]
            best[side] = np.where(lower, v, best[side])
            value[side] = np.where(lower, y, value[side])
            shift[side] = np.where(lower, s, shift[side])
    way = shift[0] + shift[1]
    between = (value[0] - value[1]) / np.where(way > 0, way, 1) * shift[1] + value[1]
    return np.where(way > 0, between, x)


def unring_slices(x: np.ndarray, n_points: int = 3, steps: int = 45) -> np.ndarray:
    """Slices (the last two axes) without ringing: both directions, each where the other's frequencies are low."""
    shifts = np.linspace(0.02, 0.9, steps)
    rows = _unrung_lines(x, n_points, shifts)
    columns = _unrung_lines(x.swapaxes(-1, -2), n_points, shifts).swapaxes(-1, -2)
    a = 1 + np.cos(2 * np.pi * np.fft.fftfreq(x.shape[-2]))[:, None]
    b = 1 + np.cos(2 * np.pi * np.fft.fftfreq(x.shape[-1]))[None, :]
    both = a + b
    share = np.where(both > 1e-12, a / np.maximum(both, 1e-12), 0.5)  # of the frequencies along the last axis
    return np.abs(np.fft.ifft2(np.fft.fft2(rows) * share + np.fft.fft2(columns) * (1 - share)))


def unring(img: DataFrame, shape: dict[str, int], axis: str = "k", n_points: int = 3, steps: int = 45) -> DataFrame:
    """Gibbs ringing taken out of every slice across ``axis``, by sub-voxel shifts of least local variation.

    A slice of a volume is the unit of work; small ones go many at a time. Slices without any voxel have no rows.
    """
    plane = [a for a in AXES if a != axis]
    if len(plane) != 2:
        raise ValueError(f"not an axis: {axis}")
    keys = ["subject", axis, *(["t"] if "t" in img.columns else [])]

    size = shape[plane[0]] * shape[plane[1]]

    def run(rows: pa.Table, which: np.ndarray, first: np.ndarray) -> pa.Table:
        x = np.zeros((len(first), *[shape[a] for a in plane]))
        x[(which, *[rows.column(a).to_numpy() for a in plane])] = rows.column("value").to_numpy()
        out = unring_slices(x, n_points, steps)
        grid = np.indices(out.shape).reshape(3, -1).astype(np.int32)
        fixed = rows.select(keys).take(pa.array(np.repeat(first, size)))
        return pa.table([*fixed.columns, *[pa.array(g) for g in grid[1:]], pa.array(out.ravel())], names=[*keys, *plane, "value"])

    kind = dict(img.dtypes)["subject"]
    schema = f"subject {kind}, " + ", ".join(f"{c} int" for c in [*keys[1:], *plane]) + ", value double"
    typed = img.select("subject", *[F.col(c).cast("int").alias(c) for c in [*keys[1:], *plane]], F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return by_groups(typed, keys, run, schema, max(1, CELLS // size))


#: The quantile of the noise that estimates its level best, by coils; the median for other numbers.
BEST_QUANTILE = {1: 0.79681213002002, 2: 0.7306303027491917, 4: 0.6721952960782169, 8: 0.6254030432343569, 16: 0.5900487123737876, 32: 0.5641772300866416, 64: 0.5455611840489607, 128: 0.5322811923303339}


def gamma_quantile(shape: float, p: float) -> float:
    """The p-quantile of the gamma distribution of scale 1, by halving on the series of its distribution."""

    def below(x: float) -> float:
        term = total = 1 / shape
        n = shape
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + shape * math.log(x) - math.lgamma(shape)) if x > 0 else 0.0

    low, high = 0.0, shape + 10 * math.sqrt(shape) + 50
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def _run_quantiles(x: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, q: float) -> np.ndarray:
    """np.quantile of the values of the rows low to high of x[which], for many runs at once."""
    out, cells = np.empty(len(which)), x.shape[1] * x.shape[2]
    for at in range(0, len(which), max(1, CELLS // cells)):
        part = slice(at, at + max(1, CELLS // cells))
        if cells > CELLS:
            out[part] = np.quantile(x[which[at], low[at] : high[at]], q)
            continue
        rows = np.arange(x.shape[1])
        inside = (rows >= low[part, None]) & (rows < high[part, None])
        values = np.sort(np.where(inside[..., None], x[which[part]], np.inf).reshape(len(which[part]), -1), axis=1)
        place = ((high[part] - low[part]) * x.shape[2] - 1) * q
        below = np.floor(place).astype(np.int64)
        each = np.arange(len(values))
        a, b = values[each, below], values[each, np.minimum(below + 1, (high[part] - low[part]) * x.shape[2] - 1)]
        t = place - below
        out[part] = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)
    return out


def slice_noise(x: np.ndarray, coils: int = 1, alpha: float = 0.01, starts: int = 50, rounds: int = 100, eps: float = 1e-5) -> float:
    """Noise deviation of a slice (voxels by volumes): the fixed point that marks the most voxels as noise alone."""
    return float(slices_noise(x[None], coils, alpha, starts, rounds, eps)[0])


def slices_noise(x: np.ndarray, coils: int = 1, alpha: float = 0.01, starts: int = 50, rounds: int = 100, eps: float = 1e-5) -> np.ndarray:
    """Noise deviations of slices (slices by voxels by volumes).

    From each of the starting levels, of all slices at once: voxels whose mean
    square fits the level are noise; a quantile of their values is the next
    level. The levels that stop first with the most voxels are the results.
    """
    quantile, n = BEST_QUANTILE.get(coils, 0.5), x.shape[2]
    scale = math.sqrt(2 * gamma_quantile(coils, quantile))
    low, high = (gamma_quantile(coils * n, p) / n for p in (alpha / 2, 1 - alpha / 2))
    squares = (x * x).sum(2) / (2 * n)
    top = np.quantile(x.reshape(len(x), -1), quantile, axis=1) / scale
    order = np.argsort(squares, axis=1, kind="stable")
    squares, x = np.take_along_axis(squares, order, 1), np.take_along_axis(x, order[..., None], 1)
    level = (np.arange(1, starts + 1) * top[:, None] / starts).ravel()
    of = np.repeat(np.arange(len(x)), starts)
    before, size = np.zeros(len(level)), np.zeros(len(level), np.int64)
    left = np.arange(len(level))
    for _ in range(rounds):
        left = left[np.abs(level[left] - before[left]) >= eps]
        if not len(left):
            break
        # Sorted by mean square, what fits a level is a run.
        a, b = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
        ends = np.flatnonzero(np.append(of[left][1:] != of[left][:-1], True)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            held, levels = squares[of[left[start]]], level[left[start:end]] ** 2
            a[start:end], b[start:end] = np.searchsorted(held, low * levels, "left"), np.searchsorted(held, high * levels, "right")
        size[left] = b - a
        some = b > a
        left, a, b = left[some], a[some], b[some]
        if not len(left):
            break
        # Many levels of a slice mark the same run.
        runs, back = np.unique((of[left] * (x.shape[1] + 1) + a) * (x.shape[1] + 1) + b, return_index=True, return_inverse=True)[1:]
        found = _run_quantiles(x, of[left][runs], a[runs], b[runs], quantile) / scale
        before[left], level[left] = level[left], found[back.ravel()]
    size, level = size.reshape(len(x), starts), level.reshape(len(x), starts)
    best = size.argmax(1)
    each = np.arange(len(x))
    return np.where(size[each, best] > 0, level[each, best], top)


def piesno(img: DataFrame, shape: dict[str, int], coils: int = 1) -> DataFrame:
    """Noise deviation of every slice across k, from its background: (subject, k, sigma). Small slices go many at a time."""

    def run(rows: pa.Table, which: np.ndarray, first: np.ndarray) -> pa.Table:
        x = np.zeros((len(first), shape["i"], shape["j"], shape["t"]))
        x[(which, *[rows.column(c).to_numpy() for c in ("i", "j", "t")])] = rows.column("value").to_numpy()
        sigma = slices_noise(x.reshape(len(first), -1, shape["t"]), coils)
        return pa.table([*rows.select(["subject", "k"]).take(pa.array(first)).columns, pa.array(sigma)], names=["subject", "k", "sigma"])

    typed = img.select("subject", *[F.col(c).cast("int").alias(c) for c in (*AXES, "t")], F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    most = max(1, CELLS // (shape["i"] * shape["j"] * shape["t"]))
    return by_groups(typed, ["subject", "k"], run, f"subject {dict(img.dtypes)['subject']}, k int, sigma double", most)


def residual(img: DataFrame, denoised: DataFrame) -> DataFrame:
    """What denoising took away, voxel by voxel and volume by volume."""
    keys = [*VOXEL, "t"]
    old, new = img.select(*keys, F.col("value").alias("old")), denoised.select(*keys, F.col("value").alias("new"))
    return old.join(new, keys, "full").select(*keys, (F.coalesce("old", F.lit(0.0)) - F.coalesce("new", F.lit(0.0))).alias("value"))


def slice_axis(kind: str) -> str:
    """The axis that slices of a kind of acquisition (axial, coronal, sagittal) lie across."""
    found = {"a": "k", "c": "j", "s": "i"}.get(kind[:1].lower())
    if found is None:
        raise ValueError(f"not a kind of slice: {kind}")
    return found
