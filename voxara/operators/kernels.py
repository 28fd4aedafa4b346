"""Per-voxel numerical kernels: independent voxels in Arrow batches, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _matrix(b: pa.RecordBatch, column: str) -> np.ndarray:
    c = b.column(column)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64)


def design_matrix(bvals: np.ndarray, bvecs: np.ndarray) -> np.ndarray:
    """Rows of -b times the products of the direction, for xx, xy, yy, xz, yz, zz; and one for the log of b0."""
    x, y, z = bvecs.T
    return np.column_stack([-bvals * c for c in (x * x, 2 * x * y, y * y, 2 * x * z, 2 * y * z, z * z)] + [np.ones(len(bvals))])


def _types(df: DataFrame, columns: tuple[str, ...]) -> str:
    """The columns' part of a schema, to go after others."""
    kinds = dict(df.dtypes)
    return "".join(f", {c} {kinds[c]}" for c in columns)


def fit_tensors(dwi: DataFrame, bvals: list[float], bvecs: list[list[float]], weighted: bool = True, floor: float = 1e-6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tensor of each voxel (subject, voxel, signal array): least squares on the log signal, maybe weighted by its square. The columns ``keep`` stay."""
    x = design_matrix(np.array(bvals, float), np.array(bvecs, float))
    pairs = np.einsum("np,nq->npq", x, x).reshape(len(x), -1)
    names = ["xx", "xy", "yy", "xz", "yz", "zz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.linalg.pinv(x)
        for b in batches:
            log = np.log(np.maximum(_matrix(b, "signal"), floor))
            beta = log @ plain.T
            if weighted:
                w = np.exp(2 * (beta @ x.T))
                w /= w.max(1, keepdims=True)
                normal = (w @ pairs).reshape(-1, x.shape[1], x.shape[1])
                beta = np.linalg.solve(normal + 1e-12 * np.eye(x.shape[1]), ((w * log) @ x)[..., None])[..., 0]
            yield pa.RecordBatch.from_arrays([b.column("subject"), b.column("voxel"), *[pa.array(beta[:, k]) for k in range(6)], *[b.column(c) for c in keep]], names=["subject", "voxel", *names, *keep])

    columns = ["subject", "voxel", "signal", *[c for c in keep if c != "signal"]]
    return dwi.select(*columns).mapInArrow(run, "subject long, voxel long, " + ", ".join(f"{n} double" for n in names) + _types(dwi, keep))


def _descended(x: np.ndarray, s: np.ndarray, w: np.ndarray, beta: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weighted least squares of exp(x beta) against the signals, all voxels at once: damped steps, each voxel with its own damping until it settles."""
    beta, damp = beta.copy(), np.full(len(s), 1e-3)
    cost = (w * (s - np.exp(beta @ x.T)) ** 2).sum(1)
    open_ = np.arange(len(s))
    for _ in range(rounds):
        if not len(open_):
            break
        fit = np.exp(beta[open_] @ x.T)
        pull = np.einsum("vn,np->vp", w[open_] * fit * (s[open_] - fit), x)
        curve = np.einsum("vn,np,nq->vpq", w[open_] * fit * fit, x, x)
        spine = np.einsum("vpp->vp", curve)
        held = curve + damp[open_][:, None, None] * np.einsum("vp,pq->vpq", np.maximum(spine, 1e-12 * spine.max(1, keepdims=True) + 1e-300), np.eye(x.shape[1]))
        step = np.linalg.solve(held, pull[..., None])[..., 0]
        tried = beta[open_] + step
        new = (w[open_] * (s[open_] - np.exp(np.clip(tried @ x.T, -700, 700))) ** 2).sum(1)
        better = new <= cost[open_]
        settled = better & (cost[open_] - new <= 1e-12 * cost[open_]) | (damp[open_] > 1e12)
        beta[open_[better]] = tried[better]
        cost[open_[better]] = new[better]
        damp[open_] = np.where(better, np.maximum(damp[open_] / 10, 1e-12), damp[open_] * 10)
        open_ = open_[~settled]
    return beta


def robust_fits(x: np.ndarray, s: np.ndarray, sigma: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Fits of the signals that leave outliers out, and which signals those are.

    A voxel with no residual beyond three deviations keeps its first fit. The
    others are fitted with Geman-McClure weights, from their residuals' median
    deviation, until they settle; what is then beyond three deviations goes, and
    the rest is fitted with equal weights.
    """
    log = np.log(np.maximum(s, 1e-6))
    start = log @ np.linalg.pinv(x).T
    beta = _descended(x, s, np.ones_like(s), start)
    gap = s - np.exp(beta @ x.T)
    out = np.zeros(s.shape, bool)
    odd = np.flatnonzero((np.abs(gap) > 3 * sigma[:, None]).any(1))
    active = odd
    for _ in range(rounds):
        if not len(active):
            break
        r = s[active] - np.exp(beta[active] @ x.T)
        spread = 1.4826 * np.median(np.abs(r - np.median(r, axis=1, keepdims=True)), axis=1)
        w = 1 / (np.maximum(spread, 1e-6 * np.abs(s[active]).max(1) + 1e-300)[:, None] ** 2 + r * r)
        new = _descended(x, s[active], w / w.max(1, keepdims=True), beta[active])
        still = np.abs(new - beta[active]).max(1) > 1e-8 * np.abs(beta[active]).max(1)
        beta[active] = new
        active = active[still]
    if len(odd):
        out[odd] = np.abs(s[odd] - np.exp(beta[odd] @ x.T)) > 3 * sigma[odd][:, None]
        few = (~out[odd]).sum(1) < x.shape[1]  # too few left to fit
        out[odd[few]] = False
        beta[odd] = _descended(x, s[odd], (~out[odd]).astype(float), beta[odd])
    return beta, out


def fit_tensors_nonlinear(dwi: DataFrame, bvals: list[float], bvecs: list[list[float]], sigma: float | None = None) -> DataFrame:
    """Tensor of each voxel (subject, voxel, signal array) by least squares on the signal itself; robust against outliers where ``sigma`` is given.

    ``sigma`` is the deviation of the noise; a column ``sigma`` of ``dwi``, where
    there is one, holds a voxel's own. Signals that are null or not finite count
    as outliers. Returns subject, voxel, xx to zz, s0, outliers.
    """
    x = design_matrix(np.array(bvals, float), np.array(bvecs, float))
    scale = np.r_[np.full(6, 1e-3), 1.0]  # diffusivities as large as the log of the signal
    own = "sigma" in dwi.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _matrix(b, "signal")
            s = np.where(np.isfinite(s), s, 0)
            if own or sigma is not None:
                level = b.column("sigma").to_numpy(zero_copy_only=False).astype(float) if own else np.full(len(s), float(sigma))
                beta, out = robust_fits(x * scale, s, level)
            else:
                beta, out = _descended(x * scale, s, np.ones_like(s), np.log(np.maximum(s, 1e-6)) @ np.linalg.pinv(x * scale).T), np.zeros(s.shape, bool)
            beta = beta * scale
            yield pa.RecordBatch.from_arrays([b.column("subject"), b.column("voxel"), *[pa.array(beta[:, k]) for k in range(6)], pa.array(np.exp(beta[:, 6])), pa.array(out.sum(1).astype(np.int32))], names=["subject", "voxel", "xx", "xy", "yy", "xz", "yz", "zz", "s0", "outliers"])

    columns = ["subject", "voxel", "signal", *(["sigma"] if own else [])]
    return dwi.select(*columns).mapInArrow(run, "subject long, voxel long, xx double, xy double, yy double, xz double, yz double, zz double, s0 double, outliers int")


#: Minors below this part of the tensor's size may be rounding.
MARGIN = 1e-13


def _raised(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tensors (six rows) with their one eigenvalue below 0, or next to it, raised to 0, and where that holds to rounding.

    The eigenvalue is the first root of the characteristic polynomial, by
    Newton's steps from 0, and its projection the adjugate of the tensor less
    it. Tensors with several negative eigenvalues, or with others close to it,
    are left to the caller.
    """
    xx, xy, yy, xz, yz, zz = t
    trace, minors = xx + yy + zz, xx * yy - xy * xy + xx * zz - xz * xz + yy * zz - yz * yz
    whole = xx * (yy * zz - yz * yz) - xy * (xy * zz - xz * yz) + xz * (xy * yz - xz * yy)
    fit = (trace > 0) & (minors > 0) & (whole <= 2 * MARGIN * trace**3)
    root = np.zeros(t.shape[1])
    with np.errstate(all="ignore"):
        for _ in range(12):
            step = (((root - trace) * root + minors) * root - whole) / ((3 * root - 2 * trace) * root + minors)
            root = root - step
            settled = np.abs(step) <= 1e-15 * trace
            if settled[fit].all():
                break
        root = np.minimum(root, 0)
        xx, yy, zz = xx - root, yy - root, zz - root
        adjugate = np.stack([yy * zz - yz * yz, xz * yz - xy * zz, xx * zz - xz * xz, xy * yz - xz * yy, xy * xz - xx * yz, xx * yy - xy * xy])
        gaps = adjugate[0] + adjugate[2] + adjugate[5]
        # The product of the distances to the other two eigenvalues, against their size.
        fit &= settled & (gaps > 0.01 * (trace - root) ** 2)
        return t - adjugate * (root / gaps), fit


def bounded(t: np.ndarray, low: float, high: float) -> np.ndarray:
    """Tensors (xx, xy, yy, xz, yz, zz by rows) with their eigenvalues held between the bounds.

    Tensors within, those whose differences from both bounds have positive
    leading minors beyond rounding, stay as they are. Where a single eigenvalue lies outside,
    it alone is moved; the rest is taken apart.
    """
    xx, xy, yy, xz, yz, zz = t
    # Off the diagonal the difference from the upper bound has the other sign, which only their product feels.
    squares, product = (xy * xy, xz * xz, yz * yz), 2 * xy * xz * yz
    within = []
    for a, c, f, sign in ((xx - low, yy - low, zz - low, 1), (high - xx, high - yy, high - zz, -1)):
        upper = a * c - squares[0]
        whole = f * upper + sign * product - a * squares[2] - c * squares[1]
        size = a + c + f
        within.append((a > 0) & (upper > MARGIN * size**2) & (whole > MARGIN * size**3))
    if within[0].all() and within[1].all():
        return t
    t = t.copy()
    unit = np.array([1.0, 0, 1, 0, 0, 1])[:, None]
    odd = [np.flatnonzero(~(within[0] | within[1]))]
    for at, bound, sign in ((np.flatnonzero(~within[0] & within[1]), low, 1), (np.flatnonzero(within[0] & ~within[1]), high, -1)):
        if len(at):
            raised, fit = _raised(sign * (t[:, at] - bound * unit))
            t[:, at[fit]] = bound * unit + sign * raised[:, fit]
            odd.append(at[~fit])
    odd = np.concatenate(odd)
    if len(odd):
        values, vectors = np.linalg.eigh(t[:, odd].T[:, [0, 1, 3, 1, 2, 4, 3, 4, 5]].reshape(-1, 3, 3))
        m = (vectors * np.clip(values, low, high)[:, None, :]) @ vectors.swapaxes(1, 2)
        t[:, odd] = m.reshape(-1, 9)[:, [0, 1, 4, 2, 5, 8]].T
    return t


def free_water(dwi: DataFrame, bvals: list[float], bvecs: list[list[float]], steps: int = 50, weight: float = 100.0, step_size: float = 1e-7, water: float = 3e-3, low: float = 1e-4, high: float = 2.5e-3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Descent on the two-compartment model from (subject, voxel, signal / b0, fraction, tensor array).

    Each step moves the tissue fraction and the tensor down the squared error,
    and holds the fraction and the eigenvalues within bounds. Without a column
    ``tensor`` the descent starts from least squares on the log of the signal
    less its water. The columns ``keep`` stay.
    """
    b_values = np.array(bvals, float)
    x = np.ascontiguousarray(design_matrix(b_values, np.array(bvecs, float))[:, :6])
    decay = np.exp(-b_values * water)[:, None]
    solve = np.linalg.pinv(x)
    given = "tensor" in dwi.columns

    def descended(s: np.ndarray, f: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, rest = bounded(t, low, high), decay - s
        for _ in range(steps):
            tissue = np.exp(x @ t)
            gap = tissue - decay
            error = f * gap + rest
            tissue *= error
            slope = (x.T @ tissue) * f
            gap *= error
            f = np.clip(f - weight * step_size * (b_values @ gap), 0.01, 0.99)
            if not np.isfinite(slope).all():
                slope = np.nan_to_num(slope, nan=0.0)
            t = t - step_size * slope
            if not np.isfinite(t).all():
                t = np.nan_to_num(t, nan=0.0)
            t = bounded(t, low, high)
        return f, t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.ascontiguousarray(_matrix(b, "signal").T)
            f = b.column("fraction").to_numpy(zero_copy_only=False).astype(float)
            if given:
                t = np.ascontiguousarray(_matrix(b, "tensor").T)
            else:
                t = solve @ np.log(np.clip((s - (1 - f) * decay) / f, 1e-3, 1 - 1e-3))
            f, t = descended(s, f, t)
            yield pa.RecordBatch.from_arrays([b.column("subject"), b.column("voxel"), pa.array(1 - f), *[pa.array(t[k]) for k in range(6)], *[b.column(c) for c in keep]], names=["subject", "voxel", "free_water", "xx", "xy", "yy", "xz", "yz", "zz", *keep])

    columns = list(dict.fromkeys(["subject", "voxel", "signal", "fraction", *(["tensor"] if given else []), *keep]))
    return dwi.select(*columns).mapInArrow(run, "subject long, voxel long, free_water double, xx double, xy double, yy double, xz double, yz double, zz double" + _types(dwi, keep))
