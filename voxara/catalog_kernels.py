"""Queries of kernels over neighbourhoods and voxels, of noise and of tensor fits."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from voxara.lineage import shared_folder
from voxara.operators import denoise, fernet, kernels, slabs, tensor
from voxara.registry import query, rounded
from voxara.sources import images, nifti, tracks

#: The grid of the stand-in series.
GRID = {"i": 6, "j": 6, "k": 5, "t": 4}
_FULL = "(SELECT s.subject, CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CAST(c.range AS INT) AS k, CAST(d.range AS INT) AS t, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT subject FROM {s}) s, range(6) a, range(6) b, range(5) c, range(4) d LEFT JOIN {s} v ON v.subject = s.subject AND v.i = a.range AND v.j = b.range AND v.k = c.range AND v.t = d.range)"


# Blocks with halos.
@query(f"WITH g AS {_FULL} SELECT o.subject, o.i, o.j, o.k, o.t, round(avg(n.value), 8) AS value FROM g o JOIN g n ON o.subject = n.subject AND o.t = n.t AND abs(o.i - n.i) <= 1 AND abs(o.j - n.j) <= 1 AND abs(o.k - n.k) <= 1 GROUP BY 1, 2, 3, 4, 5", s="series")
def series_box_mean(s):
    return rounded(slabs.box_mean(s, GRID, 1, block=4), "value", places=8)


# Noise and denoising: 299-304.
@query(
    f"WITH g AS MATERIALIZED {_FULL}, q AS MATERIALIZED (SELECT g.*, least(greatest(i + a, 0), 5) AS x, least(greatest(j + b, 0), 5) AS y, least(greatest(k + c, 0), 4) AS z FROM g, (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) d(a, b, c)), "
    "n AS (SELECT q.subject, q.i, q.j, q.k, q.t, any_value(q.value) AS own, sum(m.value) AS near FROM q JOIN g m ON m.subject = q.subject AND m.t = q.t AND m.i = q.x AND m.j = q.y AND m.k = q.z GROUP BY 1, 2, 3, 4, 5), "
    "f AS (SELECT subject, i, j, k FROM g WHERE t = 0 AND value <> 0) SELECT subject, t, round(sqrt(avg(pow(own - near / 6, 2) * 6 / 7) / (2 - pi() / 2)), 6) AS sigma FROM n JOIN f USING (subject, i, j, k) GROUP BY 1, 2",
    s="series",
)
def noise_sigma(s):
    """Noise of each volume, as seen by one receiver coil."""
    return rounded(denoise.noise_sigma(s, GRID, coils=1), "sigma")


@query(s="series")
def series_nlmeans(s):
    """Non-local means over the nearest voxels."""
    return denoise.nlmeans(s, GRID, 150.0, patch=1, reach=2)


@query(s="series")
def series_mppca(s):
    return denoise.mppca(s, GRID, radius=1)


@query(s="series")
def series_lpca(s):
    """Local components against the series' own map of the noise."""
    return denoise.lpca(s, denoise.pca_noise_map(s, GRID, smooth=1.0), GRID, radius=1)


@query(s="series")
def series_unringed(s):
    return denoise.unring(s, GRID, denoise.slice_axis("axial"))


@query(s="series")
def slice_noise(s):
    return denoise.piesno(s, GRID, coils=1)


# Tensor fits and free water: 269-278, 298-299, 305, 308-312.
_AXES = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, -1, 0), (1, 0, -1), (0, 1, -1)]
BVALS = [0.0] + [1000.0] * len(_AXES)
BVECS = [[0.0, 0.0, 0.0]] + [[float(c) / sum(abs(x) for x in a) ** 0.5 for c in a] for a in _AXES]


def _signal(t: int) -> str:
    """SQL of the stand-in's signal in volume t: its tensor seen along a direction, with a little that no tensor explains."""
    x, y, z = BVECS[t]
    form = f"xx * {x * x!r} + yy * {y * y!r} + zz * {z * z!r} + xy * {2 * x * y!r} + xz * {2 * x * z!r} + yz * {2 * y * z!r}"
    return f"s0 * exp(-{BVALS[t]!r} * ({form})) + (i * 7 + j * 5 + k * 3 + {t * 11}) % 13"


def _voxels(f):
    """The stand-in's voxels by number, with their signals as arrays."""
    return f.select("subject", (F.col("i") * 100 + F.col("j") * 10 + F.col("k")).cast("long").alias("voxel"), F.array(*[F.expr(_signal(t)) for t in range(len(BVALS))]).alias("signal"))


_SOLVE = np.linalg.pinv(kernels.design_matrix(np.array(BVALS), np.array(BVECS)))


@query(
    "WITH s AS (SELECT subject, CAST(i * 100 + j * 10 + k AS BIGINT) AS voxel, " + ", ".join(f"ln({_signal(t)}) AS s{t}" for t in range(len(BVALS))) + " FROM {f}) SELECT subject, voxel, " + ", ".join(f"round({' + '.join(f'{_SOLVE[n, t]!r} * s{t}'.replace('np.float64(', '').replace(')', '') for t in range(len(BVALS)))}, 9) + 0.0 AS {name}" for n, name in enumerate(tensor.TENSOR)) + " FROM s",
    f="field",
)
def tensor_ols(f):
    """Tensors by least squares on the log signal."""
    return rounded(kernels.fit_tensors(_voxels(f), BVALS, BVECS, weighted=False), *tensor.TENSOR, places=9)


@query(f="field")
def tensor_wls(f):
    return kernels.fit_tensors(_voxels(f), BVALS, BVECS)


@query(f="field")
def tensor_nlls(f):
    return kernels.fit_tensors_nonlinear(_voxels(f), BVALS, BVECS)


@query(f="field")
def tensor_restore(f):
    return kernels.fit_tensors_nonlinear(_voxels(f), BVALS, BVECS, sigma=3.0)


SPACE = {"i": 6, "j": 6, "k": 5}


@query(f="field")
def field_regulariser(f):
    """Gradient of the spatial regulariser of every tensor field, factors scaled to thousandths."""
    scaled = f.select("subject", "i", "j", "k", *[(F.col(c) * 1000).alias(c) for c in tensor.TENSOR])
    return fernet.regulariser(fernet.long_factors(scaled), SPACE, block=4)


@query(f="field")
def free_water_regularised(f):
    signal = F.transform(F.array(*[F.expr(_signal(t)) for t in range(1, len(BVALS))]), lambda s: s / F.col("s0"))
    start = f.select("subject", "i", "j", "k", signal.alias("signal"), F.lit(0.8).alias("fraction"), *tensor.TENSOR)
    return fernet.regularised(start, BVALS[1:], BVECS[1:], SPACE, steps=2)


@query(f="field")
def free_water_maps(f):
    """The whole correction, from signals and mask to maps."""
    dwi = f.select("subject", "i", "j", "k", F.posexplode(F.array(*[F.expr(_signal(t)) for t in range(len(BVALS))])).alias("t", "value"))
    brain = f.select("subject", "i", "j", "k", F.lit(1).alias("value"))
    return fernet.run_fernet(dwi, brain, BVALS, BVECS, erode=0, fa_above=0.3, trace_above=0.002)


# Files: 1-7, 22, 30-33, 67-68, 322. Written to the shared folder and read back.
@query("SELECT CAST(subject AS VARCHAR) AS subject, i, j, k, t, value, 1000.0 * t AS b, CASE WHEN t = 1 THEN 1.0 ELSE 0.0 END AS bx, CASE WHEN t = 2 THEN 1.0 ELSE 0.0 END AS by, CASE WHEN t = 3 THEN 1.0 ELSE 0.0 END AS bz FROM {s} WHERE value <> 0", s="series")
def series_files(s):
    """Every series with gradients as image, bval and bvec files, and as one table again."""
    along = lambda n: F.when(F.col("t") == n, 1.0).otherwise(0.0)
    dwi = s.select("*", (F.col("t") * 1000.0).alias("b"), along(1).alias("bx"), along(2).alias("by"), along(3).alias("bz"))
    folder = f"{shared_folder(s.sparkSession)}/series-{uuid.uuid4().hex}"
    nifti.write_dwi(dwi, folder, (6, 6, 5, 4), dtype="f8").count()
    return nifti.read_dwi(s.sparkSession, folder)


@query("SELECT CAST(subject AS VARCHAR) AS subject, 6 AS i, 6 AS j, 5 AS k, 4 AS t, false AS tensor, 'f4' AS dtype FROM {s} GROUP BY subject", s="series")
def series_headers(s):
    """Headers of every series, written in single precision."""
    folder = f"{shared_folder(s.sparkSession)}/series-{uuid.uuid4().hex}"
    images.write_images(s, folder, (6, 6, 5, 4)).count()
    nifti.register(s.sparkSession)
    heads = s.sparkSession.read.format("nifti").option("path", folder).option("headers", "true").load()
    return heads.select(nifti.subject_of().alias("subject"), *[F.col("shape")[n].alias(a) for n, a in enumerate("ijkt")], images.is_tensor(F.col("intent"), F.col("shape")).alias("tensor"), "dtype")


@query("SELECT CAST(subject AS VARCHAR) AS subject, CAST(dense_rank() OVER (PARTITION BY subject ORDER BY streamline) - 1 AS BIGINT) AS streamline, CAST(row_number() OVER (PARTITION BY subject, streamline ORDER BY seq) - 1 AS BIGINT) AS seq, round(x, 3) + 0.0 AS x, y, round(z, 3) + 0.0 AS z FROM {p}", p="points")
def track_files(p):
    """Every subject's streamlines as a trk file, and as points again."""
    folder = f"{shared_folder(p.sparkSession)}/tracks-{uuid.uuid4().hex}"
    tracks.write_tracks(p, folder).count()
    back = tracks.read_points(p.sparkSession, folder)
    return rounded(back.select(F.regexp_extract("path", r"([^/]*)\.trk$", 1).alias("subject"), "streamline", "seq", "x", "y", "z"), "x", "z", places=3)
