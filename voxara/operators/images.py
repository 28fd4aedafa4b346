"""Voxel-aligned image algebra on long tables (subject, i, j, k, value).

Tables are sparse: a voxel without a row is 0. Every operator is a projection,
an equi-join on the voxel, or one aggregation by voxel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxara.operators.batches import scattered, spread
from voxara.operators.slabs import _filled, by_blocks

VOXEL = ["subject", "i", "j", "k"]
#: Edge of the blocks that are smoothed, and of those whose voxels' neighbours are counted together.
SMOOTHED, COUNTED = 32, 8
#: Marks voxels that have no row, where a kernel returns whole blocks.
ABSENT = -1.7976931348623157e308
#: Offsets of the face, edge and corner neighbourhoods, by the largest sum of steps.
REACH = {"NN1": 1, "NN2": 2, "NN3": 3}


def threshold(img: DataFrame, value: float = 0.0) -> DataFrame:
    """1 where the value exceeds the threshold, else 0."""
    return img.withColumn("value", (F.col("value") > value).cast("int"))


def absolute_threshold(img: DataFrame, value: float = 0.0) -> DataFrame:
    return img.withColumn("value", F.when(F.abs("value") < value, 0.0).otherwise(F.col("value")))


def zeros(img: DataFrame) -> DataFrame:
    """An image of zeros over the same voxels."""
    return img.withColumn("value", F.lit(0.0))


def ones(img: DataFrame) -> DataFrame:
    """1 where the image is positive, else 0."""
    return img.withColumn("value", (F.col("value") > 0).cast("int"))


def invert(img: DataFrame, shape: dict[str, int]) -> DataFrame:
    """1 where the image is 0, else 0, over the whole grid: voxels without a row are 0 and come out as 1."""
    grid = img.select("subject").distinct()
    for axis, n in shape.items():
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(img.select(*VOXEL, "value"), VOXEL, "left").select(*VOXEL, (F.coalesce("value", F.lit(0.0)) == 0).cast("int").alias("value"))


def split(img: DataFrame, axis: str, index: int | None = None) -> DataFrame:
    """Slices along an axis: its place becomes ``part`` and goes from the voxel; one slice alone if an index is given."""
    rest = [c for c in img.columns if c != axis]
    parts = img if index is None else img.where(F.col(axis) == index)
    return parts.select(F.col(axis).alias("part"), *rest)


def threshold_fa(fa: DataFrame, brain: DataFrame | None = None, value: float = 0.7, iterations: int = 1) -> DataFrame:
    """Voxels above the threshold inside the mask, eroded if asked for; without a mask that of non-zero voxels."""
    inside = brain if brain is not None else fa.where("value <> 0")
    above = fa.where(F.col("value") > value)
    if not iterations:
        return mask(above, inside.where("value > 0")).select(*VOXEL, F.lit(1).alias("value"))
    # The last erosion and the mask are one aggregation over the voxels.
    near = _near(erode(inside, "NN1", iterations - 1) if iterations > 1 else inside.where("value > 0"), "NN1")
    held = spread(above.na.drop(subset=VOXEL).select(*VOXEL, F.lit(0).cast("long").alias("near"), F.lit(1).alias("held")), *VOXEL)
    both = held.union(near.withColumn("held", F.lit(0))).groupBy(VOXEL).agg(F.sum("near").alias("near"), F.sum("held").cast("int").alias("held"))
    core = both.where((F.col("near") == kernel_size("NN1")) & (F.col("held") > 0))
    # A voxel comes as often as the image has it.
    return core.select(*VOXEL, F.explode(F.array_repeat(F.lit(1), F.col("held"))).alias("value"))


def tissue_rois(brain: DataFrame, fa: DataFrame, trace: DataFrame, iterations: int = 10, fa_above: float = 0.7, trace_above: float = 0.0085, exclude: DataFrame | None = None) -> DataFrame:
    """White matter (FA above its bound) and fluid (trace above its) inside the eroded mask: (voxel, roi)."""
    core = erode(brain, "NN1", iterations) if iterations else brain.where("value > 0").select(*VOXEL, F.lit(1).alias("value"))
    if exclude is not None:
        core = core.join(exclude.where("value <> 0").select(VOXEL), VOXEL, "left_anti")
    white = mask(fa.where(F.col("value") > fa_above), core).select(*VOXEL, F.lit("white").alias("roi"))
    return white.unionByName(mask(trace.where(F.col("value") > trace_above), core).select(*VOXEL, F.lit("fluid").alias("roi")))


def gaussian(sigma: float, zooms: tuple[float, float, float], reach: float = 4.0) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """The halo that a Gaussian needs, and the function that sums neighbours by its weights along each axis and drops the halo."""
    reaches = [int(reach * sigma / z) for z in zooms]
    weights = [np.exp(-((np.arange(-far, far + 1) * z) ** 2) / (2 * sigma * sigma)) for far, z in zip(reaches, zooms, strict=True)]
    halo = max(reaches)

    def along(a: np.ndarray) -> np.ndarray:
        for axis, (far, w) in enumerate(zip(reaches, weights, strict=True)):
            n = a.shape[axis] - 2 * halo
            a = sum(w[d + far] * np.take(a, range(halo + d, halo + d + n), axis) for d in range(-far, far + 1))
        return a

    return halo, along


def smooth(img: DataFrame, sigma: float, zooms: tuple[float, float, float], shape: dict[str, int], reach: float = 4.0) -> DataFrame:
    """Gaussian smoothing of the given deviation in mm, one axis after another, up to ``reach`` deviations.

    At the border weights are those of the voxels inside, scaled to sum to 1;
    voxels without a row count as 0. Blocks with halos are smoothed along all
    axes at once, so the one shuffle is that of the voxels. Voxels without any
    other in reach have no row.
    """
    halo, along = gaussian(sigma, zooms, reach)

    def kernel(a: np.ndarray, inside: np.ndarray, near: np.ndarray) -> np.ndarray:
        norm = along(inside.astype(float))[..., None]
        # Rows are those of voxels in reach of a row; the others are marked.
        return _filled(np.where(along(near) > 0, along(a) / np.where(norm > 0, norm, 1), ABSENT), halo)

    marked = img.select(*VOXEL, "value", F.lit(1.0).alias("near"))
    return by_blocks(marked, shape, halo, kernel, SMOOTHED, "constant", ("near",)).where(F.col("value") != ABSENT)


def contrast(img: DataFrame) -> DataFrame:
    """Display limits of each subject's image: its extremes drawn in by a twentieth, or 0 and 1 where they are near."""
    top, low = F.max("value"), F.min("value")
    limits = img.groupBy("subject").agg(low.cast("double").alias("a"), top.cast("double").alias("b"))
    high = F.when((F.col("b") > 0.9) & (F.col("b") <= 1.0), F.lit(1.0)).otherwise(0.95 * F.col("b"))
    bottom = F.when(F.col("a") >= 0, F.lit(0.0)).when(F.col("a").between(-1.0, -0.9), F.lit(-1.0)).otherwise(0.95 * F.col("a"))
    return limits.select("subject", bottom.alias("low"), high.alias("high"))


def slices(img: DataFrame, kind: str, shape: dict[str, int]) -> DataFrame:
    """An image in RAS order as slices to look at: slice, row, column, value; ``kind`` is axial, coronal or sagittal."""
    back = {a: shape[a] - 1 - F.col(a) for a in "ijk"}
    views = {"a": (back["i"], back["j"], F.col("k")), "c": (back["i"], back["k"], shape["j"] - 1 - F.col("j")), "s": (back["j"], back["k"], F.col("i"))}
    place = views.get({"z": "a", "y": "c", "x": "s"}.get(kind[:1].lower(), kind[:1].lower()))
    if place is None:
        raise ValueError(f"not a kind of slice: {kind}")
    return img.select("subject", *[c.cast("int").alias(n) for c, n in zip(place, ("row", "column", "slice"), strict=True)], "value")


def grid_slices(rows: int, columns: int, center: int, spacing: int) -> list[int]:
    """Places of the slices of a grid about a center."""
    n = rows * columns
    return [center + (k - n // 2) * spacing for k in range(n)]


def labels_differ(atlas: DataFrame, labels: list[int]) -> DataFrame:
    """Labels that only the image or only the list (which always includes 0) has; none where they agree."""
    wanted = atlas.sparkSession.createDataFrame([(x,) for x in sorted({0, *labels})], "label int")
    found = atlas.select(F.col("label").cast("int").alias("label")).distinct()
    both = found.withColumn("image", F.lit(1)).join(wanted.withColumn("list", F.lit(1)), "label", "full")
    return both.where("image is null or list is null").select("label", F.col("image").isNotNull().alias("in_image"))


def target_masks(atlas: DataFrame) -> DataFrame:
    """One mask per label: the atlas's non-zero voxels by ``label``, to be written partitioned by it."""
    return atlas.where("label <> 0").select("label", *VOXEL, F.lit(1).alias("value"))


def mask(img: DataFrame, by: DataFrame, value: float = 0.0) -> DataFrame:
    """The voxels where the mask exceeds the threshold."""
    return img.join(by.where(F.col("value") > value).select(VOXEL), VOXEL, "left_semi")


def multiply(*images: DataFrame) -> DataFrame:
    """Products of aligned images; a voxel missing from one is 0 and goes."""
    named = [img.select(*VOXEL, F.col("value").alias(f"v{n}")) for n, img in enumerate(images)]
    joined = reduce(lambda a, b: a.join(b, VOXEL), named)
    return joined.select(*VOXEL, reduce(lambda a, b: a * b, [F.col(f"v{n}") for n in range(len(images))]).alias("value"))


def add(*images: DataFrame, binarize: bool = False) -> DataFrame:
    both = reduce(lambda a, b: a.unionByName(b), [img.select(*VOXEL, "value") for img in images])
    total = F.max((F.col("value") > 0).cast("int")) if binarize else F.sum("value")
    return both.groupBy(VOXEL).agg(total.alias("value"))


def intersection(*images: DataFrame) -> DataFrame:
    """Voxels that are positive in every image."""
    marked = reduce(lambda a, b: a.unionByName(b), [img.where("value > 0").select(*VOXEL, F.lit(n).alias("n")) for n, img in enumerate(images)])
    return marked.groupBy(VOXEL).agg(F.countDistinct("n").alias("n")).where(F.col("n") == len(images)).select(*VOXEL, F.lit(1).alias("value"))


def extract_roi(atlas: DataFrame, labels: list[int]) -> DataFrame:
    return atlas.where(F.col("label").isin(labels)).select(*VOXEL, F.lit(1).alias("value"))


def replace_labels(atlas: DataFrame, lut: DataFrame) -> DataFrame:
    """in_label becomes out_label, unmatched labels 0; of repeated in_labels the last position holds."""
    last = lut.groupBy("in_label").agg(F.max_by("out_label", "position").alias("out_label"))
    return atlas.join(last, atlas["label"] == last["in_label"], "left").select(*VOXEL, F.coalesce("out_label", F.lit(0)).alias("label"))


def order_labels(atlas: DataFrame) -> DataFrame:
    """Dense numbers of the sorted distinct labels; 0 stays 0. The labels, not the voxels, are ranked."""
    distinct = atlas.where("label <> 0").select("label").distinct()
    ranked = distinct.withColumn("rank", F.row_number().over(W.orderBy("label")))
    return atlas.join(ranked, "label", "left").select(*VOXEL, F.coalesce("rank", F.lit(0)).alias("label"))


def crop_pad(img: DataFrame, adjust: dict[str, tuple[int, int]], shape: dict[str, int]) -> DataFrame:
    """Crops (negative) or pads (positive) each axis; sparse voxels only move."""
    out = img
    for axis, (low, high) in adjust.items():
        out = out.withColumn(axis, F.col(axis) + low).where((F.col(axis) >= 0) & (F.col(axis) < shape[axis] + low + high))
    return out


def flip(img: DataFrame, axes: list[str], shape: dict[str, int]) -> DataFrame:
    """Reverses axes, as a change of orientation does."""
    return img.withColumns({a: (shape[a] - 1 - F.col(a)).cast("int") for a in axes})


def concatenate(*series: DataFrame) -> DataFrame:
    """Images with volumes t, one after another: later ones move by the lengths before them."""
    numbered = reduce(lambda a, b: a.unionByName(b), [s.withColumn("part", F.lit(n)) for n, s in enumerate(series)])
    lengths = numbered.groupBy("subject", "part").agg((F.max("t") + 1).alias("length"))
    before = F.sum("length").over(W.partitionBy("subject").orderBy("part")) - F.col("length")
    moved = numbered.join(lengths.withColumn("before", before), ["subject", "part"])
    return moved.withColumn("t", (F.col("t") + F.col("before")).cast("int")).drop("part", "length", "before")


def _offsets(kernel: str) -> Column:
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) <= REACH[kernel]]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in steps])).alias("d")


def kernel_size(kernel: str) -> int:
    return {"NN1": 7, "NN2": 19, "NN3": 27}[kernel]


def _near(voxels: DataFrame, kernel: str) -> DataFrame:
    """Voxels by how many of the given ones they are in reach of (``near``), in parts, dealt by voxel over all tasks.

    Neighbours are added up by blocks first, so that few of them are shuffled.
    """
    block = [f"b{a}" for a in "ijk"]
    dealt = spread(voxels.select(*VOXEL, *[F.floor(F.col(a) / COUNTED).alias(b) for a, b in zip("ijk", block, strict=True)]), "subject", *block)
    moved = dealt.select(*VOXEL, *block, _offsets(kernel)).select("subject", *block, *[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "ijk"])
    return spread(moved.groupBy("subject", *block, "i", "j", "k").agg(F.count("*").alias("near")).select(*VOXEL, "near"), *VOXEL)


def erode(binary: DataFrame, kernel: str = "NN1", iterations: int = 1) -> DataFrame:
    """Voxels whose whole neighbourhood is set; those at the border go. One shuffle per iteration."""
    out = binary.where("value > 0").select(VOXEL)
    for _ in range(iterations):
        near = scattered(out, *VOXEL).select(*VOXEL, _offsets(kernel)).select("subject", *[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "ijk"])
        out = near.groupBy(VOXEL).count().where(F.col("count") == kernel_size(kernel)).select(VOXEL)
    return out.withColumn("value", F.lit(1))


def dilate(binary: DataFrame, shape: dict[str, int], kernel: str = "NN1", iterations: int = 1) -> DataFrame:
    """Voxels within the image that have a set neighbour, or are set."""
    out = binary.where("value > 0").select(VOXEL)
    inside = reduce(lambda a, b: a & b, [F.col(a).between(0, n - 1) for a, n in shape.items()])
    for _ in range(iterations):
        near = scattered(out, *VOXEL).select(*VOXEL, _offsets(kernel)).select("subject", *[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "ijk"])
        out = near.where(inside).distinct()
    return out.withColumn("value", F.lit(1))


def boundary(white: DataFrame, gray: DataFrame, shape: dict[str, int]) -> DataFrame:
    """Gray voxels next to white ones."""
    return mask(gray.where("value > 0"), dilate(white, shape))


def split_mask(binary: DataFrame, parts: int) -> DataFrame:
    """Voxels in C order in ``parts`` runs of equal length, the remainder in the last."""
    n = F.count("*").over(W.partitionBy("subject"))
    rn = F.row_number().over(W.partitionBy("subject").orderBy("i", "j", "k"))
    size = F.greatest(F.floor(n / parts), F.lit(1))
    return binary.where("value > 0").select(*VOXEL, F.least(F.floor((rn - 1) / size), F.lit(parts - 1)).cast("int").alias("part"))


def center_of_mass(atlas: DataFrame, zooms: tuple[float, float, float], origin: tuple[float, float, float]) -> DataFrame:
    """Mean position of each label in mm, by a diagonal affine."""
    means = atlas.where("label <> 0").groupBy("subject", "label").agg(*[F.avg(a).alias(a) for a in "ijk"])
    return means.select("subject", "label", *[(F.col(a) * z + o).alias(n) for a, n, z, o in zip("ijk", "xyz", zooms, origin, strict=True)])


def gradient(img: DataFrame, axis: str, length: int) -> DataFrame:
    """Next minus previous value along an axis, 0 at its ends; voxels without a row count as 0."""
    ahead = img.select(*[(F.col(a) - 1).alias(a) if a == axis else F.col(a) for a in VOXEL], F.col("value").alias("up"))
    behind = img.select(*[(F.col(a) + 1).alias(a) if a == axis else F.col(a) for a in VOXEL], F.col("value").alias("down"))
    near = ahead.join(behind, VOXEL, "full").where(F.col(axis).between(1, length - 2))
    return near.select(*VOXEL, (F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0))).alias("value"))


def same_geometry(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether two affines (arrays) agree within the tolerances."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda x: x)


def project(img: DataFrame, matrix: list[float]) -> DataFrame:
    """Nearest-voxel move through a 4 x 4 matrix given by rows, coordinates truncated; the last value of a voxel by source order holds."""
    moved = [(F.col("i") * matrix[4 * r] + F.col("j") * matrix[4 * r + 1] + F.col("k") * matrix[4 * r + 2] + matrix[4 * r + 3]).cast("int").alias(a) for r, a in enumerate("ijk")]
    return img.select("subject", *moved, "value", F.struct("i", "j", "k").alias("source")).groupBy(VOXEL).agg(F.max_by("value", "source").alias("value"))


def parts_of(binary: DataFrame, k: int, seed: int = 1, steps: int = 100) -> DataFrame:
    """Each subject's region cut in k by k-means on the voxel coordinates; one subject's region is the unit of work."""
    import numpy as np
    import pandas as pd

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j", "k"])
        x = rows[["i", "j", "k"]].to_numpy(float)
        rng = np.random.default_rng(seed)
        centre = x[[rng.integers(len(x))]]
        while len(centre) < min(k, len(x)):  # far voxels are likelier starts
            far = ((x[:, None] - centre) ** 2).sum(2).min(1)
            if not far.any():
                break
            centre = np.vstack([centre, x[rng.choice(len(x), p=far / far.sum())]])
        part = np.zeros(len(x), int)
        for _ in range(steps):
            new = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
            centre = np.stack([x[new == c].mean(0) if (new == c).any() else centre[c] for c in range(len(centre))])
            if (new == part).all():
                break
            part = new
        return rows.assign(part=part.astype("int32"))[["subject", "i", "j", "k", "part"]]

    return binary.where("value > 0").select(VOXEL).groupBy("subject").applyInPandas(cut, "subject long, i int, j int, k int, part int")
