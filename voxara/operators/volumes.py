"""Operators on volumes, b-values, gradients and motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxara.operators.batches import spread

# Codes of the phase-encoding directions.
PHASE = {"AP": "j-", "PA": "j", "LR": "i", "RL": "i-", "IS": "k", "SI": "k-"}


def round_bvals(b: Column, nearest: int = 100) -> Column:
    """To the nearest multiple, halves to even."""
    return F.rint(b / nearest) * nearest


def in_shells(b: Column, targets: list[float], error: float = 20.0) -> Column:
    return F.exists(F.array(*[F.lit(float(t)) for t in targets]), lambda t: F.abs(b - t) <= error)


def gaussian_shells(volumes: DataFrame) -> DataFrame:
    """b = 0 and 500 to 1500 if a subject has b above 1500 or a non-zero one below 500; else all volumes."""
    extent = volumes.groupBy("subject").agg(F.max("b").alias("top"), F.min(F.when(F.col("b") > 0, F.col("b"))).alias("low"))
    joined = volumes.join(extent, "subject")
    multi = F.coalesce((F.col("top") > 1500) | (F.col("low") < 500), F.lit(False))
    return joined.where(~multi | (F.col("b") == 0) | F.col("b").between(500, 1500)).drop("top", "low")


def b0_mean(dwi: DataFrame) -> DataFrame:
    """Mean of the b = 0 volumes per voxel, and the first of them."""
    return dwi.where("b = 0").groupBy("subject", "voxel").agg(F.avg("value").alias("mean_b0"), F.min_by("value", "t").alias("first_b0"))


def temporal_snr(dwi: DataFrame, least: int = 3) -> DataFrame:
    """Mean over deviation of the b < 20 volumes per voxel; 0 where the deviation is."""
    stats = dwi.where("b < 20").groupBy("subject", "voxel").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return stats.where(F.col("n") >= least).select("subject", "voxel", F.coalesce(F.try_divide("m", F.nullif("s", F.lit(0.0))), F.lit(0.0)).alias("tsnr"))


def normalize(dwi: DataFrame, white: DataFrame, reference: float = 1000.0) -> DataFrame:
    """Scales each subject so that the median b = 0 signal in white matter is the reference."""
    median = dwi.where("b = 0").join(white, ["subject", "voxel"], "left_semi").groupBy("subject").agg(F.median("value").alias("median"))
    return dwi.join(median, "subject").withColumn("value", F.try_divide(F.col("value") * reference, F.col("median"))).drop("median")


def bval_report(volumes: DataFrame) -> DataFrame:
    """Counts of the rounded b-values, numbered from 1 in ascending order."""
    counts = volumes.groupBy("subject", round_bvals(F.col("b")).alias("b")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("subject").orderBy("b")))


def is_valid_dwi(volumes: DataFrame, gradients: DataFrame) -> DataFrame:
    """Whether a subject has one b-value and one direction for each of its volumes; images by (subject, t)."""
    images = volumes.select("subject", "t", F.lit(True).alias("image"), F.lit(0).alias("b"), F.lit(0).alias("bx"))
    directions = gradients.select("subject", "t", F.lit(False).alias("image"), F.col("b").isNotNull().cast("int").alias("b"), F.col("bx").isNotNull().cast("int").alias("bx"))
    # Each is dealt over all tasks by itself: narrow rows are small, but the groups made of them are not.
    each = spread(images, "subject").union(spread(directions, "subject")).groupBy("subject", "t").agg(F.bool_or("image").alias("image"), F.bool_or(~F.col("image")).alias("direction"), F.sum("b").alias("n_b"), F.sum("bx").alias("n_vec"))
    named = F.col("t").isNotNull()
    n = each.groupBy("subject").agg(F.bool_or("image").alias("image"), F.bool_or("direction").alias("given"), F.count_if(F.col("image") & named).alias("n_volumes"), F.count_if(F.col("direction") & named).alias("n_t"), F.sum("n_b").alias("n_b"), F.sum("n_vec").alias("n_vec"))
    ok = F.col("subject").isNotNull() & (F.col("n_b") == F.col("n_volumes")) & (F.col("n_vec") == F.col("n_volumes")) & (F.col("n_t") == F.col("n_volumes"))
    return n.where("image").select("subject", (ok & F.col("given")).alias("valid"))


def adjust_b0(dwi: DataFrame, least: float = 1e-9) -> DataFrame:
    """b = 0 signals raised to what the weighted volumes allow at the least diffusivity."""
    weighted = dwi.where("b > 0")
    low = weighted.groupBy("subject").agg(F.min("b").alias("low"))
    top = weighted.groupBy("subject", "voxel").agg(F.max("value").alias("top"))
    joined = dwi.join(top, ["subject", "voxel"], "left").join(low, "subject", "left")
    floor = F.col("top") / F.exp(-F.col("low") * least)
    return joined.select("subject", "voxel", "t", "b", F.when(F.col("b") == 0, F.greatest("value", floor)).otherwise(F.col("value")).alias("value"))


def group_by_phase(images: DataFrame) -> DataFrame:
    """Images of one phase encoding and readout time, in order: (idx, name, phase, readout)."""
    return images.groupBy("phase", "readout").agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("held")).select("phase", "readout", F.transform("held", lambda x: x["name"]).alias("names"))


def unique_acquisitions(parameters: DataFrame) -> DataFrame:
    """Number of different directions, the first three fields of the acquisition parameters."""
    return parameters.agg(F.countDistinct(F.struct("x", "y", "z")).alias("n"))


def acquisition_line(phase: Column, readout: Column) -> Column:
    """Acquisition parameters of a phase-encoding direction (as AP or j-): x, y, z and the readout time."""
    code = decode_phase(phase)
    sign = F.when(F.endswith(code, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    axis = F.substring(code, 1, 1)
    return F.array(*[F.when(axis == a, sign).otherwise(F.lit(0)).cast("double") for a in "ijk"], readout.cast("double"))


def patch_radius(n: Column) -> Column:
    """Edge of the smallest cube of at least n voxels, for a denoising patch of n volumes, made odd."""
    edge = F.ceil(F.round(F.cbrt(n.cast("double")), 9)).cast("int")
    return edge + (edge % 2 == 0).cast("int")


def odd_padding(shape: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Padding of each axis, for ``crop_pad``, that makes odd lengths even."""
    return {a: (0, n % 2) for a, n in shape.items()}


def bvals_conform(report: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether a subject's report (subject, site, rank, b, n) equals its site's (site, rank, b, n) in every entry."""
    site = sites.select("site", "rank", F.col("b").alias("site_b"), F.col("n").alias("site_n"))
    people = report.select("subject", "site").distinct()
    wanted = people.join(site, "site")
    both = report.select("subject", "rank", "b", "n").join(wanted, ["subject", "rank"], "full")
    return both.groupBy("subject").agg(F.bool_and(F.col("b").eqNullSafe(F.col("site_b")) & F.col("n").eqNullSafe(F.col("site_n"))).alias("conforms"))


def index_runs(volumes: DataFrame) -> DataFrame:
    """Running group index that grows at each b = 0 volume."""
    return volumes.withColumn("run", F.sum((F.col("b") == 0).cast("int")).over(W.partitionBy("subject").orderBy("t").rowsBetween(W.unboundedPreceding, 0)))


def remove_volumes(volumes: DataFrame, drop: DataFrame) -> DataFrame:
    """Volumes not listed, numbered anew from 0."""
    kept = volumes.join(drop, ["subject", "t"], "left_anti")
    return kept.withColumn("t", F.row_number().over(W.partitionBy("subject").orderBy("t")) - 1)


def motion(params: DataFrame) -> DataFrame:
    """Root mean square of relative and absolute displacement, rotations at 50 mm."""
    order = W.partitionBy("subject").orderBy("t")
    names = ["tx", "ty", "tz", "rx", "ry", "rz"]
    arm = {n: 1.0 if n[0] == "t" else 50.0 for n in names}
    step = sum((F.abs(F.col(n) - F.lag(n).over(order)) * arm[n] for n in names), F.lit(0.0))
    away = sum((F.abs(F.col(n) - F.first(n).over(order)) * arm[n] for n in names), F.lit(0.0))
    moved = params.select("subject", "t", step.alias("step"), away.alias("away")).where(F.col("step").isNotNull())
    return moved.groupBy("subject").agg(F.sqrt(F.avg(F.col("step") ** 2)).alias("relative"), F.sqrt(F.avg(F.col("away") ** 2)).alias("absolute"))


def most_gradients(arrays: DataFrame) -> DataFrame:
    """Acquisitions with the most non-zero b-values, ties included."""
    counts = arrays.groupBy("subject", "acq").agg(F.sum((F.col("b") > 0).cast("long")).alias("n"))
    return counts.withColumn("most", F.rank().over(W.partitionBy("subject").orderBy(F.desc("n"))) == 1)


def unique_gradients(gradients: DataFrame, angle: float = 1e-4) -> DataFrame:
    """Directions that no earlier direction equals; near-zero vectors don't count."""
    norm = F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2 + F.col("bz") ** 2)
    unit = gradients.withColumn("norm", norm).where("norm > 1e-4").select("subject", "t", *[(F.col(c) / F.col("norm")).alias(c) for c in ("bx", "by", "bz")])
    a, b = unit.alias("a"), unit.alias("b")
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("a.bx") * F.col("b.bx") + F.col("a.by") * F.col("b.by") + F.col("a.bz") * F.col("b.bz"))))
    return a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("b.t") < F.col("a.t")) & (between < angle), "left_anti")


def decode_phase(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PHASE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def lmax(n: Column) -> Column:
    """Largest even harmonic order whose coefficients n observations determine."""
    return (2 * F.floor((F.sqrt(8.0 * n + 1) - 3) / 4)).cast("int")


def rotate(v: tuple[Column, Column, Column], rx: Column, ry: Column, rz: Column) -> tuple[Column, Column, Column]:
    """A vector turned back by rotations about x, y and z."""
    x, y, z = v
    y, z = y * F.cos(rx) + z * F.sin(rx), z * F.cos(rx) - y * F.sin(rx)
    x, z = x * F.cos(ry) - z * F.sin(ry), x * F.sin(ry) + z * F.cos(ry)
    x, y = x * F.cos(rz) + y * F.sin(rz), y * F.cos(rz) - x * F.sin(rz)
    return x, y, z


def date_codes(series: DataFrame) -> DataFrame:
    """t0, t1, ... for each subject's distinct dates in order."""
    return series.withColumn("code", F.concat(F.lit("t"), F.dense_rank().over(W.partitionBy("subject").orderBy("date")) - 1))
