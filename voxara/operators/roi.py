"""Region statistics and quality-control reports over voxel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.images import VOXEL


def roi_stats(scalar: DataFrame, atlas: DataFrame, labels: list[int], zoom: float = 1.0, nonzero: bool = True) -> DataFrame:
    """Mean, median, population deviation and volume per (subject, label); absent regions are 0.

    ``labels`` are the labels to report.
    """
    voxels = scalar.where("value <> 0") if nonzero else scalar
    stats = voxels.join(atlas, VOXEL).groupBy("subject", "label").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), (F.count("*") * F.lit(float(zoom))).alias("volume"))
    # Every subject reports every label.
    wanted = scalar.select("subject").distinct().select("subject", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    return wanted.join(stats, ["subject", "label"], "left").select("subject", "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median", "std", "volume")])


def roi_stats_least(scalar: DataFrame, atlas: DataFrame, least: int = 20) -> DataFrame:
    """Variant with the sample deviation, and 0 for regions of fewer voxels than ``least``."""
    stats = scalar.where("value <> 0").join(atlas, VOXEL).groupBy("subject", "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    kept = lambda c: F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    return stats.select("subject", "label", kept("mean"), kept("std"))


def roi_outliers(stats: DataFrame, times: float = 6.0) -> DataFrame:
    """Regions whose mean is outside the quartiles by ``times`` 1.5 interquartile ranges."""
    q = stats.groupBy("subject").agg(F.percentile("mean", F.lit(0.25)).alias("q1"), F.percentile("mean", F.lit(0.75)).alias("q3"))
    reach = times * 1.5 * (F.col("q3") - F.col("q1"))
    return stats.join(q, "subject").where((F.col("mean") <= F.col("q1") - reach) | (F.col("mean") >= F.col("q3") + reach)).select("subject", "label", "mean")


def wide(stats: DataFrame, measure: str, labels: list[int]) -> DataFrame:
    """One row per subject and one column per label."""
    return stats.groupBy("subject").pivot("label", labels).agg(F.first(measure))


def tensor_roi_stats(scalars: DataFrame, atlas: DataFrame, names: list[str], least: int = 20, nonzero: bool = True) -> DataFrame:
    """Mean, median and sample deviation of several scalar maps per region: one row per (subject, label, scalar).

    ``scalars`` has one column per map. Regions of fewer voxels than ``least`` are 0.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("scalar"), F.col(n).alias("value")) for n in names]))
    long = scalars.join(atlas.where("label <> 0").select(*VOXEL, "label"), VOXEL).select("subject", "label", pairs.alias("x")).select("subject", "label", "x.*")
    held = long.where("value <> 0") if nonzero else long
    stats = held.groupBy("subject", "label", "scalar").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"))
    kept = lambda c: F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    return stats.select("subject", "label", "scalar", kept("mean"), kept("median"), kept("std"))


def registration_report(scalar: DataFrame, atlas: DataFrame, low: float, high: float, bins: int, zoom: float = 1.0) -> DataFrame:
    """One wide row per subject: background against foreground, moments, and a histogram's densities in columns."""
    joined = scalar.join(atlas.where("label <> 0").select(VOXEL), VOXEL, "left_semi")
    out = background(scalar, atlas, zoom).join(moments(joined), "subject", "left")
    width = (high - low) / bins
    names = [f"hist{low + k * width:0.2f}-{low + (k + 1) * width:0.2f}" for k in range(bins)]
    shares = histogram(joined, low, high, bins).groupBy("subject").pivot("bin", list(range(bins))).agg(F.first("density"))
    shares = shares.select("subject", *[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(n) for k, n in enumerate(names)])
    return out.join(shares, "subject", "left")


def quality_table(people: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """One row per subject with the columns of all reports, in the order given, as text and named family_column.

    A report that lacks a subject leaves its columns null.
    """
    out = people
    for family, report in families.items():
        out = out.join(report.select("subject", *[F.col(f"`{c}`").cast("string").alias(f"{family}_{c}") for c in report.columns if c != "subject"]), "subject", "left")
    return out


def background(scalar: DataFrame, atlas: DataFrame, zoom: float = 1.0) -> DataFrame:
    """Labelled volume with a zero and a non-zero scalar, and their ratio."""
    joined = atlas.where("label <> 0").join(scalar, VOXEL, "left").withColumn("zero", F.coalesce("value", F.lit(0.0)) == 0)
    return joined.groupBy("subject").agg((F.count_if("zero") * zoom).alias("zero_volume"), (F.count_if(~F.col("zero")) * zoom).alias("nonzero_volume")).withColumn("ratio", F.try_divide("zero_volume", "nonzero_volume"))


def moments(scalar: DataFrame) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis, all of the population."""
    return scalar.groupBy("subject").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))


def histogram(scalar: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Density histogram; the last bin is closed."""
    inside = scalar.where(F.col("value").between(low, high))
    binned = inside.withColumn("bin", F.least(F.floor((F.col("value") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy("subject", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("subject").agg(F.sum("n").alias("total"))
    return counts.join(totals, "subject").select("subject", "bin", "n", (F.col("n") / (F.col("total") * ((high - low) / bins))).alias("density"))


def end_slices(img: DataFrame, zoom: float = 1.0) -> DataFrame:
    """Non-zero volume in the first and the last slice."""
    last = img.groupBy("subject").agg(F.max("k").alias("last"))
    joined = img.join(last, "subject")
    return joined.groupBy("subject").agg((F.count_if((F.col("k") == 0) & (F.col("value") != 0)) * zoom).alias("first_slice"), (F.count_if((F.col("k") == F.col("last")) & (F.col("value") != 0)) * zoom).alias("last_slice"))


def grade_volumes(volumes: DataFrame, cut: float = 0.5) -> DataFrame:
    """Percentage of bad volumes per b-value, and whether it fails: 50 % below b = 50, else 15 %."""
    graded = volumes.groupBy("subject", "b").agg((100.0 * F.count_if(F.col("probability") >= cut) / F.count("*")).alias("percent_bad"))
    return graded.withColumn("bad", F.col("percent_bad") >= F.when(F.col("b") < 50, 50.0).otherwise(15.0))


def voxel_conforms(images: DataFrame, sites: DataFrame, within: float = 0.001) -> DataFrame:
    """Whether an image's zooms are relatively near its site's."""
    differ = F.greatest(*[F.abs(F.col(f"z{n}") - F.col(f"site_z{n}")) / F.col(f"site_z{n}") for n in range(3)])
    return images.join(sites, "site").select("subject", "site", (differ < within).alias("conforms"))
