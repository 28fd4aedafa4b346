"""Streamlines as point tables (subject, streamline, seq, x, y, z)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _voxel(points: DataFrame) -> DataFrame:
    return points.select("*", *[F.floor(a).cast("int").alias(b) for a, b in zip("xyz", "ijk", strict=True)])


def density(points: DataFrame) -> DataFrame:
    """Distinct streamlines per voxel."""
    return _voxel(points).groupBy("subject", "i", "j", "k").agg(F.countDistinct("streamline").alias("n"))


def touching(points: DataFrame, *masks: DataFrame) -> DataFrame:
    """Points of the streamlines that visit every mask (subject, i, j, k)."""
    placed = _voxel(points)
    kept = [placed.join(m, ["subject", "i", "j", "k"], "left_semi").select("subject", "streamline").distinct() for m in masks]
    return reduce(lambda p, k: p.join(k, ["subject", "streamline"], "left_semi"), kept, points)


def avoiding(points: DataFrame, *masks: DataFrame) -> DataFrame:
    """Points of the streamlines that visit none of the masks."""
    placed = _voxel(points)
    hit = [placed.join(m, ["subject", "i", "j", "k"], "left_semi").select("subject", "streamline").distinct() for m in masks]
    return reduce(lambda p, k: p.join(k, ["subject", "streamline"], "left_anti"), hit, points)


def lengths(points: DataFrame) -> DataFrame:
    """Length of each streamline."""
    order = W.partitionBy("subject", "streamline").orderBy("seq")
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(order)) ** 2 for a in "xyz"), F.lit(0.0)))
    return points.select("subject", "streamline", F.coalesce(step, F.lit(0.0)).alias("step")).groupBy("subject", "streamline").agg(F.sum("step").alias("length"))


def statistics(points: DataFrame) -> DataFrame:
    """Number, least, greatest, mean and deviation of lengths per subject."""
    return lengths(points).groupBy("subject").agg(F.count("*").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("std"))


def merge(*sets: DataFrame) -> DataFrame:
    """Streamlines of several sets with the set's number."""
    return reduce(lambda a, b: a.unionByName(b), [s.withColumn("set", F.lit(n)) for n, s in enumerate(sets)])


def kappa(a: DataFrame, b: DataFrame, total: int) -> DataFrame:
    """Cohen's kappa of two masks (subject, i, j, k) in a space of ``total`` voxels."""
    key = ["subject", "i", "j", "k"]
    both = a.select(*key, F.lit(1).alias("a")).join(b.select(*key, F.lit(1).alias("b")), key, "full")
    c = both.groupBy("subject").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("pp"), F.count_if(F.col("b").isNull()).alias("pn"), F.count_if(F.col("a").isNull()).alias("np"))
    nn = F.lit(total) - F.col("pp") - F.col("pn") - F.col("np")
    agree = (F.col("pp") + nn) / F.lit(float(total))
    chance = ((F.col("np") + nn) * (F.col("pn") + nn) + (F.col("np") + F.col("pp")) * (F.col("pn") + F.col("pp"))) / F.lit(float(total) * total)
    return c.select("subject", F.try_divide(agree - chance, 1 - chance).alias("kappa"))


def thin(points: DataFrame, percent: float) -> DataFrame:
    """About ``percent`` of the streamlines, those through dense voxels going first; the choice is by hash."""
    dense = density(points)
    weight = _voxel(points).join(dense, ["subject", "i", "j", "k"]).groupBy("subject", "streamline").agg(F.avg(1.0 / F.col("n")).alias("weight"))
    # Weighted sampling without replacement: the largest u ** (1 / weight) stay.
    u = (F.pmod(F.xxhash64("subject", "streamline"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30) + 1)
    ranked = weight.withColumn("place", F.percent_rank().over(W.partitionBy("subject").orderBy(F.desc(F.log(u) / F.col("weight")), "streamline")))
    return points.join(ranked.where(F.col("place") * 100 < percent), ["subject", "streamline"], "left_semi")


def coreset(points: DataFrame, percent: float, draws: int = 15, seed: int = 1) -> DataFrame:
    """Of ``draws`` weighted draws of ``percent`` of each subject's streamlines, the one that visits the fewest voxels.

    A streamline weighs as the mean inverse density of its points' voxels. A
    draw without replacement takes the smallest of -ln(u) / weight, with u made
    from seed, draw and streamline. Of equal draws the last holds. Returns
    subject, draw, streamline, weight and covered, the share of the subject's
    voxels that the draw visits.
    """
    dense = density(points)
    at = _voxel(points)
    weight = at.join(dense, ["subject", "i", "j", "k"]).groupBy("subject", "streamline").agg(F.avg(1.0 / F.col("n")).alias("weight"))
    whole = W.partitionBy("subject")
    shares = weight.withColumn("weight", F.col("weight") / F.sum("weight").over(whole)).withColumn("m", F.floor(F.count("*").over(whole) * percent / 100))
    tried = shares.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("subject").cast("string"), F.col("streamline").cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    place = F.row_number().over(W.partitionBy("subject", "draw").orderBy(-F.log(u) / F.col("weight"), "streamline"))
    drawn = tried.withColumn("place", place).where(F.col("place") <= F.col("m")).select("subject", "draw", "streamline", "weight")
    visited = at.select("subject", "streamline", "i", "j", "k").distinct()
    seen = visited.join(drawn, ["subject", "streamline"]).groupBy("subject", "draw").agg(F.countDistinct("i", "j", "k").alias("seen"))
    every = dense.groupBy("subject").agg(F.count("*").alias("voxels"))
    best = seen.join(every, "subject").select("subject", "draw", (F.col("seen") / F.col("voxels")).alias("covered"), F.struct("seen", (-F.col("draw")).alias("late")).alias("key"))
    chosen = best.groupBy("subject").agg(F.min_by("draw", "key").alias("draw"), F.min_by("covered", "key").alias("covered"))
    return drawn.join(chosen, ["subject", "draw"]).select("subject", "draw", "streamline", "weight", "covered")


def curvature(angle: Column, step: Column) -> Column:
    return step / (2 * F.sin(angle / 2))


def angle(curvature_: Column, step: Column) -> Column:
    return 2 * F.asin(step / (2 * curvature_))
