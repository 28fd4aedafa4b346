"""Ward clustering on a distributed table of distances, and the index of its cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.lineage import cut
from voxara.operators.matrices import distances


def standardised(features: DataFrame) -> DataFrame:
    """(subject, feature, y) with mean 0 and population deviation 1 in each feature; constant features are 0, nulls go."""
    held = features.where("y is not null and not isnan(y)").select("subject", "feature", F.col("y").cast("double").alias("y"))
    s = held.groupBy("feature").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    return held.join(s, "feature").select("subject", "feature", F.coalesce(F.try_divide(F.col("y") - F.col("m"), F.col("s")), F.lit(0.0)).alias("y"))


def ward(pairs: DataFrame) -> DataFrame:
    """Merges by Ward's rule of a table of distances (a, b, distance), each pair once.

    In every round all pairs of clusters that are each other's nearest merge at
    once, which gives the merges that one at a time would give; equal distances
    go by the smaller names. Distances to the new clusters are one aggregation.
    A cluster keeps the smaller name. Returns a, b (which goes), distance, size.
    """
    one = F.lit(1).cast("long")
    table = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.pow(F.col("distance").cast("double"), 2).alias("d"), one.alias("na"), one.alias("nb")))
    left = table.select("a").union(table.select("b")).distinct().count() - 1
    merged = table.where("false").select("a", "b", F.col("d").alias("distance"), F.col("na").alias("size"))
    while left > 0:
        pair = F.struct("d", "a", "b", "na", "nb").alias("pair")
        near = table.select(F.col("a").alias("c"), pair).union(table.select(F.col("b").alias("c"), pair)).groupBy("c").agg(F.min("pair").alias("pair"))
        new = cut(near.groupBy("pair").count().where(F.col("count") == 2).select("pair.*"))
        merged = merged.union(new.select("a", "b", F.sqrt("d").alias("distance"), (F.col("na") + F.col("nb")).alias("size")))
        left -= new.count()
        grown = [F.col("a").alias("into"), (F.col("na") + F.col("nb")).alias("n"), F.col("d").alias("inner")]
        to = new.select(F.col("a").alias("c"), *grown).union(new.select(F.col("b").alias("c"), *grown))
        side = lambda s: to.select(*[F.col(x).alias(f"{x}_{s}") for x in to.columns])  # noqa: E731, B023
        moved = table.join(side("a"), F.col("a") == F.col("c_a"), "left").join(side("b"), F.col("b") == F.col("c_b"), "left")
        moved = moved.select(F.coalesce("into_a", "a").alias("x"), F.coalesce("into_b", "b").alias("y"), ((F.col("na") + F.col("nb")) * F.col("d")).alias("s"), F.coalesce("n_a", "na").alias("nx"), F.coalesce("n_b", "nb").alias("ny"), F.coalesce("inner_a", F.lit(0.0)).alias("ix"), F.coalesce("inner_b", F.lit(0.0)).alias("iy")).where("x <> y")
        swap = F.col("x") > F.col("y")
        ends = [F.when(swap, F.col(v)).otherwise(F.col(u)).alias(n) for n, u, v in (("a", "x", "y"), ("b", "y", "x"), ("na", "nx", "ny"), ("nb", "ny", "nx"), ("ia", "ix", "iy"), ("ib", "iy", "ix"))]
        sums = moved.select("s", *ends).groupBy("a", "b").agg(F.sum("s").alias("s"), *[F.max(c).alias(c) for c in ("na", "nb", "ia", "ib")])
        d = (F.col("s") - F.col("nb") * F.col("ia") - F.col("na") * F.col("ib")) / (F.col("na") + F.col("nb"))
        table = cut(sums.select("a", "b", d.alias("d"), "na", "nb"))
    return merged


def assignments(merges: DataFrame, most: int | None = None) -> DataFrame:
    """Each subject's cluster at each number of clusters: (clusters, subject, cluster), clusters named by their smallest member's name.

    Cutting to k clusters leaves out the k - 1 last merges by distance. A
    subject's clusters are the chain of those that took it in, found by
    following all chains together. ``most`` bounds the numbers of clusters.
    """
    from pyspark.sql import Window as W

    total = merges.count()
    # One row per merge: the table of merges is as long as the subjects.
    order = F.row_number().over(W.orderBy("distance", "size", "a", "b"))
    numbered = cut(merges.withColumn("step", order).select(F.col("b").alias("gone"), F.col("a").alias("into"), "step"))
    subjects = numbered.select(F.col("gone").alias("subject")).union(numbered.select("into")).distinct()
    open_ = subjects.select("subject", F.col("subject").alias("cluster"), F.lit(0).alias("since"))
    chains = []
    while True:
        met = cut(open_.join(numbered, open_["cluster"] == numbered["gone"], "left").select("subject", "cluster", "since", "into", "step"))
        chains.append(met.select("subject", "cluster", "since", F.coalesce(F.col("step") - 1, F.lit(total)).alias("until")))
        open_ = met.where("into is not null").select("subject", F.col("into").alias("cluster"), F.col("step").alias("since"))
        if open_.isEmpty():
            break
    spans = reduce(lambda a, b: a.union(b), chains)
    low = F.greatest(F.col("since"), F.lit(max(0, total + 1 - most) if most is not None else 0))
    at = spans.withColumn("low", low).where("low <= until").withColumn("done", F.explode(F.sequence("low", "until")))
    return at.select((F.lit(total + 1) - F.col("done")).cast("int").alias("clusters"), "subject", "cluster")


def cluster_index(features: DataFrame, members: DataFrame) -> DataFrame:
    """Calinski-Harabasz index of each cut: (clusters, index) from (subject, feature, y) and (clusters, subject, cluster).

    Subjects lack no feature. Cuts into one cluster, or into as many as there
    are subjects, have null.
    """
    y = features.select("subject", "feature", "y").join(members, "subject")
    by = y.groupBy("clusters", "cluster", "feature").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    per = by.groupBy("clusters", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("m"), F.count("*").alias("k"))
    out = per.groupBy("clusters").agg(F.sum(F.col("m") - F.col("s") ** 2 / F.col("n")).alias("between"), F.sum(F.col("q") - F.col("m")).alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    ratio = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    usable: Column = (F.col("k") > 1) & (F.col("n") > F.col("k"))
    return out.select("clusters", F.when(usable, F.when(F.col("within") > 0, ratio).otherwise(1.0)).alias("index"))


def hierarchical(features: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges, members of every cut and the cuts' index, of subjects by their standardised features."""
    z = cut(standardised(features))
    merges = cut(ward(distances(z)))
    members = assignments(merges, most)
    return merges, members, cluster_index(z, members)
