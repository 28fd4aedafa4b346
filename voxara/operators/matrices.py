"""Connectomes as edge tables (subject, i, j, w): matrix operators and relational graph measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxara.operators.batches import by_groups, spread
from voxara.operators.slabs import CELLS

CELL = ["subject", "i", "j"]


def transpose(m: DataFrame) -> DataFrame:
    return m.select("subject", F.col("j").alias("i"), F.col("i").alias("j"), "w")


def symmetrise(m: DataFrame) -> DataFrame:
    """(M + M') / 2 as one aggregation; an absent cell is 0."""
    return m.select(*CELL, "w").unionByName(transpose(m)).groupBy(CELL).agg((F.sum("w") / 2).alias("w"))


def upper(m: DataFrame, diagonal: bool = False) -> DataFrame:
    return m.where("i <= j" if diagonal else "i < j")


def from_upper(edges: DataFrame) -> DataFrame:
    return edges.unionByName(transpose(edges.where("i < j")))


def normalise(m: DataFrame, n: int) -> DataFrame:
    """(w - min) / (max - min) over all n * n cells, absent ones being 0."""
    w = W.partitionBy("subject")
    full = F.count("*").over(w) == n * n
    low = F.when(full, F.min("w").over(w)).otherwise(F.least(F.min("w").over(w), F.lit(0.0)))
    high = F.when(full, F.max("w").over(w)).otherwise(F.greatest(F.max("w").over(w), F.lit(0.0)))
    return m.select(*CELL, F.try_divide(F.col("w") - low, high - low).alias("w"))


def binarize(m: DataFrame) -> DataFrame:
    return m.withColumn("w", (F.col("w") > 0).cast("int"))


def log_scale(m: DataFrame, base: float = 10.0) -> DataFrame:
    return m.withColumn("w", F.when(F.col("w") > 0, F.log(base, F.col("w"))).otherwise(F.lit(0.0)))


def fisher_z(m: DataFrame) -> DataFrame:
    return m.withColumn("w", F.when(F.abs("w") < 1, 0.5 * F.log((1 + F.col("w")) / (1 - F.col("w")))))


def prune(edges: DataFrame, density: float) -> DataFrame:
    """Upper edges of at least the weight at place int(density * count), from 0, in descending order; ties stay."""
    order = W.partitionBy("subject").orderBy(F.desc("w"))
    n = F.count("*").over(W.partitionBy("subject"))
    placed = edges.withColumn("place", F.row_number().over(order) - 1).withColumn("at", F.least(F.floor(n * density), n - 1))
    cut = F.max(F.when(F.col("place") == F.col("at"), F.col("w"))).over(W.partitionBy("subject"))
    return placed.withColumn("cut", cut).where("w >= cut").select(*CELL, "w")


def density(m: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    return m.groupBy("subject").agg((F.count_if(F.col("w") > threshold) / (n * (n - 1))).alias("density"))


def degree_strength(m: DataFrame) -> DataFrame:
    return m.groupBy("subject", "i").agg(F.count_if(F.col("w") > 0).alias("degree"), F.sum("w").alias("strength"))


def variation(edges: DataFrame) -> DataFrame:
    """Deviation over absolute mean of each edge across subjects."""
    return edges.groupBy("i", "j").agg(F.try_divide(F.stddev_pop("w"), F.abs(F.avg("w"))).alias("cv"))


def consistent(edges: DataFrame, controls: DataFrame, target: float = 1 / 3) -> DataFrame:
    """Edges whose variation across the controls is below the target."""
    return edges.join(variation(controls).where(F.col("cv") < target).select("i", "j"), ["i", "j"], "left_semi").select(*CELL, "w")


def _finished(m: DataFrame, symmetric: bool, zero_diagonal: bool) -> DataFrame:
    out = symmetrise(m) if symmetric else m.select(*CELL, "w")
    return out.withColumn("w", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("w"))) if zero_diagonal else out


def volume_normalise(m: DataFrame, volumes: DataFrame, symmetric: bool = True, zero_diagonal: bool = True) -> DataFrame:
    """Column j divided by its region's volume (subject, node, volume); then symmetric and without diagonal."""
    by = volumes.select("subject", F.col("node").alias("j"), "volume")
    return _finished(m.join(by, ["subject", "j"]).select(*CELL, F.try_divide("w", F.nullif("volume", F.lit(0))).alias("w")), symmetric, zero_diagonal)


def boundary_normalise(m: DataFrame, boundary: DataFrame, zoom: float = 1.0, symmetric: bool = True, zero_diagonal: bool = True) -> DataFrame:
    """All cells divided by the volume of a boundary mask (subject, i, j, k, value); then symmetric and without diagonal."""
    volume = boundary.groupBy("subject").agg((F.count_if(F.col("value") > 0) * F.lit(zoom)).alias("volume"))
    return _finished(m.join(volume, "subject").select(*CELL, F.try_divide("w", F.nullif("volume", F.lit(0.0))).alias("w")), symmetric, zero_diagonal)


def random_cell(mask: DataFrame, seed: int = 1) -> DataFrame:
    """One set cell (i, j) of a mask, drawn by a seeded hash."""
    return mask.where("w <> 0").orderBy(F.xxhash64(F.lit(seed), "i", "j"), "i", "j").limit(1).select("i", "j")


def graph_measures(m: DataFrame, n: int, densities: list[float], weighted: bool = True) -> DataFrame:
    """Global measures of each subject's matrix pruned to each density: density, assortativity, transitivity, paths.

    ``m`` is symmetric. Weighted measures use weights scaled to 0 to 1, others
    the binary matrix; all densities are one table, keyed by (subject, density).
    Returns subject, density (asked for), reached, assortativity, transitivity,
    efficiency and path_length.
    """
    grid = [_keyed(prune(m.where("i < j"), d), d) for d in densities]
    edges = from_upper(reduce(lambda a, b: a.unionByName(b), grid))
    scaled = normalise(edges, n) if weighted else binarize(edges).withColumn("w", F.col("w").cast("double"))
    held = scaled.where("w > 0")
    out = density(edges, n).withColumnRenamed("density", "reached")
    for part in (assortativity(held, weighted), transitivity(held), shortest_paths(held, n, weighted).select("subject", "efficiency", "path_length")):
        out = out.join(part, "subject", "left")
    return _unkeyed(out)


def node_measures(m: DataFrame, n: int, densities: list[float]) -> DataFrame:
    """Degree and strength of each node of each subject's matrix pruned to each density."""
    grid = [_keyed(prune(m.where("i < j"), d), d) for d in densities]
    edges = from_upper(reduce(lambda a, b: a.unionByName(b), grid))
    return _unkeyed(degree_strength(edges).withColumnRenamed("i", "node"))


#: Densities are kept in the subject's key, as whole ten-thousandths.
_PARTS = 10_000


def _keyed(m: DataFrame, density: float) -> DataFrame:
    return m.select((F.col("subject") * _PARTS + round(density * _PARTS)).alias("subject"), "i", "j", "w")


def _unkeyed(m: DataFrame) -> DataFrame:
    rest = [c for c in m.columns if c != "subject"]
    return m.select(F.floor(F.col("subject") / _PARTS).cast("long").alias("subject"), ((F.col("subject") % _PARTS) / _PARTS).alias("density"), *rest)


def is_binary(m: DataFrame) -> DataFrame:
    return m.groupBy("subject").agg((F.countDistinct(F.when(F.col("w") != 0, F.col("w"))) == 1).alias("binary"))


def systems(m: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean weight within (strict upper triangle) and between systems; a node may be in several."""
    a = membership.select(F.col("node").alias("i"), F.col("system").alias("sa"))
    b = membership.select(F.col("node").alias("j"), F.col("system").alias("sb"))
    both = m.join(a, "i").join(b, "j").where("sa < sb or (sa = sb and i < j)")
    return both.groupBy("subject", "sa", "sb").agg(F.avg("w").alias("w"))


def transitivity(m: DataFrame) -> DataFrame:
    """Sum of cube roots of triangle weights over the number of connected triples; weights are scaled by ``normalise`` first."""
    edge = m.where("i <> j and w > 0")
    a, b, c = edge.alias("a"), edge.alias("b"), edge.alias("c")
    closed = (
        a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a.j") == F.col("b.i")))
        .join(c, (F.col("b.subject") == F.col("c.subject")) & (F.col("b.j") == F.col("c.i")) & (F.col("c.j") == F.col("a.i")))
        .groupBy(F.col("a.subject").alias("subject"))
        .agg(F.sum(F.cbrt(F.col("a.w") * F.col("b.w") * F.col("c.w"))).alias("triangles"))
    )
    triples = edge.groupBy("subject", "i").agg(F.count("*").alias("k")).groupBy("subject").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("triples"))
    return triples.join(closed, "subject", "left").select("subject", F.try_divide(F.coalesce("triangles", F.lit(0.0)), F.col("triples").cast("double")).alias("transitivity"))


def assortativity(m: DataFrame, weighted: bool = False) -> DataFrame:
    """Correlation of the degrees (strengths) at both ends of each edge."""
    nodes = m.where("i <> j and w > 0").groupBy("subject", "i").agg((F.sum("w") if weighted else F.count("*").cast("double")).alias("d"))
    ends = m.where("i < j and w > 0").join(nodes.withColumnRenamed("d", "da"), ["subject", "i"]).join(nodes.select("subject", F.col("i").alias("j"), F.col("d").alias("db")), ["subject", "j"])
    h = ends.groupBy("subject").agg(F.avg(F.col("da") * F.col("db")).alias("p"), F.avg((F.col("da") + F.col("db")) / 2).alias("m"), F.avg((F.col("da") ** 2 + F.col("db") ** 2) / 2).alias("q"))
    return h.select("subject", F.try_divide(F.col("p") - F.col("m") ** 2, F.col("q") - F.col("m") ** 2).alias("assortativity"))


def correlation(series: DataFrame) -> DataFrame:
    """Correlation matrix of regions' time series (subject, t, roi, y), by a self-join on time."""
    a, b = series.alias("a"), series.alias("b")
    pairs = a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.roi") < F.col("b.roi")))
    return pairs.groupBy(F.col("a.subject").alias("subject"), F.col("a.roi").alias("i"), F.col("b.roi").alias("j")).agg(F.corr("a.y", "b.y").alias("w"))


def distances(features: DataFrame) -> DataFrame:
    """Mean squared difference of every two subjects over the features both have."""
    a, b = features.alias("a"), features.alias("b")
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.subject") < F.col("b.subject")))
    return pairs.groupBy(F.col("a.subject").alias("a"), F.col("b.subject").alias("b")).agg(F.avg((F.col("a.y") - F.col("b.y")) ** 2).alias("distance"))


def modularity(m: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman's Q of a given partition (node, module)."""
    total = m.groupBy("subject").agg(F.sum("w").alias("total"))
    joined = m.join(membership.select(F.col("node").alias("i"), F.col("module").alias("ma")), "i").join(membership.select(F.col("node").alias("j"), F.col("module").alias("mb")), "j")
    inside = joined.where("ma = mb").groupBy("subject", F.col("ma").alias("module")).agg(F.sum("w").alias("inside"))
    degree = joined.groupBy("subject", F.col("ma").alias("module")).agg(F.sum("w").alias("degree"))
    parts = degree.join(inside, ["subject", "module"], "left").join(total, "subject")
    return parts.groupBy("subject").agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("total") - (F.col("degree") / F.col("total")) ** 2).alias("modularity"))


_PATHS = "subject long, efficiency double, path_length double, mean_betweenness double"


def shortest_paths(m: DataFrame, n: int, weighted: bool = True) -> DataFrame:
    """Global efficiency, characteristic path length and mean betweenness per subject.

    A connectome has n nodes, so one subject's matrix is bounded; subjects are
    dealt over the cluster, and a step is for many at once. Weighted lengths are
    1 / w.
    """
    import numpy as np
    import pyarrow as pa

    def measure(rows: pa.Table, which: np.ndarray, first: np.ndarray) -> pa.Table:
        length = np.full((len(first), n, n), np.inf)
        i, j, w = (rows.column(c).to_numpy() for c in ("i", "j", "w"))
        held = w > 0
        length[which[held], i[held], j[held]] = 1.0 / w[held] if weighted else 1.0
        length[:, np.arange(n), np.arange(n)] = 0
        d = length.copy()
        for k in range(n):  # all pairs at once for each intermediate node
            d = np.minimum(d, d[:, :, k : k + 1] + d[:, k : k + 1])
        off = ~np.eye(n, dtype=bool)
        finite = off & np.isfinite(d)
        # Numbers of shortest paths, from near pairs to far ones; a step for all sources.
        paths, order = np.tile(np.eye(n), (len(first), 1, 1)), np.argsort(d, axis=2, kind="stable")
        each, sources = np.arange(len(first))[:, None], np.arange(n)
        for r in range(1, n):
            t = order[:, :, r]
            far, step = d[each, sources, t], length[each, :, t]
            before = off[t] & np.isfinite(step) & np.isfinite(far)[..., None] & np.isclose(d + step, far[..., None])
            paths[each, sources, t] = np.where(np.isfinite(far), np.where(before, paths, 0).sum(2), paths[each, sources, t])
        between = np.zeros((len(first), n))
        for v in range(n):
            on = np.isclose(d[:, :, v, None] + d[:, v, None], d) & finite
            on[:, v], on[:, :, v] = False, False
            with np.errstate(divide="ignore", invalid="ignore"):
                between[:, v] = np.where(on, paths[:, :, v, None] * paths[:, v, None] / paths, 0).reshape(len(first), -1).sum(1)
        count = finite.sum((1, 2))
        near = np.divide(1.0, d, out=np.zeros_like(d), where=finite).reshape(len(first), -1).sum(1)
        far = np.where(finite, d, 0).reshape(len(first), -1).sum(1)
        mean = np.where(count > 0, far / np.maximum(count, 1), np.nan)
        columns = [rows.column("subject").take(pa.array(first)), pa.array(near / (n * (n - 1))), pa.array(mean), pa.array(between.mean(1) / max(1, (n - 1) * (n - 2)))]
        return pa.table(columns, names=["subject", "efficiency", "path_length", "mean_betweenness"])

    typed = m.select(F.col("subject").cast("long").alias("subject"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    return by_groups(typed, ["subject"], measure, _PATHS, max(1, CELLS // (n * n)))


def communities(m: DataFrame, n: int, restarts: int = 100) -> DataFrame:
    """Modules of each subject's positive weights: nodes move to the neighbour module of most gain, modules merge, best of seeded restarts.

    One subject's matrix is the unit of work; all its restarts go together, a
    step for the next node of each.
    """
    import numpy as np
    import pandas as pd

    def search(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((n, n))
        held = edges[(edges.w > 0) & (edges.i != edges.j)]
        w[held.i, held.j] = held.w
        total = w.sum()
        if not total:
            return pd.DataFrame({"subject": key[0], "node": np.arange(n), "module": np.arange(n), "modularity": -1.0})
        rng, rows = np.random.default_rng(0), np.arange(restarts)
        level, label = np.broadcast_to(w, (restarts, n, n)), np.broadcast_to(np.arange(n), (restarts, n))
        while True:
            k = level.sum(2)
            own, mass, moved = np.broadcast_to(np.arange(n), (restarts, n)).copy(), k.copy(), True
            while moved:
                moved = False
                turns = rng.permuted(np.broadcast_to(np.arange(n), (restarts, n)), axis=1)
                for v in turns.T:
                    mine, heavy = own[rows, v], k[rows, v]
                    link = np.bincount((rows[:, None] * n + own).ravel(), level[rows, v].ravel(), restarts * n).reshape(restarts, n)
                    link[rows, mine] -= level[rows, v, v]
                    mass[rows, mine] -= heavy
                    gain = link - heavy[:, None] * mass / total
                    to = gain.argmax(1)
                    to = np.where(gain[rows, to] > gain[rows, mine] + 1e-12, to, mine)
                    moved |= bool((to != mine).any())
                    own[rows, v] = to
                    mass[rows, to] += heavy
            # Modules become nodes; emptied ones stay as nodes without weight.
            label = own[rows[:, None], label]
            if (own == np.arange(n)).all():
                break
            member = np.zeros((restarts, n, n))
            member[rows[:, None], np.arange(n), own] = 1
            level = member.transpose(0, 2, 1) @ level @ member
        q = np.trace(level, axis1=1, axis2=2) / total - (level.sum(2) ** 2).sum(1) / total**2
        best = int(np.argmax(q > q.max() - 1e-12))
        return pd.DataFrame({"subject": key[0], "node": np.arange(n), "module": np.unique(label[best], return_inverse=True)[1], "modularity": q[best]})

    return spread(m, "subject").groupBy("subject").applyInPandas(search, "subject long, node int, module int, modularity double")
