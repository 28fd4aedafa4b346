"""Least squares for every feature of a long table (subject, feature, y) and any formula.

One aggregation gathers the cross products of the design for all features; each
feature's small system is solved in an Arrow batch, and what follows from it
(p-values, intervals, tests of models) is Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.functions.distributions import f_upper, t_quantile, t_two_sided
from voxara.operators.statistics import false_discovery

_FIT = "feature string, n long, df long, rss double, tss double, rss_reduced double, df_reduced long, coefficient array<double>, error array<double>, sd_x array<double>, sd_y double"


def _solved(data: DataFrame, columns: list[str], reduced: list[str] | None) -> DataFrame:
    """One row per feature: sums of squares of the full and the reduced model, and the full model's terms."""
    import numpy as np
    import pyarrow as pa

    held = data.dropna(subset=["y", *[f"`{c}`" for c in columns]])
    # Columns are centred and scaled by figures of the whole table, so that cross products keep their digits.
    shape = held.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)]).first() if columns else {}
    middle = [float(shape[f"m{i}"] or 0.0) for i in range(len(columns))]
    scale = [float(shape[f"s{i}"] or 0.0) or 1.0 for i in range(len(columns))]
    x = [F.lit(1.0), *[(F.col(f"`{c}`") - m) / s for c, m, s in zip(columns, middle, scale, strict=True)]]
    p, names = len(x), ["Intercept", *columns]
    inner = [0, *[1 + columns.index(c) for c in reduced]] if reduced is not None else [0]
    sums = held.groupBy("feature").agg(F.count("*").alias("n"), F.array(*[F.sum(x[a] * x[b]) for a in range(p) for b in range(p)]).alias("xx"), F.array(*[F.sum(x[a] * F.col("y")) for a in range(p)]).alias("xy"), F.sum(F.col("y") ** 2).alias("yy"), F.var_pop("y").alias("vy"))
    back = np.diag([1.0, *[1 / s for s in scale]])
    back[0, 1:] = [-m / s for m, s in zip(middle, scale, strict=True)]

    def solve(batches):
        for b in batches:
            if not b.num_rows:
                continue
            # The systems of all features of a batch are solved at once.
            n, yy, vy = (b.column(c).to_numpy().astype(float) for c in ("n", "yy", "vy"))
            gram, cross = b.column("xx").flatten().to_numpy().reshape(-1, p, p), b.column("xy").flatten().to_numpy().reshape(-1, p)
            inverse, less = np.linalg.pinv(gram), gram[:, inner][:, :, inner]
            beta, part = np.einsum("fij,fj->fi", inverse, cross), np.einsum("fij,fj->fi", np.linalg.pinv(less), cross[:, inner])
            rss, rss_less = np.maximum(0.0, yy - (beta * cross).sum(1)), np.maximum(0.0, yy - (part * cross[:, inner]).sum(1))
            df, df_less = n - np.linalg.matrix_rank(gram), n - np.linalg.matrix_rank(less)
            s2 = np.divide(rss, df, out=np.full(len(n), np.nan), where=df > 0)
            # Back to the columns as they came.
            own, spread = beta @ back.T, np.einsum("ij,fjk,ik->fi", back, inverse, back)
            sd = np.sqrt(np.maximum(0.0, np.diagonal(gram, 0, 1, 2) / n[:, None] - (gram[:, 0] / n[:, None]) ** 2) * (n / np.maximum(1, n - 1))[:, None]) * np.array([1.0, *scale])
            error = np.sqrt(s2[:, None] * np.maximum(0.0, spread))
            offsets = pa.array(np.arange(len(n) + 1) * p, pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (own, error, sd)]
            whole = [pa.array(v.astype(np.int64)) for v in (df, df_less)]
            yield pa.RecordBatch.from_arrays([b.column("feature"), b.column("n"), whole[0], pa.array(rss), pa.array(n * vy), pa.array(rss_less), whole[1], *listed, pa.array(np.sqrt(vy))], names=fields)

    fields = [f.strip().split()[0] for f in _FIT.split(",")]
    solved = sums.withColumn("feature", F.col("feature").cast("string")).mapInArrow(solve, _FIT)
    return solved.withColumn("term", F.array(*[F.lit(t) for t in names])).withColumn("terms", F.arrays_zip("term", "coefficient", "error", "sd_x")).drop("term", "coefficient", "error", "sd_x")


def ols_terms(data: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Each term of each feature: coefficient, error, t, p, q over the features, half-width of the interval, b and d.

    Rows with a missing value are left out feature by feature. b is the
    coefficient in deviations of x (sample) and y (population), d is
    2 t / sqrt(df). A term that can't be told apart has t null and p 1, as has
    every term of a feature with no more rows than terms; its error is null.
    """
    each = _solved(data, columns, None).withColumn("critical", t_quantile(F.col("df"), alpha)).select("*", F.explode("terms").alias("x")).withColumn("error", F.nullif("x.error", F.lit(float("nan"))))
    t = F.try_divide("x.coefficient", F.nullif("error", F.lit(0.0)))
    rows = each.select("feature", "x.term", "n", "df", "x.coefficient", "error", t.alias("t"), (F.col("critical") * F.col("error")).alias("half_width"), F.try_divide(F.col("x.coefficient") * F.col("x.sd_x"), F.nullif("sd_y", F.lit(0.0))).alias("b"))
    tested = rows.withColumn("d", F.try_divide(2 * F.col("t"), F.sqrt("df"))).withColumn("p", F.coalesce(t_two_sided(F.col("t"), F.col("df")), F.lit(1.0)))
    return false_discovery(tested, ["term"]).drop("q_bonferroni", "q_holm").withColumnRenamed("q_bh", "q")


def ols_models(data: DataFrame, columns: list[str], reduced: list[str] | None = None) -> DataFrame:
    """Each feature's model: R2, adjusted R2, F against no covariate and against the reduced model, with their p."""
    s = _solved(data, columns, reduced)
    r2 = 1 - F.try_divide("rss", F.nullif("tss", F.lit(0.0)))
    mean = F.try_divide("rss", F.nullif("df", F.lit(0)))
    df_model, df_less = F.col("n") - 1 - F.col("df"), F.col("df_reduced") - F.col("df")
    full = F.try_divide(F.try_divide(F.col("tss") - F.col("rss"), F.nullif(df_model, F.lit(0))), F.nullif(mean, F.lit(0.0)))
    nested = F.try_divide(F.try_divide(F.col("rss_reduced") - F.col("rss"), F.nullif(df_less, F.lit(0))), F.nullif(mean, F.lit(0.0)))
    out = s.select("feature", "n", "df", r2.alias("r2"), (1 - F.try_divide((1 - r2) * (F.col("n") - 1), F.col("df"))).alias("r2_adj"), full.alias("f"), df_model.alias("df_model"), nested.alias("f_reduced"), df_less.alias("df_terms"))
    return out.withColumn("p", f_upper(F.col("f"), F.col("df_model"), F.col("df"))).withColumn("p_reduced", f_upper(F.col("f_reduced"), F.col("df_terms"), F.col("df")))


def compare_models(data: DataFrame, columns: list[str], reduced: list[str]) -> DataFrame:
    """One F test of the full against the reduced model, residual squares summed over all features."""
    s = _solved(data, columns, reduced).agg(F.sum("rss").alias("rss"), F.sum("rss_reduced").alias("less"), F.max("df").alias("df"), F.max("df_reduced").alias("df_reduced"))
    terms = F.col("df_reduced") - F.col("df")
    return s.withColumn("f", F.try_divide(F.try_divide(F.col("less") - F.col("rss"), terms), F.nullif(F.try_divide("rss", "df"), F.lit(0.0)))).select("f", terms.alias("df_terms"), "df", f_upper(F.col("f"), terms, F.col("df")).alias("p"))


def _predicted(coefficients: DataFrame, columns: list[str], without: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """A row of coefficients per feature, and the sum of the terms (but those left out) over a data row."""
    names = ["Intercept", *columns]
    wide = coefficients.groupBy("feature").agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"__c{i}") for i, t in enumerate(names)])
    parts = [F.col(f"__c{i}") * (F.lit(1.0) if i == 0 else F.col(f"`{t}`")) for i, t in enumerate(names) if t not in without]
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    return wide, total


def residualise(data: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """y without the fitted parts of the given terms; intercept and other terms stay in it."""
    kept = tuple(t for t in ["Intercept", *columns] if t not in terms)
    wide, part = _predicted(ols_terms(data, columns).select("feature", "term", "coefficient"), columns, kept)
    return data.join(wide, "feature").select("subject", "feature", (F.col("y") - part).alias("y"))


def residuals_of(coefficients: DataFrame, columns: list[str], other: DataFrame) -> DataFrame:
    """Residuals of another cohort's data under a fitted model."""
    wide, part = _predicted(coefficients, columns)
    return other.join(wide, "feature").select("subject", "feature", (F.col("y") - part).alias("y"))


def zscores_by_formula(data: DataFrame, columns: list[str], subset: DataFrame) -> DataFrame:
    """Residuals of a fit on the subset, for all, scaled by the subset's mean and population deviation.

    Without covariates the values themselves are scaled by the mean and
    deviation of everybody, as there is no fit that the subset would restrict.
    """
    if not columns:
        scale = data.groupBy("feature").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
        return data.join(scale, "feature").select("subject", "feature", F.try_divide(F.col("y") - F.col("m"), F.nullif("s", F.lit(0.0))).alias("z"))
    inside = data.join(subset.select("subject").distinct().withColumn("inside", F.lit(True)), "subject", "left")
    fit = ols_terms(inside.where("inside").select("feature", "y", *columns), columns)
    wide, part = _predicted(fit.select("feature", "term", "coefficient"), columns)
    left = inside.join(wide, "feature").select("subject", "feature", "inside", (F.col("y") - part).alias("r"))
    scale = left.where("inside").groupBy("feature").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return left.join(scale, "feature").select("subject", "feature", F.try_divide(F.col("r") - F.col("m"), F.nullif("s", F.lit(0.0))).alias("z"))


def to_matrix(results: DataFrame, value: str, nodes: list[int], fill: float) -> DataFrame:
    """A statistic of edges (i, j), i < j, as a whole symmetric matrix; cells without a result hold ``fill``."""
    grid = results.sparkSession.createDataFrame([(a, b) for a in nodes for b in nodes], "i int, j int")  # a matrix of the atlas
    both = results.select("i", "j", value).unionByName(results.select(F.col("j").alias("i"), F.col("i").alias("j"), value))
    return grid.join(both, ["i", "j"], "left").select("i", "j", F.coalesce(value, F.lit(fill)).alias(value))


def to_image(results: DataFrame, value: str, mask: DataFrame, fill: float) -> DataFrame:
    """A statistic per feature (place of a mask voxel in C order, from 0) as an image over the mask's voxels."""
    return mask.join(results.select("feature", value), "feature", "left").select("i", "j", "k", F.coalesce(value, F.lit(fill)).alias("value"))


def thresholded(edges: DataFrame, value: str, by: str, level: float, fill: float = 0.0, absolute: bool = True) -> DataFrame:
    """Edge values, those whose ``by`` is below the level replaced by ``fill``."""
    size = F.abs(by) if absolute else F.col(by)
    return edges.withColumn(value, F.when(size < level, F.lit(fill)).otherwise(F.col(value)))


def edge_histogram(edges: DataFrame, low: float | None = 0.0, high: float | None = None, bins: int = 50, log: bool = False) -> DataFrame:
    """Counts of edge weights above ``low`` and up to ``high`` in bins of equal width, the last one closed."""
    w = F.col("w").cast("double")
    kept = edges.where((w > low if low is not None else F.lit(True)) & (w <= high if high is not None else F.lit(True)))
    values = kept.select((F.log(w) if log else w).alias("v"))
    extent = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    a, width = extent["a"] or 0.0, ((extent["b"] or 0.0) - (extent["a"] or 0.0)) / bins
    place = F.least(F.floor((F.col("v") - a) / width), F.lit(bins - 1)) if width else F.lit(0)
    return values.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n")).select("bin", "n", (F.lit(a) + F.col("bin") * width).alias("from"))


def edge_distribution(edges: DataFrame) -> DataFrame:
    """Normal and gamma distributions of each edge over the subjects, by likelihood (gamma: Newton from Minka's start)."""
    s = edges.where("w > 0").groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.avg(F.log("w")).alias("mean_log"))
    gap = F.log("mean") - F.col("mean_log")
    shape = F.when(gap > 1e-12, (3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap))

    def digamma(k: Column) -> Column:
        up = k + 6
        steps = F.lit(0.0)
        for m in range(6):
            steps = steps + 1 / (k + m)
        return F.log(up) - 1 / (2 * up) - 1 / (12 * up * up) + 1 / (120 * F.pow(up, 4)) - 1 / (252 * F.pow(up, 6)) - steps

    def trigamma(k: Column) -> Column:
        up = k + 6
        steps = F.lit(0.0)
        for m in range(6):
            steps = steps + 1 / F.pow(k + m, 2)
        return 1 / up + 1 / (2 * up * up) + 1 / (6 * F.pow(up, 3)) - 1 / (30 * F.pow(up, 5)) + 1 / (42 * F.pow(up, 7)) + steps

    step = lambda k, _: k - (F.log(k) - digamma(k) - F.col("gap")) / (1 / k - trigamma(k))
    out = s.withColumn("gap", gap).withColumn("start", shape)
    fitted = F.when(F.col("start").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("start"), step))
    return out.select("i", "j", "n", "mean", "std", fitted.alias("shape"), F.try_divide("mean", fitted).alias("scale"))
