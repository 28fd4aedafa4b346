"""Batch harmonisation (ComBat) on long tables: the loop runs on per-batch aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(data: DataFrame) -> DataFrame:
    """(feature, subject, batch, y) with batch means as the design: adds s, grand and sd; a missing y has no s."""
    batch = data.groupBy("feature", "batch").agg(F.count("y").alias("nb"), F.avg("y").alias("mb"), F.var_pop("y").alias("vb"))
    pooled = batch.groupBy("feature").agg((F.sum(F.col("nb") * F.col("mb")) / F.sum("nb")).alias("grand"), F.sqrt(F.sum(F.col("nb") * F.col("vb")) / F.sum("nb")).alias("sd"))
    return data.join(pooled, "feature").withColumn("s", F.when(F.col("sd") == 0, F.col("y") - F.col("grand")).otherwise((F.col("y") - F.col("grand")) / F.col("sd")))


def _scale(variance: Column) -> Column:
    """1 where there is no variance, so that a constant feature keeps its values."""
    return F.when((variance == 0) | variance.isNull(), F.lit(1.0)).otherwise(variance)


def batch_effects(standard: DataFrame) -> DataFrame:
    """Location and scale of each batch and feature, with the sums that the loop needs."""
    return standard.groupBy("batch", "feature").agg(F.count("s").alias("n"), F.avg("s").alias("gamma_hat"), _scale(F.var_samp("s")).alias("delta_hat"), F.sum("s").alias("sum_s"), F.sum(F.col("s") ** 2).alias("sum_s2"))


def combat(data: DataFrame, eb: bool = True, steps: int = 30) -> DataFrame:
    """Values without batch effects; with ``eb`` they are shrunk to each batch's priors.

    Each step of the fixed point is an expression over the aggregates, so all
    steps are one projection and no raw row is read again.
    """
    standard = standardize(data)
    effects = batch_effects(standard)
    effects = shrunk(effects, steps) if eb else effects.select("batch", "feature", F.col("gamma_hat").alias("gamma"), F.col("delta_hat").alias("delta"))
    joined = standard.join(effects, ["batch", "feature"])
    adjusted = F.try_divide(F.col("s") - F.col("gamma"), F.sqrt("delta")) * F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")) + F.col("grand")
    return joined.select("subject", "feature", "batch", adjusted.alias("y"))


def shrunk(effects: DataFrame, steps: int = 100, near: float = 1e-8) -> DataFrame:
    """gamma and delta of each batch and feature, shrunk to the batch's priors by the fixed point of their posterior means.

    The steps stop where both change by less than ``near`` of themselves; effects
    that ``steps`` don't bring so far raise an error. One feature alone has no
    prior and keeps its effects.
    """
    priors = effects.groupBy("batch").agg(F.avg("gamma_hat").alias("g_bar"), F.var_pop("gamma_hat").alias("t2"), F.avg("delta_hat").alias("m"), F.var_samp("delta_hat").alias("s2"))
    a, b = (2 * F.col("s2") + F.col("m") ** 2) / F.col("s2"), (F.col("m") * F.col("s2") + F.col("m") ** 3) / F.col("s2")
    known = effects.join(priors, "batch").withColumn("a", F.when(F.col("s2") > 0, a)).withColumn("b", F.when(F.col("s2") > 0, b))

    def step(acc, _):
        g = (F.col("t2") * F.col("n") * F.col("gamma_hat") + acc["d"] * F.col("g_bar")) / (F.col("t2") * F.col("n") + acc["d"])
        squares = F.col("sum_s2") - 2 * g * F.col("sum_s") + F.col("n") * g * g
        d = (0.5 * squares + F.col("b")) / (F.col("n") / 2 + F.col("a") - 1)
        change = F.greatest(F.abs(g - acc["g"]) / F.greatest(F.abs(acc["g"]), F.lit(1e-8)), F.abs(d - acc["d"]) / acc["d"])
        return F.when(acc["change"] < near, acc).otherwise(F.struct(g.alias("g"), d.alias("d"), change.alias("change")))

    start = F.struct(F.col("gamma_hat").alias("g"), F.col("delta_hat").alias("d"), F.lit(1.0).alias("change"))
    star = F.when(F.col("a").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)).otherwise(start)
    found = known.withColumn("star", star)
    far = F.col("a").isNotNull() & (F.col("star.change") > 1e-4)
    gamma = F.when(far, F.raise_error(F.lit("batch effects don't converge")).cast("double")).otherwise(F.col("star.g"))
    return found.select("batch", "feature", gamma.alias("gamma"), F.col("star.d").alias("delta"))


_MODEL = "feature string, batch int, n long, gamma_hat double, delta_hat double, sum_s double, sum_s2 double, grand double, sd double, slopes array<double>"


def model_effects(data: DataFrame, columns: list[str], reference: int | None = None) -> DataFrame:
    """Batch effects of each feature beside covariates: (feature, subject, batch, y, columns).

    y is fitted on batches and covariates together. One aggregation gathers sums
    and products of every batch and feature, and all else follows from them: the
    covariates' slopes, the grand mean, the pooled deviation and the batches'
    effects. Rows with a missing y or covariate don't enter. With a reference
    batch the mean and deviation are those of that batch, and features that it
    lacks have no effects.
    """
    import numpy as np
    import pyarrow as pa

    k = len(columns)
    held = data.dropna(subset=["y", *[f"`{c}`" for c in columns]])
    shape = held.agg(F.count("*"), *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    x = [F.col(f"`{c}`") - float(shape[f"m{i}"] or 0.0) for i, c in enumerate(columns)]
    middle = np.array([float(shape[f"m{i}"] or 0.0) for i in range(k)])
    sums = held.groupBy("feature", "batch").agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"), *[F.array(*a).cast("array<double>").alias(n) for n, a in (("mx", [F.avg(v) for v in x]), ("cxy", [F.covar_pop(v, "y") for v in x]), ("cxx", [F.covar_pop(v, w) for v in x for w in x]))]
    )

    def solve(batches):
        for b in batches:
            if not b.num_rows:
                continue
            each = b.column("each")
            rows, counts = each.flatten(), np.diff(each.offsets.to_numpy())
            n, my, vy, mx, cxy, cxx = (rows.field(c) for c in ("n", "my", "vy", "mx", "cxy", "cxx"))
            n, my, vy = (v.to_numpy().astype(float) for v in (n, my, vy))
            mx, cxy, cxx = (v.flatten().to_numpy().reshape(len(n), *to) for v, to in ((mx, (k,)), (cxy, (k,)), (cxx, (k, k))))
            # Each feature's batches are a run of rows; all features are solved at once.
            start, of = np.append(0, np.cumsum(counts)[:-1]), np.repeat(np.arange(len(counts)), counts)
            slopes = np.einsum("fij,fj->fi", np.linalg.pinv(np.add.reduceat(n[:, None, None] * cxx, start)), np.add.reduceat(n[:, None] * cxy, start))
            slope = slopes[of]
            location = my - (mx * slope).sum(1)
            squares = np.maximum(0.0, n * (vy - 2 * (cxy * slope).sum(1) + np.einsum("bij,bi,bj->b", cxx, slope, slope)))
            own = np.ones(len(n), bool) if reference is None else rows.field("batch").to_numpy() == reference
            inside = np.add.reduceat(np.where(own, n, 0.0), start)
            with np.errstate(invalid="ignore", divide="ignore"):
                grand = np.add.reduceat(np.where(own, n * location, 0.0), start) / inside
                sd = np.sqrt(np.add.reduceat(np.where(own, squares, 0.0), start) / inside)
                sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(grand)), sd, 1.0)
                gamma, delta = (location - grand[of]) / sd[of], squares / (n - 1) / sd[of] ** 2
            delta = np.where((delta > 0) & np.isfinite(delta), delta, 1.0)
            held_by = inside[of] > 0
            columns_of = [n * gamma, squares / sd[of] ** 2 + n * gamma**2, (grand - slopes @ middle)[of], sd[of]]
            out = [b.column("feature").take(pa.array(of)), rows.field("batch"), pa.array(n.astype(np.int64)), *[pa.array(v) for v in (gamma, delta, *columns_of)], pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * k, pa.int32()), pa.array(slope.ravel()))]
            yield pa.RecordBatch.from_arrays(out, names=fields).filter(pa.array(held_by))

    fields = [f.strip().split()[0] for f in _MODEL.split(",")]
    packed = sums.groupBy(F.col("feature").cast("string").alias("feature")).agg(F.sort_array(F.collect_list(F.struct(F.col("batch").cast("int").alias("batch"), "n", "my", "vy", "mx", "cxy", "cxx"))).alias("each"))
    return packed.mapInArrow(solve, _MODEL)


def combat_with_model(data: DataFrame, columns: list[str], eb: bool = True) -> DataFrame:
    """Values without batch effects that keep what covariates explain; (subject, feature, batch, y, columns).

    Rows with a missing y or covariate come back with a null y. A feature
    without variance keeps its values. A batch of one subject raises an error.
    """
    if not check_batches(data.select("subject", "batch").distinct()).isEmpty():
        raise ValueError("every batch needs two subjects at least")
    return apply_model(data, columns, estimates(data, columns, eb))


def estimates(data: DataFrame, columns: list[str], eb: bool = True) -> DataFrame:
    """What the adjustment needs, to store and to apply to other rows: batch, feature, gamma, delta, grand, sd, slopes and the raw effects."""
    effects = model_effects(data, columns)
    if not eb:
        return effects.select("batch", "feature", F.col("gamma_hat").alias("gamma"), F.col("delta_hat").alias("delta"), "grand", "sd", "slopes", "gamma_hat", "delta_hat")
    return effects.join(shrunk(effects), ["batch", "feature"]).select("batch", "feature", "gamma", "delta", "grand", "sd", "slopes", "gamma_hat", "delta_hat")


def apply_model(data: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    """Rows adjusted by estimates."""
    joined = data.join(found, ["batch", "feature"], "left")
    part = F.col("grand")
    for i, c in enumerate(columns):
        part = part + F.get("slopes", F.lit(i)) * F.col(f"`{c}`")
    adjusted = ((F.col("y") - part) / F.col("sd") - F.col("gamma")) / F.sqrt("delta") * F.col("sd") + part
    return joined.select("subject", "feature", "batch", adjusted.alias("y"))


def check_batches(cohort: DataFrame) -> DataFrame:
    """Batches of fewer than two subjects, which can't be harmonised."""
    return cohort.groupBy("batch").agg(F.count("*").alias("n")).where("n < 2")


def combat_mean_only(data: DataFrame) -> DataFrame:
    """Shifts alone: batch means shrunk to their prior, scales left as they are."""
    standard = standardize(data)
    effects = batch_effects(standard)
    priors = effects.groupBy("batch").agg(F.avg("gamma_hat").alias("g_bar"), F.var_samp("gamma_hat").alias("t2"))
    star = effects.join(priors, "batch").select("batch", "feature", ((F.col("t2") * F.col("gamma_hat") + F.col("g_bar")) / (F.col("t2") + 1)).alias("gamma"))
    joined = standard.join(star, ["batch", "feature"])
    return joined.select("subject", "feature", "batch", ((F.col("s") - F.col("gamma")) * F.col("sd") + F.col("grand")).alias("y"))


def combat_reference(data: DataFrame, reference: int, columns: list[str] | None = None, eb: bool = False, mean_only: bool = False) -> DataFrame:
    """Batches brought to a reference batch, whose own values stay, beside covariates.

    With ``eb`` effects are shrunk to each batch's priors; ``mean_only`` leaves
    scales as they are. A missing y stays missing, as does one with a missing
    covariate outside the reference. A constant feature keeps its values; one
    that the reference batch lacks has null elsewhere.
    """
    columns = columns or []
    effects = model_effects(data, columns, reference)
    names = ["batch", "feature", "gamma", "delta", "grand", "sd", "slopes"]
    one = F.lit(1.0)
    if mean_only and eb:
        priors = effects.groupBy("batch").agg(F.avg("gamma_hat").alias("g_bar"), F.var_samp("gamma_hat").alias("t2"))
        gamma = F.coalesce((F.col("t2") * F.col("gamma_hat") + F.col("g_bar")) / (F.col("t2") + 1), F.col("gamma_hat"))
        found = effects.join(priors, "batch").withColumn("gamma", gamma).withColumn("delta", one)
    elif eb:
        found = effects.join(shrunk(effects.where(F.col("batch") != reference)), ["batch", "feature"], "left").withColumns({"gamma": F.coalesce("gamma", F.lit(0.0)), "delta": F.coalesce("delta", one)})
    else:
        found = effects.withColumn("gamma", F.col("gamma_hat")).withColumn("delta", one if mean_only else F.col("delta_hat"))
    moved = apply_model(data.where(F.coalesce(F.col("batch") != reference, F.lit(True))), columns, found.select(*names))
    return data.where(F.col("batch") == reference).select("subject", "feature", "batch", "y").unionByName(moved)


def combat_nonparametric(data: DataFrame) -> DataFrame:
    """Effects as means over the other features' effects, weighted by their likelihood; a self-join within batches."""
    standard = standardize(data)
    effects = batch_effects(standard)
    a = effects.select("batch", F.col("feature").alias("f"), "n", "sum_s", "sum_s2")
    b = effects.select(F.col("batch").alias("batch_"), F.col("feature").alias("g_"), "gamma_hat", "delta_hat")
    squares = F.col("sum_s2") - 2 * F.col("gamma_hat") * F.col("sum_s") + F.col("n") * F.col("gamma_hat") ** 2
    log = -F.col("n") / 2 * F.log(2 * 3.141592653589793 * F.col("delta_hat")) - squares / (2 * F.col("delta_hat"))
    pairs = a.join(b, (F.col("batch") == F.col("batch_")) & (F.col("f") != F.col("g_"))).select("batch", F.col("f").alias("feature"), "gamma_hat", "delta_hat", log.alias("log"))
    top = pairs.groupBy("batch", "feature").agg(F.max("log").alias("top"))
    weighted = pairs.join(top, ["batch", "feature"]).withColumn("w", F.exp(F.col("log") - F.col("top")))
    star = weighted.groupBy("batch", "feature").agg((F.sum(F.col("w") * F.col("gamma_hat")) / F.sum("w")).alias("gamma"), (F.sum(F.col("w") * F.col("delta_hat")) / F.sum("w")).alias("delta"))
    joined = standard.join(star, ["batch", "feature"])
    return joined.select("subject", "feature", "batch", ((F.col("s") - F.col("gamma")) / F.sqrt("delta") * F.col("sd") + F.col("grand")).alias("y"))


def apply_estimates(data: DataFrame, estimates: DataFrame) -> DataFrame:
    """Stored estimates (batch, feature, gamma, delta, grand, sd) on new rows; rows of unknown batches raise."""
    joined = data.join(estimates, ["batch", "feature"], "left")
    known = F.when(F.col("gamma").isNull(), F.raise_error(F.concat(F.lit("no estimates for batch "), F.col("batch").cast("string"))).cast("double"))
    adjusted = ((F.col("y") - F.col("grand")) / F.col("sd") - F.col("gamma")) / F.sqrt("delta") * F.col("sd") + F.col("grand")
    return joined.select("subject", "feature", "batch", F.coalesce(known, adjusted).alias("y"))


def covbat(data: DataFrame, share: float = 0.95, columns: list[str] | None = None) -> DataFrame:
    """ComBat, then again without shrinking on the leading principal scores, which hold covariance between features.

    Every row given comes back, with null where y (or a covariate) is missing. A
    feature that a subject lacks counts as its mean in the subject's scores;
    values that repeat a subject's feature enter them by their mean and keep
    their distance from it. What ``columns`` explain is kept in the first step.
    """
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    once = combat_with_model(data, columns) if columns else combat(data)
    # What only rounding sets apart is constant.
    spread = F.when(F.stddev_pop("y") > 1e-10 * F.max(F.abs("y")), F.stddev_pop("y")).otherwise(0.0)
    scale = once.groupBy("feature").agg(F.avg("y").alias("m"), spread.alias("s"))
    z = once.join(scale, "feature").withColumn("z", F.when(F.col("y").isNotNull(), F.coalesce(F.try_divide(F.col("y") - F.col("m"), F.col("s")), F.lit(0.0))))
    features = [r["feature"] for r in scale.select("feature").orderBy("feature").collect()]
    means = z.groupBy("subject", "batch", "feature").agg(F.avg("z").alias("z"))
    rows = means.groupBy("subject", "batch").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("zs"))
    filled = F.transform(F.array(*[F.lit(f) for f in features]), lambda f: F.coalesce(F.try_element_at("zs", f), F.lit(0.0)))
    packed = rows.select("subject", "batch", array_to_vector(filled).alias("v"))
    model = PCA(k=len(features), inputCol="v", outputCol="scores").fit(packed)
    kept = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share) + 1)
    axes = model.pc.toArray()
    scores = model.transform(packed).select("subject", "batch", F.posexplode(vector_to_array("scores")).alias("feature", "y"))
    again = combat(scores.where(F.col("feature") < kept), eb=False).unionByName(scores.where(F.col("feature") >= kept).select("subject", "feature", "batch", "y"))
    table = data.sparkSession.createDataFrame([(k, f, float(axes[n, k])) for k in range(len(features)) for n, f in enumerate(features)], "k int, feature string, axis double")
    back = again.withColumnRenamed("feature", "k").join(table, "k").groupBy("subject", "batch", "feature").agg(F.sum(F.col("y") * F.col("axis")).alias("z"))
    given = z.join(means.withColumnRenamed("z", "mean"), ["subject", "batch", "feature"]).select("subject", "batch", "feature", "m", "s", (F.col("z") - F.col("mean")).alias("off"))
    return given.join(back, ["subject", "batch", "feature"]).select("subject", "feature", "batch", ((F.col("z") + F.col("off")) * F.col("s") + F.col("m")).alias("y"))
