"""Mass-univariate statistics on long tables (subject, feature, y): one aggregation for all features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxara.functions.distributions import t_two_sided


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a normal score (rational approximation of erfc, relative error 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the published approximation.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


#: Classes of p for each halving of it, by which tests are ranked in two steps.
_CLASSES = 64


def false_discovery(tests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg, Bonferroni and Holm; p = 1 marks a test that wasn't made and stays 1.

    Tests are put into classes of p; numbers and minima of whole classes are
    carried on first, then each class ranks its own tests, so no task holds all.
    """
    keys = [*(by or []), "__class"]
    made = F.col("p") < 1
    # Ascending in p; p = 0 is a class below all others.
    place = F.when(F.col("p") > 0, F.floor(F.log2("p") * _CLASSES)).otherwise(F.lit(-1_000_000)).cast("long")
    held = tests.where(made).withColumn("__class", place)
    counts = held.groupBy(*keys).agg(F.count("*").alias("__in"))
    along = W.partitionBy(*(by or [])).orderBy("__class")
    whole = W.partitionBy(*(by or []))
    before = counts.select(*keys, (F.sum("__in").over(along) - F.col("__in")).alias("__before"), F.sum("__in").over(whole).alias("__n"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("p", "feature")) + F.col("__before")
    ranked = held.join(before, keys).withColumn("__rank", rank).withColumn("__step", F.col("__n") / F.col("__rank") * F.col("p"))
    least = ranked.groupBy(*keys).agg(F.min("__step").alias("__least"))
    later = least.select(*keys, F.min("__least").over(W.partitionBy(*(by or [])).orderBy(F.desc("__class")).rowsBetween(W.unboundedPreceding, -1)).alias("__later"))
    # From the last rank back: a window that grows is one pass, one that shrinks is read anew for every row.
    inner = F.min("__step").over(W.partitionBy(*keys).orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0))
    adjusted = ranked.join(later, keys).select(
        *tests.columns,
        F.least(inner, F.coalesce("__later", inner)).alias("q_bh"),
        F.least(F.lit(1.0), F.col("__n") * F.col("p")).alias("q_bonferroni"),
        ((F.col("__n") - F.col("__rank") + 1) * F.col("p")).alias("q_holm"),
    )
    others = tests.where(~F.coalesce(made, F.lit(False))).select(*tests.columns, *[F.lit(1.0).alias(q) for q in ("q_bh", "q_bonferroni", "q_holm")])
    return adjusted.unionByName(others)


def simple_ols(data: DataFrame, x: str) -> DataFrame:
    """y on an intercept and one covariate, per feature, from sums alone."""
    held = data.where(F.col("y").isNotNull() & F.col(x).isNotNull())
    s = held.groupBy("feature").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg("y").alias("my"), F.var_pop(x).alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop(x, "y").alias("cxy"))
    s = s.withColumn("slope", F.try_divide("cxy", "vx")).withColumn("df", F.col("n") - 2)
    rss = F.col("n") * (F.col("vy") - F.col("slope") * F.col("cxy"))
    se = F.sqrt(F.try_divide(rss, F.col("df")) / (F.col("n") * F.col("vx")))
    t = F.try_divide(F.col("slope"), se)
    out = s.select("feature", "n", "df", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "slope", se.alias("se"), t.alias("t"), (1 - F.try_divide(rss, F.col("n") * F.col("vy"))).alias("r2"), (F.col("slope") * F.sqrt(F.col("vx") * F.col("n") / (F.col("n") - 1)) / F.sqrt("vy")).alias("b"))
    return out.withColumn("d", 2 * F.col("t") / F.sqrt("df")).withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def two_covariates(data: DataFrame, x1: str, x2: str) -> DataFrame:
    """y on an intercept and two covariates, and the F test against leaving out the second."""
    held = data.where(F.col("y").isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    cov = lambda a, b: F.covar_pop(a, b)
    s = held.groupBy("feature").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), cov(x1, x1).alias("s11"), cov(x2, x2).alias("s22"), cov(x1, x2).alias("s12"), cov("y", x1).alias("sy1"), cov("y", x2).alias("sy2"), cov("y", "y").alias("syy"))
    det = F.col("s11") * F.col("s22") - F.col("s12") ** 2
    s = s.withColumn("b1", F.try_divide(F.col("sy1") * F.col("s22") - F.col("sy2") * F.col("s12"), det)).withColumn("b2", F.try_divide(F.col("sy2") * F.col("s11") - F.col("sy1") * F.col("s12"), det))
    full = F.col("n") * (F.col("syy") - F.col("b1") * F.col("sy1") - F.col("b2") * F.col("sy2"))
    reduced = F.col("n") * (F.col("syy") - F.try_divide(F.col("sy1") ** 2, F.col("s11")))
    df = F.col("n") - 3
    return s.select("feature", "n", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("intercept"), "b1", "b2", (1 - F.try_divide(full, F.col("n") * F.col("syy"))).alias("r2"), F.try_divide(reduced - full, full / df).alias("f"), df.alias("df"))


def residuals(data: DataFrame, x: str) -> DataFrame:
    """y without its linear part in x, per feature."""
    fit = simple_ols(data, x).select("feature", "intercept", "slope")
    return data.join(fit, "feature").select("subject", "feature", (F.col("y") - F.col("intercept") - F.col("slope") * F.col(x)).alias("y"))


def zscores(data: DataFrame, x: str, subset: DataFrame) -> DataFrame:
    """Residuals of a fit on the subset, for all, scaled by the subset's mean and population deviation."""
    inside = data.join(subset.select("subject").distinct(), "subject", "left_semi")
    fit = simple_ols(inside, x).select("feature", "intercept", "slope")
    left = data.join(fit, "feature").select("subject", "feature", (F.col("y") - F.col("intercept") - F.col("slope") * F.col(x)).alias("r"))
    scale = left.join(subset.select("subject").distinct(), "subject", "left_semi").groupBy("feature").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return left.join(scale, "feature").select("subject", "feature", F.try_divide(F.col("r") - F.col("m"), F.col("s")).alias("z"))


def pearson(data: DataFrame, x: str) -> DataFrame:
    s = data.where(F.col("y").isNotNull() & F.col(x).isNotNull()).groupBy("feature").agg(F.count("*").alias("n"), F.corr("y", x).alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") ** 2))
    return s.withColumn("t", t).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2))


def mid_rank(value: str, by: list[str]) -> Column:
    """Rank within the groups, ties sharing the mean of their ranks."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2.0


def spearman(data: DataFrame, x: str) -> DataFrame:
    held = data.where(F.col("y").isNotNull() & F.col(x).isNotNull())
    ranked = held.select("feature", mid_rank("y", ["feature"]).alias("ry"), mid_rank(x, ["feature"]).alias("rx"))
    s = ranked.groupBy("feature").agg(F.count("*").alias("n"), F.corr("ry", "rx").alias("rho"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") ** 2))
    return s.withColumn("p", F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(t_two_sided(t, F.col("n") - 2)))


def mann_whitney(data: DataFrame, a: str, b: str) -> DataFrame:
    """U of group b against a, rank-biserial effect, and the normal p-value with ties and continuity."""
    held = data.where(F.col("group").isin(a, b) & F.col("y").isNotNull())
    ranked = held.withColumn("r", mid_rank("y", ["feature"])).withColumn("ties", F.count("*").over(W.partitionBy("feature", "y")))
    s = ranked.groupBy("feature").agg(F.count_if(F.col("group") == a).alias("na"), F.count_if(F.col("group") == b).alias("nb"), F.sum(F.when(F.col("group") == b, F.col("r"))).alias("rb"), F.sum((F.col("ties") ** 2 - 1)).alias("ties"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    s = s.withColumn("u", F.col("rb") - nb * (nb + 1) / 2)
    sigma = F.sqrt(na * nb / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.abs(F.col("u") - na * nb / 2) - 0.5, sigma)
    return s.select("feature", "na", "nb", "u", (1 - F.try_divide(2 * F.col("u"), na * nb)).alias("effect"), F.least(F.lit(1.0), normal_two_sided(F.greatest(z, F.lit(0.0)))).alias("p"))


def _exact_upper(na: int, nb: int) -> np.ndarray:
    """P(U >= u) for every u, from the numbers of orders with each U; whole numbers, exact up to 2^53."""
    small, large = sorted((na, nb))
    counts = np.zeros(small * large + 1)
    counts[0] = 1
    for k in range(1, small + 1):  # from k - 1 of the smaller group to k of them
        for start in range(k):
            counts[start::k] = np.cumsum(counts[start::k])
        gone = counts[: len(counts) - large - k].copy()
        counts[large + k :] -= gone
    return np.cumsum(counts[::-1])[::-1] / counts.sum()


def exact_u(tests: DataFrame) -> DataFrame:
    """Adds ``p_exact`` to (na, nb, u) of tests without ties: twice the upper tail, 1 at most.

    The distribution is made once for each pair of group sizes in a batch; only
    the distinct (na, nb, u) go through it.
    """

    def run(batches):
        for b in batches:
            na, nb, u = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb", "u"))
            p = np.empty(len(u))
            for x, y in {*zip(na.tolist(), nb.tolist(), strict=True)}:
                at = (na == x) & (nb == y)
                p[at] = np.minimum(1, 2 * _exact_upper(x, y)[np.maximum(u[at], x * y - u[at])])
            yield pa.RecordBatch.from_arrays([b.column("na"), b.column("nb"), b.column("u"), pa.array(p)], names=["na", "nb", "u", "p_exact"])

    keys = [F.col(c).cast("double").alias(c) for c in ("na", "nb", "u")]
    table = tests.select(*keys).distinct().mapInArrow(run, "na double, nb double, u double, p_exact double")
    return tests.join(table, ["na", "nb", "u"])


#: Groups of so many at most, without ties, have exact probabilities.
EXACT_GROUP = 8


def mann_whitney_full(data: DataFrame, a: str, b: str, level: float = 0.05) -> DataFrame:
    """Mann-Whitney tests of every feature with exact p where a group is small and nothing ties, and q.

    Returns feature, na, nb, u, effect, p, q, and the effect where p or q is not
    above the level, else 0 (effect_trend, effect_fdr).
    """
    ties = data.where(F.col("group").isin(a, b) & F.col("y").isNotNull()).groupBy("feature").agg((F.count("*") > F.countDistinct("y")).alias("tied"))
    rough = mann_whitney(data, a, b).join(ties, "feature")
    small = ~F.col("tied") & (F.least("na", "nb") <= EXACT_GROUP) & (F.least("na", "nb") > 0)
    exact = exact_u(rough.where(small)).withColumn("p", F.col("p_exact")).select(*rough.columns)
    return with_q(rough.where(~small).unionByName(exact).drop("tied"), "effect", level)


def with_q(tests: DataFrame, effect: str, level: float = 0.05) -> DataFrame:
    """Adds q, and the effect where p or q is at most the level, else 0; a test without p has q 1."""
    corrected = false_discovery(tests).drop("q_bonferroni", "q_holm").withColumnRenamed("q_bh", "q")
    kept = lambda c: F.when(F.coalesce(F.col(c), F.lit(1.0)) <= level, F.col(effect)).otherwise(0.0)
    return corrected.withColumn(f"{effect}_trend", kept("p")).withColumn(f"{effect}_fdr", kept("q"))


#: Critical values of A-squared with estimated mean and deviation, and their levels.
NORMAL_CRITICAL = ((0.576, 0.15), (0.656, 0.10), (0.787, 0.05), (0.918, 0.025), (1.092, 0.01))


def normality(data: DataFrame) -> DataFrame:
    """A-squared of every feature with the smallest level whose critical value it reaches as p, else 1.

    Critical values are adjusted to the number of values and rounded to three
    digits. ``log_p`` is -log10 p where p is below 0.05, else 0.
    """
    n = data.where("y is not null").groupBy("feature").agg(F.count("*").cast("double").alias("n"))
    p = F.lit(1.0)
    for critical, level in NORMAL_CRITICAL:
        reached = F.col("a2") >= F.round(critical / (1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n"))), 3)
        p = F.when(reached, F.lit(level)).otherwise(p)
    out = anderson_darling(data).join(n, "feature").select("feature", "n", "a2", p.alias("p"))
    return out.withColumn("log_p", F.when(F.col("p") < 0.05, -F.log10("p")).otherwise(0.0))


def pooled_t(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Pooled t of ln(y + 1) between two groups per feature, and d = 2 t / sqrt(n - 1)."""
    y = F.log1p("y")
    g = lambda f, name: f(F.when(F.col("group") == name, y))
    s = edges.where(F.col("group").isin(a, b) & (F.col("y") > -1)).groupBy("feature").agg(F.count_if(F.col("group") == a).alias("n0"), F.count_if(F.col("group") == b).alias("n1"), g(F.avg, a).alias("m0"), g(F.avg, b).alias("m1"), g(F.var_samp, a).alias("v0"), g(F.var_samp, b).alias("v1"))
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1"))))
    return s.select("feature", "n0", "n1", t.alias("t")).withColumn("d", 2 * F.col("t") / F.sqrt(F.col("n0") + F.col("n1") - 1)).withColumn("p", t_two_sided(F.col("t"), F.col("n0") + F.col("n1") - 2))


def _numbered(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``rn``: each row's place, from 1, along the column ``hash`` within ``by``.

    Ranges of the hash are counted and their counts summed first, then the rows
    of each range are numbered, so no task holds a whole group.
    """
    ranged = rows.withColumn("part", F.floor(F.shiftrightunsigned("hash", 33) * parts / 2**31))
    counts = ranged.groupBy(*by, "part").agg(F.count("*").alias("rows"))
    before = counts.select(*by, "part", (F.sum("rows").over(W.partitionBy(*by).orderBy("part")) - F.col("rows")).alias("before"))
    within = F.row_number().over(W.partitionBy(*by, "part").orderBy("hash", "subject", "group"))
    return ranged.withColumn("rn", within).join(before, [*by, "part"]).withColumn("rn", F.col("rn") + F.col("before")).drop("part", "before", "hash")


def deal_labels(people: DataFrame, permutations: int, part_rows: int = 4096) -> DataFrame:
    """(subject, perm, new): in each permutation the groups of (subject, group) are dealt anew by a hash."""
    parts = people.count() // part_rows + 1
    perms = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    first = _numbered(people.withColumn("hash", F.xxhash64("subject")), [], parts).select("subject", "rn", perms)
    shuffled = people.select("subject", "group", perms).withColumn("hash", F.xxhash64("subject", "perm"))
    return first.join(_numbered(shuffled, ["perm"], parts).select("perm", "rn", F.col("group").alias("new")), ["perm", "rn"]).select("subject", "perm", "new")


def max_t_permutation(edges: DataFrame, a: str, b: str, permutations: int = 100, level: float = 0.95) -> DataFrame:
    """Max-T test: each permutation deals the subjects' labels anew by a hash; q is the share of larger maxima."""
    held = edges.where(F.col("group").isin(a, b))
    people = held.select("subject", "group").distinct()
    labels = deal_labels(people, permutations)
    mixed = held.drop("group").join(labels, "subject").select(F.concat_ws("|", "perm", "feature").alias("feature"), F.col("new").alias("group"), "y")
    maxima = pooled_t(mixed, a, b).groupBy(F.substring_index("feature", "|", 1).alias("perm")).agg(F.max(F.abs("t")).alias("top"))
    # One row: the critical value and the permutations' maxima, as many as were asked for.
    summary = maxima.agg(F.percentile("top", F.lit(level)).alias("critical"), F.collect_list("top").alias("tops")).first()
    tops = F.array(*[F.lit(x) for x in sorted(summary["tops"])]).cast("array<double>")
    larger = F.size(F.filter(tops, lambda x: x > F.abs(F.col("t")))) / F.lit(permutations)
    critical = F.lit(summary["critical"]).cast("double")
    return pooled_t(held, a, b).select("feature", "t", critical.alias("critical"), F.when(F.abs("t") >= critical, larger).otherwise(F.lit(1.0)).alias("q"))


def icc(ratings: DataFrame) -> DataFrame:
    """ICC(3,1) per feature of (feature, subject, session, y), complete designs."""
    s = ratings.groupBy("feature", "subject", "session").agg(F.avg("y").alias("y"))
    total = s.groupBy("feature").agg(F.avg("y").alias("g"), F.countDistinct("subject").alias("n"), F.countDistinct("session").alias("k"), (F.var_pop("y") * F.count("*")).alias("sst"))
    rows = s.groupBy("feature", "subject").agg(F.avg("y").alias("m")).groupBy("feature").agg((F.var_pop("m") * F.count("*")).alias("r"))
    columns = s.groupBy("feature", "session").agg(F.avg("y").alias("m")).groupBy("feature").agg((F.var_pop("m") * F.count("*")).alias("c"))
    j = total.join(rows, "feature").join(columns, "feature")
    ssr, ssc = F.col("k") * F.col("r"), F.col("n") * F.col("c")
    msr, mse = ssr / (F.col("n") - 1), (F.col("sst") - ssr - ssc) / ((F.col("n") - 1) * (F.col("k") - 1))
    return j.select("feature", "n", "k", F.try_divide(msr - mse, msr + (F.col("k") - 1) * mse).alias("icc"))


def anderson_darling(data: DataFrame) -> DataFrame:
    """A-squared statistic of normality per feature."""
    held = data.where("y is not null")
    w = W.partitionBy("feature")
    z = (F.col("y") - F.avg("y").over(w)) / F.stddev_samp("y").over(w)
    ranked = held.select("feature", z.alias("z")).select("feature", "z", F.row_number().over(w.orderBy("z")).alias("i"), F.row_number().over(w.orderBy(F.desc("z"))).alias("i_back"))
    upper = F.greatest(normal_two_sided(F.col("z")) / 2, F.lit(1e-300))
    below = F.when(F.col("z") < 0, upper).otherwise(1 - upper)
    above = F.when(F.col("z") < 0, 1 - upper).otherwise(upper)
    terms = (2 * F.col("i") - 1) * F.log(below) + (2 * F.col("i_back") - 1) * F.log(above)
    return ranked.groupBy("feature").agg((-F.count("*") - F.sum(terms) / F.count("*")).alias("a2"))
