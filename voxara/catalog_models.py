"""Queries of model fits: least squares with all its outputs, z-scores, edges, harmonisation with covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxara.operators import harmonize, regression
from voxara.plans.filters import cohort_filter, design
from voxara.registry import p_t, query, rounded

_TWO = ["x", "x2"]
#: Fit on two covariates from centred moments: inverse of their covariance, coefficients, residual squares.
_FIT = (
    "WITH s AS (SELECT feature, count(*) AS n, avg(y) AS my, avg(x) AS m1, avg(x2) AS m2, var_pop(x) AS s11, var_pop(x2) AS s22, covar_pop(x, x2) AS s12, covar_pop(y, x) AS a, covar_pop(y, x2) AS b, var_pop(y) AS syy FROM {f} GROUP BY 1), "
    "c AS (SELECT *, s11 * s22 - s12 * s12 AS det, (a * s22 - b * s12) / (s11 * s22 - s12 * s12) AS b1, (b * s11 - a * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s), "
    "r AS (SELECT *, n * (syy - b1 * a - b2 * b) AS rss, n * (syy - a * a / s11) AS less, n - 3 AS df, my - b1 * m1 - b2 * m2 AS b0 FROM c), "
    "v AS (SELECT *, rss / df AS s2 FROM r), "
)


@query(
    _FIT
    + "e AS (SELECT feature, n, df, 'x' AS term, b1 AS coefficient, sqrt(s2 * s22 / (n * det)) AS error, b1 * sqrt(s11 * n / (n - 1)) / sqrt(syy) AS b FROM v UNION ALL SELECT feature, n, df, 'x2', b2, sqrt(s2 * s11 / (n * det)), b2 * sqrt(s22 * n / (n - 1)) / sqrt(syy) FROM v), "
    + f"p AS (SELECT *, coefficient / error AS t, {p_t('coefficient / error', 'df')} AS p FROM e), k AS (SELECT *, count(*) OVER (PARTITION BY term) AS m, row_number() OVER (PARTITION BY term ORDER BY p, feature) AS k FROM p) "
    + "SELECT feature, term, n, df, round(coefficient, 5) + 0.0 AS coefficient, round(error, 5) AS error, round(t, 6) + 0.0 AS t, round(b, 6) + 0.0 AS b, round(2 * t / sqrt(df), 6) + 0.0 AS d, round(p, 6) AS p, round(min(m * p / k) OVER (PARTITION BY term ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q FROM k",
    f="features",
)
def ols_full(f):
    out = regression.ols_terms(f, _TWO).where("term <> 'Intercept'").drop("half_width")
    return rounded(rounded(out, "coefficient", "error", places=5), "t", "b", "d", "p", "q")


@query(
    _FIT + f"i AS (SELECT feature, df, b1, sqrt(s2 * s22 / (n * det)) AS error FROM v) SELECT feature, df, 0.05::DOUBLE AS outside FROM i",
    f="features",
)
def ols_interval(f):
    """The half-width is the error times the t that is exceeded with probability 0.05, which its own p must return."""
    from voxara.functions.distributions import t_two_sided

    out = regression.ols_terms(f, _TWO).where("term = 'x'")
    return out.select("feature", "df", F.round(t_two_sided(F.col("half_width") / F.col("error"), F.col("df")), 9).alias("outside"))


@query(
    _FIT
    + f"t AS (SELECT *, n * syy AS tss, (less - rss) / s2 AS f2 FROM v) SELECT feature, n, df, round(1 - rss / tss, 6) AS r2, round(1 - rss / tss * (n - 1) / df, 6) + 0.0 AS r2_adj, round((tss - rss) / 2 / s2, 5) AS f, 2 AS df_model, round(f2, 5) AS f_reduced, 1 AS df_terms, round(pow(df / (df + (tss - rss) / s2), df / 2.0), 6) AS p, round({p_t('sqrt(f2)', 'df')}, 6) AS p_reduced FROM t",
    f="features",
)
def ols_reduced_f(f):
    return rounded(rounded(regression.ols_models(f, _TWO, ["x"]), "r2", "r2_adj", "p", "p_reduced"), "f", "f_reduced", places=5)


@query(
    _FIT + f"t AS (SELECT sum(rss) AS rss, sum(less) AS less, max(df) AS df FROM v), g AS (SELECT (less - rss) / (rss / df) AS f, df FROM t) SELECT round(f, 5) AS f, 1 AS df_terms, df, round({p_t('sqrt(f)', 'df')}, 6) AS p FROM g",
    f="features",
)
def model_comparison(f):
    return rounded(rounded(regression.compare_models(f, _TWO, ["x"]), "p"), "f", places=5)


@query(_FIT + "o AS (SELECT * FROM {f}) SELECT o.subject, o.feature, round(o.y - b2 * o.x2, 3) + 0.0 AS y FROM o JOIN v ON o.feature = v.feature", f="features")
def ols_residualised(f):
    return rounded(regression.residualise(f, _TWO, ["x2"]), "y", places=3)


@query(
    "WITH c AS (SELECT feature, regr_intercept(y, x) AS i, regr_slope(y, x) AS s FROM {f} WHERE grp = 'BUILDING' GROUP BY 1) SELECT subject, f.feature, round(y - i - s * x, 3) + 0.0 AS y FROM {f} f JOIN c ON f.feature = c.feature WHERE grp <> 'BUILDING'",
    f="features",
)
def ols_other_cohort(f):
    fit = regression.ols_terms(f.where(cohort_filter(f, "grp=BUILDING")), ["x"]).select("feature", "term", "coefficient")
    return rounded(regression.residuals_of(fit, ["x"], f.where(cohort_filter(f, "grp!=BUILDING"))), "y", places=3)


_IN = _FIT.replace("FROM {f} GROUP BY 1", "FROM {f} WHERE x >= 0 GROUP BY 1")


@query(
    _IN
    + "o AS (SELECT * FROM {f}), e AS (SELECT o.subject, o.feature, o.x, o.y - b0 - b1 * o.x - b2 * o.x2 AS r FROM o JOIN v ON o.feature = v.feature), m AS (SELECT feature, avg(r) AS m, stddev_pop(r) AS s FROM e WHERE x >= 0 GROUP BY 1) SELECT subject, e.feature, round((r - m) / s, 5) + 0.0 AS z FROM e JOIN m ON e.feature = m.feature",
    f="features",
)
def zscores_formula(f):
    return rounded(regression.zscores_by_formula(f, _TWO, f.where(cohort_filter(f, "x>=0"))), "z", places=5)


@query("SELECT subject, f.feature, round((y - m) / s, 6) + 0.0 AS z FROM {f} f JOIN (SELECT feature, avg(y) AS m, stddev_pop(y) AS s FROM {f} GROUP BY 1) p ON f.feature = p.feature", f="features")
def zscores_plain(f):
    return rounded(regression.zscores_by_formula(f, [], f), "z")


@query("SELECT f.subject, f.feature, round(x - m, 6) + 0.0 AS x, round((x - m) * x2, 4) + 0.0 AS \"x:x2\" FROM {f} f, (SELECT avg(x) AS m FROM {f}) a", f="features")
def design_centred(f):
    planned, _ = design(f.select("subject", "feature", "x", "x2"), "x * x2", centre=("x",))
    return rounded(rounded(planned.select("subject", "feature", "x", "x:x2"), "x"), "x:x2", places=4)


_EDGE = "(SELECT i, j, avg(w) AS w FROM {c} WHERE i < j GROUP BY 1, 2)"


def _edges(c):
    return c.where("i < j").groupBy("i", "j").agg(F.avg("w").alias("w"))


@query(f"SELECT a.i, b.j, round(coalesce(e.w, 0), 6) + 0.0 AS w FROM (SELECT CAST(range AS INT) AS i FROM range(8)) a, (SELECT CAST(range AS INT) AS j FROM range(8)) b LEFT JOIN {_EDGE} e ON e.i = least(a.i, b.j) AND e.j = greatest(a.i, b.j)", c="connectome")
def edges_to_matrix(c):
    return rounded(regression.to_matrix(_edges(c), "w", list(range(8)), 0.0), "w")


@query(f"SELECT i, j, round(CASE WHEN abs(w) < 0.01 THEN 0 ELSE w END, 6) + 0.0 AS w FROM {_EDGE}", c="connectome")
def edges_thresholded(c):
    return rounded(regression.thresholded(_edges(c), "w", "w", 0.01), "w")


@query("WITH v AS (SELECT w FROM {c} WHERE w > 0), e AS (SELECT min(w) AS a, max(w) AS b FROM v), b AS (SELECT least(floor((w - a) / ((b - a) / 50)), 49)::INT AS bin, a, b FROM v, e) SELECT bin, count(*) AS n, round(min(a + bin * (b - a) / 50), 6) AS \"from\" FROM b GROUP BY 1", c="connectome")
def edges_histogram(c):
    return rounded(regression.edge_histogram(c), "from")


@query("SELECT i, j, count(*) AS n, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std FROM {c} WHERE w > 0 GROUP BY 1, 2", c="connectome")
def edges_distribution(c):
    return rounded(regression.edge_distribution(c).select("i", "j", "n", "mean", "std"), "mean", "std")


@query(c="connectome")
def edges_gamma(c):
    """Shape and scale of each edge's gamma distribution; tests hold the likelihood's equation against numpy."""
    return regression.edge_distribution(c).select("i", "j", "shape", "scale")


_COVARIATE = (
    "WITH g AS (SELECT feature, batch, avg(y) AS my, avg(x) AS mx, count(*) AS n FROM {f} GROUP BY 1, 2), d AS (SELECT f.*, f.y - my AS dy, f.x - mx AS dx FROM {f} f JOIN g ON f.feature = g.feature AND f.batch = g.batch), "
    "b AS (SELECT feature, sum(dx * dy) / sum(dx * dx) AS b FROM d GROUP BY 1), m AS (SELECT g.feature, sum(n * (my - b * mx)) / sum(n) AS grand FROM g JOIN b ON g.feature = b.feature GROUP BY 1), "
    "v AS (SELECT d.feature, sqrt(sum(pow(dy - b * dx, 2)) / count(*)) AS sd FROM d JOIN b ON d.feature = b.feature GROUP BY 1), "
    "s AS (SELECT f.subject, f.feature, f.batch, (f.y - grand - b * f.x) / sd AS s, grand + b * f.x AS part, sd FROM {f} f JOIN b ON f.feature = b.feature JOIN m ON f.feature = m.feature JOIN v ON f.feature = v.feature), "
    "e AS (SELECT feature, batch, avg(s) AS g, var_samp(s) AS d FROM s GROUP BY 1, 2) "
)


@query(_COVARIATE + "SELECT s.subject, s.feature, s.batch, round((s - g) / sqrt(d) * sd + part, 3) + 0.0 AS y FROM s JOIN e ON s.feature = e.feature AND s.batch = e.batch", f="features")
def combat_covariates(f):
    return rounded(harmonize.combat_with_model(f.select("subject", "feature", "batch", "y", "x"), ["x"], eb=False), "y", places=3)


_SHRUNK = (
    _COVARIATE.replace("WITH g AS", "WITH RECURSIVE g AS")
    + ", h AS (SELECT feature, batch, count(*) AS n, avg(s) AS gh, var_samp(s) AS dh, sum(s) AS s1, sum(s * s) AS s2 FROM s GROUP BY 1, 2), p AS (SELECT batch, avg(gh) AS gb, var_pop(gh) AS t2, avg(dh) AS m, var_samp(dh) AS v FROM h GROUP BY 1), "
    + "q AS (SELECT h.*, gb, t2, (2 * v + m * m) / v AS a, (m * v + m * m * m) / v AS bb FROM h JOIN p ON h.batch = p.batch), "
    + "i AS (SELECT feature, batch, 0 AS k, gh AS g, dh AS d FROM q UNION ALL SELECT feature, batch, k + 1, g, (bb + 0.5 * (s2 - 2 * g * s1 + n * g * g)) / (n / 2.0 + a - 1) FROM (SELECT q.*, i.k, (t2 * n * gh + i.d * gb) / (t2 * n + i.d) AS g FROM i JOIN q ON i.feature = q.feature AND i.batch = q.batch WHERE k < 60)) "
)


@query(_SHRUNK + "SELECT s.subject, s.feature, s.batch, round((s - i.g) / sqrt(i.d) * sd + part, 3) + 0.0 AS y FROM s JOIN i ON s.feature = i.feature AND s.batch = i.batch AND k = 60", f="features")
def combat_covariates_shrunk(f):
    return rounded(harmonize.combat_with_model(f.select("subject", "feature", "batch", "y", "x"), ["x"], eb=True), "y", places=3)


_PLAIN = _SHRUNK.replace("sum(dx * dy) / sum(dx * dx) AS b", "0.0 AS b")


@query(_PLAIN + "SELECT s.subject, s.feature, s.batch, round((s - i.g) / sqrt(i.d) * sd + part, 3) + 0.0 AS y FROM s JOIN i ON s.feature = i.feature AND s.batch = i.batch AND k = 60", f="features")
def combat_shrunk(f):
    return rounded(harmonize.combat(f.select("subject", "feature", "batch", "y")), "y", places=3)


_HOLES = "(SELECT subject, feature, batch, CASE WHEN subject % 11 = 0 THEN NULL WHEN feature = '5-LOW' THEN 7.0 ELSE y END AS y FROM {f})"


@query(
    f"WITH h AS {_HOLES}, g AS (SELECT feature, batch, avg(y) AS m, count(y) AS n, var_pop(y) AS v FROM h GROUP BY 1, 2), p AS (SELECT feature, sum(n * m) / sum(n) AS grand, sqrt(sum(n * v) / sum(n)) AS sd FROM g GROUP BY 1), s AS (SELECT h.*, grand, sd, (y - grand) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS s FROM h JOIN p ON h.feature = p.feature), e AS (SELECT feature, batch, avg(s) AS g, var_samp(s) AS d FROM s GROUP BY 1, 2) SELECT subject, s.feature, s.batch, round((s - g) / sqrt(CASE WHEN d = 0 THEN 1 ELSE d END) * CASE WHEN sd = 0 THEN 1 ELSE sd END + grand, 3) + 0.0 AS y FROM s JOIN e ON s.feature = e.feature AND s.batch = e.batch",
    f="features",
)
def combat_missing(f):
    """A missing value stays missing, and a constant feature keeps its values."""
    y = F.when(F.col("subject") % 11 == 0, F.lit(None).cast("double")).when(F.col("feature") == "5-LOW", 7.0).otherwise(F.col("y"))
    return rounded(harmonize.combat(f.select("subject", "feature", "batch", y.alias("y")), eb=False), "y", places=3)


_HOLED = "(SELECT subject, feature, batch, CASE WHEN subject % 11 = 0 THEN NULL WHEN feature LIKE '5%' THEN 7.0 ELSE y END AS y FROM {f})"


@query(
    f"WITH h AS {_HOLED}, b AS (SELECT feature, avg(y) AS m, CASE WHEN stddev_pop(y) > 1e-9 THEN stddev_pop(y) ELSE 1 END AS s FROM h WHERE batch = 0 GROUP BY 1), e AS (SELECT batch, h.feature, avg((y - m) / s) AS g, CASE WHEN var_samp(y) > 1e-9 THEN stddev_samp((y - m) / s) ELSE 1 END AS d FROM h JOIN b ON h.feature = b.feature WHERE y IS NOT NULL GROUP BY 1, 2) "
    "SELECT subject, h.feature, h.batch, round(CASE WHEN h.batch = 0 THEN y ELSE ((y - m) / s - g) / d * s + m END, 3) + 0.0 AS y FROM h LEFT JOIN b ON h.feature = b.feature LEFT JOIN e ON h.batch = e.batch AND h.feature = e.feature",
    f="features",
)
def combat_reference_holes(f):
    """Batches brought to the first one where values are missing and one feature is constant."""
    y = F.when(F.col("subject") % 11 == 0, F.lit(None)).when(F.col("feature").startswith("5"), 7.0).otherwise(F.col("y"))
    return rounded(harmonize.combat_reference(f.select("subject", "feature", "batch", y.cast("double").alias("y")), 0), "y", places=3)


@query(f="features")
def covbat_covariates(f):
    """Covariance harmonised beside a covariate, where values are missing."""
    y = F.when(F.col("subject") % 11 != 0, F.col("y"))
    return harmonize.covbat(f.select("subject", "feature", "batch", y.alias("y"), "x"), columns=["x"])
