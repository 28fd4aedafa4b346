"""Queries of structural connectomes, and whole results of operators that other queries show in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxara.operators import images, matrices, orientation, regression, roi, structural, tensor, tracks
from voxara.registry import p_t, query, rounded

# Structural connectomes.
_V = "SELECT subject, streamline, seq, CAST(floor(x) AS INT) AS i, CAST(floor(y) AS INT) AS j, CAST(floor(z) AS INT) AS k, x, y, z FROM {p}"
_LABELS = "(SELECT DISTINCT subject, i, j, k, abs(i + j * 3 + k) % 6 AS label FROM v)"


def _labels(p):
    placed = tracks._voxel(p).select("subject", "i", "j", "k").distinct()
    return placed.withColumn("label", F.abs(F.col("i") + F.col("j") * 3 + F.col("k")) % 6)


def _weights(p):
    return p.select("subject", "streamline").distinct().withColumn("weight", (1 + F.col("streamline") % 3).cast("double"))


@query(
    f"WITH v AS MATERIALIZED ({_V}), a AS MATERIALIZED {_LABELS}, e AS (SELECT subject, streamline, unnest([arg_min([i, j, k], seq), arg_max([i, j, k], seq)]) AS place FROM v GROUP BY 1, 2), "
    "n AS (SELECT e.subject, e.streamline, min(label) AS i, max(label) AS j FROM e JOIN a ON a.subject = e.subject AND a.i = place[1] AND a.j = place[2] AND a.k = place[3] WHERE label <> 0 GROUP BY 1, 2 HAVING count(*) = 2 AND min(label) <> max(label)), "
    "s AS (SELECT subject, streamline, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS s FROM v WINDOW w AS (PARTITION BY subject, streamline ORDER BY seq)), l AS (SELECT subject, streamline, sum(s) AS l FROM s GROUP BY 1, 2), "
    "c AS (SELECT n.subject, n.i, n.j, count(*)::DOUBLE AS count, coalesce(sum(1 / nullif(l, 0)), 0) AS by_length, sum(1 + streamline % 3)::DOUBLE AS weighted, coalesce(sum((1 + streamline % 3) / nullif(l, 0)), 0) AS weighted_by_length FROM n JOIN l USING (subject, streamline) GROUP BY 1, 2, 3), "
    "m AS (SELECT subject, label, count(*) AS m FROM a WHERE label <> 0 GROUP BY 1, 2), u AS (SELECT c.subject, c.i, c.j, count, round(count * 2 / (x.m + y.m), 8) AS by_volume, round(by_length, 8) AS by_length, weighted, round(weighted * 2 / (x.m + y.m), 8) AS weighted_by_volume, round(weighted_by_length, 8) AS weighted_by_length FROM c JOIN m x ON c.subject = x.subject AND c.i = x.label JOIN m y ON c.subject = y.subject AND c.j = y.label) "
    "SELECT * FROM u UNION ALL SELECT subject, j, i, count, by_volume, by_length, weighted, weighted_by_volume, weighted_by_length FROM u",
    p="points",
)
def structural_connectomes(p):
    """Counts, volumes and lengths, plain and weighted, of every two labels."""
    return rounded(structural.connectomes(p, _labels(p), _weights(p)), "by_volume", "by_length", "weighted_by_volume", "weighted_by_length", places=8)


@query(f"WITH v AS ({_V}), e AS (SELECT DISTINCT subject, streamline, unnest([arg_min([i, j, k], seq), arg_max([i, j, k], seq)]) AS place FROM v GROUP BY 1, 2) SELECT subject, place[1] AS i, place[2] AS j, place[3] AS k, sum(1 + streamline % 3)::DOUBLE AS value FROM e GROUP BY 1, 2, 3, 4", p="points")
def track_end_density(p):
    return structural.end_density(p, _weights(p))


_PARTS = "(SELECT subject, i, j, k, unnest([0, 1, 2]) AS class, unnest([value, value * 2, CASE WHEN value > 0.05 THEN 0.1 ELSE 0 END]) AS value FROM {v})"


@query(f"SELECT subject, i, j, k, class, round(coalesce(value / nullif(sum(value) OVER (PARTITION BY subject, i, j, k), 0), 0), 9) AS value FROM {_PARTS}", v="voxels")
def class_shares(v):
    parts = F.array(F.col("value"), F.col("value") * 2, F.when(F.col("value") > 0.05, 0.1).otherwise(0.0))
    return rounded(structural.class_shares(v.select("subject", "i", "j", "k", F.posexplode(parts).alias("class", "value"))), "value", places=9)


@query("SELECT subject, i, j, k, CASE WHEN label = 2 THEN 'edema' ELSE 'tumour' END AS mask FROM {a} WHERE label <> 0", a="atlas")
def lesion_masks(a):
    return structural.lesion_masks(a)


@query("WITH h AS (SELECT v.* FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE label > 3), q AS (SELECT subject, quantile_cont(price, 0.9) AS q FROM h GROUP BY 1) SELECT subject, i, j, k, round(least(price, q), 6) AS value FROM h JOIN q USING (subject)", v="voxels", a="atlas")
def image_capped(v, a):
    """Values in the labelled part at most at its 90th percentile."""
    mask = a.select("subject", "i", "j", "k", (F.col("label") > 3).cast("int").alias("value"))
    return rounded(structural.capped(v.select("subject", "i", "j", "k", F.col("price").alias("value")), mask), "value")


@query(
    "WITH m AS (SELECT subject, i, j, k, CAST(value AS DOUBLE) AS value FROM {v} WHERE k < 4) SELECT o.subject, o.i, o.j, o.k, round(sum(n.value * exp(-(pow(o.i - n.i, 2) + pow(o.j - n.j, 2) + pow(o.k - n.k, 2)) / 2.0)) / sum(exp(-(pow(o.i - n.i, 2) + pow(o.j - n.j, 2) + pow(o.k - n.k, 2)) / 2.0)), 8) AS value "
    "FROM m o JOIN m n ON o.subject = n.subject AND abs(o.i - n.i) <= 4 AND abs(o.j - n.j) <= 4 AND abs(o.k - n.k) <= 4 GROUP BY 1, 2, 3, 4",
    v="voxels",
)
def image_smooth_inside(v):
    held = v.where("k < 4").select("subject", "i", "j", "k", "value")
    mask = held.select("subject", "i", "j", "k", F.lit(1).alias("value"))
    return rounded(structural.smooth_inside(held, mask, 1.0, (1.0, 1.0, 1.0), {"i": 12, "j": 12, "k": 7}), "value", places=8)


# Whole results.
@query("SELECT k AS part, subject, i, j, value FROM {v}", v="voxels")
def image_slices_whole(v):
    return images.split(v.select("subject", "i", "j", "k", "value"), "k")


@query("SELECT label, subject, i, j, k, 1 AS value FROM {a} WHERE label <> 0", a="atlas")
def target_masks_whole(a):
    return images.target_masks(a)


@query("WITH w AS (SELECT *, yy - xy * xy / xx AS w2, (xx * yz - xy * xz) / (xx * yy - xy * xy) AS w6 FROM {t}) SELECT subject, voxel, round(xx, 12) AS w1, round(w2, 12) AS w2, round(zz - xz * xz / xx - w2 * w6 * w6, 12) + 0.0 AS w3, round(xy / xx, 10) + 0.0 AS w4, round(xz / xx, 10) + 0.0 AS w5, round(w6, 10) + 0.0 AS w6 FROM w", t="tensors")
def tensor_factors_whole(t):
    """All six factors."""
    return rounded(rounded(tensor.to_factors(t), "w1", "w2", "w3", places=12), "w4", "w5", "w6", places=10)


_ORDERS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
_LETTERS = ["LR", "PA", "IS"]
_CODES = "[" + ", ".join("'" + "".join(_LETTERS[o[a]][s >> a & 1] for a in range(3)) + "'" for o in _ORDERS for s in range(8)) + "]"


@query(f"SELECT subject, t, {_CODES}[CAST(t % 48 AS INT) + 1] AS code, true AS valid FROM {{m}}", m="motion")
def orientation_codes_whole(m):
    """Codes of affines that take every axis to every direction, with some shear."""
    number = F.col("t") % 48
    order, sign = F.floor(number / 8).cast("int"), (number % 8).cast("int")
    cells = []
    for r in range(3):
        for c in range(3):
            along = F.lit(False)
            for n, o in enumerate(_ORDERS):
                if o[c] == r:
                    along = along | (order == n)
            up = F.shiftright(sign, c).bitwiseAND(F.lit(1)) == 1
            cells.append(F.when(along, F.when(up, 2.0).otherwise(-2.0)).otherwise(0.1 * (c + 1)))
        cells.append(F.lit(5.0))
    code = orientation.of_affine(F.array(*cells, *map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    return m.select("subject", "t", code.alias("code"), orientation.is_valid(code).alias("valid"))


@query("SELECT subject, count(DISTINCT CASE WHEN w <> 0 THEN w END) = 1 AS \"binary\" FROM (SELECT subject, CASE WHEN subject % 2 = 0 THEN CAST(w > 0 AS INT)::DOUBLE ELSE w END AS w FROM {c}) GROUP BY 1", c="connectome")
def matrix_is_binary(c):
    return matrices.is_binary(c.withColumn("w", F.when(F.col("subject") % 2 == 0, (F.col("w") > 0).cast("double")).otherwise(F.col("w"))))


@query("SELECT subject, subject % 3 AS site, CASE subject % 3 WHEN 0 THEN n % 5 <> 0 WHEN 1 THEN true ELSE false END AS conforms FROM (SELECT subject, count(*) AS n FROM {v} GROUP BY 1)", v="voxels")
def voxel_conforms(v):
    """Zooms against those of three sites; the third site's are other ones."""
    n = v.groupBy("subject").agg(F.count("*").alias("n")).withColumn("site", F.col("subject") % 3)
    zoom = lambda a: F.when((F.col("site") == 0) & (F.col("n") % 5 == 0), 2.01).otherwise(2.0 + 0.0005 * a)
    zooms = n.select("subject", "site", *[zoom(a).alias(f"z{a}") for a in range(3)])
    sites = n.select("site").distinct().select("site", *[F.when(F.col("site") == 2, 1.5).otherwise(2.0).alias(f"site_z{a}") for a in range(3)])
    return roi.voxel_conforms(zooms, sites)


@query("SELECT subject, i, j, k, CASE WHEN (i * 84 + j * 7 + k) % 3 = 0 THEN -1.0 ELSE (i * 84 + j * 7 + k) / 10.0 END::DOUBLE AS value FROM {v}", v="voxels")
def results_image(v):
    """A statistic per mask voxel as every subject's image, filled where a voxel has none."""
    feature = F.col("i") * 84 + F.col("j") * 7 + F.col("k")
    mask = v.select("subject", "i", "j", "k", feature.alias("feature"))
    results = mask.select("feature").distinct().where("feature % 3 <> 0").withColumn("t", F.col("feature") / 10.0)
    parts = mask.groupBy("subject").agg(F.count("*"))
    whole = regression.to_image(results, "t", mask.select("i", "j", "k", "feature").distinct(), -1.0)
    return mask.drop("feature").join(whole, ["i", "j", "k"]).join(parts.select("subject"), "subject").select("subject", "i", "j", "k", "value")


@query(
    f"WITH RECURSIVE f AS (SELECT feature, count(*) - 2 AS df, regr_slope(y, x) AS slope, sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS error FROM {{f}} GROUP BY 1), "
    f"b AS (SELECT feature, df, 0.0::DOUBLE AS low, 1000.0::DOUBLE AS high, 0 AS n FROM f UNION ALL SELECT feature, df, CASE WHEN {p_t('((low + high) / 2)', 'df')} > 0.05 THEN (low + high) / 2 ELSE low END, CASE WHEN {p_t('((low + high) / 2)', 'df')} > 0.05 THEN high ELSE (low + high) / 2 END, n + 1 FROM b WHERE n < 60) "
    "SELECT f.feature, f.df, round(slope, 6) + 0.0 AS slope, round(error * low, 5) AS half_width FROM f JOIN b USING (feature) WHERE n = 60",
    f="features",
)
def ols_half_width(f):
    """The half-width of a slope's 95 % interval, the t found by halving."""
    out = regression.ols_terms(f, ["x"]).where("term = 'x'")
    return rounded(rounded(out.select("feature", "df", F.col("coefficient").alias("slope"), "half_width"), "slope"), "half_width", places=5)
