"""All registered queries of the library, with their SQL.

Names follow the operators; the comment above each group gives the rows of the
operator inventory that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.functions import names
from voxara.operators import harmonize, images, matrices, roi, tensor, tracks, volumes
from voxara.operators import statistics as st
from voxara.operators.regression import ols_terms
from voxara.plans.filters import cohort_filter, design
from voxara.registry import QUERIES, SQL, Query, p_t, p_z, rounded
from voxara.registry import query as _query

FLAGSHIP = "ols_by_feature"
SHAPE = {"i": 12, "j": 12, "k": 7}
A, B = "AUTOMOBILE", "BUILDING"

def _image(v: DataFrame, column: str = "value") -> DataFrame:
    return v.select("subject", "i", "j", "k", F.col(column).alias("value"))


# Image algebra: 44-59, 78, 156-165.
@_query("SELECT subject, i, j, k, CAST(value > 0.02 AS INT) AS value FROM {v}", v="voxels")
def image_threshold(v):
    return images.threshold(_image(v), 0.02)


@_query("SELECT subject, i, j, k, CASE WHEN abs(value) < 0.02 THEN 0.0 ELSE value END AS value FROM {v}", v="voxels")
def image_absolute_threshold(v):
    return images.absolute_threshold(_image(v), 0.02)


@_query("SELECT subject, i, j, k, price AS value FROM {v} WHERE value > 0.01", v="voxels")
def image_mask(v):
    return images.mask(_image(v, "price"), _image(v), 0.01)


@_query("SELECT subject, i, j, k, round(value * price, 6) AS value FROM {v}", v="voxels")
def image_multiply(v):
    return rounded(images.multiply(_image(v), _image(v, "price")), "value")


@_query("SELECT subject, i, j, k, round(value + price, 6) AS value FROM {v}", v="voxels")
def image_add(v):
    return rounded(images.add(_image(v), _image(v, "price")), "value")


@_query("SELECT subject, i, j, k, CAST(value > 0 OR price > 0 AS INT) AS value FROM {v}", v="voxels")
def image_add_binarize(v):
    return images.add(_image(v), _image(v, "price"), binarize=True)


@_query("SELECT subject, i, j, k, 1 AS value FROM {v} WHERE value > 0 AND price > 0", v="voxels")
def image_intersection(v):
    return images.intersection(_image(v), _image(v, "price"))


@_query("SELECT subject, i, j, k, 1 AS value FROM {a} WHERE label IN (2, 5)", a="atlas")
def image_extract_roi(a):
    return images.extract_roi(a, [2, 5])


@_query("SELECT subject, i, j, k, CAST(CASE label WHEN 1 THEN 40 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 0 END AS INT) AS label FROM {a}", a="atlas")
def label_replace(a):
    lut = a.sparkSession.createDataFrame([(0, 1, 10), (1, 2, 30), (2, 3, 20), (3, 1, 40)], "position int, in_label int, out_label int")
    return images.replace_labels(a, lut)


@_query("SELECT subject, i, j, k, CAST(CASE WHEN label = 0 THEN 0 ELSE r END AS INT) AS label FROM (SELECT a.*, r FROM {a} a LEFT JOIN (SELECT label AS l, row_number() OVER (ORDER BY label) AS r FROM (SELECT DISTINCT label FROM {a} WHERE label <> 0)) o ON a.label = o.l)", a="atlas")
def label_order(a):
    return images.order_labels(a)


@_query("SELECT subject, CAST(i + 2 AS INT) AS i, CAST(j - 1 AS INT) AS j, k, value FROM {v} WHERE j >= 1 AND i <= 11", v="voxels")
def image_crop_pad(v):
    return images.crop_pad(_image(v), {"i": (2, 0), "j": (-1, 0)}, SHAPE)


@_query("SELECT subject, CAST(11 - i AS INT) AS i, j, CAST(6 - k AS INT) AS k, value FROM {v}", v="voxels")
def image_reorient(v):
    return images.flip(_image(v), ["i", "k"], SHAPE)


@_query("SELECT subject, t, i, j, value FROM (SELECT subject, CAST(k AS INT) AS t, i, j, value FROM {v} UNION ALL SELECT v.subject, CAST(k + n AS INT) AS t, i, j, value FROM {v} v JOIN (SELECT subject, max(k) + 1 AS n FROM {v} GROUP BY 1) m ON v.subject = m.subject)", v="voxels")
def image_concatenate(v):
    series = v.select("subject", F.col("k").alias("t"), "i", "j", "value")
    return images.concatenate(series, series).select("subject", "t", "i", "j", "value")


_NN1 = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) d(di, dj, dk)"


@_query(f"SELECT subject, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, 1 AS value FROM (SELECT subject, i + di AS i, j + dj AS j, k + dk AS k FROM (SELECT * FROM {{v}} WHERE price > 20000) v, {_NN1}) GROUP BY subject, i, j, k HAVING count(*) = 7", v="voxels")
def image_erode(v):
    return images.erode(_image(v, "price").where("value > 20000"))


@_query(f"SELECT DISTINCT subject, CAST(i + di AS INT) AS i, CAST(j + dj AS INT) AS j, CAST(k + dk AS INT) AS k, 1 AS value FROM (SELECT * FROM {{v}} WHERE price > 60000) v, {_NN1} WHERE i + di BETWEEN 0 AND 11 AND j + dj BETWEEN 0 AND 11 AND k + dk BETWEEN 0 AND 6", v="voxels")
def image_dilate(v):
    return images.dilate(_image(v, "price").where("value > 60000"), SHAPE)


@_query(f"SELECT g.subject, g.i, g.j, g.k, g.value FROM {{v}} g WHERE g.value > 0 AND EXISTS (SELECT 1 FROM (SELECT subject AS s, i + di AS a, j + dj AS b, k + dk AS c FROM (SELECT * FROM {{v}} WHERE price > 60000) w, {_NN1}) n WHERE n.s = g.subject AND n.a = g.i AND n.b = g.j AND n.c = g.k)", v="voxels")
def image_boundary(v):
    return images.boundary(_image(v, "price").where("value > 60000"), _image(v), SHAPE)


@_query("SELECT subject, i, j, k, CAST(least(floor((rn - 1) / greatest(floor(n / 4.0), 1)), 3) AS INT) AS part FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY i, j, k) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM {v} WHERE value > 0)", v="voxels")
def image_split_mask(v):
    return images.split_mask(_image(v), 4)


@_query("SELECT subject, label, round(avg(i) * 2 - 10, 6) AS x, round(avg(j) * 2 - 20, 6) AS y, round(avg(k) * 3 + 5, 6) AS z FROM {a} WHERE label <> 0 GROUP BY 1, 2", a="atlas")
def atlas_center_of_mass(a):
    return rounded(images.center_of_mass(a, (2.0, 2.0, 3.0), (-10.0, -20.0, 5.0)), "x", "y", "z")


@_query("SELECT subject, i, j, k, round(sum(value), 6) + 0.0 AS value FROM (SELECT subject, CAST(i - 1 AS INT) AS i, j, k, value FROM {v} UNION ALL SELECT subject, CAST(i + 1 AS INT), j, k, -value FROM {v}) WHERE i BETWEEN 1 AND 10 GROUP BY subject, i, j, k", v="voxels")
def image_gradient(v):
    return rounded(images.gradient(_image(v), "i", 12), "value")


# Region statistics and reports: 89-90, 101-103, 114-126.
@_query("SELECT w.subject, w.label, round(coalesce(mean, 0), 6) AS mean, round(coalesce(median, 0), 6) AS median, round(coalesce(std, 0), 6) AS std, coalesce(volume, 0) AS volume FROM (SELECT subject, CAST(l AS INT) AS label FROM (SELECT DISTINCT subject FROM {v}) s, range(1, 11) r(l)) w LEFT JOIN (SELECT v.subject, label, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, count(*) * 8.0::DOUBLE AS volume FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE value <> 0 GROUP BY 1, 2) s ON w.subject = s.subject AND w.label = s.label", v="voxels", a="atlas")
def roi_stats(v, a):
    return rounded(roi.roi_stats(_image(v), a, list(range(1, 11)), 8.0), "mean", "median", "std")


@_query("SELECT v.subject, label, round(CASE WHEN count(*) < 20 THEN 0 ELSE avg(value) END, 6) AS mean, round(CASE WHEN count(*) < 20 THEN 0 ELSE stddev_samp(value) END, 6) AS std FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE value <> 0 GROUP BY 1, 2", v="voxels", a="atlas")
def roi_stats_least(v, a):
    return rounded(roi.roi_stats_least(_image(v), a), "mean", "std")


@_query("WITH m AS (SELECT v.subject, label, avg(price) AS mean FROM {v} v JOIN {a} a USING (subject, i, j, k) GROUP BY 1, 2), q AS (SELECT subject, quantile_cont(mean, 0.25) AS q1, quantile_cont(mean, 0.75) AS q3 FROM m GROUP BY 1) SELECT m.subject, label, round(mean, 4) AS mean FROM m JOIN q ON m.subject = q.subject WHERE mean <= q1 - 0.15 * (q3 - q1) OR mean >= q3 + 0.15 * (q3 - q1)", v="voxels", a="atlas")
def roi_outliers(v, a):
    means = _image(v, "price").join(a, images.VOXEL).groupBy("subject", "label").agg(F.avg("value").alias("mean"))
    return rounded(roi.roi_outliers(means, 0.1), "mean", places=4)


@_query("SELECT v.subject, " + ", ".join(f"round(avg(CASE WHEN label = {n} THEN value END), 6) AS r{n}" for n in range(1, 5)) + " FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE value <> 0 GROUP BY 1", v="voxels", a="atlas")
def roi_wide(v, a):
    stats = roi.roi_stats(_image(v), a, list(range(1, 9)))
    wide = roi.wide(stats, "mean", [1, 2, 3, 4])
    return rounded(wide.select("subject", *[F.col(str(n)).alias(f"r{n}") for n in range(1, 5)]), *[f"r{n}" for n in range(1, 5)])


@_query("SELECT a.subject, sum(CASE WHEN coalesce(value, 0) = 0 THEN 1 ELSE 0 END) * 2.0::DOUBLE AS zero_volume, sum(CASE WHEN coalesce(value, 0) <> 0 THEN 1 ELSE 0 END) * 2.0::DOUBLE AS nonzero_volume, round(sum(CASE WHEN coalesce(value, 0) = 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN coalesce(value, 0) <> 0 THEN 1 ELSE 0 END), 0), 6) AS ratio FROM {a} a LEFT JOIN {v} v USING (subject, i, j, k) WHERE label <> 0 GROUP BY 1", a="atlas", v="voxels")
def qc_background(a, v):
    return rounded(roi.background(_image(v), a, 2.0), "ratio")


@_query("SELECT subject, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round((avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * pow(avg(value), 3)) / pow(stddev_pop(value), 3), 5) AS skew, round(kurtosis_pop(value), 5) AS kurtosis FROM {v} GROUP BY 1", v="voxels")
def qc_moments(v):
    return rounded(rounded(roi.moments(_image(v)), "mean", "std"), "skew", "kurtosis", places=5)


@_query("SELECT subject, bin, count(*) AS n, round(count(*) / (any_value(total) * 5000.0), 12) AS density FROM (SELECT subject, CAST(least(floor(price / 5000), 19) AS INT) AS bin, count(*) OVER (PARTITION BY subject) AS total FROM {v} WHERE price BETWEEN 0 AND 100000) GROUP BY 1, 2", v="voxels")
def qc_histogram(v):
    return rounded(roi.histogram(_image(v, "price"), 0.0, 100000.0, 20), "density", places=12)


@_query("SELECT v.subject, count(*) FILTER (WHERE k = 0 AND value <> 0) * 2.0::DOUBLE AS first_slice, count(*) FILTER (WHERE k = m.last AND value <> 0) * 2.0::DOUBLE AS last_slice FROM {v} v JOIN (SELECT subject, max(k) AS last FROM {v} GROUP BY 1) m ON v.subject = m.subject GROUP BY 1", v="voxels")
def qc_end_slices(v):
    return roi.end_slices(_image(v), 2.0)


@_query("SELECT subject, b, round(p, 6) AS percent_bad, p >= CASE WHEN b < 50 THEN 50 ELSE 15 END AS bad FROM (SELECT subject, b, 100.0::DOUBLE * count(*) FILTER (WHERE probability >= 0.5) / count(*) AS p FROM {g} GROUP BY 1, 2)", g="grades")
def qc_grade_volumes(g):
    return rounded(roi.grade_volumes(g), "percent_bad")


@_query("SELECT subject, round_even(b / 100, 0) * 100 AS b, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY round_even(b / 100, 0) * 100) AS rank FROM {v} GROUP BY 1, 2", v="volumes")
def bval_report(v):
    return volumes.bval_report(v).withColumn("rank", F.col("rank").cast("long"))


# Volumes, gradients and motion: 71-75, 105-113, 144-145, 253-262, 28.
@_query("SELECT subject, t, b FROM {v} WHERE abs(b - 1000) <= 20 OR abs(b) <= 20", v="volumes")
def shells_extract(v):
    return v.where(volumes.in_shells(F.col("b"), [0.0, 1000.0])).select("subject", "t", "b")


@_query("SELECT v.subject, t, b FROM {v} v JOIN (SELECT subject, max(b) AS top, min(CASE WHEN b > 0 THEN b END) AS low FROM {v} GROUP BY 1) e ON v.subject = e.subject WHERE NOT coalesce(top > 1500 OR low < 500, false) OR b = 0 OR b BETWEEN 500 AND 1500", v="volumes")
def shells_gaussian(v):
    return volumes.gaussian_shells(v).select("subject", "t", "b")


@_query("SELECT subject, voxel, round(avg(value), 7) AS mean_b0, arg_min(value, t) AS first_b0 FROM {d} WHERE b = 0 GROUP BY 1, 2", d="dwi")
def dwi_b0(d):
    return rounded(volumes.b0_mean(d), "mean_b0", places=7)


@_query("SELECT subject, voxel, round(coalesce(avg(value) / nullif(stddev_pop(value), 0), 0), 5) AS tsnr FROM {d} WHERE b < 20 GROUP BY 1, 2 HAVING count(*) >= 3", d="dwi")
def dwi_tsnr(d):
    return rounded(volumes.temporal_snr(d), "tsnr", places=5)


@_query("SELECT d.subject, voxel, t, b, round(value * 1000 / median, 5) AS value FROM {d} d JOIN (SELECT subject, median(value) AS median FROM {d} WHERE b = 0 AND voxel % 2 = 0 GROUP BY 1) m ON d.subject = m.subject", d="dwi")
def dwi_normalize(d):
    return rounded(volumes.normalize(d, d.where("voxel % 2 = 0").select("subject", "voxel")), "value", places=5)


@_query("SELECT subject, t, b, sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM {v}", v="volumes")
def volume_runs(v):
    return volumes.index_runs(v.select("subject", "t", "b"))


@_query("SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS INT) AS t, b FROM {v} WHERE t <> 2", v="volumes")
def volumes_remove(v):
    return volumes.remove_volumes(v.select("subject", "t", "b"), v.where("t = 2").select("subject", "t"))


@_query("SELECT subject, round(sqrt(avg(step * step)), 5) AS relative, round(sqrt(avg(away * away)), 5) AS absolute FROM (SELECT subject, abs(tx - lag(tx) OVER w) + abs(ty - lag(ty) OVER w) + abs(tz - lag(tz) OVER w) + 50 * (abs(rx - lag(rx) OVER w) + abs(ry - lag(ry) OVER w) + abs(rz - lag(rz) OVER w)) AS step, abs(tx - first(tx) OVER w) + abs(ty - first(ty) OVER w) + abs(tz - first(tz) OVER w) + 50 * (abs(rx - first(rx) OVER w) + abs(ry - first(ry) OVER w) + abs(rz - first(rz) OVER w)) AS away FROM {m} WINDOW w AS (PARTITION BY subject ORDER BY t)) WHERE step IS NOT NULL GROUP BY 1", m="motion")
def motion_rms(m):
    return rounded(volumes.motion(m), "relative", "absolute", places=5)


@_query("SELECT subject, acq, n, rank() OVER (PARTITION BY subject ORDER BY n DESC) = 1 AS most FROM (SELECT subject % 100 AS subject, t AS acq, count(*) FILTER (WHERE b > 0) AS n FROM {v} GROUP BY 1, 2)", v="volumes")
def acquisitions_most(v):
    return volumes.most_gradients(v.select((F.col("subject") % 100).alias("subject"), F.col("t").alias("acq"), "b"))


@_query("SELECT subject, t, CAST(2 * floor((sqrt(8 * n + 1) - 3) / 4) AS INT) AS lmax, p AS phase FROM (SELECT subject, t, t + 5 AS n, CASE t % 3 WHEN 0 THEN 'j-' WHEN 1 THEN 'i' ELSE 'other' END AS p FROM {v})", v="volumes")
def gradient_functions(v):
    code = F.when(F.col("t") % 3 == 0, "AP").when(F.col("t") % 3 == 1, "LR").otherwise("other")
    return v.select("subject", "t", volumes.lmax(F.col("t") + 5).alias("lmax"), volumes.decode_phase(code).alias("phase"))


@_query("SELECT subject, series, date, 't' || (dense_rank() OVER (PARTITION BY subject ORDER BY date) - 1) AS code FROM {d}", d="dates")
def date_codes(d):
    return volumes.date_codes(d)


# Matrices and graphs: 133-140, 147-148, 156-177, 241.
@_query("SELECT a.subject, a.i, a.j, round((a.w + b.w) / 2, 6) + 0.0 AS w FROM {c} a JOIN {c} b ON a.subject = b.subject AND a.i = b.j AND a.j = b.i", c="connectome")
def matrix_symmetrise(c):
    return rounded(matrices.symmetrise(c), "w")


@_query("SELECT subject, i, j, round((w - min(w) OVER (PARTITION BY subject)) / nullif(max(w) OVER (PARTITION BY subject) - min(w) OVER (PARTITION BY subject), 0), 6) AS w FROM {c}", c="connectome")
def matrix_normalise(c):
    return rounded(matrices.normalise(c, 8), "w")


@_query("SELECT subject, i, j, CAST(w > 0 AS INT) AS w FROM {c}", c="connectome")
def matrix_binarize(c):
    return matrices.binarize(c)


@_query("SELECT subject, i, j, round(CASE WHEN w > 0 THEN log10(w) ELSE 0 END, 5) + 0.0 AS w FROM {c}", c="connectome")
def matrix_log(c):
    return rounded(matrices.log_scale(c), "w", places=5)


@_query("SELECT subject, i, j, round(0.5 * ln((1 + w) / (1 - w)), 6) + 0.0 AS w FROM {c}", c="connectome")
def matrix_fisher_z(c):
    return rounded(matrices.fisher_z(c), "w")


@_query("WITH u AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY w DESC) - 1 AS place, count(*) OVER (PARTITION BY subject) AS n FROM {c} WHERE i < j), t AS (SELECT subject, w AS cut FROM u WHERE place = floor(n * 0.25)) SELECT u.subject, i, j, w FROM u JOIN t ON u.subject = t.subject WHERE w >= cut", c="connectome")
def matrix_prune(c):
    return matrices.prune(matrices.upper(c), 0.25)


@_query("SELECT subject, round(count(*) FILTER (WHERE w > 0) / 56.0, 6) AS density FROM {c} GROUP BY 1", c="connectome")
def matrix_density(c):
    return rounded(matrices.density(c, 8), "density")


@_query("SELECT subject, i, count(*) FILTER (WHERE w > 0) AS degree, round(sum(w), 5) + 0.0 AS strength FROM {c} GROUP BY 1, 2", c="connectome")
def matrix_degree_strength(c):
    return rounded(matrices.degree_strength(c), "strength", places=5)


@_query("SELECT i, j, round(stddev_pop(w) / abs(avg(w)), 2) AS cv FROM {c} GROUP BY 1, 2", c="connectome")
def matrix_variation(c):
    return rounded(matrices.variation(c), "cv", places=2)


@_query("SELECT c.subject, c.i, c.j, w FROM {c} c JOIN (SELECT i, j FROM {c} GROUP BY 1, 2 HAVING stddev_pop(w) / abs(avg(w)) < 20) k ON c.i = k.i AND c.j = k.j", c="connectome")
def matrix_consistent(c):
    return matrices.consistent(c, c, 20.0)


@_query("WITH m AS (SELECT * FROM (VALUES ('a', 0), ('a', 1), ('a', 2), ('b', 2), ('b', 3), ('b', 4), ('c', 5), ('c', 6), ('c', 7)) m(system, node)) SELECT c.subject, a.system AS sa, b.system AS sb, round(avg(w), 6) + 0.0 AS w FROM {c} c JOIN m a ON c.i = a.node JOIN m b ON c.j = b.node WHERE a.system < b.system OR (a.system = b.system AND i < j) GROUP BY 1, 2, 3", c="connectome")
def matrix_systems(c):
    member = c.sparkSession.createDataFrame([(s, n) for s, ns in (("a", (0, 1, 2)), ("b", (2, 3, 4)), ("c", (5, 6, 7))) for n in ns], "system string, node int")
    return rounded(matrices.systems(c, member), "w")


_SYM = "(SELECT a.subject, a.i, a.j, (a.w + b.w) / 2 AS w FROM {c} a JOIN {c} b ON a.subject = b.subject AND a.i = b.j AND a.j = b.i WHERE a.i <> a.j AND a.w + b.w > 0)"


@_query(f"WITH r AS (SELECT subject, i, j, sum(w) / 2 AS w FROM (SELECT subject, i, j, w FROM {{c}} UNION ALL SELECT subject, j, i, w FROM {{c}}) GROUP BY 1, 2, 3), x AS (SELECT subject, min(w) AS low, max(w) AS high FROM r GROUP BY 1), e AS (SELECT r.subject, i, j, (w - low) / (high - low) AS w FROM r JOIN x ON r.subject = x.subject WHERE i <> j AND w > low), t AS (SELECT a.subject, sum(cbrt(a.w * b.w * c.w)) AS t FROM e a JOIN e b ON a.subject = b.subject AND a.j = b.i JOIN e c ON b.subject = c.subject AND b.j = c.i AND c.j = a.i GROUP BY 1), k AS (SELECT subject, sum(k * (k - 1)) AS k FROM (SELECT subject, i, count(*) AS k FROM e GROUP BY 1, 2) GROUP BY 1) SELECT k.subject, round(coalesce(t, 0) / nullif(k, 0), 6) AS transitivity FROM k LEFT JOIN t ON k.subject = t.subject", c="connectome")
def graph_transitivity(c):
    return rounded(matrices.transitivity(matrices.normalise(matrices.symmetrise(c), 8)), "transitivity")


@_query(f"WITH e AS {_SYM}, d AS (SELECT subject, i, sum(w) AS d FROM e GROUP BY 1, 2), x AS (SELECT e.subject, avg(a.d * b.d) AS p, avg((a.d + b.d) / 2) AS m, avg((a.d * a.d + b.d * b.d) / 2) AS q FROM e JOIN d a ON e.subject = a.subject AND e.i = a.i JOIN d b ON e.subject = b.subject AND e.j = b.i WHERE e.i < e.j GROUP BY 1) SELECT subject, round((p - m * m) / nullif(q - m * m, 0), 4) + 0.0 AS assortativity FROM x", c="connectome")
def graph_assortativity(c):
    return rounded(matrices.assortativity(matrices.symmetrise(c), weighted=True), "assortativity", places=4)


@_query("WITH g AS (SELECT sum(w) AS total FROM {t}), p AS (SELECT i % 5 AS module, sum(w) AS degree, sum(CASE WHEN i % 5 = j % 5 THEN w ELSE 0 END) AS inside FROM {t} GROUP BY 1) SELECT 0 AS subject, round(sum(inside / total - pow(degree / total, 2)), 6) AS modularity FROM p, g", t="trade")
def graph_modularity(t):
    member = t.select(F.col("i").alias("node")).distinct().withColumn("module", F.col("node") % 5)
    return rounded(matrices.modularity(t, member), "modularity")


@_query(c="connectome")
def graph_paths(c):
    return matrices.shortest_paths(matrices.symmetrise(c).where("i <> j and w > 0"), 8)


@_query("SELECT a.grp AS subject, a.feature AS i, b.feature AS j, round(corr(a.y, b.y), 5) AS w FROM {f} a JOIN {f} b ON a.subject = b.subject AND a.feature < b.feature GROUP BY 1, 2, 3", f="features")
def correlation_matrix(f):
    return rounded(matrices.correlation(f.select(F.col("grp").alias("subject"), F.col("subject").alias("t"), F.col("feature").alias("roi"), "y")), "w", places=5)


@_query("SELECT a.subject AS a, b.subject AS b, round(avg(pow((a.y - b.y) / 100000, 2)), 6) AS distance FROM (SELECT * FROM {r}) a JOIN (SELECT * FROM {r}) b ON a.feature = b.feature AND a.session = b.session AND a.subject < b.subject GROUP BY 1, 2", r="ratings")
def distance_matrix(r):
    return rounded(matrices.distances(r.select("subject", F.concat_ws("|", "feature", "session").alias("feature"), (F.col("y") / 100000).alias("y"))), "distance")


# Statistics: 146, 179-199, 207-214.
@_query(f"WITH s AS (SELECT feature, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM {{f}} GROUP BY 1), r AS (SELECT *, c / vx AS slope, n * (vy - c * c / vx) AS rss FROM s) SELECT feature, n, n - 2 AS df, round(my - slope * mx, 3) AS intercept, round(slope, 6) + 0.0 AS slope, round(sqrt(rss / (n - 2) / (n * vx)), 6) AS se, round(slope / sqrt(rss / (n - 2) / (n * vx)), 6) + 0.0 AS t, round(1 - rss / (n * vy), 6) AS r2, round({p_t('slope / sqrt(rss / (n - 2) / (n * vx))', 'n - 2')}, 6) + 0.0 AS p FROM r", f="features")
def ols_by_feature(f):
    return rounded(rounded(st.simple_ols(f, "x").select("feature", "n", "df", "intercept", "slope", "se", "t", "r2", "p"), "intercept", places=3), "slope", "se", "t", "r2", "p")


@_query("WITH s AS (SELECT feature, count(*) AS n, avg(y) AS my, avg(x) AS m1, avg(x2) AS m2, var_pop(x) AS s11, var_pop(x2) AS s22, covar_pop(x, x2) AS s12, covar_pop(y, x) AS a, covar_pop(y, x2) AS b, var_pop(y) AS syy FROM {f} GROUP BY 1), c AS (SELECT *, (a * s22 - b * s12) / (s11 * s22 - s12 * s12) AS b1, (b * s11 - a * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s), r AS (SELECT *, syy - b1 * a - b2 * b AS f, syy - a * a / s11 AS g FROM c) SELECT feature, n, round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 6) + 0.0 AS b1, round(b2, 4) + 0.0 AS b2, round(1 - f / syy, 6) AS r2, round((g - f) / (f / (n - 3)), 5) AS f, n - 3 AS df FROM r", f="features")
def ols_two_covariates(f):
    return rounded(rounded(rounded(rounded(st.two_covariates(f, "x", "x2"), "intercept", places=3), "b1", "r2"), "b2", places=4), "f", places=5)


@_query("SELECT feature, 'Intercept' AS term, round(regr_intercept(y, x), 3) + 0.0 AS coefficient, count(*) - 2 AS df FROM {f} GROUP BY 1 UNION ALL SELECT feature, 'x', round(regr_slope(y, x), 3) + 0.0, count(*) - 2 FROM {f} GROUP BY 1", f="features")
def ols_formula(f):
    planned, columns = design(f.select("subject", "feature", "y", "x"), "x")
    return rounded(ols_terms(planned, columns).select("feature", "term", "coefficient", "df"), "coefficient", places=3)


@_query("SELECT subject, f.feature, round(y - i - s * x, 3) + 0.0 AS y FROM {f} f JOIN (SELECT feature, regr_intercept(y, x) AS i, regr_slope(y, x) AS s FROM {f} GROUP BY 1) r ON f.feature = r.feature", f="features")
def ols_residuals(f):
    return rounded(st.residuals(f, "x"), "y", places=3)


@_query("WITH r AS (SELECT f.subject, f.feature, grp, y - i - s * x AS r FROM {f} f JOIN (SELECT feature, regr_intercept(y, x) AS i, regr_slope(y, x) AS s FROM {f} WHERE grp = 'BUILDING' GROUP BY 1) c ON f.feature = c.feature), m AS (SELECT feature, avg(r) AS m, stddev_pop(r) AS s FROM r WHERE grp = 'BUILDING' GROUP BY 1) SELECT subject, r.feature, round((r - m) / s, 6) + 0.0 AS z FROM r JOIN m ON r.feature = m.feature", f="features")
def zscores_subset(f):
    return rounded(st.zscores(f, "x", f.where(cohort_filter(f, "grp=BUILDING"))), "z")


@_query(f"SELECT feature, n, round(r, 6) + 0.0 AS r, round(t, 5) + 0.0 AS t, round({p_t('t', 'n - 2')}, 6) + 0.0 AS p FROM (SELECT feature, count(*) AS n, corr(y, x) AS r, corr(y, x) * sqrt((count(*) - 2) / (1 - pow(corr(y, x), 2))) AS t FROM {{f}} GROUP BY 1)", f="features")
def pearson_by_feature(f):
    return rounded(rounded(st.pearson(f, "x"), "r", "p"), "t", places=5)


_RANK = "rank() OVER (PARTITION BY feature ORDER BY {0}) + (count(*) OVER (PARTITION BY feature, {0}) - 1) / 2.0"


@_query(f"SELECT feature, n, round(r, 6) + 0.0 AS rho, round({p_t('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')}, 6) + 0.0 AS p FROM (SELECT feature, count(*) AS n, corr(ry, rx) AS r FROM (SELECT feature, {_RANK.format('y')} AS ry, {_RANK.format('x')} AS rx FROM {{f}}) GROUP BY 1)", f="features")
def spearman_by_feature(f):
    return rounded(st.spearman(f, "x"), "rho", "p")


@_query(
    f"WITH r AS (SELECT feature, grp, {_RANK.format('y')} AS r, count(*) OVER (PARTITION BY feature, y) AS ties FROM {{f}} WHERE grp IN ('{A}', '{B}')), s AS (SELECT feature, count(*) FILTER (WHERE grp = '{A}')::DOUBLE AS na, count(*) FILTER (WHERE grp = '{B}')::DOUBLE AS nb, sum(r) FILTER (WHERE grp = '{B}') AS rb, sum(ties * ties - 1) AS ties FROM r GROUP BY 1), u AS (SELECT *, rb - nb * (nb + 1) / 2 AS u FROM s), z AS (SELECT *, greatest(0, (abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1))))) AS z FROM u) "
    f"SELECT feature, na, nb, u, round(1 - 2 * u / (na * nb), 6) + 0.0 AS effect, round(least(1, {p_z('z')}), 5) + 0.0 AS p FROM z",
    f="features",
)
def mann_whitney(f):
    return rounded(rounded(st.mann_whitney(f.withColumnRenamed("grp", "group"), A, B).select("feature", F.col("na").cast("double").alias("na"), F.col("nb").cast("double").alias("nb"), "u", "effect", "p"), "effect"), "p", places=5)


@_query(f"WITH s AS (SELECT feature, count(*) FILTER (WHERE grp = '{A}') AS n0, count(*) FILTER (WHERE grp = '{B}') AS n1, avg(ln(y + 1)) FILTER (WHERE grp = '{A}') AS m0, avg(ln(y + 1)) FILTER (WHERE grp = '{B}') AS m1, var_samp(ln(y + 1)) FILTER (WHERE grp = '{A}') AS v0, var_samp(ln(y + 1)) FILTER (WHERE grp = '{B}') AS v1 FROM {{f}} WHERE grp IN ('{A}', '{B}') GROUP BY 1), t AS (SELECT *, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t FROM s) SELECT feature, n0, n1, round(t, 6) + 0.0 AS t, round(2 * t / sqrt(n0 + n1 - 1), 6) + 0.0 AS d, round({p_t('t', 'n0 + n1 - 2')}, 6) + 0.0 AS p FROM t", f="features")
def pooled_t(f):
    return rounded(st.pooled_t(f.withColumnRenamed("grp", "group"), A, B), "t", "d", "p")


@_query(f="features")
def permutation_max_t(f):
    return st.max_t_permutation(f.withColumnRenamed("grp", "group"), A, B)


@_query("WITH p AS (SELECT subject AS feature, CASE WHEN min(value) > 0.05 THEN 1.0 ELSE (subject * 37 % 101 + i % 3) / 150.0 END::DOUBLE AS p, i FROM {v} GROUP BY subject, i), u AS (SELECT feature * 100 + i AS feature, p FROM p), r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, feature) AS k FROM u WHERE p < 1) SELECT feature, p, round(min(n * p / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q_bh, round(least(1.0, n * p), 6) AS q_bonferroni, round((n - k + 1) * p, 6) AS q_holm FROM r UNION ALL SELECT feature, p, 1, 1, 1 FROM u WHERE p >= 1", v="voxels")
def false_discovery(v):
    p = v.groupBy("subject", "i").agg(F.min("value").alias("low")).select((F.col("subject") * 100 + F.col("i")).alias("feature"), F.when(F.col("low") > 0.05, 1.0).otherwise((F.col("subject") * 37 % 101 + F.col("i") % 3) / 150.0).alias("p"))
    return rounded(st.false_discovery(p), "q_bh", "q_bonferroni", "q_holm")


@_query("WITH t AS (SELECT feature, count(DISTINCT subject) AS n, count(DISTINCT session) AS k, var_pop(y) * count(*) AS sst FROM {r} GROUP BY 1), a AS (SELECT feature, var_pop(m) * count(*) AS r FROM (SELECT feature, subject, avg(y) AS m FROM {r} GROUP BY 1, 2) GROUP BY 1), b AS (SELECT feature, var_pop(m) * count(*) AS c FROM (SELECT feature, session, avg(y) AS m FROM {r} GROUP BY 1, 2) GROUP BY 1), x AS (SELECT t.feature, n, k, k * r / (n - 1) AS msr, (sst - k * r - n * c) / ((n - 1) * (k - 1)) AS mse FROM t JOIN a ON t.feature = a.feature JOIN b ON t.feature = b.feature) SELECT feature, n, k, round((msr - mse) / (msr + (k - 1) * mse), 6) + 0.0 AS icc FROM x", r="ratings")
def icc_by_feature(r):
    return rounded(st.icc(r), "icc")


@_query(f="features")
def anderson_darling(f):
    return st.anderson_darling(f)


# Harmonisation: 215-240.
_COMBAT = "WITH b AS (SELECT feature, batch, count(*) AS nb, avg(y) AS mb, var_pop(y) AS vb FROM {f} GROUP BY 1, 2), p AS (SELECT feature, sum(nb * mb) / sum(nb) AS grand, sqrt(sum(nb * vb) / sum(nb)) AS sd FROM b GROUP BY 1), s AS (SELECT f.*, (y - grand) / sd AS s, grand, sd FROM {f} f JOIN p ON f.feature = p.feature), e AS (SELECT batch, feature, avg(s) AS g, var_samp(s) AS d FROM s GROUP BY 1, 2) SELECT subject, s.feature, s.batch, round((s - g) / sqrt(d) * sd + grand, 3) AS y FROM s JOIN e ON s.batch = e.batch AND s.feature = e.feature"


@_query(_COMBAT, f="features")
def combat_plain(f):
    return rounded(harmonize.combat(f.select("subject", "feature", "batch", "y"), eb=False), "y", places=3)


@_query("WITH b AS (SELECT feature, batch, count(*) AS nb, avg(y) AS mb, var_pop(y) AS vb FROM {f} GROUP BY 1, 2), p AS (SELECT feature, sum(nb * mb) / sum(nb) AS grand, sqrt(sum(nb * vb) / sum(nb)) AS sd FROM b GROUP BY 1), s AS (SELECT f.*, (y - grand) / sd AS s, grand, sd FROM {f} f JOIN p ON f.feature = p.feature), e AS (SELECT batch, feature, avg(s) AS g FROM s GROUP BY 1, 2), q AS (SELECT batch, avg(g) AS m, var_samp(g) AS t FROM e GROUP BY 1), r AS (SELECT e.batch, feature, (t * g + m) / (t + 1) AS g FROM e JOIN q ON e.batch = q.batch) SELECT subject, s.feature, s.batch, round((s - g) * sd + grand, 3) AS y FROM s JOIN r ON s.batch = r.batch AND s.feature = r.feature", f="features")
def combat_mean_only(f):
    return rounded(harmonize.combat_mean_only(f.select("subject", "feature", "batch", "y")), "y", places=3)


@_query("WITH b AS (SELECT feature, avg(y) AS m, stddev_pop(y) AS s FROM {f} WHERE batch = 0 GROUP BY 1), s AS (SELECT f.*, (y - m) / s AS z, m, s FROM {f} f JOIN b ON f.feature = b.feature), e AS (SELECT batch, feature, avg(z) AS g, stddev_samp(z) AS d FROM s GROUP BY 1, 2) SELECT subject, s.feature, s.batch, round(CASE WHEN s.batch = 0 THEN y ELSE (z - g) / d * s + m END, 3) AS y FROM s JOIN e ON s.batch = e.batch AND s.feature = e.feature", f="features")
def combat_reference(f):
    return rounded(harmonize.combat_reference(f.select("subject", "feature", "batch", "y"), 0), "y", places=3)


@_query(f="features")
def combat_nonparametric(f):
    return harmonize.combat_nonparametric(f.select("subject", "feature", "batch", "y"))


@_query(f="features")
def covbat(f):
    return harmonize.covbat(f.select("subject", "feature", "batch", "y"))


@_query(c="connectome")
def graph_communities(c):
    return matrices.communities(matrices.symmetrise(c), 8)


@_query("SELECT subject, CAST(trunc(i * 0.5) AS INT) AS i, CAST(trunc(j * 0.5) AS INT) AS j, CAST(k AS INT) AS k, arg_max(price, i * 10000 + j * 100 + k) AS value FROM {v} GROUP BY 1, 2, 3, 4", v="voxels")
def image_project(v):
    return images.project(_image(v, "price"), [0.5, 0, 0, 0, 0, 0.5, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])


@_query(v="voxels")
def image_parts(v):
    return images.parts_of(_image(v), 3)


# Tensors: 279-297, 306-311.
_EIGEN = "WITH q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {t}), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), a AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 AS phi FROM p), e AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM a), l AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM e) "


@_query(_EIGEN + "SELECT subject, voxel, round(sqrt(0.5 * (pow(l1 - l2, 2) + pow(l2 - l3, 2) + pow(l3 - l1, 2)) / (l1 * l1 + l2 * l2 + l3 * l3)), 6) AS fa, round((l1 + l2 + l3) / 3, 9) AS md, round(l1, 9) AS ax, round((l2 + l3) / 2, 9) AS rad, round((l1 - l2) / (l1 + l2 + l3), 6) + 0.0 AS cl, round(2 * (l2 - l3) / (l1 + l2 + l3), 6) + 0.0 AS cp, round(3 * l3 / (l1 + l2 + l3), 6) AS cs FROM l", t="tensors")
def tensor_scalars(t):
    s = tensor.scalars(t).select("subject", "voxel", "fa", "md", "ax", "rad", "cl", "cp", "cs")
    return rounded(rounded(s, "fa", "cl", "cp", "cs"), "md", "ax", "rad", places=9)


# Tracks: 128-132, 314-319, 263-264.
@_query("SELECT subject, CAST(floor(x) AS INT) AS i, CAST(floor(y) AS INT) AS j, CAST(floor(z) AS INT) AS k, count(DISTINCT streamline) AS n FROM {p} GROUP BY 1, 2, 3, 4", p="points")
def track_density(p):
    return tracks.density(p)


@_query("SELECT subject, count(*) AS n, round(min(l), 5) AS shortest, round(max(l), 5) AS longest, round(avg(l), 5) AS mean, round(stddev_pop(l), 5) AS std FROM (SELECT subject, streamline, sum(coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)), 0)) AS l FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM {p} WINDOW w AS (PARTITION BY subject, streamline ORDER BY seq)) GROUP BY 1, 2) GROUP BY 1", p="points")
def track_statistics(p):
    return rounded(tracks.statistics(p), "shortest", "longest", "mean", "std", places=5)


@_query("SELECT subject, streamline, count(*) AS n FROM {p} p WHERE streamline IN (SELECT streamline FROM {p} WHERE x >= 20 AND y < 1) AND streamline NOT IN (SELECT streamline FROM {p} WHERE x >= 30 AND y < 1 AND z < 1) GROUP BY 1, 2", p="points")
def track_filter(p):
    voxel = p.select("subject", *[F.floor(a).cast("int").alias(b) for a, b in zip("xyz", "ijk", strict=True)], "x", "y", "z")
    include, exclude = voxel.where("i >= 20 and j < 1"), voxel.where("i >= 30 and j < 1 and k < 1")
    key = ["subject", "i", "j", "k"]
    return tracks.avoiding(tracks.touching(p, include.select(key).distinct()), exclude.select(key).distinct()).groupBy("subject", "streamline").agg(F.count("*").alias("n"))


@_query(p="points")
def track_thin(p):
    return tracks.thin(p, 50.0)


# Names and text functions: 8-14, 24-25, 80.
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/scan_"), F.col("page_id").cast("string"), F.lit(".nii.gz"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", names.image_prefix(path).alias("prefix"), names.image_ext(path).alias("ext"), names.strip_ext(path).alias("bare"), names.expand_template("/data/{s}/x.csv", F.col("page_id")).alias("file"), names.roi_name(F.col("page_id") % 1000, F.lit("roi"), 4).alias("roi"))


QUERIES["name_functions"] = _names
SQL["name_functions"] = "SELECT page_id, 'scan_' || page_id AS prefix, '.nii.gz' AS ext, '/data/scan_' || page_id AS bare, '/data/' || page_id || '/x.csv' AS file, 'r' || lpad(CAST(page_id % 1000 AS VARCHAR), 4, '0') || '_roi' AS roi FROM pages"


# The other modules of queries register theirs as they are imported.
from voxara import catalog_graphs, catalog_kernels, catalog_models, catalog_volumes, catalog_whole  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
