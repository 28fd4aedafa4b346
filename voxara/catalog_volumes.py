"""Queries of images, orientations, gradients, nodes, connectome measures and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxara.functions import names
from voxara.operators import images, matrices, nodes, orientation, roi, tensor, volumes
from voxara.registry import query, rounded

SHAPE = {"i": 12, "j": 12, "k": 7}


def _image(v, column="value"):
    return v.select("subject", "i", "j", "k", F.col(column).alias("value"))


# Images: 52-54, 58, 74, 82-83.
@query("SELECT subject, i, j, k, 0.0 AS value FROM {v}", v="voxels")
def image_zeros(v):
    return images.zeros(_image(v))


@query("SELECT subject, i, j, k, CAST(value > 0 AS INT) AS value FROM {v}", v="voxels")
def image_ones(v):
    return images.ones(_image(v))


@query(
    "SELECT s.subject, CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CAST(c.range AS INT) AS k, CAST(coalesce(v.value, 0) = 0 AS INT) AS value FROM (SELECT DISTINCT subject FROM {v}) s, range(12) a, range(12) b, range(7) c LEFT JOIN {v} v ON v.subject = s.subject AND v.i = a.range AND v.j = b.range AND v.k = c.range",
    v="voxels",
)
def image_invert(v):
    return images.invert(_image(v), SHAPE)


@query("SELECT k AS part, subject, i, j, value FROM {v} WHERE k = 3", v="voxels")
def image_slice(v):
    return images.split(_image(v), "k", 3)


@query("SELECT k AS part, count(*) AS n, round(sum(value), 6) AS total FROM {v} GROUP BY 1", v="voxels")
def image_slices(v):
    return rounded(images.split(_image(v), "k").groupBy("part").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


_CORE = "(SELECT o.subject, o.i, o.j, o.k FROM {v} o JOIN {v} m ON o.subject = m.subject AND abs(o.i - m.i) + abs(o.j - m.j) + abs(o.k - m.k) <= 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 7)"


@query(f"SELECT v.subject, v.i, v.j, v.k, 1 AS value FROM {{v}} v JOIN {_CORE} c ON v.subject = c.subject AND v.i = c.i AND v.j = c.j AND v.k = c.k WHERE v.value > 0.02", v="voxels")
def image_threshold_fa(v):
    return images.threshold_fa(_image(v), v.select("subject", "i", "j", "k", F.lit(1).alias("value")), 0.02)


@query("SELECT label, image IS NOT NULL AS in_image FROM (SELECT DISTINCT label, 1 AS image FROM {a}) x FULL JOIN (SELECT unnest([0, 1, 2, 3, 42]) AS label, 1 AS list) y USING (label) WHERE image IS NULL OR list IS NULL", a="atlas")
def labels_differ(a):
    return images.labels_differ(a, [1, 2, 3, 42])


@query("SELECT label, count(*) AS n FROM {a} WHERE label <> 0 GROUP BY 1", a="atlas")
def target_masks(a):
    return images.target_masks(a).groupBy("label").agg(F.count("*").alias("n"))


# Orientations and gradients: 60-65, 79.
@query("SELECT subject, CAST(6 - k AS INT) AS i, CAST(i AS INT) AS j, CAST(11 - j AS INT) AS k, value FROM {v}", v="voxels")
def image_reorient(v):
    # From R, A, S to I, R, P: the third axis reversed, the first, the second reversed.
    return orientation.reorient(_image(v), "RAS", "IRP", SHAPE)


@query("SELECT subject, t, -tz + 0.0 AS bx, tx AS by, -ty + 0.0 AS bz FROM {m}", m="motion")
def gradient_reorient(m):
    g = m.select("subject", "t", F.col("tx").alias("bx"), F.col("ty").alias("by"), F.col("tz").alias("bz"))
    return orientation.reorient_gradients(g, "RAS", "IRP")


@query("SELECT subject, t, -tx + 0.0 AS bx, ty AS by, -tz + 0.0 AS bz FROM {m}", m="motion")
def gradient_flip(m):
    g = m.select("subject", "t", F.col("tx").alias("bx"), F.col("ty").alias("by"), F.col("tz").alias("bz"))
    return orientation.flip_gradients(g, ["bx", "bz"])


@query(
    "SELECT subject, t, CASE WHEN 0.3 * tx < 0.2 THEN 'L' ELSE CASE WHEN tx - 2 < 0 THEN 'L' ELSE 'R' END END AS first, CASE WHEN tx < 2.25 THEN 'valid' ELSE 'valid' END AS valid FROM {m} WHERE abs(tx - 2) > 1",
    m="motion",
)
def orientation_codes(m):
    a = m.where("abs(tx - 2) > 1").select("subject", "t", F.array(F.col("tx") - 2, F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.1), F.lit(-2.0), F.lit(0.0), F.lit(0.0), F.lit(-3.0), F.lit(0.2), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("affine"))
    code = orientation.of_affine(F.col("affine"))
    # The second axis moves along I, the third along P.
    return a.select("subject", "t", F.substring(code, 1, 1).alias("first"), F.when(orientation.is_valid(code) & (F.substring(code, 2, 2) == "IP"), "valid").otherwise("invalid").alias("valid"))


# Volumes: 5, 67-68, 75, 111-113, 125, 258-259.
@query(
    "WITH w AS (SELECT subject, voxel, max(value) AS top FROM {d} WHERE b > 0 GROUP BY 1, 2), l AS (SELECT subject, min(b) AS low FROM {d} WHERE b > 0 GROUP BY 1) SELECT d.subject, d.voxel, t, b, round(CASE WHEN b = 0 THEN greatest(value, top / exp(-low * 1e-4)) ELSE value END, 4) AS value FROM {d} d LEFT JOIN w ON d.subject = w.subject AND d.voxel = w.voxel LEFT JOIN l ON d.subject = l.subject",
    d="dwi",
)
def dwi_adjust_b0(d):
    return rounded(volumes.adjust_b0(d, 1e-4), "value", places=4)


@query("SELECT subject, count(b) = count(CASE WHEN b <> 50 THEN t END) AS valid FROM {v} GROUP BY 1", v="volumes")
def dwi_valid(v):
    """A direction is missing where b is 50, so the subject's gradients don't cover its volumes."""
    g = v.select("subject", "t", "b", F.when(F.col("b") != 50, 1.0).alias("bx"))
    return volumes.is_valid_dwi(v, g)


@query("SELECT subject AS phase, b AS readout, count(*) AS n, min(t) AS first FROM {v} GROUP BY 1, 2", v="volumes")
def images_by_phase(v):
    named = v.select(F.col("t").alias("idx"), F.col("t").cast("string").alias("name"), F.col("subject").alias("phase"), F.col("b").alias("readout"))
    return volumes.group_by_phase(named).select("phase", "readout", F.size("names").cast("long").alias("n"), F.get("names", F.lit(0)).cast("int").alias("first"))


@query("SELECT count(DISTINCT (t, b)) AS n FROM {v}", v="volumes")
def unique_acquisitions(v):
    return volumes.unique_acquisitions(v.select(F.col("t").alias("x"), F.col("b").alias("y"), F.lit(0).alias("z")))


@query("SELECT DISTINCT t, CASE t % 4 WHEN 0 THEN '0,-1,0' WHEN 1 THEN '0,1,0' WHEN 2 THEN '1,0,0' ELSE '0,0,-1' END AS line FROM {v}", v="volumes")
def acquisition_lines(v):
    code = F.element_at(F.array(*map(F.lit, ("AP", "j", "LR", "k-"))), (F.col("t") % 4 + 1).cast("int"))
    line = volumes.acquisition_line(code, F.lit(0.05))
    return v.select("t", F.array_join(F.transform(F.slice(line, 1, 3), lambda x: x.cast("int").cast("string")), ",").alias("line")).distinct()


@query(
    "WITH r AS (SELECT subject, round_even(b / 100, 0) * 100 AS b, count(*) AS n FROM {v} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY b) AS rank FROM r), s AS (SELECT rank, b, n FROM k WHERE subject = (SELECT min(subject) FROM k)), f AS (SELECT coalesce(p.subject, k.subject) AS subject, k.b IS NOT DISTINCT FROM p.b AND k.n IS NOT DISTINCT FROM p.n AS same FROM (SELECT DISTINCT k.subject, s.* FROM k, s) p FULL JOIN k ON p.subject = k.subject AND p.rank = k.rank) SELECT subject, bool_and(same) AS conforms FROM f GROUP BY 1",
    v="volumes",
)
def bvals_conform(v):
    report = volumes.bval_report(v).withColumn("site", F.lit("s"))
    first = report.agg(F.min("subject").alias("subject"))
    site = report.join(first, "subject", "left_semi").select("site", "rank", "b", "n")
    return volumes.bvals_conform(report, site)


# Regions and reports: 104, 118, 126-127.
@query(
    "WITH x AS (SELECT v.subject, label, 'value' AS scalar, value FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE label <> 0 AND value <> 0 UNION ALL SELECT v.subject, label, 'price', price FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE label <> 0 AND price <> 0) SELECT subject, label, scalar, round(CASE WHEN count(*) < 20 THEN 0 ELSE avg(value) END, 4) AS mean, round(CASE WHEN count(*) < 20 THEN 0 ELSE median(value) END, 4) AS median, round(CASE WHEN count(*) < 20 THEN 0 ELSE coalesce(stddev_samp(value), 0) END, 4) AS std FROM x GROUP BY 1, 2, 3",
    v="voxels",
    a="atlas",
)
def tensor_roi_stats(v, a):
    return rounded(roi.tensor_roi_stats(v, a, ["value", "price"]), "mean", "median", "std", places=4)


_REGISTRATION = (
    "WITH j AS (SELECT v.subject, v.value FROM {v} v JOIN {a} a USING (subject, i, j, k) WHERE label <> 0), h AS (SELECT subject, least(floor(value / 0.05), 1)::INT AS bin FROM j WHERE value BETWEEN 0 AND 0.1), t AS (SELECT subject, count(*) FILTER (WHERE bin = 0) AS a, count(*) FILTER (WHERE bin = 1) AS b, count(*) AS n FROM h GROUP BY 1) "
    "SELECT j.subject, count(*) FILTER (WHERE value = 0) AS zero_volume, round(avg(value), 6) AS mean, round(min(a / (n * 0.05)), 5) AS low, round(min(b / (n * 0.05)), 5) AS high FROM j JOIN t ON j.subject = t.subject GROUP BY 1"
)


@query(_REGISTRATION, v="voxels", a="atlas")
def registration_report(v, a):
    report = roi.registration_report(_image(v), a, 0.0, 0.1, 2)
    return rounded(rounded(report.select("subject", F.col("zero_volume").cast("long").alias("zero_volume"), "mean", F.col("`hist0.00-0.05`").alias("low"), F.col("`hist0.05-0.10`").alias("high")), "mean"), "low", "high", places=5)


@query("SELECT v.subject, CAST(count(*) FILTER (WHERE k = 0 AND value <> 0) AS BIGINT) AS first_slice, count(*) AS n FROM {v} v GROUP BY 1", v="voxels")
def quality_table(v):
    people = v.select("subject").distinct()
    counts = v.groupBy("subject").agg(F.count("*").alias("n"))
    wide = roi.quality_table(people, {"FOV": roi.end_slices(_image(v)), "Count": counts})
    return wide.select("subject", F.col("FOV_first_slice").cast("double").cast("long").alias("first_slice"), F.col("Count_n").cast("long").alias("n"))


# Connectomes: 139-140, 149, 177-178.
_VOLUME = "(SELECT subject, CAST(i AS INT) AS node, count(*) AS volume FROM {v} WHERE i < 8 GROUP BY 1, 2)"
_GRAPH = "(SELECT subject, CAST(j % 8 AS INT) AS i, CAST(k AS INT) AS j, sum(price) AS w FROM {v} GROUP BY 1, 2, 3)"


def _graph(v):
    return v.groupBy("subject", (F.col("j") % 8).cast("int").alias("i"), F.col("k").alias("j")).agg(F.sum("price").alias("w"))


@query(
    f"WITH m AS (SELECT g.subject, g.i, g.j, g.w / o.volume AS w FROM {_GRAPH} g JOIN {_VOLUME} o ON g.subject = o.subject AND g.j = o.node), b AS (SELECT * FROM m UNION ALL SELECT subject, j, i, w FROM m) SELECT subject, i, j, round(CASE WHEN i = j THEN 0 ELSE sum(w) / 2 END / 1000, 4) AS w FROM b GROUP BY 1, 2, 3",
    v="voxels",
)
def matrix_volume_normalise(v):
    volume = v.where("i < 8").groupBy("subject", F.col("i").alias("node")).agg(F.count("*").alias("volume"))
    return rounded(matrices.volume_normalise(_graph(v), volume).withColumn("w", F.col("w") / 1000), "w", places=4)


@query(
    f"WITH o AS (SELECT subject, count(*) FILTER (WHERE value > 0) * 8.0 AS volume FROM {{v}} GROUP BY 1), m AS (SELECT g.subject, g.i, g.j, g.w / o.volume AS w FROM {_GRAPH} g JOIN o ON g.subject = o.subject), b AS (SELECT * FROM m UNION ALL SELECT subject, j, i, w FROM m) SELECT subject, i, j, round(CASE WHEN i = j THEN 0 ELSE sum(w) / 2 END, 3) AS w FROM b GROUP BY 1, 2, 3",
    v="voxels",
)
def matrix_boundary_normalise(v):
    return rounded(matrices.boundary_normalise(_graph(v), _image(v), 8.0), "w", places=3)


@query("SELECT 1 AS n, true AS inside", c="connectome")
def matrix_random_cell(c):
    """One set cell; which one is the hash's choice."""
    mask = c.where("subject = 0 and w > 0")
    return matrices.random_cell(mask).join(mask.select("i", "j"), ["i", "j"], "left_semi").agg(F.count("*").cast("int").alias("n"), (F.count("*") == 1).alias("inside"))


_SYMMETRIC = "(SELECT subject, i, j, sum(w) / 2 AS w FROM (SELECT subject, i, j, abs(w) AS w FROM {c} UNION ALL SELECT subject, j, i, abs(w) FROM {c}) GROUP BY 1, 2, 3)"
_PRUNED = (
    f"WITH RECURSIVE e AS (SELECT subject, i, j, w, d FROM {_SYMMETRIC} s, (SELECT unnest([0.25, 0.5]) AS d) WHERE i < j), r AS (SELECT *, row_number() OVER (PARTITION BY subject, d ORDER BY w DESC) - 1 AS place, least(floor(count(*) OVER (PARTITION BY subject, d) * d), count(*) OVER (PARTITION BY subject, d) - 1) AS last FROM e), "
    "c AS (SELECT subject, d, max(w) AS cut FROM r WHERE place = last GROUP BY 1, 2), p AS (SELECT e.subject, e.d, i, j, w FROM e JOIN c ON e.subject = c.subject AND e.d = c.d AND w >= cut), m AS (SELECT subject, d, i, j, w FROM p UNION ALL SELECT subject, d, j, i, w FROM p) "
)


@query(_PRUNED + "SELECT subject, d::DOUBLE AS density, i AS node, count(*) AS degree, round(sum(w), 6) AS strength FROM m GROUP BY 1, 2, 3", c="connectome")
def connectome_node_measures(c):
    m = matrices.symmetrise(c.withColumn("w", F.abs("w")))
    return rounded(matrices.node_measures(m, 8, [0.25, 0.5]), "strength")


@query(
    _PRUNED.replace("m AS (", "x AS (")
    + ", hops AS (SELECT subject, d, i AS a, i AS b, 0 AS h FROM (SELECT DISTINCT subject, d, i FROM x) UNION SELECT hops.subject, hops.d, a, x.j, h + 1 FROM hops JOIN x ON hops.subject = x.subject AND hops.d = x.d AND hops.b = x.i WHERE h < 7), "
    "near AS (SELECT subject, d, a, b, min(h) AS h FROM hops WHERE a <> b GROUP BY 1, 2, 3, 4), paths AS (SELECT subject, d, sum(1.0 / h) / 56 AS efficiency, avg(h) AS path_length FROM near GROUP BY 1, 2), "
    "k AS (SELECT subject, d, i, count(*)::DOUBLE AS k FROM x GROUP BY 1, 2, 3), ends AS (SELECT x.subject, x.d, a.k AS ka, b.k AS kb FROM x JOIN k a ON x.subject = a.subject AND x.d = a.d AND x.i = a.i JOIN k b ON x.subject = b.subject AND x.d = b.d AND x.j = b.i WHERE x.i < x.j), "
    "mix AS (SELECT subject, d, avg(ka * kb) AS p, avg((ka + kb) / 2) AS m, avg((ka * ka + kb * kb) / 2) AS q FROM ends GROUP BY 1, 2), tri AS (SELECT f.subject, f.d, count(*) AS t FROM x f JOIN x g ON f.subject = g.subject AND f.d = g.d AND f.j = g.i JOIN x h ON g.subject = h.subject AND g.d = h.d AND g.j = h.i AND h.j = f.i GROUP BY 1, 2), two AS (SELECT subject, d, sum(k * (k - 1)) AS two FROM k GROUP BY 1, 2), n AS (SELECT subject, d, count(*) / 56.0 AS reached FROM x GROUP BY 1, 2) "
    "SELECT n.subject, n.d::DOUBLE AS density, round(reached, 6) AS reached, round(CASE WHEN abs(q - m * m) > 1e-12 THEN (p - m * m) / (q - m * m) END, 5) + 0.0 AS assortativity, round(coalesce(t, 0) / nullif(two, 0), 6) AS transitivity, round(efficiency, 6) AS efficiency, round(path_length, 6) AS path_length FROM n JOIN paths USING (subject, d) JOIN mix USING (subject, d) JOIN two USING (subject, d) LEFT JOIN tri USING (subject, d)",
    c="connectome",
)
def connectome_measures(c):
    m = matrices.symmetrise(c.withColumn("w", F.abs("w")))
    out = matrices.graph_measures(m, 8, [0.25, 0.5], weighted=False)
    return rounded(rounded(out, "reached", "transitivity", "efficiency", "path_length"), "assortativity", places=5)


@query(c="connectome")
def connectome_weighted_measures(c):
    return matrices.graph_measures(matrices.symmetrise(c.withColumn("w", F.abs("w"))), 8, [0.25, 0.5])


# Nodes: 91-97, 36.
_LUT = "SELECT n_nationkey AS Label, n_name AS ShortName, lower(n_name) AS LongName, CASE WHEN n_nationkey % 2 = 0 THEN 'L' ELSE 'R' END AS Hemisphere, n_regionkey AS LobeID, n_nationkey % 3 AS FunctionalID, n_nationkey * 1.5 AS X, n_regionkey * 2.0 AS Y, 0.5 AS Z FROM {n}"


def _lut(n):
    key = F.col("n_nationkey")
    return n.select(key.alias("Label"), F.col("n_name").alias("ShortName"), F.lower("n_name").alias("LongName"), F.when(key % 2 == 0, "L").otherwise("R").alias("Hemisphere"), F.col("n_regionkey").alias("LobeID"), (key % 3).alias("FunctionalID"), (key * 1.5).cast("double").alias("X"), (F.col("n_regionkey") * 2.0).cast("double").alias("Y"), F.lit(0.5).alias("Z"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY Label) - 1 AS INT) AS node, X::DOUBLE AS X, Y::DOUBLE AS Y, Z::DOUBLE AS Z, CASE WHEN Hemisphere = 'L' THEN 1 ELSE 2 END AS module, 2.0::DOUBLE AS size, list_aggregate(list_reverse(string_split(ShortName, '_')), 'string_agg', '.') AS label FROM ({_LUT})", n="nation")
def node_table(n):
    return nodes.node_table(_lut(n), "short2", 2.0, "hemisphere")


@query(f"SELECT CAST(row_number() OVER (ORDER BY Label) AS VARCHAR) AS label, LobeID AS module FROM ({_LUT})", n="nation")
def node_numbers(n):
    return nodes.node_table(_lut(n), "range", None, "lobe").select("label", "module")


@query(f"SELECT count(*) AS n, sum(length(LongName)) AS chars FROM ({_LUT})", n="nation")
def node_lines(n):
    lines = nodes.node_lines(nodes.node_table(_lut(n), "long", None, "functional"))
    return lines.select(F.element_at(F.split("value", "\t"), 6).alias("label")).agg(F.count("*").alias("n"), F.sum(F.length("label")).alias("chars"))


# Tensors: 292-296.
_V1 = "WITH q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {t}), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), a AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 AS phi FROM p), e AS (SELECT *, q + 2 * p * cos(phi) AS l1 FROM a) "


@query(_V1 + "SELECT subject, voxel, count(*) AS n, true AS fits, true AS unit FROM e GROUP BY 1, 2", t="tensors")
def tensor_vectors(t):
    """The vectors are of length 1, at right angles, and the tensor stretches each by its own value."""
    e = tensor.eigenvectors(t)
    dot = lambda a, b: sum((F.col(a)[k] * F.col(b)[k] for k in range(1, 3)), F.col(a)[0] * F.col(b)[0])
    rows = {0: ("xx", "xy", "xz"), 1: ("xy", "yy", "yz"), 2: ("xz", "yz", "zz")}
    near = F.lit(True)
    for v, l in (("v1", "l1"), ("v2", "l2"), ("v3", "l3")):
        for r, names in rows.items():
            near = near & (F.abs(sum((F.col(c) * F.col(v)[k] for k, c in enumerate(names[1:], 1)), F.col(names[0]) * F.col(v)[0]) - F.col(l) * F.col(v)[r]) < 1e-8)
    unit = (F.abs(dot("v1", "v1") - 1) < 1e-9) & (F.abs(dot("v2", "v2") - 1) < 1e-9) & (F.abs(dot("v3", "v3") - 1) < 1e-9) & (F.abs(dot("v1", "v2")) < 1e-6) & (F.abs(dot("v1", "v3")) < 1e-6) & (F.abs(dot("v2", "v3")) < 1e-6)
    return e.groupBy("subject", "voxel").agg(F.count("*").alias("n"), F.bool_and(near).alias("fits"), F.bool_and(unit).alias("unit"))


@query(t="tensors")
def tensor_colormap(t):
    return tensor.colormap(t)


@query("SELECT subject, voxel, round(xx, 9) AS w1, round(yy - xy * xy / xx + 1e-11, 9) AS w2, round(xy / xx, 9) + 0.0 AS w4, round(xz / xx, 9) + 0.0 AS w5, round((xx * yz - xy * xz) / (xx * yy - xy * xy), 9) + 0.0 AS w6 FROM {t}", t="tensors")
def tensor_factors(t):
    return rounded(tensor.to_factors(t).drop("w3").withColumn("w2", F.col("w2") + 1e-11), "w1", "w2", "w4", "w5", "w6", places=9)


@query("SELECT subject, voxel, round(xx, 9) AS xx, round(xy, 9) AS xy, round(yy, 9) AS yy, round(xz, 9) AS xz, round(yz, 9) AS yz, round(zz, 9) AS zz FROM {t}", t="tensors")
def tensor_from_factors(t):
    """Factors of a tensor give it back."""
    return rounded(tensor.from_factors(tensor.to_factors(t)).select("subject", "voxel", *tensor.TENSOR), *tensor.TENSOR, places=9)


@query("SELECT subject, voxel, round(xx, 8) AS xx, round(xy, 8) AS xy, round(yy, 8) AS yy, round(xz, 8) AS xz, round(yz, 8) AS yz, round(zz, 8) AS zz FROM {t}", t="tensors")
def tensor_clipped(t):
    """Bounds beyond all eigenvalues leave tensors as they are."""
    return rounded(tensor.clip_eigenvalues(t, -10.0, 10.0).select("subject", "voxel", *tensor.TENSOR), *tensor.TENSOR, places=8)


# Rows 260-261, 307, 312, 327, 359-361.
@query(
    f"WITH c AS {_CORE} SELECT v.subject, v.i, v.j, v.k, 'white' AS roi FROM {{v}} v JOIN c USING (subject, i, j, k) WHERE value > 0.05 UNION ALL SELECT v.subject, v.i, v.j, v.k, 'fluid' FROM {{v}} v JOIN c USING (subject, i, j, k) WHERE price > 20000",
    v="voxels",
)
def tissue_rois(v):
    return images.tissue_rois(_image(v).withColumn("value", F.lit(1)), _image(v), _image(v, "price"), 1, 0.05, 20000.0)


@query(
    "WITH n AS (SELECT a.range AS at, sum(exp(-pow(a.range - b.range, 2) / 2.0)) AS w FROM range(12) a, range(12) b WHERE abs(a.range - b.range) <= 4 GROUP BY 1), m AS (SELECT a.range AS at, sum(exp(-pow(a.range - b.range, 2) / 2.0)) AS w FROM range(7) a, range(7) b WHERE abs(a.range - b.range) <= 4 GROUP BY 1), "
    "x AS (SELECT subject, n.at AS i, j, k, sum(value * exp(-pow(n.at - i, 2) / 2.0)) / any_value(n.w) AS value FROM {v} JOIN n ON abs(n.at - i) <= 4 GROUP BY 1, 2, 3, 4), y AS (SELECT subject, i, n.at AS j, k, sum(value * exp(-pow(n.at - j, 2) / 2.0)) / any_value(n.w) AS value FROM x JOIN n ON abs(n.at - j) <= 4 GROUP BY 1, 2, 3, 4) "
    "SELECT subject, i, j, m.at AS k, round(sum(value * exp(-pow(m.at - k, 2) / 2.0)) / any_value(m.w), 8) AS value FROM y JOIN m ON abs(m.at - k) <= 4 GROUP BY 1, 2, 3, 4",
    v="voxels",
)
def image_smooth(v):
    return rounded(images.smooth(_image(v), 1.0, (1.0, 1.0, 1.0), SHAPE), "value", places=8)


@query("SELECT subject, 0.0::DOUBLE AS low, round(0.95 * max(price), 6) AS high FROM {v} GROUP BY 1", v="voxels")
def image_contrast(v):
    return rounded(images.contrast(_image(v, "price")), "high")


@query("SELECT subject, CAST(11 - j AS INT) AS row, CAST(6 - k AS INT) AS \"column\", CAST(i AS INT) AS slice, value FROM {v} WHERE i IN (2, 4, 6, 8)", v="voxels")
def image_grid(v):
    """Sagittal slices of a grid of two by two about the sixth voxel."""
    return images.slices(_image(v), "sagittal", SHAPE).where(F.col("slice").isin(images.grid_slices(2, 2, 6, 2)))


@query("SELECT subject, (2 * floor(ceil(round(cbrt(count(*)), 9)) / 2) + 1)::INT AS radius FROM {v} GROUP BY 1", v="volumes")
def patch_radius(v):
    return v.groupBy("subject").agg(F.count("*").alias("n")).select("subject", volumes.patch_radius(F.col("n")).alias("radius"))


# Listings: 13-15, 19, 43.
_FILES = "(SELECT '/d/s' || page_id || '.nii.gz' AS path FROM pages UNION ALL SELECT '/d/s' || page_id || '.bval' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT '/d/s' || page_id || '.json' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT '/d/s' || page_id || '.nii' FROM pages WHERE page_id % 7 = 0)"


def _files(p):
    name = lambda ext: F.concat(F.lit("/d/s"), F.col("page_id").cast("string"), F.lit(ext)).alias("path")
    return p.select(name(".nii.gz")).union(p.where("page_id % 2 = 0").select(name(".bval"))).union(p.where("page_id % 3 = 0").select(name(".json"))).union(p.where("page_id % 7 = 0").select(name(".nii")))


@query(
    f"WITH f AS {_FILES}, i AS (SELECT path, regexp_replace(path, '\\.nii(\\.gz)?$', '') AS stem FROM f WHERE path LIKE '%.nii' OR path LIKE '%.nii.gz') SELECT i.path, stem, b.path AS bval, NULL::VARCHAR AS bvec, j.path AS json FROM i LEFT JOIN f b ON b.path = stem || '.bval' LEFT JOIN f j ON j.path = stem || '.json' WHERE stem LIKE '/d/s1%' OR stem LIKE '/d/s%5'",
    p="pages",
)
def image_sidecars(p):
    found = names.sidecars(_files(p), ["s"])
    return found.where("stem like '/d/s1%' or stem like '/d/s%5'")


@query("SELECT '/d/s' || page_id AS stem, 2 AS n FROM pages WHERE page_id % 7 = 0", p="pages")
def ambiguous_images(p):
    return names.ambiguous_images(_files(p))


@query("SELECT page_id, page_id % 3 = 0 AS affine FROM pages", p="pages")
def affine_texts(p):
    last = F.when(F.col("page_id") % 3 == 0, "0 0 0 1\n").when(F.col("page_id") % 3 == 1, "0 0 1 1\n").otherwise("0 0 x 1")
    return p.select("page_id", names.is_affine_text(F.concat(F.lit("1 0 0 "), F.col("page_id").cast("string"), F.lit("\n0 1 0  2\n0 0 1 3.5\n"), last)).alias("affine"))
