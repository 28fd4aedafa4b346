"""Queries of node topology, clustering, track coresets and small-sample tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxara.operators import clustering, matrices, topology, tracks
from voxara.operators import statistics as st
from voxara.registry import p_t, p_z, query, rounded

# Node topology: 167-168, 173-178.
_LINKS = "(SELECT a.subject, a.i, a.j FROM {c} a JOIN {c} b ON a.subject = b.subject AND a.i = b.j AND a.j = b.i WHERE a.i <> a.j AND a.w + b.w > 0)"
_WALKS = (
    "e AS MATERIALIZED (SELECT * FROM {links}), v AS MATERIALIZED (SELECT s.subject, CAST(n.range AS INT) AS node FROM (SELECT DISTINCT subject FROM e) s, range(8) n), "
    "r AS (SELECT subject, i AS s, j AS t, 1 AS d FROM e UNION SELECT r.subject, r.s, e.j, d + 1 FROM r JOIN e ON r.subject = e.subject AND r.t = e.i WHERE d < 7), "
    "d AS MATERIALIZED (SELECT subject, s, t, min(d) AS d FROM r WHERE s <> t GROUP BY 1, 2, 3), "
    "w AS (SELECT subject, i AS s, j AS t, 1 AS d FROM e UNION ALL SELECT w.subject, w.s, e.j, w.d + 1 FROM w JOIN e ON w.subject = e.subject AND w.t = e.i JOIN d ON d.subject = w.subject AND d.s = w.s AND d.t = e.j AND d.d = w.d + 1), "
    "p AS MATERIALIZED (SELECT d.subject, d.s, d.t, d.d, count(*)::DOUBLE AS n FROM w JOIN d ON w.subject = d.subject AND w.s = d.s AND w.t = d.t AND w.d = d.d GROUP BY 1, 2, 3, 4)"
).replace("{links}", _LINKS)


@query(
    f"WITH RECURSIVE {_WALKS}, b AS (SELECT a.subject, a.t AS node, sum(a.n * z.n / p.n) AS b FROM p a JOIN p z ON a.subject = z.subject AND a.t = z.s JOIN p ON p.subject = a.subject AND p.s = a.s AND p.t = z.t AND p.d = a.d + z.d GROUP BY 1, 2), "
    "f AS (SELECT subject, s AS node, sum(1.0 / d) / 7 AS e FROM d GROUP BY 1, 2) SELECT v.subject, v.node, round(coalesce(b, 0) / 42, 8) AS betweenness, round(coalesce(e, 0), 8) AS efficiency FROM v LEFT JOIN b ON v.subject = b.subject AND v.node = b.node LEFT JOIN f ON v.subject = f.subject AND v.node = f.node",
    c="connectome",
)
def node_betweenness(c):
    """Betweenness and efficiency of every node of the binary matrix."""
    held = matrices.symmetrise(c).where("i <> j and w > 0")
    return rounded(topology.node_paths(held, 8, weighted=False).select("subject", "node", "betweenness", "efficiency"), "betweenness", "efficiency", places=8)


@query(
    f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_LINKS}), n AS MATERIALIZED (SELECT a.subject, a.i AS u, x.i, x.j FROM e a JOIN e b ON a.subject = b.subject AND a.i = b.i JOIN e x ON x.subject = a.subject AND x.i = a.j AND x.j = b.j), "
    "r AS (SELECT subject, u, i AS s, j AS t, 1 AS d FROM n UNION SELECT r.subject, r.u, r.s, n.j, d + 1 FROM r JOIN n ON r.subject = n.subject AND r.u = n.u AND r.t = n.i WHERE d < 6), "
    "d AS (SELECT subject, u, s, t, min(d) AS d FROM r WHERE s <> t GROUP BY 1, 2, 3, 4), f AS (SELECT subject, u, sum(1.0 / d) AS e FROM d GROUP BY 1, 2), k AS (SELECT subject, i AS u, count(*) AS k FROM e GROUP BY 1, 2), "
    "v AS (SELECT s.subject, CAST(q.range AS INT) AS node FROM (SELECT DISTINCT subject FROM e) s, range(8) q) SELECT v.subject, v.node, round(CASE WHEN k > 1 THEN coalesce(e, 0) / (k * (k - 1)) ELSE 0 END, 8) AS local_efficiency FROM v LEFT JOIN k ON v.subject = k.subject AND v.node = k.u LEFT JOIN f ON v.subject = f.subject AND v.node = f.u",
    c="connectome",
)
def node_local_efficiency(c):
    """Efficiency among the neighbours of every node of the binary matrix."""
    held = matrices.symmetrise(c).where("i <> j and w > 0")
    return rounded(topology.node_paths(held, 8, weighted=False).select("subject", "node", "local_efficiency"), "local_efficiency", places=8)


@query(c="connectome")
def node_measures_weighted(c):
    """Node measures of the scaled matrices at two densities."""
    return topology.node_grid(matrices.symmetrise(c), 8, [0.3, 0.6])


@query(c="connectome")
def module_densities(c):
    return topology.module_grid(matrices.symmetrise(c), 8, [0.3, 0.6])


# Clustering: 242.
_NATIONS = "(SELECT c.c_nationkey AS subject, o.o_orderpriority AS feature, avg(o.o_totalprice) AS y, min(c.c_nationkey % 5) AS part FROM {o} o JOIN {c} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"


def _nations(o, c):
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").alias("subject"), F.col("o_orderpriority").alias("feature")).agg(F.avg("o_totalprice").alias("y"))


@query(
    f"WITH x AS {_NATIONS}, z AS (SELECT x.subject, x.feature, part, (y - m) / s AS y FROM x JOIN (SELECT feature, avg(y) AS m, stddev_pop(y) AS s FROM x GROUP BY 1) USING (feature)), g AS (SELECT feature, avg(y) AS g FROM z GROUP BY 1), c AS (SELECT feature, part, avg(y) AS c, count(*) AS n FROM z GROUP BY 1, 2), "
    "b AS (SELECT sum(n * pow(c - g, 2)) AS b FROM c JOIN g USING (feature)), w AS (SELECT sum(pow(y - c, 2)) AS w FROM z JOIN c USING (feature, part)), n AS (SELECT count(DISTINCT subject) AS n, count(DISTINCT part) AS k FROM z) SELECT CAST(5 AS INT) AS clusters, round((b / (k - 1)) / (w / (n - k)), 6) AS index FROM b, w, n",
    o="orders", c="customer",
)
def cluster_index(o, c):
    """Index of the nations' parts by remainder, over standardised features."""
    z = clustering.standardised(_nations(o, c))
    members = z.select("subject").distinct().select(F.lit(5).alias("clusters"), "subject", (F.col("subject") % 5).alias("cluster"))
    return rounded(clustering.cluster_index(z, members), "index")


@query(o="orders", c="customer")
def ward_merges(o, c):
    return clustering.hierarchical(_nations(o, c), most=2)[0]


@query(o="orders", c="customer")
def ward_indexes(o, c):
    """The index of every cut of the nations' tree."""
    return clustering.hierarchical(_nations(o, c))[2]


# Tracks: 318.
_VOXELS = "SELECT subject, streamline, CAST(floor(x) AS INT) AS i, CAST(floor(y) AS INT) AS j, CAST(floor(z) AS INT) AS k FROM {p}"


@query(
    f"WITH a AS MATERIALIZED ({_VOXELS}), n AS (SELECT subject, i, j, k, count(DISTINCT streamline) AS n FROM a GROUP BY 1, 2, 3, 4), w AS (SELECT subject, streamline, avg(1.0 / n) AS w FROM a JOIN n USING (subject, i, j, k) GROUP BY 1, 2), "
    "s AS (SELECT subject, streamline, w / sum(w) OVER (PARTITION BY subject) AS weight, count(*) OVER (PARTITION BY subject) AS c FROM w), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY subject, draw ORDER BY -ln((CAST('0x' || substr(md5('1:' || draw || ':' || subject || ':' || streamline), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE) / weight, streamline) AS place FROM (SELECT s.*, CAST(r.range AS INT) AS draw FROM s, range(1, 16) r)), "
    "d AS (SELECT subject, draw, streamline, weight FROM t WHERE place <= floor(c * 50 / 100)), v AS (SELECT subject, draw, count(DISTINCT (i, j, k)) AS seen FROM d JOIN a USING (subject, streamline) GROUP BY 1, 2), m AS (SELECT subject, count(*) AS voxels FROM n GROUP BY 1), "
    "b AS (SELECT subject, arg_min(draw, seen * 100 - draw) AS draw, min(seen) AS seen FROM v GROUP BY 1) SELECT d.subject, d.draw, d.streamline, round(weight, 9) AS weight, round(seen / voxels, 9) AS covered FROM d JOIN b ON d.subject = b.subject AND d.draw = b.draw JOIN m ON d.subject = m.subject",
    p="points",
)
def track_coreset(p):
    """Half of the streamlines of each subject, of fifteen draws the one of least coverage."""
    return rounded(tracks.coreset(p, 50.0), "weight", "covered", places=9)


# Small-sample tests: 181-184.
_SMALL = "(SELECT s_nationkey % 10 AS feature, s_suppkey % 2 AS grp, s_acctbal AS y FROM {s})"


@query(
    f"WITH RECURSIVE x AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, y) AS ties FROM {_SMALL}), "
    "g AS (SELECT feature, count(*) FILTER (WHERE grp = 0) AS na, count(*) FILTER (WHERE grp = 1) AS nb, sum(r) FILTER (WHERE grp = 1) AS rb, sum(ties * ties - 1) AS t, max(ties) > 1 AS tied FROM x GROUP BY 1), "
    "u AS (SELECT *, rb - nb * (nb + 1) / 2 AS u, greatest(0, (abs(rb - nb * (nb + 1) / 2 - na * nb / 2) - 0.5) / sqrt(na * nb / 12.0 * (na + nb + 1 - t / ((na + nb) * (na + nb - 1.0))))) AS z FROM g), "
    "d AS (SELECT 0 AS r, 0 AS k, 0 AS s, 1::DOUBLE AS c UNION ALL SELECT r + 1, k + x, s + x * (r + 1), sum(c)::DOUBLE FROM d, (VALUES (0), (1)) o(x) WHERE r < 40 AND k + x <= 8 GROUP BY 1, 2, 3), "
    "e AS (SELECT u.*, (SELECT sum(c) FILTER (WHERE s - k * (k + 1) / 2 >= greatest(u, na * nb - u)) / sum(c) FROM d WHERE r = na + nb AND k = least(na, nb)) AS upper FROM u), "
    f"p AS (SELECT *, CASE WHEN NOT tied AND least(na, nb) BETWEEN 1 AND 8 THEN least(1, 2 * upper) ELSE least(1, {p_z('z')}) END AS p, 1 - 2 * u / nullif(na * nb, 0) AS effect FROM e), "
    "k AS (SELECT feature, count(*) OVER () * p / row_number() OVER (ORDER BY p, feature) AS s, p FROM p WHERE p < 1), q AS (SELECT feature, min(s) OVER (ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM k) "
    "SELECT feature, na::DOUBLE AS na, nb::DOUBLE AS nb, u::DOUBLE AS u, round(effect, 6) + 0.0 AS effect, round(p, 6) + 0.0 AS p, round(coalesce(q, 1), 6) + 0.0 AS q, round(CASE WHEN p <= 0.05 THEN effect ELSE 0 END, 6) + 0.0 AS effect_trend, round(CASE WHEN coalesce(q, 1) <= 0.05 THEN effect ELSE 0 END, 6) + 0.0 AS effect_fdr FROM p LEFT JOIN q USING (feature)",
    s="supplier",
)
def mann_whitney_exact(s):
    """Tests of small groups, with exact probabilities and q."""
    held = s.select((F.col("s_nationkey") % 10).alias("feature"), (F.col("s_suppkey") % 2).cast("string").alias("group"), F.col("s_acctbal").alias("y"))
    return rounded(st.mann_whitney_full(held, "0", "1").withColumns({c: F.col(c).cast("double") for c in ("na", "nb", "u")}), "effect", "p", "q", "effect_trend", "effect_fdr")




@query(
    f"WITH z AS (SELECT feature, (y - avg(y) OVER (PARTITION BY feature)) / stddev_samp(y) OVER (PARTITION BY feature) AS z, row_number() OVER (PARTITION BY feature ORDER BY y) AS i, count(*) OVER (PARTITION BY feature) AS n FROM {{f}}), p AS (SELECT *, greatest({p_z('z')} / 2, 1e-12) AS tail FROM z), "
    "a AS (SELECT feature, any_value(n)::DOUBLE AS n, -any_value(n) - sum((2 * i - 1) * ln(CASE WHEN z < 0 THEN tail ELSE 1 - tail END) + (2 * (n + 1 - i) - 1) * ln(CASE WHEN z < 0 THEN 1 - tail ELSE tail END)) / any_value(n) AS a2 FROM p GROUP BY 1), "
    "q AS (SELECT *, CASE WHEN a2 >= round(1.092 / c, 3) THEN 0.01 WHEN a2 >= round(0.918 / c, 3) THEN 0.025 WHEN a2 >= round(0.787 / c, 3) THEN 0.05 WHEN a2 >= round(0.656 / c, 3) THEN 0.1 WHEN a2 >= round(0.576 / c, 3) THEN 0.15 ELSE 1 END AS p FROM (SELECT *, 1 + 4 / n - 25 / (n * n) AS c FROM a)) "
    "SELECT feature, n, round(a2, 2) AS a2, p::DOUBLE AS p, round(CASE WHEN p < 0.05 THEN -log10(p) ELSE 0 END, 6) AS log_p FROM q",
    f="features",
)
def normality(f):
    return rounded(rounded(st.normality(f), "a2", places=2), "log_p")




@query(
    f"WITH t AS (SELECT feature, count(*) AS n, corr(y, x) AS r FROM {{f}} GROUP BY 1), p AS (SELECT *, {p_t('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} AS p FROM t), q AS (SELECT *, min(s) OVER (ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM (SELECT *, count(*) OVER () * p / row_number() OVER (ORDER BY p, feature) AS s FROM p)) "
    "SELECT feature, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, round(CASE WHEN p <= 0.05 THEN r ELSE 0 END, 6) + 0.0 AS r_trend, round(CASE WHEN q <= 0.05 THEN r ELSE 0 END, 6) + 0.0 AS r_fdr FROM q",
    f="features",
)
def pearson_corrected(f):
    """Correlations with q, and what of them stays at the level."""
    return rounded(st.with_q(st.pearson(f, "x").drop("t"), "r"), "r", "p", "q", "r_trend", "r_fdr")
