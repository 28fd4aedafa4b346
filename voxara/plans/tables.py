"""Stand-in tables: the driver's tables seen as images, cohorts, connectomes and so on.

Each is SQL over the tables, given once for Spark and, where it differs, for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VOXELS = "SELECT l_suppkey AS subject, CAST(l_partkey % 12 AS INT) AS i, CAST(l_orderkey % 12 AS INT) AS j, CAST(l_linenumber - 1 AS INT) AS k, min(l_discount) AS value, max(l_extendedprice) AS price FROM {lineitem} GROUP BY 1, 2, 3, 4"

TABLES: dict[str, str] = {
    "voxels": _VOXELS,
    "atlas": f"SELECT subject, i, j, k, CAST((i * 7 + j * 3 + k) % 9 AS INT) AS label FROM ({_VOXELS}) v",
    "features": "SELECT c.c_custkey AS subject, o.o_orderpriority AS feature, avg(o.o_totalprice) AS y, min(c.c_mktsegment) AS grp, min(c.c_acctbal) AS x, CAST(min(c.c_nationkey) AS DOUBLE) AS x2, CAST(min(c.c_nationkey) % 4 AS INT) AS batch FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2",
    "volumes": "SELECT l_orderkey AS subject, l_linenumber AS t, min(CASE WHEN l_quantity < 8 THEN 0.0e0 ELSE l_quantity * 50 END) AS b FROM {lineitem} GROUP BY 1, 2",
    "dwi": "SELECT l_suppkey AS subject, l_partkey % 20 AS voxel, l_orderkey AS t, CAST((l_linenumber % 3) * 1000 AS DOUBLE) AS b, max(l_extendedprice) AS value FROM {lineitem} GROUP BY 1, 2, 3, 4",
    "series": "SELECT l_suppkey AS subject, CAST(l_partkey % 6 AS INT) AS i, CAST(l_orderkey % 6 AS INT) AS j, CAST(l_linenumber % 5 AS INT) AS k, CAST(CAST(l_quantity AS INT) % 4 AS INT) AS t, max(l_extendedprice) / 100 AS value FROM {lineitem} GROUP BY 1, 2, 3, 4, 5",
    "field": "SELECT l_suppkey AS subject, CAST(l_partkey % 6 AS INT) AS i, CAST(l_orderkey % 6 AS INT) AS j, CAST(l_linenumber % 5 AS INT) AS k, 0.0004e0 + max(l_quantity) * 0.00002e0 AS xx, max(l_discount) * 0.001e0 AS xy, 0.0004e0 + max(l_tax) * 0.005e0 AS yy, max(l_tax) * 0.001e0 AS xz, max(l_discount) * 0.0005e0 AS yz, 0.0004e0 + max(l_discount) * 0.005e0 AS zz, 1000 + max(l_extendedprice) / 100 AS s0 FROM {lineitem} GROUP BY 1, 2, 3, 4",
    "motion": "SELECT user_id AS subject, event_id AS t, value AS tx, value / 2 AS ty, value / 4 AS tz, value / 1000 AS rx, value / 2000 AS ry, value / 3000 AS rz FROM {events}",
    "tensors": "SELECT l_orderkey AS subject, l_linenumber AS voxel, 0.001e0 + l_quantity * 0.0001e0 AS xx, l_discount * 0.001e0 AS xy, 0.002e0 + l_tax * 0.01e0 AS yy, l_tax * 0.002e0 AS xz, l_discount * l_tax * 0.01e0 AS yz, 0.0015e0 + l_discount * 0.01e0 AS zz FROM {lineitem}",
    "points": "SELECT user_id % 5 AS subject, user_id AS streamline, event_id AS seq, value / 10 AS x, event_id % 7 + 0.5e0 AS y, value % 5 AS z FROM {events}",
    "ratings": "SELECT c.c_mktsegment AS feature, c.c_nationkey AS subject, o.o_orderpriority AS session, avg(o.o_totalprice) AS y FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3",
    "trade": "SELECT 0 AS subject, CAST(c.c_nationkey AS INT) AS i, CAST(s.s_nationkey AS INT) AS j, sum(l.l_quantity) AS w FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2, 3",
    "connectome": "SELECT subject, CAST(floor(p / 8) AS INT) AS i, CAST(p % 8 AS INT) AS j, CAST(w AS DOUBLE) AS w FROM (SELECT vec_id AS subject, posexplode(embedding) AS (p, w) FROM {embeddings}) e",
    "dates": "SELECT o_custkey AS subject, o_orderkey AS series, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date FROM {orders}",
    "grades": "SELECT d.source AS subject, CAST(d.doc_id % 3 * 40 AS DOUBLE) AS b, l.toxic * 0.6e0 AS probability FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
}
#: Where DuckDB spells it differently.
DUCK: dict[str, str] = {
    "connectome": "SELECT vec_id AS subject, CAST(p // 8 AS INT) AS i, CAST(p % 8 AS INT) AS j, CAST(embedding[p + 1] AS DOUBLE) AS w FROM embeddings, range(64) t(p)",
}
_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


TABLES |= {n: f"SELECT * FROM {{{n}}}" for n in _NAMES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(TABLES[name].format(**{n: f"parquet.`{sf_dir}/{n}.parquet`" for n in _NAMES}))


def duck(name: str) -> str:
    """The table as a parenthesised DuckDB query."""
    return f"({DUCK.get(name, TABLES[name]).format(**{n: n for n in _NAMES})})"
