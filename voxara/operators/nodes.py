"""Node tables of a parcellation: coordinates, labels, sizes and modules of connectome nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def node_table(lut: DataFrame, labels: str | list[str] | None = None, sizes: float | list[float] | None = None, modules: str | list[int] | None = None) -> DataFrame:
    """One row per node in label order: node (from 0), X, Y, Z, module, size, label.

    ``lut`` has Label, ShortName, LongName, Hemisphere, LobeID, FunctionalID, X,
    Y, Z. Labels are the numbers, ``range``, ``short``, ``short2`` (parts of the
    short name in reverse), ``long`` or given ones; modules are 1, ``lobe``,
    ``functional``, ``hemisphere`` or given ones. The table is an atlas's, so
    one window numbers it.
    """
    node = F.row_number().over(W.orderBy("Label")) - 1
    numbered = lut.withColumn("node", node)
    given = [x for x in (labels, sizes, modules) if isinstance(x, list)]
    if given:
        n = lut.count()
        if any(len(x) != n for x in given):
            raise ValueError(f"lists need one entry for each of the {n} nodes")
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("node"))

    def text(kind: str | list[str] | None) -> Column:
        if isinstance(kind, list):
            return at(kind)
        if kind is None:
            return F.col("Label").cast("string")
        if kind == "range":
            return (F.col("node") + 1).cast("string")
        if kind.lower().startswith("short"):
            return F.array_join(F.reverse(F.split("ShortName", "_")), ".") if kind.endswith("2") else F.col("ShortName")
        return F.col("LongName")

    def module(kind: str | list[int] | None) -> Column:
        if isinstance(kind, list):
            return at(kind)
        if kind is None:
            return F.lit(1)
        start = kind.lower()[:4]
        return F.col("LobeID") if start == "lobe" else F.col("FunctionalID") if start == "func" else F.when(F.col("Hemisphere") == "L", 1).otherwise(2)

    size = at([float(x) for x in sizes]) if isinstance(sizes, list) else F.lit(float(1.0 if sizes is None else sizes))
    return numbered.select("node", "X", "Y", "Z", module(modules).cast("int").alias("module"), size.alias("size"), text(labels).alias("label"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """Lines of a node file, tab-separated in node order: X, Y, Z, module, size, label."""
    fields = [F.col(c).cast("string") for c in ("X", "Y", "Z", "module", "size", "label")]
    return nodes.orderBy("node").select(F.concat_ws("\t", *fields).alias("value"))
