"""Text inputs: gradients, matrices, cohorts and sidecars, all by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.plans.filters import missing_to_null

SIDECAR = "PhaseEncodingDirection string, TotalReadoutTime double, EffectiveEchoSpacing double, PhaseEncodingSteps int, SliceTiming array<double>"


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0) and the numbers of each line of small text files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\n").alias("lines"))
    lines = files.select("path", F.posexplode("lines").alias("row", "line"))
    return lines.select("path", "row", F.transform(F.filter(F.split("line", r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double")).alias("numbers"))


def read_bvals(spark: SparkSession, path: str) -> DataFrame:
    return _numbers(spark, path).where("row = 0").select("path", F.posexplode("numbers").alias("t", "b"))


def read_bvecs(spark: SparkSession, path: str) -> DataFrame:
    """path, t, bx, by, bz of files with three rows."""
    cells = _numbers(spark, path).where("row < 3").select("path", "row", F.posexplode("numbers").alias("t", "v"))
    return cells.groupBy("path", "t").agg(*[F.max(F.when(F.col("row") == n, F.col("v"))).alias(c) for n, c in enumerate(("bx", "by", "bz"))])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Square text matrices as cells: path, i, j, w."""
    return _numbers(spark, path).select("path", F.col("row").alias("i"), F.posexplode("numbers").alias("j", "w"))


def read_cohort(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header; tokens for missing values become null, and missing columns raise."""
    df = spark.read.csv(path, header=True)
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"the cohort has no column {', '.join(lacking)}")
    return missing_to_null(df, df.columns).dropDuplicates()


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Acquisition parameters of JSON sidecars; the readout time falls back to spacing * (steps - 1)."""
    df = spark.read.schema(SIDECAR).json(path, multiLine=True)
    axis = lambda c: F.when(F.substring("PhaseEncodingDirection", 1, 1) == c, F.when(F.col("PhaseEncodingDirection").endswith("-"), -1).otherwise(1)).otherwise(0)
    return df.select(F.input_file_name().alias("path"), *[axis(c).alias(f"pe_{c}") for c in "ijk"], F.coalesce("TotalReadoutTime", F.col("EffectiveEchoSpacing") * (F.col("PhaseEncodingSteps") - 1)).alias("readout"), F.array_sort("SliceTiming").alias("slice_times"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """system, node from ragged rows: a name, then its nodes."""
    cells = spark.read.text(path).select(F.filter(F.split("value", r"[,\s]+"), lambda x: x != "").alias("cells")).where(F.size("cells") > 1)
    return cells.select(F.col("cells")[0].alias("system"), F.explode(F.slice(F.col("cells"), F.lit(2), F.size("cells") - 1)).try_cast("int").alias("node")).where("node is not null")


def write_gradients(gradients: DataFrame, folder: str) -> None:
    """One bval line and three bvec lines per subject, as text partitions by subject and row."""
    lines = gradients.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("t", "b", "bx", "by", "bz"))).alias("g"))
    joined = lambda c, f: F.array_join(F.transform("g", lambda x: F.format_string(f, x[c])), " ")
    rows = F.array(*[F.struct(F.lit(n).alias("row"), joined(c, f).alias("value")) for n, (c, f) in enumerate([("b", "%.1f"), ("bx", "%.8f"), ("by", "%.8f"), ("bz", "%.8f")])])
    lines.select("subject", F.explode(rows).alias("r")).select("subject", "r.row", "r.value").write.partitionBy("subject", "row").text(folder)
