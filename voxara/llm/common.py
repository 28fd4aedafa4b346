"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class body (Java, RE2 and Python alike).
SPACE = r"\x20\x09-\x0D"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master (tests) may go without; it gets a folder of its own.
    """
    sc: SparkContext = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="voxara-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: written as Parquet in the shared folder and read again, so that lost executors cost no rerun.

    ``drop`` deletes the files once nothing reads them any more.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _open.append(path)
    return out


#: Folders that ``stored`` has written and nothing has dropped.
_open: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _open.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark free the shuffles that no plan refers to any more."""
    gc.collect()
    # Shuffle files go when the driver's JVM has collected what refers to them.
    spark._jvm.System.gc()


def drop(*tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes the files of stored tables, and lets Spark free the shuffles that made them."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)
    if shuffles and tables:
        free_shuffles(tables[0].sparkSession)


def open_folders() -> list[str]:
    """The folders of stored tables that nothing has dropped."""
    return list(_open)


def drop_unread(docs: DataFrame, folders: list[str]) -> None:
    """Deletes those of the folders of stored tables that ``docs`` doesn't read."""
    left = [p for p in folders if p in _open]
    read = docs.inputFiles() if left else []
    for path in left:
        if not any(path.rsplit("/", 1)[1] in f for f in read):
            _delete(docs.sparkSession, path)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def safely_named(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function of documents, for tables whose other columns have any names: they go in by place and come out by name."""

    @wraps(function)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        names = docs.columns
        return function(docs.toDF(*[n if n in ("doc_id", "text", "n_chars") else f"column{i}" for i, n in enumerate(names)]), *args, **options).toDF(*names)

    return run


def counted_rows(docs: DataFrame) -> DataFrame:
    """The distinct rows, with ``__row``, a 64-bit hash of all columns, and ``__n``, how many rows are equal to it.

    The key is made from the row alone, so that every scan gives the same one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__row", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    repeated = stored(keyed.groupBy("__row").agg(F.count("*").alias("__n")).where("__n > 1").select("__row"), "repeated")
    if repeated.isEmpty():
        return keyed.withColumn("__n", F.lit(1).cast("long"))
    # Only rows that have equals are grouped with their texts.
    single = keyed.join(repeated, "__row", "left_anti").select(*columns, "__row", F.lit(1).cast("long").alias("__n"))
    several = keyed.join(repeated, "__row", "left_semi").groupBy(*columns, "__row").agg(F.count("*").alias("__n"))
    return single.unionByName(several)


def shuffled(right: DataFrame) -> DataFrame:
    """The right side of a join of tables that grow alike: shuffled at any size, as a broadcast goes through the driver."""
    return right.hint("merge")


def times(rows: DataFrame, n: Column, names: list[str]) -> DataFrame:
    """The named columns of each row, n times."""
    return rows.withColumn("__time", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in names])


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with null as the empty text."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after which a task gives the memory it no longer needs back to the system: Python workers live on, idle ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    squeezed = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")
