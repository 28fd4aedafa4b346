"""NIfTI files as a Spark data source: ``spark.read.format("nifti")`` after ``register``.

An uncompressed file is dealt in ranges of volumes, for which its header is read
to plan. Compressed files, and all where headers alone are asked for, are only
listed to plan: there are 200 partitions of them at most. A filter on t
has the headers of compressed files read to plan as well. Filters on path and t leave whole
files and volumes unread. Options: ``path`` (a folder or file that pyarrow reaches, searched through
all folders), ``volumes`` (of a partition, 16) and ``headers`` ("true": a row
per file with its header instead of voxels).
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voxara.sources.images import decode_header

VOXELS = "path string, i int, j int, k int, t int, value double"
HEADERS = "path string, shape array<int>, zooms array<double>, affine array<double>, intent int, dtype string"
#: Bytes that hold the header of a compressed file, by far.
_FIRST = 1 << 14


@dataclass
class Files(InputPartition):
    """Whole files by name; their headers are read by the task."""

    names: list[str]

    @property
    def count(self) -> int:
        return len(self.names)


#: Partitions of whole files, at most.
_PARTS = 200


@dataclass
class Volumes(InputPartition):
    """Volumes of one file: its name and header, the first and the number."""

    name: str
    head: dict
    first: int
    count: int


def _keeps(f: Filter, column: str, value: object) -> bool:
    """Whether a filter may hold where the column has the value."""
    if getattr(f, "attribute", None) != (column,):
        return True
    if isinstance(f, In):
        return value in f.value
    tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
    return tests[type(f)](value, f.value) if type(f) in tests and f.value is not None else True


class NiftiReader(DataSourceReader):
    def __init__(self, path: str, volumes: int, headers: bool) -> None:
        self.path, self.volumes, self.headers, self.filters = path, volumes, headers, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = list(filters)
        yield from filters  # Spark tests the rows again

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Volumes]:
        from pyarrow import fs

        store, root = self._store()
        info = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        parts, whole = [], []
        by_volume = any(getattr(x, "attribute", None) == ("t",) for x in self.filters)
        for f in sorted((f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".nii", ".nii.gz")))):
            if not all(_keeps(x, "path", f) for x in self.filters):
                continue
            if self.headers or (f.endswith(".gz") and not by_volume):
                whole.append(f)
                continue
            head = self._head(store, f)
            if head is None:
                continue
            if f.endswith(".gz"):
                if any(all(_keeps(x, "t", t) for x in self.filters) for t in range(int(np.prod(head["shape"][3:])))):
                    whole.append(f)
                continue
            n = int(np.prod(head["shape"][3:]))
            for first in range(0, n, self.volumes):
                held = range(first, min(n, first + self.volumes))
                if any(all(_keeps(x, "t", t) for x in self.filters) for t in held):
                    parts.append(Volumes(f, head, first, len(held)))
        step = max(1, -(-len(whole) // _PARTS))
        parts += [Files(whole[at : at + step]) for at in range(0, len(whole), step)]
        return parts or [Volumes("", {}, 0, 0)]

    def _head(self, store, name: str) -> dict | None:
        """The header of a file; none where it is no image."""
        with store.open_input_stream(name, compression=None) as s:
            try:
                return decode_header(s.read(_FIRST if name.endswith(".gz") else 352))
            except (ValueError, KeyError):
                return None

    def read(self, partition: Volumes | Files) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Files):
            store, _ = self._store()
            for name in partition.names:
                head = self._head(store, name)
                if head is not None:
                    n = int(np.prod(head["shape"][3:]))
                    if self.headers or any(all(_keeps(x, "t", t) for x in self.filters) for t in range(n)):
                        yield from self._volumes(Volumes(name, head, 0, n))
        elif partition.count:
            yield from self._volumes(partition)

    def _volumes(self, partition: Volumes) -> Iterator[pa.RecordBatch]:
        head, name = partition.head, partition.name
        if self.headers:
            row = [[name], [head["shape"]], [head["zooms"]], [head["affine"]], [head["intent"]], [head["dtype"]]]
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["path", "shape", "zooms", "affine", "intent", "dtype"])
            return
        shape = (head["shape"] + [1, 1, 1])[:3]
        kind = np.dtype(head["order"] + head["dtype"])
        size = int(np.prod(shape)) * kind.itemsize
        store, _ = self._store()
        with store.open_input_file(name) as source:
            stream = gzip.GzipFile(fileobj=source) if name.endswith(".gz") else source
            stream.seek(head["offset"] + partition.first * size)
            for t in range(partition.first, partition.first + partition.count):
                raw = stream.read(size)  # one volume at a time
                if not all(_keeps(x, "t", t) for x in self.filters):
                    continue
                v = np.frombuffer(raw, kind).astype(np.float64).reshape(shape, order="F")
                if head["slope"]:
                    v = v * head["slope"] + head["inter"]
                at = np.nonzero(v)
                n = len(at[0])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *[pa.array(a.astype(np.int32)) for a in at], pa.array(np.full(n, t, np.int32)), pa.array(v[at])], names=["path", "i", "j", "k", "t", "value"])


class NiftiSource(DataSource):
    """Non-zero voxels of all images below a path."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else VOXELS

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(self.options["path"], max(1, int(self.options.get("volumes", "16"))), self.options.get("headers", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NiftiSource)


def subject_of(path: str = "path") -> F.Column:
    """The name of a file without folders and ending."""
    return F.regexp_extract(path, r"([^/]*?)(\.nii)?(\.gz)?$", 1)


def read_dwi(spark: SparkSession, path: str) -> DataFrame:
    """Images with the gradients beside them as one table: subject, i, j, k, t, value, b, bx, by, bz.

    Gradients lie in ``.bval`` and ``.bvec`` files of the image's name; an image
    without them has 0 in all.
    """
    from voxara.sources.text import read_bvals, read_bvecs

    register(spark)
    voxels = spark.read.format("nifti").option("path", path).load().withColumn("subject", subject_of()).drop("path")
    name = lambda ending: F.regexp_extract("path", rf"([^/]*)\.{ending}$", 1).alias("subject")
    b = read_bvals(spark, f"{path}/*.bval").select(name("bval"), "t", "b")
    v = read_bvecs(spark, f"{path}/*.bvec").select(name("bvec"), "t", "bx", "by", "bz")
    return join_dwi(voxels, b.join(v, ["subject", "t"], "full"))


def join_dwi(images: DataFrame, gradients: DataFrame) -> DataFrame:
    """Voxels (subject, i, j, k, t, value) with their gradients (subject, t, b, bx, by, bz); 0 where there are none."""
    names = ("b", "bx", "by", "bz")
    return images.join(gradients, ["subject", "t"], "left").select("subject", "i", "j", "k", "t", "value", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def split_dwi(dwi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voxels and gradients of a joined table."""
    return dwi.select("subject", "i", "j", "k", "t", "value"), dwi.select("subject", "t", "b", "bx", "by", "bz").distinct()


def write_dwi(dwi: DataFrame, folder: str, shape: tuple[int, int, int, int], zooms: tuple[float, ...] = (1.0, 1.0, 1.0), affine: list[float] | None = None, dtype: str = "f4") -> DataFrame:
    """Each subject's image with its bval (one digit) and bvec (eight) files beside it; returns subject and path."""
    from pyarrow import fs

    from voxara.sources.images import write_images

    images, gradients = split_dwi(dwi)

    def write(key, rows):
        import pandas as pd

        rows = rows.sort_values("t")
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        lines = {"bval": [("%.1f", rows.b)], "bvec": [("%.8f", rows.bx), ("%.8f", rows.by), ("%.8f", rows.bz)]}
        for ending, parts in lines.items():
            with store.open_output_stream(f"{root}/{key[0]}.{ending}") as out:
                out.write("".join(" ".join(f % x for x in values) + "\n" for f, values in parts).encode())
        return pd.DataFrame({"subject": [str(key[0])], "volumes": [len(rows)]})

    wrote = gradients.groupBy("subject").applyInPandas(write, "subject string, volumes int")
    return write_images(images, folder, shape, zooms, affine, dtype).join(wrote, "subject").select("subject", "path")
