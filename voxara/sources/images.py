"""NIfTI-1 files as voxel tables, and back.

Files are listed and read by Spark's binaryFile source, so any store that Spark
reaches will do; each task decodes whole files, one at a time.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_CODES = {v: k for k, v in TYPES.items()}
_HEADER = 348


def decode_header(raw: bytes) -> dict:
    """Fields of a NIfTI-1 header from its first 352 bytes, or from the first part of a gzip file."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompressobj(31).decompress(raw, 352)
    order = "<" if len(raw) >= 4 and struct.unpack_from("<i", raw)[0] == _HEADER else ">"
    if len(raw) < _HEADER or struct.unpack_from(order + "i", raw)[0] != _HEADER or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", raw, 40)
    shape = [max(1, d) for d in dim[1 : dim[0] + 1]]
    intent, code = struct.unpack_from(order + "hh", raw, 68)
    zooms = struct.unpack_from(order + "8f", raw, 76)[1 : dim[0] + 1]
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    affine = [*struct.unpack_from(order + "12f", raw, 280), 0.0, 0.0, 0.0, 1.0]
    return {"shape": shape, "zooms": [float(z) for z in zooms], "affine": affine, "intent": intent, "dtype": TYPES[code], "order": order, "offset": int(offset), "slope": slope, "inter": inter}


def is_tensor(intent: Column, shape: Column) -> Column:
    """Whether an image holds tensors: the intent of symmetric matrices, five dimensions, six values."""
    return (intent == 1005) & (F.size(shape) == 5) & (F.get(shape, F.lit(4)) == 6)


def decode(raw: bytes) -> tuple[dict, np.ndarray]:
    """Header fields and values of a NIfTI-1 file; gzip is undone, scaling applied."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head = decode_header(raw[:352])
    values = np.frombuffer(raw, head["order"] + head["dtype"], int(np.prod(head["shape"])), head["offset"]).astype(np.float64).reshape(head["shape"], order="F")
    if head["slope"]:
        values = values * head["slope"] + head["inter"]
    return {k: head[k] for k in ("shape", "zooms", "affine", "intent", "dtype")}, values


def encode(values: np.ndarray, affine: list[float] | None = None, zooms: list[float] | None = None, intent: int = 0, compress: bool = True) -> bytes:
    """A NIfTI-1 file of the values; codes of both transforms are 1."""
    head = bytearray(352)
    kind = np.dtype(values.dtype).str[1:]
    zooms = zooms or [1.0] * values.ndim
    affine = affine or [zooms[0], 0, 0, 0, 0, zooms[1], 0, 0, 0, 0, zooms[2], 0, 0, 0, 0, 1]
    struct.pack_into("<i", head, 0, _HEADER)
    struct.pack_into(f"<{values.ndim + 1}h", head, 40, values.ndim, *values.shape)
    struct.pack_into("<hhh", head, 68, intent, _CODES[kind], values.dtype.itemsize * 8)
    struct.pack_into(f"<{values.ndim + 1}f", head, 76, 1.0, *zooms)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<hh", head, 252, 1, 1)
    struct.pack_into("<12f", head, 280, *affine[:12])
    head[344:348] = b"n+1\0"
    out = bytes(head) + values.astype("<" + kind).tobytes(order="F")
    return gzip.compress(out) if compress else out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"(\.nii|\.nii\.gz)$"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable image; a file that isn't one has ``valid`` false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    head = decode_header(raw.as_py())
                    rows.append((name, True, head["shape"], head["zooms"], head["affine"], head["intent"], head["dtype"]))
                except (ValueError, KeyError, struct.error, OSError, zlib.error):
                    rows.append((name, False, None, None, None, None, None))
            kinds = [pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "valid", "shape", "zooms", "affine", "intent", "dtype"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, valid boolean, shape array<int>, zooms array<double>, affine array<double>, intent int, dtype string")


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Non-zero voxels of all images: path, i, j, k, t, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, v = decode(raw.as_py())
                v = v.reshape([*v.shape, *[1] * (4 - v.ndim)]) if v.ndim < 4 else v.reshape([*v.shape[:3], -1])
                for t in range(v.shape[3]):  # one volume at a time
                    at = np.nonzero(v[..., t])
                    n = len(at[0])
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), *[pa.array(a.astype(np.int32)) for a in at], pa.array(np.full(n, t, np.int32)), pa.array(v[..., t][at])], names=["path", "i", "j", "k", "t", "value"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, i int, j int, k int, t int, value double")


def write_images(voxels: DataFrame, folder: str, shape: tuple[int, ...], zooms: tuple[float, ...] = (1.0, 1.0, 1.0), affine: list[float] | None = None, dtype: str = "f4", intent: int = 0) -> DataFrame:
    """One file per subject in the folder; returns subject and path. An image is held by one task.

    ``voxels`` has t where the shape has four dimensions; then volumes are
    written along the last. ``affine`` has sixteen numbers by rows. A file
    appears under its name only when it is whole, so a task that runs again
    leaves no half of one.
    """
    from pyarrow import fs

    axes = ["i", "j", "k", "t"][: len(shape)]

    def write(key, rows):
        import uuid

        import pandas as pd

        v = np.zeros(shape, dtype)
        v[tuple(rows[a].to_numpy() for a in axes)] = rows.value.to_numpy()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            out.write(encode(v, affine, [*zooms, *[1.0] * (len(shape) - len(zooms))], intent))
        store.move(part, f"{root}/{key[0]}.nii.gz")
        return pd.DataFrame({"subject": [str(key[0])], "path": [f"{folder}/{key[0]}.nii.gz"]})

    return voxels.select("subject", *axes, "value").groupBy("subject").applyInPandas(write, "subject string, path string")
