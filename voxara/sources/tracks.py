"""Streamline files (tck and trk) as point tables."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.operators.batches import _starts

_OFFSET = 256
#: Points of a batch, about, and bytes of a file that are read or copied at once.
_POINTS, _BYTES = 1 << 16, 1 << 22
#: Stores whose files tasks open themselves; files of others come whole from Spark's reader.
_OPENED = ("file", "hdfs", "s3", "gs")


def _tck_lines(source: BinaryIO) -> Iterator[np.ndarray]:
    """The streamlines of an open tck file, read in pieces."""
    raw = source.read(_BYTES)
    while b"END" not in raw and (more := source.read(_BYTES)):
        raw += more
    fields = dict(line.split(": ", 1) for line in raw[: raw.index(b"END")].decode("ascii", "replace").splitlines() if ": " in line)
    kind, offset = ">f4" if fields["datatype"].endswith("BE") else "<f4", int(fields["file"].split()[-1])
    while len(raw) < offset and (more := source.read(_BYTES)):
        raw += more
    raw, held, last = raw[offset:], [], False
    while True:
        whole = len(raw) // 12 * 12
        points, raw = np.frombuffer(raw[:whole], kind).reshape(-1, 3).astype(np.float64), raw[whole:]
        last = bool(np.isinf(points[:, 0]).any())
        points = points[: int(np.argmax(np.isinf(points[:, 0])))] if last else points
        *done, rest = np.split(points, np.flatnonzero(np.isnan(points[:, 0])))
        for part in done:  # all but the first begin with the NaN that ended the one before
            held.append(part)
            line = np.concatenate(held)
            line, held = line[~np.isnan(line[:, 0])], []
            if len(line):
                yield line
        held.append(rest)
        if last or not (more := source.read(_BYTES)):
            break
        raw += more
    line = np.concatenate(held)
    line = line[~np.isnan(line[:, 0])]
    if len(line):
        yield line


def decode_tck(raw: bytes) -> list[np.ndarray]:
    """Streamlines of a tck file: float triples, NaN between streamlines and infinity at the end."""
    return list(_tck_lines(io.BytesIO(raw)))


def _tck_head(n: int) -> bytes:
    # A fixed offset leaves room for the header, whatever the count.
    return f"mrtrix tracks\ndatatype: Float32LE\ncount: {n}\nfile: . {_OFFSET}\nEND\n".encode().ljust(_OFFSET, b"\0")


def _tck_body(streamlines: list[np.ndarray]) -> bytes:
    return b"".join(np.append(np.asarray(s, "<f4"), np.full((1, 3), np.nan, "<f4"), 0).tobytes() for s in streamlines)


_TCK_END = np.full((1, 3), np.inf, "<f4").tobytes()


def encode_tck(streamlines: list[np.ndarray]) -> bytes:
    return _tck_head(len(streamlines)) + _tck_body(streamlines) + _TCK_END


def _trk_lines(source: BinaryIO) -> Iterator[np.ndarray]:
    """The streamlines of an open trk file, read in pieces."""
    raw = source.read(max(_BYTES, 1000))
    scalars, properties = struct.unpack_from("<h", raw, 36)[0], struct.unpack_from("<h", raw, 238)[0]
    at, width = struct.unpack_from("<i", raw, 996)[0], 3 + scalars
    while True:
        n = struct.unpack_from("<i", raw, at)[0] if at + 4 <= len(raw) else None
        size = 4 if n is None else 4 + 4 * (n * width + properties)
        if at + size > len(raw) and (more := source.read(max(_BYTES, at + size - len(raw)))):
            raw, at = raw[at:] + more, 0
        elif n is None:
            return
        else:
            yield np.frombuffer(raw, "<f4", n * width, at + 4).reshape(n, width)[:, :3].astype(np.float64)
            at += size


def decode_trk(raw: bytes) -> list[np.ndarray]:
    """Streamlines of a trk file, in its own mm coordinates."""
    return list(_trk_lines(io.BytesIO(raw)))


def _trk_head(n: int, shape: tuple[int, int, int], zooms: tuple[float, float, float], affine: list[float] | None) -> bytes:
    head = bytearray(1000)
    head[:5] = b"TRACK"
    struct.pack_into("<3h3f", head, 6, *shape, *zooms)
    struct.pack_into("<16f", head, 440, *(affine or [zooms[0], 0, 0, 0, 0, zooms[1], 0, 0, 0, 0, zooms[2], 0, 0, 0, 0, 1]))
    head[948:951] = b"RAS"
    struct.pack_into("<3i", head, 988, n, 2, 1000)
    return bytes(head)


def _trk_body(streamlines: list[np.ndarray]) -> bytes:
    return b"".join(struct.pack("<i", len(s)) + np.asarray(s, "<f4").tobytes() for s in streamlines)


def encode_trk(streamlines: list[np.ndarray], shape: tuple[int, int, int] = (1, 1, 1), zooms: tuple[float, float, float] = (1.0, 1.0, 1.0), affine: list[float] | None = None) -> bytes:
    """A trk file of the streamlines in its own mm coordinates; ``affine`` (sixteen numbers by rows) takes voxels to the world."""
    return _trk_head(len(streamlines), shape, zooms, affine) + _trk_body(streamlines)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """path, streamline, seq, x, y, z of all tck and trk files; many streamlines to a batch, files read in pieces."""

    def opened(name: str, content: bytes | None) -> BinaryIO:
        from pyarrow import fs

        if content is not None:
            return io.BytesIO(content)
        scheme, _, rest = name.partition(":")
        # Spark writes file:/a for file:///a.
        store, at = fs.FileSystem.from_uri(name if rest.startswith("//") else f"{scheme}://{rest}")
        return store.open_input_stream(at, compression=None)

    def points(name: str, first: int, held: list[np.ndarray]) -> pa.RecordBatch:
        p, sizes = np.concatenate(held), [len(x) for x in held]
        seq = np.concatenate([np.arange(n) for n in sizes])
        return pa.RecordBatch.from_arrays([pa.array([name] * len(p)), pa.array(np.repeat(np.arange(first, first + len(held)), sizes)), pa.array(seq), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)]], names=["path", "streamline", "seq", "x", "y", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, name in enumerate(b.column(0).to_pylist()):
                first, held, size = 0, [], 0
                with opened(name, b.column(1)[row].as_py() if b.num_columns > 1 else None) as source:
                    for line in (_tck_lines if name.endswith(".tck") else _trk_lines)(source):
                        if held and size + len(line) > _POINTS:
                            yield points(name, first, held)
                            first, held, size = first + len(held), [], 0
                        held.append(line)
                        size += len(line)
                if held:
                    yield points(name, first, held)

    schema = "path string, streamline long, seq long, x double, y double, z double"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path rlike '[.](tck|trk)$'")
    one = files.select("path").head()
    # Names alone are read of files that tasks open themselves.
    return files.select("path", *(["content"] if one is not None and one.path.split(":")[0] not in _OPENED else [])).mapInArrow(run, schema)


def write_tracks(points: DataFrame, folder: str, kind: str = "trk", shape: tuple[int, int, int] = (1, 1, 1), zooms: tuple[float, float, float] = (1.0, 1.0, 1.0), affine: list[float] | None = None) -> DataFrame:
    """One tck or trk file per subject: its streamlines by number, points by seq. Returns subject, path and streamlines.

    A task writes a subject's points as they come, sorted, and holds one
    streamline and a piece of others; a file appears under its name only when it
    is whole. As the header has the count, the rest is written first, beside it.
    """
    from pyarrow import fs

    if kind not in ("tck", "trk"):
        raise ValueError(f"not a kind of track file: {kind}")
    body, end = (_tck_body, _TCK_END) if kind == "tck" else (_trk_body, b"")

    def finished(store, root: str, part: str, subject: str, n: int) -> pa.RecordBatch:
        whole = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(whole) as out, store.open_input_stream(part) as source:
            out.write(_tck_head(n) if kind == "tck" else _trk_head(n, shape, zooms, affine))
            while piece := source.read(_BYTES):
                out.write(piece)
            out.write(end)
        store.delete_file(part)
        store.move(whole, f"{root}/{subject}.{kind}")
        return pa.RecordBatch.from_pydict({"subject": [subject], "path": [f"{folder}/{subject}.{kind}"], "streamlines": [n]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = None
        for b in batches:
            at = np.append(_starts(b, ["subject"]), b.num_rows)
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                subject, line = str(b.column("subject")[low].as_py()), b.column("streamline").slice(low, high - low).to_numpy(zero_copy_only=False)
                p = np.stack([b.column(c).slice(low, high - low).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
                if out is None or subject != open_subject:
                    if out is not None:
                        out.write(body([np.concatenate(held)]))
                        out.close()
                        yield finished(store, root, part, open_subject, n + 1)
                    part = f"{root}/.{uuid.uuid4().hex}"
                    out, open_subject, n, held, last = store.open_output_stream(part), subject, 0, [], line[0]
                parts = np.split(p, np.flatnonzero(np.append(line[0] != last, line[1:] != line[:-1])))
                held.append(parts[0])
                if len(parts) > 1:
                    out.write(body([np.concatenate(held), *parts[1:-1]]))
                    n, held = n + len(parts) - 1, [parts[-1]]
                last = line[-1]
        if out is not None:
            out.write(body([np.concatenate(held)]))
            out.close()
            yield finished(store, root, part, open_subject, n + 1)

    rows = points.select("subject", "streamline", "seq", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    order = [F.col("subject"), F.asc_nulls_last("streamline"), F.asc_nulls_last("seq")]
    return rows.repartition("subject").sortWithinPartitions(*order).mapInArrow(run, "subject string, path string, streamlines long")
