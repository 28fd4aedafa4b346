"""DICOM headers: a small tag reader over binaryFile, and grouping by series."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.functions.names import first_of

# Tags of the attributes by name, value types with long lengths, and the ids of the transfer syntaxes.
TAGS = {
    "PatientID": (0x0010, 0x0020), "StudyInstanceUID": (0x0020, 0x000D), "StudyDate": (0x0008, 0x0020), "InstitutionName": (0x0008, 0x0080),
    "Manufacturer": (0x0008, 0x0070), "ManufacturerModelName": (0x0008, 0x1090), "DeviceSerialNumber": (0x0018, 0x1000), "MagneticFieldStrength": (0x0018, 0x0087),
    "SeriesInstanceUID": (0x0020, 0x000E), "SeriesNumber": (0x0020, 0x0011), "SeriesDescription": (0x0008, 0x103E), "SeriesDate": (0x0008, 0x0021),
    "SeriesTime": (0x0008, 0x0031), "Rows": (0x0028, 0x0010), "Columns": (0x0028, 0x0011), "PixelSpacing": (0x0028, 0x0030),
    "SpacingBetweenSlices": (0x0018, 0x0088), "SliceThickness": (0x0018, 0x0050), "RepetitionTime": (0x0018, 0x0080), "EchoTime": (0x0018, 0x0081),
    "InversionTime": (0x0018, 0x0082), "DwellTime": (0x0019, 0x1018), "FlipAngle": (0x0018, 0x1314), "PixelBandwidth": (0x0018, 0x0095),
    "BandwidthPerPixelPhaseEncode": (0x0019, 0x1028), "NumberPhaseEncodingSteps": (0x0018, 0x0089), "InPlanePhaseEncodingDirection": (0x0018, 0x1312),
    "AcquisitionDate": (0x0008, 0x0022), "ContentDate": (0x0008, 0x0023), "Modality": (0x0008, 0x0060), "ProtocolName": (0x0018, 0x1030),
}
_LONG = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR", b"OV", b"SV", b"UV"}
IMPLICIT, BIG_ENDIAN, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
_NUMBERS = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}
#: Value types of attributes that are no text, where a file doesn't say.
_BINARY = {"Rows": b"US", "Columns": b"US", "BandwidthPerPixelPhaseEncode": b"FD"}
_NAMES = {v: k for k, v in TAGS.items()}
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
_UNKNOWN = 0xFFFFFFFF


def _element(raw: bytes, at: int, order: str, explicit: bool) -> tuple[tuple[int, int], bytes, int, int]:
    """Tag, value type, length and place of the value of the element at a place."""
    tag = struct.unpack_from(order + "HH", raw, at)
    if tag[0] == 0xFFFE or not explicit:
        return tag, b"", struct.unpack_from(order + "I", raw, at + 4)[0], at + 8
    kind = raw[at + 4 : at + 6]
    if kind in _LONG:
        return tag, kind, struct.unpack_from(order + "I", raw, at + 8)[0], at + 12
    return tag, kind, struct.unpack_from(order + "H", raw, at + 6)[0], at + 8


def _after_items(raw: bytes, at: int, order: str, explicit: bool, end: tuple[int, int]) -> int:
    """The place after the delimiter that ends a sequence or item of unknown length; what lies within may nest."""
    while at + 8 <= len(raw):
        tag, _, size, at = _element(raw, at, order, explicit)
        if tag == end:
            return at
        if size == _UNKNOWN:
            at = _after_items(raw, at, order, explicit, _ITEM_END if tag == _ITEM else _SEQUENCE_END)
        else:
            at += size
    return len(raw)


def _value(raw: bytes, kind: bytes, order: str) -> str:
    if kind in _NUMBERS:
        code = _NUMBERS[kind]
        values = struct.unpack(f"{order}{len(raw) // struct.calcsize(code)}{code}", raw[: len(raw) // struct.calcsize(code) * struct.calcsize(code)])
        return ",".join(str(int(v)) if float(v).is_integer() else repr(v) for v in values)
    return raw.decode("latin-1").strip("\0 ").replace("\\", ",")


def header(raw: bytes) -> dict[str, str]:
    """Known attributes of a file up to its pixels; multiple values comma-joined.

    Explicit and implicit value types, both byte orders and deflated files are
    read as the file's own group says; sequences are passed over. Attributes
    inside sequences don't count.
    """
    if raw[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, syntax = 132, ""
    while at + 8 <= len(raw) and struct.unpack_from("<H", raw, at)[0] == 0x0002:  # always explicit and little-endian
        tag, _, size, at = _element(raw, at, "<", True)
        if tag == (0x0002, 0x0010):
            syntax = raw[at : at + size].decode("latin-1").strip("\0 ")
        at += size
    if syntax == DEFLATED:
        raw, at = zlib.decompressobj(-15).decompress(raw[at:]), 0
    order, explicit, found = ">" if syntax == BIG_ENDIAN else "<", syntax != IMPLICIT, {}
    while at + 8 <= len(raw):
        tag, kind, size, at = _element(raw, at, order, explicit)
        if tag == (0x7FE0, 0x0010):
            break
        if size == _UNKNOWN:
            at = _after_items(raw, at, order, explicit and kind != b"UN", _SEQUENCE_END)
            continue
        if name := _NAMES.get(tag):
            found[name] = _value(raw[at : at + size], kind if explicit and kind != b"UN" else _BINARY.get(name, b"LO"), order)
        at += size
    return found


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, valid and a column per attribute; the date falls back along the other dates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw in b.column(1):
                try:
                    found.append(header(raw.as_py()))
                except (ValueError, struct.error, zlib.error):
                    found.append(None)
            columns = [b.column(0), pa.array([f is not None for f in found]), *[pa.array([(f or {}).get(n) for f in found], pa.string()) for n in TAGS]]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "valid", *TAGS])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    read = files.mapInArrow(run, "path string, valid boolean, " + ", ".join(f"{n} string" for n in TAGS))
    return read.withColumn("date", first_of(*[F.col(c) for c in ("StudyDate", "SeriesDate", "AcquisitionDate", "ContentDate")]))


def series(headers: DataFrame) -> DataFrame:
    """One row per (study, series): its files in order, and the distinct attribute tuples."""
    shown = F.struct("Modality", "SeriesDescription", "ProtocolName", "PixelSpacing")
    return headers.where("valid").groupBy("StudyInstanceUID", "SeriesInstanceUID").agg(F.sort_array(F.collect_list("path")).alias("files"), F.collect_set(shown).alias("attributes"), F.min("date").alias("date"))
