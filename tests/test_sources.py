"""Files written and read back; syntaxes of headers."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxara.sources import dicom, images, nifti, tracks

AFFINE = [2.0, 0, 0, -10, 0, 2, 0, -20, 0, 0, 3, 5, 0, 0, 0, 1]


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    folder = tmp_path_factory.mktemp("nifti")
    rng = np.random.default_rng(1)
    a = {"plain": rng.integers(0, 4, (5, 4, 3, 7)).astype("i2"), "big": rng.random((3, 3, 3))}
    (folder / "plain.nii").write_bytes(images.encode(a["plain"], AFFINE, [2.0, 2, 3, 1], compress=False))
    (folder / "deep").mkdir()
    (folder / "deep" / "big.nii.gz").write_bytes(images.encode(a["big"], AFFINE, [2.0, 2, 3]))
    (folder / "none.nii").write_bytes(b"no image at all")
    return folder, a


def test_source_reads_ranges_of_volumes(spark, stored):
    folder, a = stored
    nifti.register(spark)
    df = spark.read.format("nifti").option("path", str(folder)).option("volumes", "2").load()
    assert df.rdd.getNumPartitions() == 5  # four ranges of volumes and a compressed file
    got = {n: np.zeros(x.shape if x.ndim == 4 else (*x.shape, 1)) for n, x in a.items()}
    for r in df.withColumn("subject", nifti.subject_of()).collect():
        got[r.subject][r.i, r.j, r.k, r.t] = r.value
    assert (got["plain"] == a["plain"]).all() and (got["big"][..., 0] == a["big"]).all()
    heads = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("nifti").option("path", f"file://{folder}").option("headers", "true").load().collect()}
    assert heads["plain.nii"]["shape"] == [5, 4, 3, 7] and heads["plain.nii"].dtype == "i2" and heads["big.nii.gz"].affine == AFFINE and len(heads) == 2


def test_filters_leave_volumes_unread(spark, stored):
    folder, a = stored
    reader = nifti.NiftiReader(str(folder), 2, False)
    kept = list(reader.pushFilters([nifti.EqualTo(("t",), 3)]))
    parts = reader.partitions()
    assert len(kept) == 1 and [(p.first, p.count) for p in parts] == [(2, 2)]
    assert {t for p in parts for b in reader.read(p) for t in b.column("t").to_pylist()} == {3}
    reader.filters = [nifti.In(("path",), ("nowhere",))]
    assert [p.count for p in reader.partitions()] == [0] and list(reader.read(reader.partitions()[0])) == []


def test_dwi_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s in ("s1", "s2"):
        for at in np.ndindex(3, 2, 2, 4):
            t = at[3]
            want[(s, *at)] = v = float(np.float32(rng.random() + 1))
            rows.append((s, *at, v, 1000.0 * (t > 0), float(t == 1), float(t == 2), float(t == 3)))
    df = spark.createDataFrame(rows, "subject string, i int, j int, k int, t int, value double, b double, bx double, by double, bz double")
    paths = nifti.write_dwi(df, f"file://{tmp_path}", (3, 2, 2, 4), (2.0, 2.0, 3.0), AFFINE).collect()
    assert {p.subject for p in paths} == {"s1", "s2"}
    back = nifti.read_dwi(spark, str(tmp_path)).collect()
    assert {(r.subject, r.i, r.j, r.k, r.t): r.value for r in back} == want
    assert {(r.t, r.b, r.bx, r.by, r.bz) for r in back} == {(0, 0, 0, 0, 0), (1, 1000, 1, 0, 0), (2, 1000, 0, 1, 0), (3, 1000, 0, 0, 1)}
    assert (tmp_path / "s1.bval").read_text() == "0.0 1000.0 1000.0 1000.0\n" and (tmp_path / "s1.bvec").read_text().splitlines()[0].split()[1] == "1.00000000"
    head, _ = images.decode((tmp_path / "s2.nii.gz").read_bytes())
    assert head["affine"] == AFFINE and head["shape"] == [3, 2, 2, 4]
    (tmp_path / "s1.bval").unlink()
    voxels, gradients = nifti.split_dwi(nifti.join_dwi(df.select("subject", "i", "j", "k", "t", "value"), df.select("subject", "t", "b", "bx", "by", "bz").distinct().where("subject = 's2'")))
    assert voxels.count() == 96 and {r.b for r in gradients.where("subject = 's1'").collect()} == {0.0}


def test_tensor_images_are_known(spark):
    df = spark.createDataFrame([(1005, [2, 2, 2, 1, 6]), (1005, [2, 2, 2, 6]), (0, [2, 2, 2, 1, 6]), (1005, [2, 2, 2, 1, 5])], "intent int, shape array<int>")
    assert [r.t for r in df.select(images.is_tensor(F.col("intent"), F.col("shape")).alias("t")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("kind", ["trk", "tck"])
def test_track_round_trip(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(tracks, "_POINTS", 5)
    rng = np.random.default_rng(3)
    rows = [(s, n * 2, q, *map(float, rng.random(3).astype(np.float32))) for s in (1, 2) for n in range(6) for q in range(1 + n)]
    df = spark.createDataFrame(rows, "subject long, streamline long, seq long, x double, y double, z double")
    wrote = {r.subject: r.streamlines for r in tracks.write_tracks(df, f"file://{tmp_path}", kind, (9, 9, 9), (2.0, 2.0, 2.0), AFFINE).collect()}
    assert wrote == {"1": 6, "2": 6}
    back = sorted((int(r.path[-5]), r.streamline * 2, r.seq, r.x, r.y, r.z) for r in tracks.read_points(spark, str(tmp_path)).collect())
    assert back == sorted(rows)
    with pytest.raises(ValueError):
        tracks.write_tracks(df, f"file://{tmp_path}", "vtk")


def _part(order, explicit, name, kind, raw):
    raw += b" " * (len(raw) % 2)
    tag = struct.pack(order + "HH", *dicom.TAGS[name])
    return tag + (kind + struct.pack(order + "H", len(raw)) if explicit else struct.pack(order + "I", len(raw))) + raw


def _file(syntax):
    order, explicit = (">" if syntax == dicom.BIG_ENDIAN else "<"), syntax != dicom.IMPLICIT
    uid = syntax.encode() + b"\0" * (len(syntax) % 2)
    meta = struct.pack("<HH", 2, 16) + b"UI" + struct.pack("<H", len(uid)) + uid
    item = struct.pack(order + "HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + _part(order, explicit, "PatientID", b"LO", b"inner") + struct.pack(order + "HHI", 0xFFFE, 0xE00D, 0)
    head = struct.pack(order + "HH", 8, 0x1140) + (b"SQ\0\0" if explicit else b"") + struct.pack(order + "I", 0xFFFFFFFF)
    body = _part(order, explicit, "StudyDate", b"DA", b"20200102") + head + item + struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0)
    body += _part(order, explicit, "PatientID", b"LO", b"p7") + _part(order, explicit, "FlipAngle", b"DS", b"90") + _part(order, explicit, "BandwidthPerPixelPhaseEncode", b"FD", struct.pack(order + "d", 12.5))
    body += _part(order, explicit, "StudyInstanceUID", b"UI", b"1.2") + _part(order, explicit, "Rows", b"US", struct.pack(order + "H", 300)) + _part(order, explicit, "PixelSpacing", b"DS", b"2\\2.5")
    if syntax == dicom.DEFLATED:
        z = zlib.compressobj(wbits=-15)
        body = z.compress(body) + z.flush()
    return b"\0" * 128 + b"DICM" + meta + body


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", dicom.IMPLICIT, dicom.BIG_ENDIAN, dicom.DEFLATED])
def test_transfer_syntaxes(syntax):
    assert dicom.header(_file(syntax)) == {"StudyDate": "20200102", "PatientID": "p7", "FlipAngle": "90", "BandwidthPerPixelPhaseEncode": "12.5", "StudyInstanceUID": "1.2", "Rows": "300", "PixelSpacing": "2,2.5"}


def test_broken_deflation_is_no_image(spark, tmp_path):
    raw = _file(dicom.DEFLATED)
    (tmp_path / "a.dcm").write_bytes(raw[: 132 + 8 + len(dicom.DEFLATED)] + b"\xff" * 40)
    (tmp_path / "b.dcm").write_bytes(_file(dicom.IMPLICIT))
    assert {(r.valid, r.Rows) for r in dicom.read_headers(spark, str(tmp_path)).collect()} == {(False, None), (True, "300")}


def test_many_files_are_few_partitions(spark, tmp_path):
    for n in range(450):
        (tmp_path / f"{n}.nii.gz").write_bytes(images.encode(np.full((1, 1, 1), float(n + 1)), AFFINE, [2.0, 2, 3]))
    reader = nifti.NiftiReader(f"file://{tmp_path}", 16, False)
    assert len(reader.partitions()) == 150
    nifti.register(spark)
    df = spark.read.format("nifti").option("path", str(tmp_path)).load()
    assert sorted(r.value for r in df.collect()) == [float(n + 1) for n in range(450)]
    assert spark.read.format("nifti").option("path", str(tmp_path)).option("headers", "true").load().count() == 450
