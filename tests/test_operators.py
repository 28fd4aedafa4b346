"""Operators against plain numpy on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxara.functions import names
from voxara.operators import harmonize, images, kernels, matrices, regression, tensor, tracks, volumes
from voxara.operators import statistics as st
from voxara.plans import filters
from voxara.operators.regression import ols_terms
from voxara.plans.filters import cohort_filter, design, missing_to_null, terms
from voxara.sources import images as files
from voxara.sources import text
from voxara.streaming import quality


def test_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, x double")
    of = lambda e: sorted(r.g for r in df.where(cohort_filter(df, e)).collect())
    assert of("g=a,c") == ["a", "c"] and of("g!a") == ["b", "c"]
    assert of("x<2") == ["a"] and of("x>2") == ["c"] and of("1<x<3") == ["b"] and of("3>x>1") == ["b"]


def test_missing_values(spark):
    df = missing_to_null(spark.createDataFrame([("NA",), (".",), (" ",), ("1",)], "x string"), ["x"])
    assert [r.x for r in df.collect()] == [None, None, None, "1"]


def test_formula(spark):
    assert terms("a * b + c") == ["a", "b", "a:b", "c"]
    rng = np.random.default_rng(0)
    n = 60
    x, g = rng.normal(size=n), rng.integers(0, 2, n)
    y = 2 + 3 * x - g + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(int(i), "f", float(a), "ab"[b], float(c)) for i, (a, b, c) in enumerate(zip(x, g, y, strict=True))], "subject long, feature string, x double, g string, y double")
    planned, columns = design(df, "x + g")
    assert columns == ["x", "g[T.b]"]
    got = {r.term: r.coefficient for r in ols_terms(planned, columns).collect()}
    expected = np.linalg.lstsq(np.column_stack([np.ones(n), x, g]), y, rcond=None)[0]
    assert np.allclose([got["Intercept"], got["x"], got["g[T.b]"]], expected)


def test_t_distribution(spark):
    # Two-sided p-values by numeric integration of the density.
    from math import lgamma, pi

    for df in (1, 2, 3, 4, 5, 10, 31):
        for t in (0.3, 1.5, 4.0):
            x = np.tan(np.linspace(0, np.arctan(t), 200_001))
            density = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / np.sqrt(df * pi) * (1 + x * x / df) ** (-(df + 1) / 2)
            expected = 1 - 2 * np.trapezoid(density, x)
            got = spark.range(1).select(st.t_two_sided(F.lit(t), F.lit(df)).alias("p")).first().p
            assert got == pytest.approx(expected, abs=1e-7)


def test_normal_tail(spark):
    p = spark.range(1).select(st.normal_two_sided(F.lit(1.959963985)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-6)


def test_false_discovery_with_ties(spark):
    p = [0.01, 0.04, 0.03, 0.04, 1.0, 0.2]
    df = spark.createDataFrame(list(enumerate(p)), "feature int, p double")
    got = {r.feature: r for r in st.false_discovery(df).collect()}
    made = [x for x in p if x < 1]
    for k, x in enumerate(p):
        expected = 1.0 if x == 1 else min(len(made) / sum(m <= v for m in made) * v for v in made if v >= x)
        assert got[k].q_bh == pytest.approx(expected)


def test_erosion_and_dilation(spark):
    cells = [(0, i, j, k, 1) for i in range(5) for j in range(5) for k in range(5)]
    df = spark.createDataFrame(cells, "subject int, i int, j int, k int, value int")
    assert images.erode(df).count() == 27 and images.erode(df, "NN3", 2).count() == 1
    assert images.dilate(df.where("i = 2 and j = 2 and k = 2"), {"i": 5, "j": 5, "k": 5}).count() == 7


def test_paths(spark):
    # A line of four nodes: distances 1, 2, 3.
    edges = [(0, i, i + 1, 1.0) for i in range(3)] + [(0, i + 1, i, 1.0) for i in range(3)]
    got = matrices.shortest_paths(spark.createDataFrame(edges, "subject long, i int, j int, w double"), 4).first()
    assert got.efficiency == pytest.approx(2 * (3 + 2 / 2 + 1 / 3) / 12)
    assert got.path_length == pytest.approx(2 * (3 + 4 + 3) / 12)
    assert got.mean_betweenness == pytest.approx((4 + 4) / 4 / 6)


def test_combat_removes_shifts(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f"f{f}", s % 2, float(rng.normal() * (1 + s % 2) + 5 * (s % 2) + f)) for s in range(80) for f in range(6)]
    df = spark.createDataFrame(rows, "subject long, feature string, batch int, y double")
    for eb in (True, False):
        means = harmonize.combat(df, eb).groupBy("feature", "batch").agg(F.avg("y").alias("m"), F.stddev("y").alias("s")).toPandas().pivot(index="feature", columns="batch")
        assert np.abs(means["m"][0] - means["m"][1]).max() < 0.5
        assert np.abs(means["s"][0] / means["s"][1] - 1).max() < 0.4


def test_tensor_scalars_match_eigh(spark):
    rng = np.random.default_rng(2)
    rows = []
    for v in range(20):
        m = rng.normal(size=(3, 3))
        m = m @ m.T if v else np.zeros((3, 3))
        rows.append((0, v, *[float(m[a]) for a in ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2))]))
    got = {r.voxel: r for r in tensor.scalars(spark.createDataFrame(rows, "subject long, voxel long, xx double, xy double, yy double, xz double, yz double, zz double")).collect()}
    for _, v, xx, xy, yy, xz, yz, zz in rows:
        e = np.linalg.eigvalsh([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])[::-1]
        assert np.allclose([got[v].l1, got[v].l2, got[v].l3], e, atol=1e-9)
    assert got[0].fa == 0


def test_tensor_fit_and_free_water(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(30, 3))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[0], b = 0, np.array([0.0] + [1000.0] * 29)
    true = np.array([1.7e-3, 1e-4, 4e-4, 5e-5, -1e-4, 3e-4])
    x = kernels.design_matrix(b, vectors)
    signal = np.exp(x[:, :6] @ true)
    df = spark.createDataFrame([(0, 0, [float(v) * 900 for v in signal])], "subject long, voxel long, signal array<double>")
    for weighted in (True, False):
        r = kernels.fit_tensors(df, b.tolist(), vectors.tolist(), weighted).first()
        assert np.allclose([r.xx, r.xy, r.yy, r.xz, r.yz, r.zz], true, atol=1e-8)
    mixed = 0.7 * signal + 0.3 * np.exp(-b * 3e-3)
    start = spark.createDataFrame([(0, 0, mixed.tolist(), 0.7, true.tolist())], "subject long, voxel long, signal array<double>, fraction double, tensor array<double>")
    r = kernels.free_water(start, b.tolist(), vectors.tolist()).first()
    assert r.free_water == pytest.approx(0.3, abs=1e-3)


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, (4, 5, 6)).astype(np.int16)
    (tmp_path / "a.nii").write_bytes(files.encode(v, compress=False))
    (tmp_path / "b.nii.gz").write_bytes(files.encode(np.stack([v, v], -1).astype(np.float32)))
    (tmp_path / "c.nii").write_bytes(b"no image")
    heads = {r.path.rsplit("/", 1)[1]: r for r in files.read_headers(spark, str(tmp_path)).collect()}
    assert heads["a.nii"].shape == [4, 5, 6] and heads["b.nii.gz"].shape == [4, 5, 6, 2] and not heads["c.nii"].valid
    (tmp_path / "c.nii").unlink()
    voxels = files.read_voxels(spark, str(tmp_path)).toPandas()
    assert len(voxels) == 3 * np.count_nonzero(v)
    one = voxels[voxels.path.str.endswith("a.nii")]
    assert (v[one.i, one.j, one.k] == one.value).all()
    table = spark.createDataFrame(one.assign(subject=7)[["subject", "i", "j", "k", "value"]])
    wrote = files.write_images(table, f"file://{tmp_path}/out", (4, 5, 6)).collect()
    again = files.read_voxels(spark, wrote[0].path).count()
    assert again == np.count_nonzero(v)


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.bval").write_text("0 1000 2000\n")
    (tmp_path / "x.bvec").write_text("0 1 0\n0 0 1\n0 0 0\n")
    (tmp_path / "m.txt").write_text("0 1\n3 0\n")
    (tmp_path / "s.json").write_text('{"PhaseEncodingDirection": "j-", "EffectiveEchoSpacing": 0.001,\n "PhaseEncodingSteps": 101}')
    (tmp_path / "c.csv").write_text("subject,Age\na,NA\nb,30\nb,30\n")
    assert [r.b for r in text.read_bvals(spark, str(tmp_path / "x.bval")).orderBy("t").collect()] == [0, 1000, 2000]
    assert [(r.bx, r.by) for r in text.read_bvecs(spark, str(tmp_path / "x.bvec")).orderBy("t").collect()] == [(0, 0), (1, 0), (0, 1)]
    cells = text.read_matrix(spark, str(tmp_path / "m.txt")).withColumn("subject", F.lit(0))
    assert {(r.i, r.j): r.w for r in matrices.symmetrise(cells).collect()}[0, 1] == 2
    side = text.read_sidecars(spark, str(tmp_path / "s.json")).first()
    assert side.pe_j == -1 and side.readout == pytest.approx(0.1)
    assert text.read_cohort(spark, str(tmp_path / "c.csv"), ["Age"]).where("Age is null").count() == 1
    with pytest.raises(ValueError):
        text.read_cohort(spark, str(tmp_path / "c.csv"), ["Sex"])


def test_gradients_and_names(spark):
    g = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, -1.0, 0.0, 0.0), (0, 3, 0.0, 0.0, 0.0)], "subject int, t int, bx double, by double, bz double")
    assert sorted(r.t for r in volumes.unique_gradients(g).collect()) == [0, 2]
    row = spark.range(1).select(volumes.round_bvals(F.lit(50.0)).alias("a"), volumes.round_bvals(F.lit(150.0)).alias("b"), volumes.lmax(F.lit(45)).alias("l"), names.parse_time(F.lit("010203.5")).alias("t"), names.strip_ext(F.lit("/a.b/c.tar.gz")).alias("s"), names.strip_ext(F.lit("x.nii.gz")).alias("n")).first()
    assert (row.a, row.b, row.l, row.t, row.s, row.n) == (0.0, 200.0, 8, 3723, "/a.b/c", "x")


def test_kappa(spark):
    a = spark.createDataFrame([(0, i, 0, 0) for i in range(4)], "subject int, i int, j int, k int")
    b = a.where("i >= 2")
    # Agreement 8 of 10; chance (6 * 8 + 4 * 2) / 100.
    assert tracks.kappa(a, b, 10).first().kappa == pytest.approx((0.8 - 0.56) / 0.44)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).selectExpr("timestamp_seconds(id * 600) AS ts", "CAST(id % 3 AS STRING) AS event_type", "CAST(id % 100 AS DOUBLE) AS value")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    quality.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.event_type): (r.n, r.bad) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.start, r.event_type): (r.n, r.bad) for r in quality.bad_share(events).collect()}
    assert got and all(whole[k] == v for k, v in got.items())


def test_nonparametric_and_covariance_harmonisation(spark):
    rng = np.random.default_rng(8)
    rows = [(s, f"f{f}", s % 2, float(rng.normal() * (1 + s % 2) + 3 * (s % 2) + f)) for s in range(60) for f in range(5)]
    df = spark.createDataFrame(rows, "subject long, feature string, batch int, y double")
    for f in (harmonize.combat_nonparametric, harmonize.covbat, harmonize.combat_mean_only):
        out = f(df).groupBy("batch").agg(F.avg("y").alias("m"), F.count("*").alias("n")).toPandas().set_index("batch")
        assert (out.n == 150).all() and abs(out.m[0] - out.m[1]) < 0.3


def test_communities(spark):
    edges = [(0, a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a != b] + [(0, 3, 4, 0.1), (0, 4, 3, 0.1)]
    got = {r.node: r.module for r in matrices.communities(spark.createDataFrame(edges, "subject long, i int, j int, w double"), 8).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(4, 8)}) == 1 and got[0] != got[7]


def test_track_files(spark, tmp_path):
    from voxara.sources import tracks as track_files

    lines = [np.arange(9.0).reshape(3, 3), np.ones((2, 3))]
    (tmp_path / "a.tck").write_bytes(track_files.encode_tck(lines))
    got = track_files.read_points(spark, str(tmp_path)).toPandas().sort_values(["streamline", "seq"])
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), np.concatenate(lines)) and list(got.streamline) == [0, 0, 0, 1, 1]


def test_dicom_headers(spark, tmp_path):
    from voxara.sources import dicom

    def element(name, value):
        group, number = dicom.TAGS[name]
        raw = value.encode().ljust(len(value) + len(value) % 2)
        return np.array([group, number], "<u2").tobytes() + b"LO" + np.array([len(raw)], "<u2").tobytes() + raw

    body = b"\0" * 128 + b"DICM" + element("StudyDate", "") + element("AcquisitionDate", "20200102") + element("StudyInstanceUID", "1.2") + element("SeriesInstanceUID", "1.2.3") + element("PixelSpacing", "2\\3")
    for n in range(2):
        (tmp_path / f"{n}.dcm").write_bytes(body)
    (tmp_path / "x.dcm").write_bytes(b"none")
    heads = dicom.read_headers(spark, str(tmp_path))
    assert heads.where("not valid").count() == 1
    row = dicom.series(heads).first()
    assert row.date == "20200102" and len(row.files) == 2 and row.attributes[0].PixelSpacing == "2,3"


def test_covariance_harmonisation_keeps_incomplete_subjects(spark):
    rng = np.random.default_rng(9)
    rows = [(s, f"f{f}", s % 2, float(rng.normal() * (1 + s % 2) + 3 * (s % 2) + f)) for s in range(60) for f in range(4) if (s * 7 + f) % 5]
    rows.append((0, "f1", 0, 1.5))  # a feature twice
    df = spark.createDataFrame(rows, "subject long, feature string, batch int, y double")
    once = harmonize.combat(df).toPandas()
    scale = once.groupby("feature").y.agg(["mean", lambda y: y.std(ddof=0)]).to_numpy()
    once["z"] = [(y - scale[int(f[1]), 0]) / scale[int(f[1]), 1] for f, y in zip(once.feature, once.y, strict=True)]
    means = once.groupby(["subject", "feature"]).z.mean()
    z = means.unstack().reindex(range(60)).fillna(0.0).to_numpy()
    values, axes = np.linalg.eigh(np.cov(z.T))
    axes, share = axes[:, ::-1], np.cumsum(values[::-1]) / values.sum()
    scores, batch = z @ axes, np.arange(60) % 2
    for k in range(np.searchsorted(share, 0.95) + 1):
        grand, sd = scores[:, k].mean(), np.sqrt(np.mean([scores[batch == b, k].var() for b in (0, 1)]))
        for b in (0, 1):
            x = (scores[batch == b, k] - grand) / sd
            scores[batch == b, k] = (x - x.mean()) / x.std(ddof=1) * sd + grand
    back = scores @ axes.T
    expected = sorted((r.subject, r.feature, (back[r.subject, int(r.feature[1])] + r.z - means[r.subject, r.feature]) * scale[int(r.feature[1]), 1] + scale[int(r.feature[1]), 0]) for r in once.itertuples())
    got = sorted((r.subject, r.feature, r.y) for r in harmonize.covbat(df).collect())
    assert len(got) == len(rows) and [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[2] for g in got], [e[2] for e in expected])


def test_permutations_deal_every_label_once(spark):
    people = spark.createDataFrame([(s, "a" if s % 3 else "b") for s in range(500)], "subject long, group string")
    dealt = st.deal_labels(people, 20, 16).toPandas()
    assert len(dealt) == 500 * 20 and len(set(zip(dealt.subject, dealt.perm, strict=True))) == len(dealt)
    assert (dealt.groupby("perm").new.apply(lambda x: (x == "a").sum()) == sum(1 for s in range(500) if s % 3)).all()
    assert len({tuple(g.sort_values("subject").new) for _, g in dealt.groupby("perm")}) == 20


def test_max_t_takes_a_hundred_permutations(spark):
    rng = np.random.default_rng(10)
    rows = [(s, f"f{f}", "ab"[s % 2], float(rng.uniform(1, 2))) for s in range(40) for f in range(3)]
    edges = spark.createDataFrame(rows, "subject long, feature string, group string, y double")
    got = {r.feature: r for r in st.max_t_permutation(edges, "a", "b").collect()}
    assert got == {r.feature: r for r in st.max_t_permutation(edges, "a", "b", permutations=100).collect()}
    assert got["f0"].critical != st.max_t_permutation(edges, "a", "b", permutations=20).first().critical


def test_distributions_keep_their_tails(spark):
    from voxara.functions import distributions as d

    # Reference values to many digits.
    cases = [(12.0, 60, 1.5148e-17), (2.0, 10, 0.07338803), (0.0, 5, 1.0), (40.0, 5, 1.8426e-7), (1.96, 1_000_000, 0.04999579)]
    rows = spark.createDataFrame(cases, "t double, df long, p double").select("t", "df", "p", d.t_two_sided(F.col("t"), F.col("df")).alias("got")).collect()
    # Symmetry and closed forms: two degrees, and one.
    for t in (0.3, 1.0, 5.0, 1e3, 1e6):
        two, one = (spark.range(1).select(d.t_two_sided(F.lit(t), F.lit(k))).first()[0] for k in (2, 1))
        x = t / math.sqrt(2 + t * t)
        assert two == pytest.approx(1 / ((1 + x) * (2 + t * t)) * 2, rel=1e-9)  # 1 - x without cancelling
        assert one == pytest.approx(2 / math.pi * math.atan(1 / t), rel=1e-9)
    assert all(r.got == pytest.approx(r.p, rel=1e-2) for r in rows)
    # F with two degrees above has a closed form, down to 1e-30.
    for f in (0.5, 3.0, 40.0, 150.0):
        got = spark.range(1).select(d.f_upper(F.lit(f), F.lit(2), F.lit(60))).first()[0]
        assert got == pytest.approx((60 / (60 + 2 * f)) ** 30, rel=1e-9)
    q = spark.createDataFrame([(k,) for k in (1, 2, 30, 5000)], "df long").select(d.t_quantile(F.col("df"))).collect()
    assert [x[0] for x in q] == pytest.approx([12.7062047, 4.30265273, 2.04227246, 1.96043858], rel=1e-7)
    g = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 30.0, 1e5)], "z double").select("z", d.log_gamma(F.col("z")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.z), rel=1e-11, abs=1e-11) for r in g)


def test_cohort_filters(spark):
    people = spark.createDataFrame([(1, 4.0, "a"), (2, 5.0, "b"), (3, 6.0, "c"), (4, None, None)], "id int, age double, g string")
    kept = lambda e: [r.id for r in people.where(filters.cohort_filter(people, e)).orderBy("id").collect()]
    assert kept("age>=5") == [2, 3] and kept("age<=5") == [1, 2] and kept("age>5") == [3] and kept("age<5") == [1]
    assert kept("g!=a") == kept("g!a") == [2, 3] and kept("g=a,b") == kept("g==a,b") == [1, 2] and kept("g!=a,b") == [3]
    assert kept("4<age<=6") == [2, 3] and kept("6>age>=4") == [1, 2] and kept("4 <= age < 6") == [1, 2]
    for wrong in ("nothing", "height>3", "age"):
        with pytest.raises(ValueError):
            filters.cohort_filter(people, wrong)


def test_free_water_moves_the_fraction(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    b = np.full(30, 1000.0)
    x = kernels.design_matrix(b, v)[:, :6]
    truth = np.array([1.2e-3, 0.0, 0.4e-3, 0.0, 0.0, 0.4e-3])
    signal = 0.7 * np.exp(x @ truth) + 0.3 * np.exp(-b * 3e-3)
    start = spark.createDataFrame([(1, 1, signal.tolist(), 0.5, truth.tolist())], "subject long, voxel long, signal array<double>, fraction double, tensor array<double>")
    assert kernels.free_water(start, b.tolist(), v.tolist()).first().free_water < 0.45
    nan = spark.createDataFrame([(1, 1, [float("nan")] * 30, 0.5, truth.tolist())], start.schema)
    assert not math.isnan(kernels.free_water(nan, b.tolist(), v.tolist()).first().xx)


def test_harmonised_model_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows, table = [], {}
    for f in range(4):
        for s in range(60):
            batch, x, z = s % 3, float(rng.normal(50, 10)), float(s % 2)
            y = 10 * f + 0.3 * x - 2 * z + (0, 4, -3)[batch] + float(rng.normal()) * (1, 2, 0.5)[batch]
            table[f, s] = (batch, x, z, y)
            rows.append((s, str(f), batch, y if s else None, x, z))
        rows.append((99, str(f), 0, 1.0, None, 0.0))
    data = spark.createDataFrame(rows, "subject int, feature string, batch int, y double, x double, z double")
    got = {(r.feature, r.subject): r.y for r in harmonize.combat_with_model(data, ["x", "z"], eb=False).collect()}
    assert len(got) == len(rows) and got["0", 0] is None and got["0", 99] is None
    for f in range(4):
        held = [table[f, s] for s in range(1, 60)]
        batch, cov, y = np.array([h[0] for h in held]), np.array([h[1:3] for h in held]), np.array([h[3] for h in held])
        d = np.column_stack([np.eye(3)[batch], cov])
        beta = np.linalg.lstsq(d, y, rcond=None)[0]
        grand = np.bincount(batch) @ beta[:3] / len(y)
        sd = np.sqrt(((y - d @ beta) ** 2).mean())
        s = (y - grand - cov @ beta[3:]) / sd
        out = np.empty(len(y))
        for k in range(3):
            out[batch == k] = (s[batch == k] - s[batch == k].mean()) / s[batch == k].std(ddof=1)
        assert [got[str(f), n] for n in range(1, 60)] == pytest.approx(out * sd + grand + cov @ beta[3:], rel=1e-6)
    with pytest.raises(ValueError):
        harmonize.combat_with_model(data.where("batch = 0 or subject = 1"), ["x"])
    # New rows under stored estimates come out as they did.
    found = harmonize.estimates(data, ["x", "z"])
    again = {(r.feature, r.subject): r.y for r in harmonize.apply_model(data.where("subject < 5"), ["x", "z"], found).collect()}
    first = {(r.feature, r.subject): r.y for r in harmonize.combat_with_model(data, ["x", "z"]).collect()}
    assert all(first[k] == (pytest.approx(v) if v is not None else None) for k, v in again.items())


def test_gamma_of_edges(spark):
    rng = np.random.default_rng(6)
    w = rng.gamma(3.0, 2.0, 4000)
    r = regression.edge_distribution(spark.createDataFrame([(k, 0, 1, float(x)) for k, x in enumerate(w)], "subject int, i int, j int, w double")).first()
    h = 1e-5
    digamma = (math.lgamma(r.shape + h) - math.lgamma(r.shape - h)) / (2 * h)
    assert math.log(r.shape) - digamma == pytest.approx(math.log(w.mean()) - np.log(w).mean(), abs=1e-7)
    assert r.shape * r.scale == pytest.approx(w.mean()) and abs(r.shape - 3) < 0.3


def test_parts_are_of_each_subject(spark):
    voxels = [(s, i + 20 * p, j, 0, 1.0) for s in (1, 2) for p in range(3) for i in range(3) for j in range(3)]
    got = images.parts_of(spark.createDataFrame(voxels, "subject long, i int, j int, k int, value double"), 3).collect()
    for s in (1, 2):
        parts = {(r.i // 20): set() for r in got}
        for r in got:
            if r.subject == s:
                parts[r.i // 20].add(r.part)
        assert all(len(p) == 1 for p in parts.values()) and len(set.union(*parts.values())) == 3


def test_valid_dwi_deals_subjects_over_all_tasks(spark):
    rows = [(1, 0), (1, 1), (2, 0), (3, 0), (4, None), (None, 0), (5, 0), (5, 1)]
    found = [(1, 0, 0.0, 1.0), (1, 1, 5.0, 1.0), (2, 0, 0.0, None), (4, None, None, None), (None, 0, 1.0, 1.0), (5, 0, 1.0, 1.0), (5, 0, 1.0, 1.0), (6, 0, 1.0, 1.0)]
    out = volumes.is_valid_dwi(spark.createDataFrame(rows, "subject long, t int"), spark.createDataFrame(found, "subject long, t int, b double, bx double"))
    assert {r.subject: r.valid for r in out.collect()} == {1: True, 2: False, 3: False, 4: True, None: False, 5: False}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("REPARTITION_BY_NUM") >= 2


def test_erosion_after_threshold_is_one_shuffle(spark):
    brain = spark.createDataFrame([(s, i, j, k, 1) for s in range(2) for i in range(4) for j in range(4) for k in range(3)], "subject long, i int, j int, k int, value int")
    fa = brain.where("i > 1").select("subject", "i", "j", "k", (F.col("j") / 2.0).alias("value"))
    out = images.threshold_fa(fa.union(fa.where("j = 1 and k = 1")), brain, 0.5)
    # The core is i and j from 1 to 2, k 1; only i 2 has a value there, only j 2 one above the threshold.
    assert sorted(tuple(r) for r in out.collect()) == [(0, 2, 2, 1, 1), (1, 2, 2, 1, 1)]
    twice = images.threshold_fa(fa.union(fa), brain, 0.5)
    assert twice.count() == 4
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_subject_of_many_points_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    from voxara.sources import tracks as track_files

    monkeypatch.setattr(track_files, "_POINTS", 7)
    monkeypatch.setattr(track_files, "_BYTES", 64)
    rows = [(s, line, seq, float(line), float(seq), 0.5) for s in range(2) for line in range(9) for seq in range(1 + line * 3)]
    points = spark.createDataFrame(rows, "subject long, streamline long, seq long, x double, y double, z double").repartition(3)
    for kind in ("trk", "tck"):
        folder = f"file://{tmp_path}/{kind}"
        assert sorted(r.streamlines for r in track_files.write_tracks(points, folder, kind).collect()) == [9, 9]
        got = track_files.read_points(spark, folder).select(F.regexp_extract("path", r"([^/]*)[.]...$", 1).cast("long"), "streamline", "seq", "x", "y", "z")
        assert sorted(map(tuple, got.collect())) == rows
        raw = (tmp_path / kind / f"1.{kind}").read_bytes()
        assert raw == (track_files.encode_trk if kind == "trk" else track_files.encode_tck)([np.array([r[3:] for r in rows if r[0] == 1 and r[1] == line]) for line in range(9)])
