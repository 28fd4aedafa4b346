"""Blocks with halos and denoising against plain loops over whole images."""

import itertools
import math

import numpy as np
import pytest

from voxara.operators import denoise, slabs

LONG = "subject string, i int, j int, k int, t int, value double"


def rows_of(a, subject="s"):
    a = a if a.ndim == 4 else a[..., None]
    return [(subject, *map(int, at), float(v)) for at, v in np.ndenumerate(a) for at in [at] if v != 0]


def frame(spark, a, subject="s"):
    df = spark.createDataFrame(rows_of(a, subject), LONG)
    return df if a.ndim == 4 else df.drop("t")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    names = ["i", "j", "k", "t"][: len(shape)]
    for r in df.toPandas().itertuples(index=False):
        at = tuple(getattr(r, n) for n in names)
        assert np.isnan(out[at])  # once
        out[at] = r.value
    return out


def named(shape):
    return dict(zip("ijkt", shape, strict=False))


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(0)
    shape = (9, 7, 6, 5)
    i, j, k = np.indices(shape[:3])
    base = 100 + 40 * (i > 4) + 20 * (j > 3) + 5 * k
    return np.abs(base[..., None] * np.exp(-0.2 * np.arange(5)) + rng.normal(0, 5, shape))


@pytest.mark.parametrize("block", [2, 4, 8, 64])
def test_blocks_equal_the_whole_image(spark, noisy, block):
    a = np.where(noisy > 60, noisy, 0)  # voxels without a row
    padded, known = np.pad(a, [(2, 2)] * 3 + [(0, 0)]), np.pad(np.ones(a.shape[:3]), 2)
    expected = np.zeros(a.shape)
    for at in np.ndindex(a.shape[:3]):
        here = tuple(slice(c, c + 5) for c in at)
        expected[at] = padded[here].sum((0, 1, 2)) / known[here].sum()
    got = array_of(slabs.box_mean(frame(spark, a), named(a.shape), 2, block), a.shape)
    np.testing.assert_allclose(got, expected, atol=1e-10)


def test_blocks_keep_subjects_apart_and_take_odd_rows(spark):
    rows = [("a", 0, 0, 0, 0, 27.0), ("b", 0, 0, 0, 0, 54.0), ("b", 1, 0, 0, 0, None), ("b", 9, 0, 0, 0, 5.0), ("c", 3, 3, 3, 0, 1.0)]
    df = spark.createDataFrame(rows, LONG).drop("t")
    got = {(r.subject, r.i, r.j, r.k): r.value for r in slabs.box_mean(df, {"i": 4, "j": 4, "k": 4}, 1, 2).collect() if r.value}
    assert got[("a", 0, 0, 0)] == 27 / 8 and got[("b", 1, 1, 1)] == 2.0 and got[("c", 3, 3, 3)] == 1 / 8
    assert slabs.box_mean(df.where("false"), {"i": 4, "j": 4, "k": 4}).count() == 0


def _means(a, sigma, patch, reach, rician):
    x = np.pad(a, reach, mode="reflect")
    out = np.zeros(a.shape)
    cut = lambda at: x[tuple(slice(c - patch, c + patch + 1) for c in at)]
    far = reach - patch
    for at in np.ndindex(a.shape):
        here = tuple(c + reach for c in at)
        total = squares = 0.0
        for d in itertools.product(range(-far, far + 1), repeat=3):
            there = tuple(c + e for c, e in zip(here, d, strict=True))
            w = math.exp(-((cut(here) - cut(there)) ** 2).mean() / (math.sqrt(2) * sigma**2))
            total, squares = total + w, squares + w * x[there] ** 2
        out[at] = math.sqrt(max(squares / total - (2 * sigma**2 if rician else 0), 0))
    return out


@pytest.mark.parametrize(("block", "rician"), [(3, True), (32, False)])
def test_non_local_means(spark, noisy, block, rician):
    a = noisy[:6, :5, :, :2]
    got = array_of(denoise.nlmeans(frame(spark, a), named(a.shape), [5.0, 7.0], 1, 3, rician, block=block), a.shape)
    for t, sigma in enumerate((5.0, 7.0)):
        np.testing.assert_allclose(got[..., t], _means(a[..., t], sigma, 1, 3, rician), atol=1e-9)
    kept = frame(spark, (np.indices(a.shape[:3])[0] > 2).astype(float))
    masked = array_of(denoise.nlmeans(frame(spark, a), named(a.shape), 5.0, 1, 2, rician, kept, block), a.shape)
    assert (masked[:3] == 0).all() and (masked[3:] > 0).all()


def _components(a, radius, tau, sigma):
    n, total, weight = (2 * radius + 1) ** 3, np.zeros(a.shape), np.zeros(a.shape[:3])
    for at in itertools.product(*[range(radius, s - radius) for s in a.shape[:3]]):
        here = tuple(slice(c - radius, c + radius + 1) for c in at)
        x = a[here].reshape(n, -1)
        mean = x.mean(0)
        d, w = np.linalg.eigh(np.cov(x.T, bias=True))
        if sigma is None:
            low = d[-(n - 1) :]
            c = len(low) - 1
            while c > 0 and low[c] - low[0] > 4 * math.sqrt((c + 1) / n) * low[: c + 1].mean():
                c -= 1
            noise = low[: c + 1].mean()
        else:
            noise = sigma[at] ** 2
        f = 1 + math.sqrt(a.shape[3] / n) if tau is None else tau
        kept = w[:, d >= f * f * noise]
        share = 1 / (1 + kept.shape[1])
        total[here] += share * ((x - mean) @ kept @ kept.T + mean).reshape(*[2 * radius + 1] * 3, -1)
        weight[here] += share
    return np.maximum(total / weight[..., None], 0)


@pytest.mark.parametrize("block", [3, 32])
def test_local_components(spark, noisy, block):
    got = array_of(denoise.mppca(frame(spark, noisy), named(noisy.shape), 1, block), noisy.shape)
    np.testing.assert_allclose(got, _components(noisy, 1, None, None), atol=1e-8)
    sigma = 3 + np.indices(noisy.shape[:3])[1] * 0.5
    got = array_of(denoise.lpca(frame(spark, noisy), frame(spark, sigma), named(noisy.shape), 1, 1.5, block), noisy.shape)
    np.testing.assert_allclose(got, _components(noisy, 1, 1.5, sigma), atol=1e-8)


def test_components_bring_back_the_signal(spark):
    rng = np.random.default_rng(3)
    i, j, k = np.indices((10, 10, 8))
    clean = (200 + 10 * i + 5 * j)[..., None] * np.exp(-0.1 * np.arange(20)) + 0 * k[..., None]
    a = clean + rng.normal(0, 8, clean.shape)
    out = array_of(denoise.mppca(frame(spark, a), named(a.shape), 2), a.shape)
    assert np.sqrt(((out - clean) ** 2).mean()) < 0.4 * np.sqrt(((a - clean) ** 2).mean())


def test_noise_levels(spark):
    rng = np.random.default_rng(5)
    a = 100 + rng.normal(0, 6, (12, 11, 10, 4))
    a[..., 3] = 0
    a[2, 3, 4, 0] = 0  # left out in every volume
    got = {r.t: r.sigma for r in denoise.noise_sigma(frame(spark, a), named(a.shape)).collect()}
    for t in range(3):
        x = np.pad(a[..., t], 1, mode="symmetric")
        near = sum(np.roll(x, d, axis)[1:-1, 1:-1, 1:-1] for axis in range(3) for d in (-1, 1))
        gap = math.sqrt(6 / 7) * (a[..., t] - near / 6)
        assert got[t] == pytest.approx(math.sqrt((gap[a[..., 0] != 0] ** 2).mean()), rel=1e-10)
    assert got[0] == pytest.approx(6, rel=0.15) and set(got) == {0, 1, 2}
    assert denoise.magnitude_variance(1) == pytest.approx(2 - math.pi / 2) and denoise.magnitude_variance(4) == pytest.approx(0.4834941393603609)


def test_local_noise_map(spark):
    rng = np.random.default_rng(6)
    a = 1000 + rng.normal(0, 10, (10, 9, 8, 6))
    x = a.reshape(-1, 6) - a.reshape(-1, 6).mean(0)
    w = np.linalg.eigh(x.T @ x)[1][:, 0]
    least = (x @ w).reshape(a.shape[:3])
    square, count = np.zeros(a.shape[:3]), np.zeros(a.shape[:3])
    for at in itertools.product(*[range(1, s - 1) for s in a.shape[:3]]):
        here = tuple(slice(c - 1, c + 2) for c in at)
        square[here] += (least[here] - least[here].mean()) ** 2
        count[here] += 1
    df = denoise.pca_noise_map(frame(spark, a), named(a.shape), correct_bias=False, smooth=None, block=4)
    np.testing.assert_allclose(array_of(df, a.shape[:3]), np.sqrt(square / count), rtol=1e-6)
    smooth = array_of(denoise.pca_noise_map(frame(spark, a), named(a.shape), [0, 2, 3, 5], smooth=1.0), a.shape[:3])
    assert smooth.mean() == pytest.approx(10, rel=0.15) and smooth.std() < 1.5


def test_rician_bias_at_both_ends():
    assert denoise.rician_bias(np.array([0.0]))[0] == pytest.approx(2 - math.pi / 2, abs=1e-9)
    assert denoise.rician_bias(np.array([30.0, 50.0])) == pytest.approx([1, 1], abs=2e-3)


def test_ringing_falls(spark):
    # An edge whose high frequencies are cut rings.
    fine = np.full((128, 128), 50.0)
    fine[35:93, 40:85] = 150
    spectrum = np.fft.fftshift(np.fft.fft2(fine))[48:80, 48:80]
    rung = np.abs(np.fft.ifft2(np.fft.ifftshift(spectrum))) / 16
    clean = np.full((32, 32), 50.0)
    clean[9:23, 10:21] = 150
    a = np.stack([rung, rung.T], -1)[..., None]
    got = array_of(denoise.unring(frame(spark, a), named(a.shape)), a.shape)
    flat = np.ones((32, 32), bool)  # away from the edge itself
    flat[7:11] = flat[21:26] = False
    flat[:, 8:12] = flat[:, 19:24] = False
    error = lambda x: np.abs(x - clean)[flat].mean()
    assert error(got[:, :, 0, 0]) < 0.2 * error(rung)
    np.testing.assert_allclose(got[:, :, 1, 0], got[:, :, 0, 0].T, atol=1e-6)
    with pytest.raises(ValueError):
        denoise.slice_axis("oblique")


def test_smooth_slices_stay(spark):
    x = 50 + 10 * np.sin(2 * np.pi * np.arange(16) / 16)[:, None] + np.zeros((16, 16))
    np.testing.assert_allclose(denoise.unring_slices(x), x, atol=0.7)


@pytest.mark.parametrize("coils", [1, 4])
def test_background_noise(spark, coils):
    rng = np.random.default_rng(8)
    x = np.sqrt((rng.normal(0, 12, (2 * coils, 20, 20, 2, 15)) ** 2).sum(0))
    x[5:15, 5:15] += 500  # tissue
    got = {r.k: r.sigma for r in denoise.piesno(frame(spark, x), named(x.shape), coils).collect()}
    assert got == {0: pytest.approx(12, rel=0.05), 1: pytest.approx(12, rel=0.05)}
    assert denoise.gamma_quantile(1, 0.5) == pytest.approx(math.log(2)) and denoise.gamma_quantile(30, 0.995) == pytest.approx(45.9759, abs=1e-3)


def test_what_denoising_took(spark, noisy):
    a = noisy[:3, :3, :3, :2]
    got = denoise.residual(frame(spark, a), frame(spark, a - 1).where("t = 0")).collect()
    assert {(r.t, round(r.value, 9)) for r in got if r.t == 0} == {(0, 1.0)} and sum(r.t for r in got) == 27
