"""Reference batches and covariance harmonisation with missing values, constants and covariates."""

import numpy as np
import pytest

from voxara.operators import harmonize

ROWS = "subject long, feature string, batch int, y double, age double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    age = rng.uniform(20, 80, 90)
    out = [(s, f"f{f}", s % 3, float(0.1 * (f + 1) * age[s] + 2 * (s % 3) + rng.normal() * (1 + 0.5 * (s % 3)) + f), float(age[s])) for s in range(90) for f in range(6)]
    out += [(s, "same", s % 3, 5.0, float(age[s])) for s in range(90)]
    return [(s, f, b, None if (s, f) in {(4, "f1"), (0, "f2"), (7, "f0")} else y, None if s == 10 else a) for s, f, b, y, a in out]


def _expected(rows, reference, mean_only=False):
    """Batches and age fitted together, the reference's mean and residual deviation as the scale."""
    out = {}
    for f in {r[1] for r in rows}:
        held = [r for r in rows if r[1] == f and r[3] is not None and r[4] is not None]
        y, b, age = (np.array([r[n] for r in held], float) for n in (3, 2, 4))
        x = np.column_stack([b == k for k in range(3)] + [age]).astype(float)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        res, ref = y - x @ beta, b == reference
        sd = np.sqrt((res[ref] ** 2).mean())
        sd = sd if sd > 1e-9 else 1.0
        for r in rows:
            if r[1] != f:
                continue
            if r[2] == reference:
                out[r[0], f] = r[3]
            elif r[3] is None or r[4] is None:
                out[r[0], f] = None
            else:
                k = r[2]
                d = np.sqrt((res[b == k] ** 2).sum() / ((b == k).sum() - 1)) / sd
                d = 1.0 if mean_only or d < 1e-9 else d
                stand = beta[reference] + beta[3] * r[4]
                out[r[0], f] = ((r[3] - stand) / sd - (beta[k] - beta[reference]) / sd) / d * sd + stand
    return out


@pytest.mark.parametrize("mean_only", [False, True])
def test_reference_batch_with_covariates(spark, rows, mean_only):
    got = {(r.subject, r.feature): r.y for r in harmonize.combat_reference(spark.createDataFrame(rows, ROWS), 1, ["age"], mean_only=mean_only).collect()}
    want = _expected(rows, 1, mean_only)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-8)
    assert got[4, "f1"] is None and all(got[s, "same"] == pytest.approx(5.0) for s in range(90) if s != 10)


def test_reference_batch_shrinks_and_keeps_its_rows(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    for options in ({"eb": True}, {"eb": True, "mean_only": True}):
        got = {(r.subject, r.feature): r.y for r in harmonize.combat_reference(df, 0, ["age"], **options).collect()}
        raw = {(r[0], r[1]): r[3] for r in rows}
        assert set(got) == set(raw) and all(got[k] == raw[k] for k in raw if k[0] % 3 == 0)
        assert {k for k in got if got[k] is None} == {k for k in raw if raw[k] is None or (k[0] == 10)}
        age = {r[0]: r[4] for r in rows}

        def gap(y, f):
            left = {k: v - 0.1 * (f + 1) * age[k[0]] for k, v in y.items() if v is not None and k[1] == f"f{f}" and age[k[0]] is not None}
            return abs(np.mean([v for k, v in left.items() if k[0] % 3 == 2]) - np.mean([v for k, v in left.items() if k[0] % 3 == 0]))

        assert np.mean([gap(got, f) for f in range(6)]) < 0.3 * np.mean([gap(raw, f) for f in range(6)])


def test_features_that_the_reference_lacks(spark):
    rows = [(s, "a", s % 2, float(s), 1.0) for s in range(8)] + [(s, "b", 1, float(s), 1.0) for s in range(1, 8, 2)]
    got = {(r.subject, r.feature): r.y for r in harmonize.combat_reference(spark.createDataFrame(rows, ROWS), 0).collect()}
    assert len(got) == 12 and all(v is None for k, v in got.items() if k[1] == "b") and all(v is not None for k, v in got.items() if k[1] == "a")


def test_covariance_harmonisation_invents_nothing(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    for columns in (None, ["age"]):
        got = {(r.subject, r.feature): r.y for r in harmonize.covbat(df, columns=columns).collect()}
        assert len(got) == len(rows)
        assert {k for k, v in got.items() if v is None} == {(r[0], r[1]) for r in rows if r[3] is None or columns and r[4] is None}
    age = {r[0]: r[4] for r in rows if r[4] is not None}
    slope = np.polyfit([age[s] for s in range(90) if s in age], [got[s, "f5"] for s in range(90) if s in age], 1)[0]
    assert slope == pytest.approx(0.6, abs=0.1)  # the covariate's part is kept
