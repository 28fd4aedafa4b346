import numpy as np
import pytest

from voxara.operators import harmonize, regression


@pytest.fixture(scope="module")
def rows():
    """Features of other sizes, one constant, one whose covariate repeats another there, one of two rows."""
    rng = np.random.default_rng(4)
    out = []
    for k in range(40):
        n = 2 if k == 7 else 20 + k
        a, b = rng.normal(50, 9, n), rng.normal(0, 1, n)
        if k == 3:
            b = (a - 50) / 9
        y = np.full(n, 6.5) if k == 5 else 3 + 0.2 * a - b + rng.normal(0, 1, n)
        out += [(f"s{s}", f"f{k}", int(s % 3), float(y[s]), float(a[s]), float(b[s])) for s in range(n)]
    return out


def test_all_features_of_a_batch_at_once(spark, rows):
    data = spark.createDataFrame([*rows, ("none", "f0", 0, None, 1.0, 1.0)], "subject string, feature string, batch int, y double, a double, b double")
    terms = {(r.feature, r.term): r for r in regression.ols_terms(data, ["a", "b"]).collect()}
    models = {r.feature: r for r in regression.ols_models(data, ["a", "b"], ["a"]).collect()}
    assert len(terms) == 120 and len(models) == 40
    for k in range(40):
        of = [r for r in rows if r[1] == f"f{k}"]
        x, y = np.array([(1.0, r[4], r[5]) for r in of]), np.array([r[3] for r in of])
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=1e-10)
        rss = float(((y - x @ beta) ** 2).sum())
        assert (models[f"f{k}"].n, models[f"f{k}"].df) == (len(of), len(of) - rank)
        if rank == 3:
            error = np.sqrt(rss / (len(of) - 3) * np.diag(np.linalg.inv(x.T @ x)))
            for t, c, e in zip(("Intercept", "a", "b"), beta, error, strict=True):
                got = terms[f"f{k}", t]
                assert got.coefficient == pytest.approx(c, abs=1e-7) and (k == 5 or got.half_width is not None)
                if k != 5:
                    assert got.t == pytest.approx(c / e, rel=1e-6)
        if k == 7:  # two rows leave nothing to estimate an error from
            assert all(terms["f7", t].t is None and terms["f7", t].p == 1 and terms["f7", t].error is None for t in ("Intercept", "a", "b")) and models["f7"].r2_adj is None
        if k not in (5, 7):
            assert models[f"f{k}"].r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), abs=1e-8)


def test_an_empty_table_has_no_terms(spark):
    data = spark.createDataFrame([], "feature string, y double, a double")
    assert regression.ols_terms(data, ["a"]).count() == 0 and regression.ols_models(data, []).count() == 0


@pytest.mark.parametrize("columns", [[], ["a"], ["a", "b"]])
@pytest.mark.parametrize("reference", [None, 1])
def test_batch_effects_of_all_features_at_once(spark, rows, columns, reference):
    data = spark.createDataFrame(rows, "subject string, feature string, batch int, y double, a double, b double")
    got = {(r.feature, r.batch): r for r in harmonize.model_effects(data, columns, reference).collect()}
    place = {"a": 4, "b": 5}
    for k in range(40):
        of = [r for r in rows if r[1] == f"f{k}" and k not in (3, 5, 7)]
        if not of:
            continue
        batch, y = np.array([r[2] for r in of]), np.array([r[3] for r in of])
        x = np.array([[r[place[c]] for c in columns] for r in of]).reshape(len(of), -1)
        beta = np.linalg.lstsq(np.hstack([np.eye(3)[batch], x]), y, rcond=None)[0]
        inside = np.ones(len(of), bool) if reference is None else batch == reference
        left = y - x @ beta[3:]
        grand = sum((batch[inside] == g).sum() * beta[g] for g in range(3)) / inside.sum()
        sd = np.sqrt(((left - beta[:3][batch])[inside] ** 2).mean())
        for g in range(3):
            r = got[f"f{k}", g]
            assert (r.gamma_hat, r.sd, r.grand, r.n) == (pytest.approx((beta[g] - grand) / sd, abs=1e-7), pytest.approx(sd), pytest.approx(grand, abs=1e-7), (batch == g).sum())
            assert r.delta_hat == pytest.approx(((left[batch == g] - beta[g]) ** 2).sum() / ((batch == g).sum() - 1) / sd**2, rel=1e-6)
            assert r.slopes == pytest.approx(list(beta[3:]), abs=1e-8)
    assert reference is None or {f for f, _ in got} == {f"f{k}" for k in range(40)}
