import numpy as np
import pandas as pd
import pytest

from tabulon.operators.gwr import LocalFits, fit_gwr


def by_hand(p, i, bandwidth):
    d = np.sqrt((p.px - p.px[i]) ** 2 + (p.py - p.py[i]) ** 2).to_numpy()
    z = d / (np.sort(d)[bandwidth - 1] * 1.0000001)
    w = np.where(z < 1, (1 - z * z) ** 2, 0.0)
    x = np.c_[np.ones(len(p)), p.a]
    c = np.linalg.solve(x.T @ (w[:, None] * x), x.T * w)
    return c @ p.v.to_numpy(), x[i] @ c[:, i], (c * c).sum(axis=1)


def sample(n):
    rng = np.random.default_rng(3)
    # Positions on a grid, so that many are equally far.
    p = pd.DataFrame({"px": rng.integers(0, 300, n) * 1.0, "py": rng.integers(0, 300, n) * 1.0, "a": rng.normal(size=n)})
    return p.assign(v=p.a * np.sin(p.px / 90) + p.py / 50 + rng.normal(0, 0.1, n))


def test_more_rows_than_the_former_bound(spark):
    n = 5_003
    p = sample(n)
    rows = p.assign(id=np.arange(n), source_row=np.arange(n) + 2)[["id", "source_row", "px", "py", "v", "a"]]
    r = fit_gwr(spark.createDataFrame(rows), "px", "py", "v", ["a"], False, bandwidth=40)
    got = r["local"].toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == n and got["id"].tolist() == list(range(n))
    for i in range(0, n, 700):
        beta, _, _ = by_hand(p, i, 40)
        assert [got.coefficient_CONSTANT[i], got.coefficient_a[i]] == pytest.approx(beta.tolist())


@pytest.mark.parametrize("bandwidth", [9, 40, 130, 300])
def test_moments_match_the_hat_matrix(bandwidth):
    p = sample(300)
    m = LocalFits(p[["px", "py"]].to_numpy(), p[["a"]].to_numpy(), p.v.to_numpy(), False)
    f = m.fit(np.arange(0, 300, 50), bandwidth)
    for k, i in enumerate(range(0, 300, 50)):
        beta, s, cct = by_hand(p, i, bandwidth)
        assert f["beta"][k] == pytest.approx(beta) and f["s"][k] == pytest.approx(s) and f["cct"][k] == pytest.approx(cct)


def test_search_passes_over_bandwidths_without_a_fit(spark):
    n = 400
    p = sample(n)
    # Runs of one value, so that small kernels hold a constant column: their local fits have no solution.
    p["a"] = (p.px // 60 + 5 * (p.py // 60)) % 4
    p["v"] = 2 * p.a + np.sin(p.px / 90) + p.py / 50
    rows = p.assign(id=np.arange(n), source_row=np.arange(n) + 2)[["id", "source_row", "px", "py", "v", "a"]]
    r = fit_gwr(spark.createDataFrame(rows), "px", "py", "v", ["a"], False)
    scores = dict(r["search"])
    assert np.isinf(list(scores.values())).any() and np.isfinite(scores[r["bandwidth"]])
    assert r["local"].count() == n
