import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tabulon.errors import EngineError
from tabulon.operators.forest import fit_forest, grid, tune_bandwidth, tune_parameters
from tabulon.operators.rows import number_rows
from tabulon.operators.trees import Forest
from tabulon.runtime import cut


def sample(n=60, p=4):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, p))
    x[:, 3] = rng.integers(0, 3, n)
    return x, x[:, 0] * 2 + np.sin(x[:, 1]) * 3 + x[:, 2] * x[:, 0] + rng.normal(0, 0.1, n), rng.random(n) + 0.1


def test_one_split_is_the_best_one():
    x, y, w = sample(25)
    f = Forest(x, y, w, 1, 1, 2, 5)
    # The tree's rows and weights are those of its bootstrap.
    draws = np.bincount(np.random.default_rng(5).integers(0, 25, (1, 25))[0], minlength=25)
    ww = draws * w
    best = math.inf
    for j in range(4):
        for t in np.unique(x[ww > 0, j])[:-1]:
            left = x[:, j] <= t
            loss = sum((ww[s] * (y[s] - np.average(y[s], weights=ww[s])) ** 2).sum() for s in (left & (ww > 0), ~left & (ww > 0)))
            best = min(best, loss)
    assert (ww * (y - f.predict(x)) ** 2).sum() == pytest.approx(best)


def test_limits_of_growth():
    x, y, w = sample()
    assert Forest(x, y, w, 5, 3, 2, 1).depth <= 3
    assert len(Forest(x, y, w, 5, None, 1000, 1).feature) == 5
    assert (Forest(x, np.ones(60), w, 5, None, 2, 1).feature == -1).all()
    deep = Forest(x, y, np.ones(60), 200, None, 2, 1)
    assert 1 - ((y - deep.predict(x)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    zero = Forest(x[:3], y[:3], np.array([1.0, 0.0, 0.0]), 20, None, 2, 1)
    assert np.isfinite(zero.predict(x[:3])).all()


def test_shapley_values_match_their_definition():
    x, y, w = sample()
    f, p, target = Forest(x, y, w, 20, 5, 4, 1), 4, x[3]

    def value(known):
        def at(n):
            if f.feature[n] < 0:
                return f.value[n]
            lo = f.left[n]
            if f.feature[n] in known:
                return at(lo + (target[f.feature[n]] > f.threshold[n]))
            return (f.cover[lo] * at(lo) + f.cover[lo + 1] * at(lo + 1)) / f.cover[n]

        return sum(at(t) for t in range(f.trees)) / f.trees

    v = {s: value(set(s)) for r in range(p + 1) for s in itertools.combinations(range(p), r)}
    fact = math.factorial
    phi = [
        sum(fact(len(s)) * fact(p - len(s) - 1) / fact(p) * (v[tuple(sorted((*s, i)))] - v[s]) for r in range(p) for s in itertools.combinations([k for k in range(p) if k != i], r))
        for i in range(p)
    ]
    got, inter, base = f.shap(target, [(0, 2)])
    assert got.tolist() == pytest.approx(phi)
    assert base + got.sum() == pytest.approx(f.predict(target[None])[0])
    both = sum(
        fact(len(s)) * fact(p - len(s) - 2) / fact(p - 1) * (v[tuple(sorted((*s, 0, 2)))] - v[tuple(sorted((*s, 0)))] - v[tuple(sorted((*s, 2)))] + v[s])
        for r in range(p - 1)
        for s in itertools.combinations([1, 3], r)
    )
    assert inter[0] == pytest.approx(both / 2)


@pytest.fixture(scope="module")
def table(spark):
    # Two rows of stations with a step between them; no draw, so that the figures are the same everywhere.
    k = np.arange(14)
    side, along = k % 2, k // 2
    x1, x2 = along * 1.5 + 0.3 * side, np.cos(k * 2.1) + along / 5
    p = {"k": k, "lon": -3.0 + 0.05 * along, "lat": 51.0 + 0.2 * side + 0.003 * along, "x1": x1, "x2": x2, "t": 4.0 * side + x1 * x2 - 0.1 * (k % 3)}
    return cut(number_rows(spark.createDataFrame(pd.DataFrame(p)), "k"))


PLACE = ("lon", "lat", "t", ["x1", "x2"])


@pytest.mark.parametrize("fit_method", ["in_sample", "loocv"])
def test_local_forests(table, fit_method):
    r = fit_forest(table, *PLACE, 8, fit_method=fit_method, trees=10, depth=5, split=2, shap=True, interactions=True, interaction_columns=["x1", "x2"], permutations=19)
    local = r["local"].toPandas()
    assert len(local) == 14 and {"importance_x1", "shap_x2", "shap_interaction_x1__x2"} <= set(local)
    assert sum(v["relative_importance"] for v in r["importance_summary"]) == pytest.approx(100)
    assert r["metrics"]["rmse"] == pytest.approx(math.sqrt((local.residual**2).mean()))
    assert local.source_row.min() == 2


def test_one_forest_serves_all_limits():
    x, y, w = sample()
    deep = Forest(x, y, w, 15, None, 2, 9)
    limits = [(None, 2), (3, 2), (None, 9), (2, 30)]
    got = deep.pruned_sums(x, limits, step=7)
    assert got[0] / 15 == pytest.approx(deep.predict(x))
    for k, (depth, split) in enumerate(limits):
        # The draws of a forest come before its lots, so that the bootstrap is the same; ties of the features are rare.
        assert got[k] / 15 == pytest.approx(Forest(x, y, w, 15, depth, split, 9).predict(x), abs=0.5)
    assert got[1] / 15 == pytest.approx(Forest(x, y, w, 15, 3, 2, 9).predict(x))


def test_searches(table):
    g = tune_parameters(table, "t", ["x1", "x2"], trees=20, depth=5, split=5)
    assert len(g["search_results"]) == len(grid(20, 5, 5)) == 12
    assert g["search_results"][0]["rank"] == 1 and g["best_parameters"].items() <= g["search_results"][0].items()
    b = tune_bandwidth(table, *PLACE, [5, 8, 5], trees=10, depth=5, split=2)
    assert [x["bandwidth"] for x in b["search_results"]] == [5, 8]
    assert b["best_bandwidth"] == min(b["search_results"], key=lambda x: x["loocv_rmse"])["bandwidth"]


@pytest.mark.parametrize(
    "bandwidth,options",
    [(14, {"fit_method": "loocv"}), (2, {}), (99, {}), (8, {"trees": 5}), (8, {"depth": 0}), (8, {"split": 1}), (8, {"split": 9}), (8, {"interactions": True}),
     (8, {"shap": True, "interactions": True, "interaction_columns": ["x1"]}), (8, {"shap": True, "interactions": True, "interaction_columns": ["x1", "t"]}), (None, {"optimize_bandwidth": True})],
)
def test_guards(table, bandwidth, options):
    with pytest.raises(EngineError):
        fit_forest(table, *PLACE, bandwidth, **{"trees": 10, "split": 2} | options)
