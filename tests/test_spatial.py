import math

import numpy as np
import pandas as pd
import pytest

from tabulon.errors import EngineError
from tabulon.operators.moran import moran, weight_sums
from tabulon.operators.numeric import prepare
from tabulon.operators.rows import ROW, number_rows
from tabulon.operators.spatial import analyze_spatial
from tabulon.operators.graph import Graph
from tabulon.operators.spatial_models import LagFrame, LogDet, ml_error, ml_lag, model_selection, recommend
from tabulon.operators.weights import components, coordinates, knn_weights, nearest, row_standardised
from tabulon.runtime import cut

GRID = np.array([(i, j) for i in range(6) for j in range(6)], float)


def dense(k):
    d = np.sqrt(((GRID[:, None] - GRID[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    w = np.zeros((36, 36))
    for i in range(36):
        w[i, np.argsort(d[i], kind="stable")[:k]] = 1 / k
    return w


W4 = dense(4)


def data():
    rng = np.random.default_rng(12)
    x1, x2 = rng.normal(0, 1, 36) + GRID[:, 0] * 0.2, rng.normal(0, 1, 36)
    y = np.linalg.solve(np.eye(36) - 0.5 * W4, 2 + 1.5 * x1 - 0.8 * x2 + rng.normal(0, 0.3, 36))
    return pd.DataFrame({"k": range(36), "xc": GRID[:, 0], "yc": GRID[:, 1], "x1": x1, "x2": x2, "y": y})


@pytest.fixture(scope="module")
def table(spark):
    return cut(number_rows(spark.createDataFrame(data()), "k"))


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400), "c": 0.0})
    p.loc[:60, ["a", "b"]] = 0.5  # many at one place
    t = spark.createDataFrame(p)
    for options in ({}, {"per_cell": 40, "block": 25}):
        got = nearest(t, 5, **options).toPandas()
        xyz = p[["a", "b", "c"]].to_numpy()
        for i in range(0, 400, 7):
            d = np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            assert got[got.i == i].sort_values("rank").j.tolist() == np.argsort(d, kind="stable")[:5].tolist()
    own = nearest(t.limit(5), 2, self_too=True).where("rank = 1").toPandas()
    assert len(own) == 5
    with pytest.raises(EngineError):
        nearest(t.limit(3), 3)


def test_rows_of_weights_sum_to_one(rows, tuples):
    e = rows([(1, 2, 2.0), (1, 3, 6.0), (2, 1, 5.0)], "i long, j long, w double")
    assert tuples(row_standardised(e)) == [(1, 2, 0.25), (1, 3, 0.75), (2, 1, 1.0)]


def test_components_of_a_long_path(spark, tuples):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "i long, j long, w double")
    ids = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "id long")
    assert sorted({r["component"] for r in components(path, ids).collect()}) == [0, 100, 200]
    assert components(path.limit(0), ids).where("id <> component").count() == 0


def test_moran_of_a_checkerboard_is_negative(spark):
    pts = pd.DataFrame({"id": range(36), "a": GRID[:, 0], "b": GRID[:, 1], "c": 0.0})
    e = cut(knn_weights(spark.createDataFrame(pts), 4))
    v = spark.createDataFrame(pd.DataFrame({"id": range(36), "value": (GRID.sum(axis=1) % 2)}))
    r = moran(e, v, permutations=99)
    z = GRID.sum(axis=1) % 2 - 0.5
    assert r["i"] < 0 and r["i"] == pytest.approx(float(36 / W4.sum() * (z @ W4 @ z) / (z @ z)))
    assert r["expected_i"] == pytest.approx(-1 / 35) and r == moran(e, v, permutations=99)
    s = weight_sums(e)
    assert s["s1"] == pytest.approx(((W4 + W4.T) ** 2).sum() / 2) and s["s2"] == pytest.approx(((W4.sum(0) + W4.sum(1)) ** 2).sum())
    with pytest.raises(EngineError):
        moran(e, v.selectExpr("id", "1.0D AS value"))


def test_lag_model_impacts_and_selection(table):
    r = analyze_spatial(table, "sdm", "xc", "yc", "y", ["x1", "x2"], kind="projected", neighbors=4, permutations=49)
    est = {c["term"]: c["estimate"] for c in r["regression"]["coefficients"]}
    rho = r["regression"]["metrics"]["rho"]
    for i in r["regression"]["spatial_impacts"]:
        assert i["direct"] + i["indirect"] == pytest.approx(i["total"])
        assert i["total"] == pytest.approx((est[i["term"]] + est[f"W_{i['term']}"]) / (1 - rho))
    s = r["model_selection"]
    assert len(s["tests"]) == 5 and s["available"]
    p = data()
    X = np.c_[np.ones(36), p.x1, p.x2]
    y = p.y.to_numpy()
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e, M = y - X @ b, np.eye(36) - X @ inv @ X.T
    s2, T = e @ e / 36, np.trace(W4.T @ W4 + W4 @ W4)
    dE, dL = e @ W4 @ e / s2, e @ W4 @ y / s2
    J = (W4 @ X @ b) @ M @ (W4 @ X @ b) / s2 + T
    want = [dE**2 / T, dL**2 / J, (dE - T / J * dL) ** 2 / (T * (1 - T / J)), (dL - dE) ** 2 / (J - T)]
    assert [t["statistic"] for t in s["tests"][:4]] == pytest.approx(want)
    assert s["tests"][4]["statistic"] == pytest.approx(want[0] + want[3])


def test_estimated_log_determinant(table):
    p = prepare(table, ["xc", "yc", "y", "x1", "x2"])
    rows = cut(p.df.withColumn("id", p.df[ROW]))
    edges = cut(knn_weights(coordinates(rows, "id", "xc", "yc", "projected"), 4))
    frame = LagFrame(rows, edges, "y", ["x1", "x2"], p.stats, 36)
    exact, series = LogDet(Graph(edges, rows)), LogDet(Graph(edges, rows), dense=10)
    assert series(0.4) == pytest.approx(exact(0.4), abs=0.4)
    assert exact.document(0.4)["method"] == "eigenvalues" and series.document(0.4)["method"] == "power_series"
    assert series.document(0.4)["remainder_bound"] < 0.01 < series.remainder(0.99)
    for fit in (lambda d: ml_lag(frame, d, False), lambda d: ml_lag(frame, d, True), lambda d: ml_error(frame, d)):
        a, b = fit(exact)["coefficients"], fit(series)["coefficients"]
        assert [c["estimate"] for c in a] == pytest.approx([c["estimate"] for c in b], abs=0.1, rel=0.1)
        assert [c["standard_error"] for c in a] == pytest.approx([c["standard_error"] for c in b], rel=0.15)
    assert model_selection(frame, weight_sums(edges))["model"] == "slm"


def test_terms_are_added_until_the_rest_is_small(table):
    rows = cut(table.withColumn("id", table[ROW]))
    det = LogDet(Graph(cut(knn_weights(coordinates(rows, "id", "xc", "yc", "projected"), 4)), rows), dense=10)
    assert len(det.traces) == 32 and det.settled(0.3)
    while not det.settled(0.95):
        pass
    assert det.remainder(0.95) <= 0.01 and len(det.traces) > 32


def test_recommendations():
    assert [recommend(*p) for p in ((0.5, 0.01), (0.01, 0.5), (0.01, 0.01), (0.5, 0.5))] == ["slm", "sem", "sdm", "ols"]


def test_error_model_and_regression_by_place(table):
    r = analyze_spatial(table, "sem", "xc", "yc", "y", ["x1", "x2"], kind="projected", neighbors=4, permutations=19)
    assert r["regression"]["spatial_impacts"] == [] and r["regression"]["metrics"]["lambda"] is not None
    g = analyze_spatial(table, "gwr", "xc", "yc", "y", ["x1"], kind="projected", neighbors=4, permutations=19, bandwidth=36)
    local = g["gwr"]["local"].toPandas()
    assert len(local) == 36 and {"coefficient_x1", "t_value_CONSTANT", "p_value_unadjusted_x1", "local_r_squared"} <= set(local)
    # By hand for one focal point.
    p = data()
    d = np.sqrt(((GRID - GRID[7]) ** 2).sum(axis=1))
    w = (1 - (d / (d.max() * 1.0000001)) ** 2) ** 2
    X = np.c_[np.ones(36), p.x1]
    b = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * p.y))
    row = local[local.source_row == 9].iloc[0]
    assert [row.coefficient_CONSTANT, row.coefficient_x1] == pytest.approx(b.tolist())


def test_guards(table, spark):
    bad = table.withColumn("xc", table.xc + 200)
    for t, args, options in (
        (bad, ("moran", "xc", "yc", "y"), {}),
        (table, ("moran", "xc", "xc", "y"), {}),
        (table, ("slm", "xc", "yc", "y"), {}),
        (table, ("slm", "xc", "yc", "y", ["y"]), {}),
        (table, ("moran", "xc", "yc", "y"), {"neighbors": 36}),
        (table, ("odd", "xc", "yc", "y"), {}),
        (table, ("moran", "xc", "yc", "zz"), {}),
    ):
        with pytest.raises(EngineError):
            analyze_spatial(t, *args, **options)
