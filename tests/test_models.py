import math

import numpy as np
import pandas as pd
import pytest

from tabulon.errors import EngineError
from tabulon.functions import special as S
from tabulon.operators.regression import analyze


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_special_functions():
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert S.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert S.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and S.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert S.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert S.trigamma(np.array([1.0, 0.5])).tolist() == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], abs=1e-10)


def test_correlation_of_proportional_columns(spark):
    t = frame(spark, x=[1, 2, 3, 4, 5], y=[2, 4, 6, 8, 10])
    for method in ("pearson", "spearman"):
        c = analyze(t, method, "y", ["x"])["correlation"]
        assert c["coefficient"] == pytest.approx(1.0) and c["p_value"] < 1e-6


def test_spearman_with_ties(spark):
    x, y = [1, 1, 2, 3, 3, 3, 7], [5, 4, 4, 4, 2, 1, 1]
    c = analyze(frame(spark, x=x, y=y), "spearman", "y", ["x"])["correlation"]["coefficient"]
    assert c == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()), abs=1e-12)


def test_least_squares(spark):
    x = np.arange(20.0)
    y = 2 * x + 1 + np.where(np.arange(20) % 2, 0.2, -0.2)
    r = analyze(frame(spark, x=x, y=y), "ols", "y", ["x"])
    c = {k["term"]: k for k in r["regression"]["coefficients"]}
    X = np.c_[np.ones(20), x]
    b, ssr, *_ = np.linalg.lstsq(X, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * ssr[0] / 18)
    assert [c["const"]["estimate"], c["x"]["estimate"]] == pytest.approx(b.tolist())
    assert [c["const"]["standard_error"], c["x"]["standard_error"]] == pytest.approx(se.tolist())
    assert r["regression"]["metrics"]["r_squared"] > 0.99 and r["diagnostics"]["valid_inference"]


def test_collinear_columns_are_flagged(spark):
    x = np.arange(12.0)
    y = x + np.cos(x)
    r = analyze(frame(spark, x1=x, x2=2 * x, y=y), "ols", "y", ["x1", "x2"])
    X = np.c_[np.ones(12), x, 2 * x]
    assert [c["estimate"] for c in r["regression"]["coefficients"]] == pytest.approx((np.linalg.pinv(X) @ y).tolist(), abs=1e-6)
    d = r["diagnostics"]
    assert not d["valid_inference"] and d["rank"] == 2 < d["parameter_count"] and d["warnings"]


def test_logistic(spark):
    x = list(range(20))
    y = [0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1, 1, 1, 1, 1]
    r = analyze(frame(spark, x=x, y=y), "logistic", "y", ["x"])
    assert r["regression"]["binary_mapping"] == {"0": 0, "1": 1}
    slope = r["regression"]["coefficients"][1]
    assert slope["effect_ratio"] == pytest.approx(math.exp(slope["estimate"]))
    # Score equations hold at the estimate.
    b = [c["estimate"] for c in r["regression"]["coefficients"]]
    mu = 1 / (1 + np.exp(-(b[0] + b[1] * np.array(x))))
    assert abs((np.array(y) - mu).sum()) < 1e-5 and abs(((np.array(y) - mu) * x).sum()) < 1e-4
    with pytest.raises(EngineError, match="exactly two"):
        analyze(frame(spark, x=list(range(8)), y=list(range(8))), "logistic", "y", ["x"])


def test_negative_binomial(spark):
    rng = np.random.default_rng(42)
    x = np.linspace(0, 2, 40)
    mu = np.exp(0.5 + 0.7 * x)
    y = rng.negative_binomial(2, 2 / (2 + mu))
    r = analyze(frame(spark, x=x, count=y), "negative_binomial", "count", ["x"])["regression"]
    assert [c["term"] for c in r["coefficients"]] == ["const", "x", "alpha"]

    def ll(b0, b1, alpha):
        m, a = np.exp(b0 + b1 * x), 1 / alpha
        return sum(math.lgamma(v + a) - math.lgamma(a) - math.lgamma(v + 1) + v * math.log(alpha * u / (1 + alpha * u)) - a * math.log(1 + alpha * u) for v, u in zip(y, m))

    best = [c["estimate"] for c in r["coefficients"]]
    top = ll(*best)
    assert top == pytest.approx(r["metrics"]["log_likelihood"], abs=1e-6)
    for k in range(3):
        for step in (-1e-3, 1e-3):
            moved = list(best)
            moved[k] += step
            assert ll(*moved) < top
    with pytest.raises(EngineError, match="non-negative"):
        analyze(frame(spark, x=x, count=y + 0.5), "negative_binomial", "count", ["x"])


def test_argument_errors(spark):
    t = frame(spark, x=[1.0, 1.0, 1.0, 1.0], y=[1.0, 2.0, 3.0, 4.0])
    for args in (("ols", "y", []), ("ols", "y", ["y"]), ("ols", "y", ["x"]), ("pearson", "y", ["x", "y"]), ("pearson", "y", ["x"]), ("magic", "y", ["x"]), ("ols", "y", ["zz"])):
        with pytest.raises(EngineError):
            analyze(t, *args)
