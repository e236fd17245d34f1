"""Spatial lag, error and Durbin models, diagnostics of their least-squares baseline, and impacts.

Rows are reduced to one matrix of cross-products of the columns and their spatial lags; every
likelihood, residual sum and test is a quadratic form in it. Only ln|I - rho W| and the traces of the
information matrix need the graph: exactly, by the eigenvalues and the inverse, up to ``DENSE_ROWS``
observations; beyond by the power series of W, whose traces are estimated with random signs and which is
carried on until what is left out is below ``TOLERANCE``. The result says which, with its error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.functions.special import chi2_sf, finite, normal_two_sided
from tabulon.operators.design import cross_products
from tabulon.operators.graph import Graph
from tabulon.operators.near import NearGraph
from tabulon.operators.weights import lag
from tabulon.runtime import cut, quoted

#: Most observations for which W is held as a matrix on the driver (8 bytes a pair).
DENSE_ROWS = 3_000
#: Most that the rest of the power series may add to the log-likelihood at the maximum, and the terms tried for it.
TOLERANCE = 0.01
TERMS = (32, 128, 512, 2048)
MODELS = ("slm", "sem", "sdm")


class LagFrame:
    """Standardised columns with their lags, cut from the lineage, and their cross-products."""

    def __init__(self, rows: DataFrame, edges: DataFrame | NearGraph, y: str, xs: Sequence[str], stats: dict[str, dict[str, float]], n: int):
        self.n, self.xs, self.y, self.edges = n, list(xs), y, edges
        self.mean = np.array([stats[c]["avg"] for c in xs])
        self.scale = np.array([stats[c]["std"] or 1.0 for c in xs])
        self.y_mean, self.y_scale = stats[y]["avg"], stats[y]["std"] or 1.0
        self.x = ["one", *(f"x{i}" for i in range(len(xs)))]
        if isinstance(edges, NearGraph):  # of the columns xs, y
            edges.standardise(np.append(self.mean, self.y_mean), np.append(self.scale, self.y_scale))
            own = [*self.x, "y"]
            self.df, self.columns, self.gram = edges, [*own, *self.w(own), *(f"t_{c}" for c in self.x)], edges.gram()
            return
        z = rows.select(
            "id",
            F.lit(1.0).alias("one"),
            *[((quoted(c) - F.lit(float(m))) / F.lit(float(s))).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(xs, self.mean, self.scale))],
            ((quoted(y) - F.lit(float(self.y_mean))) / F.lit(float(self.y_scale))).alias("y"),
        )
        z = cut(z)
        out = z.join(lag(edges, z, [*self.x, "y"], "w_"), "id", "left")
        back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
        out = out.join(lag(back, z, self.x, "t_"), "id", "left")
        self.df = cut(out.na.fill(0.0))
        self.columns = [c for c in self.df.columns if c != "id"]
        self.gram = cross_products(self.df, [F.col(c) for c in self.columns])

    def g(self, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        at = self.columns.index
        return self.gram[np.ix_([at(c) for c in a], [at(c) for c in b])]

    def w(self, names: Sequence[str]) -> list[str]:
        return [f"w_{c}" for c in names]

    def vector(self, of: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of a vector of a ``NearGraph``: of 1, the xs and y, and of their lags."""
        own = [*self.x, "y"]
        return np.array([of.get(c, 0.0) for c in own]), np.array([of.get(c, 0.0) for c in self.w(own)])

    def inner(self, graph: Graph | NearGraph, rho: float, terms: int, names: Sequence[str], beta: np.ndarray) -> tuple[float, np.ndarray, float]:
        """(|G|^2, Z'p, p'p) for G = W (I - rho W)^-1 and p = G Z beta, Z of the columns ``names``."""
        if not isinstance(graph, NearGraph):
            return graph.inner(rho, terms, self.df, names, beta)
        norm, products, square = graph.inner(rho, terms, *self.vector(dict(zip(names, beta))))
        return norm, products[[self.columns.index(c) for c in names]], square

    def residuals(self, of: dict[str, float]) -> DataFrame | tuple[np.ndarray, np.ndarray]:
        """(id, value): the sum of the columns by their coefficients, in the scale of y; or the vector of a ``NearGraph``."""
        if isinstance(self.edges, NearGraph):
            return tuple(v * self.y_scale for v in self.vector(of))
        return self.df.select("id", (sum(F.col(c) * F.lit(v) for c, v in of.items()) * F.lit(self.y_scale)).alias("value"))

    def raw(self, beta: np.ndarray, lagged: bool) -> np.ndarray:
        """Coefficients of the original columns from those of the standardised ones.

        The standardised model is y~ = r Wy~ + b0 + ..; with rows of W summing to 1, Wy~ is the
        standardised Wy, so that slopes only change scale; the constant is set by the caller.
        """
        k = len(self.xs)
        out = beta.copy()
        out[1 : k + 1] = beta[1 : k + 1] * self.y_scale / self.scale
        if lagged:
            out[k + 1 :] = beta[k + 1 :] * self.y_scale / self.scale
        return out

    def transform(self, k: int, lagged: bool, own: float) -> np.ndarray:
        """Linear map from standardised coefficients to raw ones; ``own`` is 1 - rho, or 1 without a lag of y.

        The constant takes up the means: b0 = own * mean(y) + s_y a0 - sum(b_j mean_j).
        """
        m = len(self.xs)
        t = np.zeros((k, k))
        t[0, 0] = self.y_scale
        for j in range(m):
            t[1 + j, 1 + j] = self.y_scale / self.scale[j]
            t[0, 1 + j] = -self.mean[j] * self.y_scale / self.scale[j]
            if lagged:
                t[1 + m + j, 1 + m + j] = self.y_scale / self.scale[j]
                t[0, 1 + m + j] = -self.mean[j] * self.y_scale / self.scale[j]
        return t


class LogDet:
    """ln|I - rho W| as a function of rho, its error, and the traces that the information matrix needs."""

    def __init__(self, graph: Graph | NearGraph, *, dense: int = DENSE_ROWS):
        self.graph, self.n = graph, graph.n
        self.w = self.omega = self.traces = None
        if self.n <= dense and graph.held is not None:
            g = graph.held
            self.w = np.zeros((self.n, self.n))
            rows = np.repeat(np.arange(self.n), g.degree) if g.degree is not None else g.i
            self.w[rows, g.j] = g.w
            self.omega = np.linalg.eigvals(self.w)
        else:
            self.tr_ww = graph.sums()["tr_ww"]
            self._carry_on(TERMS[0])

    def _carry_on(self, terms: int) -> None:
        each, self.norm = self.graph.traces(terms)
        each[:, 0], each[:, 1] = 0.0, self.tr_ww  # both are known
        self.each, self.traces = each, each.mean(axis=0)
        self.rest = max(0.0, float(self.traces[-2:].mean()))

    def __call__(self, rho: float) -> float:
        if self.omega is not None:
            return float(np.log(np.abs(1.0 - rho * self.omega)).sum())
        return self._series(rho, self.traces) - self.rest * self._left(rho)

    def _series(self, rho: float, traces: np.ndarray) -> float:
        k = np.arange(1, len(traces) + 1)
        return float(-(rho**k * traces / k).sum())

    def _left(self, rho: float) -> float:
        """The sum of rho^k / k after the terms."""
        k = np.arange(1, len(self.traces) + 1)
        return -math.log1p(-rho) - float((rho**k / k).sum())

    def remainder(self, rho: float) -> float:
        """Bound on what the terms leave out: for k >= 2p, |tr(W^k)| <= |W^p|^2 by Weyl's inequality, as no eigenvalue exceeds 1."""
        m, r = len(self.traces), abs(rho)
        return self.norm * r ** (m + 1) / ((m + 1) * (1.0 - r))

    def settled(self, rho: float) -> bool:
        """Is the remainder at ``rho`` small enough? If not, and if there are more terms to try, they are computed."""
        if self.omega is not None or self.remainder(rho) <= TOLERANCE or len(self.traces) >= TERMS[-1]:
            return True
        self._carry_on(next(t for t in TERMS if t > len(self.traces)))
        return False

    def spread(self, rho: float, frame: LagFrame | None = None, names: Sequence[str] = (), beta: np.ndarray | None = None) -> tuple:
        """(tr G, tr GG, |G|^2, Z'p, p'p) for G = W (I - rho W)^-1 and p = G Z beta."""
        if self.w is not None:
            g = self.w @ np.linalg.inv(np.eye(self.n) - rho * self.w)
            zp, pp = np.empty(0), 0.0
            if frame is not None:
                z = frame.df.select("id", *names).orderBy("id").toPandas()[list(names)].to_numpy()
                p = g @ (z @ beta)
                zp, pp = z.T @ p, float(p @ p)
            return float(np.trace(g)), float(np.sum(g * g.T)), float(np.sum(g * g)), zp, pp
        t, m = self.traces, len(self.traces)
        k = np.arange(m)
        once = float((rho**k * t).sum())
        twice = float(((k[:-1] + 1) * rho ** k[:-1] * t[1:]).sum())
        return (once, twice, *(self.graph.inner(rho, m) if frame is None else frame.inner(self.graph, rho, m, names, beta)))

    def document(self, rho: float) -> dict:
        """How the log-determinant at ``rho`` was found, and how far off it can be."""
        if self.omega is not None:
            return {"method": "eigenvalues", "terms": None, "probes": None, "standard_error": 0.0, "remainder_bound": 0.0}
        found = [self._series(rho, t) for t in self.each]
        return {
            "method": "power_series",
            "terms": len(self.traces),
            "probes": len(found),
            "standard_error": float(np.std(found, ddof=1) / math.sqrt(len(found))),
            "remainder_bound": self.remainder(rho),
        }


def _settle(det: LogDet, ll: Callable[[float], float]) -> tuple[float, bool]:
    """The maximum of a likelihood with enough terms of its log-determinant there."""
    while True:
        at, inside = maximise(ll)
        if det.settled(at):
            return at, inside


def maximise(f: Callable[[float], float], low: float = -0.999, high: float = 0.999, tol: float = 1e-10) -> tuple[float, bool]:
    """The maximum of a unimodal function on an interval by golden section after a coarse scan; inside it or not."""
    grid = np.linspace(low, high, 81)
    best = int(np.argmax([f(float(x)) for x in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 80)]
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return float(x), low + 1e-6 < x < high - 1e-6


def _inverse(m: np.ndarray) -> np.ndarray:
    e = np.linalg.eigvalsh(m)
    if not e[0] > 1e-12 * e[-1]:
        raise EngineError("The columns' cross-products cannot be inverted: columns combine or repeat one another, or there are too few rows.")
    return np.linalg.inv(m)


def ml_lag(f: LagFrame, det: LogDet, durbin: bool) -> dict:
    """Spatial lag model, or Durbin model with the lags of X beside X: maximum of the concentrated likelihood."""
    n = f.n
    x = [*f.x, *(f.w(f.x[1:]) if durbin else [])]
    inv = _inverse(f.g(x, x))
    xy, xw = f.g(x, ["y"])[:, 0], f.g(x, ["w_y"])[:, 0]
    b0, bl = inv @ xy, inv @ xw
    yy, yw, ww = f.g(["y"], ["y"])[0, 0], f.g(["y"], ["w_y"])[0, 0], f.g(["w_y"], ["w_y"])[0, 0]
    e00, e0l, ell = yy - b0 @ xy, yw - b0 @ xw, ww - bl @ xw

    def sse(r: float) -> float:
        return e00 - 2 * r * e0l + r * r * ell

    def ll(r: float) -> float:
        # The likelihood of y itself: standardising it divides the density by its scale.
        return -n / 2 * (math.log(2 * math.pi) + 1 + math.log(sse(r) / n)) + det(r) - n * math.log(f.y_scale)

    rho, inside = _settle(det, ll)
    beta = b0 - rho * bl
    s2 = sse(rho) / n
    k = len(x)
    once, twice, norm, xp, pp = det.spread(rho, f, x, beta)
    m = np.zeros((k + 2, k + 2))
    m[:k, :k] = f.g(x, x) / s2
    m[:k, k] = m[k, :k] = xp / s2
    m[k, k] = twice + norm + pp / s2
    m[k, k + 1] = m[k + 1, k] = once / s2
    m[k + 1, k + 1] = n / (2 * s2 * s2)
    cov = np.linalg.inv(m)[: k + 1, : k + 1]
    t = np.eye(k + 1)
    t[:k, :k] = f.transform(k, durbin, 1 - rho)
    t[0, k] = -f.y_mean  # the constant holds (1 - rho) mean(y)
    est = t @ np.append(beta, rho)
    est[0] += f.y_mean
    cov = t @ cov @ t.T
    coef = {"y": 1.0, "w_y": -rho} | {c: -float(b) for c, b in zip(x, beta)}
    names = ["CONSTANT", *f.xs, *(f"W_{c}" for c in f.xs if durbin), f"W_{f.y}"]
    return _result(f, names, est, cov, ll(rho), len(x) + 1, coef, rho=rho, lam=None, converged=inside) | {"log_determinant": det.document(rho)}


def ml_error(f: LagFrame, det: LogDet) -> dict:
    """Spatial error model: generalised least squares on columns filtered by I - lambda W."""
    n, x = f.n, f.x
    wx = f.w(x)

    def filtered(la: float) -> tuple[np.ndarray, np.ndarray, float]:
        xx = f.g(x, x) - la * (f.g(x, wx) + f.g(wx, x)) + la * la * f.g(wx, wx)
        xy = f.g(x, ["y"]) - la * (f.g(x, ["w_y"]) + f.g(wx, ["y"])) + la * la * f.g(wx, ["w_y"])
        yy = f.g(["y"], ["y"])[0, 0] - 2 * la * f.g(["y"], ["w_y"])[0, 0] + la * la * f.g(["w_y"], ["w_y"])[0, 0]
        return xx, xy[:, 0], yy

    def ll(la: float) -> float:
        xx, xy, yy = filtered(la)
        s = yy - xy @ np.linalg.solve(xx, xy)
        return -n / 2 * (math.log(2 * math.pi) + 1 + math.log(s / n)) + det(la) - n * math.log(f.y_scale)

    _inverse(f.g(x, x))
    la, inside = _settle(det, ll)
    xx, xy, yy = filtered(la)
    inv = _inverse(xx)
    beta = inv @ xy
    s2 = (yy - xy @ beta) / n
    k = len(x)
    cov = np.zeros((k + 1, k + 1))
    cov[:k, :k] = s2 * inv
    once, twice, norm, _, _ = det.spread(la)
    m = np.array([[twice + norm, once / s2], [once / s2, n / (2 * s2 * s2)]])
    cov[k, k] = np.linalg.inv(m)[0, 0]
    t = np.eye(k + 1)
    t[:k, :k] = f.transform(k, False, 1.0)
    est = t @ np.append(beta, la)
    est[0] += f.y_mean
    cov = t @ cov @ t.T
    coef = {"y": 1.0} | {c: -float(b) for c, b in zip(x, beta)}
    return _result(f, ["CONSTANT", *f.xs, "lambda"], est, cov, ll(la), k, coef, rho=None, lam=la, converged=inside) | {"log_determinant": det.document(la)}


def _result(f: LagFrame, names, est, cov, ll, k, coef, *, rho, lam, converged) -> dict:
    with np.errstate(all="ignore"):
        se = np.sqrt(np.diag(cov))
        z = est / se
    p = normal_two_sided(z)
    rows = [
        {
            "term": t,
            "estimate": finite(b),
            "standard_error": finite(s),
            "statistic": finite(v),
            "p_value": finite(q),
            "confidence_low": finite(b - 1.96 * s),
            "confidence_high": finite(b + 1.96 * s),
        }
        for t, b, s, v, q in zip(names, est, se, z, p)
    ]
    # Fit: predictions are y minus the residual, both linear in the columns.
    r = np.array([coef.get(c, 0.0) for c in f.columns])
    y = np.array([float(c == "y") for c in f.columns])
    one = np.array([float(c == "one") for c in f.columns])
    fit = y - r
    gram, n = f.gram, f.n
    cross = lambda a, b: a @ gram @ b - (a @ gram @ one) * (b @ gram @ one) / n
    vf = cross(fit, fit)
    pr2 = cross(y, fit) ** 2 / (cross(y, y) * vf) if vf > 0 else math.nan
    return {
        "coefficients": rows,
        "metrics": {
            "pseudo_r_squared": finite(pr2),
            "aic": finite(2 * k - 2 * ll),
            "bic": finite(k * math.log(n) - 2 * ll),
            "log_likelihood": finite(ll),
            "rho": finite(rho),
            "lambda": finite(lam),
        },
        "residuals": f.residuals(coef),
        "converged": converged,
        "inference": (est, se, p),
    }


def impacts(result: dict, method: str, columns: Sequence[str]) -> list[dict]:
    """Simple impacts: direct b, total (b + theta) / (1 - rho), indirect the difference; none for the error model."""
    if method not in ("slm", "sdm"):
        return []
    est = {r["term"]: r["estimate"] for r in result["coefficients"]}
    own = 1.0 - (result["metrics"]["rho"] or 0.0)
    out = []
    for c in columns:
        if abs(own) < 1e-12:
            out.append({"term": c, "direct": None, "indirect": None, "total": None})
            continue
        total = (est[c] + (est.get(f"W_{c}", 0.0) if method == "sdm" else 0.0)) / own
        out.append({"term": c, "direct": finite(est[c]), "indirect": finite(total - est[c]), "total": finite(total)})
    return out


RECOMMENDATIONS = {
    "slm": "The robust lag test is significant and the robust error test is not: prefer the spatial lag model.",
    "sem": "The robust error test is significant and the robust lag test is not: prefer the spatial error model.",
    "sdm": "Both robust tests are significant: compare richer models such as the spatial Durbin model.",
    "ols": "Neither robust test is significant: keep least squares.",
}


def recommend(robust_error_p: float, robust_lag_p: float) -> str:
    if robust_lag_p < 0.05 <= robust_error_p:
        return "slm"
    if robust_error_p < 0.05 <= robust_lag_p:
        return "sem"
    return "sdm" if robust_lag_p < 0.05 and robust_error_p < 0.05 else "ols"


def model_selection(f: LagFrame, sums: dict[str, float]) -> dict:
    """Lagrange-multiplier tests and Moran's I of the residuals of least squares, from cross-products alone."""
    n, x, wx, tx = f.n, f.x, f.w(f.x), [f"t_{c}" for c in f.x]
    k = len(x)
    try:
        inv = _inverse(f.g(x, x))
        b = inv @ f.g(x, ["y"])[:, 0]
        at = f.columns.index
        e, we, wxb = (np.zeros(len(f.columns)) for _ in range(3))
        e[at("y")], we[at("w_y")] = 1.0, 1.0
        for c, v in zip(x, b):
            e[at(c)] -= v
            we[at(f"w_{c}")] -= v
            wxb[at(f"w_{c}")] += v
        wy = np.zeros(len(f.columns))
        wy[at("w_y")] = 1.0
        g = f.gram
        ee = e @ g @ e
        s2 = ee / n
        t = sums["tr_wtw"] + sums["tr_ww"]
        d_e, d_l = (e @ g @ we) / s2, (e @ g @ wy) / s2
        xg = g[[at(c) for c in x]]
        m_wxb = wxb @ g @ wxb - (xg @ wxb) @ inv @ (xg @ wxb)
        j = m_wxb / s2 + t
        lm_error, lm_lag = d_e**2 / t, d_l**2 / j
        r_lag = (d_l - d_e) ** 2 / (j - t)
        r_error = (d_e - t / j * d_l) ** 2 / (t * (1 - t / j))
        sarma = lm_error + r_lag
        tests = [("LM-Error", lm_error, 1), ("LM-Lag", lm_lag, 1), ("Robust LM-Error", r_error, 1), ("Robust LM-Lag", r_lag, 1), ("LM-SARMA", sarma, 2)]
        rows = [{"name": a, "statistic": finite(s), "p_value": finite(chi2_sf(s, df))} for a, s, df in tests]
        a1 = inv @ f.g(x, wx)
        tr_mw = -np.trace(a1)
        tr_mwmw = sums["tr_ww"] - 2 * np.trace(inv @ f.g(tx, wx)) + np.trace(a1 @ a1)
        tr_mwmwt = sums["tr_wtw"] - np.trace(inv @ f.g(wx, wx)) - np.trace(inv @ f.g(tx, tx)) + np.trace(a1 @ inv @ f.g(wx, x))
        scale = n / sums["s0"]
        i = scale * (e @ g @ we) / ee
        mean = scale * tr_mw / (n - k)
        var = scale**2 * (tr_mwmwt + tr_mwmw + tr_mw**2) / ((n - k) * (n - k + 2)) - mean**2
        z = (i - mean) / math.sqrt(var)
    except (EngineError, ValueError, ZeroDivisionError, np.linalg.LinAlgError) as exc:
        return {"available": False, "baseline_residual_moran": None, "tests": [], "model": None, "recommendation": "The baseline diagnostics could not be computed.", "warnings": [str(exc)]}
    model = recommend(rows[2]["p_value"], rows[3]["p_value"])
    return {
        "available": True,
        "baseline_residual_moran": {"i": finite(i), "z_score": finite(z), "p_value": finite(float(normal_two_sided(z)))},
        "tests": rows,
        "model": model,
        "recommendation": RECOMMENDATIONS[model],
        "warnings": [],
    }
