"""Least squares, logistic and negative binomial regression from sums that Spark computes.

The rows are read once for least squares and once per Newton step for the others; only matrices of
the number of parameters reach the driver. Columns are standardised for the fit and estimates are
carried back to the original scale.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.functions.special import digamma, finite, lgamma, normal_two_sided, t_quantile, t_two_sided, trigamma
from tabulon.operators.correlation import METHODS as CORRELATIONS
from tabulon.operators.correlation import correlate
from tabulon.operators.design import cross_products, design_diagnostics, judged
from tabulon.operators.guards import enough, known, predictors, require, varying
from tabulon.operators.numeric import Prepared, prepare
from tabulon.runtime import quoted

METHODS = ("ols", "logistic", "negative_binomial")
_Z95 = 1.959963984540054
_FAILED = "The model could not be fitted. Check sample size, variation and collinearity."


class Design:
    """Standardised columns [1, z..] as expressions, their correlation matrix, and the way back to the raw scale."""

    def __init__(self, p: Prepared, columns: list[str], y: str):
        self.p, self.columns, self.y = p, columns, y
        self.n = p.observations
        self.means = np.array([p.stats[c]["avg"] for c in columns])
        self.scales = np.array([p.stats[c]["std"] for c in columns])
        safe = np.where(self.scales > 0, self.scales, 1.0)
        self.terms = [F.lit(1.0)] + [(quoted(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(columns, self.means, safe)]
        k = len(columns) + 1
        # raw beta = back @ standardised beta
        self.back = np.eye(k)
        self.back[1:, 1:] = np.diag(1.0 / safe)
        self.back[0, 1:] = -self.means / safe

    def gram(self) -> np.ndarray:
        """Cross-products of [1, z.., y centred]."""
        return cross_products(self.p.df, [*self.terms, quoted(self.y) - F.lit(float(self.p.stats[self.y]["avg"]))])


def _rows(terms, beta, se, stat, p, low, high, ratio) -> list[dict]:
    out = []
    for i, t in enumerate(terms):
        r = None
        if ratio and t != "alpha":
            try:
                r = finite(math.exp(beta[i]))
            except OverflowError:
                r = None
        out.append(
            {
                "term": t,
                "estimate": finite(beta[i]),
                "standard_error": finite(se[i]),
                "statistic": finite(stat[i]),
                "p_value": finite(p[i]),
                "confidence_low": finite(low[i]),
                "confidence_high": finite(high[i]),
                "effect_ratio": r,
            }
        )
    return out


def _wald(beta: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, ...]:
    with np.errstate(all="ignore"):
        se = np.sqrt(np.diag(cov))
        z = beta / se
    return se, z, normal_two_sided(z), beta - _Z95 * se, beta + _Z95 * se


def _ols(d: Design, g: np.ndarray) -> dict:
    k = len(d.columns) + 1
    n = d.n
    xx, xy, yy = g[:k, :k], g[:k, k], g[k, k]
    mean = d.p.stats[d.y]["avg"]
    eig = np.linalg.eigvalsh(xx / n)
    rank = int(np.count_nonzero(eig > 1e-12 * max(1.0, eig[-1])))
    if rank == k:
        inv = np.linalg.inv(xx)
        b = inv @ xy
        ssr = max(float(yy - b @ xy), 0.0)
        beta = d.back @ b
        cov = d.back @ inv @ d.back.T
    else:
        # The smallest solution on the original scale.
        fwd = np.linalg.inv(d.back)
        raw = fwd.T @ xx @ fwd
        inv = np.linalg.pinv(raw, rcond=1e-11, hermitian=True)
        beta = inv @ (fwd.T @ xy)
        ssr = max(float(yy - (np.linalg.pinv(xx, rcond=1e-11, hermitian=True) @ xy) @ xy), 0.0)
        beta = beta + inv @ (raw[:, 0] * mean)
        cov = inv
        mean = 0.0
    beta = beta.copy()
    beta[0] += mean
    df = n - rank
    s2 = ssr / df if df > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(cov) * s2, 0.0))
    with np.errstate(all="ignore"):
        t = beta / se
    p = np.array([t_two_sided(float(v), df) for v in t])
    q = t_quantile(0.975, df)
    r2 = 1.0 - ssr / yy if yy > 0 else math.nan
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else math.inf
    return {
        "rows": _rows(["const", *d.columns], beta, se, t, p, beta - q * se, beta + q * se, False),
        "metrics": {
            "r_squared": finite(r2),
            "adjusted_r_squared": finite(1 - (1 - r2) * (n - 1) / df) if df > 0 else None,
            "pseudo_r_squared": None,
            "aic": finite(-2 * ll + 2 * rank),
            "bic": finite(-2 * ll + math.log(n) * rank),
            "log_likelihood": finite(ll),
        },
        "converged": True,
        "inference": (beta, se, p),
    }


def _logit(d: Design, low: float, iterations: int) -> dict:
    """Newton steps; each is one aggregation of weighted cross-products."""
    k = len(d.columns) + 1
    y = F.when(quoted(d.y) == F.lit(low), 0.0).otherwise(1.0)
    b = np.zeros(k)
    converged, last = False, -math.inf
    ones = None
    for _ in range(iterations):
        eta = sum((t * F.lit(float(v)) for t, v in zip(d.terms[1:], b[1:])), F.lit(float(b[0])))
        mu = 1.0 / (1.0 + F.exp(-eta))
        ll = F.sum(y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))).alias("ll")
        aggs = [ll, F.sum(y).alias("ones")]
        aggs += [F.sum((y - mu) * t).alias(f"g{i}") for i, t in enumerate(d.terms)]
        aggs += [F.sum(mu * (1 - mu) * d.terms[i] * d.terms[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = d.p.df.agg(*aggs).first()
        ones = r["ones"]
        grad = np.array([r[f"g{i}"] for i in range(k)])
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        if np.abs(grad).max() < 1e-8 * max(1.0, d.n) or abs(r["ll"] - last) < 1e-12 * max(1.0, abs(last)):
            converged, last = True, r["ll"]
            break
        last = r["ll"]
        try:
            step = np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError as exc:
            raise EngineError(_FAILED) from exc
        b = b + step
        if not np.isfinite(b).all() or np.abs(b).max() > 1e3:
            raise EngineError(_FAILED)
    share = ones / d.n
    null = d.n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    try:
        cov = d.back @ np.linalg.inv(hess) @ d.back.T
    except np.linalg.LinAlgError as exc:
        raise EngineError(_FAILED) from exc
    beta = d.back @ b
    se, z, p, lo, hi = _wald(beta, cov)
    return {
        "rows": _rows(["const", *d.columns], beta, se, z, p, lo, hi, True),
        "metrics": _likelihood(last, null, d.n, k),
        "converged": converged,
        "inference": (beta, se, p),
    }


def _likelihood(ll: float, null: float, n: int, k: int) -> dict:
    return {
        "r_squared": None,
        "adjusted_r_squared": None,
        "pseudo_r_squared": finite(1 - ll / null) if null else None,
        "aic": finite(-2 * ll + 2 * k),
        "bic": finite(-2 * ll + math.log(n) * k),
        "log_likelihood": finite(ll),
    }


def _nb_sums(df: DataFrame, k: int, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian in (beta, alpha): one partial sum per Arrow batch, added by Spark."""
    m = k + 1
    names = ["ll", *(f"g{i}" for i in range(m)), *(f"h{i}_{j}" for i in range(m) for j in range(i, m))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, alpha = theta[:k], theta[k]
        a = 1.0 / alpha
        for pdf in batches:
            v = pdf.to_numpy(float)
            x, y = v[:, :k], v[:, k]
            mu = np.exp(np.clip(x @ b, -700, 700))
            am = 1.0 + alpha * mu
            log_am = np.log1p(alpha * mu)
            one = np.full(1, a)
            bracket = log_am - digamma(y + a) + digamma(one)
            ll = lgamma(y + a) - math.lgamma(a) - lgamma(y + 1) + y * (math.log(alpha) + np.log(mu) - log_am) - a * log_am
            gb = x.T @ ((y - mu) / am)
            ga = a * a * bracket + (y - mu) / (alpha * am)
            h = np.zeros((m, m))
            h[:k, :k] = -(x * (mu * (1 + alpha * y) / am**2)[:, None]).T @ x
            h[:k, k] = -(x.T @ (mu * (y - mu) / am**2))
            h[k, k] = (
                -2 * a**3 * bracket + a * a * (mu / am + a * a * (trigamma(y + a) - trigamma(one))) - (y - mu) * (1 + 2 * alpha * mu) / (alpha * am) ** 2
            ).sum()
            row = [ll.sum(), *gb, ga.sum(), *(h[i, j] for i in range(m) for j in range(i, m))]
            yield pd.DataFrame([row], columns=names)

    r = df.mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    return r["ll"], np.array([r[f"g{i}"] for i in range(m)]), hess


def _nb_fit(df: DataFrame, k: int, start: np.ndarray, iterations: int) -> tuple[np.ndarray, float, np.ndarray, bool]:
    theta = start
    ll, g, h = _nb_sums(df, k, theta)
    for _ in range(iterations):
        # Newton in (beta, log alpha), which keeps alpha positive.
        j = np.ones(k + 1)
        j[k] = theta[k]
        gl = g * j
        hl = h * np.outer(j, j)
        hl[k, k] += g[k] * theta[k]
        e, v = np.linalg.eigh(-hl)
        step = v @ ((v.T @ gl) / np.maximum(np.abs(e), 1e-8 * max(1.0, np.abs(e).max())))
        decrement = float(gl @ step)
        if decrement < 1e-10:
            return theta, ll, h, True
        size = min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        while size > 1e-6:
            new = theta.copy()
            new[:k] += size * step[:k]
            new[k] = min(max(theta[k] * math.exp(size * step[k]), 1e-10), 1e10)
            ll2, g2, h2 = _nb_sums(df, k, new)
            if math.isfinite(ll2) and ll2 >= ll:
                break
            size /= 2
        else:
            return theta, ll, h, decrement < 1e-6
        theta, ll, g, h = new, ll2, g2, h2
    return theta, ll, h, False


def _negative_binomial(d: Design, iterations: int) -> dict:
    k = len(d.columns) + 1
    s = d.p.stats[d.y]
    mean, var = s["avg"], s["std"] ** 2
    if mean <= 0:
        raise EngineError(_FAILED)
    alpha = max((var - mean) / mean**2, 0.05)
    df = d.p.df.select(*[t.alias(f"x{i}") for i, t in enumerate(d.terms)], quoted(d.y).alias("y"))
    start = np.zeros(k + 1)
    start[0], start[k] = math.log(mean), alpha
    theta, ll, h, converged = _nb_fit(df, k, start, iterations)
    _, null, _, _ = _nb_fit(df.select("x0", "y"), 1, np.array([math.log(mean), alpha]), iterations)
    back = np.eye(k + 1)
    back[:k, :k] = d.back
    try:
        cov = back @ np.linalg.inv(-h) @ back.T
    except np.linalg.LinAlgError as exc:
        raise EngineError(_FAILED) from exc
    beta = back @ theta
    se, z, p, lo, hi = _wald(beta, cov)
    return {
        "rows": _rows(["const", *d.columns, "alpha"], beta, se, z, p, lo, hi, True),
        "metrics": _likelihood(ll, null, d.n, k + 1),
        "converged": converged,
        "inference": (beta, se, p),
    }


def regress(df: DataFrame, method: str, dependent: str, independent: list[str], iterations: int = 200) -> dict:
    """Result document of a regression; see the module's text. Errors name the first condition that fails."""
    require([known("Method", method, METHODS), *predictors(dependent, independent)])
    p = prepare(df, [dependent, *independent])
    require([enough(p.observations, len(independent) + 3), *varying(p, independent)])
    y = quoted(dependent)
    mapping, low = None, 0.0
    if method == "negative_binomial":
        odd = p.df.agg(F.count_if((y < 0) | (y % 1 != 0)).alias("n")).first()["n"]
        require([(not odd, f"The response of a count model holds {odd} values that are negative or not whole; counts are non-negative.")])
    elif method == "logistic":
        s = p.stats[dependent]
        between = p.df.agg(F.count_if((y > F.lit(s["min"])) & (y < F.lit(s["max"]))).alias("n")).first()["n"]
        require([(not between and not p.constant(dependent), "The response of a logistic model must have exactly two values.")])
        low = s["min"]
        whole = dict(df.dtypes)[dependent] in ("tinyint", "smallint", "int", "bigint")
        text = lambda v: str(int(v)) if whole else str(v)
        mapping = {text(s["min"]): 0, text(s["max"]): 1}
    d = Design(p, independent, dependent)
    again = method != "ols"
    if again:
        p.df = p.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        g = d.gram()
        k = len(independent) + 1
        z = g[1:k, 1:k] / d.n
        diagnostics = design_diagnostics(z, d.means, d.scales, independent)
        fit = _ols(d, g) if method == "ols" else _logit(d, low, iterations) if method == "logistic" else _negative_binomial(d, iterations)
    except (np.linalg.LinAlgError, ZeroDivisionError, OverflowError, ValueError) as exc:
        if isinstance(exc, EngineError):
            raise
        raise EngineError(_FAILED) from exc
    finally:
        if again:
            p.df.unpersist()
    return {
        "kind": "regression",
        "method": method,
        "observations": p.observations,
        "dropped_rows": p.dropped,
        "dependent_column": dependent,
        "independent_columns": independent,
        "correlation": None,
        "regression": {"coefficients": fit["rows"], "metrics": fit["metrics"], "binary_mapping": mapping},
        "diagnostics": judged(diagnostics, fit),
    }


def analyze(df: DataFrame, method: str, dependent: str, independent: list[str]) -> dict:
    """Correlation or regression by the name of the method."""
    return correlate(df, method, dependent, independent) if method in CORRELATIONS else regress(df, method, dependent, independent)
