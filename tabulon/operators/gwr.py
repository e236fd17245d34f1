"""Geographically weighted regression: adaptive bisquare kernel, golden-section bandwidth, local results.

Each observation is a focal point with its own weighted least squares over all rows, so the work grows
with the square of the rows. Every task holds the rows (8 bytes a cell); focal points are spread over the
tasks and solved in batches, from weighted moments of the rows inside the kernel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.functions.special import finite, normal_two_sided
from tabulon.functions.sphere import haversine
from tabulon.operators.guards import enough, require

#: Pairs of a focal point and a row whose distances are held at once.
PAIRS = 1_000_000
_FAILED = "A local fit has no solution: its rows share a position, its columns repeat one another, or there are too few."


def bisquare(d: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Weights (1 - (d / reach)^2)^2 within the reach, 0 beyond; all 1 where the reach is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = d / reach
        w = np.where(z < 1.0, (1.0 - z * z) ** 2, 0.0)
    return np.where(reach > 0, w, 1.0)


def kernel_weights(edges: DataFrame) -> DataFrame:
    """(i, j, w): the kernel's weights of neighbours (i, j, distance), the farthest of each i at its reach."""

    @F.pandas_udf("double")
    def weight(d: pd.Series, reach: pd.Series) -> pd.Series:
        return pd.Series(bisquare(d.to_numpy(float), reach.to_numpy(float)))

    reach = F.max("distance").over(Window.partitionBy("i"))
    return edges.withColumn("reach", reach).select("i", "j", weight("distance", "reach").alias("w"))


class LocalFits:
    """The rows held by every task, and the local fits of some focal rows for a bandwidth."""

    def __init__(self, xy: np.ndarray, x: np.ndarray, y: np.ndarray, spherical: bool):
        self.xy = np.radians(xy) if spherical else xy
        self.x = np.column_stack((np.ones(len(x)), x))
        self.xx = (self.x[:, :, None] * self.x[:, None, :]).reshape(len(x), -1)
        self.y, self.spherical = y, spherical

    def distances(self, focal: np.ndarray) -> np.ndarray:
        a, b = self.xy[focal][:, None, :], self.xy[None, :, :]
        if self.spherical:
            return haversine(a[..., 0], a[..., 1], b[..., 0], b[..., 1], 6371.0)
        return np.sqrt(((a - b) ** 2).sum(axis=2))

    def inside(self, focal: np.ndarray, bandwidth: int) -> tuple[np.ndarray, np.ndarray | None]:
        """(weights, the numbers of their rows) inside the kernels; no numbers if that is most of the rows, in order."""
        d = self.distances(focal)
        part = np.partition(d, bandwidth - 1, axis=1)
        # The farthest neighbour lies just inside the kernel, and so does whatever is as far.
        reach = part[:, bandwidth - 1 : bandwidth] * 1.0000001
        if 4 * bandwidth > d.shape[1] or not (reach > 0).all():
            return bisquare(d, reach), None
        most = int((d < reach).sum(axis=1).max())
        at = np.argpartition(d, most - 1, axis=1)[:, :most]
        return bisquare(np.take_along_axis(d, at, axis=1), reach), at

    def moments(self, w: np.ndarray, at: np.ndarray | None, columns: np.ndarray) -> np.ndarray:
        """The weighted sums of columns at each focal point."""
        return w @ columns if at is None else np.einsum("fm,fmc->fc", w, columns[at])

    def fit(self, focal: np.ndarray, bandwidth: int, *, errors: bool = True) -> dict[str, np.ndarray]:
        w, at = self.inside(focal, bandwidth)
        k = self.x.shape[1]
        square = lambda m: m.reshape(-1, k, k)
        sums = self.moments(w, at, np.column_stack((self.xx, self.x * self.y[:, None])))
        inverse = np.linalg.inv(square(sums[:, : k * k]))
        beta = np.einsum("fkl,fl->fk", inverse, sums[:, k * k :])
        own = self.x[focal]
        # A focal point has distance 0 to itself, so its own weight is 1.
        out = {"beta": beta, "predicted": (own * beta).sum(axis=1), "s": np.einsum("fk,fkl,fl->f", own, inverse, own)}
        if errors:
            out["cct"] = np.einsum("fkl,flm,fkm->fk", inverse, square(self.moments(w * w, at, self.xx)), inverse)
        return out


def _batches(focal: np.ndarray, n: int) -> Iterator[np.ndarray]:
    step = max(1, PAIRS // n)
    for s in range(0, len(focal), step):
        yield focal[s : s + step]


def _golden(score, low: int, high: int) -> tuple[int, list[tuple[int, float]]]:
    """Golden section over whole numbers; each is scored once. Where neither of two has a finite score, larger ones are tried."""
    seen: dict[int, float] = {}

    def at(v: int) -> float:
        if v not in seen:
            seen[v] = score(v)
        return seen[v]

    delta = 0.38197
    a, c = float(low), float(high)
    b, d = round(a + delta * abs(c - a)), round(c - delta * abs(c - a))
    best = b
    for _ in range(200):
        fb, fd = at(b), at(d)
        if fb <= fd and fb < math.inf:
            best, c, d = b, d, b
            b = round(a + delta * abs(c - a))
        else:
            best, a, b = d, b, d
            d = round(c - delta * abs(c - a))
        if abs(fb - fd) <= 1e-6:
            break
    return int(best), sorted(seen.items())


def fit_gwr(rows: DataFrame, x: str, y: str, dependent: str, independent: Sequence[str], spherical: bool, *, bandwidth: int | None = None) -> dict:
    """Bandwidth, metrics, coefficient summaries and the local results (a DataFrame with every row).

    ``rows`` holds (id, source_row, coordinates, columns) of complete cases with unique ids.
    """
    spark = rows.sparkSession
    n = rows.count()
    k = len(independent) + 1
    low = max(2 * k + 1, 5)
    require([enough(n, low + 1)])
    data = rows.orderBy("id").toPandas()
    ids = data["id"].to_numpy()
    parts = (data[[x, y]].to_numpy(float), data[list(independent)].to_numpy(float), data[dependent].to_numpy(float), spherical)
    model = LocalFits(*parts)
    held = spark.sparkContext.broadcast(parts)
    width = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    focal = spark.range(0, n, 1, width)

    def score(bw: int) -> float:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = LocalFits(*held.value)
            for b in batches:
                rss = tr = 0.0
                for part in _batches(b["id"].to_numpy(), n):
                    try:
                        f = m.fit(part, bw, errors=False)
                    except np.linalg.LinAlgError:  # too few rows for some local fit: no bandwidth to take
                        rss = math.inf
                        break
                    rss += float(((m.y[part] - f["predicted"]) ** 2).sum())
                    tr += float(f["s"].sum())
                yield pd.DataFrame({"rss": [rss], "tr": [tr]})

        r = focal.mapInPandas(run, "rss double, tr double").agg(F.sum("rss").alias("rss"), F.sum("tr").alias("tr")).first()
        return _aicc(n, r["rss"], r["tr"])

    def local(bw: int) -> pd.DataFrame:
        schema = "id long, predicted double, s double, " + ", ".join(f"b{i} double, c{i} double" for i in range(k))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = LocalFits(*held.value)
            for b in batches:
                for part in _batches(b["id"].to_numpy(), n):
                    f = m.fit(part, bw)
                    out = {"id": part, "predicted": f["predicted"], "s": f["s"]}
                    for i in range(k):
                        out[f"b{i}"], out[f"c{i}"] = f["beta"][:, i], f["cct"][:, i]
                    yield pd.DataFrame(out)

        return focal.mapInPandas(run, schema).toPandas().sort_values("id")

    try:
        searched: list = []
        if bandwidth is None:
            bandwidth, searched = _golden(score, low, n)
        elif not k < bandwidth <= n:
            raise EngineError(f"The bandwidth must lie between {k + 1} and {n}.")
        f = local(bandwidth)
    except EngineError:
        raise
    except Exception as exc:
        raise EngineError(_FAILED) from exc
    predicted = f["predicted"].to_numpy()
    residual = model.y - predicted
    rss, tr = float(residual @ residual), float(f["s"].sum())
    tss = float(((model.y - model.y.mean()) ** 2).sum())
    s2 = rss / (n - tr)

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LocalFits(*held.value)
        for b in batches:
            for part in _batches(b["id"].to_numpy(), n):
                w, at = m.inside(part, bandwidth)
                y = m.y[None] if at is None else m.y[at]
                mean = (w * y).sum(axis=1) / w.sum(axis=1)
                t = (w * (y - mean[:, None]) ** 2).sum(axis=1)
                r = m.moments(w, at, residual[:, None] ** 2)[:, 0]
                with np.errstate(all="ignore"):
                    yield pd.DataFrame({"id": part, "local_r_squared": np.where(t > 0, 1.0 - r / t, np.nan)})

    local_r2 = focal.mapInPandas(share, "id long, local_r_squared double").toPandas().sort_values("id")["local_r_squared"].to_numpy()
    terms = ["CONSTANT", *independent]
    table = {"id": ids, "source_row": data["source_row"].to_numpy(), x: data[x], y: data[y], "observed": model.y, "predicted": predicted, "residual": residual, "local_r_squared": local_r2}
    summaries, arrays = [], []
    for i, t in enumerate(terms):
        b = f[f"b{i}"].to_numpy()
        with np.errstate(all="ignore"):
            se = np.sqrt(f[f"c{i}"].to_numpy() * s2)
            tv = b / se
        p = normal_two_sided(tv)
        arrays += [b, se, tv]
        table |= {f"coefficient_{t}": b, f"standard_error_{t}": se, f"t_value_{t}": tv, f"p_value_unadjusted_{t}": p}
        summaries.append(
            {"term": t, "mean": finite(b.mean()), "standard_deviation": finite(b.std()), "minimum": finite(b.min()), "median": finite(float(np.median(b))), "maximum": finite(b.max())}
        )
    frame = pd.DataFrame(table)
    frame = frame.astype(object).where(frame.apply(lambda c: np.isfinite(c.astype(float))), None)
    schema = "id long, source_row long, " + ", ".join(f"`{c}` double" for c in list(table)[2:])
    local_rows = spark.createDataFrame(frame, schema)
    r2 = 1 - rss / tss if tss > 0 else math.nan
    ll = -n / 2 * (math.log(2 * math.pi) + 1 + math.log(rss / n)) if rss > 0 else math.inf
    return {
        "bandwidth": bandwidth,
        "search": searched,
        "metrics": {
            "r_squared": finite(r2),
            "adjusted_r_squared": finite(1 - (1 - r2) * (n - 1) / (n - tr - 1)),
            "aic": finite(-2 * ll + 2 * (tr + 1)),
            "aicc": finite(_aicc(n, rss, tr)),
        },
        "coefficient_summaries": summaries,
        "local": local_rows,
        "converged": True,
        "inference": tuple(arrays),
        "residuals": local_rows.select("id", F.col("residual").alias("value")),
    }


def _aicc(n: int, rss: float, tr: float) -> float:
    if not 0 < rss < math.inf or n - tr - 2 <= 0:
        return math.inf
    return n * (math.log(2 * math.pi) + 1 + math.log(rss / n)) + 2 * n * (tr + 1) / (n - tr - 2)
