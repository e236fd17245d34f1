"""Spatial weights as an edge table (i, j, w): nearest neighbours, lags, components.

Nearest neighbours are exact at any size: points are placed in cells around two levels of pivots drawn
from them; the distance to the k-th neighbour within the own cell bounds the search, and a point then asks
only the cells whose boxes can hold a nearer one. Inside a cell leaves of a few dozen points prune the
search in the same way. Most points ask no other cell and are done. Crowded cells are searched in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.functions.sphere import sphere_xyz
from tabulon.operators.guards import known as one_of
from tabulon.operators.guards import require
from tabulon.runtime import cut, hashed_share, quoted

COORDINATES = ("geographic", "projected")


def coordinates(df: DataFrame, id_column: str, x: str, y: str, kind: str) -> DataFrame:
    """(id, a, b, c): planar coordinates, or unit vectors, whose chords keep the great-circle order."""
    return df.select(quoted(id_column).cast("long").alias("id"), *[e.alias(n) for e, n in zip(axes(x, y, kind), "abc")])


def axes(x: str, y: str, kind: str) -> tuple[Column, Column, Column]:
    require([one_of("Coordinate type", kind, COORDINATES)])
    u, v = quoted(x).cast("double"), quoted(y).cast("double")
    return sphere_xyz(u, v) if kind == "geographic" else (u, v, F.lit(0.0))


def check_degrees(df: DataFrame, x: str, y: str) -> None:
    off = df.agg(*[F.count_if(~quoted(c).between(-most, most)).alias(n) for n, c, most in (("lon", x, 180), ("lat", y, 90))]).first()
    require([(not off["lon"], f"{off['lon']} longitudes lie outside -180 to 180."), (not off["lat"], f"{off['lat']} latitudes lie outside -90 to 90.")])


#: Points of a leaf in the search inside a cell.
LEAF = 40


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """The points' numbers in leaves of at most ``LEAF``: halves by count along the longest side of their box."""
    out, stack = [], [np.arange(len(p))] if len(p) else []
    while stack:
        m = stack.pop()
        if len(m) <= LEAF:
            out.append(m)
            continue
        own = p[m]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        o = np.argpartition(own[:, side], len(m) // 2)
        stack += [m[o[: len(m) // 2]], m[o[len(m) // 2 :]]]
    return out


def _boxes(p: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[m].min(axis=0) for m in leaves]), np.array([p[m].max(axis=0) for m in leaves])


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distance between a box (or each of several points, their own boxes) and each of the boxes."""
    gap = np.maximum(0.0, np.maximum(lows - high[..., None, :], low[..., None, :] - highs))
    return np.sqrt((gap * gap).sum(axis=-1))


def _metric(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.subtract.outer(x[:, 0], y[:, 0]) ** 2
    for c in range(1, x.shape[1]):
        d += np.subtract.outer(x[:, c], y[:, c]) ** 2
    return np.sqrt(d, out=d)


def _near(q: np.ndarray, qid: np.ndarray, p: np.ndarray, pid: np.ndarray, k: int, self_too: bool, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest points of each query, by (distance, id); inf and -1 where there are fewer.

    Points and queries are put into leaves; a leaf of queries looks at the leaves of points whose boxes are no
    farther than its worst bound, which comes from the nearest leaves and from ``limit``, distances beyond
    which a query needs no neighbours.
    """
    order = np.argsort(pid, kind="stable")
    p, pid = p[order], pid[order]
    dist, ids = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    if not len(p) or not len(q):
        return dist, ids
    leaves = _leaves(p)
    low, high = _boxes(p, leaves)
    size = np.array([len(m) for m in leaves])
    for mine in _leaves(q):
        x, own = q[mine], qid[mine]

        def away(at: np.ndarray) -> np.ndarray:
            d = _metric(x, p[at])
            if not self_too:
                d[own[:, None] == pid[at][None, :]] = np.inf
            return d

        gap = _apart(x.min(axis=0), x.max(axis=0), low, high)
        first = np.argsort(gap, kind="stable")
        first = first[: 1 + int(np.searchsorted(np.cumsum(size[first]), 2 * (k + 1)))]
        d = away(np.concatenate([leaves[i] for i in first]))
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)
        if limit is not None:
            bound = np.minimum(bound, limit[mine])
        at = np.sort(np.concatenate([leaves[i] for i in np.union1d(first, np.flatnonzero(gap <= bound.max() * (1 + 1e-9) + 1e-12))]))
        step = max(1, 4_000_000 // len(at))
        for s in range(0, len(x), step):
            d = _metric(x[s : s + step], p[at])
            if not self_too:
                d[own[s : s + step, None] == pid[at][None, :]] = np.inf
            m = min(k, len(at))
            if m < len(at):
                # Everything up to the k-th distance, so that ties are settled by id.
                kth = np.partition(d, m - 1, axis=1)[:, m - 1]
                d = np.where(d <= kth[:, None], d, np.inf)
            best = np.argsort(d, axis=1, kind="stable")[:, :m]
            got = np.take_along_axis(d, best, axis=1)
            dist[mine[s : s + step], :m] = got
            ids[mine[s : s + step], :m] = np.where(np.isfinite(got), pid[at][best], -1)
    return dist, ids


class Cells:
    """Two levels of pivots; a point belongs to the nearest fine pivot of its nearest coarse one."""

    def __init__(self, pts: np.ndarray, cells: int):
        pts = np.unique(pts, axis=0)
        pts = pts[np.random.default_rng(11).permutation(len(pts))[: max(1, cells)]]
        self.coarse = pts[: max(1, math.isqrt(len(pts)))]
        owner = self._nearest(pts, self.coarse)
        order = np.argsort(owner, kind="stable")
        self.fine = pts[order]
        self.start = np.searchsorted(owner[order], np.arange(len(self.coarse) + 1))

    @staticmethod
    def _nearest(p: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        out = np.empty(len(p), np.int64)
        step = max(1, 2_000_000 // len(pivots))
        half = (pivots * pivots).sum(axis=1) / 2
        for s in range(0, len(p), step):
            out[s : s + step] = np.argmin(half - p[s : s + step] @ pivots.T, axis=1)
        return out

    def place(self, p: np.ndarray) -> np.ndarray:
        group = self._nearest(p, self.coarse)
        cell = np.empty(len(p), np.int32)
        for g in np.unique(group):
            m = np.flatnonzero(group == g)
            cell[m] = self.start[g] + self._nearest(p[m], self.fine[self.start[g] : self.start[g + 1]])
        return cell


class Reach:
    """The boxes of the cells' points, and of the cells of each coarse pivot: which cells can hold a point nearer than a bound."""

    def __init__(self, cells: Cells, at: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray):
        self.at, self.low, self.high, self.count = at, low, high, count
        group = np.searchsorted(cells.start, at, side="right") - 1
        self.groups = [np.flatnonzero(group == g) for g in np.unique(group)]
        self.glow, self.ghigh = (np.array([f(b[m], axis=0) for m in self.groups]) for f, b in ((np.min, low), (np.max, high)))

    def ask(self, p: np.ndarray, bound: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the point, place of the cell) of every cell no farther than the point's bound.

        A point without a bound takes the distance within which whole cells surely hold ``need`` points.
        """
        bound = bound.copy()
        for i in np.flatnonzero(~np.isfinite(bound)):
            far = np.sqrt((np.maximum(np.abs(p[i] - self.low), np.abs(p[i] - self.high)) ** 2).sum(axis=1))
            o = np.argsort(far)
            bound[i] = far[o][np.searchsorted(np.cumsum(self.count[o]), need)]
        bound = bound * (1 + 1e-9) + 1e-12
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, 2_000_000 // len(self.groups))
        for s in range(0, len(p), step):
            part = p[s : s + step]
            i, g = np.nonzero(_apart(part, part, self.glow, self.ghigh) <= bound[s : s + step, None])
            for one in np.unique(g):
                m, own = i[g == one], self.groups[one]
                for r in range(0, len(m), max(1, 2_000_000 // len(own))):
                    mm = m[r : r + max(1, 2_000_000 // len(own))]
                    a, b = np.nonzero(_apart(part[mm], part[mm], self.low[own], self.high[own]) <= bound[s + mm][:, None])
                    rows.append(s + mm[a])
                    cols.append(own[b])
        return np.concatenate(rows), np.concatenate(cols)


def nearest(points: DataFrame, k: int, *, self_too: bool = False, per_cell: int = 4000, block: int = 24_000) -> DataFrame:
    """(i, j, distance, rank): the k nearest other points of each, by (distance, id), rank from 1.

    ``points`` is (id, a, b, c) with unique ids. With ``self_too`` a point is its own neighbour at
    distance 0. Points without a coordinate take no part. There must be more than k points.
    """
    points = cut(points.dropna())
    n = points.count()
    if not 1 <= k <= n - (not self_too):
        raise EngineError(f"{k} neighbours were asked for; of {n} points there can be 1 to {n - (not self_too)}.")
    want = max(1, math.ceil(n / per_cell))
    # A fixed number of points for each pivot; they steer only how evenly the work is spread.
    drawn = points.where(hashed_share(F.col("id"), max(4.0 * want, 256.0) / n)).select("a", "b", "c").toPandas().to_numpy(float)
    if not len(drawn):
        drawn = points.limit(1).select("a", "b", "c").toPandas().to_numpy(float)
    cells = Cells(drawn, want)
    place_of = "id long, a double, b double, c double, cell int"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=cells.place(b[["a", "b", "c"]].to_numpy(float)))

    placed = cut(points.mapInPandas(place, place_of))
    # One row per pivot: counts and boxes.
    known = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{o}{c}") for c in "abc" for o, f in (("l", F.min), ("h", F.max))]).toPandas().sort_values("cell")
    at, count = known["cell"].to_numpy(), known["n"].to_numpy()
    reach = Reach(cells, at, known[["la", "lb", "lc"]].to_numpy(), known[["ha", "hb", "hc"]].to_numpy(), count)
    parts = np.ceil(count / block).astype(np.int64)
    split = {int(c): int(m) for c, m in zip(at, parts) if m > 1}
    placed = placed.withColumn("part", F.lit(0))
    if split:
        of = F.element_at(F.create_map(*[F.lit(x) for cm in split.items() for x in cm]), F.col("cell")) if len(split) <= 1000 else None
        if of is None:
            table = points.sparkSession.createDataFrame(list(split.items()), "cell int, parts int")
            placed = placed.join(table, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).select("id", "a", "b", "c", "cell", "part")
        else:
            placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce(of, F.lit(1))).cast("int"))
    need = k + (not self_too)

    def own(b: pd.DataFrame) -> pd.DataFrame:
        p, ids = b[["a", "b", "c"]].to_numpy(float), b["id"].to_numpy()
        dist, found = _near(p, ids, p, ids, k, self_too)
        bound = dist[:, k - 1]
        i, c = reach.ask(p, bound, need)
        # Its own part of its own cell has answered already.
        times = parts[c]
        i, c = np.repeat(i, times), np.repeat(c, times)
        part = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        other = (at[c] != b["cell"].iloc[0]) | (part != b["part"].iloc[0])
        i, c, part = i[other], c[other], part[other]
        o = np.argsort(i, kind="stable")
        ends = np.searchsorted(i[o], np.arange(len(p) + 1))
        code = (at[c][o].astype(np.int64) << 32) + part[o]
        return b[["id", "a", "b", "c"]].assign(
            bound=bound, found=list(found), away=list(dist), asks=[code[s:e] for s, e in zip(ends, ends[1:])]
        )

    answered = placed.groupBy("cell", "part").applyInPandas(own, "id long, a double, b double, c double, bound double, found array<long>, away array<double>, asks array<long>")
    answered = cut(answered)
    near = F.posexplode(F.arrays_zip("found", "away")).alias("at", "n")
    done = answered.select(F.col("id").alias("i"), F.size("asks").alias("asked"), near).select(
        "i", "asked", F.col("n.found").alias("j"), F.col("n.away").alias("distance"), (F.col("at") + 1).alias("rank")
    )
    done = done.where(F.col("distance") < float("inf"))
    asks = answered.select("id", "a", "b", "c", "bound", F.explode("asks").alias("code"))
    if asks.isEmpty():
        return done.select("i", "j", "distance", "rank")
    asks = asks.select("id", "a", "b", "c", F.shiftright("code", 32).cast("int").alias("cell"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("part"), "bound")
    both = asks.unionByName(placed.select("id", "a", "b", "c", "cell", "part", F.lit(None).cast("double").alias("bound")))

    def search(b: pd.DataFrame) -> pd.DataFrame:
        limit = b["bound"].to_numpy()
        asking = ~np.isnan(limit)
        xyz, ids = b[["a", "b", "c"]].to_numpy(float), b["id"].to_numpy()
        dist, found = _near(xyz[asking], ids[asking], xyz[~asking], ids[~asking], k, self_too, limit[asking])
        ok = dist <= limit[asking][:, None]
        ok &= np.isfinite(dist)
        return pd.DataFrame({"i": np.repeat(ids[asking], k).reshape(-1, k)[ok], "j": found[ok], "distance": dist[ok]})

    others = both.groupBy("cell", "part").applyInPandas(search, "i long, j long, distance double")
    mixed = done.where("asked > 0").select("i", "j", "distance").unionAll(others)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    mixed = mixed.withColumn("rank", rank).where(F.col("rank") <= k)
    return done.where("asked = 0").select("i", "j", "distance", "rank").unionAll(mixed)


def row_standardised(edges: DataFrame) -> DataFrame:
    """(i, j, w) with the weights of each i summing to 1."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.select("i", "j", (w / F.sum(w).over(Window.partitionBy("i"))).alias("w"))


def knn_weights(points: DataFrame, k: int) -> DataFrame:
    """Row-standardised k-nearest-neighbour weights; each is 1/k."""
    return nearest(points, k).select("i", "j", F.lit(1.0 / k).alias("w"))


def lag(edges: DataFrame, values: DataFrame, columns: Sequence[str], prefix: str = "lag_") -> DataFrame:
    """(id, lag_<column>..): the weighted sums of the neighbours' values."""
    d = edges.join(values.withColumnRenamed("id", "j"), "j")
    return d.groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * quoted(c)).alias(f"{prefix}{c}") for c in columns])


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component): connected components of the undirected graph, named by their smallest id.

    Alternating large-star and small-star steps: the longest path halves each time, so that a few
    rounds do whatever the size; each round is cut from its lineage.
    """
    e = cut(edges.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        # Done when every node points at a root: no root points on.
        if new.select("v").join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            break
        e = new
    return ids.select("id").join(new.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def component_count(edges: DataFrame, ids: DataFrame) -> int:
    return components(edges, ids).agg(F.count_distinct("component")).first()[0]


def duplicate_coordinates(df: DataFrame, x: str, y: str) -> DataFrame:
    """(distinct_positions, rows_at_shared_positions) of complete coordinates."""
    g = df.select(quoted(x).alias("x"), quoted(y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("distinct_positions"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_at_shared_positions"))
