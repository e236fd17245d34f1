"""Points near other points, and the region that contains a point.

Space is cut by a two-level Voronoi partition around pivots drawn from the points. A point belongs
to the cell of its nearest pivot and is replicated to every cell that may hold a point within the
radius: by the triangle inequality, a point q of cell j with d(p, q) <= r has
d(p, j) <= d(p, i) + 2 r, where i is the nearest pivot of p. The same bound holds again for the fine
pivots inside a coarse cell, so that every point is compared with about 2 sqrt(K) of K pivots.
Inside a cell a vantage-point tree answers the radius search with the exact great-circle metric.

Cells are bounded: a cell with more than ``block`` points is joined block by block, so that no task
ever holds more than two blocks, however many points share a place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.functions.sphere import EARTH_M, haversine, unit
from tabulon.runtime import cut, hashed_share, quoted

#: Metres by which bounds are widened for rounding; it never changes a result.
SLACK_M = 1.0
#: Vertices of regions sent to the tasks at once; more regions are handled in several passes.
REGION_VERTICES = 500_000


def valid_points(df: DataFrame, id_column: str, lon: str, lat: str) -> DataFrame:
    """(id, lon, lat) of the rows whose coordinates are numbers within their ranges."""
    x, y = quoted(lon).cast("double"), quoted(lat).cast("double")
    return df.where(x.between(-180.0, 180.0) & y.between(-90.0, 90.0)).select(
        quoted(id_column).cast("long").alias("id"), x.alias("lon"), y.alias("lat")
    )


class Pivots:
    """Two levels of pivots: coarse ones, and for each of them its fine ones."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, cells: int):
        pts = np.unique(np.stack((lon, lat), axis=1), axis=0)
        rng = np.random.default_rng(7)
        pts = pts[rng.permutation(len(pts))[: max(1, cells)]]
        xyz = unit(pts[:, 0], pts[:, 1])
        n = max(1, math.isqrt(len(xyz)))
        self.coarse = xyz[:n]
        owner = np.concatenate([np.argmax(xyz[k : k + 4096] @ self.coarse.T, axis=1) for k in range(0, len(xyz), 4096)])
        order = np.argsort(owner, kind="stable")
        self.fine = xyz[order]
        self.start = np.searchsorted(owner[order], np.arange(n + 1))

    def __len__(self) -> int:
        return len(self.fine)

    def assign(self, xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, cell, is it the point's own cell) for a radius in radians."""
        idx, cell, home = [], [], []
        own, near = _within(xyz, self.coarse, radius)
        rows, cols = np.nonzero(near)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        bounds = np.searchsorted(cols, np.arange(len(self.coarse) + 1))
        for c in np.unique(cols):
            r = rows[bounds[c] : bounds[c + 1]]
            best, close = _within(xyz[r], self.fine[self.start[c] : self.start[c + 1]], radius)
            i, j = np.nonzero(close)
            idx.append(r[i])
            cell.append(j + self.start[c])
            home.append((best[i] == j) & (own[r[i]] == c))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return cat(idx, np.int64), cat(cell, np.int32), cat(home, bool)


def _within(xyz: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each point, and the pivots at most 2 radii farther than that."""
    dots = xyz @ pivots.T
    best = np.argmax(dots, axis=1)
    nearest = np.arccos(np.clip(dots[np.arange(len(xyz)), best], -1.0, 1.0))
    least = np.cos(np.minimum(nearest + 2.0 * radius + SLACK_M / EARTH_M, math.pi)) - 1e-15
    near = dots >= least[:, None]
    near[np.arange(len(xyz)), best] = True
    return best, near


class VantageTree:
    """Vantage-point tree over points in radians; ``search`` takes all queries through it at once."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, radius_m: float = EARTH_M, leaf: int = 48):
        self.lon, self.lat, self.sphere = lon, lat, radius_m
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(lon)), leaf) if len(lon) else -1

    def _build(self, members: np.ndarray, leaf: int) -> int:
        # Depth first with an explicit stack, so that many equal points cannot exhaust Python's.
        nodes, stack, root = self.nodes, [(members, -1, 0)], 0
        while stack:
            m, parent, side = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            if len(m) <= leaf:
                nodes.append([None, m, 0.0, -1, -1])
                continue
            vp = m[len(m) // 2]
            d = haversine(self.lon[vp], self.lat[vp], self.lon[m], self.lat[m], self.sphere)
            mu = float(np.median(d))
            inside = d <= mu
            if inside.all():  # more than half at one distance
                inside = d < mu
                if not inside.any():
                    nodes.append([None, m, 0.0, -1, -1])
                    continue
                mu = float(d[inside].max())
            nodes.append([vp, None, mu, -1, -1])
            stack += [(m[inside], at, 3), (m[~inside], at, 4)]
        return root

    def search(self, qlon: np.ndarray, qlat: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, point) indices at most ``r`` metres apart."""
        if self.root < 0 or not len(qlon):
            return
        stack = [(self.root, np.arange(len(qlon)))]
        while stack:
            at, q = stack.pop()
            vp, members, mu, inner, outer = self.nodes[at]
            if members is not None:
                step = max(1, 2_000_000 // len(members))
                for k in range(0, len(q), step):
                    part = q[k : k + step]
                    d = haversine(qlon[part][:, None], qlat[part][:, None], self.lon[members], self.lat[members], self.sphere)
                    i, j = np.nonzero(d <= r)
                    if len(i):
                        yield part[i], members[j]
                continue
            d = haversine(qlon[q], qlat[q], self.lon[vp], self.lat[vp], self.sphere)
            for child, keep in ((inner, d <= mu + r + 1e-6), (outer, d >= mu - r - 1e-6)):
                if keep.any():
                    stack.append((child, q[keep]))


def draw_pivots(points: DataFrame, per_cell: int, most: int = 65_536) -> Pivots | None:
    """Pivots drawn from the points, one for about ``per_cell`` of them, at most ``most``.

    The draw only steers how evenly the work is spread; results do not depend on it.
    """
    n = points.count()
    if not n:
        return None
    cells = max(1, min(most, math.ceil(n / per_cell)))
    share = min(1.0, 4.0 * max(cells, 64) / n)
    drawn = points.where(hashed_share(F.col("id"), share)).select("lon", "lat").toPandas()
    if drawn.empty:
        drawn = points.select("lon", "lat").limit(1).toPandas()
    return Pivots(drawn["lon"].to_numpy(), drawn["lat"].to_numpy(), cells)


def near_pairs(
    df: DataFrame, id_column: str, lon: str, lat: str, radius_m: float, *, per_cell: int = 3000, block: int = 40_000, pivots: Pivots | None = None
) -> DataFrame:
    """All pairs (id_a, id_b, distance_m) of points at most ``radius_m`` metres apart, id_a < id_b.

    Rows with coordinates that are null, NaN or out of range take no part; equal points are at
    distance 0; an id that occurs twice is not paired with itself; an empty table gives no pairs.
    Other columns of ``df`` are not read.
    """
    if radius_m < 0:
        raise EngineError("The radius must not be negative.")
    points = valid_points(df, id_column, lon, lat)
    pivots = pivots or draw_pivots(points, per_cell)
    out = "id_a long, id_b long, distance_m double"
    if pivots is None:
        return df.sparkSession.createDataFrame([], out)
    rad = radius_m / EARTH_M

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            i, cell, home = pivots.assign(unit(x, y), rad)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(home), pa.array(ids[i]), pa.array(x[i]), pa.array(y[i])], ["cell", "home", "id", "lon", "lat"]
            )

    placed = cut(points.mapInArrow(assign, "cell int, home boolean, id long, lon double, lat double"))
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = crowded.select("cell", F.ceil(F.col("n") / (block / 2)).cast("int").alias("parts"))
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= 10_000 else crowded
        placed = placed.join(crowded, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        placed = placed.withColumn("parts", F.lit(1))
    # In a crowded cell, block a of the points to search meets block b of the queries in group (a, b).
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    roles = F.when(
        F.col("parts") == 1,
        F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("home").alias("held"), F.lit(True).alias("asks"))),
    ).otherwise(
        F.concat(
            F.transform(other, lambda a: F.struct(a.alias("a"), mine.alias("b"), F.lit(False).alias("held"), F.lit(True).alias("asks"))),
            F.when(
                F.col("home"),
                F.transform(other, lambda b: F.struct(mine.alias("a"), b.alias("b"), F.lit(True).alias("held"), F.lit(False).alias("asks"))),
            ).otherwise(F.array()),
        )
    )
    grouped = placed.select("cell", "id", "lon", "lat", F.explode(roles).alias("r")).select("cell", "r.*", "id", "lon", "lat")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        x, y = np.radians(pdf["lon"].to_numpy()), np.radians(pdf["lat"].to_numpy())
        held, asks = np.flatnonzero(pdf["held"].to_numpy()), np.flatnonzero(pdf["asks"].to_numpy())
        tree = VantageTree(x[held], y[held])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, p in tree.search(x[asks], y[asks], radius_m):
            i, j = held[p], asks[q]
            keep = ids[i] < ids[j]
            left.append(i[keep])
            right.append(j[keep])
        i, j = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"id_a": ids[i], "id_b": ids[j], "distance_m": haversine(x[i], y[i], x[j], y[j])})

    return grouped.groupBy("cell", "a", "b").applyInPandas(search, out)


class Regions:
    """Outlines with holes; edges are straight in degrees, longitudes may run past the 180th meridian."""

    def __init__(self, outline: pd.DataFrame):
        self.ids, self.edges, self.boxes, centres, reach = [], [], [], [], []
        for rid, g in outline.sort_values(["region_id", "ring_no", "vertex_no"]).groupby("region_id"):
            parts = []
            for _, ring in g.groupby("ring_no"):
                v = ring[["longitude", "latitude"]].to_numpy(float)
                w = np.roll(v, -1, axis=0)
                parts.append(np.concatenate((v, w), axis=1)[~np.all(v == w, axis=1)])
            e = np.concatenate(parts)
            if not len(e):
                continue
            box = (e[:, 0].min(), e[:, 0].max(), e[:, 1].min(), e[:, 1].max())
            # A cap around the box's middle that covers the box: no point of it is farther than its border.
            t = np.linspace(0.0, 1.0, 33)
            bx = np.concatenate([box[0] + (box[1] - box[0]) * t] * 2 + [np.full(33, box[0]), np.full(33, box[1])])
            by = np.concatenate([np.full(33, box[2]), np.full(33, box[3])] + [box[2] + (box[3] - box[2]) * t] * 2)
            c = unit(np.array([(box[0] + box[1]) / 2]), np.array([(box[2] + box[3]) / 2]))[0]
            step = math.radians(max(box[1] - box[0], box[3] - box[2]) / 32)
            self.ids.append(int(rid))
            self.edges.append(e)
            self.boxes.append(box)
            centres.append(c)
            reach.append(min(math.pi, float(np.arccos(np.clip(unit(bx, by) @ c, -1, 1)).max()) + step) if box[1] - box[0] < 180 else math.pi)
        self.centres, self.reach = np.array(centres).reshape(-1, 3), np.array(reach)

    def contains(self, k: int, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Even-odd rule over all rings of region ``k``, so that points in holes are outside."""
        x0, x1, y0, y1 = self.boxes[k]
        found = np.zeros(len(lon), bool)
        for turn in (-360.0, 0.0, 360.0):
            x = lon + turn
            at = np.flatnonzero((x >= x0) & (x <= x1) & (lat >= y0) & (lat <= y1))
            for s in range(0, len(at), 8192):
                i = at[s : s + 8192]
                px, py = x[i][:, None], lat[i][:, None]
                ax, ay, bx, by = self.edges[k].T
                cross = (ay > py) != (by > py)
                with np.errstate(divide="ignore", invalid="ignore"):
                    left = px < (bx - ax) * (py - ay) / (by - ay) + ax
                found[i] |= (np.count_nonzero(cross & left, axis=1) % 2).astype(bool)
        return found


def containing_regions(
    df: DataFrame, outline: DataFrame, id_column: str, lon: str, lat: str, *, per_cell: int = 3000, pivots: Pivots | None = None
) -> DataFrame:
    """(region_id, id) for every point and every region that it lies in.

    The points' Voronoi cells prune the regions: a region whose cap is farther from a pivot than the
    cell reaches cannot hold any of the cell's points (triangle inequality); what remains is tested
    exactly. Regions go to the tasks in passes of at most ``REGION_VERTICES`` corners each.
    Unusable coordinates and empty tables give no rows.
    """
    points = valid_points(df, id_column, lon, lat)
    pivots = pivots or draw_pivots(points, per_cell)
    out = "region_id long, id long"
    if pivots is None:
        return df.sparkSession.createDataFrame([], out)
    corners = outline.select("region_id", "ring_no", "vertex_no", "longitude", "latitude").dropna()
    passes: list[list[int]] = [[]]
    room = REGION_VERTICES
    for row in corners.groupBy("region_id").count().orderBy("region_id").toLocalIterator():
        if row["count"] > room and passes[-1]:
            passes.append([])
            room = REGION_VERTICES
        passes[-1].append(row["region_id"])
        room -= row["count"]

    def locate(regions: Regions):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                xyz = unit(x, y)
                dots = xyz @ pivots.coarse.T
                cell = np.argmax(dots, axis=1)
                dist = np.arccos(np.clip(dots[np.arange(len(cell)), cell], -1.0, 1.0))
                rid, pid = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for c in np.unique(cell):
                    m = np.flatnonzero(cell == c)
                    away = np.arccos(np.clip(regions.centres @ pivots.coarse[c], -1.0, 1.0))
                    for k in np.flatnonzero(away <= regions.reach + dist[m].max() + 1e-6):
                        hit = m[regions.contains(k, x[m], y[m])]
                        rid.append(np.full(len(hit), regions.ids[k], np.int64))
                        pid.append(ids[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid)), pa.array(np.concatenate(pid))], ["region_id", "id"])

        return run

    result = None
    for wanted in passes:
        regions = Regions(corners.where(F.col("region_id").isin(wanted)).toPandas())
        if not regions.ids:
            continue
        part = points.mapInArrow(locate(regions), out)
        result = part if result is None else result.unionAll(part)
    return df.sparkSession.createDataFrame([], out) if result is None else result
