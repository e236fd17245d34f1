import math

import numpy as np
import pytest

from tabulon.errors import EngineError
from tabulon.functions.sphere import haversine
from tabulon.operators.nearby import VantageTree, containing_regions, near_pairs

POINTS = "id long, lon double, lat double, area int"


def brute(data, radius):
    out = set()
    for i, (a, x, y, *_) in enumerate(data):
        for b, u, v, *_ in data:
            if a < b and haversine(*np.radians([x, y, u, v])) <= radius:
                out.add((a, b))
    return out


def cluster(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.array([[179.9999, 10], [-179.9999, 10.0001], [0, 89.9999], [90, 89.9998], [12.5, -45]])
    at = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 3e-4, (n, 2))
    at[:, 0] = (at[:, 0] + 180) % 360 - 180
    at[:, 1] = np.clip(at[:, 1], -90, 90)
    return [(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(at)]


@pytest.mark.parametrize("per_cell,block", [(3000, 40_000), (20, 15), (400, 7)])
def test_pairs_match_brute_force(rows, tuples, per_cell, block):
    data = cluster(300, 3) + [(1000, 12.5, -45.0, 0), (1001, 12.5, -45.0, 0), (1002, 12.5, -45.0, 1)]
    got = near_pairs(rows(data, POINTS), "id", "lon", "lat", 25.0, per_cell=per_cell, block=block)
    pairs = [tuple(r) for r in tuples(got, "id_a", "id_b")]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(data, 25.0)
    assert all(0 <= r["distance_m"] <= 25.0 for r in got.collect())


def test_unusable_points_and_empty_tables(rows, tuples):
    bad = [(1, None, 1.0, 0), (2, 1.0, None, 0), (3, math.nan, 1.0, 0), (4, 181.0, 1.0, 0), (5, 1.0, 90.5, 0), (6, 1.0, math.inf, 0), (7, 1.0, 1.0, None), (8, 1.0, 1.0, 1)]
    assert tuples(near_pairs(rows(bad, POINTS), "id", "lon", "lat", 10.0), "id_a", "id_b") == [(7, 8)]
    assert near_pairs(rows([], POINTS), "id", "lon", "lat", 10.0).count() == 0
    with pytest.raises(EngineError):
        near_pairs(rows(bad, POINTS), "id", "lon", "lat", -1.0)


def test_extra_columns_with_clashing_names(rows, tuples):
    t = rows([(1, 2.0, 2.0, 5, True), (2, 2.0, 2.0, 6, False)], "id long, lon double, lat double, cell int, home boolean")
    assert tuples(near_pairs(t, "id", "lon", "lat", 1.0), "id_a", "id_b") == [(1, 2)]


def test_meridian_and_poles(rows, tuples):
    t = rows([(1, 180.0, 0.0, 0), (2, -180.0, 0.0, 0), (3, 0.0, 90.0, 0), (4, 123.0, 90.0, 0)], POINTS)
    assert tuples(near_pairs(t, "id", "lon", "lat", 0.01), "id_a", "id_b") == [(1, 2), (3, 4)]


def test_tree_of_equal_points():
    x = np.zeros(500)
    tree = VantageTree(x, x)
    assert sum(len(q) for q, _ in tree.search(x[:3], x[:3], 1.0)) == 1500


def outline(rows):
    ring = lambda r, k, pts: [(r, k, i + 1, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    square = [(170, -10), (190, -10), (190, 10), (170, 10)]
    hole = [(178, -2), (182, -2), (182, 2), (178, 2), (178, -2)]  # closed explicitly
    return rows(ring(1, 0, square) + ring(1, 1, hole) + ring(2, 0, [(0, 0), (5, 0), (0, 5)]), "region_id long, ring_no int, vertex_no int, longitude double, latitude double")


def test_regions_holes_and_the_turn(rows, tuples):
    data = [(1, 175.0, 0.0, 0), (2, -175.0, 5.0, 0), (3, 180.0, 0.0, 0), (4, -180.0, 1.0, 0), (5, 180.0, 5.0, 0), (6, 1.0, 1.0, 0), (7, 4.0, 4.0, 0), (8, 200.0, 0.0, 0), (9, None, None, 0)]
    got = containing_regions(rows(data, POINTS), outline(rows), "id", "lon", "lat", per_cell=2)
    assert tuples(got, "region_id", "id") == [(1, 1), (1, 2), (1, 5), (2, 6)]
    assert containing_regions(rows([], POINTS), outline(rows), "id", "lon", "lat").count() == 0
    assert containing_regions(rows(data, POINTS), outline(rows).limit(0), "id", "lon", "lat").count() == 0


def test_regions_in_several_passes(rows, tuples, monkeypatch):
    import tabulon.operators.nearby as nearby

    monkeypatch.setattr(nearby, "REGION_VERTICES", 4)
    got = containing_regions(rows([(1, 175.0, 0.0, 0), (6, 1.0, 1.0, 0)], POINTS), outline(rows), "id", "lon", "lat")
    assert tuples(got, "region_id", "id") == [(1, 1), (2, 6)]
