import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.errors import EngineError
from tabulon.llm.packing import fill_containers, plan


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_holds_every_item_once(histogram):
    patterns = plan(histogram, 60)
    got = {}
    for n, contents in patterns:
        assert n > 0 and sum(s * k for s, k in contents) <= 60
        assert sum(k for s, k in contents if 3 * s > 60) <= 2
        for s, k in contents:
            got[s] = got.get(s, 0) + n * k
    assert got == histogram


def test_plan_is_close_to_the_least():
    rng = random.Random(4)
    for _ in range(20):
        h = {rng.randint(1, 128): rng.randint(1, 200) for _ in range(60)}
        used, total = sum(n for n, _ in plan(h, 128)), sum(s * n for s, n in h.items())
        big = sum(n for s, n in h.items() if 2 * s > 128)
        assert used <= 1.1 * max(-(-total // 128), big) + 1


def test_plan_with_one_size_and_errors():
    assert plan({50: 7}, 100) == [(3, [(50, 2)]), (1, [(50, 1)])] or sum(n for n, _ in plan({50: 7}, 100)) == 4
    assert plan({}, 10) == []
    with pytest.raises(EngineError):
        plan({11: 1}, 10)


def test_containers(rows):
    data = [(1, 25, 0), (2, 10, 0), (3, 0, 0), (4, None, 0), (5, 3, 0), (6, 3, 0), (6, 3, 0), (7, 0, 0), (8, 7, 0)] + [(100 + i, 6, 0) for i in range(40)]
    t = rows(data, "id long, tokens long, piece int")
    got = fill_containers(t, "id", "tokens", 10).collect()
    cells = {(r["container"], r["position"]) for r in got}
    assert len(cells) == len(got)
    assert sorted((r["piece"], r["start"], r["size"]) for r in got if r["id"] == 1) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert sorted(r["position"] for r in got if r["container"] == 0) == [1, 2]
    assert not [r for r in got if r["id"] == 4]
    by = {}
    for r in got:
        by.setdefault(r["container"], []).append(r)
    for c, items in by.items():
        assert sorted(r["position"] for r in items) == list(range(1, len(items) + 1))
        assert {r["room"] for r in items} == {10 - sum(r["size"] for r in items)}
    assert sum(r["size"] for r in got) == sum(v or 0 for _, v, _ in data)


def test_empty(rows):
    assert fill_containers(rows([], "id long, tokens long"), "id", "tokens", 10).count() == 0
    with pytest.raises(EngineError):
        fill_containers(rows([], "id long, tokens long"), "id", "tokens", 0)
