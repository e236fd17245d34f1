import random

import pytest

from tabulon.errors import EngineError
from tabulon.llm.mixing import mix, plan_mix, schedule

TARGETS = "source string, target_share double, max_repeats int"


def documents(rows, seed=2):
    rng = random.Random(seed)
    data = [(i, s, rng.randint(0, 60), "x") for s, n in (("a", 1500), ("b", 300), ("c", 90)) for i in range(n)]
    data = [(k, s, n, x) for k, (_, s, n, x) in enumerate(data)] + [(90_001, None, 5, "x"), (90_002, "z", 5, "x"), (90_003, "a", None, "x")]
    return rows(data, "id long, source string, tokens long, block string")


def test_shares_are_met_and_repeats_kept(rows):
    targets = rows([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 4)], TARGETS)
    used, shares = mix(documents(rows), "id", "source", "tokens", targets)
    for r in shares.collect():
        assert abs(r["reached_share"] - r["target_share"]) < 0.01
        assert r["most_uses"] <= r["max_repeats"]
    got = {r["id"]: r for r in used.collect()}
    assert len(got) == 1893 and got[90_001]["uses"] == got[90_002]["uses"] == 0 and got[90_001]["source"] is None
    c = [r["uses"] for r in got.values() if r["source"] == "c"]
    assert max(c) == 4 and max(c) - min(c) <= 1


def test_every_stretch_has_the_shares(rows, spark):
    targets = rows([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 4)], TARGETS)
    m = plan_mix(documents(rows), "source", "tokens", targets, slots=3000)
    s = [r["source"] for r in schedule(spark, m).orderBy("slot").collect()]
    for k in range(0, 2900, 100):
        part = s[k : k + 100]
        assert abs(part.count("a") - 50) <= 3 and abs(part.count("b") - 30) <= 3


def test_errors(rows):
    d = documents(rows)
    for bad in ([], [("a", 0.0, 1)], [("nowhere", 1.0, 1)]):
        with pytest.raises(EngineError):
            plan_mix(d, "source", "tokens", rows(bad, TARGETS))
    with pytest.raises(EngineError):
        plan_mix(d.limit(0), "source", "tokens", rows([("a", 1.0, 1)], TARGETS))


def test_one_document_larger_than_a_slot(rows):
    t = rows([(1, "a", 1_000_000), (2, "a", 1), (3, "a", 1)], "id long, source string, tokens long")
    used, shares = mix(t, "id", "source", "tokens", rows([("a", 1.0, 2)], TARGETS), slots=100)
    assert {r["uses"] for r in used.collect()} == {2}
    assert shares.first()["reached_share"] == 1.0
