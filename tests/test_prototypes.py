import math

import pytest

from tabulon.operators.impute import fit_prototypes


def test_prototypes_move_until_they_rest(rows):
    # Unequal spacing: the borders between prototypes creep on for more than four rounds.
    data = [math.exp(i / 12) for i in range(80)]
    df = rows([(v, "a") for v in data], "x double, c string")
    m = fit_prototypes(df, ["x"], ["c"])
    assert m.converged
    centres = sorted(p["x"] for p in m.rows)
    near = [min(centres, key=lambda c, v=v: abs(c - v)) for v in data]
    for c in set(near):  # each is the mean of the rows nearest to it
        own = [v for v, k in zip(data, near) if k == c]
        assert c == pytest.approx(sum(own) / len(own))
    with pytest.warns(UserWarning, match="still moved"):
        assert not fit_prototypes(df, ["x"], ["c"], rounds=2).converged
