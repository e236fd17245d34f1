import datetime as dt
import math

from pyspark.sql import functions as F

from tabulon.operators.impute import fill_missing, fit_prototypes
from tabulon.runtime import quantiles

SCHEMA = "id long, age double, score double, city string, site long, day date, num int"
D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)


def fill(df, **options):
    city = F.col("city")
    return fill_missing(
        df,
        "id",
        numeric={"age": F.when(F.col("age").between(0, 120), F.col("age")), "score": F.when(F.col("score").between(0, 100), F.col("score"))},
        categorical={"city": F.when(F.length(F.trim(city)) > 0, city)},
        groups=[("site", F.col("site")), ("day", F.col("day"))],
        **options,
    )


def test_site_then_day_then_nothing(rows, tuples):
    t = rows(
        [
            (1, 20.0, 50.0, "a", 1, D1, 0),
            (2, None, 60.0, "a", 1, D1, 0),
            (3, math.nan, None, " ", 2, D1, 0),
            (4, 999.0, -1.0, "b", None, D2, 0),
            (5, None, None, None, 3, None, 0),
            (6, 30.0, None, "b", 2, D1, 0),
        ],
        SCHEMA,
    )
    got = {(r["id"], r["column_name"]): (r["filled_from"], r["number_value"], r["text_value"]) for r in fill(t).collect()}
    assert got[2, "age"] == ("site", 20.0, None)
    assert got[3, "age"] == ("site", 30.0, None)
    assert got[3, "city"] == ("site", None, "b")
    assert got[3, "score"][0] == got[6, "score"][0] == "day"
    assert set(got) == {(2, "age"), (3, "age"), (3, "score"), (3, "city"), (6, "score")}


def test_similar_rows_come_first(rows):
    # Two kinds of people on one site: the young score low, the old high.
    data = [(i, 20.0 + i % 3, 10.0 + i % 2, "x", 1, D1, 0) for i in range(40)] + [(100 + i, 80.0 + i % 3, 90.0 + i % 2, "y", 1, D1, 0) for i in range(30)]
    data += [(200, 21.0, None, "x", 1, D1, 0), (201, 81.0, None, "y", 1, D1, 0)]
    got = {r["id"]: r for r in fill(rows(data, SCHEMA), clusters=2).collect()}
    assert got[200]["method"] == got[201]["method"] == "cluster"
    assert got[200]["number_value"] < 12 and got[201]["number_value"] > 89


def test_ties_take_the_first_category(rows):
    t = rows([(1, 1.0, 1.0, "b", 1, D1, 0), (2, 1.0, 1.0, "a", 1, D1, 0), (3, 1.0, 1.0, None, 1, D1, 0)], SCHEMA)
    assert [r["text_value"] for r in fill(t, clusters=1).collect()] == ["a"]


def test_empty_and_all_missing(rows):
    assert fill(rows([], SCHEMA)).count() == 0
    assert fill(rows([(1, None, None, None, None, None, 1)], SCHEMA)).count() == 0


def test_prototypes_of_nothing(rows):
    p = fit_prototypes(rows([], "a double, c string"), ["a"], ["c"], clusters=2)
    assert rows([(1.0, "x")], "a double, c string").select(p.cluster().alias("k")).first()["k"] == 0


def test_quantiles_from_frequencies(rows, tuples):
    import numpy as np

    v = [1.0, 1.0, 1.0, 2.0, 7.0, 7.0, 10.0]
    t = rows([("g", 1.0, 3), ("g", 2.0, 1), ("g", 7.0, 2), ("g", 10.0, 1), ("h", 4.0, 5)], "k string, v double, n long")
    got = {r["k"]: r for r in quantiles(t, ["k"], "v", "n", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    assert [got["g"][x] for x in "abc"] == np.percentile(v, [25, 50, 75]).tolist()
    assert got["h"]["b"] == 4.0


def test_features_of_any_name(rows):
    t = rows([(1, 2.0, "x", 1), (2, None, None, 1)], "id long, _k double, feature string, g int")
    got = fill_missing(t, "id", numeric={"id": F.col("_k"), "_k": F.col("_k")}, categorical={"feature": F.col("feature")}, groups=[("g", F.col("g"))], clusters=1)
    assert sorted((r["column_name"], r["number_value"], r["text_value"]) for r in got.collect()) == [("_k", 2.0, None), ("feature", None, "x"), ("id", 2.0, None)]
