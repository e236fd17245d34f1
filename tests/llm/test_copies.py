import datetime as dt
import math

from tabulon.llm.copies import collapse, surplus

SCHEMA = "id long, name string, note string, score double, day date, copies int"
FIELDS = {"name": "text", "note": "text", "score": "exact", "day": "exact"}
D = dt.date(2020, 1, 1)


def test_spellings_and_swapped_fields(rows, tuples):
    t = rows(
        [
            (5, "Straße 1", "Ab", 1.0, D, 1),
            (2, " strasse-1! ", "A.B", 1.0, D, 1),
            (9, "ab", "STRASSE 1", 1.0, D, 1),
            (3, "strasse 1", "ab", 1.5, D, 1),
            (4, None, "x", None, None, 1),
            (6, "", "X", None, None, 1),
            (7, "x", "-", None, None, 1),
            (8, "x", None, math.nan, None, 1),
            (10, "X", "", math.nan, None, 2),
            (11, "ΟΔΟΣ", "", 0.0, D, 1),
            (12, "οδος", "", -0.0, D, 1),
            (13, "οδοσ", "", 0.0, D, 1),
        ],
        SCHEMA,
    )
    assert tuples(surplus(t, "id", FIELDS, [("name", "note")])) == sorted([(2, 5), (2, 9), (4, 6), (4, 7), (8, 10), (11, 12), (11, 13)], key=repr)
    assert tuples(collapse(t, "id", FIELDS, [("name", "note")])) == sorted([(2, 3), (3, 1), (4, 3), (8, 2), (11, 3)], key=repr)
    assert (2, 9) not in tuples(surplus(t, "id", FIELDS))


def test_empty_and_repeated_ids(rows, tuples):
    assert surplus(rows([], SCHEMA), "id", FIELDS).count() == 0
    t = rows([(1, "a", "b", None, None, 0), (1, "a", "b", None, None, 0)], SCHEMA)
    assert tuples(collapse(t, "id", FIELDS)) == [(1, 2)]


def test_long_text_and_a_hot_record(rows, tuples):
    long = "w" * 200_000
    t = rows([(i, long + "." * (i % 3), None, None, None, 0) for i in range(50)], SCHEMA)
    assert tuples(collapse(t, "id", FIELDS)) == [(0, 50)]


def test_hash_sums_stand_for_sets(rows, spark):
    from pyspark.sql import functions as F

    from tabulon.llm.copies import fingerprint

    a, b = [("f", F.lit("x")), ("f", F.lit("x")), ("g", F.lit("y"))], [("g", F.lit("y")), ("f", F.lit("x")), ("f", F.lit("x"))]
    c = [("g", F.lit("y")), ("f", F.lit("x"))]
    one = spark.range(1)
    found = [tuple(one.select(*[x.alias(f"f{i}") for i, x in enumerate(fingerprint(p))]).first()) for p in (a, b, c)]
    assert found[0] == found[1] != found[2]


def test_colliding_fingerprints_stay_apart(rows, tuples, monkeypatch):
    from pyspark.sql import functions as F

    import tabulon.llm.copies as copies

    monkeypatch.setattr(copies, "fingerprint", lambda pairs: [F.length(pairs[0][1]).cast("long")] * 4)
    t = rows([(1, "ab", "x", None, None, 0), (2, "cd", "x", None, None, 0), (3, "A-B", "x", None, None, 0), (4, "ef", "x", None, None, 0), (5, "abc", "x", None, None, 0), (6, "ABC", "x", None, None, 0)], SCHEMA)
    assert tuples(surplus(t, "id", FIELDS)) == [(1, 3), (5, 6)]
    assert tuples(collapse(t, "id", FIELDS)) == [(1, 2), (2, 1), (4, 1), (5, 2)]
