import datetime as dt
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabulon.errors import EngineError
from tabulon.functions.text import value_type_of
from tabulon.operators import clean as C
from tabulon.operators import profile as P
from tabulon.operators.numeric import coercion_report, prepare
from tabulon.operators.rows import ROW, number_rows, preview


def numbered(rows, data, schema):
    """Rows numbered in the order given."""
    return rows([(i, *r) for i, r in enumerate(data, 1)], f"{ROW} long, {schema}")


def test_quality_of_mixed_columns(rows, tuples):
    t = numbered(rows, [("Alice", "twenty"), ("Bob", "x 1"), ("Bob", "x 1"), (" ", "22")], "name string, age string")
    got = {r["column_name"]: r for r in P.column_counts(t).collect()}
    assert got["name"]["missing_count"] == 1 and got["name"]["missing_ratio"] == 0.25
    assert got["age"]["mixed_types"] and not got["name"]["mixed_types"]
    types = tuples(P.type_histogram(t).where("column_name = 'age'"), "kind", "n", "rank")
    assert types == [("number", 1, 2), ("text", 3, 1)]
    assert tuples(P.type_examples(t, 3).where("column_name = 'age' and kind = 'text'"), "example") == [("twenty",), ("x 1",), ("x 1",)]
    assert P.duplicate_count(t).first()[0] == 1
    assert [r[0] for r in P.duplicate_rows(t).orderBy("row_number").collect()] == [2, 3]
    r = P.table_rollup(t).first()
    assert (r["missing_cell_count"], r["duplicate_row_count"]) == (1, 1)
    assert P.has_issues(t).first()[0]


def test_padding_and_line_breaks(rows, tuples):
    t = numbered(rows, [(" Alice ", "hello\nworld", None), ("Bob", " ok ", 10)], "name string, note string, score int")
    assert tuples(P.flagged_rows(t)) == sorted([("name", "whitespace", 1), ("note", "line_break", 1), ("note", "whitespace", 2)], key=repr)
    assert P.table_rollup(t).first()["whitespace_cell_count"] == 2


def test_types_of_all_columns(rows):
    t = rows([(True, 1.5, dt.date(2020, 1, 1), b"x", [1], "2024-99-99")], "a boolean, b double, c date, d binary, e array<int>, f string")
    got = {r["column_name"]: r["kind"] for r in P.type_histogram(t).collect()}
    assert got == {"a": "boolean", "b": "number", "c": "datetime", "d": "text", "e": "text", "f": "datetime"}


@pytest.mark.parametrize(
    "text,kind",
    [("1", "number"), ("-.5e+3", "number"), ("5.", "number"), ("１２", "number"), (".", "text"), ("1,000", "text"), ("5%", "text"), ("inf", "text"), ("1d", "text"), ("TRUE", "boolean"),
     ("2024-1-2", "datetime"), ("2024/01/02T10:00", "datetime"), ("1-2-2024 x", "datetime"), ("2024年1月2日", "datetime"), ("2024年1月2日T", "text"), ("2024-1-2x", "text"), ("2024-1-2 a\nb", "text")],
)
def test_value_types(rows, text, kind):
    from pyspark.sql import functions as F

    from tabulon.functions.text import value_type

    assert value_type_of(text) == kind
    assert rows([(f" \t{text}　",)], "x string").select(value_type(F.col("x"), "string").alias("k")).first()["k"] == kind


@given(st.text(max_size=8))
def test_value_type_never_fails(text):
    assert value_type_of(text.strip()) in ("boolean", "number", "datetime", "text")


def test_empty_table(rows):
    t = numbered(rows, [], "a string, b double")
    assert [r["missing_ratio"] for r in P.column_counts(t).collect()] == [0.0, 0.0]
    assert P.duplicate_count(t).first()[0] == 0
    assert P.type_histogram(t).count() == P.eligible_numeric(t).count() == 0


def test_nan_and_null_repeat_themselves(rows):
    t = numbered(rows, [(math.nan, None), (math.nan, None), (0.0, "x"), (-0.0, "x"), (None, None)], "a double, b string")
    assert P.duplicate_count(t).first()[0] == 2


def test_missing_policies(rows, tuples):
    t = numbered(rows, [(" Alice ", "hello\nworld", None), ("Bob", " ok ", 10)], "name string, note string, score int")
    kept, extracted, summary = C.clean(t, action="extract_rows", trim=True, breaks=True)
    assert tuples(kept) == [(2, "Bob", "ok", 10)]
    assert tuples(extracted) == [(1, "Alice", "hello world", None)]
    assert summary["text_changed_cell_count"] == 3 and summary["missing_affected_row_count"] == 1
    kept, extracted, summary = C.clean(t, action="drop_rows", trim=True)
    assert kept.count() == 1 and extracted.count() == 0 and summary["text_changed_cell_count"] == 1
    zero = numbered(rows, [("a", None), (" ", 1.0), (None, math.nan)], "name string, score double")
    assert [tuple(r)[1:] for r in C.clean(zero, action="fill_zero")[0].orderBy(ROW).collect()] == [("a", 0.0), ("0", 1.0), ("0", 0.0)]
    with pytest.raises(EngineError):
        C.clean(t, action="guess")


def test_scaling(rows):
    t = numbered(rows, [("a", 10, "7"), ("b", 20, "7"), ("c", 30, None)], "name string, score int, same string")
    low, stats = C.scale(t, ["score", "same"], "min_max")
    assert [r["score"] for r in low.orderBy(ROW).collect()] == [0.0, 0.5, 1.0]
    assert [r["same"] for r in low.orderBy(ROW).collect()] == [0.0, 0.0, None]
    assert stats[0] == {"column_name": "score", "minimum": 10.0, "maximum": 30.0, "mean": 20.0, "standard_deviation": 8.164966}
    z = C.scale(t, ["score"], "z_score")[0]
    assert [r["score"] for r in z.orderBy(ROW).collect()] == [-1.224745, 0.0, 1.224745]
    # Filled cells enter the statistics.
    f = numbered(rows, [(None,), (10.0,)], "v double")
    assert [r["v"] for r in C.clean(f, action="fill_zero", scaling="min_max", columns=["v"])[0].orderBy(ROW).collect()] == [0.0, 1.0]


@pytest.mark.parametrize("columns", [[], ["nope"], ["score", "score"], ["name"], ["empty"]])
def test_scaling_errors(rows, columns):
    t = rows([("unknown", 1, None)], "name string, score int, empty double")
    with pytest.raises(EngineError):
        C.scale(t, columns, "z_score")


def test_numeric_preparation(rows, tuples):
    t = number_rows(rows([(1, "1.5", 2.0), (2, " ", 3.0), (3, "２", math.nan), (4, "4", 5.0)], "k int, a string, b double"), "k")
    p = prepare(t, ["a", "b"])
    assert (p.observations, p.dropped) == (2, 2)
    assert tuples(p.df, "__source_row__", "a", "b") == [(2, 1.5, 2.0), (5, 4.0, 5.0)]
    assert tuples(coercion_report(t, ["a"])) == [("a", 4, 1, 3, 0)]
    for bad in (["a", "a"], ["zz"]):
        with pytest.raises(EngineError):
            prepare(t, bad)
    with pytest.raises(EngineError):
        prepare(rows([("x",)], "a string"), ["a"])
    with pytest.raises(EngineError):
        prepare(rows([(math.inf,)], "a double"), ["a"])


def test_row_numbers_and_preview(spark, rows):
    t = number_rows(spark.range(0, 1000, 1, 7).selectExpr("id * 37 % 1000 as k", "CAST('NaN' AS DOUBLE) AS x"), "k")
    got = t.orderBy("k").collect()
    assert [r[ROW] for r in got] == list(range(1, 1001)) and [r["k"] for r in got] == list(range(1000))
    first = preview(t, 3).collect()
    assert [r["row_number"] for r in first] == [1, 2, 3] and first[0]["record"] == '{"k":0,"x":null}'
