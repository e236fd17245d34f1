import csv
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabulon.errors import EngineError
from tabulon.operators.rejects import code_points, load_records, split_records, structure, with_delimiter

COLUMNS = [("name", "string"), ("note", "string"), ("score", "double")]


def run(rows, texts, delimiter=","):
    t = rows([(i, x, delimiter) for i, x in enumerate(texts)], "line_id long, raw string, d string")
    out = load_records(t, "raw", "d", COLUMNS, no_controls_in=["note"])
    return [(r["name"], r["note"], r["score"], r["reason"]) for r in out.orderBy("line_id").collect()]


def test_reasons_in_their_order(rows):
    bad = (None, None, None)
    assert run(
        rows,
        [
            'a,"b ""c"" d, e",1.5',
            'a,b "c" d,1',
            'a,"b" c,1',
            'a,"b,1',
            "a,b",
            "a,b,1,2",
            'a,b"c',
            "a,b,x",
            "a,b\x07,1",
            "a\x07,b\tc\r\nd,1",
            "NA, null ,  NaN ",
            "a,b,",
            '"","",""',
            "",
            None,
            "a,b,1e5",
            "a,b, ７ ",
            'a,"""",2',
        ],
    ) == [
        ("a", 'b "c" d, e', 1.5, None),
        (*bad, "quoting"),
        (*bad, "quoting"),
        (*bad, "quoting"),
        (*bad, "column_count"),
        (*bad, "column_count"),
        (*bad, "quoting"),
        (*bad, "value"),
        (*bad, "value"),
        ("a\x07", "b\tc\r\nd", 1.0, None),
        (None, " null ", None, None),
        ("a", "b", None, None),
        (None, None, None, None),
        (*bad, "column_count"),
        (*bad, "column_count"),
        ("a", "b", 1e5, None),
        ("a", "b", 7.0, None),
        ("a", '"', 2.0, None),
    ]


def test_delimiters_per_record_and_clashing_names(rows):
    t = rows([(1, "a;b;1", ";", "x"), (2, "a\tb\t2", "\t", "y"), (3, "a,b,3", None, "z"), (4, "aéb€,é4", "é", "w")], "line_id long, raw string, d string, name string")
    out = load_records(t, "raw", "d", COLUMNS)
    assert out.columns == ["line_id", "raw", "d", "name_1", "name", "note", "score", "reason"]
    assert [(r["name_1"], r["score"], r["reason"]) for r in out.orderBy("line_id").collect()] == [("x", 1.0, None), ("y", 2.0, None), ("z", 3.0, None), ("w", 4.0, None)]


def test_empty_table_and_very_long_record(rows):
    assert run(rows, []) == []
    assert run(rows, ["a," + "b" * 300_000 + ",1"])[0][1] == "b" * 300_000
    with pytest.raises(EngineError):
        load_records(rows([("x",)], "raw string"), "raw", None, [])


def test_unknown_files_keep_the_default(rows):
    t = with_delimiter(rows([(1, 5, "a,b,1"), (2, 9, "a,b,1"), (3, None, "a,b,1")], "line_id long, f long, raw string"), rows([(5, ","), (None, ";")], "f long, d string"), "f", "d")
    out = load_records(t, "raw", "d", COLUMNS)
    assert out.where("reason is null").count() == 3


@given(st.lists(st.lists(st.text(alphabet='ab",;\n é', max_size=6), min_size=1, max_size=4), min_size=1, max_size=5), st.sampled_from(",;"))
def test_well_formed_records_are_split_as_written(records, delimiter):
    texts = []
    for r in records:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        texts.append(out.getvalue())
    import numpy as np

    cp, offsets = code_points(texts)
    where, record, bad = structure(cp, offsets, np.full(len(texts), ord(delimiter), np.uint32))
    assert not bad.any()
    assert [int((record == i).sum()) + 1 for i in range(len(texts))] == [len(r) for r in records]


def parse_by_hand(text, delimiter):
    """Is the quoting in order? A plain state machine."""
    state = "start"
    for ch in text:
        if state == "quoted":
            state = "closing" if ch == '"' else "quoted"
        elif state == "closing":
            if ch == '"':
                state = "quoted"
            elif ch == delimiter:
                state = "start"
            else:
                return False
        elif ch == '"':
            if state != "start":
                return False
            state = "quoted"
        else:
            state = "start" if ch == delimiter else "plain"
    return state != "quoted"


@given(st.lists(st.text(alphabet='a",', max_size=12), min_size=1, max_size=6))
def test_quoting_matches_a_state_machine(texts):
    import numpy as np

    cp, offsets = code_points(texts)
    _, _, bad = structure(cp, offsets, np.full(len(texts), ord(","), np.uint32))
    assert bad.tolist() == [not parse_by_hand(t, ",") for t in texts]


def test_split_records():
    assert split_records('a,"b\nc"\r\nd\re\n\nf') == ['a,"b\nc"', "d", "e", "", "f"]
    assert split_records("") == []
