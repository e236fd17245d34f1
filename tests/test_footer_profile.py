import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tabulon.operators.footer_profile import chunk_frequencies, column_quality, load_findings, scan_frequencies, values_of

COLS = ["name", "age"]


def write(path, table, **options):
    pq.write_table(pa.table(table), path, **options)


def test_footers_and_scan_agree(spark, tmp_path, tuples):
    rng = np.random.default_rng(1)
    loads = np.sort(rng.integers(1, 6, 900))
    name = [None if rng.random() < 0.2 else ["a", " a", "b", ""][rng.integers(0, 4)] for _ in loads]
    age = [str(rng.integers(0, 300)) for _ in loads]
    write(tmp_path / "a.parquet", {"load_id": pa.array(loads), "name": pa.array(name, pa.string()), "age": pa.array(age)}, row_group_size=100)
    write(tmp_path / "b.parquet", {"load_id": pa.array([7] * 50), "name": pa.array([None] * 50, pa.string()), "age": pa.array(["5"] * 50)})
    write(tmp_path / "c.parquet", {"load_id": pa.array([8, None, 8]), "name": pa.array(["é" * 100_000, "x", None]), "age": pa.array(["1", "2", "3"])}, use_dictionary=False)
    df = spark.read.parquet(str(tmp_path))
    key = ["load_id", "column_name", "s", "n", "padded"]
    assert tuples(values_of(chunk_frequencies(df, "load_id", COLS)), *key) == tuples(values_of(scan_frequencies(df, "load_id", COLS)), *key)


def test_settled_chunks_are_not_read(spark, tmp_path, monkeypatch, tuples):
    write(tmp_path / "b.parquet", {"load_id": pa.array([7] * 4), "name": pa.array([None] * 4, pa.string()), "age": pa.array(["5", None, "5", "5"])})
    out = chunk_frequencies(spark.read.parquet(str(tmp_path)), "load_id", COLS)
    assert tuples(out) == [(7, "age", "5", 3), (7, "age", None, 1), (7, "name", None, 4)]


def frame(rows, loads):
    return rows([(k, c, v) for k, cols in loads.items() for c, vs in cols.items() for v in vs], "load_id long, column_name string, value string").groupBy("load_id", "column_name", "value").count().withColumnRenamed("count", "n")


def test_findings_by_hand(rows, tuples):
    loads = {
        1: {"age": ["1", "2", "3", "4", "5"], "city": ["x", "x", "y", "y"], "name": ["a", "b", None, " "]},
        2: {"age": ["3", "9", "9", "30", "zz"], "city": ["x"] * 3 + ["z"], "name": ["a ", "a", "a", "a"]},
        3: {"age": [None, ""], "city": ["x", "z", "z", "z"], "name": ["true", "5"]},
    }
    order = rows([(1, 1, 1), (2, 1, 5), (3, 1, 9), (4, 2, 1)], "load_id long, feed_id long, load_no int")
    got = load_findings(values_of(frame(rows, loads)), order, numeric=["age"], categorical=["city"])
    assert tuples(got) == sorted(
        [
            (2, "age", "mixed_types"),
            (2, "age", "drift"),
            (2, "age", "range"),
            (2, "city", "drift"),
            (2, "name", "whitespace"),
            (2, "name", "missing_change"),
            (2, "name", "constant"),
            (3, "age", "missing_change"),
            (3, "city", "drift"),
            (3, "name", "mixed_types"),
        ],
        key=repr,
    )


def test_quality_of_one_column(rows):
    r = column_quality(values_of(frame(rows, {1: {"age": ["1", "2", " 2", "3", "10", "x", None, "　"]}}))).first()
    assert (r["cells"], r["missing_count"], r["whitespace_count"], r["distinct_count"]) == (8, 2, 1, 5)
    assert (r["min_number"], r["median"], r["max_number"], r["q1"], r["q3"]) == (1.0, 2.0, 10.0, 2.0, 3.0)
    assert (r["n_number"], r["n_text"], r["mixed_types"]) == (5, 1, True)


def test_empty(rows):
    v = values_of(rows([], "load_id long, column_name string, value string, n long"))
    assert column_quality(v).count() == 0
    assert load_findings(v, rows([], "load_id long, feed_id long, load_no int"), numeric=["age"], categorical=["city"]).count() == 0


def test_whole_columns_by_footers_and_dictionaries(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tabulon.operators.footer_profile import table_chunks, table_quality

    few = [None if i % 7 == 0 else f"v{i % 40:02d}" for i in range(3000)]
    many = [f"{i * 7919 % 3000:05d}\u00e9" for i in range(3000)]
    long = ["x" * 100 + str(i % 3) for i in range(3000)]
    t = pa.table({"few": few, "many": many, "long": long, "none": pa.array([None] * 3000, pa.string())})
    for name, options in (("a", {}), ("b", {"compression": "zstd", "data_page_version": "2.0"}), ("c", {"use_dictionary": ["few"]}), ("d", {"dictionary_pagesize_limit": 500}), ("e", {"write_statistics": False})):
        pq.write_table(t, tmp_path / f"{name}.parquet", row_group_size=1100, **options)
        got = {r["column_name"]: r for r in table_quality(table_chunks(spark.read.parquet(str(tmp_path / f"{name}.parquet")), list(t.column_names))).collect()}
        for c in t.column_names:
            v = [x for x in t.column(c).to_pylist() if x is not None]
            r = got[c]
            assert (r["rows"], r["null_count"], r["distinct_count"]) == (3000, 3000 - len(v), len(set(v))), (name, c)
            assert (r["min_text"], r["max_text"]) == ((min(v), max(v)) if v else (None, None))
            assert r["extrema_by_footer"] + r["extrema_by_scan"] == 3 == r["distinct_by_dictionary"] + r["distinct_by_scan"]
        assert got["few"]["distinct_by_dictionary"] == (3 if name != "d" else got["few"]["distinct_by_dictionary"])
        # A dictionary that outgrows its page is given up within the chunk.
        assert got["many"]["distinct_by_scan"] == 3 if name == "c" else got["many"]["distinct_by_scan"] > 0 if name == "d" else got["many"]["distinct_by_scan"] == 0
        assert got["few"]["extrema_by_footer"] == (0 if name == "e" else 3)
        assert got["long"]["extrema_by_footer"] == 0
