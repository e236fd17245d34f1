import datetime as dt
import io
import math
import zipfile

import pytest

from tabulon import rules
from tabulon.errors import EngineError
from tabulon.operators import clean as C
from tabulon.operators.regression import analyze
from tabulon.operators.rows import ROW
from tabulon.sinks import reports as R
from tabulon.sinks.files import BOM, export_clean, table_csv
from tabulon.sources.files import check_file, load, read_csv, sniff_encoding
from tabulon.sources.xlsx import mangled, read_table, read_xlsx, write_xlsx


def test_csv_promotion_and_quoted_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name,note,age,n,flag,none,a,a\n"x ""y""","hello\nworld",20,1,True,NA,1,2\nBob,ok,,2,False,,3,4\n', encoding="utf-8-sig")
    df = load(spark, str(p))
    assert dict(df.dtypes) == {"name": "string", "note": "string", "age": "double", "n": "bigint", "flag": "boolean", "none": "double", "a": "bigint", "a.1": "bigint", ROW: "bigint"}
    assert [tuple(r) for r in df.orderBy(ROW).collect()] == [('x "y"', "hello\nworld", 20.0, 1, True, None, 1, 2, 1), ("Bob", "ok", None, 2, False, None, 3, 4, 2)]


def test_gb18030(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes("城市,n\n北京,1\n".encode("gb18030"))
    assert sniff_encoding(str(p)) == "GB18030"
    assert [tuple(r) for r in read_csv(spark, str(p)).collect()] == [("北京", 1)]


def test_gate(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.CSV").write_text("")
    (tmp_path / "c.csv").write_text("x" * 100)
    (tmp_path / "d.csv").write_bytes(b"\xff\xff\xff\n")
    for name, limit in (("a.txt", None), ("b.CSV", None), ("c.csv", 10)):
        with pytest.raises(EngineError):
            check_file(str(tmp_path / name), limit)
    with pytest.raises(EngineError):
        sniff_encoding(str(tmp_path / "d.csv"))


def test_workbook_round_trip(spark, tmp_path):
    head = ["t", "i", "f", "b", "d", "t"]
    rows = [["a<&>\n\"é", 1, 1.5, True, dt.datetime(2020, 1, 2, 3, 4), "x"], [None, 2, None, False, None, " y "]]
    content = write_xlsx({"one": (head, rows), "a name longer than thirty-one characters": (["z"], [])})
    schema, got = read_table(content)
    assert [f.name for f in schema] == ["t", "i", "f", "b", "d", "t.1"]
    assert [list(r) for r in got] == rows
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert b'name="a name longer than thirty-one c"' in z.read("xl/workbook.xml") or b"thirty-one" in z.read("xl/workbook.xml")
    p = tmp_path / "a.xlsx"
    p.write_bytes(content)
    df = read_xlsx(spark, str(p))
    assert df.count() == 2 and dict(df.dtypes)["d"] == "timestamp_ntz"
    for bad in (b"", b"no zip", b"PK\x05\x06" + b"\0" * 18):
        with pytest.raises(EngineError):
            read_table(bad)
    assert mangled(["a", "a", "a.1", "", None]) == ["a", "a.1", "a.1.1", "Unnamed: 3", "Unnamed: 4"]


def test_clean_export(spark, rows):
    t = rows([(1, "a", 10.0), (2, None, 2.5), (3, 'q"', math.nan)], f"{ROW} long, name string, v double")
    kept, extracted, _ = C.clean(t, action="extract_rows")
    name, content = export_clean(kept, extracted, "data", "csv")
    assert name == "data-cleaned.csv" and content == BOM + b"name,v\na,10.0\n"
    assert export_clean(kept, extracted, "data", "csv", "extracted")[1] == BOM + b'name,v\n,2.5\n"q""",\n'
    book = zipfile.ZipFile(io.BytesIO(export_clean(kept, extracted, "data", "xlsx")[1])).read("xl/workbook.xml")
    assert b"cleaned_data" in book and b"missing_data" in book
    book = zipfile.ZipFile(io.BytesIO(export_clean(kept, extracted.limit(0), "data", "xlsx")[1])).read("xl/workbook.xml")
    assert b"missing_data" not in book
    assert table_csv(kept).startswith(BOM)
    with pytest.raises(EngineError):
        export_clean(kept, extracted, "data", "pdf")


def test_analysis_report(spark):
    t = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "x double, y double")
    r = analyze(t, "ols", "y", ["x"])
    sheets = R.analysis_sheets(r)
    assert set(sheets) == {"summary", "coefficients", "vif"} and [x[0] for x in sheets["summary"][1]][:5] == ["method", "observations", "dropped_rows", "dependent_column", "independent_columns"]
    assert R.analysis_csv(r).startswith(BOM + b"term,estimate,")
    assert read_table(R.workbook(sheets))[1]
    c = analyze(t, "pearson", "y", ["x"])
    assert set(R.analysis_sheets(c)) == {"summary", "coefficients"}
    assert R.summary_frame(spark, sheets["summary"]).columns == ["item", "value"]


def test_latest_result():
    k = R.LatestResult()
    a = k.put({"n": 1})
    assert k.get(a) == {"n": 1}
    b = k.put({"n": 2})
    assert k.get(b) == {"n": 2}
    with pytest.raises(EngineError):
        k.get(a)


def test_rules(spark):
    assert rules.detect_coordinates(["a", " LON ", "Lat"]) == ("geographic", " LON ", "Lat")
    assert rules.detect_coordinates(["x", "y_coord"]) == ("projected", "x", "y_coord")
    assert rules.detect_coordinates(["lon", "y"]) is None
    assert [rules.format_number(v) for v in (None, 0.0, 0.00001234, 1.5)] == ["-", "0.000000", "1.234e-05", "1.500000"]
    assert rules.parse_candidates("5, 8，5 9") == [5, 8, 9] and rules.parse_candidates("5,x") == [] and rules.parse_candidates("") == []
    assert rules.default_neighbors(3) == 2 and rules.default_neighbors(100) == 8 and rules.bandwidth_bound(14, "loocv") == 13
    assert rules.importance_width([2.0, 1.0]) == [100.0, 50.0] and rules.importance_width([0.0]) == [0.0]
    assert rules.format_ratio(0.25) == "25.00%" and rules.format_size(1536) == "1.5 KB"
    assert rules.parse_names('["a"]') == ["a"] and rules.parse_integers("[1, 2]") == [1, 2]
    for f, bad in ((rules.parse_names, "[1]"), (rules.parse_names, "x"), (rules.parse_integers, "[true]"), (rules.parse_integers, "{}")):
        with pytest.raises(EngineError):
            f(bad)
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(0.8, 0.01), (-0.5, 0.2), (0.1, None), (None, 0.01)], "r double, p double")
    got = [tuple(r) for r in d.select(rules.correlation_strength(F.col("r")), rules.significant(F.col("p")), rules.moran_direction(F.col("r"), F.col("p"))).collect()]
    assert got == [("strong", True, "clustered"), ("moderate", False, "random"), ("weak", False, "random"), ("undetermined", True, "random")]


def test_workflow():
    w = rules.ForestWorkflow()
    with pytest.raises(EngineError):
        w.tuned_bandwidth()
    w.tuned_parameters()
    w.tuned_bandwidth()
    assert w.ready(True)
    w.changed_coordinates_or_parameters()
    assert not w.ready(True) and w.ready(False) and w.parameters_tuned
    w.changed_columns()
    assert not w.parameters_tuned


def test_streams(spark, tmp_path):
    from tabulon.streaming.rows import clean_stream, quality_stream

    data = [(" a ", dt.datetime(2020, 1, 1, 0, 5)), (None, dt.datetime(2020, 1, 1, 0, 6)), ("b\n", dt.datetime(2020, 1, 1, 1, 7))]
    path = str(tmp_path / "in")
    schema = "name string, at timestamp"
    spark.createDataFrame(data, schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    for name, out in (("cleaned", clean_stream(stream, action="drop_rows", trim=True)), ("quality", quality_stream(stream, "at"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "cleaned" else "complete").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["name"] for r in spark.table("cleaned").collect()) == ["a", "b"]
    got = {(r["window"]["start"].hour, r["column_name"]): (r["cells"], r["missing"], r["padded"], r["broken"]) for r in spark.table("quality").collect()}
    assert got[0, "name"] == (2, 1, 1, 0) and got[1, "name"] == (1, 0, 1, 1)
