"""Reading and writing XLSX workbooks with the standard library, and a data source for Spark.

A workbook is one compressed file and is read by one task; many workbooks are read in parallel.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.errors import EngineError

# Name spaces and content types of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

_NS = {"m": MAIN}
_EPOCH = dt.datetime(1899, 12, 30)
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indices of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = set()
    for f in root.iterfind(".//m:numFmt", _NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower()
        if re.search(r"[ymdhs]", code) and "general" not in code:
            own.add(int(f.get("numFmtId")))
    xfs = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(xfs if xfs is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _first_sheet(z: zipfile.ZipFile) -> str:
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = book.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{REL}}}id")
    for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == rid:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise EngineError("The workbook has no readable sheet.")


def read_cells(content: bytes) -> Iterator[list]:
    """The rows of the first sheet as lists of str, int, float, bool, datetime or None."""
    if not content:
        raise EngineError("The file is empty.")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")))
        dates, sheet = _date_styles(z), z.open(_first_sheet(z))
    except (zipfile.BadZipFile, KeyError, AttributeError, ET.ParseError) as exc:
        raise EngineError("The file could not be parsed.") from exc
    for _, row in ET.iterparse(sheet):
        if row.tag != f"{{{MAIN}}}row":
            continue
        out: list = []
        for c in row.iterfind("m:c", _NS):
            at = _column(c.get("r", "")) if c.get("r") else len(out)
            out += [None] * (at + 1 - len(out))
            kind, v = c.get("t", "n"), c.find("m:v", _NS)
            text = v.text if v is not None else None
            if kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
            elif text is None:
                out[at] = None
            elif kind == "s":
                out[at] = shared[int(text)]
            elif kind == "b":
                out[at] = text == "1"
            elif kind in ("str", "e"):
                out[at] = text
            elif kind == "d":
                out[at] = dt.datetime.fromisoformat(text)
            else:
                number = float(text)
                if int(c.get("s", 0)) in dates:
                    out[at] = _EPOCH + dt.timedelta(days=number)
                else:
                    out[at] = int(number) if number.is_integer() and "." not in text and "e" not in text.lower() else number
        row.clear()
        yield out


def mangled(names: Sequence) -> list[str]:
    """Header names as texts; repeated ones get .1, .2 and so on, blank ones their position."""
    out, used, seen = [], set(), {}
    for i, n in enumerate(names):
        name = base = str(n) if n not in (None, "") else f"Unnamed: {i}"
        while name in used:
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}.{seen[base]}"
        used.add(name)
        out.append(name)
    return out


def _spark_type(values: Iterable) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType() if all(v is not None for v in values) else T.DoubleType()
    if kinds <= {int, float}:
        return T.DoubleType()
    return T.TimestampNTZType() if kinds == {dt.datetime} else T.StringType()


def _converted(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v)
    return float(v) if isinstance(kind, T.DoubleType) else v


def read_table(content: bytes) -> tuple[T.StructType, list[tuple]]:
    """(schema, rows) of the first sheet; its first row is the header."""
    rows = list(read_cells(content))
    if not rows:
        raise EngineError("The file could not be parsed.")
    names = mangled(rows[0])
    body = [r + [None] * (len(names) - len(r)) for r in rows[1:]]
    kinds = [_spark_type([r[i] for r in body]) for i in range(len(names))]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return schema, [tuple(_converted(r[i], k) for i, k in enumerate(kinds)) for r in body]


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from read_table(f.read())[1]


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)``; several paths are separated by commas and share a schema."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        with open(self.options["path"].split(",")[0], "rb") as f:
            return read_table(f.read())[0]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").load(path)


def _cell(ref: str, v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, (dt.datetime, dt.date)):
        d = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return f'<c r="{ref}" s="1"><v>{(d.replace(tzinfo=None) - _EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'


def write_xlsx(sheets: dict[str, tuple[Sequence[str], Iterable[Sequence]]]) -> bytes:
    """A workbook of named sheets, each (header, rows); names are cut to 31 characters. Rows are streamed."""
    if not sheets:
        raise EngineError("A workbook needs a sheet.")
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds, book, rels = [], [], []
        for n, (name, (header, rows)) in enumerate(sheets.items(), 1):
            with z.open(f"xl/worksheets/sheet{n}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for r, row in enumerate(_all(header, rows), 1):
                    cells = "".join(_cell(f"{_letters(c)}{r}", v) for c, v in enumerate(row))
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
            kinds.append(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            book.append(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>')
            rels.append(f'<Relationship Id="rId{n}" Type="{REL}/worksheet" Target="worksheets/sheet{n}.xml"/>')
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{"".join(kinds)}</Types>',
        )
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{"".join(book)}</sheets></workbook>')
        styles = f'<Relationship Id="rId{len(sheets) + 1}" Type="{REL}/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{"".join(rels)}{styles}</Relationships>')
        z.writestr(
            "xl/styles.xml",
            f'{head}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        )
    return out.getvalue()


def _all(header: Sequence, rows: Iterable[Sequence]) -> Iterator[Sequence]:
    yield header
    yield from rows
