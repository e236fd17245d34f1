"""Writing tables: small ones as one CSV or XLSX file, large ones in parallel."""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame

from tabulon.errors import EngineError
from tabulon.operators.rows import ROW, data_columns
from tabulon.sources.xlsx import write_xlsx

BOM = b"\xef\xbb\xbf"


def _text(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return "True" if v else "False"
    return repr(v) if isinstance(v, float) else str(v)


def rows_of(df: DataFrame) -> Iterator[Sequence]:
    """The rows in row order without row numbers, one partition at a time on the driver."""
    d = df.orderBy(ROW) if ROW in df.columns else df
    return d.select(*[f"`{c}`" for c in data_columns(df)]).toLocalIterator()


def csv_bytes(header: Sequence[str], rows: Iterable[Sequence]) -> bytes:
    """UTF-8 with byte-order mark, line feeds, missing cells empty."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    for r in rows:
        w.writerow([_text(v) for v in r])
    return BOM + out.getvalue().encode("utf-8")


def table_csv(df: DataFrame) -> bytes:
    return csv_bytes(data_columns(df), rows_of(df))


def write_csv_parts(df: DataFrame, path: str) -> None:
    """A table of any size as CSV parts with a header each, written by the tasks."""
    df.select(*[f"`{c}`" for c in data_columns(df)]).write.mode("error").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_clean(cleaned: DataFrame, extracted: DataFrame, stem: str, output: str, table: str = "cleaned", suffix: str = "cleaned") -> tuple[str, bytes]:
    """(file name, content) of a cleaning result.

    ``csv`` writes the table asked for; ``xlsx`` the cleaned one, and the extracted one on a second
    sheet if it has rows.
    """
    if output not in ("csv", "xlsx"):
        raise EngineError(f"Unknown format '{output}'.")
    if table not in ("cleaned", "extracted"):
        raise EngineError(f"Unknown table '{table}'.")
    if output == "csv":
        if table == "extracted":
            return f"{stem}-missing-{suffix}.csv", table_csv(extracted)
        return f"{stem}-{suffix}.csv", table_csv(cleaned)
    sheets = {"cleaned_data": (data_columns(cleaned), rows_of(cleaned))}
    if not extracted.isEmpty():
        sheets["missing_data"] = (data_columns(extracted), rows_of(extracted))
    return f"{stem}-{suffix}.xlsx", write_xlsx(sheets)
