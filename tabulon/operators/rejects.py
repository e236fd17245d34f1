"""Loading delimited records and separating those that cannot be read, with the reason.

Structural indexing: the records of an Arrow batch become one array of code points; masks of quotes
and the parity of their running count within a record locate the delimiters and record ends, and the
quotes that stand where none may, for all records at once. Only then are cells cut out and typed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import EngineError
from tabulon.functions.text import NULL_TOKENS, NUMBER_RE
from tabulon.runtime import fresh, quoted

_QUOTE = 34
_NULLS = frozenset(NULL_TOKENS)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of each)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def structure(cp: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the delimiters outside quotes, record of each, does a record break the quoting).

    ``delimiter`` has the delimiter's code point for each record.
    """
    n = len(offsets) - 1
    record = np.repeat(np.arange(n), np.diff(offsets))
    quote = cp == _QUOTE
    running = np.concatenate(([0], np.cumsum(quote)))
    before = running[:-1] - running[offsets[:-1]][record]  # quotes before this place, in its record
    outside = (before & 1) == 0
    cut = (cp == delimiter[record]) & outside & ~quote
    first = np.zeros(len(cp) + 1, bool)
    first[offsets[:-1]] = True
    last = np.zeros(len(cp) + 1, bool)
    last[offsets[1:]] = True  # the place after a record's end
    after_cut = np.concatenate(([False], cut))
    after_quote = np.concatenate(([False], quote))
    at = np.flatnonzero(quote)
    opens = outside[at]
    # An opening quote starts a cell or doubles the quote before it; a closing one ends a cell or is doubled.
    starts = first[at] | after_cut[at] | (after_quote[at] & ~first[at])
    nxt = at + 1
    pad = np.concatenate((cp, np.zeros(1, np.uint32)))
    ends = last[nxt] | ((pad[nxt] == delimiter[record[at]]) & ~last[nxt]) | ((pad[nxt] == _QUOTE) & ~last[nxt])
    bad = np.zeros(n, bool)
    bad[record[at[np.where(opens, ~starts, ~ends)]]] = True
    bad |= ((running[offsets[1:]] - running[offsets[:-1]]) & 1).astype(bool)
    where = np.flatnonzero(cut)
    return where, record[where], bad


def control_characters(cp: np.ndarray) -> np.ndarray:
    return ((cp < 32) & (cp != 9) & (cp != 10) & (cp != 13)) | (cp == 127)


def _cell(text: str) -> str:
    return text[1:-1].replace('""', '"') if text[:1] == '"' else text


def load_records(
    df: DataFrame,
    text: str,
    delimiter: str | None,
    columns: Sequence[tuple[str, str]],
    *,
    default_delimiter: str = ",",
    no_controls_in: Sequence[str] = (),
) -> DataFrame:
    """Parse one record per row into ``columns`` (name, "string" or "double"), keeping the other columns of ``df``.

    Adds one column per cell and ``reason``: null for a loaded record, otherwise the first that
    applies of ``quoting`` (a quote elsewhere than opening a cell, closing it or doubled inside it, or
    a cell never closed), ``column_count`` (not one cell per column) and ``value`` (a number cell that
    is neither blank, a missing token nor a number; a control character other than tab, CR and LF in a
    cell of ``no_controls_in``). Cells of rejected records are null. Null records count as having no
    cell, empty ones as having one; missing tokens, compared exactly, are read as null; a null or
    empty delimiter is ``default_delimiter``. A row column that bears the name of a cell is renamed
    with a numbered suffix. Splitting is lazy: ``where("reason is null")`` and its complement.
    """
    if not columns:
        raise EngineError("At least one column is required.")
    if default_delimiter == '"' or len(default_delimiter) != 1:
        raise EngineError("A delimiter is one character other than the double quote.")
    names = [c for c, _ in columns]
    kept = fresh([*names, "reason"], *df.columns)
    typed = [T.StructField(c, T.DoubleType() if k == "double" else T.StringType()) for c, k in columns]
    fields = T.StructType([*(T.StructField(k, f.dataType) for k, f in zip(kept, df.schema.fields)), *typed, T.StructField("reason", T.StringType())])
    at = df.columns.index(text)
    at_delimiter = df.columns.index(delimiter) if delimiter else None
    width, guarded = len(columns), [names.index(c) for c in no_controls_in]
    numbers = [k for k, (_, kind) in enumerate(columns) if kind == "double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).to_pylist()
            marks = b.column(at_delimiter).to_pylist() if at_delimiter is not None else [None] * len(raw)
            texts = [t or "" for t in raw]
            cp, offsets = code_points(texts)
            delim = np.array([ord(m[0]) if m else ord(default_delimiter) for m in marks], np.uint32)
            where, record, quoting = structure(cp, offsets, delim)
            n = len(texts)
            count = np.bincount(record, minlength=n) + 1
            count[[t is None for t in raw]] = 0
            bounds = np.searchsorted(record, np.arange(n + 1))
            dirty = np.concatenate(([0], np.cumsum(control_characters(cp))))
            has_control = dirty[offsets[1:]] > dirty[offsets[:-1]]
            reasons = np.where(quoting, "quoting", np.where(count != width, "column_count", None)).astype(object)
            cells: list[list] = [[None] * n for _ in columns]
            starts = offsets.tolist()
            for k in np.flatnonzero(reasons == None).tolist():  # noqa: E711
                t, base = texts[k], starts[k]
                cuts = (where[bounds[k] : bounds[k + 1]] - base).tolist()
                row = [_cell(t[i:j]) for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(t)])]
                good = True
                for c in numbers:
                    s = row[c].strip()
                    if s in _NULLS:
                        row[c] = None
                    elif NUMBER_RE.fullmatch(s):
                        row[c] = float(s)
                    else:
                        good = False
                if good and has_control[k]:
                    good = not any(any((ch < " " and ch not in "\t\n\r") or ch == "\x7f" for ch in row[c] or "") for c in guarded)
                if not good:
                    reasons[k] = "value"
                    continue
                for c, v in enumerate(row):
                    cells[c][k] = None if v in _NULLS else v
            arrays = [*b.columns, *(pa.array(v, pa.float64() if kind == "double" else pa.string()) for v, (_, kind) in zip(cells, columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(reasons.tolist(), pa.string())], [f.name for f in fields])

    return df.mapInArrow(run, fields)


def split_records(content: str) -> list[str]:
    """The records of a whole file: line breaks outside quotes end a record (LF, CR LF or CR)."""
    cp, offsets = code_points([content])
    inside = (np.concatenate(([0], np.cumsum(cp == _QUOTE)))[:-1] & 1).astype(bool)
    feed, back = cp == 10, cp == 13
    pair = np.concatenate((feed[1:], [False])) & back
    ends = np.flatnonzero((feed | (back & ~pair)) & ~inside)
    out, at = [], 0
    for e in ends.tolist():
        stop = e - 1 if cp[e] == 10 and e > at and cp[e - 1] == 13 else e
        out.append(content[at:stop])
        at = e + 1
    if at < len(content):
        out.append(content[at:])
    return out


def with_delimiter(rows: DataFrame, files: DataFrame, key: str, delimiter: str) -> DataFrame:
    """Attach each record's delimiter; a record of an unknown file keeps a null."""
    marks = files.where(quoted(key).isNotNull()).groupBy(quoted(key)).agg(F.min(quoted(delimiter)).alias(delimiter))
    return rows.join(marks, key, "left")
