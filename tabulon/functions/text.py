"""Cell predicates and text functions as Catalyst expressions (no Python in the data path)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode strip removes.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Cells that a file reader takes for a missing value, compared exactly.
NULL_TOKENS = (
    "", "NA", "N/A", "n/a", "NaN", "nan", "-nan", "-NaN", "null", "NULL", "None", "<NA>",
    "#N/A", "#N/A N/A", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN",
)
# Shapes of a number and of the three accepted date forms.
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
DATES = (
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T][^\n]*)?",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{4}(?:[ T][^\n]*)?",
    r"\d{4}年\d{1,2}月\d{1,2}日(?: [^\n]*)?",
)

NUMBER_RE = re.compile(NUMBER)
DATES_RE = tuple(re.compile(p) for p in DATES)

TEXT, NUMBERS, TIMES = ("string",), ("tinyint", "smallint", "int", "bigint", "float", "double"), ("date", "timestamp", "timestamp_ntz")


def strip(c: Column) -> Column:
    """Unicode strip; ``trim`` alone takes off only U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_number_type(dtype: str) -> bool:
    return dtype in NUMBERS or dtype.startswith("decimal")


def is_missing(c: Column, dtype: str) -> Column:
    """Null, NaN or, for text, blank. Never null itself."""
    if dtype == "string":
        return F.coalesce(F.length(strip(c)) == 0, F.lit(True))
    if dtype in ("float", "double"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def matches(c: Column, pattern: str) -> Column:
    """Whole-text match with Unicode digits."""
    return c.rlike(r"(?U)\A(?:" + pattern + r")\z")


def value_type(c: Column, dtype: str) -> Column:
    """boolean, number, datetime or text of a cell that is not missing."""
    if dtype == "boolean":
        return F.lit("boolean")
    if is_number_type(dtype):
        return F.lit("number")
    if dtype in TIMES:
        return F.lit("datetime")
    if dtype != "string":
        return F.lit("text")
    s = strip(c)
    return (
        F.when(F.lower(s).isin("true", "false"), "boolean")
        .when(matches(s, NUMBER), "number")
        .when(matches(s, DATES[0]) | matches(s, DATES[1]) | matches(s, DATES[2]), "datetime")
        .otherwise("text")
    )


def value_type_of(text: str) -> str:
    """``value_type`` of one stripped text, for use inside Arrow batches."""
    if text.lower() in ("true", "false"):
        return "boolean"
    if NUMBER_RE.fullmatch(text):
        return "number"
    return "datetime" if any(p.fullmatch(text) for p in DATES_RE) else "text"


def number(c: Column, dtype: str) -> Column:
    """Numeric value of a cell; null for cells that are missing or not of the type number."""
    if is_number_type(dtype):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if dtype == "boolean":
        return c.cast("double")
    if dtype != "string":
        return F.lit(None).cast("double")
    s = strip(c)
    # The JVM parses only ASCII digits, so others are mapped first.
    return F.when(matches(s, NUMBER), ascii_digits(s).try_cast("double"))


_DIGITS = "".join(
    chr(base + k)
    for base in (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040, 0x17E0, 0x1810, 0xFF10)
    for k in range(10)
)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _DIGITS, "0123456789" * (len(_DIGITS) // 10))


def has_line_break(c: Column) -> Column:
    return c.contains("\r") | c.contains("\n")


def collapse_breaks(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]+", " ")
