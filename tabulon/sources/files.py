"""Reading tables from CSV, XLSX and Parquet files with promotion of column types as a reader of data frames does it."""

from __future__ import annotations

import codecs
import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import EngineError
from tabulon.functions.text import NULL_TOKENS
from tabulon.operators.rows import number_rows
from tabulon.runtime import quoted
from tabulon.sources.xlsx import mangled, read_xlsx

SUFFIXES = (".csv", ".xlsx")
_SNIFF = 1 << 20
# Texts read as booleans.
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
_INT = r"[+-]?[0-9]+"
_FLOAT = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:inf|Inf|INF|infinity|Infinity|INFINITY)"


def check_file(path: str, limit: int | None = None) -> str:
    """The file's suffix, or an error for an unknown one, an empty file or one above ``limit`` bytes."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in SUFFIXES:
        raise EngineError("Only CSV and XLSX files are supported.")
    size = os.path.getsize(path)
    if not size:
        raise EngineError("The file is empty.")
    if limit is not None and size > limit:
        raise EngineError(f"The file exceeds {limit} bytes.")
    return suffix


def sniff_encoding(path: str) -> str:
    """``UTF-8`` if the whole file decodes strictly as such, else ``GB18030``, else an error. Read in blocks."""
    for name in ("utf-8", "gb18030"):
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with open(path, "rb") as f:
                while block := f.read(_SNIFF):
                    decoder.decode(block)
                decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            continue
        return name.upper()
    raise EngineError("The file's encoding is neither UTF-8 nor GB18030.")


def _header(path: str, encoding: str) -> list[str]:
    with open(path, encoding="utf-8-sig" if encoding == "UTF-8" else encoding, newline="") as f:
        for row in csv.reader(f):
            if row:
                return mangled(row)
    raise EngineError("The file could not be parsed.")


def promoted(df: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where all their cells allow it, null tokens as null.

    A column of whole numbers with a missing cell becomes double; one without any value double too.
    One aggregation decides for all columns.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    null = {c: quoted(c).isNull() | quoted(c).isin(*NULL_TOKENS) for c in texts}

    def every(c: str, cond: Column) -> Column:
        return F.coalesce(F.bool_and(null[c] | cond), F.lit(True))

    def number(c: str, pattern: str) -> Column:
        return F.trim(quoted(c)).rlike(rf"\A(?:{pattern})\z")

    aggs = []
    for i, c in enumerate(texts):
        aggs += [
            F.count_if(null[c]).alias(f"n{i}"),
            every(c, number(c, _INT) & F.trim(quoted(c)).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            every(c, number(c, _FLOAT)).alias(f"f{i}"),
            every(c, quoted(c).isin(*_TRUE, *_FALSE)).alias(f"b{i}"),
        ]
    r = df.agg(*aggs, F.count("*").alias("rows")).first()
    out = []
    for f in df.schema.fields:
        v = quoted(f.name)
        if f.name in null:
            i = texts.index(f.name)
            v = F.when(~null[f.name], v)
            if r[f"n{i}"] == r["rows"]:
                v = F.lit(None).cast("double")
            elif r[f"i{i}"] or r[f"f{i}"]:
                v = F.trim(v).try_cast("bigint" if r[f"i{i}"] and not r[f"n{i}"] else "double")
            elif r[f"b{i}"] and not r[f"n{i}"]:
                v = v.isin(*_TRUE)
        out.append(v.alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, *, infer: bool = True) -> DataFrame:
    """A CSV file with a header; quoted cells may hold line breaks; repeated names become ``a``, ``a.1``."""
    encoding = sniff_encoding(path)
    names = _header(path, encoding)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    if encoding != "UTF-8":
        # The charset is outside the default set of the JVM side.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True)
    reader = reader.option("escape", '"').option("encoding", encoding).option("mode", "FAILFAST").option("maxCharsPerColumn", -1)
    df = reader.csv(path).toDF(*names)
    return promoted(df) if infer else df


def load(spark: SparkSession, path: str, *, limit: int | None = None, key: str | None = None) -> DataFrame:
    """A numbered table from a CSV, XLSX or Parquet file; Parquet takes its row order from ``key``."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return number_rows(spark.read.parquet(path), key)
    suffix = check_file(path, limit)
    return number_rows(read_csv(spark, path) if suffix == ".csv" else read_xlsx(spark, path), key)


