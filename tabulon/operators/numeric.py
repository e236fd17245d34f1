"""Numeric preparation of selected columns, with all checks in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import is_missing, number
from tabulon.operators.guards import require
from tabulon.operators.rows import ROW, SOURCE_ROW
from tabulon.runtime import quoted


@dataclass
class Prepared:
    """Complete numeric rows, how many there are and how many were dropped, and each column's figures."""

    df: DataFrame
    observations: int
    dropped: int
    stats: dict[str, dict[str, float]]

    def constant(self, column: str) -> bool:
        s = self.stats[column]
        return s["min"] == s["max"]


def coercion_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, cells, missing, numeric, invalid): invalid cells are neither missing nor numbers."""
    types = dict(df.dtypes)
    aggs = [F.count("*").alias("cells")]
    for i, c in enumerate(columns):
        m, v = is_missing(quoted(c), types[c]), number(quoted(c), types[c])
        aggs += [F.count_if(m).alias(f"m{i}"), F.count(v).alias(f"v{i}"), F.count_if(~m & v.isNull()).alias(f"b{i}")]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col("cells"), F.col(f"m{i}").alias("missing"), F.col(f"v{i}").alias("numeric"), F.col(f"b{i}").alias("invalid"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in which all columns are numbers, as doubles, with their row keys; other columns are dropped."""
    types = dict(df.dtypes)
    rows = [c for c in (ROW, SOURCE_ROW) if c in df.columns]
    if ROW in rows and SOURCE_ROW not in rows:
        df = df.withColumn(SOURCE_ROW, F.col(ROW) + 1)
        rows.append(SOURCE_ROW)
    return df.select(*rows, *[number(quoted(c), types[c]).alias(c) for c in columns]).dropna(subset=list(columns))


def prepare(df: DataFrame, columns: Sequence[str], *, finite: bool = True) -> Prepared:
    """Complete cases with checks: columns exist once each and hold only numbers and missing cells.

    With ``finite``, infinite values are an error too. Figures are those of the complete cases.
    """
    require([(len(set(columns)) == len(columns), "A column was chosen more than once."), *((c in df.columns, f"The table has no column '{c}'.") for c in columns)])
    types = dict(df.dtypes)
    values = {c: number(quoted(c), types[c]) for c in columns}
    whole = None
    for c in columns:
        whole = values[c].isNotNull() if whole is None else whole & values[c].isNotNull()
    aggs = [F.count("*").alias("rows"), F.count_if(whole).alias("kept")]
    for i, c in enumerate(columns):
        v = F.when(whole, values[c])
        aggs += [
            F.count_if(~is_missing(quoted(c), types[c]) & values[c].isNull()).alias(f"b{i}"),
            F.count_if(F.abs(v) == float("inf")).alias(f"i{i}"),
            *[f(v).alias(f"{n}{i}") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))],
        ]
    r = df.agg(*aggs).first()
    require([(not r[f"b{i}"], f"Column '{c}' holds {r[f'b{i}']} cells that are no numbers.") for i, c in enumerate(columns)])
    require([(not (finite and r[f"i{i}"]), f"Column '{c}' holds infinite values.") for i, c in enumerate(columns)])
    stats = {c: {n: r[f"{n}{i}"] for n in ("min", "max", "avg", "std")} for i, c in enumerate(columns)}
    return Prepared(complete_cases(df, columns), r["kept"], r["rows"] - r["kept"], stats)
