"""Pearson and Spearman correlation with two-sided p-values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.special import finite, t_two_sided
from tabulon.operators.guards import enough, known, require, varying
from tabulon.operators.numeric import Prepared, prepare
from tabulon.runtime import attach, cut, quoted

METHODS = ("pearson", "spearman")


def average_ranks(df: DataFrame, column: str, rank: str) -> DataFrame:
    """(column, rank): the average rank of each distinct value, without sorting the table in one task.

    Distinct values are range-partitioned; each partition ranks its own after the sizes of the earlier.
    """
    v = quoted(column)
    freq = df.where(v.isNotNull()).groupBy(v.alias(column)).agg(F.count("*").alias("_n"))
    freq = cut(freq.repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()))
    sizes = freq.groupBy("_p").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_p", before.alias("_b")))  # one row per partition
    own = F.sum("_n").over(Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    d = freq.withColumn("_c", own).join(offsets, "_p")
    return d.select(column, "_n", (F.col("_b") + F.col("_c") - F.col("_n") / 2 + 0.5).alias(rank))


def spearman_frame(df: DataFrame, y: str, x: str) -> DataFrame:
    """(ry, rx) of complete rows. Values of very many rows are looked up in several parts."""
    d = df.select(quoted(y).alias("_y"), quoted(x).alias("_x"))
    ranks = {c: cut(average_ranks(d, c, r)) for c, r in (("_y", "ry"), ("_x", "rx"))}
    n = ranks["_y"].agg(F.sum("_n")).first()[0] or 0
    for c, table in ranks.items():
        d = attach(d, table, [c], "_n", n, "inner")
    return d.select("ry", "rx")


def correlation_p(r: float, n: int) -> float:
    if n < 3:
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def correlate(df: DataFrame, method: str, dependent: str, independent: list[str]) -> dict:
    require([known("Correlation", method, METHODS), (len(independent) == 1, f"A correlation is between two columns, not {1 + len(independent)}.")])
    (x,) = independent
    p: Prepared = prepare(df, [dependent, x])
    require([enough(p.observations, 3), *varying(p, [dependent, x], "Column")])
    if method == "pearson":
        r = p.df.agg(F.corr(quoted(x), quoted(dependent)).alias("r")).first()["r"]
    else:
        r = spearman_frame(p.df, dependent, x).agg(F.corr("rx", "ry").alias("r")).first()["r"]
    r = max(-1.0, min(1.0, r))
    return {
        "kind": "correlation",
        "method": method,
        "observations": p.observations,
        "dropped_rows": p.dropped,
        "dependent_column": dependent,
        "independent_columns": independent,
        "correlation": {"coefficient": finite(r), "p_value": finite(correlation_p(r, p.observations))},
        "regression": None,
        "diagnostics": None,
    }
