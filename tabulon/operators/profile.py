"""Quality report of a table: missing cells, value types, padding, line breaks and repeated rows.

Everything is a Catalyst expression over one unpivoted scan; row numbers need ``__row_number__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import has_line_break, is_missing, strip, value_type
from tabulon.operators.rows import ROW, data_columns
from tabulon.runtime import quoted


def cells(df: DataFrame) -> DataFrame:
    """(position, column_name, value, missing, kind, padded, broken[, row_number]) of every cell; ``value`` as text."""
    types = dict(df.dtypes)
    parts = []
    for i, c in enumerate(data_columns(df)):
        v, t = quoted(c), types[c]
        missing = is_missing(v, t)
        text = t == "string"
        parts.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                (v if t not in ("binary",) and not t.startswith(("array", "map", "struct")) else F.to_json(F.struct(v))).cast("string").alias("value"),
                missing.alias("missing"),
                F.when(~missing, value_type(v, t)).alias("kind"),
                (~missing & (v != strip(v)) if text else F.lit(False)).alias("padded"),
                (~missing & has_line_break(v) if text else F.lit(False)).alias("broken"),
            )
        )
    row = [F.col(ROW).alias("row_number")] if ROW in df.columns else []
    return df.select(*row, F.explode(F.array(*parts)).alias("c")).select(*(["row_number"] if row else []), "c.*")


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def column_counts(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing cells and ratio, padded cells, cells with line breaks, mixed types.

    A column is mixed if its cells that are not missing have more than one type. The ratio is rounded
    half to even to 4 places, and 0 without rows. All columns are counted in one pass without a shuffle
    of cells: the aggregate has one row, which is then turned.
    """
    types = dict(df.dtypes)
    names = data_columns(df)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        v, t = quoted(c), types[c]
        missing = is_missing(v, t)
        aggs.append(_count(missing).alias(f"m{i}"))
        if t == "string":
            kind = value_type(v, t)
            aggs += [_count(~missing & (v != strip(v))).alias(f"w{i}"), _count(~missing & has_line_break(v)).alias(f"l{i}")]
            aggs.append(F.size(F.collect_set(F.when(~missing, kind))).alias(f"k{i}"))
        else:
            aggs += [F.lit(0).cast("long").alias(f"w{i}"), F.lit(0).cast("long").alias(f"l{i}"), F.lit(1).alias(f"k{i}")]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("data_type"),
                F.col("rows"),
                F.col(f"m{i}").alias("missing_count"),
                F.when(F.col("rows") > 0, F.bround(F.col(f"m{i}") / F.col("rows"), 4)).otherwise(0.0).alias("missing_ratio"),
                (F.col(f"k{i}") > 1).alias("mixed_types"),
                F.col(f"w{i}").alias("whitespace_count"),
                F.col(f"l{i}").alias("line_break_count"),
            )
            for i, c in enumerate(names)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def type_histogram(df: DataFrame) -> DataFrame:
    """(column_name, kind, n, rank): counts per value type, most frequent first, ties by name."""
    n = cells(df).where("kind is not null").groupBy("position", "column_name", "kind").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("n"), "kind"))
    return n.select("column_name", "kind", "n", rank.alias("rank"))


def type_examples(df: DataFrame, per_type: int = 3) -> DataFrame:
    """(column_name, kind, example_no, example): the first raw values of each type in row order."""
    w = Window.partitionBy("position", "column_name", "kind").orderBy("row_number")
    d = cells(df).where("kind is not null").withColumn("example_no", F.row_number().over(w)).where(F.col("example_no") <= per_type)
    return d.select("column_name", "kind", "example_no", F.col("value").alias("example"))


def flagged_rows(df: DataFrame) -> DataFrame:
    """(column_name, issue, row_number): every padded cell and every cell with a line break.

    One row per cell, so that no list grows with the table.
    """
    d = cells(df)
    issue = F.explode(F.array_compact(F.array(F.when(F.col("padded"), F.lit("whitespace")), F.when(F.col("broken"), F.lit("line_break")))))
    return d.select("column_name", issue.alias("issue"), "row_number")


def _row_keys(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df)]


def duplicate_groups(df: DataFrame) -> DataFrame:
    """One row per set of identical rows with more than one member: ``copies`` and ``first_row``.

    Null equals null, NaN equals NaN and 0.0 equals -0.0, as in Spark's grouping.
    """
    aggs = [F.count("*").alias("copies")] + ([F.min(ROW).alias("first_row")] if ROW in df.columns else [])
    return df.groupBy(*[quoted(c) for c in _row_keys(df)]).agg(*aggs).where("copies > 1")


def duplicate_count(df: DataFrame) -> DataFrame:
    """(duplicate_row_count): rows beyond the first of each set of identical rows."""
    return duplicate_groups(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_row_count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(row_number, first_row, copies) of all members of sets of identical rows.

    The sets are found by aggregation, which shrinks a hot set before the shuffle, and joined back.
    """
    keys = _row_keys(df)
    groups = duplicate_groups(df).select(*[quoted(c).alias(f"_{i}") for i, c in enumerate(keys)], "copies", "first_row")
    on = None
    for i, c in enumerate(keys):
        same = quoted(c).eqNullSafe(F.col(f"_{i}"))
        on = same if on is None else on & same
    return df.join(groups, on).select(F.col(ROW).alias("row_number"), "first_row", "copies")


def table_rollup(df: DataFrame) -> DataFrame:
    """Sums of the column counts and the number of surplus rows, in one row."""
    sums = column_counts(df).agg(
        F.sum("missing_count").alias("missing_cell_count"), F.sum("whitespace_count").alias("whitespace_cell_count"), F.sum("line_break_count").alias("line_break_cell_count")
    )
    return sums.crossJoin(duplicate_count(df))  # one row each


def has_issues(df: DataFrame) -> DataFrame:
    """(has_issues): any missing cell, surplus row or mixed column."""
    mixed = column_counts(df).agg(F.sum("missing_count").alias("m"), F.bool_or("mixed_types").alias("x"))
    return mixed.crossJoin(duplicate_count(df)).select(((F.col("m") > 0) | F.col("x") | (F.col("duplicate_row_count") > 0)).alias("has_issues"))


def eligible_numeric(df: DataFrame) -> DataFrame:
    """(column_name): columns whose cells that are not missing are all of the type number, and that have one."""
    n = cells(df).where("kind is not null").groupBy("position", "column_name").agg(F.bool_and(F.col("kind") == "number").alias("ok"))
    return n.where("ok").select("column_name")


def build_report(df: DataFrame) -> dict[str, DataFrame]:
    """All parts of the quality report; the table must carry row numbers."""
    return {
        "table": table_rollup(df),
        "columns": column_counts(df),
        "types": type_histogram(df),
        "examples": type_examples(df),
        "issues": flagged_rows(df),
        "duplicates": duplicate_rows(df),
    }
