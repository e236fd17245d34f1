"""Missing-value policies, text cleaning and scaling, in this order, so that filled cells enter the statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import collapse_breaks, is_missing, is_number_type, number, strip
from tabulon.operators.guards import known, require
from tabulon.operators.rows import ROW, data_columns
from tabulon.runtime import quoted

ACTIONS = ("none", "drop_rows", "extract_rows", "fill_zero")
SCALINGS = ("none", "min_max", "z_score")


def any_missing(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    types = dict(df.dtypes)
    return reduce(lambda a, b: a | b, [is_missing(quoted(c), types[c]) for c in columns or data_columns(df)], F.lit(False))


def split_missing(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with a missing cell); the latter's ``__row_number__`` says which they are."""
    cond = any_missing(df)
    return df.where(~cond), df.where(cond)


def fill_zero(df: DataFrame) -> DataFrame:
    """Every missing cell as zero of its type; ``0`` in text columns, false in boolean ones.

    Columns of other types have no zero and keep their nulls.
    """
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        v, t = quoted(c), types[c]
        if c in data_columns(df) and (t in ("string", "boolean") or is_number_type(t)):
            v = F.when(is_missing(v, t), F.lit("0") if t == "string" else F.lit(0).cast(t)).otherwise(v)
        out.append(v.alias(c))
    return df.select(*out)


def cleaned_text(c: Column, trim: bool, breaks: bool) -> Column:
    """Stripped first, then runs of line breaks as one space."""
    c = strip(c) if trim else c
    return collapse_breaks(c) if breaks else c


def clean_text(df: DataFrame, trim: bool = True, breaks: bool = True) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(
        *[(cleaned_text(quoted(c), trim, breaks) if types[c] == "string" and c in data_columns(df) else quoted(c)).alias(c) for c in df.columns]
    )


def changed_cells(df: DataFrame, trim: bool = True, breaks: bool = True) -> DataFrame:
    """(changed_cell_count): text cells that cleaning alters."""
    types = dict(df.dtypes)
    changed = [F.coalesce(F.sum(F.when(cleaned_text(quoted(c), trim, breaks) != quoted(c), 1)), F.lit(0)) for c in data_columns(df) if types[c] == "string"]
    return df.agg(reduce(lambda a, b: a + b, changed, F.lit(0)).cast("long").alias("changed_cell_count"))


def scaling_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: minimum, maximum, and mean and population deviation rounded to 6 places, in one pass."""
    _check(df, columns)
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(columns):
        v = number(quoted(c), types[c])
        bad = ~is_missing(quoted(c), types[c]) & v.isNull()
        aggs += [F.min(v).alias(f"n{i}"), F.max(v).alias(f"x{i}"), F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}"), F.count_if(bad).alias(f"b{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"n{i}").alias("minimum"),
                F.col(f"x{i}").alias("maximum"),
                F.bround(f"a{i}", 6).alias("mean"),
                F.bround(f"s{i}", 6).alias("standard_deviation"),
                F.col(f"a{i}").alias("exact_mean"),
                F.col(f"s{i}").alias("exact_deviation"),
                F.col(f"b{i}").alias("invalid"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def _check(df: DataFrame, columns: Sequence[str]) -> None:
    require(
        [
            (bool(columns), "No column to scale was given."),
            (len(set(columns)) == len(columns), "A column was chosen more than once."),
            *((c in df.columns, f"The table has no column '{c}'.") for c in columns),
        ]
    )


def scale(df: DataFrame, columns: Sequence[str], method: str) -> tuple[DataFrame, list[dict]]:
    """(table with the columns scaled and rounded half to even to 6 places, their statistics).

    One aggregation, one row to the driver, then literals in a projection. Constant columns become
    0; missing cells stay null.
    """
    require([known("Scaling", method, SCALINGS)])
    if method == "none":
        return df, []
    stats = [r.asDict() for r in scaling_statistics(df, columns).collect()]
    for r in stats:
        name, odd = r["column_name"], r.pop("invalid")
        require([(not odd, f"Column '{name}' holds {odd} cells that are no numbers."), (r["minimum"] is not None, f"Column '{name}' holds no numbers.")])
    types = dict(df.dtypes)
    by = {r["column_name"]: r for r in stats}
    out = []
    for c in df.columns:
        if c in by:
            r, v = by[c], number(quoted(c), types[c])
            low, width = (r["minimum"], r["maximum"] - r["minimum"]) if method == "min_max" else (r["exact_mean"], r["exact_deviation"])
            out.append((v * 0.0 if width == 0 else F.bround((v - F.lit(low)) / F.lit(width), 6)).alias(c))
        else:
            out.append(quoted(c).alias(c))
    return df.select(*out), [{k: v for k, v in r.items() if not k.startswith("exact_")} for r in stats]


def clean(
    df: DataFrame, *, action: str = "none", trim: bool = False, breaks: bool = False, scaling: str = "none", columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, dict]:
    """(cleaned, extracted, summary): policy for rows with missing cells, then text, then scaling.

    ``extracted`` holds rows only for ``extract_rows``; changed cells are counted in both, not in
    dropped rows. The summary takes two aggregations; the extracted rows' numbers are a column of
    ``extracted``, not a list.
    """
    require([known("Action", action, ACTIONS)])
    affected = df.agg(F.count_if(any_missing(df)).alias("n")).first()["n"]
    kept, extracted = df, df.limit(0)
    if action == "drop_rows":
        kept, _ = split_missing(df)
    elif action == "extract_rows":
        kept, extracted = split_missing(df)
    elif action == "fill_zero":
        kept = fill_zero(df)
    changed = 0
    if trim or breaks:
        counted = df if action == "extract_rows" else kept
        changed = changed_cells(counted, trim, breaks).first()[0]
        kept, extracted = clean_text(kept, trim, breaks), clean_text(extracted, trim, breaks)
    kept, statistics = scale(kept, list(columns), scaling)
    return (
        kept,
        extracted,
        {
            "missing_action": action,
            "missing_affected_row_count": affected,
            "text_changed_cell_count": changed,
            "standardization_method": scaling,
            "standardized_columns": list(columns),
            "standardization_statistics": statistics,
        },
    )


def extracted_row_numbers(df: DataFrame) -> DataFrame:
    """(row_number) of the rows with a missing cell."""
    return df.where(any_missing(df)).select(F.col(ROW).alias("row_number"))
