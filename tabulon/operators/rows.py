"""Row identity: contiguous 1-based numbers in file order or in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import EngineError

ROW = "__row_number__"
#: File line of a data row: the header is line 1.
SOURCE_ROW = "__source_row__"


def number_rows(df: DataFrame, key: str | None = None, *, compressed: bool = False) -> DataFrame:
    """Add ``__row_number__``; the table is checkpointed, or with ``compressed`` stands in files (see ``kept``).

    Without a key, rows keep the order in which the source delivers them. With a key, the rows are
    range-partitioned and sorted by it, and each partition numbers its own rows after the sizes of
    those before it: no task sees the whole table. Rows of equal key have no defined order.
    """
    if ROW in df.columns:
        raise EngineError(f"The table already has a column {ROW}.")
    if key is not None:
        df = df.repartitionByRange(key).sortWithinPartitions(key)
    from tabulon.runtime import cut, kept

    d = (kept if compressed else cut)(df.withColumn("_m", F.monotonically_increasing_id()))
    # The upper 31 bits of the id are the partition, the lower 33 the place in it.
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = d.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition of the input: a number that the scheduler bounds.
    offsets = F.broadcast(sizes.select("_p", before.alias("_before")))
    out = d.withColumn("_p", part).join(offsets, "_p").withColumn(ROW, place + F.col("_before") + 1)
    return out.drop("_m", "_p", "_before")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW, SOURCE_ROW)]


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first ``rows`` rows, as JSON texts with ISO dates and NaN as null."""
    cols = []
    for f in df.schema.fields:
        if f.name in (ROW, SOURCE_ROW):
            continue
        c = F.col(f"`{f.name}`")
        cols.append((F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name))
    d = df.orderBy(ROW).limit(rows) if ROW in df.columns else df.limit(rows)
    json = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record")
    return d.select(F.col(ROW).alias("row_number"), json) if ROW in df.columns else d.select(json)
