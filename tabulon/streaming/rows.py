"""The row-wise operators on streams: they hold no state, so a stream takes the same expressions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.operators.clean import any_missing, clean_text, fill_zero
from tabulon.operators.profile import cells


def clean_stream(stream: DataFrame, *, action: str = "none", trim: bool = False, breaks: bool = False) -> DataFrame:
    """Cleaning of each row as it comes. Scaling needs the whole table and has no place here."""
    if action == "drop_rows":
        stream = stream.where(~any_missing(stream))
    elif action == "extract_rows":
        stream = stream.where(any_missing(stream))
    elif action == "fill_zero":
        stream = fill_zero(stream)
    elif action != "none":
        raise EngineError(f"Unknown action '{action}'.")
    return clean_text(stream, trim, breaks) if trim or breaks else stream


def quality_stream(stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, column_name, cells, missing, padded, broken): counts per event-time window, late rows up to ``late``."""
    d = stream.withWatermark(time, late)
    c = cells(d.withColumn("__row_number__", F.col(time)))
    return c.groupBy(F.window("row_number", window).alias("window"), "column_name").agg(
        F.count("*").alias("cells"), F.count_if("missing").alias("missing"), F.count_if("padded").alias("padded"), F.count_if("broken").alias("broken")
    )
