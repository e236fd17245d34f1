"""Column profiles of large columnar tables, per load, and what changed between loads.

Footers come first: a column chunk that is all null, or that holds one value for one load, is answered
from its exact null count and extrema and is not read. Of the other chunks the dictionary and its
codes are decoded, so that a distinct value reaches the profile once per chunk and load with its
number of occurrences; strings are never materialised per row. Everything after that (types, padding,
ranges, quartiles, distribution changes) works on this value-frequency table inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse, urlunparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.functions.text import ascii_digits, strip, value_type
from tabulon.operators.parquet_pages import chunk_dictionary
from tabulon.runtime import cut, quantiles, quoted, range_cuts

_OUT = "load_id long, column_name string, value string, n long"
_TYPES = ("boolean", "datetime", "number", "text")


def _system(uri: str):
    """(file system, path) of a URI: this machine's, those that Arrow knows, else any that fsspec does."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    # Hadoop's names of the same stores.
    known = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}.get(parts.scheme, parts.scheme)
    try:
        return fs.FileSystem.from_uri(urlunparse(parts._replace(scheme=known)))
    except (pa.ArrowInvalid, NotImplementedError):
        import fsspec

        return fs.PyFileSystem(fs.FSSpecHandler(fsspec.filesystem(known))), f"{parts.netloc}{unquote(parts.path)}"


def _open(uri: str, coded: Sequence[str] = ()) -> pq.ParquetFile:
    """A file whose columns ``coded`` are left as dictionary codes; its footer is read once."""
    system, path = _system(uri)
    return pq.ParquetFile(system.open_input_file(path), read_dictionary=list(coded))


def _from_footer(group: pq.RowGroupMetaData, key: pq.ColumnChunkMetaData, chunk: pq.ColumnChunkMetaData) -> dict | None:
    """{value: count} of a chunk whose statistics settle it; None if it has to be read."""
    k, c = key.statistics, chunk.statistics
    if k is None or c is None or not (k.has_min_max and k.has_null_count and c.has_null_count):
        return None
    if k.null_count or k.min != k.max:
        return None
    if c.null_count == group.num_rows:
        return {None: c.null_count}
    if c.has_min_max and c.min == c.max and isinstance(c.min, str) and len(c.min) < 32:
        return {c.min: group.num_rows - c.null_count} | ({None: c.null_count} if c.null_count else {})
    return None


def chunk_frequencies(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(load_id, column_name, value, n) of a table in Parquet files, n per chunk, from footers and dictionaries.

    ``df`` must be a plain scan: its files are read whole.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return spark.createDataFrame([], _OUT)
    width = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(pd.DataFrame({"file": files})).repartition(width)

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b["file"]:
                groups = _open(f).metadata.num_row_groups
                yield pd.DataFrame({"file": [f] * groups, "row_group": np.arange(groups, dtype=np.int64)})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pq.ParquetFile] = {}
        for b in batches:
            for f, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f not in opened:
                    opened.clear()
                    opened[f] = _open(f, columns)
                source = opened[f]
                group = source.metadata.row_group(g)
                at = {group.column(i).path_in_schema: i for i in range(group.num_columns)}
                settled, needed = {}, []
                for c in columns:
                    found = _from_footer(group, group.column(at[key]), group.column(at[c]))
                    if found is None:
                        needed.append(c)
                    else:
                        settled[c] = found
                if settled:
                    only = group.column(at[key]).statistics.min
                    rows = [(only, c, v, n) for c, found in settled.items() for v, n in found.items()]
                    yield _batch(*zip(*rows))
                if not needed:
                    continue
                table = source.read_row_group(g, columns=[key, *needed])
                loads = table.column(key).combine_chunks()
                known = loads.drop_null()
                names, which = np.unique(known.to_numpy(zero_copy_only=False), return_inverse=True)
                keep = np.asarray(loads.is_valid())
                for c in needed:
                    coded = table.column(c).combine_chunks()
                    if not pa.types.is_dictionary(coded.type):
                        coded = coded.cast(pa.string()).dictionary_encode()
                    values = coded.dictionary.cast(pa.string())
                    size = len(values) + 1
                    codes = coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)[keep]
                    pairs, n = np.unique(which.astype(np.int64) * size + codes, return_counts=True)
                    taken = pa.array(np.where(pairs % size == len(values), 0, pairs % size), mask=pairs % size == len(values))
                    yield _batch(names[pairs // size], [c] * len(pairs), values.take(taken), n)

    chunks = listed.mapInPandas(footers, "file string, row_group long").repartition(4 * spark.sparkContext.defaultParallelism)
    return chunks.mapInArrow(decode, _OUT)


def _batch(loads, names, values, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(loads, np.int64)),
            pa.array(list(names), pa.string()),
            values if isinstance(values, pa.Array) else pa.array(list(values), pa.string()),
            pa.array(np.asarray(n, np.int64)),
        ],
        ["load_id", "column_name", "value", "n"],
    )


#: Extrema of texts this long may have been cut short by their writer.
_WHOLE_TEXT = 60


def _extrema(chunk: pq.ColumnChunkMetaData) -> tuple | None:
    """(nulls, minimum, maximum) of a text chunk by its footer, if these are exact."""
    c = chunk.statistics
    if c is None or not c.has_null_count:
        return None
    if c.null_count == chunk.num_values:
        return c.null_count, None, None
    if not c.has_min_max or not all(isinstance(x, str) and len(x.encode()) < _WHOLE_TEXT for x in (c.min, c.max)):
        return None
    return c.null_count, c.min, c.max


_PIECES = "column_name string, rows long, nulls long, low string, high string, source string, distinct_by string, value string"


def table_chunks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What is known of each chunk of text columns: one row with its rows, nulls and extrema, and one per distinct value.

    Nulls and extrema come from the footer, distinct values from the dictionary page alone where all of a
    chunk's pages use it; only a chunk for which either does not hold is read. ``source`` and ``distinct_by``
    say which it was: footer, dictionary or scan. ``df`` must be a plain scan of Parquet files.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return spark.createDataFrame([], _PIECES)
    listed = spark.createDataFrame(pd.DataFrame({"file": files})).repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))

    kinds = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in (x.split() for x in _PIECES.split(", "))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = _system(uri)
                with system.open_input_file(path) as raw:
                    source = pq.ParquetFile(raw)
                    for g in range(source.metadata.num_row_groups):
                        group = source.metadata.row_group(g)
                        at = {group.column(i).path_in_schema: i for i in range(group.num_columns)}
                        for c in columns:
                            chunk = group.column(at[c])
                            known, held, by, how = _extrema(chunk), chunk_dictionary(raw, chunk), "footer", "dictionary"
                            if known is None or held is None:
                                cells = source.read_row_group(g, columns=[c]).column(0).cast(pa.string())
                                if known is None:
                                    low, high = (pa.compute.min_max(cells.cast(pa.binary()))[x].as_py() for x in ("min", "max")) if len(cells) else (None, None)
                                    known, by = (cells.null_count, *(None if x is None else x.decode() for x in (low, high))), "scan"
                                if held is None:
                                    held, how = cells.unique().drop_null().to_pylist(), "scan"
                            rows = [(c, group.num_rows, *known, by, how, None), *((c, None, None, None, None, None, None, v) for v in held)]
                            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    return listed.mapInArrow(pieces, _PIECES)


def table_quality(chunks: DataFrame) -> DataFrame:
    """One row per column of a whole table: rows, nulls, extrema of the texts as stored, distinct values, and chunks by where that came from."""
    head = chunks.where(F.col("rows").isNotNull()).groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("null_count"),
        F.min("low").alias("min_text"),
        F.max("high").alias("max_text"),
        *[F.count_if(F.col("source") == k).alias(f"extrema_by_{k}") for k in ("footer", "scan")],
        *[F.count_if(F.col("distinct_by") == k).alias(f"distinct_by_{k}") for k in ("dictionary", "scan")],
    )
    # A value reaches this once per chunk, not once per row.
    values = chunks.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    values = values.groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    return head.join(values, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def scan_frequencies(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The same table from any DataFrame, by a scan: for sources without footers."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns]))
    long = df.where(quoted(key).isNotNull()).select(quoted(key).cast("long").alias("load_id"), cells.alias("c")).select("load_id", "c.*")
    return long.groupBy("load_id", "column_name", "value").agg(F.count("*").alias("n"))


def values_of(chunks: DataFrame) -> DataFrame:
    """(load_id, column_name, s, n, padded, kind, num): each distinct stripped value once, with its type and number; s is null for missing cells."""
    s = strip(F.col("value"))
    d = chunks.select("load_id", "column_name", "value", "n", s.alias("s")).withColumn("s", F.when(F.length("s") > 0, F.col("s")))
    padded = F.when(F.col("s") != F.col("value"), F.col("n")).otherwise(0)
    d = d.select("load_id", "column_name", "s", "n", padded.alias("padded")).groupBy("load_id", "column_name", "s").agg(F.sum("n").alias("n"), F.sum("padded").alias("padded"))
    d = d.withColumn("kind", F.when(F.col("s").isNotNull(), value_type(F.col("s"), "string")))
    return cut(d.withColumn("num", F.when(F.col("kind") == "number", ascii_digits(F.col("s")).try_cast("double"))))


def column_quality(values: DataFrame, ranged: Sequence[str] | None = None) -> DataFrame:
    """One row per load and column: cells, missing, types, padded cells, distinct values, ranges, quartiles.

    Ranges are those of the stripped texts and, over the cells of type number, of the numbers; quartiles are those of the
    columns ``ranged``, or of all.
    """
    stats = values.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("cells"),
        F.sum(F.when(F.col("s").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.sum("padded").alias("whitespace_count"),
        F.count("s").alias("distinct_count"),
        F.min("s").alias("min_text"),
        F.max("s").alias("max_text"),
        F.min("num").alias("min_number"),
        F.max("num").alias("max_number"),
        *[F.sum(F.when(F.col("kind") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in _TYPES],
    )
    stats = stats.withColumn("missing_ratio", F.col("missing_count") / F.col("cells"))
    stats = stats.withColumn("mixed_types", sum(F.when(F.col(f"n_{t}") > 0, 1).otherwise(0) for t in _TYPES) > 1)
    numbers = values if ranged is None else values.where(F.col("column_name").isin(*ranged))
    numbers = numbers.where(F.col("num").isNotNull()).select("load_id", "column_name", "num", "n")
    numbers = numbers.groupBy("load_id", "column_name", "num").agg(F.sum("n").alias("n"))  # 1 and 1.0
    q = quantiles(numbers, ["load_id", "column_name"], "num", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75}, range_cuts(values, "num"))
    return stats.join(q, ["load_id", "column_name"], "left")


def preceding(loads: DataFrame) -> DataFrame:
    """(load_id, before): the feed's load with the next lower number; loads without feed or number have none."""
    d = loads.where(F.col("feed_id").isNotNull() & F.col("load_no").isNotNull())
    d = d.withColumn("before", F.lag("load_id").over(Window.partitionBy("feed_id").orderBy("load_no", "load_id")))
    return d.where(F.col("before").isNotNull()).select("load_id", "before")


def distribution_shift(values: DataFrame, stats: DataFrame, order: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(load_id, column_name, shift): half the sum of absolute differences of the values' shares to the load before."""
    known = stats.select("load_id", "column_name", (F.col("cells") - F.col("missing_count")).alias("known"))
    shares = values.where(F.col("s").isNotNull() & F.col("column_name").isin(*columns)).join(known, ["load_id", "column_name"])
    shares = shares.select("load_id", "column_name", "s", (F.col("n") / F.col("known")).alias("share"))
    earlier = shares.withColumnRenamed("load_id", "before").join(order, "before")
    both = shares.withColumn("side", F.lit(1)).unionByName(earlier.select("load_id", "column_name", "s", (-F.col("share")).alias("share"), F.lit(2).alias("side")))
    per_value = both.groupBy("load_id", "column_name", "s").agg(F.abs(F.sum("share")).alias("d"), F.bit_or("side").alias("sides"))
    out = per_value.groupBy("load_id", "column_name").agg((F.sum("d") / 2).alias("shift"), F.bit_or("sides").alias("sides"))
    return out.where("sides = 3").drop("sides")


def load_findings(
    values: DataFrame,
    loads: DataFrame,
    *,
    numeric: Sequence[str],
    categorical: Sequence[str],
    missing_change: float = 0.13,
    median_move: float = 0.55,
    far: float = 10.0,
    share_move: float = 0.35,
) -> DataFrame:
    """(load_id, column_name, finding) of every load against the feed's preceding one.

    ``values`` comes from ``values_of``. Nothing is compared where either side has no cell of the kind
    compared, nor for a feed's first load. An interquartile range of 0 makes any move a drift.
    """
    if min(missing_change, median_move, far, share_move) < 0:
        raise EngineError("Thresholds must not be negative.")
    used = ["cells", "missing_count", "distinct_count", "min_number", "max_number", "q1", "median", "q3"]
    stats = cut(column_quality(values, numeric).select("load_id", "column_name", "mixed_types", "whitespace_count", *used))
    order = preceding(loads)
    past = stats.select(F.col("load_id").alias("before"), "column_name", *[F.col(c).alias(f"was_{c}") for c in used])
    d = stats.join(order, "load_id", "left").join(past, ["before", "column_name"], "left")
    d = d.join(distribution_shift(values, stats, order, categorical), ["load_id", "column_name"], "left")
    was = lambda c: F.col(f"was_{c}")
    spread = was("q3") - was("q1")
    is_numeric = F.col("column_name").isin(*numeric)

    def when(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    found = F.array_compact(
        F.array(
            when(F.col("mixed_types"), "mixed_types"),
            when(F.col("whitespace_count") > 0, "whitespace"),
            when(F.abs(F.col("missing_count") / F.col("cells") - was("missing_count") / was("cells")) > missing_change, "missing_change"),
            when((F.col("distinct_count") == 1) & (was("distinct_count") >= 2), "constant"),
            when(is_numeric & (F.abs(F.col("median") - was("median")) > median_move * spread), "drift"),
            when(is_numeric & (F.greatest(F.col("max_number") - was("median"), was("median") - F.col("min_number")) > far * spread), "range"),
            when(F.col("column_name").isin(*categorical) & (F.col("shift") > share_move), "drift"),
        )
    )
    return d.select("load_id", "column_name", F.explode(found).alias("finding"))
