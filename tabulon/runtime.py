"""Session helpers: lineage cuts, table loading, distributed ranks and exact weighted quantiles."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.errors import EngineError


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a folder of this machine is used if
    the master is local, as in tests; on a cluster it would not be shared, so that is an error.
    """
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints, set if it was not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise EngineError("Set spark.checkpoint.dir to a folder that all executors share.")
            named = tempfile.mkdtemp(prefix="tabulon-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, but as compressed columns, a fraction of a checkpoint's bytes; for types that Parquet has.

    The files go when the driver no longer uses the table, as checkpoints do; so do shuffles that went into it.
    """
    from tabulon.operators.kernel import folders

    spark = df.sparkSession
    path = f"{checkpoints(spark)}/kept-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    location = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    folders(spark).until(location, path)
    swept(spark)
    return out


def swept(spark: SparkSession) -> None:
    """Let shuffles of tables that are no longer used go, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(taken: Sequence[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that do not clash with ``taken`` (compared without case, as Spark does)."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        candidate, n = name, 0
        while candidate.lower() in used:
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashed_share(c: Column, share: float) -> Column:
    """A predicate that holds for about ``share`` of the values of ``c``, always the same ones; for all at 1."""
    return F.shiftrightunsigned(F.xxhash64(c), 11) < F.lit(int(min(1.0, share) * 2**53))


#: A key with more than this share of the rows is spread over several tasks, in a join by ``attach``.
SPREAD = 1000


def attach(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with a ``table`` of unique keys ``on`` whose column ``weight`` says how many of the ``total`` rows have the key.

    Rows of a key with more than one in ``SPREAD`` of them are dealt to as many parts, each of which gets the key's
    row of the table, so that no task gets much more than that share. By their share there are fewer
    than ``SPREAD`` such keys, which is why they may be broadcast. ``weight`` is dropped; nothing is sorted.
    """
    parts, salt = fresh([*rows.columns, *table.columns], "_parts", "_salt")
    sized = table.withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col(weight) * F.lit(SPREAD / max(1, total)))).cast("int")).drop(weight)
    hot = F.broadcast(sized.where(F.col(parts) > 1).select(*on, parts))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.when(no_key, F.lit(SPREAD)).otherwise(F.coalesce(parts, F.lit(1)))  # rows without a key find nothing, wherever they are
    dealt = rows.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(*[quoted(c) for c in rows.columns]), spread).cast("int")).drop(parts)
    each = sized.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return dealt.join(each.hint("shuffle_hash"), [*on, salt], how).drop(salt)


#: Rows of one part of a ranking, and of the values looked through for a quantile, about.
PART_ROWS, RANGE_ROWS = 200_000, 1_000_000


def ranked(df: DataFrame, keys: list[str], order: str, rank: str, buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Add ``rank``: the 0-based position of a row among the rows of its ``keys``, in the order of the
    long column ``order`` hashed, or, with ``weight``, the sum of the weights of the rows before it.

    No key is ever gathered in one task: rows are counted per (keys, bucket), where the bucket is the
    leading part of the hash, the few sums are accumulated per key, and rows are numbered inside
    their bucket only. There is a bucket for each ``PART_ROWS`` of all rows unless their number is given. Ties of the
    hash are broken by ``order`` itself.
    """
    if buckets is None:
        buckets = max(1, -(-df.count() // PART_ROWS))
    h, b, off, inner = fresh([*df.columns, rank], "_h", "_b", "_off", "_in")
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    d = df.withColumn(h, F.xxhash64(F.col(order))).withColumn(
        b, F.floor((F.shiftrightunsigned(F.col(h), 1).cast("double")) / F.lit(2.0**63 / buckets)).cast("int")
    )
    d = d.withColumn(b, F.least(F.col(b), F.lit(buckets - 1)))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, b).agg(F.sum(amount).alias(off))
    sums = sums.select(*keys, b, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off))
    local = Window.partitionBy(*keys, b).orderBy(F.shiftrightunsigned(F.col(h), 1), F.col(h), F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(inner, F.coalesce(F.sum(amount).over(local), F.lit(0)))
    return d.join(sums, [*keys, b]).withColumn(rank, F.col(inner) + F.col(off)).drop(h, b, off, inner)


def range_cuts(df: DataFrame, value: str, part_rows: int = RANGE_ROWS) -> list[float]:
    """Values that cut all rows' values into parts of about ``part_rows``, at most 10,000; few rows are not cut.

    They come from a mergeable sketch and only steer how the work is spread.
    """
    most = 10_000
    d = df.where(F.col(value).isNotNull())
    n = d.count()
    parts = min(most, -(-n // part_rows))
    if parts < 2:
        return []
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts <= 64 else F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: k / F.lit(float(parts)))
    found = d.agg(F.percentile_approx(value, at, 4 * parts).alias("c")).first()["c"]
    return sorted(set(found))


def quantiles(df: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float], cuts: Sequence[float] = ()) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys``, interpolated linearly, from a value-frequency table.

    ``df`` holds each value once per key with its number of occurrences ``weight``. With ``cuts`` (see
    ``range_cuts``) it goes in two stages: occurrences are counted per key and range between cuts, which
    tells the ranges that hold the wanted positions; only those are put in order, each by itself. A key
    with any number of values is thus never gathered in one task. Keys whose values are all null give no row.
    """
    cum, total, part, off, size = fresh([*df.columns, *probs], "_cum", "_total", "_part", "_off", "_size")
    d = df.where(F.col(value).isNotNull())
    place = lambda p: F.lit(p) * (F.col(total) - 1)
    if len(cuts):
        edges = np.asarray(cuts, float)

        @F.pandas_udf("int")
        def range_of(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, v.to_numpy(float)))

        d = d.withColumn(part, range_of(F.col(value).cast("double"))).repartition(*keys, part)
        counts = d.groupBy(*keys, part).agg(F.sum(weight).alias(size))
        # At most one row per key and range.
        before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn(off, before).withColumn(total, F.sum(size).over(Window.partitionBy(*keys)))
        asked = [(F.col(off) <= f(place(p))) & (f(place(p)) < F.col(off) + F.col(size)) for p in probs.values() for f in (F.floor, F.ceil)]
        counts = counts.where(reduce(lambda a, b: a | b, asked)).select(*keys, part, off, total)
        d = d.join(counts.hint("shuffle_hash"), [*keys, part])
        w = Window.partitionBy(*keys, part).orderBy(value)
        d = d.withColumn(cum, F.col(off) + F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        w = Window.partitionBy(*keys).orderBy(value)
        d = d.withColumn(cum, F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.withColumn(total, F.sum(weight).over(Window.partitionBy(*keys)))
    aggs = []
    for name, p in probs.items():
        low, high = F.floor(place(p)), F.ceil(place(p))
        first = F.col(cum) - F.col(weight)
        at_low = F.max(F.when((first <= low) & (low < F.col(cum)), F.col(value)))
        at_high = F.max(F.when((first <= high) & (high < F.col(cum)), F.col(value)))
        aggs += [(name, at_low, at_high, F.max(place(p) - low))]
    out = d.groupBy(*keys).agg(
        *[x.alias(f"_{name}_{k}") for name, lo, hi, fr in aggs for k, x in (("lo", lo), ("hi", hi), ("fr", fr))]
    )
    return out.select(
        *keys,
        *[
            F.when(F.col(f"_{n}_lo") == F.col(f"_{n}_hi"), F.col(f"_{n}_lo"))
            .otherwise(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_fr"))
            .alias(n)
            for n in probs
        ],
    )
