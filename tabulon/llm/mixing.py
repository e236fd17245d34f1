"""Mixing sources to target shares of all tokens, repeating none more often than allowed.

The total is the largest that all shares allow. It is cut into equal slots; the golden-ratio sequence,
mapped through the cumulative shares, gives each slot its source, so that every stretch of the mix has
nearly the target shares. The documents of a source, in shuffled order, form blocks of as many tokens
as a slot; the r-th slot of a source takes its block r modulo the number of blocks, so that a source
is gone through once, then again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.runtime import cut, quoted, ranked

_GOLDEN = 0.6180339887498949  # fractional part of the golden ratio


class Mix:
    """The scaled shares of a mix: tokens per source and in all, and the size of a slot."""

    def __init__(self, totals: dict[str, int], shares: dict[str, float], repeats: dict[str, int], slots: int):
        live = {s: w for s, w in shares.items() if w > 0}
        if not live:
            raise EngineError("No source has a share above 0.")
        lacking = [s for s in live if not totals.get(s) or repeats[s] < 1]
        if lacking:
            raise EngineError(f"No tokens can come from: {', '.join(sorted(lacking))}.")
        whole = sum(live.values())
        self.shares = {s: live[s] / whole for s in sorted(live)}
        self.total = min(repeats[s] * totals[s] / w for s, w in self.shares.items())
        self.slots = slots
        self.block = self.total / slots
        self.blocks = {s: max(1, round(totals[s] / self.block)) for s in self.shares}
        self.totals, self.repeats = totals, repeats


def plan_mix(sizes: DataFrame, source: str, size: str, targets: DataFrame, *, slots: int = 20_000) -> Mix:
    """The mix for (source, target_share, max_repeats) rows over all documents; one row per source comes to the driver."""
    if slots < 1:
        raise EngineError("At least one slot.")
    totals = {r["s"]: r["n"] or 0 for r in sizes.groupBy(quoted(source).alias("s")).agg(F.sum(quoted(size)).alias("n")).join(targets.select(F.col("source").alias("s")), "s", "left_semi").collect()}
    rows = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).collect()
    return Mix(totals, {r["source"]: r["w"] for r in rows}, {r["source"]: r["m"] or 1 for r in rows}, slots)


def schedule(spark, mix: Mix) -> DataFrame:
    """(slot, source, block, round): which block of which source fills each slot, and in which round of the source."""
    u = F.pmod((F.col("slot") + 1).cast("double") * _GOLDEN, F.lit(1.0))
    pick, cum = None, 0.0
    names = list(mix.shares)
    for s in names[:-1]:
        cum += mix.shares[s]
        pick = F.when(u < cum, s) if pick is None else pick.when(u < cum, s)
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(names[-1])
    blocks = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(mix.blocks[s]))])
    d = spark.range(mix.slots).select(F.col("id").alias("slot")).withColumn("source", pick)
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1)
    # The golden sequence may give a source a few slots more than its rounds allow.
    d = d.withColumn("n", blocks[F.col("source")]).withColumn("round", F.floor(F.col("r") / F.col("n")))
    most = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(mix.repeats[s]))])
    return d.where(F.col("round") < most[F.col("source")]).select("slot", "source", (F.col("r") % F.col("n")).alias("block"), "round")


def uses(sizes: DataFrame, id_column: str, source: str, size: str, mix: Mix) -> DataFrame:
    """(id, source, tokens, uses, first_slot): every document with how often the mix uses it, 0 included.

    A document belongs to the block in which it starts, in the source's shuffled order; blocks in
    which none starts are empty. Documents without a source or target, of null size or empty are used
    as their block is, those outside any target 0 times. Equal sizes and repeated ids are separate
    documents. No source is gathered in one task.
    """
    d = sizes.select(quoted(id_column).cast("long").alias("id"), quoted(source).alias("source"), F.coalesce(quoted(size).cast("long"), F.lit(0)).alias("tokens"))
    placed = ranked(d.withColumn("source", F.coalesce("source", F.lit(""))), ["source"], "id", "before", weight="tokens")
    totals = F.create_map(*[x for s in mix.shares for x in (F.lit(s), F.lit(float(mix.totals[s])))])
    blocks = F.create_map(*[x for s in mix.shares for x in (F.lit(s), F.lit(mix.blocks[s]))])
    key = F.col("source")
    block = F.least(F.floor(F.col("before") / totals[key] * blocks[key]), (blocks[key] - 1).cast("long"))
    taken = schedule(sizes.sparkSession, mix).groupBy("source", "block").agg(F.count("*").alias("uses"), F.min("slot").alias("first_slot"))
    out = placed.withColumn("block", F.when(totals[key].isNotNull(), block)).join(taken, ["source", "block"], "left")
    return out.select("id", F.when(key != "", key).alias("source"), "tokens", F.coalesce("uses", F.lit(0)).alias("uses"), "first_slot")


def reached(used: DataFrame, mix: Mix) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_uses, max_repeats) of a mix."""
    spark = used.sparkSession
    want = spark.createDataFrame([(s, w, mix.repeats[s]) for s, w in mix.shares.items()], "source string, target_share double, max_repeats int")
    got = used.where("uses > 0").groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses")
    )
    d = want.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_uses"])
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    return d.select("source", "target_share", share.alias("reached_share"), "tokens", "documents", "most_uses", "max_repeats")


def mix(sizes: DataFrame, id_column: str, source: str, size: str, targets: DataFrame, *, slots: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of the documents; see ``uses`` and ``reached``."""
    found = plan_mix(sizes, source, size, targets, slots=slots)
    used = cut(uses(sizes, id_column, source, size, found))
    return used, reached(used, found)
