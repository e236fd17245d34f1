import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.runtime import attach, cut, quantiles, range_cuts


def skewed(spark, n=3000):
    """Nine in ten rows have key 1; some have none."""
    return cut(spark.range(n).select("id", F.when(F.col("id") % 10 < 9, 1).when(F.col("id") % 100 == 99, None).otherwise(F.col("id") % 7 + 2).cast("int").alias("k"), F.sin("id").alias("v")))


def test_a_hot_key_is_spread_over_many_parts(spark):
    d = skewed(spark)
    table = cut(d.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")))
    got = attach(d, table, ["k"], "n", d.count())
    assert got.count() == d.count() and set(got.columns) == {"id", "k", "v", "top"}
    want = {r["k"]: r["top"] for r in table.collect()}
    assert all(r["top"] == want.get(r["k"]) for r in got.collect())
    assert attach(d, table, ["k"], "n", d.count(), "inner").where("k is null").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    # What a task gets: the rows of one key and part.
    hashed = spark.createDataFrame([(1,)], "k int").select(F.lit(1000)).first()[0]
    parts = d.where("k = 1").groupBy(F.pmod(F.xxhash64("id", "k", "v"), F.lit(int(0.9 * hashed)))).count().agg(F.max("count")).first()[0]
    assert parts <= 0.01 * d.count()


@pytest.mark.parametrize("part_rows", [50, 400, 100_000])
def test_quantiles_in_two_stages(spark, part_rows):
    d = skewed(spark).where("k is not null").groupBy("k", F.round("v", 2).alias("v")).agg(F.count("*").alias("n"))
    d = cut(d.unionAll(spark.createDataFrame([(99, None, 3)], "k int, v double, n long")))
    cuts = range_cuts(d, "v", part_rows)
    assert bool(cuts) == (part_rows < 100_000)
    got = {r["k"]: (r["q1"], r["q2"], r["q9"]) for r in quantiles(d, ["k"], "v", "n", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, cuts).collect()}
    values = {}
    for r in d.where("v is not null").collect():
        values.setdefault(r["k"], []).extend([r["v"]] * r["n"])
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.9]).tolist())
    if cuts:
        edges = [-np.inf, *cuts, np.inf]
        sizes = [d.where((F.col("k") == 1) & (F.col("v") > a) & (F.col("v") <= b)).count() for a, b in zip(edges, edges[1:])]
        assert max(sizes) <= 4 * part_rows
