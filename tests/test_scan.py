"""The slab scan against a sort in pandas, with a third of the rows under one key and one instant."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberscan.operators.scan import exact_quantiles, islands, lookup_join, prefix_scan, ranked_positions


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 4000
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    t = rng.uniform(0, 1000, n)
    t[: n // 3] = 500.0
    return pd.DataFrame(dict(id=np.arange(n), key=key, t=t, v=rng.normal(size=n), w=rng.integers(0, 5, n).astype(float)))


@pytest.mark.parametrize("slabs", [1, 3, 64])
def test_running_aggregates(spark, rows, slabs):
    df = spark.createDataFrame(rows).withColumn("maybe", F.when(F.col("id") % 7 == 0, F.col("v")))
    got = prefix_scan(df, ["key"], ["t", "id"], sums={"s": "w"}, running_max={"m": "v"}, previous={"p": "maybe"},
                      following={"f": "maybe"}, slabs=slabs).toPandas().sort_values("id").reset_index(drop=True)
    want = rows.sort_values(["key", "t", "id"]).assign(maybe=lambda d: d.v.where(d.id % 7 == 0))
    g = want.groupby("key")
    want = want.assign(s=g.w.cumsum(), m=g.v.transform(lambda x: x.cummax().shift()), p=g.maybe.ffill(), f=g.maybe.bfill())
    want = want.sort_values("id").reset_index(drop=True)
    for c in "smpf":
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_without_keys(spark, rows):
    got = prefix_scan(spark.createDataFrame(rows), [], ["t", "id"], sums={"s": "w"}, slabs=16).agg(F.max("s")).first()[0]
    assert got == rows.w.sum()


def test_hot_key_is_spread_over_slabs(spark, rows):
    from emberscan.operators.scan import SLAB, range_slabs
    sizes = range_slabs(spark.createDataFrame(rows), ["key"], ["t", "id"], 16).groupBy(SLAB).count().toPandas()["count"]
    # The hot key holds more than half of the rows, the hot instant a third of them.
    assert len(sizes) > 8 and sizes.max() < 0.25 * len(rows)


@pytest.mark.parametrize("gap", [0.0, 0.7])
def test_islands(spark, rows, gap):
    d = rows.assign(e=rows.t + np.abs(rows.v) * 0.2)
    got = islands(spark.createDataFrame(d), ["key"], "t", "e", "id", gap=gap).toPandas()
    want = d.sort_values(["key", "t", "id"])
    reach = want.groupby("key").e.transform(lambda x: x.cummax().shift())
    opens = reach.isna() | (want.t - reach > gap)
    want = want.assign(island=opens.groupby(want.key).cumsum().astype(int) - 1)
    both = got.merge(want[["id", "island"]], on="id", suffixes=("", "_w"))
    assert (both.island == both.island_w).all()


def test_exact_quantiles(spark, rows):
    qs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows), ["key"], "v", qs).toPandas().sort_values(["key", "q"])
    want = rows.groupby("key").v.quantile(qs)
    np.testing.assert_allclose(got.quantile_value, want.to_numpy(), atol=1e-12)


def test_ranked_positions_collapse_ties(spark, rows):
    got = ranked_positions(spark.createDataFrame(rows), [], "w", descending=True).toPandas().sort_values("w")
    assert list(got.n) == list(rows.w.value_counts().sort_index())
    assert got.n_upto.max() == len(rows) and len(got) == 5


def test_lookup_join_leaves_both_sides_to_be_split(spark, rows):
    df = spark.createDataFrame(rows)
    means = df.groupBy("key").agg(F.avg("v").alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(df, means, ["key"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") >= 3
        assert joined.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
