"""Range joins against dense matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberscan.operators import rangejoin as rj


@pytest.fixture(scope="module")
def two():
    rng = np.random.default_rng(5)
    a = pd.DataFrame(dict(id=np.arange(700), t=rng.uniform(0, 300, 700), d=rng.exponential(0.3, 700) ** 3))
    b = pd.DataFrame(dict(rid=np.arange(600), rt=rng.uniform(-5, 300, 600), rd=rng.exponential(1, 600) ** 3))
    a.loc[:199, "t"] = 77.25
    b.loc[:99, "rt"] = 77.5
    a.loc[0, "d"], b.loc[0, "rd"] = 400.0, 0.0
    return a.assign(e=a.t + a.d), b.assign(re=b.rt + b.rd)


def pairs(df, l="id_l", r="rid_r"):
    got = df.select(l, r).toPandas()
    assert not got.duplicated().any()
    return set(map(tuple, got.to_numpy()))


def test_cross_pairs(spark, two):
    a, b = two
    got = pairs(rj.cross_pairs(spark.createDataFrame(a), spark.createDataFrame(b), "t", "rt", 0.8))
    dt = b.rt.to_numpy()[None] - a.t.to_numpy()[:, None]
    assert got == set(zip(*np.nonzero(np.abs(dt) <= 0.8)))


def test_neighbour_pairs_cost_is_the_pairs(spark):
    grid = spark.range(20000).withColumn("t", F.col("id") * 0.01)
    assert rj.neighbour_pairs(grid, "t", "id", 0.045).count() == 4 * 20000 - 10


@pytest.mark.parametrize("finest", [-12, -4, 3])
def test_overlap_join(spark, two, finest):
    a, b = two
    got = pairs(rj.overlap_join(spark.createDataFrame(a), spark.createDataFrame(b), ("t", "e"), ("rt", "re"), finest=finest))
    met = (a.t.to_numpy()[:, None] <= b.re.to_numpy()[None]) & (b.rt.to_numpy()[None] <= a.e.to_numpy()[:, None])
    assert got == set(zip(*np.nonzero(met)))


def test_one_long_interval_covers_two_cells(spark):
    short = spark.range(1000).select("id", F.col("id").cast("double").alias("lo"), (F.col("id") + 0.5).alias("hi"))
    long_ = spark.createDataFrame([(1, 0.0, 1e9)], "rid long, lo double, hi double")
    joined = rj.overlap_join(short, long_, ("lo", "hi"), ("lo", "hi"))
    assert joined.count() == 1000
    level = rj._level(F.lit(0.0), F.lit(1e9), -4)
    assert spark.range(1).select(F.size(rj._cells(F.lit(0.0), F.lit(1e9), level))).first()[0] <= 2


def test_nearest_within_counts_and_ties(spark, two):
    a, b = two
    got = rj.nearest_within(spark.createDataFrame(a), spark.createDataFrame(b), "t", "rt", 1.0, "id", "rid").select(
        "l.id", "r.rid", "n_matches").toPandas().set_index("id").sort_index()
    for i, t in zip(a.id, a.t):
        near = b[(b.rt >= t - 1.0) & (b.rt <= t + 1.0)]
        if near.empty:
            assert i not in got.index
            continue
        best = near.assign(x=(near.rt - t).abs()).sort_values(["x", "rt", "rid"]).iloc[0]
        assert got.loc[i, "n_matches"] == len(near) and got.loc[i, "rid"] == best.rid


def test_count_inside_and_as_of(spark, two):
    a, b = two
    spans, points = spark.createDataFrame(a), spark.createDataFrame(b)
    got = rj.count_inside(spans, points, ("t", "e"), "rt", "id").toPandas().set_index("id").n_inside
    want = [(b.rt.between(t, e)).sum() for t, e in zip(a.t, a.e)]
    assert (got.sort_index().to_numpy() == np.array(want)).all()
    table = points.select(F.col("rt").alias("at"), F.col("rt").alias("v")).distinct()
    seen = rj.as_of(spans, table, "t", "at", "v", "id").toPandas().set_index("id").sort_index()
    ref = np.unique(b.rt)
    slot = np.searchsorted(ref, a.t, side="right")
    np.testing.assert_allclose(seen.before.fillna(-1), [ref[s - 1] if s else -1 for s in slot])
    np.testing.assert_allclose(seen.after.fillna(-1), [ref[s] if s < len(ref) else -1 for s in slot])


def test_empty_sides(spark, two):
    a, b = two
    none = spark.createDataFrame(b).limit(0)
    assert rj.nearest_within(spark.createDataFrame(a), none, "t", "rt", 1.0, "id", "rid").count() == 0
    assert rj.cross_pairs(spark.createDataFrame(a), none, "t", "rt", 1.0).count() == 0
    assert rj.overlap_join(spark.createDataFrame(a), none, ("t", "e"), ("rt", "re")).count() == 0


def test_lengths_of_one_order_share_a_level(spark):
    spans = spark.range(10, 131).select(F.lit(0.0).alias("lo"), F.col("id").cast("double").alias("hi"))
    levels = spans.select(rj._level(F.col("lo"), F.col("hi"), -4).alias("lv")).distinct()
    assert levels.count() <= 2
    cells = spans.select(F.size(rj._cells(F.col("lo"), F.col("hi"), rj._level(F.col("lo"), F.col("hi"), -4))).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 2


def test_nearest_within_over_more_slabs_than_partitions(spark, two, monkeypatch):
    from emberscan.operators import scan
    a, b = two
    near = lambda: rj.nearest_within(spark.createDataFrame(a), spark.createDataFrame(b), "t", "rt", 1.0, "id", "rid").select(
        "l.id", "r.rid", "n_matches")
    want = near().toPandas().sort_values("id").to_numpy().tolist()
    monkeypatch.setattr(scan, "SLAB_ROWS", 100)
    assert scan.slabs_for(spark, 3 * len(a) + len(b)) == 27 and scan.slabs_for(spark, 100) == 8
    got = near()
    assert got.rdd.getNumPartitions() == 27
    assert got.toPandas().sort_values("id").to_numpy().tolist() == want
