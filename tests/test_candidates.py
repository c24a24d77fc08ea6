"""Admitted pairs at scale: what is shuffled for them, how their code is compiled, and that results stay the same."""

import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.operators import coincidence as co
from emberscan.operators import rank as rk
from emberscan.operators import slides as sl
from emberscan.plans import registry
from emberscan.plans.queries_coincidence import CONFIG, rank_far

registry.load()


def events(spark, n=60, seed=5, ifo="a"):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        t, k_ = float(rng.uniform(0, 900)), int(rng.integers(0, 40))
        rows.append((seed * 1000 + k, ifo, t, t - 5 - k_ / 2, 10.0 + k_, k_ / 10.0, 0.7 * k_, 1.0 * k_, 1.4 * k_, float(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "id long, ifo string, gpsPeak double, gpsStart double, duration double, tSpread double, freqMin double, "
                                       "freqMean double, freqMax double, EnWDF double")


def longest_method(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue()))


@pytest.mark.parametrize("name", ["interval_candidates", "slides_canonical", "network_slides"])
def test_the_jvm_compiles_what_makes_pairs(spark, folder, name):
    # The JVM never compiles a method of more than 8000 bytes, and interprets it for every pair.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert longest_method(registry.QUERIES[name](spark, folder)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_share_that_is_asked_for_is_still_held_to(spark):
    left, right = events(spark), events(spark, seed=6, ifo="b")
    every = co.candidate_edges(left, right, CONFIG)
    strict = co.CoincidenceConfig(light_travel_time_s=4.0, timing_jitter_s=0.5, minimum_frequency_overlap=0.3, minimum_time_overlap=0.6)
    some = co.candidate_edges(left, right, strict).select("id_l", "id_r").collect()
    assert 0 < len(some) < every.count()
    assert {*some} == {*every.where("frequency_overlap >= 0.3 and time_overlap >= 0.6").select("id_l", "id_r").collect()}


def test_one_copy_of_the_unmoved_events_meets_all_slides(spark):
    left, right = (events(spark, seed=s, ifo=i).withColumn("pair", F.lit("a,b")) for s, i in ((7, "a"), (8, "b")))
    moved = sl.slide_events(right, [30.0, 170.0, 410.0], 0.0, 900.0, "gpsPeak", ["gpsPeak", "gpsStart"])
    keys = ["pair", sl.SLIDE]
    want = co.candidate_edges(sl.replicate(left, 2), moved, CONFIG, (), keys)
    got = co.candidate_edges(sl.replicate(left, 2, written=False), moved, CONFIG, (), keys)
    assert {*got.columns} == {*want.columns}
    rows = lambda df: sorted(df.select(*sorted(df.columns)).collect())
    assert rows(got) == rows(want) and want.count() > 20
    # The left events are copied nowhere.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([0,1])" not in plan and "sequence(0, 1" not in plan


def test_events_of_unknown_or_equal_loudness_are_ranked_like_their_pairs(spark):
    left, right = events(spark, seed=9), events(spark, seed=10, ifo="b")
    left = left.withColumn("EnWDF", F.when(F.col("id") % 5 != 0, F.col("EnWDF")))
    right = right.withColumn("EnWDF", F.when(F.col("id") % 7 != 0, F.col("EnWDF")))
    bg = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 3, 3, 3, 6, 8)] + [(None,)], "s double")
    pairs = co.candidate_edges(left, right, CONFIG).withColumn("s", F.least("EnWDF_l", "EnWDF_r")).withColumn("p", F.concat_ws("-", "id_l", "id_r"))
    want = rk.rank_by_rate(pairs.select("p", "s"), bg, "s", "p", 100.0, 10.0).toPandas().sort_values("p")
    louds = left.unionByName(right).select("EnWDF").distinct()
    ranked = {r["EnWDF"]: r["n_background_ge"] for r in rk.rank_by_rate(louds, bg, "EnWDF", "EnWDF", 100.0, 10.0, "s").collect()}
    assert [ranked[None if s != s else s] for s in want.s] == want.n_background_ge.tolist()
    assert want.s.isna().any()


def test_no_pair_is_shuffled_to_be_ranked(spark, folder):
    plan = rank_far(spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # Above the join that makes the pairs there are only projections.
    above = plan[:next(k for k, line in enumerate(plan) if "Join" in line)]
    assert above and all("Project" in line for line in above)
