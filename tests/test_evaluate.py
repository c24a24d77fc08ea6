"""Ranking, calibration, injections, slides, the sky and learned scores on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberscan.functions import geometry as geo
from emberscan.operators import clean
from emberscan.operators import evaluate as ee
from emberscan.operators import learn
from emberscan.operators import rank as rk
from emberscan.operators import slides as sl
from emberscan.operators import sky as sk
from emberscan.operators.coincidence import CoincidenceConfig, network_candidates, network_edges, legacy_window
from emberscan.operators.components import component_labels, spanning_edges
from emberscan.plans import pipelines as pl
from tests_support import labels_of


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_count_at_or_above_counts_ties(spark):
    fg = frame(spark, id=[1, 2, 3, 4], s=[0.5, 2.0, 3.0, 9.0])
    bg = frame(spark, s=[1.0, 2.0, 2.0, 3.0])
    got = rk.count_at_or_above(fg, bg, "s", "id").toPandas().set_index("id").n_background_ge
    assert got.sort_index().to_list() == [4, 3, 1, 0]


def test_rates_of_an_empty_background(spark):
    fg = frame(spark, id=[1, 2], s=[1.0, 2.0])
    got = rk.rank_by_rate(fg, fg.limit(0).select("s"), "s", "id", 100.0, 50.0).toPandas()
    assert (got.far_hz == 0.01).all() and np.allclose(got.fap, 1 - np.exp(-0.5))


def test_background_calibrated_on_itself_is_unit_exponential(spark):
    rng = np.random.default_rng(0)
    size = rng.integers(1, 25, 20000)
    x = pd.DataFrame(dict(id=np.arange(20000), size=size, stat=np.sqrt(size) * rng.chisquare(8, 20000) / 8))
    df = spark.createDataFrame(x)
    s = rk.event_significance(df, df, "stat", "size", "id").toPandas().significance
    assert s.mean() == pytest.approx(1.0, abs=0.03) and (s > 3).mean() == pytest.approx(np.exp(-3), abs=0.005)
    bins = rk.size_bins(df, "size", 900).toPandas().sort_values("bin")
    counts = [((size >= a) & ((size < b) if b == b else True)).sum() for a, b in zip(bins.edge_lo, bins.edge_hi)]
    assert min(counts) >= 900 and sum(counts) == 20000


def test_thresholds_say_when_they_cannot_be_measured(spark):
    bg = frame(spark, s=np.arange(1.0, 101.0))
    got = rk.threshold_at_far(bg, "s", 10.0, [0.05, 1.0, 20.0]).toPandas().set_index("far_per_day")
    assert not got.measurable[0.05] and np.isnan(got.threshold[0.05])
    assert got.threshold[1.0] == 91.0 and got.threshold[20.0] == -np.inf


def test_injections_are_matched_to_the_loudest_that_covers_them(spark):
    cand = frame(spark, id=[10, 11, 12], gpsPeak=[5.0, 6.0, 50.0], gpsStart=[0.0, 5.5, 50.0], duration=[10.0, 1.0, 0.0], EnWDF=[4.0, 9.0, 5.0])
    inj = frame(spark, injection_id=[1, 2, 3], inj_gps=[5.2, 0.1, 49.4], network_snr=[1.0, 2.0, 3.0])
    got = ee.match_injections(cand, inj, 0.5).toPandas().set_index("injection_id")
    assert got.candidate_index[1] == 11 and got.candidate_index[2] == 10
    assert not got.found[3] and got.candidate_index[3] == -1 and np.isnan(got.recovered_snr[3])
    assert ee.false_alarms(cand, inj, 0.5).toPandas().id.to_list() == [12]
    assert ee.unclaimed(cand, inj.limit(0), 0.5, statistic="EnWDF", limit=2).toPandas().id.to_list() == [11, 12]
    with pytest.raises(KeyError):
        ee.unclaimed(cand, inj, statistic="nothing")


def test_one_value_of_every_score_has_a_curve(spark):
    pos, neg = frame(spark, s=[1.0, 1.0]), frame(spark, s=[1.0])
    curve = ee.roc_curve(pos, neg, "s", 10).toPandas()
    assert (curve.tpr == 1).all() and (curve.fpr == 1).all()


def test_roc_of_separated_scores_is_one(spark):
    auc = ee.roc_auc(ee.roc_curve(frame(spark, s=np.arange(10.0, 20.0)), frame(spark, s=np.arange(0.0, 9.0)), "s")).first().auc
    assert auc == pytest.approx(1.0)


def test_shifts_are_reproducible_and_apart():
    a, b = sl.draw_shifts(20, 2, 1000.0, 50.0, 7), sl.draw_shifts(20, 2, 1000.0, 50.0, 7)
    assert a == b and all(abs(x - y) >= 50.0 and min(abs(x), abs(y)) >= 50.0 for x, y in a)
    with pytest.raises(ValueError):
        sl.draw_shifts(1, 1, 3.0, 2.0)


def test_a_slide_moves_an_event_as_a_whole(spark):
    e = frame(spark, id=[1], gpsCentroid=[95.0], gpsStart=[90.0], gpsEnd=[101.0])
    row = sl.slide_events(e, [10.0], 0.0, 100.0, "gpsCentroid", ["gpsCentroid", "gpsStart", "gpsEnd"]).first()
    assert (row.gpsCentroid, row.gpsStart, row.gpsEnd) == (5.0, 0.0, 11.0)
    torn = sl.slide_events_by_column(e, [10.0], 0.0, 100.0, ["gpsStart", "gpsEnd"]).first()
    assert (torn.gpsStart, torn.gpsEnd) == (0.0, 11.0) or torn.gpsStart > torn.gpsEnd


def test_a_common_signal_stands_above_its_slides(spark):
    rng = np.random.default_rng(3)
    def detector(name, shift):
        n = 150
        t = np.concatenate([rng.uniform(0, 3600, n), np.array([700.0, 1900.0, 3000.0]) + shift])
        e = np.concatenate([rng.gamma(2, 1.8, n) + 4, [40.0, 45.0, 50.0]])
        return frame(spark, id=np.arange(n + 3), ifo=[name] * (n + 3), gpsPeak=t, gpsCentroid=t, gpsStart=t - 0.01, duration=np.full(n + 3, 0.02),
                     tSpread=np.full(n + 3, 0.003), freqMin=np.full(n + 3, 50.0), freqMean=np.full(n + 3, 150.0), freqMax=np.full(n + 3, 250.0), EnWDF=e)
    finder = pl.one_to_one_finder(CoincidenceConfig(), ("H1", "L1"))
    got = pl.search_with_background(detector("H1", 0.0), detector("L1", 0.004), finder, 0.0, 3600.0, n_slides=20).toPandas()
    top = got.sort_values("far_hz").head(3)
    assert set(top.id_a) == {150, 151, 152} and (top.n_background_ge == 0).all()


def test_network_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    n = 240
    e = pd.DataFrame(dict(id=np.arange(n), ifo=rng.choice(["H1", "L1", "V1"], n), gpsPeak=np.round(rng.uniform(0, 900, n), 3), EnWDF=rng.uniform(1, 9, n)))
    windows = {("H1", "L1"): 2.0, ("H1", "V1"): 5.0, ("L1", "V1"): 4.0}
    df = spark.createDataFrame(e)
    got = component_labels(network_edges(df, windows)).toPandas().set_index("vertex").component
    pairs = [(i, j) for i in range(n) for j in range(i) if e.ifo[i] != e.ifo[j]
             and abs(e.gpsPeak[i] - e.gpsPeak[j]) <= windows[tuple(sorted((e.ifo[i], e.ifo[j])))]]
    want = labels_of(n, pairs)
    assert all(got.get(i, i) == want[i] for i in range(n))
    c = network_candidates(df, ["H1", "L1", "V1"], windows, min_ifos=3).toPandas()
    assert (c.n_ifos == 3).all() and set(c.ifos_involved) <= {"H1,L1,V1"}


def test_network_edges_are_contracted_where_they_are_made(spark):
    n = 600
    df = spark.createDataFrame([(k, ("H1", "L1", "V1")[k * k % 7 % 3], 0.5 * k) for k in range(n)], "id long, ifo string, gpsPeak double")
    edges = network_edges(df, {("H1", "L1"): 9.0, ("H1", "V1"): 9.0, ("L1", "V1"): 9.0}).select(F.col("dst").alias("u"), F.col("src").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spanning_edges(edges).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # One link an event, and a few at the borders of the tasks.
    assert left <= n + 100


def test_geometry():
    assert geo.light_travel_time("H1", "L1") == pytest.approx(0.010012846, abs=1e-7)
    assert geo.network_light_travel_time(["H1", "V1", "L1", "X9"]) == pytest.approx(geo.light_travel_time("H1", "V1"))
    assert geo.network_light_travel_time(["H1"]) == 0.0
    assert legacy_window("H1", "L1") == pytest.approx(0.030012846, abs=1e-7)
    with pytest.raises(KeyError):
        geo.light_travel_time("H1", "X9")
    c = CoincidenceConfig()
    assert c.between(("H1", "L1")).cap_s == pytest.approx(2.5 * geo.light_travel_time("H1", "L1"))


def test_skies_are_ranked_where_they_are(spark, monkeypatch):
    from emberscan.operators import scan
    monkeypatch.setattr(sk, "SKY_ROWS", 100)
    monkeypatch.setattr(scan, "cut_lineage", lambda df: pytest.fail("the sky was written"))
    rows = [(c, i, 1000.0 * c + t, 0.002) for c in range(20) for i, t in (("H1", 0.0), ("L1", 0.001))]
    sky = sk.localise(spark.createDataFrame(rows, "candidate_id long, ifo string, gps double, spread double"), 24, 12)
    assert sky.rdd.getNumPartitions() == 58 and sky.count() == 20 * 288
    weights = sky.toPandas().sort_values(["weight", "cell"], ascending=[False, True]).groupby("candidate_id").weight
    want = {c: int((w.cumsum() < 0.9).sum()) + 1 for c, w in weights}
    got = sk.credible_area(sky)
    assert dict(got.select("candidate_id", "n_cells").toPandas().to_numpy()) == want


def test_sky_regions_cover_the_truth(spark):
    rng = np.random.default_rng(6)
    rows, truth = [], []
    for cid in range(20):
        ra, dec, gps = rng.uniform(0, 2 * np.pi), np.arcsin(rng.uniform(-1, 1)), 1.26e9 + cid * 997
        h = ra - (geo.GMST_AT_GPS_EPOCH + geo.SIDEREAL_RATE * gps) % (2 * np.pi)
        u = np.array([np.cos(dec) * np.cos(h), np.cos(dec) * np.sin(h), np.sin(dec)])
        truth.append((cid, float(ra), float(dec)))
        for ifo in ("H1", "L1", "V1"):
            rows.append((cid, ifo, float(gps - u @ np.array(geo.SITES[ifo]) / geo.SPEED_OF_LIGHT + rng.normal(0, 5e-4)), 1e-3))
    sky = sk.localise(spark.createDataFrame(rows, "candidate_id long, ifo string, gps double, spread double"), 72, 36).persist()
    assert sky.groupBy("candidate_id").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").count() == 0
    inside = sk.contains(sky, spark.createDataFrame(truth, "candidate_id long, ra_true double, dec_true double")).toPandas().inside
    assert inside.mean() >= 0.85
    area = sk.credible_area(sky).toPandas().area_deg2
    assert area.between(1, 20000).all()


def test_schedules_and_schema_guards(spark):
    assert clean.window_schedule([64, 128], 16) == [(64, 16), (128, 16)]
    for bad in (([64], [64]), ([64, 128], [1])):
        with pytest.raises(ValueError):
            clean.window_schedule(*bad)
    with pytest.raises(KeyError):
        clean.ensure_statistic(frame(spark, a=[1]))
    nan = frame(spark, id=[1, 2, 3], gpsPeak=[1.0, np.nan, 3.0], EnWDF=[1.0, 2.0, np.inf], sigma=[1.0, 1.0, 1.0])
    assert clean.clean_triggers_robust(nan, "id").toPandas().id.to_list() == [1]
    with pytest.raises(Exception):
        clean.temporal_split(frame(spark, gps_candidate=[1.0, 1.0])).collect()


def test_window_lengths_and_energy_fallback(spark):
    one = frame(spark, id=[1, 2], n_coeff=[64, 64], EnWDF=[3.0, 4.0])
    assert clean.single_window_length(one).count() == 2
    with pytest.raises(Exception, match="mix window lengths"):
        clean.single_window_length(frame(spark, id=[1, 2], n_coeff=[64, 128])).collect()
    assert [r.e for r in one.select(clean.coefficient_energy(one).alias("e")).collect()] == [9.0, 16.0]


def test_logistic_baseline_and_anomaly(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 400
    y = rng.integers(0, 2, n)
    df = frame(spark, label=y, a=y * 2.0 + rng.normal(0, 0.5, n), b=np.where(rng.random(n) < 0.05, np.nan, rng.normal(size=n)))
    model = learn.LogisticBaseline(["a", "b"]).fit(df)
    scored = model.score(df).toPandas()
    assert ((scored.baseline_score > 0.5) == scored.label).mean() > 0.95
    model.save(str(tmp_path / "m"))
    again = learn.LogisticBaseline.load(str(tmp_path / "m"), ["a", "b"]).score(df).toPandas()
    np.testing.assert_allclose(np.sort(again.baseline_logit), np.sort(scored.baseline_logit))
    with pytest.raises(ValueError):
        learn.LogisticBaseline(["a", "b"]).fit(df.where("label = 1"))
    with pytest.raises(KeyError):
        learn.LogisticBaseline(["a", "nothing"]).fit(df)
    with pytest.raises(RuntimeError):
        learn.LogisticBaseline(["a"]).score(df)
    line = frame(spark, a=np.linspace(-1, 1, 200), b=np.linspace(-2, 2, 200) + rng.normal(0, 0.01, 200))
    odd = learn.BackgroundAnomaly(["a", "b"], 1).fit(line).score(frame(spark, a=[0.5, 0.5], b=[1.0, -1.0])).toPandas().anomaly_score
    assert odd[1] > 100 * odd[0]


def test_message_passing_is_symmetric_and_respects_the_mask(spark):
    rng = np.random.default_rng(2)
    nodes = frame(spark, id=np.arange(60), f=rng.normal(size=60))
    e = pd.DataFrame(dict(src=rng.integers(0, 60, 200), dst=rng.integers(0, 60, 200), w=rng.normal(size=200)))
    e["label"] = (e.w > 0).astype(int)
    edges = spark.createDataFrame(e)
    s = learn.MessagePassingScorer(["f"], ["w"], hidden=6).fit(nodes, edges, edges, mask=F.col("src") != F.col("dst"))
    a = s.score(nodes, edges, edges).toPandas().set_index(["src", "dst", "w"]).gnn_score
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "label")
    b = s.score(nodes, edges, flipped).toPandas().set_index(["dst", "src", "w"]).gnn_score
    np.testing.assert_allclose(a.sort_index().to_numpy(), b.sort_index().to_numpy(), atol=1e-9)


def test_pairs_are_labelled_without_being_shuffled(spark):
    from emberscan.operators import coincidence as co
    from emberscan.operators.rangejoin import cross_pairs
    from emberscan.plans.queries_coincidence import IFOS
    from emberscan.plans.queries_evaluate import labelled_pairs
    schema = "id long, ifo string, gps double, gpsStart double, gpsEnd double, gpsPeak double, duration double"
    rows = [(k, IFOS[k % 3], 7.0 * k, 7.0 * k - 2, 7.0 * k + 2, 7.0 * k, 4.0) for k in range(60)] + [(None, "click", 50.0, 48.0, 52.0, 50.0, 4.0)]
    truth = spark.createDataFrame([(1, 45.0), (2, 200.0), (3, 210.0)], "injection_id long, inj_gps double")

    def joined(t):
        sides = co.by_detector_pair(t.select("ifo", "id", "gps"), IFOS)
        pairs = cross_pairs(*sides, "gps", "gps", 20.0, ["pair"]).select(F.col("id_l").alias("src"), F.col("id_r").alias("dst"))
        return ee.edge_labels(pairs, ee.covered_injection(t, truth, 20.0))

    key = lambda df: sorted(map(repr, df.select("src", "dst", "label").collect()))
    # Alone, and with an id that is held by two events.
    for more in ([], [(5, "view", 201.0, 199.0, 203.0, 201.0, 4.0)]):
        t = spark.createDataFrame(rows + more, schema)
        got = labelled_pairs(t, truth, 20.0)
        assert key(got) == key(joined(t)) and {r.label for r in got.collect()} == {0, 1}
    plan = labelled_pairs(spark.createDataFrame(rows, schema), truth, 20.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
