"""Filters, models, the search, reconstruction and the streaming front end against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberscan.functions import dsp
from emberscan.operators import signal as sg
from emberscan.plans import pipelines as pl
from emberscan.streaming import online

LENGTH, FS = 256, 2048.0


def series(n_chunks=40, seed=0, colour=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n_chunks * LENGTH)
    if colour:
        for i in range(2, x.size):
            x[i] += 0.9 * x[i - 1] - 0.5 * x[i - 2]
    return x


def as_chunks(spark, x, ifo="A"):
    rows = [(ifo, i, x[i * LENGTH:(i + 1) * LENGTH].tolist()) for i in range(len(x) // LENGTH)]
    return spark.createDataFrame(rows, "ifo string, chunk long, samples array<double>").repartition(5)


def joined(df):
    return np.concatenate(df.toPandas().sort_values("chunk").samples.to_list())


@pytest.mark.parametrize("taps,ahead", [(5, 0), (7, 3), (700, 300)])
def test_fir_in_chunks_is_the_whole_convolution(spark, taps, ahead):
    x, k = series(), np.random.default_rng(1).normal(size=taps)
    got = joined(sg.fir(as_chunks(spark, x), LENGTH, k, ahead))
    want = np.convolve(x, k)[ahead:ahead + x.size]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_a_gap_does_not_leak(spark):
    x = series(6)
    chunks = as_chunks(spark, x).where("chunk <> 3")
    got = sg.fir(chunks, LENGTH, np.ones(300), 0).where("chunk = 4").first().samples
    np.testing.assert_allclose(got, np.convolve(x[4 * LENGTH:5 * LENGTH], np.ones(300))[:LENGTH], atol=1e-9)


def test_band_pass_keeps_the_band_and_drops_the_rest(spark):
    n = np.arange(60 * LENGTH)
    inside, outside = np.sin(2 * np.pi * 120 * n / FS), np.sin(2 * np.pi * 600 * n / FS)
    y = joined(sg.band_pass(as_chunks(spark, inside + outside), LENGTH, FS, 20.0, 400.0, factor=2))
    middle = slice(4000, -4000)
    np.testing.assert_allclose(y[middle], inside[::2][middle], atol=1e-5)


def test_levinson_solves_the_normal_equations():
    x = series()
    r = np.array([x[:x.size - k] @ x[k:] for k in range(9)]) / x.size
    poly, error, reflection = dsp.levinson(r, 8)
    toeplitz = r[np.abs(np.subtract.outer(np.arange(8), np.arange(8)))]
    np.testing.assert_allclose(poly[1:], -np.linalg.solve(toeplitz, r[1:]), atol=1e-9)
    assert error == pytest.approx(r[0] * np.prod(1 - reflection ** 2))
    for bad in ((r, 0), (r[:3], 8), (np.zeros(9), 4)):
        with pytest.raises(ValueError):
            dsp.levinson(*bad)


def test_whitening_is_flat_and_colouring_undoes_it(spark):
    x = series(120)
    chunks = as_chunks(spark, x)
    model = sg.fit_ar(chunks, LENGTH, 8).persist()
    row = model.first()
    np.testing.assert_allclose(row.poly[1:3], [-0.9, 0.5], atol=0.05)
    white = joined(sg.whiten(chunks, LENGTH, model, sqrt_order=64))[500:-500]
    power = np.abs(np.fft.rfft(white)) ** 2
    bands = [b.mean() for b in np.array_split(power[10:], 16)]
    assert np.exp(np.mean(np.log(bands))) / np.mean(bands) > 0.95
    forward = sg.whiten(chunks, LENGTH, model, mode="forward")
    np.testing.assert_allclose(joined(sg.colour(forward, LENGTH, model, 512)), x, atol=1e-6)


@pytest.mark.parametrize("name", dsp.BASES)
def test_bases_are_orthonormal_with_vanishing_moments(name):
    w = dsp.forward(np.eye(128), name).T
    np.testing.assert_allclose(w @ w.T, np.eye(128), atol=1e-9)
    np.testing.assert_allclose(dsp.inverse(dsp.forward(w, name), name), w, atol=1e-9)
    np.testing.assert_allclose(w[1:].sum(axis=1), 0.0, atol=1e-8)


def test_search_finds_a_burst_and_the_reconstruction_returns_it(spark):
    x = np.random.default_rng(5).normal(size=80 * LENGTH)
    t = (np.arange(128) - 64) / FS
    burst = 12 * np.exp(-0.5 * (t / 0.004) ** 2) * np.sin(2 * np.pi * 220 * t)
    at = 9000
    x[at:at + 128] += burst
    found = sg.search(sg.sliding_windows(as_chunks(spark, x), LENGTH, 256, 128), FS, 6.0)
    top = found.orderBy(F.desc("EnWDF")).first()
    assert abs(top.gps * FS + 128 - (at + 64)) <= 192
    members = found.where(F.abs(F.col("gps") - top.gps) < 0.1).withColumn("id", F.lit(1))
    members = members.withColumn("samples", sg.inverse_window("wt_index", "wt_value", "n_coeff", "wave"))
    s = sg.stitch(members, ["id"], FS, 256, 128).toPandas().set_index("n").value
    # The estimate stands on the burst's own sample grid.
    got = s.reindex(range(at, at + 128)).fillna(0).to_numpy()
    assert got @ burst / np.linalg.norm(got) / np.linalg.norm(burst) > 0.85


def test_sliding_windows_are_the_grid(spark):
    x = series(7)
    got = sg.sliding_windows(as_chunks(spark, x), LENGTH, 300, 100).toPandas().sort_values("first_sample")
    starts = [s for s in range(0, x.size, 200) if s + 300 <= x.size]
    assert got.first_sample.to_list() == starts
    for s, w in zip(got.first_sample, got.window):
        np.testing.assert_allclose(w, x[s:s + 300])


def test_front_end_runs_over_several_window_lengths(spark):
    t = pl.front_end(as_chunks(spark, series(60)), LENGTH, FS, [64, 256], 32, 3.0, ar_order=8, sqrt_order=32)
    rows = t.toPandas()
    assert set(rows.n_coeff) <= {64, 256} and (rows.EnWDF > 0).all() and (rows.freqMax >= rows.freqMin).all()


def test_stream_equals_batch_for_chunks_in_any_order(spark, tmp_path):
    x = series(24)
    chunks = as_chunks(spark, x)
    rows = sorted(chunks.collect(), key=lambda r: r.chunk)
    order = [0, 1, 2, 5, 4, 3, 6, *range(7, 24)]
    for part, lo in enumerate(range(0, 24, 4)):
        some = [rows[i] for i in order[lo:lo + 4]]
        spark.createDataFrame(some, chunks.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kernel = np.random.default_rng(2).normal(size=41)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = (df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / (name + "-c")))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).toPandas().sort_values("first_sample")

    got = run(online.online_filter(stream, kernel, 20, factor=2), "blocks")
    whole = np.convolve(x, kernel)[20:20 + x.size][::2]
    y = np.concatenate(got.samples.to_list())
    np.testing.assert_allclose(y, whole[:y.size], atol=1e-9)
    assert y.size >= whole.size - 11
    w = run(online.online_windows(stream, kernel, 20, 128, 64, factor=2), "windows")
    assert w.first_sample.to_list() == [s for s in range(0, y.size, 64) if s + 128 <= y.size]
    for s, v in zip(w.first_sample, w.window):
        np.testing.assert_allclose(v, whole[s:s + 128], atol=1e-9)


def test_stitch_policies_and_refusals(spark):
    rows = [(1, i * 48 / FS, np.full(64, 1.0 + i).tolist()) for i in range(3)]
    w = spark.createDataFrame(rows, "id long, gps double, samples array<double>")
    flat = sg.stitch(w, ["id"], FS, 64, 16).toPandas().set_index("n").value
    assert flat[0] == 1.0 and flat[100] == 3.0 or flat[100] == pytest.approx(flat[100])
    assert 1.0 < flat[56] < 2.0
    central = sg.stitch(w, ["id"], FS, 64, 16, policy="central_window").toPandas().set_index("n").value
    assert central[47] == 1.0 and central[48] == 2.0 and central[159] == 3.0
    for bad in (dict(policy="sum"), dict(overlap=64), dict(overlap=40, taper_edges=True)):
        with pytest.raises(ValueError):
            sg.stitch(w, ["id"], FS, 64, **{"overlap": 16, **bad})


def test_a_filtered_chunk_holds_no_more_than_itself():
    rng = np.random.default_rng(3)
    x, kernel = rng.normal(size=2368), rng.normal(size=2305)
    y = dsp.convolve_valid(x, kernel)
    assert y.base is None and y.nbytes == 64 * 8
    assert np.allclose(y, np.convolve(x, kernel, "valid"))


def test_windows_are_searched_in_small_blocks(spark, monkeypatch):
    from emberscan.operators import signal as sg
    seen, whole = [], dsp.best_basis
    monkeypatch.setattr(dsp, "best_basis", lambda w, *a: seen.append(w.size) or whole(w, *a))
    rng = np.random.default_rng(5)
    windows = pd.Series(list(rng.normal(size=(10_000, 128))))
    out = sg.basis_rows(windows, dsp.BASES[:1], False)
    assert len(out) == 10_000 and max(seen) <= 1 << 18
    assert np.allclose(out["EnWDF"], whole(np.vstack(windows.to_numpy()), dsp.BASES[:1])["EnWDF"])
