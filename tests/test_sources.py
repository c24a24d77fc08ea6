"""Trigger files, sidecars, sample chunks, models and submissions round the file system."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberscan.sources import samples as sm
from emberscan.sources import submission as sub
from emberscan.sources import triggers as tr


def records(n=50, ifo="H1"):
    rng = np.random.default_rng(0)
    return [dict(gps=float(i), gpsStart=float(i), gpsCentroid=i + 0.1, gpsPeak=i + 0.1, tSpread=0.01, duration=0.02, duration90=0.01,
                 EnWDF=float(rng.uniform(3, 9)), sigma=1.0, snrPeak=3.0, freqMin=10.0, freqMean=20.0, freqMax=40.0, freqQ05=11.0,
                 freqQ95=39.0, wave="Haar", n_coeff=64, fs=2048.0, wt_index=[1, 5], wt_value=[2.0, -1.5]) for i in range(n)]


def test_triggers_round_trip(spark, tmp_path):
    df = tr.triggers_from_records(spark, records(), "H1").unionByName(tr.triggers_from_records(spark, records(20), "L1"))
    path = str(tmp_path / "out")
    tr.write_triggers(df, path)
    back = tr.read_triggers(spark, path)
    assert back.count() == 70 and back.where("ifo = 'L1'").count() == 20
    plan = back.where("ifo = 'L1' and n_coeff = 64")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ifo" in plan and "n_coeff" in plan.split("PartitionFilters")[1].split("]")[0]
    columns = [c for c in df.columns if c not in tr.MEASURED]
    assert sorted(map(repr, back.select(columns).collect())) == sorted(map(repr, df.select(columns).collect()))
    (tmp_path / "out" / "parametersUsed-Win64.json").write_text(json.dumps(dict(window=64, overlap=16, sampling=8192, ResamplingFactor=4)))
    assert {r.stride for r in tr.with_stride(back, path).select("stride").collect()} == {48 / 2048}


def test_bad_indices_are_refused(spark, tmp_path):
    bad = records(1)
    bad[0]["wt_index"] = [1, 64]
    with pytest.raises(Exception, match="outside its window"):
        tr.checked(tr.triggers_from_records(spark, bad, "H1")).collect()


def test_foreign_files_with_split_bytes(spark, tmp_path):
    rows = pd.DataFrame(records(10))
    schema = pa.schema([(c, pa.float64()) for c in tr.TIMES] + [(c, pa.float32()) for c in tr.MEASURED] + [
        ("wave", pa.string()), ("n_coeff", pa.uint32()), ("fs", pa.float64()), ("wt_index", pa.list_(pa.uint16())), ("wt_value", pa.list_(pa.float32()))])
    run = tmp_path / "run"
    run.mkdir()
    pq.write_table(pa.Table.from_pandas(rows[schema.names], schema), run / "H1-Win64-a.parquet", compression="zstd",
                   use_dictionary=["wave"], column_encoding={c: "BYTE_STREAM_SPLIT" for c in ("EnWDF", "gps")})
    (run / "parametersUsed-Win64.json").write_text(json.dumps(dict(window=64, overlap=16, sampling=8192, ResamplingFactor=4)))
    got = tr.read_triggers(spark, str(run), "H1", foreign=True)
    assert got.count() == 10 and dict(got.dtypes)["EnWDF"] == "double"
    assert tr.with_stride(got, str(run)).select("stride").distinct().first()[0] == 48 / 2048
    assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "parametersUsed-Win8.json").write_text("{}")
    with pytest.raises(Exception, match="run parameters"):
        tr.with_stride(got, str(empty)).collect()


def test_files_without_coefficients_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="not trigger files"):
        tr.read_triggers(spark, str(tmp_path / "x"))


def test_a_tree_of_runs_is_read_whole_and_pruned_in_every_run(spark, tmp_path):
    base = tmp_path / "o4" / "night"
    for k, (name, n) in enumerate((("run1", 30), ("deep/run2", 20))):
        df = tr.triggers_from_records(spark, records(n), "H1").unionByName(tr.triggers_from_records(spark, records(5), "L1"))
        tr.write_triggers(df, str(base / name))
        (base / name / "parametersUsed-Win64.json").write_text(json.dumps(dict(window=64, overlap=16 * (k + 1), sampling=8192, ResamplingFactor=4)))
    assert [r.rsplit("/", 1)[1] for r in tr.run_folders(spark, [str(tmp_path)])] == ["run2", "run1"]
    back = tr.read_triggers(spark, str(tmp_path))
    assert back.count() == 60 and set(tr.TRIGGER.names) <= set(back.columns)
    some = back.where("ifo = 'L1'")
    assert some.count() == 10
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(ifo") == 2
    strides = tr.with_stride(back, str(tmp_path)).groupBy("stride").count().collect()
    assert {(r.stride, r["count"]) for r in strides} == {(48 / 2048, 35), (32 / 2048, 25)}
    # Both runs, named one by one.
    assert tr.read_triggers(spark, [str(base / "run1"), str(base / "deep" / "run2")]).count() == 60


def test_no_paths_no_files_and_missing_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no trigger file paths"):
        tr.read_triggers(spark, [])
    with pytest.raises(ValueError, match="no trigger files"):
        tr.read_triggers(spark, str(tmp_path))
    bad = tr.triggers_from_records(spark, records(2), "H1").drop("freqMean", "sigma")
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="bad has no column sigma, freqMean"):
        tr.read_triggers(spark, str(tmp_path))


def test_run_parameters(tmp_path):
    path = str(tmp_path / "p.json")
    tr.RunParameters(64, 16, 8192, 4, {"channel": "A"}).dump(path)
    assert tr.RunParameters.load(path) == tr.RunParameters(64, 16, 8192, 4, {"channel": "A"})


def test_samples_and_models(spark, tmp_path):
    c = spark.range(20).select(F.lit("H1").alias("ifo"), F.col("id").alias("chunk"), (F.col("id") * 2.0).alias("t0"), F.lit(2.0).alias("fs"),
                               F.array(*[F.lit(float(i)) for i in range(4)]).alias("samples"))
    sm.write_samples(c, str(tmp_path / "s"))
    assert sm.read_samples(spark, str(tmp_path / "s"), "H1", 5.0, 9.0).select("chunk").distinct().count() == 3
    long_ = c.select("ifo", (F.col("chunk") * 4).alias("b"), F.posexplode("samples").alias("i", "value")).select("ifo", (F.col("b") + F.col("i")).alias("n"), "value")
    with pytest.raises(Exception, match="has a hole"):
        sm.rechunk(long_.where("n <> 17"), 8).collect()
    short = sm.rechunk(long_.where("n < 77"), 8)
    assert sorted(r.n for r in short.select(F.size("samples").alias("n")).collect()) == [5] + [8] * 9
    model = spark.createDataFrame([("H1", 1.0, [1.0, -0.5])], "ifo string, sigma double, poly array<double>")
    sm.save_model(model, str(tmp_path / "m"))
    assert sm.load_model(spark, str(tmp_path / "m")).first().poly == [1.0, -0.5]


def test_waveform_tables(spark, tmp_path):
    (tmp_path / "m15_strains_d1.txt").write_text("# t hp hc\n0.0 1.0 2.0\n0.1 3.0 4.0\n")
    got = sm.waveform_catalogue(spark, str(tmp_path)).first()
    assert (got.model, got.direction) == ("m15", "d1")
    assert sm.read_waveforms(spark, str(tmp_path)).agg(F.sum("h_cross")).first()[0] == 6.0


def test_submission_files(spark, tmp_path):
    t = pd.DataFrame({c: [1.0, 2.0] for c in sub.COLUMNS}).assign(gps_start=[10.0, 30.0], gps_end=[11.0, 31.0])
    seg = spark.createDataFrame([(0.0, 20.0), (25.0, 40.0)], "seg_start double, seg_end double")
    paths = sub.write_submission(str(tmp_path), spark.createDataFrame(t), seg, "o4b-2", "short-0", "ember", "26-12-01")
    lines = sorted(r.value for r in spark.read.text(paths["triggers"]).collect())
    assert lines[0].startswith("10.000000,11.000000,1.000000")
    stray = spark.createDataFrame(t.assign(gps_end=[11.0, 60.0]))
    with pytest.raises(ValueError, match="outside every analysed segment"):
        sub.write_submission(str(tmp_path), stray, seg, "o4b-2", "short-0", "ember", "26-12-01")
    for bad in (("x", "a", "b", "c", "26-12-01"), ("triggers", "A", "b", "c", "26-12-01"), ("triggers", "a", "b", "c_d", "26-12-01"), ("triggers", "a", "b", "c", "2026")):
        with pytest.raises(ValueError):
            sub.submission_name(*bad)
    with pytest.raises(ValueError):
        sub.resolvable_threshold(1e-6, 10.0)
