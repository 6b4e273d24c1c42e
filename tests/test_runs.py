import math

import numpy as np
from pyspark.sql import functions as F

from lagoon import cli
from lagoon.operators import correlate, matrix, transforms
from lagoon.plans import run
from lagoon.series import SeriesFrame
from lagoon.sources import client, store, waveforms

META = {"title": "t", "institution": "i", "author": "a", "source": "s"}


def grid(spark, hole=True):
    rng = np.random.default_rng(3)
    cells = [(r, t, float(v)) for r in ("A", "B", "C") for t, v in enumerate(rng.normal(size=96)) if not (hole and r == "C" and t == 50)]
    df = spark.createDataFrame(cells, "receiver string, t int, v double")
    return correlate.dense_grid(df, df, "receiver", "t", 96, "v", None)


def test_run_resume_and_retry(spark, tmp_path):
    path = str(tmp_path / "xc")
    go = lambda g, **o: run.run(g, "receiver", path, META, first=0, last=96, window=24, step=12, origin="2024-01-01 00:00:00", clip=(-6, 6), **o)
    assert go(grid(spark)) == {"planned": 21, "new": 21, "done": 17, "missing": 4}
    assert go(grid(spark))["new"] == 0
    assert go(grid(spark, False), retry_missing=True) == {"planned": 21, "new": 4, "done": 21, "missing": 0}
    assert store.mfread(spark, [path]).count() == 21


def test_run_gated_by_availability(spark, tmp_path):
    g = grid(spark)
    cells = g.where("v is not null").withColumn("day", F.floor(F.col("t") / 24).cast("int")).withColumn("one", F.lit(1))
    status = waveforms.availability(cells, cells, "receiver", "day", 0, 3, 24, "one").where("day <> 3")
    got = run.run(g, "receiver", str(tmp_path / "xc"), META, first=0, last=96, window=24, step=24, origin="2024-01-01 00:00:00", status=status)
    assert got["planned"] > 0 and got["new"] == got["planned"]


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "xc")
    run.run(grid(spark, False), "receiver", path, META, first=0, last=96, window=24, step=12, origin="2024-01-01 00:00:00")
    out = lambda c, *more: (cli.main([c, "--xc", path, "--out", str(tmp_path / c), "--first", "-23", *more], spark), spark.read.parquet(str(tmp_path / c)))[1]
    assert out("list").count() == 3
    snr = out("snr", "--signal", "-5", "5", "--noise", "10", "23", "--start", "2024-01-01 00:00:00", "--end", "2024-01-03 00:00:00")
    assert 0 < snr.count() < 21 and snr.where("snr is null").count() == 0
    cli.main(["ct", "--xc", str(tmp_path / "snr"), "--out", str(tmp_path / "ct"), "--threshold", "0", "--coincidence", "3", "--step", "43200"], spark)
    assert {r.period for r in spark.read.parquet(str(tmp_path / "ct")).collect()} == {0}
    n = out("psd", "--duration", "16", "--freq-max", "0.5").count()
    assert n == 21 * 33
    assert out("plmax", "--duration", "16", "--freq-max", "0.5", "--distance", "2").count() > 21
    t = out("timelapse", "--duration", "16", "--freq-max", "0.5", "--bands", "0.1,0.3")
    assert t.count() == 3 * 49 and t.where("time1 = time2 and abs(cc2 - 1) > 1e-9").count() == 0
    spark.createDataFrame([("A", 0.0, 0.0), ("B", 10.0, 0.0), ("C", 0.0, 10.0)], "receiver string, x double, y double").write.parquet(str(tmp_path / "geo"))
    assert out("beamform", "--geometry", str(tmp_path / "geo")).where("s_x is not null").count() == 7
    assert out("swresp", "--pair", "A-%").count() == 7 * 24
    swap = t.alias("x").join(t.alias("y"), F.expr("x.pair = y.pair and x.time1 = y.time2 and x.time2 = y.time1 and (x.cc2 <> y.cc2 or x.delta_lag <> -y.delta_lag)"))
    assert swap.count() == 0


def test_source_chain(spark):
    rows = [("N.A..X", 0, 50), ("N.B..X", 0, 100)], [("N.A..X", 0, 100)]
    make = lambda r: spark.createDataFrame([(a, b, c, [float(i) for i in range(c)]) for a, b, c in r], "receiver string, s int, npts int, data array<double>").select("receiver", F.timestamp_add("SECOND", F.col("s"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("starttime"), F.lit(60.0).alias("delta"), "npts", "data")
    c = client.WaveformSource([make(r) for r in rows], max_gap=120.0, operations={"X": [("demean", {})]})
    start, stop = F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.expr("timestamp_ntz'2024-01-01 01:30:00'")
    assert {(r.receiver, r.source, r.npts) for r in c.window("N.%", start, stop, 0.0).collect()} == {("N.A..X", 1, 91), ("N.B..X", 0, 91)}
    p = c.pair("N.A..X-N.B..X", start, stop, 1 / 60, buffer=0.0).first()
    assert abs(sum(p.xa)) < 1e-9 and len(p.xb) == 91
    assert c.pair("N.A..X-N.B..X", start, stop, 1.0).count() == 0
    assert c.verify_processing(["N.A..X", "N.Z..X"], start, stop, 1 / 60) == {"N.A..X": 1, "N.Z..X": 0}
    got = {(r.receiver, str(r.day), r.status) for r in c.verify(make(rows[0]), "2024-01-01", "2024-01-02").collect()}
    assert ("N.A..X", "2024-01-01", 0) in got and ("N.B..X", "2024-01-02", -1) in got and "tables" in str(c)


def test_discovery(spark):
    t = spark.createDataFrame([("N.A..BHZ-N.B..BHZ",), ("N.A..BHR-N.B..BHZ",)], "pair string")
    assert client.discover_pairs(t, "N.A%").count() == 2 and client.discover_pairs(t, "%", "BHZ").count() == 1
    inv = spark.createDataFrame([("N.A..BH1",), ("N.A..BHZ",), ("N.B..BHZ",), ("N.C..BHZ",)], "receiver string")
    assert client.inventory_of(t, inv).count() == 3


def test_fluent_operators(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 9))
    df = spark.createDataFrame([(i, "g", r.tolist()) for i, r in enumerate(x)], "i int, g string, x array<double>")
    s = SeriesFrame(df, "x")
    assert np.allclose([r.x for r in s.fft().ifft().df.orderBy("i").collect()], x)
    assert np.allclose([r.x for r in s.rfft().irfft(9).df.orderBy("i").collect()], x)
    n = s.norm2d(["i", "g"], ["g"])
    assert abs(n.agg(F.sum(F.col("v") ** 2)).first()[0] - 1) < 1e-12
    assert s.window().first().window[4] == 1.0 and len(s.unbias_weights(9).first().weights) == 9
    assert s.lombscargle(["i"], [0.1, 0.2]).count() == 8
    hits = s.coincidence_trigger("i", thr_on=-99.0, coincidence=4)
    assert hits.count() == 9
    z = transforms.spectrogram(df, ["i"], "x", 1.0, 16.0)
    assert z.count() == 4 * 17 and SeriesFrame(z, "psd").peak_local_max(["i"]).count() == 0
    shifted = spark.createDataFrame([("p", "q", np.eye(1, 9, 6)[0].tolist())], "rx_a string, rx_b string, x array<double>").withColumn("t", F.lit(0))
    geo = spark.createDataFrame([("p", "q", 1.0, 0.0)], "rx_a string, rx_b string, dx double, dy double")
    assert SeriesFrame(shifted, "x").plane_wave_estimate(geo, ["t"]).first().s_x is None  # one couple has no plane
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 9.0), (1, 1, 3.0)], "a int, b int, v double")
    got = {(r.a, r.b): r.v for r in SeriesFrame(cells, "v").tri_mirror([], "a", "b", odd=True).collect()}
    assert got == {(0, 0): 1, (1, 0): 2, (0, 1): -2, (1, 1): 3} and matrix.tri_mask(2, 1) and math.isclose(1, 1)
