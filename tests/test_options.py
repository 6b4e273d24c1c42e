"""Metadata, validation gates, table hashes, wavelets and test runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import lagoon
from lagoon.functions import hashing, metadata
from lagoon.kernels import fourier, spectral
from lagoon.operators import correlate, transforms
from lagoon.plans import run
from lagoon.series import SeriesFrame
from lagoon.sources import operations, store

META = {"title": "t", "institution": "i", "author": "a", "source": "s"}


def test_global_attributes_and_versions():
    got = metadata.global_attrs({"title": "x", "author": "me", "own": 1})
    assert got["title"] == "x" and got["institution"] == "n/a" and got["lagoon_version"] == lagoon.__version__ and "own" not in got and got["history"].startswith("Created @ ")
    assert metadata.global_attrs({"own": 1}, conventions_only=False)["own"] == 1
    assert set(metadata.list_versions(False)) == {"numpy", "pandas", "pyarrow", "pyspark"} and "numpy-" in metadata.list_versions()


@pytest.mark.parametrize("n", [8, 9])
def test_axis_attributes_come_back(n):
    axis = {"name": "lag", "first": -1.5, "delta": 0.02, "n": n, "units": "s"}
    freq = metadata.transformed_axis(axis)
    assert np.allclose(freq["first"] + freq["delta"] * np.arange(n), np.fft.fftshift(np.fft.fftfreq(n, 0.02)))
    assert metadata.restored_axis(freq) == axis


def test_validation_gates():
    recipes = operations.operations_to_json({"BHZ": [["merge", {}]]})
    plain = META | {"preprocess": recipes, "lagoon_version": "1"}
    meta = plain | {"sha256_hash_metadata": hashing.hash_object(plain)}
    digest = operations.operations_to_dict(recipes)["sha256_hash"]
    assert store.validate(meta, preprocess_hash=digest, version="1")
    assert not store.validate(meta, preprocess_hash="0" * 64) and not store.validate(meta, version="2")
    wrong = plain | {"preprocess": recipes.replace("merge", "demean")}
    assert not store.validate(wrong | {"sha256_hash_metadata": hashing.hash_object(wrong)}, preprocess_hash=digest)
    bare = META | {"sha256_hash_metadata": hashing.hash_object(META)}
    assert store.validate(bare) and not store.validate(bare, preprocess_hash=digest)


def test_read_with_schema_gate_and_spans(spark, tmp_path):
    df = spark.createDataFrame([("A-B", 1, [1.0])], "pair string, status int, cc array<double>").withColumn("time", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    df = df.withColumn("offset", F.expr("INTERVAL '1 02:03:04.5' DAY TO SECOND"))
    path = str(tmp_path / "t")
    assert store.write(df, path, META)
    assert store.read(spark, path, columns={"cc": "array<double>", "status": "int"}).first().offset == 86400 + 7200 + 180 + 4.5
    assert store.read(spark, path, columns={"cc": "array<float>"}) is None and store.read(spark, path, columns={"nothing": "int"}) is None


def test_many_tables_are_read_at_once(spark, tmp_path):
    one = lambda p, v: spark.createDataFrame([(p, 1, [v])], "pair string, status int, cc array<double>").withColumn("time", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    paths = [str(tmp_path / f"t {k}%") for k in range(4)]
    for k, p in enumerate(paths):
        store.write(one(f"A-{k}", float(k)), p, META if k != 2 else META | {"title": "other"})
    assert sorted(r.pair for r in store.mfread(spark, paths).collect()) == ["A-0", "A-1", "A-3"]
    assert store.mfread(spark, []) is None
    same = [str(tmp_path / d / "x") for d in "ab"]  # equal last names
    for k, p in enumerate(same):
        store.write(one(f"B-{k}", 1.0), p, META)
    assert store.mfread(spark, same).count() == 2


def test_test_run_stores_nothing(spark, tmp_path):
    rows = [(r, t, float((t * 7) % 5)) for r in "AB" for t in range(48)]
    grid = spark.createDataFrame(rows, "receiver string, t int, v double")
    path = str(tmp_path / "xc")
    got = run.run(grid, "receiver", path, META, first=0, last=48, window=24, step=12, origin="2024-01-01 00:00:00", test_run=True)
    assert got == {"planned": 3, "new": 1, "done": 1, "missing": 0} and not store.exists(spark, path)


def test_table_hashes(spark):
    rows = [(i, i % 2, [i / 3, float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, g int, x array<double>")
    h = hashing.hash_table(df, ["id"], "x").first().hash
    assert h == hashing.hash_table(df.repartition(5).orderBy(F.desc("id")), ["id"], "x").first().hash
    assert h != hashing.hash_table(df.where("id < 19"), ["id"], "x").first().hash
    assert h != hashing.hash_table(df.withColumn("x", F.when(F.col("id") == 3, F.array(F.lit(0.0))).otherwise(F.col("x"))), ["id"], "x").first().hash
    assert hashing.hash_table(df, ["id"], "x", ["g"]).count() == 2


@pytest.mark.parametrize("wavelet,bandwidth", [("cmor", 1.5), ("mexh", 1.0), ("shan", 0.5)])
def test_wavelet_methods_agree(wavelet, bandwidth):
    """Products of spectra and sums in time, at scales of many samples."""
    x = np.random.default_rng(3).normal(size=400)
    x = np.convolve(x, np.hanning(31), "same")
    for a, b in zip(spectral.cwt(x, 1.0, np.array([10.0, 20.0]), bandwidth, 1.0, wavelet)[1], spectral.cwt(x, 1.0, np.array([10.0, 20.0]), bandwidth, 1.0, wavelet, "conv")[1], strict=True):
        mid = slice(100, 300)
        assert np.abs(a - b)[mid].max() < (0.08 if wavelet == "shan" else 1e-3) * np.abs(b).max()
    with pytest.raises(ValueError):
        spectral.cwt(x, 1.0, np.array([10.0]), method="other")


def test_correlation_options(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 7))
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    r = df.select(
        correlate.cc(F.col("x"), F.col("y"), unbiased=True).alias("u"), correlate.cc(F.col("x"), F.col("y"), True, pad=False).alias("c"), correlate.cc(F.col("x"), F.col("y"), single=True).alias("s"),
    )
    assert dict(r.dtypes)["s"] == "array<float>"
    got = r.first()
    full = np.correlate(x, y, "full")
    assert np.allclose(got.u, full * 7 / (7 - np.abs(np.arange(-6, 7)))) and np.allclose(got.s, full, atol=1e-5)
    circle = [sum(x[(m + k) % 7] * y[m] for m in range(7)) for k in range(-3, 4)]
    assert np.allclose(got.c, np.array(circle) / np.linalg.norm(x) / np.linalg.norm(y))
    assert fourier.circular(x[:6], y[:6])[3] == pytest.approx(x[:6] @ y[:6])


def test_plane_wave_by_absolute_value_or_envelope(spark):
    lags = np.arange(-20, 21)
    rows = []
    for a, b, d in (("p", "q", 4), ("p", "r", -6), ("q", "r", -10)):
        pulse = -np.exp(-((lags - d) ** 2) / 18.0) * np.cos(2 * np.pi * (lags - d) / 8)
        rows.append((0, a, b, pulse.tolist()))
    df = spark.createDataFrame(rows, "t int, rx_a string, rx_b string, x array<double>")
    geo = spark.createDataFrame([("p", "q", 100.0, 0.0), ("p", "r", 0.0, 100.0), ("q", "r", -100.0, 100.0)], "rx_a string, rx_b string, dx double, dy double")
    for envelope in (False, True):
        r = SeriesFrame(df, "x").plane_wave_estimate(geo, ["t"], envelope=envelope).first()
        assert (r.s_x, r.s_y) == pytest.approx((40.0, -60.0))


def test_periodogram_axes(spark):
    long = spark.createDataFrame([("a", float(t), float(np.cos(2 * np.pi * t / 12.5))) for t in range(100) if t % 7], "k string, t double, v double")
    by = lambda f, **o: [r.power for r in transforms.lombscargle(long, ["k"], "t", "v", f, **o).orderBy("freq").collect()]
    assert by([12.5], invert=True) == pytest.approx(by([0.08])) and by([2 * np.pi * 0.08], angular=True) == pytest.approx(by([0.08]))
