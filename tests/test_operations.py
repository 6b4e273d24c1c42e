"""Operations on streams: the registry, and operations against plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.kernels import filters, fourier
from lagoon.sources import client, operations

T0 = "timestamp_ntz'2024-01-01 00:00:00'"


def traces(spark, rows, delta=1.0):
    """rows: (receiver, first second, samples)."""
    df = spark.createDataFrame([(r, float(s), [None if v is None else float(v) for v in x]) for r, s, x in rows], "receiver string, s double, data array<double>")
    start = F.timestamp_add("MICROSECOND", F.round(F.col("s") * 1e6).cast("long"), F.expr(T0))
    return df.select("receiver", start.alias("starttime"), F.lit(float(delta)).alias("delta"), F.size("data").alias("npts"), "data")


def one(df):
    r = df.collect()
    assert len(r) == 1 and r[0].npts == len(r[0].data)
    return r[0]


def test_registry(spark):
    assert {"merge", "rotate", "select", "running_rms", "attach_response", "trim", "filter"} <= set(operations.list_operations())
    assert operations.is_operation("merge") and not operations.is_operation("nothing") and not operations.is_operation(len)
    assert "Injected: starttime, endtime" in operations.help("trim") and len(operations.help().splitlines()) == len(operations.list_operations())
    assert operations.inject("trim", {"starttime": 1}, starttime=5, endtime=7, inventory=9) == {"starttime": 1, "endtime": 7}
    t = traces(spark, [("a", 0, [1, 2, 3])])
    with pytest.warns(UserWarning, match="nothing"):
        got = operations.process(t, [("nothing", {}), ("demean", {}), (lambda df, k: df.withColumn("data", F.transform("data", lambda v: v * k)), {"k": 2.0})])
    assert one(got).data == [-2.0, 0.0, 2.0]
    with pytest.raises(ValueError, match="nothing"):
        operations.process(t, [("nothing", {})], strict=True)
    with pytest.raises(ValueError, match="pair"):
        operations.process(t, ["demean"], strict=True)


def test_recipes_and_their_hash():
    recipes = {"BHZ": [["merge", {}]], "BH": [], "XHZ": [], "EDH": [["detrend", {"type": "linear"}]], "sha256_hash": "old"}
    assert set(operations.filter_operations(recipes)) == {"BHZ", "EDH"}
    text = operations.operations_to_json(recipes)
    back = operations.operations_to_dict(text)
    assert operations.check_operations_hash(back) and back["BHZ"] == recipes["BHZ"]
    with pytest.raises(ValueError):
        operations.operations_to_dict(json.dumps(json.loads(text) | {"BHZ": []}))
    with pytest.raises(ValueError):
        operations.check_operations_hash({"BHZ": []})


def test_merge_of_laps_and_gaps(spark):
    parts = [("a", 0, [0, 1, 2, 3]), ("a", 2, [9, 9]), ("a", 3, [9, 14, 15]), ("a", 9, [9, 10]), ("b", 5, [7])]
    got = {r.receiver: r for r in operations.merge(traces(spark, parts), fill_value="interpolate").collect()}
    assert got["a"].data == [0, 1, 2, 3, 14, 15, 13.5, 12, 10.5, 9, 10] and got["b"].data == [7] and str(got["b"].starttime) == "2024-01-01 00:00:05"
    assert {r.receiver: r for r in operations.merge(traces(spark, parts)).collect()}["a"].data[6:9] == [None] * 3
    assert {r.receiver: r for r in operations.merge(traces(spark, parts), fill_value=0).collect()}["a"].data[6:9] == [0, 0, 0]
    with pytest.raises(ValueError):
        operations.merge(traces(spark, parts), method=0)


def test_rates_of_rows(spark):
    """Filters and rates follow each row's own step."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 60))
    t = traces(spark, [("a", 0, x[0])]).union(traces(spark, [("b", 0, x[1])], 0.5))
    got = {r.receiver: r for r in operations.process(t, [("filter", {"type": "lowpass", "freq": 0.2}), ("interpolate", {"sampling_rate": 4.0})]).collect()}
    for r, v, d in (("a", x[0], 1.0), ("b", x[1], 0.5)):
        want = fourier.lanczos(filters.run(filters.butterworth(4, 0.2, "lowpass", 1 / d), v), 4 * d, 20)
        assert np.allclose(got[r].data, want) and got[r].delta == 0.25 and got[r].npts == len(want)
    zero = one(operations.filter_(traces(spark, [("a", 0, x[0])]), "bandpass", freqmin=0.1, freqmax=0.3, corners=2, zerophase=True))
    assert np.allclose(zero.data, filters.zero_phase(filters.butterworth(2, (0.1, 0.3), "bandpass", 1.0), x[0]))
    assert np.allclose(one(operations.resample(traces(spark, [("a", 0, x[0])]), 0.5)).data, fourier.resample(x[0], 30))
    d = one(operations.decimate(traces(spark, [("a", 0, x[0])]), 5))
    assert d.npts == 12 and d.delta == 5.0 and one(operations.decimate(traces(spark, [("a", 0, x[0])]), 5, no_filter=True)).data == x[0][::5].tolist()


def test_rotation_of_any_orientation(spark):
    rng = np.random.default_rng(6)
    zne = rng.normal(size=(3, 20))
    axes = [(37.0, 10.0), (121.0, -25.0), (300.0, -70.0)]
    comps = []
    for a, d in np.radians(axes):
        comps.append(np.cos(d) * np.cos(a) * zne[1] + np.cos(d) * np.sin(a) * zne[2] - np.sin(d) * zne[0])
    names = ["X.S..BH1", "X.S..BH2", "X.S..BHZ"]
    inv = spark.createDataFrame([(n, *p) for n, p in zip(names, axes, strict=True)], "receiver string, azimuth double, dip double")
    t = traces(spark, [(n, 0, c) for n, c in zip(names, comps, strict=True)] + [("X.T..BH1", 0, [1.0])])
    got = {r.receiver[-1]: r.data for r in operations.process(t, [("rotate", {"method": "->ZNE"})], inventory=inv).collect()}
    assert np.allclose([got[c] for c in "ZNE"], zne) and len(got) == 3
    plain = {r.receiver[-1]: r.data for r in operations.rotate(t).collect()}
    assert np.allclose(plain["N"], comps[0]) and np.allclose(plain["E"], comps[1]) and np.allclose(plain["Z"], comps[2])
    rt = {r.receiver[-1]: r.data for r in operations.process(t, [("rotate", {"method": "->ZNE"}), ("rotate", {"method": "NE->RT", "back_azimuth": 90.0})], inventory=inv).collect()}
    assert np.allclose(rt["R"], -zne[2]) and np.allclose(rt["T"], zne[1]) and np.allclose(rt["Z"], zne[0])
    with pytest.raises(ValueError):
        operations.rotate(t, "RT->NE")


def test_select_trim_and_sensitivity(spark):
    t = traces(spark, [("IU.RAR.10.BHZ", 0, range(10)), ("IU.RAR.00.BHN", 0, range(10)), ("IM.H10N1..EDH", 0, range(10))])
    sel = lambda **p: {r.receiver for r in operations.select(t, **p).collect()}
    assert sel(channel="BH?") == {"IU.RAR.10.BHZ", "IU.RAR.00.BHN"} and sel(component="Z", network="I*") == {"IU.RAR.10.BHZ"} and sel(sampling_rate=2.0) == set() and sel(location="") == {"IM.H10N1..EDH"}
    at = lambda s: F.timestamp_add("SECOND", F.lit(s), F.expr(T0))
    assert [r.data for r in operations.process(t, [("trim", {})], starttime=at(3), endtime=at(5)).collect()] == [[3.0, 4.0, 5.0]] * 3
    inv = spark.createDataFrame([("IU.RAR.10.BHZ", [], [], 2.0)], "receiver string, zeros array<double>, poles array<double>, gain double")
    assert one(operations.process(t, [("remove_sensitivity", {})], inventory=inv)).data == [v / 2 for v in range(10)]
    assert one(operations.process(t, [("remove_response", {})], inventory=inv)).data == pytest.approx([v / 2 for v in range(10)])
    with pytest.raises(ValueError):
        operations.process(t, [("remove_response", {})])


def test_source_gives_merged_and_rotated_windows(spark):
    rng = np.random.default_rng(9)
    n, e, z = rng.normal(size=(3, 100)).round(3)
    gap = [("X.STA..BH1", 0, n[:40]), ("X.STA..BH1", 43, n[43:]), ("X.STA..BH2", 0, e), ("X.STA..BHZ", 0, z), ("X.OTH..BHZ", 0, z), ("X.OTH..BH1", 0, n)]
    rot = [("rotate", {"method": "->ZNE"}), ("rotate", {"method": "NE->RT", "back_azimuth": 30.0}), ("select", {"channel": "BHR"})]
    c = client.WaveformSource([traces(spark, gap)], max_gap=5.0, operations={"BHZ": [("demean", {})], "BHR": rot})
    start, stop = F.expr(T0), F.timestamp_add("SECOND", F.lit(99), F.expr(T0))
    filled = n.copy()
    filled[40:43] = n[39] + (n[43] - n[39]) * np.arange(1, 4) / 4
    got = one(c.processed("X.STA..BHR", start, stop, 1.0, buffer=0.0))
    b = np.radians(30)
    assert got.receiver == "X.STA..BHR" and np.allclose(got.data, -filled * np.cos(b) - e * np.sin(b))
    assert c.processed("X.OTH..BHR", start, stop, 1.0, buffer=0.0).count() == 0  # a component lacks
    assert np.allclose(one(c.processed("X.STA..BHZ", start, stop, 1.0, buffer=0.0)).data, z - z.mean())
    pair = c.pair("X.STA..BHR-X.OTH..BHZ", start, stop, 1.0, buffer=0.0).collect()
    assert len(pair) == 1 and np.allclose(pair[0].xb, z - z.mean())
    assert c.verify_processing(["X.STA..BHZ", "X.STA..BHR", "X.OTH..BHR"], start, stop, 1.0) == {"X.STA..BHZ": 1, "X.STA..BHR": 1, "X.OTH..BHR": 0}


def test_write_back(spark, tmp_path):
    first, second = [("X.A..BHZ", 0, range(50))], [("X.A..BHZ", 0, range(100)), ("X.B..BHZ", 0, range(100))]
    c = client.WaveformSource([traces(spark, first, 60.0), traces(spark, second, 60.0)], archive_path=str(tmp_path / "a"), max_gap=60.0, force_write=True)
    start, stop = F.expr(T0), F.timestamp_add("MINUTE", F.lit(99), F.expr(T0))
    c.write_back("X.%", start, stop)
    got = {r.receiver: r.npts for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert got == {"X.A..BHZ": 100, "X.B..BHZ": 100}
