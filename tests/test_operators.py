import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions import hashing, names, times
from lagoon.operators import correlate, detect, matrix, transforms
from lagoon.plans import correlation
from lagoon.series import SeriesFrame
from lagoon.sources import store, waveforms


def one(spark, x, *cols):
    return spark.createDataFrame([(x,)], "x array<double>").select(*cols).first()


def test_missing_samples(spark):
    x = [1.0, None, 3.0, 8.0]
    r = one(spark, x, A.mean(F.col("x")), A.rms(F.col("x")), A.demean(F.col("x")), A.norm1d(F.col("x")), A.has_nan(F.col("x")), A.detrend(F.col("x")))
    assert r[0] == 4 and abs(r[1] - math.sqrt(74 / 3)) < 1e-12 and r[2] == [-3, None, -1, 4] and r[3][1] is None and r[4]
    t, v = np.array([0, 2, 3]), np.array([1.0, 3, 8])
    m, b = np.polyfit(t, v, 1)
    assert np.allclose([r[5][i] for i in t], v - (m * t + b)) and r[5][1] is None


@pytest.mark.parametrize("x", [[], [None], [0.0, 0.0]])
def test_degenerate_series(spark, x):
    r = one(spark, x, A.mean(F.col("x")), A.norm1d(F.col("x")), A.taper(F.col("x")), A.detrend(F.col("x")))
    assert len(r[1]) == len(r[2]) == len(r[3]) == len(x) and (r[1] == [None] * len(x))


def test_window_sides(spark):
    n = F.lit(10)
    both, left, right, none = spark.range(1).select(A.window(n, max_percentage=0.3), A.window(n, "left", max_percentage=0.3), A.window(n, "right", max_percentage=0.3), A.window(n, max_length=0.0)).first()
    ramp = [0.5 - 0.5 * math.cos(math.pi * i / 3) for i in range(6)]
    assert np.allclose(both, ramp[:3] + [1] * 4 + ramp[3:]) and np.allclose(left, ramp[:3] + [1] * 7) and np.allclose(right, [1] * 7 + ramp[3:]) and none == [1.0] * 10
    with pytest.raises(ValueError):
        A.window(n, "middle")


def test_unbias_of_constant(spark):
    n = 8
    full = np.correlate(np.ones(n), np.ones(n), "full").tolist()
    assert np.allclose(one(spark, full, A.unbias(F.col("x"), n, 1 - n))[0], n)
    assert max(one(spark, full, A.unbias(F.col("x"), n, 1 - n, 2.0))[0]) == n


def test_fluent_unbias_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0],)], "x array<double>")
    s = SeriesFrame(df, "x", first=-1.0).unbias(2)
    assert s.unbias(2).df.first().x == s.df.first().x == [2.0, 2.0, 2.0]


def test_kernels_skip_incomplete_series(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    got = {r.i: r.e for r in df.select("i", transforms.envelope(F.col("x")).alias("e")).collect()}
    assert got[2] is None and got[3] is None and got[4] is None and len(got[1]) == 2 and len(got[5]) == 3


def brute_trigger(cells, on, off, need, steps, extend):
    by = {}
    for e, t, v in cells:
        by.setdefault(e, {})[t] = v
    hits = {}
    for e, row in by.items():
        state = False
        for t in range(min(row), max(row) + 1):
            v = row.get(t)
            state = v is not None and (v >= off if state else v >= on)
            if state:
                hits.setdefault(t, set()).add(e)
    ts = sorted(t for t, s in hits.items() if len(s) >= need)
    runs = []
    for t in ts:
        if runs and runs[-1][1] == t - 1:
            runs[-1][1] = t
        else:
            runs.append([t, t])
    merged = []
    for a, b in [(a - extend, b + extend) for a, b in runs if b - a + 1 >= steps]:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return {(t, p) for p, (a, b) in enumerate(merged) for t in range(a, b + 1)}


@pytest.mark.parametrize("off,extend", [(None, 0), (3.0, 0), (3.0, 2), (5.0, 1)])
def test_coincidence_trigger(spark, off, extend):
    rng = random.Random(extend + 3)
    cells = [(e, t, rng.choice([0.0, 2.0, 3.5, 6.0, 9.0])) for e in "abc" for t in range(120) if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "e string, t int, v double")
    got = detect.coincidence_trigger(df, "e", "t", "v", thr_on=5.0, thr_off=off, coincidence=2, min_steps=2, extend=extend)
    want = brute_trigger(cells, 5.0, off or 5.0, 2, 2, extend)
    assert {(r.t, r.period) for r in got.collect()} == want and want
    none = detect.coincidence_trigger(df, "e", "t", "v", thr_on=99.0, coincidence=2)
    assert none.count() == 0


def test_plane_wave_recovers_slowness(spark):
    xy = [(0, 0), (900, 100), (-300, 700), (200, -800)]
    g = matrix.couples(spark.createDataFrame([(f"r{i}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "receiver string, x double, y double"), "receiver", "x", "y")
    sx, sy = 0.0004, -0.0003
    r = matrix.plane_wave(g.withColumn("tau", F.col("dx") * sx + F.col("dy") * sy), []).first()
    assert abs(r.s_x - 0.4) < 1e-9 and abs(r.s_y + 0.3) < 1e-9 and abs(r.vel - 2) < 1e-9 and abs(r.doa - (math.degrees(math.atan2(sx, sy)) % 360)) < 1e-9 and r.err < 1e-12
    flat = matrix.plane_wave(g.withColumn("dy", F.lit(0.0)).withColumn("tau", F.lit(1.0)), []).first()
    assert flat.s_x is None


def test_lombscargle_amplitude(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.random(400) * 100)
    v = 3 * np.sin(2 * np.pi * 0.7 * t + 0.4)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, v, strict=True)] + [("b", 0.0, 1.0)], "k string, t double, v double")
    got = {(r.k, r.freq): r.power for r in transforms.lombscargle(df, ["k"], "t", "v", [0.7, 0.31], rescale=True).collect()}
    assert abs(got["a", 0.7] - 3) < 0.05 and got["a", 0.31] < 0.6 and got["b", 0.7] is None


def test_names(spark):
    df = spark.createDataFrame([("IU.RAR.10.BHR", "IU.RAR.10.BHZ")], "a string, b string")
    pair = names.pair(F.col("a"), F.col("b"))
    r = df.select(names.split_pair_substitute(pair).alias("s"), names.receiver_string(names.receiver_struct(F.col("a"))).alias("a"), names.channel(F.col("a")).alias("c")).first()
    assert r.s == ["IU.RAR.10.BH1", "IU.RAR.10.BH2", "IU.RAR.10.BHZ"] and r.a == "IU.RAR.10.BHR" and r.c == "BHR"


def trace_rows(spark):
    rows = [("A", "2024-01-01 23:00:00", 3600.0, [1.0, 2.0, 3.0]), ("A", "2024-01-02 04:00:00", 3600.0, [4.0, 5.0]), ("A", "2024-01-02 05:00:00", 3600.0, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "receiver string, s string, delta double, data array<double>")
    return df.select("receiver", F.col("s").cast("timestamp_ntz").alias("starttime"), "delta", F.size("data").alias("npts"), "data")


def test_traces(spark):
    t = trace_rows(spark)
    d = waveforms.duration(t).first()
    assert (d.npts, d.seconds, d.gaps, d.overlaps) == (7, 6 * 3600.0, 1, 1)
    days = {(str(r.day), tuple(r.data)) for r in waveforms.slice_days(t, 0.0).collect()}
    assert days == {("2024-01-01", (1.0,)), ("2024-01-02", (2.0, 3.0)), ("2024-01-02", (4.0, 5.0)), ("2024-01-02", (5.0, 6.0))}
    at = lambda h: F.expr(f"timestamp_ntz'2024-01-02 0{h}:00:00'")
    got = waveforms.get_waveforms(t, "A", at(0), at(4)).collect()
    assert sorted(tuple(r.data) for r in got) == [(2.0, 3.0), (4.0,)]


def test_archive_is_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "sds")
    waveforms.archive(trace_rows(spark), path, 0.0)
    n = spark.read.parquet(path).count()
    waveforms.archive(trace_rows(spark).where("starttime < timestamp_ntz'2024-01-02 00:00:00'"), path, 7200.0)
    after = spark.read.parquet(path)
    assert n == 4 and after.count() == 2  # the second day is replaced, the first is kept


def test_response_removal(spark):
    n, delta = 511, 0.02
    x = np.random.default_rng(1).normal(size=n)
    s = 2j * np.pi * np.fft.rfftfreq(n, delta)
    h = 5.0 / (s + 20.0)
    recorded = np.fft.irfft(np.fft.rfft(x) * h, n).tolist()
    back = one(spark, recorded, waveforms.spectral_division(F.col("x"), delta, [], [-20.0], 5.0))[0]
    assert np.allclose(back, x)


def test_operations(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],)], "x array<double>")
    ops = [("demean", {}), ("nothing", {}), ("trim", {"first": 1, "n": 2}), lambda x: F.transform(x, lambda v: v * 10)]
    assert waveforms.apply_operations(df, "x", ops).first().x == [-10.0, 30.0]
    with pytest.raises(ValueError):
        waveforms.apply_operations(df, "x", [("nothing", {})], strict=True)


def test_operations_mix_native_steps_and_kernels(spark):
    t = np.arange(400) * 0.02
    x = 5 + np.sin(2 * np.pi * t) + np.sin(2 * np.pi * 20 * t)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    ops = [("demean", {}), ("detrend", {}), ("taper", {"max_percentage": 0.05}), ("decimate", {"factor": 5, "delta": 0.02}), ("normalize", {}), ("resample", {"n": 160}), ("demean", {}),
           ("filter", {"type": "lowpass", "frequency": 3.0, "delta": 0.05}), ("interpolate", {"factor": 2})]
    got = waveforms.apply_operations(df, "x", ops, strict=True).first().x
    spec = np.abs(np.fft.rfft(got))
    assert len(got) == 319 and np.argmax(spec) == 8 and spec[20:].max() < 0.05 * spec.max()
    poles = {"delta": 0.02, "zeros": [], "poles": [-20.0], "gain": 5.0}
    back = waveforms.apply_operations(df.withColumn("x", F.slice("x", 1, 399)), "x", [("simulate", poles), ("remove_response", poles)]).first().x
    assert np.allclose(back, x[:399]) and "simulate" in waveforms.list_operations()


def test_decimate_filters_first(spark):
    """Against the low-pass as a recursion written out, forward and backward; no sampling interval given."""
    from lagoon.kernels.filters import butterworth

    n, factor = 240, 4
    t = np.arange(n)
    slow, fast = np.sin(2 * np.pi * t / 40), np.sin(2 * np.pi * 0.3 * t)
    df = spark.createDataFrame([("slow", slow.tolist()), ("fast", fast.tolist()), ("both", (slow + fast).tolist())], "k string, x array<double>")
    got = {r.k: np.array(r.x) for r in waveforms.apply_operations(df, "x", [("decimate", {"factor": factor})], strict=True).collect()}
    edge = butterworth(4, 0.4 / factor, "lowpass", 1.0)

    def once(y):
        for b0, b1, b2, _, a1, a2 in edge:
            z, v = [], [y[0]] * 2  # a constant past, which a low-pass of gain one leaves
            past = [y[0] * (b0 + b1 + b2) / (1 + a1 + a2)] * 2
            for value in y:
                new = b0 * value + b1 * v[0] + b2 * v[1] - a1 * past[0] - a2 * past[1]
                v, past = [value, v[0]], [new, past[0]]
                z.append(new)
            y = z
        return y

    for k, x in (("slow", slow), ("fast", fast), ("both", slow + fast)):
        pad = 3 * (2 * len(edge) + 1)
        ext = [*(2 * x[0] - x[pad:0:-1]), *x, *(2 * x[-1] - x[-2 : -pad - 2 : -1])]
        want = np.array(once(once(ext)[::-1])[::-1])[pad : pad + n : factor]
        assert np.allclose(got[k], want, atol=1e-9)
    inner = slice(5, -5)
    assert np.abs(got["fast"][inner]).max() < 0.01 and np.allclose(got["slow"][inner], slow[::factor][inner], atol=0.02)
    plain = waveforms.apply_operations(df, "x", [("decimate", {"factor": factor, "lowpass": False})]).where("k = 'both'").first().x
    assert np.allclose(plain, (slow + fast)[::factor])


def test_interpolate_lanczos(spark):
    rng = np.random.default_rng(5)
    x, tone = rng.normal(size=90), np.sin(2 * np.pi * 0.4 * np.arange(90))
    df = spark.createDataFrame([("x", x.tolist()), ("tone", tone.tolist()), ("gap", [1.0, None, 2.0])], "k string, x array<double>")

    def run(**p):
        return {r.k: r.x for r in waveforms.apply_operations(df, "x", [("interpolate", p)], strict=True).collect()}

    def brute(v, ratio, a):
        out = []
        for m in range(int((len(v) - 1) * ratio + 1e-9) + 1):
            t = [m / ratio - i for i in range(len(v))]
            out.append(sum(y * np.sinc(d) * np.sinc(d / a) for y, d in zip(v, t, strict=True) if abs(d) < a))
        return out

    got = run(sampling_rate=50.0, delta=0.05, method="lanczos", a=20)
    assert np.allclose(got["x"], brute(x, 2.5, 20), atol=1e-9) and len(got["x"]) == 223 and got["gap"] is None
    assert np.allclose(run(factor=0.6, method="lanczos", a=3)["x"], brute(x, 0.6, 3), atol=1e-9)
    assert np.allclose(run(factor=4, method="lanczos")["x"][::4], x)
    # content near Nyquist, away from the ends: straight lines miss it
    true = np.sin(2 * np.pi * 0.4 * np.arange(357) / 4)[100:257]
    near, lines = (np.abs(np.array(run(factor=4, method=m)["tone"])[100:257] - true).max() for m in ("lanczos", "linear"))
    assert near < 0.03 and lines > 0.5, (near, lines)
    straight = run(sampling_rate=50.0, delta=0.05, method="linear")["x"]
    assert np.allclose(straight, np.interp(np.arange(223) / 2.5, np.arange(90), x))
    for bad in ({"factor": 2, "method": "cubic"}, {"sampling_rate": 5.0}, {}):
        with pytest.raises(ValueError):
            run(**bad)


def test_regular_axis_and_period_days(spark):
    rows = [("a", t) for t in (0, 10, 20, 30)] + [("b", t) for t in (0, 10, 25)] + [("c", 5)]
    got = {r.k: r.regular for r in correlate.regular(spark.createDataFrame(rows, "k string, t int"), "k", "t").collect()}
    assert got == {"a": True, "b": False, "c": True}
    trigs = spark.createDataFrame([(t, int(t > 40)) for t in (20, 21, 22, 23, 24, 50)], "h int, period int")
    assert {(r.period, r.day) for r in detect.period_days(trigs, "h", 24).collect()} == {(0, 0), (0, 1), (1, 2)}
    assert one(spark, [1.0, -4.0, 2.0], A.normalize_max(F.col("x")))[0] == [0.25, -1.0, 0.5]


META = {"title": "t", "institution": "i", "author": "a", "source": "s"}


def stored(spark, status=1):
    rows = [("A-B", "2024-01-01 12:00:00", status, [1.0]), ("A-B", "2025-01-01 12:00:00", -1, [2.0])]
    return spark.createDataFrame(rows, "pair string, t string, status int, cc array<double>").select("pair", F.col("t").cast("timestamp_ntz").alias("time"), "status", "cc")


def test_store(spark, tmp_path):
    p = [str(tmp_path / x) for x in "abc"]
    assert store.write(stored(spark), p[0], META) and store.write(stored(spark), p[1], META | {"title": "other"}) and not store.write(stored(spark, 0), p[2], META)
    meta = store.read_metadata(spark, p[0])
    assert store.validate(meta) and not store.validate(meta | {"title": "x"}) and not store.validate(meta, "0" * 64)
    assert sorted(r.cc is None for r in store.read(spark, p[0], extract=True).collect()) == [False, True]
    assert store.mfread(spark, p[:2]).count() == 2  # the second has other metadata
    assert store.historicize(meta, "f", {"x": 1}, "1")["history"] == ['lagoon-1: f({"x": 1})']


def test_hashes(spark):
    obj = {"b": 1, "a": [1, 2]}
    h = hashing.hash_object(obj)
    assert h == hashing.hash_object({"a": [1, 2], "b": 1, "sha256_hash": h}) and hashing.check_hash(obj | {"sha256_hash": h}) and not hashing.check_hash(obj | {"a": 0, "sha256_hash": h})


def test_process_and_resume(spark):
    cells = [(r, t, float((t * k) % 7)) for k, r in ((1, "A"), (2, "B"), (3, "C")) for t in range(24) if not (r == "C" and t == 20)]
    df = spark.createDataFrame(cells, "r string, t int, v double")
    plan = correlation.init(df, "r", 0, 24, 12, 6)
    grid = correlate.dense_grid(df, df, "r", "t", 24, "v", None)
    done = correlation.process(plan, correlation.windows(grid, "r", "t", "v", 0, 24, 12, 6), "r", 12)
    got = {(r.pair, r.start): r for r in done.collect()}
    assert len(got) == 9 and {k for k, r in got.items() if r.status == -1} == {(p, 12) for p in ("A-C", "B-C")}
    x = np.array([[float((t * k) % 7) for t in range(6, 18)] for k in (1, 2)])
    assert np.allclose(got["A-B", 6].cc, np.correlate(x[0], x[1], "full"))
    assert correlation.retry(done, plan).count() == 0 and correlation.retry(done, plan, True).count() == 2
    post = correlation.postprocess(done, n=12, first_lag=-11, delta=1.0, highpass=0.1, taper1=2.0, taper2=2.0)
    assert correlation.postprocess(post, n=12, first_lag=-11, delta=1.0, highpass=0.1, taper1=2.0, taper2=2.0) is post and post.count() == 7


def test_time_zone_has_no_say(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 01:30:00.25' AS a, timestamp_ntz'2024-03-31 03:30:01.5' AS b")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = df.select(times.seconds(F.col("a"), F.col("b")).alias("s"), times.hour_number(F.col("b"), "2024-03-30 02:00:00").alias("h"), F.timestamp_add("HOUR", F.lit(2), F.col("a")).cast("string").alias("t")).first()
            assert (r.s, r.h, r.t) == (7201.25, 25, "2024-03-31 03:30:00.25")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
