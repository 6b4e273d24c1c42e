"""Windows and correlations at array level, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.plans import correlation


def assembled(traces, first, last, window, step):
    """Windows sample by sample; of overlapping traces the one that begins first is taken, then the shorter."""
    out = {}
    for s in range(first, last - window + 1, step):
        for r in {t[0] for t in traces}:
            x = [None] * window
            met = [(max(0, k - s), min(k + len(d), s + window) - max(k, s), d[max(0, s - k) : s + window - k]) for q, k, d in traces if q == r and d and k < s + window and k + len(d) > s]
            end = 0
            for o, n, d in sorted(met, key=lambda p: (p[0], p[1])):
                for i in range(max(o, end), o + n):
                    x[i] = d[i - o]
                end = max(end, o + n)
            if met:
                out[r, s] = x
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_traces(spark, seed):
    rng = random.Random(seed)
    traces = []
    for r in "AB":
        k = -20
        while k < 120:
            n = rng.randrange(0, 40)
            traces.append((r, k, [rng.choice([None, 1.0, 2.0, float(k + i)]) if seed % 2 else float(k + i) for i in range(n)]))
            k += n + rng.choice([0, 0, 3, -2 if seed > 1 else 0])
    df = spark.createDataFrame(traces, "rx string, k0 long, data array<double>").repartition(3)
    got = {(r.rx, r.start): (r.x, r.complete) for r in correlation.trace_windows(df, "rx", 4, 100, 24, 8).collect()}
    want = assembled(traces, 4, 100, 24, 8)
    if seed <= 1:  # without laps there is one answer
        assert {k: v[0] for k, v in got.items()} == want
    assert set(got) == set(want) and all(len(x) == 24 and c == (None not in x) for x, c in got.values())
    assert [[v is None for v in got[k][0]] == [v is None for v in want[k]] for k in want] == [True] * len(want) or seed > 1


def test_chunks_are_dense(spark):
    rows = [("A", t, float(t)) for t in range(30) if t not in (3, 4, 11, 20)] + [("B", 7, None), ("B", 9, 1.0)]
    df = spark.createDataFrame(rows, "rx string, t int, v double").repartition(3)
    got = {(r.rx, r.k0): r.data for r in correlation.chunks(df, "rx", "t", "v", 0, 28, 10).collect()}
    assert got == {
        ("A", 0): [0.0, 1.0, 2.0, None, None, 5.0, 6.0, 7.0, 8.0, 9.0], ("A", 10): [10.0, None, *map(float, range(12, 20))],
        ("A", 21): [float(t) for t in range(21, 28)], ("B", 7): [None, None, 1.0],
    }


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("clip", [None, (-5, 5), (2, 9), (-9, -3), (-40, 40)])
def test_process_in_cells(spark, parts, clip):
    rng = np.random.default_rng(7)
    data = {r: rng.normal(size=60).tolist() for r in "ABCDE"}
    data["D"][50] = None
    data["E"] = [0.0] * 60
    df = spark.createDataFrame([(r, 0, d) for r, d in data.items()], "rx string, k0 int, data array<double>")
    plan = correlation.init(df, "rx", 0, 60, 20, 10)
    done = correlation.process(plan, correlation.trace_windows(df, "rx", 0, 60, 20, 10), "rx", 20, clip, True, parts)
    rows = done.collect()
    assert len(rows) == 50 and done.columns == ["pair", "rx_a", "rx_b", "start", "time", "status", "cc"]
    for r in rows:
        x, y = (data[k][r.start : r.start + 20] for k in (r.rx_a, r.rx_b))
        assert r.status == (-1 if None in x + y else 1)
        if r.status == 1 and "E" not in (r.rx_a, r.rx_b):
            full = np.correlate(x, y, "full") / (np.linalg.norm(x) * np.linalg.norm(y))
            low, high = clip or (-19, 19)
            assert np.allclose(r.cc, full[max(0, low + 19) : high + 20])
        else:
            assert r.cc is None
    assert correlation.process(plan.limit(0), correlation.trace_windows(df, "rx", 0, 60, 20, 10), "rx", 20).count() == 0


def test_no_sample_becomes_a_row(spark):
    df = spark.createDataFrame([("A", 0, [1.0] * 60)], "rx string, k0 int, data array<double>")
    wins = correlation.trace_windows(df, "rx", 0, 60, 20, 10)
    plan = correlation.process(correlation.init(df, "rx", 0, 60, 20, 10), wins, "rx", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "explode(data" not in plan and "posexplode" not in plan


@pytest.mark.parametrize("delta", [0.29, 0.004, 1 / 3, 0.01])
def test_times_are_rounded(spark, delta):
    from datetime import datetime, timedelta

    from lagoon.sources import waveforms

    df = spark.range(1, 3000, 7).select(F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("s"), F.col("id").cast("int").alias("n"))
    for r in df.select("n", waveforms.end_time(F.col("s"), F.lit(delta), F.col("n")).alias("e")).collect():
        assert r.e == datetime(2024, 1, 1) + timedelta(microseconds=round((r.n - 1) * delta * 1e6))


@pytest.mark.parametrize("delta", [0.29, 0.004, 0.01])
def test_cuts_keep_every_sample(spark, delta):
    """Windows that follow one another and day slices share the samples of a trace out, each once."""
    from lagoon.sources import waveforms

    n = 4000
    start = F.expr("timestamp_ntz'2024-01-01 23:59:50'")
    t = spark.range(1).select(F.lit("A").alias("receiver"), start.alias("starttime"), F.lit(delta).alias("delta"), F.lit(n).alias("npts"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")).alias("data"))
    got = [v for r in waveforms.slice_days(t, 0.0).orderBy("starttime").collect() for v in r.data]
    assert got == [float(i) for i in range(n)]
    plus = lambda k: F.timestamp_add("MICROSECOND", F.lit(round(k * delta * 1e6)), start)
    for a, b in ((0, 99), (100, 1099), (1100, 3999)):
        rows = waveforms.get_waveforms(t, "A", plus(a), plus(b)).collect()
        assert [r.data for r in rows] == [[float(i) for i in range(a, b + 1)]] and rows[0].npts == b - a + 1
