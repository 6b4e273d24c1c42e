"""Beams of small event tables against their SQL: waves everywhere at once, equal peaks, missing delays."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.kernels import fourier
from lagoon.operators import matrix
from lagoon.plans import registry

TYPES = ["click", "error", "purchase", "signup", "view"]


def both(spark, folder, name, value, types=TYPES):
    """The rows of a query and of its SQL for events (hour, type) -> value, None for no event."""
    rows = [(h, t, value(h, t)) for h in range(720) for t in types]
    con = duckdb.connect()
    values = ", ".join(f"({h}, '{t}', {v!r})" for h, t, v in rows if v is not None)
    con.sql(f"CREATE TABLE events AS SELECT TIMESTAMP '2024-01-01' + to_hours(h) AS ts, t AS event_type, CAST(v AS DOUBLE) AS value FROM (VALUES {values}) e(h, t, v)")
    con.sql(f"COPY events TO '{folder}/events.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(con.sql(registry.ORACLE[name]).select(", ".join(df.columns)).fetchall())


def test_beam_of_a_wave_everywhere_at_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "pipeline_beamform", lambda h, t: 12.34)
    assert got == want == [(i, 0.0, 0.0, 0.0, math.inf, 0.0) for i in range(6)]


def test_beam_of_equal_peaks(spark, tmp_path):
    """Spikes of one size meet equally often at several lags: the first counts."""
    rng = np.random.default_rng(3)
    for size in (1.0, 1e6):
        hours = {t: set(rng.choice(720, 40, replace=False).tolist()) for t in TYPES}
        folder = tmp_path / str(int(size))
        folder.mkdir()
        got, want = both(spark, folder, "pipeline_beamform", lambda h, t, s=size, at=hours: s if h in at[t] else None)
        assert got == want and len(got) == 6


def test_peak_lag_is_the_first_of_equal_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 120):
        x, y = rng.integers(-1, 2, (2, 30, n))
        want = [int(np.argmax(np.correlate(a, b, "full"))) - (n - 1) for a, b in zip(x, y, strict=True)]
        # hundredths are no binary fractions: equal sums of their products are rounded differently
        for unit in (1.0, 0.01, 12345.67):
            assert fourier.peak_lag(x * unit, y * unit).tolist() == want
    assert fourier.peak_lag(np.zeros((1, 4)), np.ones((1, 4))).tolist() == [-3]


def test_plane_wave_of_known_delays(spark):
    xy = [(f"r{i}", float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (900, 100), (-300, 700), (200, -800)])]
    g = matrix.couples(spark.createDataFrame(xy, "receiver string, x double, y double"), "receiver", "x", "y")
    tau = F.col("dx") * 0.0004 - F.col("dy") * 0.0003
    d = g.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("tau", F.when((F.col("t") == 0) | (F.col("rx_a") != "r1"), tau))
    fits = {r.t: r for r in matrix.plane_wave(d, ["t"]).collect()}
    assert all(abs(r.s_x - 0.4) < 1e-9 and abs(r.s_y + 0.3) < 1e-9 for r in fits.values()) and len(fits) == 2
    assert [r.t for r in matrix.plane_wave(d, ["t"], n_pairs=6).collect()] == [0]


def test_envelope_beam_of_a_wave_everywhere_at_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "plane_wave_envelope", lambda h, t: 12.34)
    assert got == want == [(i, 0.0, 0.0, 0.0, math.inf, 0.0) for i in range(6)]


def test_envelope_beam_needs_all_receivers(spark, tmp_path):
    got, want = both(spark, tmp_path, "plane_wave_envelope", lambda h, t: float((h * 7 + len(t)) % 11 + 1), TYPES[:4])
    assert got == want == []


def test_envelope_beam_of_equal_peaks(spark, tmp_path):
    """Windows that read the same backwards have envelopes with equal peaks at opposite lags."""
    rng = np.random.default_rng(1)
    half = {(w, t): set(rng.choice(60, 6, replace=False).tolist()) for w in range(6) for t in TYPES}
    for size in (1.0, 12.34):
        folder = tmp_path / str(int(size))
        folder.mkdir()
        got, want = both(spark, folder, "plane_wave_envelope", lambda h, t, s=size: s if min(h % 120, 119 - h % 120) in half[h // 120, t] else None)
        assert got == want and len(got) == 6


def test_argmax_of_nearly_equal_values(spark):
    rows = [("noise", [1.0, 3.0, 3.0 + 4e-16 * 3]), ("decimals", [0.0, 2.000001, 2.000004]), ("apart", [0.0, 2.0, 2.0001]), ("large", [1e12, 1e12 + 0.01, 5.0]), ("negative", [-4e12, -3e12 - 0.01, -3e12]), ("gap", [None, 1.0, 2.0]), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x array<double>")
    got = {r.k: r.i for r in df.select("k", A.argmax(F.col("x"), 5).alias("i")).collect()}
    assert got == {"noise": 1, "decimals": 1, "apart": 2, "large": 0, "negative": 1, "gap": 2, "none": None}
