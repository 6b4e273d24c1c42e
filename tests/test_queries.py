"""Every query of the time-series engine against DuckDB, or a plain NumPy version where SQL cannot say it."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from lagoon.kernels import geodesic
from lagoon.plans import registry

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: the smallest tables have too few events for whole windows and for triggers of two thresholds
WINDOWED = {"process_windows", "postprocess", "pipeline_snr_windows", "pipeline_psd", "pipeline_plmax", "pipeline_timelapse", "pipeline_beamform", "coincidence_trigger", "coincidence_hysteresis",
            "trigger_periods", "trigger_values", "period_days", "snr_peak_cap", "pipeline_ct", "max_gap_filter", "gating_semi_join", "op_process_recipe"}
PLAIN = {}


def sf_of(name):
    return MORE if name in WINDOWED else SF


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in (SF, MORE):
        c = out[sf] = duckdb.connect()
        for f in os.listdir(sf):
            c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return out


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.7g}"
    return str(v)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, ducks, name):
    duck = ducks[sf_of(name)]
    df = registry.QUERIES[name](spark, sf_of(name))
    got = df.collect()
    assert got
    if name not in registry.ORACLE:
        PLAIN[name](spark, duck, got)
        return
    want = duck.sql(registry.ORACLE[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    want = want.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    got = [tuple(r[c] for c in cols) for r in got]
    assert len(got) == len(want)
    key = lambda r: [shown(round(v, 3)) if isinstance(v, float) else shown(v) for v in r]
    floats = lambda r: sum(isinstance(v, float) for v in r)
    ids = lambda r: ([str(v) for v in r if not isinstance(v, float)], key(r))
    assert all(floats(r) == floats(w) and all(close(float(a) if isinstance(b, float) and a is not None else a, b) or str(a) == str(b) for a, b in zip(r, w, strict=True)) for r, w in zip(sorted(got, key=ids), sorted(want, key=ids), strict=True))


def plain(check):
    PLAIN[check.__name__] = check
    return check


@plain
def series_hash_bytes(spark, duck, got):
    want = {i: hashlib.sha256(np.asarray(x, "<f8").tobytes()).hexdigest() for i, x in duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()}
    assert {r.vec_id: r.hash for r in got} == want


@plain
def pair_distance_geodesic(spark, duck, got):
    """Within what flattening makes of the spherical distance, and exact along the equator."""
    ball = {r.pair: r.km for r in registry.QUERIES["pair_distance_haversine"](spark, SF).collect()}
    assert set(ball) == {r.pair for r in got} and all(abs(r.km / ball[r.pair] - 1) < 0.0062 for r in got)
    assert abs(geodesic.distance(*[np.array([v]) for v in (0.0, 10.0, 0.0, 31.0)])[0] - 6378137 * math.radians(21)) < 1e-3


@plain
def pipeline_timelapse(spark, duck, got):
    """Every lag of every two spectrograms of a pair by direct sums."""
    bands = [(0.05, 0.2), (0.2, 0.4)]
    cells = {}
    for pair, start, freq, h, v in duck.sql(registry.ORACLE["pipeline_psd"].replace("log10(1 + v), 6", "v, 12")).fetchall():
        for b, (lo, hi) in enumerate(bands):
            if lo <= freq < hi:
                cells.setdefault((pair, b), {}).setdefault(start, {}).setdefault(round(freq * 32), {})[h] = v
    found = {(r.pair, r.band, r.time1, r.time2): r for r in got}
    n = 0
    for (pair, b), by in cells.items():
        z = {t: np.array([[rows[f][h] for h in sorted(rows[f])] for f in sorted(rows)]) for t, rows in by.items()}
        for t1 in z:
            for t2 in z:
                x, y = (z[t1], z[t2]) if t2 <= t1 else (z[t2], z[t1])
                best = (-np.inf, 0, 0)
                r, c = x.shape
                pad = np.zeros((3 * r - 2, 3 * c - 2))
                pad[r - 1 : 2 * r - 1, c - 1 : 2 * c - 1] = x
                view = np.lib.stride_tricks.sliding_window_view(pad, (r, c))
                full = np.tensordot(view, y, axes=([2, 3], [0, 1])) / np.sqrt((x**2).sum() * (y**2).sum())
                i, k = np.unravel_index(np.argmax(full), full.shape)
                best = (full[i, k], i - (r - 1), k - (c - 1))
                sign = 1 if t2 <= t1 else -1
                q = found[pair, b, t1, t2]
                n += 1
                assert abs(q.cc2 - best[0]) < 2e-6
                assert (q.delta_freq, q.delta_lag) == (sign * best[1], sign * best[2]) or abs(q.cc2 - full.max()) < 1e-6
    assert n == len(got) > 1000
