"""DuckDB SQL of queries whose kernels are transforms or recursions, written as sums and recursive CTEs.

Transforms are convolutions with kernels that SQL sums up from cosines; filters run sample by sample
over the literal coefficients of their sections.
"""

from __future__ import annotations

from lagoon.kernels import filters, spectral
from lagoon.plans.queries_basic import _HITS, _UNBIASED, COUNT, THR
from lagoon.plans.queries_data import _PLAN
from lagoon.plans.queries_spectral import _COUPLES, _FIT, _NEXT, _PERIODS, _SCALES
from lagoon.plans.register import CROSS, GRID, VECTORS

SQL: dict[str, str] = {}


def _envelope(src: str, n: int) -> str:
    """env(key, i, v) of ``src(key, i, v)``, odd ``n``: the imaginary part is a sum of sines."""
    return f"""hk AS (SELECT u.u, 2.0 / {n} * sum(sin(2 * pi() * k.k * u.u / {n})) AS h FROM range({1 - n}, {n}) u(u), range(1, {(n + 1) // 2}) k(k) GROUP BY 1),
im AS (SELECT a.key, t.i, sum(a.v * hk.h) AS im FROM {src} a, range({n}) t(i), hk WHERE hk.u = t.i - a.i GROUP BY 1, 2),
env AS (SELECT key, i, sqrt(a.v * a.v + im.im * im.im) AS v FROM {src} a JOIN im USING (key, i))"""


def _pass(name: str, src: str, sos, steady: bool = True) -> str:
    """``name(key, i, y)``: the sections over ``src(key, i, v)``, from the steady state of the first value or
    from rest."""

    def stage(x: str, states: list[tuple[str, str]] | None) -> tuple[list[str], str]:
        """Nested selects of the sections; without states those of a constant input."""
        outs, q = [], x
        for k, section in enumerate(sos):
            b0, b1, b2, _, a1, a2 = (repr(float(c)) for c in section)
            k1, k2 = (repr(float(c)) for c in filters._steady(section))
            v = "v" if k == 0 else f"y{k - 1}"
            rest = (f"{k1} * {v}", f"{k2} * {v}") if steady else ("0.0", "0.0")
            s1, s2 = rest if states is None else states[k]
            q = f"SELECT *, {b0} * {v} + {s1} AS y{k}, {s1} AS p{k}, {s2} AS q{k} FROM ({q})"
            outs.append(f"{b1} * {v} - {a1} * y{k} + q{k} AS s{k}, {b2} * {v} - {a2} * y{k} AS t{k}")
        return outs, q

    n = len(sos)
    first, q0 = stage(f"SELECT key, i, v FROM {src} WHERE i = 0", None)
    cols = ", ".join(f"{name}.s{k} AS a{k}, {name}.t{k} AS b{k}" for k in range(n))
    later, q1 = stage(f"SELECT s.key, s.i, s.v, {cols} FROM {name} JOIN {src} s ON s.key = {name}.key AND s.i = {name}.i + 1", [(f"a{k}", f"b{k}") for k in range(n)])
    return f"""{name} AS (SELECT key, i, y{n - 1} AS y, {", ".join(first)} FROM ({q0})
UNION ALL SELECT key, i, y{n - 1} AS y, {", ".join(later)} FROM ({q1}))"""


def _zero_phase(src: str, n: int, order: int, frequency, kind: str, tag: str = "") -> str:
    """zf(key, i, v): forward and backward over ``src`` of ``n`` samples, ends reflected at their points."""
    sos = filters.butterworth(order, frequency, kind, 1.0)
    pad = min(3 * (2 * len(sos) + 1), n - 1)
    size = n + 2 * pad
    return f"""ex{tag} AS (SELECT s.key, CAST(t.i AS INTEGER) AS i, CASE WHEN t.i < {pad} THEN 2 * a.v - s.v WHEN t.i >= {pad + n} THEN 2 * z.v - s.v ELSE s.v END AS v
  FROM range({size}) t(i) JOIN {src} s ON s.i = CASE WHEN t.i < {pad} THEN {pad} - t.i WHEN t.i >= {pad + n} THEN {2 * n + pad - 2} - t.i ELSE t.i - {pad} END
  JOIN {src} a ON a.key = s.key AND a.i = 0 JOIN {src} z ON z.key = s.key AND z.i = {n - 1}),
{_pass("fw" + tag, "ex" + tag, sos)},
rv{tag} AS (SELECT key, CAST({size - 1} - i AS INTEGER) AS i, y AS v FROM fw{tag}),
{_pass("bw" + tag, "rv" + tag, sos)},
zf{tag} AS (SELECT key, {size - 1} - i - {pad} AS i, y AS v FROM bw{tag} WHERE {size - 1} - i BETWEEN {pad} AND {pad + n - 1})"""


def _ramp(i: str, n: int, r: int) -> str:
    return f"CASE WHEN {i} < {r} THEN 0.5 - 0.5 * cos(pi() * ({i}) / {r}) WHEN {i} >= {n - r} THEN 0.5 - 0.5 * cos(pi() * ({r} + {i} - {n - r}) / {r}) ELSE 1.0 END"


# ---- envelopes

_CLIPPED = _UNBIASED + ", uk AS (SELECT pair AS key, lag + 168 AS i, cc AS v FROM u)"
SQL["snr_envelope"] = f"""WITH {_CLIPPED}, {_envelope("uk", 337)},
s AS (SELECT key, v AS s, i - 168 AS lag, row_number() OVER (PARTITION BY key ORDER BY round(v, 6) DESC, i) AS k FROM env WHERE abs(i - 168) <= 12),
n AS (SELECT key, sqrt(avg(v * v)) AS n FROM env WHERE i - 168 >= 72 GROUP BY 1)
SELECT key AS pair, CAST(lag AS DOUBLE) AS lag_s_max, round(s / n, 6) AS snr FROM s JOIN n USING (key) WHERE k = 1"""
SQL["unbiased_envelope"] = f"""WITH {_CLIPPED}, um AS (SELECT key, i, v - avg(v) OVER (PARTITION BY key) AS v FROM uk), {_envelope("um", 337)}
SELECT key AS pair, CAST(i - 168 AS INTEGER) AS lag, round(v, 1) + 0.0 AS v FROM env"""

# ---- triggers: on where the last sample at or above the upper threshold is after the last below the lower

SQL["coincidence_hysteresis"] = f"""WITH {GRID}, il AS (SELECT receiver, h, v, h - row_number() OVER (PARTITION BY receiver ORDER BY h) AS g FROM e),
st AS (SELECT receiver, h, max(CASE WHEN v >= {THR} THEN h END) OVER w AS at_on, max(CASE WHEN v < {THR / 2} THEN h END) OVER w AS at_off FROM il
  WINDOW w AS (PARTITION BY receiver, g ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hits AS (SELECT h FROM st WHERE at_on IS NOT NULL AND (at_off IS NULL OR at_off < at_on) GROUP BY h HAVING count(DISTINCT receiver) >= {COUNT}),
{_HITS.format(thr=THR, count=COUNT, ext=1, steps=2).split("HAVING count(DISTINCT receiver) >= " + str(COUNT) + "),", 1)[1]} SELECT h, period FROM tg"""

# ---- shifts and rates by interpolation kernels of the spectrum

SQL["timeshift_fractional"] = f"""WITH {VECTORS}, dl AS (SELECT i * 0.25 AS d FROM range(5) t(i)),
kn AS (SELECT u.u, dl.d, (1 + 2 * sum(cos(2 * pi() * k.k * (u.u - dl.d) / 64)) + any_value(cos(pi() * dl.d) * cos(pi() * u.u))) / 64 AS w FROM range(-63, 64) u(u), dl, range(1, 32) k(k) GROUP BY 1, 2)
SELECT a.vec_id, CAST(t.i AS INTEGER) AS k, round(sum(a.v * kn.w), 6) + 0.0 AS v FROM v a, range(64) t(i), kn WHERE kn.u = t.i - a.k AND kn.d = (a.vec_id % 5) * 0.25 GROUP BY 1, 2"""
SQL["op_resample"] = f"""WITH {VECTORS}, kn AS (SELECT u.u, (1 + 2 * sum(cos(2 * pi() * k.k * u.u / 64))) / 64 AS w FROM range(-64, 64) u(u), range(1, 17) k(k) GROUP BY 1)
SELECT a.vec_id, CAST(t.i AS INTEGER) AS k, round(sum(a.v * kn.w), 6) + 0.0 AS v FROM v a, range(32) t(i), kn WHERE kn.u = 2 * t.i - a.k GROUP BY 1, 2"""
_SINC = "CASE WHEN {x} = 0 THEN 1.0 ELSE sin(pi() * {x}) / (pi() * {x}) END"
SQL["op_interpolate_lanczos"] = f"""WITH {VECTORS}, pl AS (SELECT CAST(i AS INTEGER) AS k, i / 4 AS t FROM range(253) r(i)), x AS (SELECT vec_id, pl.k, pl.t - v.k AS d, v FROM v, pl WHERE v.k BETWEEN floor(pl.t) - 19 AND floor(pl.t) + 20)
SELECT vec_id, k, round(sum(v * {_SINC.format(x="d")} * {_SINC.format(x="(d / 20)")}), 6) + 0.0 AS v FROM x GROUP BY 1, 2"""
# one over the response 2 s / ((s - p)(s - q)), p, q = -1e-4 +- 1e-4 i, at s = i w, is (b - i a) / 2 w with a = 2e-8 - w^2, b = 2e-4 w
SQL["op_remove_response"] = f"""WITH {GRID}, fr AS (SELECT k, 2 * pi() * k / (720 * 3600.0) AS w FROM range(361) t(k)), ab AS (SELECT k, w, 2e-8 - w * w AS a, 2e-4 * w AS b FROM fr),
hh AS (SELECT *, 2 * w / sqrt(a * a + b * b) AS size FROM ab), fl AS (SELECT max(size) * 1e-3 AS fl FROM hh),
ih AS (SELECT k, CASE WHEN size = 0 THEN 1 / fl WHEN size < fl THEN b / sqrt(a * a + b * b) / fl ELSE b / (2 * w) END AS re, CASE WHEN size = 0 THEN 0 WHEN size < fl THEN -a / sqrt(a * a + b * b) / fl ELSE -a / (2 * w) END AS im FROM hh, fl),
kn AS (SELECT u, sum(CASE WHEN k IN (0, 360) THEN re * cos(2 * pi() * k * u / 720) ELSE 2 * (re * cos(2 * pi() * k * u / 720) - im * sin(2 * pi() * k * u / 720)) END) / 720 AS w FROM ih, range(720) t(u) GROUP BY 1)
SELECT a.receiver, CAST(t.i AS INTEGER) AS h, round(sum(a.v * kn.w), 3) + 0.0 AS v FROM g a, range(720) t(i), kn WHERE kn.u = (t.i - a.h + 720) % 720 GROUP BY 1, 2"""

# ---- filters

_SERIES = GRID + ", sr AS (SELECT receiver AS key, h AS i, v FROM g)"
for _name, _args in {"filter_lowpass": (2, 0.1, "lowpass"), "filter_highpass": (4, 0.1, "highpass"), "filter_bandpass": (2, (0.05, 0.2), "bandpass")}.items():
    SQL[_name] = f"WITH RECURSIVE {_SERIES}, {_zero_phase('sr', 720, *_args)} SELECT key AS receiver, CAST(i AS INTEGER) AS h, round(v, 4) + 0.0 AS v FROM zf"
SQL["op_decimate_lowpass"] = f"""WITH RECURSIVE {VECTORS}, sr AS (SELECT vec_id AS key, k AS i, v FROM v), {_zero_phase("sr", 64, 4, 0.1, "lowpass")}
SELECT key AS vec_id, CAST(i // 4 AS BIGINT) AS k, round(v, 6) + 0.0 AS v FROM zf WHERE i % 4 = 0"""

# ---- windows of correlations

_WINDOWS = f"""{_PLAN}, wc AS (SELECT pair, ps.start, a.h - b.h AS lag, sum(a.v * b.v) AS cc FROM ps JOIN g a ON a.receiver = rx_a AND a.h >= ps.start AND a.h < ps.start + 120
JOIN g b ON b.receiver = rx_b AND b.h >= ps.start AND b.h < ps.start + 120 AND abs(a.h - b.h) <= 24 WHERE status = 1 GROUP BY ALL)"""
SQL["pipeline_snr_windows"] = f"""WITH {_WINDOWS}, s AS (SELECT pair, start, abs(cc) AS s, lag, row_number() OVER (PARTITION BY pair, start ORDER BY round(abs(cc), 6) DESC, lag) AS k FROM wc WHERE abs(lag) <= 6),
n AS (SELECT pair, start, sqrt(avg(cc * cc)) AS n FROM wc WHERE lag >= 12 GROUP BY 1, 2)
SELECT pair, start, round(s, 4) AS s, CAST(lag AS DOUBLE) AS lag_s_max, round(s / n, 6) AS snr FROM s JOIN n USING (pair, start) WHERE k = 1"""
SQL["postprocess"] = f"""WITH RECURSIVE {_WINDOWS}, ub AS (SELECT pair || '|' || start AS key, lag + 24 AS i, cc * 120 / (120 - abs(lag)) AS v FROM wc),
dm AS (SELECT key, i, v - avg(v) OVER (PARTITION BY key) AS v FROM ub), tp AS (SELECT key, i, v * ({_ramp("i", 49, 5)}) AS v FROM dm),
sh AS (SELECT key, CAST((i + 1) % 49 AS INTEGER) AS i, v FROM tp), {_zero_phase("sh", 49, 2, 0.1, "highpass")}
SELECT split_part(key, '|', 1) AS pair, CAST(split_part(key, '|', 2) AS INTEGER) AS start, CAST(i - 24 AS INTEGER) AS lag, round(v * ({_ramp("i", 49, 2)}), 3) + 0.0 AS v FROM zf"""
SQL["chain_fluent"] = f"""WITH RECURSIVE {_CLIPPED}, dm AS (SELECT key, i, v - avg(v) OVER (PARTITION BY key) AS v FROM uk), tp AS (SELECT key, CAST(i AS INTEGER) AS i, v * ({_ramp("i", 337, 12)}) AS v FROM dm),
{_zero_phase("tp", 337, 2, 0.1, "highpass")},
s AS (SELECT key, abs(v) AS s, i - 168 AS lag, row_number() OVER (PARTITION BY key ORDER BY round(abs(v), 6) DESC, i) AS k FROM zf WHERE abs(i - 168) <= 12),
n AS (SELECT key, sqrt(avg(v * v)) AS n FROM zf WHERE i - 168 >= 72 GROUP BY 1)
SELECT key AS pair, CAST(lag AS DOUBLE) AS lag_s_max, round(s / n, 6) AS snr FROM s JOIN n USING (key) WHERE k = 1"""

# ---- time and frequency


def _spectrogram(src: str, n: int, size: int, hop: int, padding: int) -> str:
    """sp(key, f, i, v): the density of segments of ``size`` each ``hop`` at their centres, zero elsewhere."""
    nfft, edge = size * padding, size / 8
    top = nfft // 2
    segments = (n - size) // hop + 1
    return f"""wi AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < {edge} THEN 0.5 * (1 - cos(pi() * i / {edge})) WHEN i > {size - edge} THEN 0.5 * (1 - cos(pi() * ({size} - i) / {edge})) ELSE 1.0 END AS w FROM range({size}) t(i)),
sg AS (SELECT key, s.s, a.i - s.s * {hop} AS i, v - avg(v) OVER (PARTITION BY key, s.s) AS v FROM {src} a, range({segments}) s(s) WHERE a.i >= s.s * {hop} AND a.i < s.s * {hop} + {size}),
tr AS (SELECT CAST(f AS INTEGER) AS f, i, w * cos(2 * pi() * i * f / {nfft}) AS c, w * sin(2 * pi() * i * f / {nfft}) AS s FROM wi, range({top + 1}) t(f)),
ft AS (SELECT key, sg.s, f, pow(sum(v * c), 2) + pow(sum(v * tr.s), 2) AS p FROM sg JOIN tr USING (i) GROUP BY ALL),
sp AS (SELECT k.key, f.f, CAST(t.i AS INTEGER) AS i, coalesce(p * CASE WHEN f.f IN (0, {top}) THEN 1 ELSE 2 END / (SELECT sum(w * w) FROM wi), 0.0) AS v
  FROM (SELECT DISTINCT key FROM {src}) k CROSS JOIN range({top + 1}) f(f) CROSS JOIN range({n}) t(i) LEFT JOIN ft ON ft.key = k.key AND ft.f = f.f AND ft.s * {hop} + {size // 2} = t.i)"""


SQL["spectrogram"] = f"""WITH {VECTORS}, sr AS (SELECT vec_id AS key, k AS i, v FROM v), {_spectrogram("sr", 64, 16, 1, 2)}
SELECT key AS vec_id, round(f / 32, 9) AS freq, i AS h, round(v, 4) + 0.0 AS v FROM sp"""
SQL["spectrogram_overlap"] = f"""WITH {_SERIES}, {_spectrogram("sr", 720, 48, 5, 2)} SELECT key AS receiver, round(f / 96, 9) AS freq, i AS h, round(log10(1 + v), 6) + 0.0 AS v FROM sp"""
_SPECTRA = f"""{_WINDOWS}, sr AS (SELECT pair || '|' || start AS key, lag + 24 AS i, cc AS v FROM wc), {_spectrogram("sr", 49, 16, 1, 2)}, sq AS (SELECT * FROM sp WHERE f / 32 <= 0.4)"""
_KEYS = "split_part(key, '|', 1) AS pair, CAST(split_part(key, '|', 2) AS INTEGER) AS start"
SQL["pipeline_psd"] = f"WITH {_SPECTRA} SELECT {_KEYS}, round(f / 32, 9) AS freq, i AS h, round(log10(1 + v), 6) + 0.0 AS v FROM sq"
SQL["pipeline_plmax"] = f"""WITH {_SPECTRA}, tp AS (SELECT key, max(v) AS top FROM sq GROUP BY 1),
pk AS (SELECT a.key, a.f, a.i, a.v FROM sq a JOIN tp USING (key) JOIN sq b ON b.key = a.key AND abs(b.f - a.f) <= 3 AND abs(b.i - a.i) <= 3 WHERE a.v > 0 AND a.v >= 0.01 * top GROUP BY 1, 2, 3, 4 HAVING max(b.v) <= a.v)
SELECT {_KEYS}, round(f / 32, 9) AS freq, i AS index, round(log10(1 + v), 6) AS v, CAST(row_number() OVER (PARTITION BY key ORDER BY v DESC, f, i) - 1 AS INTEGER) AS rank FROM pk"""


def _wavelet(scales) -> str:
    """wv(receiver, s, i, re, im): sums with the wavelet's values, themselves sums over its spectrum."""
    listed = ", ".join(repr(float(s)) for s in scales)
    return f"""sc AS (SELECT unnest([{listed}]) AS s), bk AS (SELECT s, k, sqrt(s) * exp(-pow(pi() * (s * (CASE WHEN k < 1024 THEN k ELSE k - 2048 END) / 2048.0 - 1.0), 2) * 1.5) AS b FROM sc, range(2048) t(k)),
kn AS (SELECT s, CAST(u AS INTEGER) AS u, sum(b * cos(2 * pi() * k * u / 2048)) / 2048 AS re, sum(b * sin(2 * pi() * k * u / 2048)) / 2048 AS im FROM bk, range(-719, 720) t(u) WHERE b > 1e-30 GROUP BY 1, 2),
wv AS (SELECT a.receiver, kn.s, a.h + kn.u AS i, sum(a.v * kn.re) AS re, sum(a.v * kn.im) AS im FROM g a, kn WHERE a.h + kn.u BETWEEN 0 AND 719 GROUP BY 1, 2, 3)"""


SQL["cwt"] = f"WITH {GRID}, {_wavelet(_SCALES)} SELECT receiver, round(1 / s, 9) AS freq, CAST(i AS INTEGER) AS h, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM wv"
_FINE = [s for s in spectral.scales(1.0, 1.5, 1.0, 24) if 0.01 <= 1 / s <= 0.4]
SQL["scaleogram"] = f"WITH {GRID}, {_wavelet(_FINE)} SELECT receiver, round(1 / s, 9) AS freq, CAST(i AS INTEGER) AS h, round(sqrt(re * re + im * im), 4) + 0.0 AS v FROM wv"

# ---- streams: clicks, views and errors as the components 1, 2 and Z of a station

_ARRAY = "CASE receiver WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'error' THEN 'Z' END"
_MERGED = GRID + """, mk AS (SELECT *, lead(h) OVER w AS h2, lead(v) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY receiver ORDER BY h)), mx AS (SELECT *, unnest(range(0, coalesce(h2 - h, 1))) AS i FROM mk),
mg AS (SELECT receiver, CAST(h + i AS INTEGER) AS h, CASE WHEN i = 0 THEN v ELSE v + (v2 - v) * i / (h2 - h) END AS v FROM mx)"""
SQL["op_stream_merge"] = f"WITH {_MERGED} SELECT receiver, h, round(v, 5) + 0.0 AS v FROM mg"
SQL["op_stream_running_rms"] = f"WITH {GRID} SELECT receiver, CAST(h // 7 AS INTEGER) AS k, TIMESTAMP '2024-01-01' + to_hours(CAST(h // 7 * 7 + 3 AS BIGINT)) AS time, round(sqrt(avg(v * v)), 5) AS rms FROM g GROUP BY ALL"
_TURN = """nn AS (SELECT i, a.v * cos(radians(30)) + b.v * cos(radians(120)) AS n, a.v * sin(radians(30)) + b.v * sin(radians(120)) AS e FROM {x} a JOIN {x} b USING (i) WHERE a.key = '1' AND b.key = '2'),
rr AS (SELECT 'R' AS key, i, -n * cos(radians(250.39)) - e * sin(radians(250.39)) AS v, n * sin(radians(250.39)) - e * cos(radians(250.39)) AS t FROM nn)"""
SQL["op_stream_rotate"] = f"""WITH {GRID}, sr AS (SELECT {_ARRAY} AS key, h AS i, v FROM g), {_TURN.format(x="sr")}
SELECT CASE c WHEN 0 THEN 'XX.STA.00.BHR' WHEN 1 THEN 'XX.STA.00.BHT' ELSE 'XX.STA.00.BHZ' END AS receiver, CAST(rr.i AS INTEGER) AS h, round(CASE c WHEN 0 THEN rr.v WHEN 1 THEN rr.t ELSE z.v END, 5) + 0.0 AS v
FROM rr JOIN sr z ON z.i = rr.i AND z.key = 'Z', range(3) q(c)"""
SQL["op_stream_response"] = SQL["op_remove_response"]
_HIGH, _LOW = (filters.butterworth(4, f, k, 1.0) for f, k in ((0.05, "highpass"), (0.2, "lowpass")))
SQL["op_process_recipe"] = f"""WITH RECURSIVE {_MERGED}, sr AS (SELECT {_ARRAY} AS key, h - 24 AS i, v - avg(v) OVER (PARTITION BY receiver) AS v FROM mg WHERE receiver IN ('click', 'view', 'error') QUALIFY h BETWEEN 24 AND 695),
{_pass("hp", "sr", _HIGH, False)}, hv AS (SELECT key, i, y AS v FROM hp), {_TURN.format(x="hv")},
pl AS (SELECT CAST(i AS INTEGER) AS k, i / 2 AS t FROM range(1343) r(i)), lx AS (SELECT pl.k, pl.t - rr.i AS d, v FROM rr, pl WHERE rr.i BETWEEN floor(pl.t) - 19 AND floor(pl.t) + 20),
li AS (SELECT 'R' AS key, k AS i, sum(v * {_SINC.format(x="d")} * {_SINC.format(x="(d / 20)")}) AS v FROM lx GROUP BY k), {_pass("lp", "li", _LOW, False)},
lm AS (SELECT i, y - avg(y) OVER () AS v FROM lp) SELECT 'XX.STA.00.BHR' AS receiver, CAST(i AS INTEGER) AS k, round(v * ({_ramp("i", 1343, 60)}), 4) + 0.0 AS v FROM lm"""
_KINDS = {"hann": "0.5 - 0.5 * cos(pi() * t / 6)", "hamming": "0.54 - 0.46 * cos(pi() * t / 6)", "blackman": "0.42 - 0.5 * cos(pi() * t / 6) + 0.08 * cos(2 * pi() * t / 6)", "cosine": "sin(pi() * (t + 0.5) / 13)", "bartlett": "t / 6", "boxcar": "1.0"}
SQL["window_types"] = "WITH k AS (SELECT CAST(k AS INTEGER) AS k, least(k, 64 - k) AS t FROM range(64) q(k)) SELECT k, " + ", ".join(f"CAST(CASE WHEN t < 6 OR k >= 58 THEN round({x}, 8) + 0.0 ELSE 1.0 END AS DOUBLE) AS {n}" for n, x in _KINDS.items()) + " FROM k"

# ---- options

SQL["cc_options"] = f"""WITH {_NEXT}, xy AS (SELECT p.vec_id, a.k AS i, b.k AS j, a.v * b.v AS v, na.n * nb.n AS n FROM p JOIN v a ON a.vec_id = p.vec_id JOIN v b ON b.vec_id = p.nx JOIN nm na ON na.vec_id = p.vec_id JOIN nm nb ON nb.vec_id = p.nx)
SELECT vec_id, i - j AS lag, round(sum(v) / any_value(n) * 64 / (64 - abs(i - j)), 6) + 0.0 AS v, 'unbiased' AS kind FROM xy GROUP BY 1, 2
UNION ALL SELECT vec_id, (i - j + 96) % 64 - 32 AS lag, round(sum(v), 6) + 0.0 AS v, 'circular' AS kind FROM xy GROUP BY 1, 2"""
SQL["lombscargle_periods"] = f"""WITH {GRID}, x AS (SELECT receiver, h AS t, v - avg(v) OVER (PARTITION BY receiver) AS v FROM e),
fq AS (SELECT 'period' AS kind, x, 2 * pi() / x AS w FROM (SELECT unnest({_PERIODS}) AS x) UNION ALL SELECT 'angular', x, x FROM (SELECT unnest([0.2, 0.5]) AS x)), w AS (SELECT * EXCLUDE (x.v), x.v AS v FROM x CROSS JOIN fq),
ta AS (SELECT receiver, kind, x, any_value(w) AS w, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / 2 / any_value(w) AS tau FROM w GROUP BY 1, 2, 3),
p AS (SELECT w.receiver, w.kind, w.x, 0.5 * (pow(sum(v * cos(w.w * (t - tau))), 2) / sum(pow(cos(w.w * (t - tau)), 2)) + pow(sum(v * sin(w.w * (t - tau))), 2) / sum(pow(sin(w.w * (t - tau)), 2))) AS p, sum(v * v) AS vv, count(*) AS n
  FROM w JOIN ta ON ta.receiver = w.receiver AND ta.kind = w.kind AND ta.x = w.x GROUP BY 1, 2, 3)
SELECT receiver, kind, CAST(x AS DOUBLE) AS x, round(sqrt(4 * p / n), 6) AS amplitude, round(2 * p / vv, 8) AS share FROM p"""
_LISTED = ", ".join(repr(float(x)) for x in _SCALES)
SQL["cwt_conv"] = f"""WITH {GRID}, sc AS (SELECT CAST(unnest([{_LISTED}]) AS DOUBLE) AS s), tt AS (SELECT s, CAST(u AS INTEGER) AS u, u / s AS t FROM sc, range(-719, 720) q(u)),
kn AS (SELECT 'cmor' AS wavelet, s, u, 1.0 AS c, cos(2 * pi() * t) * exp(-t * t / 1.5) / sqrt(pi() * 1.5 * s) AS re, sin(2 * pi() * t) * exp(-t * t / 1.5) / sqrt(pi() * 1.5 * s) AS im FROM tt
  UNION ALL SELECT 'mexh', s, u, 0.25, 2 / (sqrt(3) * pow(pi(), 0.25)) * (1 - t * t) * exp(-t * t / 2) / sqrt(s), 0.0 FROM tt)
SELECT a.receiver, kn.wavelet, round(any_value(kn.c) / kn.s, 9) AS freq, CAST(a.h + kn.u AS INTEGER) AS h, round(sum(a.v * kn.re), 3) + 0.0 AS re, round(sum(a.v * kn.im), 3) + 0.0 AS im
FROM g a, kn WHERE a.h + kn.u BETWEEN 0 AND 719 GROUP BY a.receiver, kn.wavelet, kn.s, a.h + kn.u"""
SQL["plane_wave_envelope"] = f"""WITH {CROSS}, {_COUPLES}, wc AS (SELECT a.receiver AS rx_a, b.receiver AS rx_b, CAST(a.h // 120 AS INTEGER) AS time, a.h - b.h AS lag, sum(a.v * b.v) AS cc FROM g a JOIN g b ON a.receiver < b.receiver AND a.h // 120 = b.h // 120 GROUP BY ALL),
wk AS (SELECT rx_a || '|' || rx_b || '|' || time AS key, lag + 119 AS i, cc - avg(cc) OVER (PARTITION BY rx_a, rx_b, time) AS v FROM wc), {_envelope("wk", 239)},
tk AS (SELECT key, i - 119 AS lag, row_number() OVER (PARTITION BY key ORDER BY round(v, 5) DESC, i) AS k FROM env),
dl AS (SELECT split_part(key, '|', 1) AS rx_a, split_part(key, '|', 2) AS rx_b, CAST(split_part(key, '|', 3) AS INTEGER) AS time, CAST(lag AS DOUBLE) AS tau FROM tk WHERE k = 1), {_FIT}"""
_DIGEST = VECTORS + """, rh AS (SELECT vec_id, any_value(label) AS label, sha256(concat_ws('|', CAST(vec_id AS VARCHAR), string_agg(CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY k))) AS h FROM v GROUP BY 1),
rd AS (SELECT label, """ + ", ".join(f"CAST(('0x' || substr(h, {1 + 15 * k}, 15)) AS BIGINT) AS d{k}" for k in range(4)) + " FROM rh)"
_SUMS = "sha256(concat_ws('|', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(sum(d{k}) AS VARCHAR)" for k in range(4)) + ")) AS hash"
SQL["dataset_hash"] = f"WITH {_DIGEST} SELECT label, {_SUMS} FROM rd GROUP BY label UNION ALL SELECT NULL, {_SUMS} FROM rd"
