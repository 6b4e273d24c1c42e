"""Queries on correlation, element-wise operators, signal-to-noise ratios and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions.core import tidy
from lagoon.operators import correlate, detect, matrix
from lagoon.plans import fixtures as X
from lagoon.plans import pipelines
from lagoon.plans.register import CROSS, GRID, VECTORS, Registry

Q = Registry()
N, DELTA = X.HOURS, X.HOUR


@Q(f"WITH {GRID} SELECT receiver, h, v FROM g")
def dense_grid(spark, d):
    return X.grid(spark, d)


@Q(f"WITH {CROSS} SELECT pair, lag, round(cc, 4) + 0.0 AS cc FROM cc")
def cc_full(spark, d):
    return correlate.to_long(X.cross(spark, d), ["pair"], "cc", "lag", "cc", 1 - N).withColumn("cc", tidy(F.col("cc"), 4))


@Q(f"""WITH {CROSS}, p AS (SELECT receiver, sqrt(sum(v * v)) AS p FROM g GROUP BY 1)
SELECT pair, lag, round(cc / (a.p * b.p), 8) + 0.0 AS cc FROM cc JOIN p a ON a.receiver = split_part(pair, '-', 1) JOIN p b ON b.receiver = split_part(pair, '-', 2)""")
def cc_normalized(spark, d):
    return correlate.to_long(X.cross(spark, d, True), ["pair"], "cc", "lag", "cc", 1 - N).withColumn("cc", tidy(F.col("cc"), 8))


@Q(f"WITH {CROSS} SELECT pair, lag * 3600e0 AS lag, round(cc, 4) + 0.0 AS cc FROM cc WHERE lag BETWEEN -48 AND 48")
def cc_clip_lag(spark, d):
    x = X.cross(spark, d).select("pair", A.clip_lags(F.col("cc"), N, DELTA, -48 * DELTA, 48 * DELTA).alias("cc"))
    return correlate.to_long(x, ["pair"], "cc", "k", "cc", -48).select("pair", (F.col("k") * DELTA).alias("lag"), tidy(F.col("cc"), 4).alias("cc"))


@Q(f"""WITH {GRID} SELECT a.receiver || '-' || b.receiver AS pair, a.h - b.h AS lag, round(sum(a.v * b.v), 4) + 0.0 AS cc FROM g a JOIN g b ON a.receiver < b.receiver
WHERE a.v <> 0 AND b.v <> 0 AND abs(a.h - b.h) <= 24 GROUP BY ALL""")
def cc_sql(spark, d):
    return correlate.cc_long(X.grid(spark, d), "receiver", "h", "v", 24).withColumn("cc", tidy(F.col("cc"), 4))


@Q("SELECT CAST(i AS BIGINT) AS k, i * 3600e0 AS lag FROM range(-719, 720) t(i)")
def lag_axis(spark, d):
    return spark.range(1 - N, N).select(F.col("id").alias("k"), (F.col("id") * DELTA).alias("lag"))


@Q("SELECT CAST(i AS BIGINT) AS k, round(720 / (720 - abs(i)), 8) AS w, round(least(720 / (720 - abs(i)), 10.0), 8) AS w_clip FROM range(-719, 720) t(i)")
def unbias_weights(spark, d):
    k = F.col("id")
    return spark.range(1 - N, N).select(k.alias("k"), F.round(A.weight(k, N), 8).alias("w"), F.round(A.weight(k, N, 10.0), 8).alias("w_clip"))


_TOP = "SELECT pair, lag, cc, row_number() OVER (PARTITION BY pair ORDER BY round(cc, 6) DESC, lag) AS i FROM cc"


@Q(f"WITH {CROSS}, t AS ({_TOP}) SELECT pair, CAST(lag AS DOUBLE) AS shift FROM t WHERE i = 1")
def extract_shift(spark, d):
    return X.cross(spark, d).select("pair", correlate.shift(F.col("cc")).cast("double").alias("shift"))


@Q(f"WITH {CROSS}, t AS ({_TOP}) SELECT pair, lag * 3600e0 AS shift, round(cc, 4) AS cc_max FROM t WHERE i = 1")
def extract_shift_and_max(spark, d):
    return X.cross(spark, d).select("pair", correlate.shift_and_max(F.col("cc"), DELTA).alias("s")).select("pair", "s.shift", F.round("s.cc_max", 4).alias("cc_max"))


@Q(f"""WITH {CROSS}, t AS ({_TOP}), p AS (SELECT receiver, sqrt(sum(v * v)) AS p FROM g GROUP BY 1)
SELECT pair, lag * 3600e0 AS shift, round(cc / (a.p * b.p), 8) AS cc_max FROM t JOIN p a ON a.receiver = split_part(pair, '-', 1) JOIN p b ON b.receiver = split_part(pair, '-', 2) WHERE i = 1""")
def compute_shift_and_max(spark, d):
    return X.cross(spark, d, True).select("pair", correlate.shift_and_max(F.col("cc"), DELTA).alias("s")).select("pair", "s.shift", F.round("s.cc_max", 8).alias("cc_max"))


def _clipped(spark, d, k: int = 168):
    """Unbiased correlations at |lag| <= k hours, in units of the axis' hours."""
    x = X.cross(spark, d).select("pair", A.clip_lags(F.col("cc"), N, 1.0, -k, k).alias("cc"))
    return x.withColumn("cc", A.unbias(F.col("cc"), N, -k))


_UNBIASED = CROSS + ", u AS (SELECT pair, lag, cc * 720 / (720 - abs(lag)) AS cc FROM cc WHERE abs(lag) <= 168)"


@Q(f"WITH {_UNBIASED} SELECT pair, lag, round(cc, 1) + 0.0 AS cc FROM u")
def unbias(spark, d):
    return correlate.to_long(_clipped(spark, d), ["pair"], "cc", "lag", "cc", -168).withColumn("cc", tidy(F.col("cc"), 1))


def _vectors_long(spark, d, x):
    return correlate.to_long(X.vectors(spark, d).select("vec_id", x.alias("x")), ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(v - avg(v) OVER (PARTITION BY vec_id), 6) + 0.0 AS v FROM v")
def demean(spark, d):
    return _vectors_long(spark, d, A.demean(F.col("x")))


@Q(f"""WITH {VECTORS}, f AS (SELECT vec_id, regr_slope(v, k) AS m, regr_intercept(v, k) AS b FROM v GROUP BY 1)
SELECT vec_id, k, round(v - (m * k + b), 6) + 0.0 AS v FROM v JOIN f USING (vec_id)""")
def detrend_linear(spark, d):
    return _vectors_long(spark, d, A.detrend(F.col("x")))


@Q("""WITH p AS (SELECT CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1)
SELECT round(regr_slope(v, t), 3) + 0.0 AS slope, round(avg(v), 1) AS mean, count(*) AS n FROM p""")
def trend_daily(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("double")
    p = X.table(spark, d, "lineitem").groupBy(day.alias("t")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return p.agg(tidy(F.regr_slope("v", "t"), 3).alias("slope"), F.round(F.avg("v"), 1).alias("mean"), F.count("*").alias("n"))


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS v FROM v")
def norm1d(spark, d):
    return _vectors_long(spark, d, A.norm1d(F.col("x")))


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 7) + 0.0 AS v FROM v")
def norm2d(spark, d):
    c = correlate.to_long(X.vectors(spark, d), ["vec_id", "label"], "x")
    return matrix.norm2d(c, ["label"], "v").select("vec_id", "k", tidy(F.col("v"), 7).alias("v"))


@Q(f"WITH {VECTORS} SELECT vec_id, round(sqrt(avg(v * v)), 6) AS rms FROM v GROUP BY 1")
def rms(spark, d):
    return X.vectors(spark, d).select("vec_id", F.round(A.rms(F.col("x")), 6).alias("rms"))


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(abs(v), 6) + 0.0 AS v FROM v")
def absolute(spark, d):
    return _vectors_long(spark, d, A.absolute(F.col("x")))


_HANN = "CASE WHEN k < {r} THEN 0.5 - 0.5 * cos(pi() * k / {r}) WHEN k >= 64 - {r} THEN 0.5 - 0.5 * cos(pi() * ({r} + k - (64 - {r})) / {r}) ELSE 1.0 END"


@Q(f"SELECT CAST(k AS INTEGER) AS k, round({_HANN.format(r=32)}, 8) + 0.0 AS half, round({_HANN.format(r=6)}, 8) + 0.0 AS tenth, CASE WHEN k < 5 THEN round(0.5 - 0.5 * cos(pi() * k / 5), 8) + 0.0 ELSE 1.0 END AS left_5 FROM range(64) t(k)")
def window_hann(spark, d):
    n = F.lit(64)
    one = spark.range(1).select(F.posexplode(F.arrays_zip(A.window(n).alias("half"), A.window(n, max_percentage=0.1).alias("tenth"), A.window(n, "left", max_length=5.0).alias("left_5"))).alias("k", "w"))
    return one.select("k", *[tidy(F.col(f"w.{c}"), 8).alias(c) for c in ("half", "tenth", "left_5")])


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(v * ({_HANN.format(r=6)}), 6) + 0.0 AS v FROM v")
def taper(spark, d):
    return _vectors_long(spark, d, A.taper(F.col("x"), max_percentage=0.1))


_SNR = _UNBIASED + """,
s AS (SELECT pair, abs(cc) AS s, lag, row_number() OVER (PARTITION BY pair ORDER BY round(abs(cc), 6) DESC, lag) AS i FROM u WHERE abs(lag) <= 12),
n AS (SELECT pair, sqrt(avg(cc * cc)) AS n FROM u WHERE lag >= 72 GROUP BY 1)"""


def _snr(spark, d, **options):
    return pipelines.snr(_clipped(spark, d), ["pair"], first=-168.0, delta=1.0, signal=(-12, 12), noise=(72, 168), **options)


@Q(f"WITH {_SNR} SELECT pair, round(s, 3) AS s, CAST(lag AS DOUBLE) AS lag_s_max, round(n, 3) AS n, round(s / n, 8) AS snr FROM s JOIN n USING (pair) WHERE i = 1")
def snr_pipeline(spark, d):
    return _snr(spark, d).select("pair", F.round("s", 3).alias("s"), "lag_s_max", F.round("n", 3).alias("n"), F.round("snr", 8).alias("snr"))


@Q(f"WITH {_SNR} SELECT pair, round(s * s / n / n, 6) AS snr FROM s JOIN n USING (pair) WHERE i = 1")
def snr_power(spark, d):
    return _snr(spark, d, power=True).select("pair", F.round("snr", 6).alias("snr"))


@Q(f"WITH {_SNR} SELECT pair, round(20 * log10(s / n), 6) AS snr FROM s JOIN n USING (pair) WHERE i = 1")
def snr_db(spark, d):
    return _snr(spark, d, decibels=True).select("pair", F.round("snr", 6).alias("snr"))


@Q()
def snr_envelope(spark, d):
    return _snr(spark, d, envelope=True).select("pair", "lag_s_max", F.round("snr", 6).alias("snr"))


@Q(f"WITH {VECTORS} SELECT vec_id, k, CASE WHEN v > 0 THEN round(20 * log10(v), 5) + 0.0 END AS db FROM v")
def to_db(spark, d):
    return correlate.to_long(X.vectors(spark, d), ["vec_id"], "x").select("vec_id", "k", tidy(A.decibel(F.col("v")), 5).alias("db"))


@Q(f"WITH {VECTORS} SELECT vec_id, CAST(count(*) AS INTEGER) AS n FROM v WHERE NOT (vec_id % 7 = 0) GROUP BY 1")
def nan_reject(spark, d):
    x = F.when(F.col("vec_id") % 7 == 0, F.transform("x", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("x"))
    return X.vectors(spark, d).withColumn("x", x).where(~A.has_nan(F.col("x"))).select("vec_id", F.size("x").alias("n"))


_STATION = """st AS (SELECT n_name AS receiver, n_nationkey * 5.0 - 60 AS lat, n_nationkey * 13.0 - 150 AS lon FROM nation),
sp AS (SELECT a.receiver || '-' || b.receiver AS pair, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
  FROM st a JOIN st b ON a.receiver < b.receiver)"""


def _km(spark, d):
    from lagoon.functions import geo

    return X.station_pairs(spark, d).select("pair", geo.haversine_km(*[F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]).alias("km"))


@Q(f"WITH {_STATION} SELECT pair, round(greatest(0.0, km * 1000 / 1500.0), 3) AS low, round(least(9000.0, km * 1000 / 1460.0), 3) AS high FROM sp")
def celerity_window(spark, d):
    low, high = detect.celerity_window(F.col("km"), 1500.0, 1460.0, 0.0, 9000.0)
    return _km(spark, d).select("pair", F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


# ---- triggers

THR, COUNT = 250.0, 2
_HITS = """hits AS (SELECT h FROM e WHERE v >= {thr} GROUP BY h HAVING count(DISTINCT receiver) >= {count}),
m AS (SELECT h, h - row_number() OVER (ORDER BY h) AS gr FROM hits),
runs AS (SELECT min(h) - {ext} AS a, max(h) + {ext} AS b FROM m GROUP BY gr HAVING max(h) - min(h) + 1 >= {steps}),
mk AS (SELECT *, CASE WHEN a <= max(b) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM runs),
nb AS (SELECT a, b, sum(fresh) OVER (ORDER BY a) - 1 AS period FROM mk),
ps AS (SELECT CAST(period AS INTEGER) AS period, min(a) AS a, max(b) AS b FROM nb GROUP BY 1),
tg AS (SELECT CAST(unnest(range(a, b + 1)) AS INTEGER) AS h, period FROM ps)"""
_TRIGS = GRID + ", " + _HITS.format(thr=THR, count=COUNT, ext=1, steps=2)


def _trigs(spark, d, **options):
    args = {"thr_on": THR, "coincidence": COUNT, "min_steps": 2, "extend": 1} | options
    return detect.coincidence_trigger(X.cells(spark, d), "receiver", "h", "v", **args)


@Q(f"WITH {_TRIGS} SELECT h, period FROM tg")
def coincidence_trigger(spark, d):
    return _trigs(spark, d)


@Q()
def coincidence_hysteresis(spark, d):
    return _trigs(spark, d, thr_off=0.5 * THR)


@Q(f"WITH {_TRIGS} SELECT period, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS \"end\", round((b - a) / 24, 6) AS days FROM ps")
def trigger_periods(spark, d):
    return detect.trigger_periods(_trigs(spark, d), "h").withColumn("days", F.round("days", 6))


@Q(f"WITH {_TRIGS} SELECT period, CAST(unnest(range(CAST(floor(a / 24) AS BIGINT), CAST(floor(b / 24) AS BIGINT) + 1)) AS INTEGER) AS day FROM ps")
def period_days(spark, d):
    return detect.period_days(_trigs(spark, d), "h", 24)


@Q(f"WITH {GRID}, df AS (SELECT receiver, h - lag(h) OVER (PARTITION BY receiver ORDER BY h) AS d FROM e) SELECT receiver, coalesce(max(d) - min(d), 0) = 0 AS regular FROM df GROUP BY 1")
def regular_axis(spark, d):
    return correlate.regular(X.cells(spark, d), "receiver", "h")


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(v / max(abs(v)) OVER (PARTITION BY vec_id), 6) + 0.0 AS v FROM v")
def normalize_max(spark, d):
    return _vectors_long(spark, d, A.normalize_max(F.col("x")))


@Q(f"WITH {_TRIGS} SELECT e.receiver, e.h, e.v, tg.period FROM e JOIN tg ON e.h = tg.h")
def trigger_values(spark, d):
    return detect.trigger_values(X.cells(spark, d), _trigs(spark, d), "h").select("receiver", "h", "v", "period")


@Q(f"WITH {_TRIGS}, cap AS (SELECT max(m) AS cap FROM (SELECT e.h, min(v) AS m FROM e JOIN tg ON e.h = tg.h GROUP BY 1)) SELECT receiver, h, v FROM e, cap WHERE v <= cap")
def snr_peak_cap(spark, d):
    return detect.peak_cap(X.cells(spark, d), _trigs(spark, d), "receiver", "h", "v").select("receiver", "h", "v")


@Q(f"WITH {_TRIGS}, cap AS (SELECT max(m) AS cap FROM (SELECT e.h, min(v) AS m FROM e JOIN tg ON e.h = tg.h GROUP BY 1)) SELECT period, count(*) AS n, round(sum(v), 2) AS v FROM e JOIN tg ON e.h = tg.h, cap WHERE v <= cap GROUP BY 1")
def pipeline_ct(spark, d):
    cells = X.cells(spark, d).withColumnRenamed("v", "snr").drop("n")
    trigs, capped = pipelines.ct(cells, "receiver", "h", thr_on=THR, coincidence=COUNT, min_steps=2, extend=1)
    return capped.join(trigs, "h").groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("snr"), 2).alias("v"))
