"""Series functions on ``array<double>`` columns, native and inside one projection.

NULL elements are missing samples: reductions skip them, element-wise functions keep them. A series
without energy normalises to NULLs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagoon.functions.core import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v * v, F.lit(0.0)))


def valid(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v.isNotNull()))


def mean(x: Column) -> Column:
    return let(x, lambda a: total(a) / F.nullif(valid(a), F.lit(0)))


def rms(x: Column) -> Column:
    return let(x, lambda a: F.sqrt(energy(a) / F.nullif(valid(a), F.lit(0))))


def absolute(x: Column) -> Column:
    return F.transform(x, F.abs)


def magnitude(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b))


def demean(x: Column) -> Column:
    return let(x, lambda a: let(mean(a), lambda m: F.transform(a, lambda v: v - m)))


def detrend(x: Column) -> Column:
    """Least-squares line over the sample number removed; missing samples do not count in the fit."""

    def fit(a: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "t", "v", "tt", "tv")])
        sums = F.aggregate(
            F.transform(a, lambda v, i: F.struct(i.cast("double").alias("t"), v.alias("v"))), zero,
            lambda s, p: F.when(p["v"].isNull(), s).otherwise(F.struct(
                (s["n"] + 1).alias("n"), (s["t"] + p["t"]).alias("t"), (s["v"] + p["v"]).alias("v"),
                (s["tt"] + p["t"] * p["t"]).alias("tt"), (s["tv"] + p["t"] * p["v"]).alias("tv"),
            )),
        )

        def line(s: Column) -> Column:
            spread = s["n"] * s["tt"] - s["t"] * s["t"]
            slope = F.when(spread > 0, (s["n"] * s["tv"] - s["t"] * s["v"]) / spread).otherwise(F.lit(0.0))
            return F.struct(slope.alias("m"), ((s["v"] - slope * s["t"]) / F.nullif(s["n"], F.lit(0.0))).alias("b"))

        return let(sums, lambda s: let(line(s), lambda p: F.transform(a, lambda v, i: v - (p["m"] * i + p["b"]))))

    return let(x, fit)


def norm1d(x: Column) -> Column:
    return let(x, lambda a: let(F.sqrt(energy(a)), lambda n: F.transform(a, lambda v: F.when(n > 0, v / n))))


def normalize_max(x: Column) -> Column:
    """Over the largest absolute value; NULLs where that is zero."""
    return let(x, lambda a: let(F.array_max(F.transform(a, F.abs)), lambda m: F.transform(a, lambda v: F.when(m > 0, v / m))))


def weight(lag: Column, n: int | Column, clip: float | None = None) -> Column:
    """Bias correction n / (n - |lag|) at integer ``lag``, at most ``clip``."""
    n = F.lit(n) if isinstance(n, int) else n
    w = n / (n - F.abs(lag)).cast("double")
    return w if clip is None else F.least(w, F.lit(float(clip)))


def unbias(x: Column, n: int | Column, first_lag: int | Column, clip: float | None = None) -> Column:
    """A (clipped) correlation times its weights; element 0 is lag ``first_lag``, in samples."""
    first = F.lit(first_lag) if isinstance(first_lag, int) else first_lag
    return F.transform(x, lambda v, i: v * weight(i + first, n, clip))


def ramp_length(n: Column, *, max_percentage: float | None = None, max_length: float | None = None, delta: float = 1.0) -> Column:
    """Samples of a taper's ramp: half the series by default; a length in seconds wins over a share."""
    if max_length is not None:
        size = F.round(F.lit(max_length / delta))
    else:
        size = F.round(n * F.lit(0.5 if max_percentage is None else max_percentage))
    return F.least(size.cast("int"), F.floor(n / 2).cast("int"))


#: value of a window's rise of ``r`` samples at the share ``t`` of it, from 0 (begin) to 1 (top)
RAMPS = {
    "hann": lambda t, r: F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(math.pi) * t),
    "hamming": lambda t, r: F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(math.pi) * t),
    "blackman": lambda t, r: F.lit(0.42) - F.lit(0.5) * F.cos(F.lit(math.pi) * t) + F.lit(0.08) * F.cos(F.lit(2 * math.pi) * t),
    "cosine": lambda t, r: F.sin(F.lit(math.pi) * (t * r + 0.5) / (2 * r + 1)),
    "bartlett": lambda t, r: t,
    "boxcar": lambda t, r: t * 0.0 + 1.0,
}


def window_value(i: Column, n: Column, ramp: Column, side: str = "both", kind: str = "hann") -> Column:
    """Window at sample ``i`` of ``n``: rising over the first ``ramp``, falling over the last."""
    if side not in ("left", "right", "both"):
        raise ValueError("side: left, right or both")
    if kind not in RAMPS:
        raise ValueError(f"no such window: {kind}")
    w = F.lit(1.0)
    if side in ("right", "both"):
        w = F.when((ramp > 0) & (i >= n - ramp), RAMPS[kind]((n - i) / ramp, ramp)).otherwise(w)
    if side in ("left", "both"):
        w = F.when((ramp > 0) & (i < ramp), RAMPS[kind](i / ramp, ramp)).otherwise(w)
    return w


def window(n: Column, side: str = "both", kind: str = "hann", **length) -> Column:
    return let(F.struct(n.alias("n"), ramp_length(n, **length).alias("r")), lambda s: F.transform(
        F.sequence(F.lit(0), s["n"] - 1), lambda i: window_value(i, s["n"], s["r"], side, kind)
    ))


def taper(x: Column, side: str = "both", kind: str = "hann", **length) -> Column:
    return let(x, lambda a: let(
        F.struct(F.size(a).alias("n"), ramp_length(F.size(a), **length).alias("r")),
        lambda s: F.transform(a, lambda v, i: v * window_value(i, s["n"], s["r"], side, kind)),
    ))


def lag_index(lag: float | Column, npts: int, delta: float) -> Column:
    """Index of a lag in the full axis of 2 * npts - 1 lags."""
    lag = F.lit(float(lag)) if isinstance(lag, int | float) else lag
    return F.round((lag + (npts - 1) * delta) / delta).cast("int")


def clip_lags(full: Column, npts: int, delta: float, low: float, high: float) -> Column:
    """Lags low .. high, both included, of a full correlation."""
    a = max(0, round(low / delta) + npts - 1)
    b = min(2 * npts - 2, round(high / delta) + npts - 1)
    return F.slice(full, a + 1, max(0, b - a + 1))


def between(x: Column, first: float | Column, delta: float | Column, low: Column, high: Column) -> Column:
    """Elements whose coordinate first + i * delta lies in low .. high, as (coordinate, value)."""
    first = F.lit(float(first)) if isinstance(first, int | float) else first
    delta = F.lit(float(delta)) if isinstance(delta, int | float) else delta
    pairs = F.transform(x, lambda v, i: F.struct((first + i * delta).alias("c"), v.alias("v")))
    return F.filter(pairs, lambda p: (p["c"] >= low) & (p["c"] <= high))


def peak(pairs: Column) -> Column:
    """(c, v) of the largest |v| of (coordinate, value) pairs; of equal ones the first."""
    return F.aggregate(
        pairs, F.lit(None).cast("struct<c:double,v:double>"),
        lambda a, p: F.when(p["v"].isNotNull() & (a.isNull() | (F.abs(p["v"]) > a["v"])), F.struct(p["c"].cast("double").alias("c"), F.abs(p["v"]).alias("v"))).otherwise(a),
    )


def values(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["v"])


def argmax(x: Column, digits: int | None = None) -> Column:
    """Index of the largest element, the first of equal ones.

    With ``digits`` elements are equal that agree to so many decimals, or to 13 significant digits of the
    largest, as equal values do that come out of transforms.
    """
    if digits is None:
        return let(x, lambda a: F.array_position(a, F.array_max(a)) - 1)

    def first(a: Column) -> Column:
        top = F.array_max(a)
        return let(top - F.abs(top) * 1e-13, lambda low: F.array_position(F.transform(a, lambda v: v >= low), F.lit(True)) - 1)

    return let(F.transform(x, lambda v: F.round(v, digits)), first)


def has_nan(x: Column) -> Column:
    return F.exists(x, lambda v: F.isnan(v) | v.isNull())


def decibel(x: Column) -> Column:
    """20 log10 of a positive amplitude ratio, else NULL."""
    return F.when(x > 0, 20 * F.log10(x))


def decimate(x: Column, factor: int) -> Column:
    return F.filter(x, lambda v, i: i % factor == 0)
