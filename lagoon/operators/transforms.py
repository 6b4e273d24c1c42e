"""Fourier-type transforms, filters and time-frequency operators on series columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.core import let
from lagoon.kernels import filters, fourier, spectral
from lagoon.operators.kernels import binary, table_kernel, unary, unary_with

def _complex(fn, *cols: Column) -> Column:
    """A kernel with a complex result, as a struct of its parts: both packed in one array."""
    op = unary if len(cols) == 1 else binary
    packed = op(lambda *a: np.concatenate([(z := fn(*a)).real, z.imag], axis=-1), *cols)
    half = lambda p: (F.size(p) / 2).cast("int")
    return let(packed, lambda p: F.struct(F.slice(p, F.lit(1), half(p)).alias("re"), F.slice(p, half(p) + 1, half(p)).alias("im")))


def fft(x: Column) -> Column:
    """Complex spectrum, frequencies rising from negative to positive."""
    return _complex(fourier.spectrum, x)


def ifft(re: Column, im: Column) -> Column:
    return _complex(lambda a, b: fourier.from_spectrum(a + 1j * b), re, im)


def rfft(x: Column) -> Column:
    return _complex(np.fft.rfft, x)


def irfft(re: Column, im: Column, n: int) -> Column:
    """Inverse of ``rfft`` of ``n`` samples, even or odd."""
    return binary(lambda a, b: np.fft.irfft(a + 1j * b, n), re, im)


def frequencies(n: Column, delta: float) -> Column:
    """Frequencies of ``fft`` of n samples."""
    half = F.floor(n / 2)
    return F.transform(F.sequence(-half, n - half - 1), lambda k: k / (n * F.lit(delta)))


def timeshift(x: Column, delay: Column, delta: float) -> Column:
    """Circular delay in seconds."""
    return unary_with(lambda a, d: fourier.timeshift(a, d, delta), x, delay)


def hilbert(x: Column) -> Column:
    return _complex(fourier.analytic, x)


def envelope(x: Column) -> Column:
    return unary(fourier.envelope, x)


def filter(x: Column, frequency: float | tuple[float, float], btype: str, delta: float, order: int = 2) -> Column:  # noqa: A001
    """Zero-phase Butterworth filter; the sections are designed once, on the driver."""
    sos = filters.butterworth(order, frequency, btype, 1 / delta)
    return unary(lambda a: filters.zero_phase(sos, a), x)


def causal_filter(x: Column, frequency: float | tuple[float, float], btype: str, delta: float, order: int = 4) -> Column:
    sos = filters.butterworth(order, frequency, btype, 1 / delta)
    return unary(lambda a: filters.run(sos, a), x)


def resample(x: Column, n: int) -> Column:
    """Fourier resampling to ``n`` samples of the same span."""
    return unary(lambda a: fourier.resample(a, n), x)


def interpolate_linear(x: Column, factor: int) -> Column:
    """``factor`` times as many samples by straight lines, native."""
    n = F.size(x)
    steps = F.sequence(F.lit(0), (n - 1) * factor)
    at = lambda i: F.get(x, F.floor(i / factor).cast("int"))
    nxt = lambda i: F.coalesce(F.get(x, (F.floor(i / factor) + 1).cast("int")), at(i))
    return F.transform(steps, lambda i: at(i) + (nxt(i) - at(i)) * ((i % factor) / F.lit(float(factor))))


def interpolate(x: Column, ratio: float, method: str = "lanczos", a: int = 20) -> Column:
    """Samples ``ratio`` times as dense, from the first one to the last that the series reaches.

    Any positive ratio; below one there is no low-pass, so content above the new Nyquist has to be
    filtered before.
    """
    if ratio <= 0 or a < 1:
        raise ValueError("ratio and a must be positive")
    kernels = {"lanczos": lambda v: fourier.lanczos(v, ratio, a), "linear": lambda v: fourier.straight(v, ratio)}
    if method not in kernels:
        raise ValueError(f"no such interpolation: {method}")
    return unary(kernels[method], x)


def spectrogram(series: DataFrame, keys: list[str], x: str, delta: float, duration: float, *, padding: int = 2, overlap: float | None = None, scaling: str = "density", freq_lim: tuple[float, float] | None = None) -> DataFrame:
    """Rows (keys, freq, psd): one per series and frequency; ``overlap`` None moves by one sample."""
    size = max(16, int(np.floor(duration / delta + 1e-9)))
    hop = 1 if overlap is None else max(1, int(round(size * (1 - overlap))))

    def one(row):
        v = np.asarray(row[x], dtype=float)
        freq, psd = spectral.spectrogram(v, delta, duration, padding, hop, scaling)
        for f, p in zip(freq, psd, strict=True):
            if freq_lim is None or freq_lim[0] <= f <= freq_lim[1]:
                yield {**{k: row[k] for k in keys}, "freq": float(f), "psd": p}

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, x).where(F.col(x).isNotNull()).mapInPandas(table_kernel(one), f"{kinds}, freq double, psd array<double>")


def cwt(series: DataFrame, keys: list[str], x: str, delta: float, *, scale=None, bandwidth: float = 1.5, centre: float = 1.0, magnitude: bool = False, freq_lim: tuple[float, float] | None = None, wavelet: str = "cmor", method: str = "fft") -> DataFrame:
    """Rows (keys, freq, re, im), or (keys, freq, mag): wavelet coefficients, of a complex Morlet wavelet by
    default (``wavelet`` cmor, shan or mexh; ``method`` fft or conv)."""
    s = np.asarray(scale if scale is not None else spectral.scales(delta, bandwidth, centre), dtype=float)

    def one(row):
        freq, z = spectral.cwt(np.asarray(row[x], dtype=float), delta, s, bandwidth, centre, wavelet, method)
        for f, c in zip(freq, z, strict=True):
            if freq_lim is None or freq_lim[0] <= f <= freq_lim[1]:
                value = {"mag": np.abs(c)} if magnitude else {"re": c.real, "im": c.imag}
                yield {**{k: row[k] for k in keys}, "freq": float(f), **value}

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    tail = "mag array<double>" if magnitude else "re array<double>, im array<double>"
    return series.select(*keys, x).where(F.col(x).isNotNull()).mapInPandas(table_kernel(one), f"{kinds}, freq double, {tail}")


def scaleogram(series: DataFrame, keys: list[str], x: str, delta: float, **options) -> DataFrame:
    return cwt(series, keys, x, delta, magnitude=True, **options)


def lombscargle(long: DataFrame, keys: list[str], t: str, v: str, freqs: list[float], *, nmin: int = 3, normalize: bool = False, rescale: bool = False, precenter: bool = True, angular: bool = False, invert: bool = False, more: bool = False) -> DataFrame:
    """Periodogram of unevenly sampled rows (keys, t, v) at ordinary frequencies, native.

    ``angular``: frequencies are in radians; ``invert``: they are periods. ``more`` adds ``share`` (of the
    sum of squares, as ``normalize``) and ``amplitude`` (as ``rescale``) beside the plain power.

    Two passes of conditional sums: the phase offset tau of each frequency, then the projections.
    Frequencies are exploded on the rows, so sums are partial before the shuffle. Fewer than ``nmin``
    valid samples give NULL.
    """
    rows = long.where(F.col(v).isNotNull() & ~F.isnan(v)).select(*keys, F.col(t).alias("_t"), F.col(v).alias("_v"))
    if precenter:
        centre = rows.groupBy(*keys).agg(F.avg("_v").alias("_m"))
        rows = rows.join(centre, keys).select(*keys, "_t", (F.col("_v") - F.col("_m")).alias("_v"))
    each = rows.select(*keys, "_t", "_v", F.explode(F.array(*[F.lit(float(f)) for f in freqs])).alias("freq"))
    f = 1 / F.col("freq") if invert else F.col("freq")
    w = f if angular else F.lit(2 * np.pi) * f
    sums = each.groupBy(*keys, "freq").agg(
        *[F.sum(e).alias(n) for n, e in {
            "c": F.cos(w * F.col("_t")) * F.col("_v"), "s": F.sin(w * F.col("_t")) * F.col("_v"),
            "cc": F.cos(w * F.col("_t")) ** 2, "ss": F.sin(w * F.col("_t")) ** 2,
            "cs": F.cos(w * F.col("_t")) * F.sin(w * F.col("_t")), "vv": F.col("_v") ** 2,
        }.items()], F.count("*").alias("n"),
    )
    tau = 0.5 * F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss"))  # w * tau
    ct, st = F.cos(tau), F.sin(tau)
    yc = F.col("c") * ct + F.col("s") * st
    ys = F.col("s") * ct - F.col("c") * st
    cc = F.col("cc") * ct**2 + 2 * F.col("cs") * ct * st + F.col("ss") * st**2
    ss = F.col("ss") * ct**2 - 2 * F.col("cs") * ct * st + F.col("cc") * st**2
    p = 0.5 * (F.when(cc > 1e-12, yc**2 / cc).otherwise(0.0) + F.when(ss > 1e-12, ys**2 / ss).otherwise(0.0))
    enough = lambda c: F.when(F.col("n") >= nmin, c)
    if more:
        power = sums.select(*keys, "freq", "n", "vv", p.alias("_p"))
        return power.select(
            *keys, "freq", enough(F.col("_p")).alias("power"), enough(F.col("_p") * 2 / F.nullif(F.col("vv"), F.lit(0.0))).alias("share"),
            enough(F.sqrt(4 * F.col("_p") / F.col("n"))).alias("amplitude"),
        )
    if normalize:
        p = p * 2 / F.nullif(F.col("vv"), F.lit(0.0))
    if rescale:
        p = F.sqrt(4 * p / F.col("n"))
    return sums.select(*keys, "freq", enough(p).alias("power"))
