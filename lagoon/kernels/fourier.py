"""Correlation and Fourier kernels along the last axis."""

from __future__ import annotations

import math

import numpy as np


def fast_length(n: int) -> int:
    """Smallest 2^a 3^b 5^c at least ``n``."""
    best = 1 << max(0, n - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            two = three
            while two < n:
                two *= 2
            best = min(best, two)
            three *= 3
        five *= 5
    return best


def transformed(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``x`` with zeros to ``size``, and its norm."""
    return np.fft.rfft(x, size), np.linalg.norm(x, axis=-1)


def correlate_spectra(a: tuple, b: tuple, n: int, size: int, normalize: bool = False, clip: tuple[int, int] | None = None) -> np.ndarray:
    """``correlate`` of series of ``n`` samples that ``transformed`` has prepared; lags of ``clip`` only."""
    r = np.fft.irfft(a[0] * np.conj(b[0]), size)
    low, high = (1 - n, n - 1) if clip is None else (max(1 - n, clip[0]), min(n - 1, clip[1]))
    out = np.concatenate([r[..., size + low : size + min(high, -1) + 1], r[..., : max(high + 1, 0)]], axis=-1) if low < 0 else r[..., low : high + 1]
    if normalize:
        scale = a[1] * b[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / np.where(scale > 0, scale, np.nan)[..., None]
    return out


def correlate(x: np.ndarray, y: np.ndarray, normalize: bool = False) -> np.ndarray:
    """R[k] = sum_m x[m + k] y[m] for k = -(n - 1) .. n - 1; zero lag at index n - 1.

    Normalised by the product of norms; a series without energy gives NaN.
    """
    n = x.shape[-1]
    size = fast_length(2 * n - 1)
    return correlate_spectra(transformed(x, size), transformed(y, size), n, size, normalize)


def _direct(x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, float]:
    """Correlation of two series at lag ``k``, and the same of absolute values, each rounded once."""
    n = len(x)
    p = x[max(k, 0) : n + min(k, 0)] * y[max(-k, 0) : n - max(k, 0)]
    p = p[p != 0]
    return math.fsum(p), math.fsum(np.abs(p))


def peak_lag(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lag of the largest correlation of each row; of equal ones the first.

    Equal sums leave a transform with different errors. Lags within these errors of the largest are summed
    directly, and sums that differ by no more than their products' rounding count as equal.
    """
    n, eps = x.shape[-1], np.finfo(float).eps
    r = correlate(x, y)
    scale = np.linalg.norm(x, axis=-1) * np.linalg.norm(y, axis=-1)
    out = np.full(len(r), np.nan)
    for i, row in enumerate(r):
        at = np.flatnonzero(row >= row.max() - 32 * eps * np.log2(2 * n) * scale[i])
        if len(at) > 1 and scale[i] > 0:
            sums, sizes = np.array([_direct(x[i], y[i], k) for k in at - (n - 1)]).T
            at = at[sums >= sums.max() - 2 * eps * sizes.max()]
        if len(at):
            out[i] = at[0] - (n - 1)
    return out


def circular(x: np.ndarray, y: np.ndarray, normalize: bool = False) -> np.ndarray:
    """``correlate`` without padding: R[k] = sum_m x[(m + k) mod n] y[m], zero lag at index n // 2."""
    r = np.fft.fftshift(np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), x.shape[-1]), axes=-1)
    if normalize:
        scale = np.linalg.norm(x, axis=-1) * np.linalg.norm(y, axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = r / np.where(scale > 0, scale, np.nan)[..., None]
    return r


def correlate2d(x: np.ndarray, y: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Full 2-D correlation, (2a - 1) x (2b - 1), by the Frobenius norms."""
    a, b = x.shape[-2:]
    shape = (fast_length(2 * a - 1), fast_length(2 * b - 1))
    r = np.fft.irfft2(np.fft.rfft2(x, shape) * np.conj(np.fft.rfft2(y, shape)), shape)
    r = np.roll(r, (a - 1, b - 1), axis=(-2, -1))[..., : 2 * a - 1, : 2 * b - 1]
    if normalize:
        scale = np.sqrt((x**2).sum((-2, -1)) * (y**2).sum((-2, -1)))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = r / np.where(scale > 0, scale, np.nan)[..., None, None]
    return r


def spectrum(x: np.ndarray) -> np.ndarray:
    """Complex spectrum with frequencies rising from negative to positive."""
    return np.fft.fftshift(np.fft.fft(x), axes=-1)


def from_spectrum(s: np.ndarray) -> np.ndarray:
    """Inverse of ``spectrum`` for even and odd lengths."""
    return np.fft.ifft(np.fft.ifftshift(s, axes=-1))


def timeshift(x: np.ndarray, delay: np.ndarray, delta: float) -> np.ndarray:
    """Circular delay in seconds by the phases of the spectrum; positive moves samples later."""
    n = x.shape[-1]
    f = np.fft.rfftfreq(n, delta)
    phase = np.exp(-2j * np.pi * np.asarray(delay)[..., None] * f)
    if n % 2 == 0:
        phase[..., -1] = phase[..., -1].real  # keeps the Nyquist term of an even length real
    return np.fft.irfft(np.fft.rfft(x) * phase, n)


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal: positive frequencies doubled, negative ones zero."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to ``n`` samples of the same span, along the last axis."""
    m = x.shape[-1]
    s = np.fft.rfft(x)
    k = min(m, n) // 2 + 1
    out = np.zeros((*x.shape[:-1], n // 2 + 1), complex)
    out[..., :k] = s[..., :k]
    if min(m, n) % 2 == 0 and m != n:
        out[..., k - 1] *= 2 if n < m else 0.5
        if n < m:
            out[..., k - 1] = out[..., k - 1].real
    return np.fft.irfft(out, n) * n / m


def places(n: int, ratio: float) -> np.ndarray:
    """Where the samples of a series of ``n`` lie that is ``ratio`` times as dense, in old samples."""
    return np.minimum(np.arange(int(np.floor((n - 1) * ratio + 1e-9)) + 1) / ratio, n - 1)


def straight(x: np.ndarray, ratio: float) -> np.ndarray:
    """Straight lines between samples, along the last axis."""
    at = places(x.shape[-1], ratio)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, x.shape[-1] - 1)
    return x[..., low] + (x[..., high] - x[..., low]) * (at - low)


def lanczos(x: np.ndarray, ratio: float, a: int = 20) -> np.ndarray:
    """Sum of x_i sinc(t - i) sinc((t - i) / a) over the 2a samples around t, along the last axis.

    Beyond the ends there are no samples. One of the 2a terms is held at a time, for long series.
    """
    n = x.shape[-1]
    at = places(n, ratio)
    # places that rounding moved off a sample are put back on it
    at = np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at)
    low = np.floor(at).astype(int)
    out = np.zeros((*x.shape[:-1], len(at)))
    for j in range(1 - a, a + 1):
        i = low + j
        t = at - i
        weight = np.where((i >= 0) & (i < n), np.sinc(t) * np.sinc(t / a), 0.0)
        out += weight * x[..., np.clip(i, 0, n - 1)]
    return out
