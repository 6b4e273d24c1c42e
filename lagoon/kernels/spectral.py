"""Spectrogram, wavelet, Lomb-Scargle and peak kernels for one series or a stack."""

from __future__ import annotations

import numpy as np


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """Tapered cosine window, periodic."""
    i = np.arange(n)
    edge = alpha * n / 2
    w = np.ones(n)
    if edge > 0:
        rise = i < edge
        w[rise] = 0.5 * (1 - np.cos(np.pi * i[rise] / edge))
        fall = i > n - edge
        w[fall] = 0.5 * (1 - np.cos(np.pi * (n - i[fall]) / edge))
    return w


def spectrogram(x: np.ndarray, delta: float, duration: float, padding: int = 2, hop: int = 1, scaling: str = "density", alpha: float = 0.25):
    """(frequencies, PSD of shape frequencies x samples) of one series.

    Segments of floor(duration / delta) samples (16 at least), their mean removed, Tukey window, one
    sided; columns stand at the segments' centres and are zero where no segment is centred.
    """
    n = len(x)
    size = max(16, int(np.floor(duration / delta + 1e-9)))
    nfft = size * padding
    freq = np.fft.rfftfreq(nfft, delta)
    out = np.zeros((len(freq), n))
    if size > n:
        return freq, out
    w = tukey(size, alpha)
    seg = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    power = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * w, nfft)) ** 2
    power *= delta / (w**2).sum() if scaling == "density" else 1 / w.sum() ** 2
    power[:, 1 : (len(freq) - 1) if nfft % 2 == 0 else None] *= 2
    edge = int(np.rint(size / 2))
    at = edge + hop * np.arange(len(seg))
    keep = at < n
    out[:, at[keep]] = power[keep].T
    return freq, out


def scales(delta: float, bandwidth: float, centre: float, count: int = 200) -> np.ndarray:
    """Logarithmic scales from the Nyquist frequency down to the slowest useful one."""
    rate = 1 / delta
    return np.logspace(np.log10(2 * centre), np.log10(max(2 * centre * 1.01, centre * rate**2 / 2 if rate > 2 else 2 * centre * count / 4)), count)


#: wavelet -> (transform at frequency f of scale one, value at t of scale one) for bandwidth B and centre C
WAVELETS = {
    "cmor": (
        lambda f, B, C: np.exp(-((np.pi * (f - C)) ** 2) * B),
        lambda t, B, C: np.exp(2j * np.pi * C * t - t**2 / B) / np.sqrt(np.pi * B),
    ),
    "shan": (
        lambda f, B, C: (np.abs(f - C) < B / 2) / np.sqrt(B) + 0.5 * (np.abs(f - C) == B / 2) / np.sqrt(B),
        lambda t, B, C: np.sqrt(B) * np.sinc(B * t) * np.exp(2j * np.pi * C * t),
    ),
    "mexh": (
        lambda f, B, C: 2 / (np.sqrt(3) * np.pi**0.25) * np.sqrt(2 * np.pi) * (2 * np.pi * f) ** 2 * np.exp(-((2 * np.pi * f) ** 2) / 2),
        lambda t, B, C: 2 / (np.sqrt(3) * np.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2),
    ),
}


def cwt(x: np.ndarray, delta: float, scale: np.ndarray, bandwidth: float = 1.5, centre: float = 1.0, wavelet: str = "cmor", method: str = "fft"):
    """(frequencies, complex coefficients scales x samples), by default with a complex Morlet wavelet.

    cmor: psi(t) = exp(2 pi i C t) exp(-t^2 / B) / sqrt(pi B); shan: sqrt(B) sinc(B t) exp(2 pi i C t);
    mexh: the second derivative of a Gaussian, its centre at 0.25. ``fft``: products of spectra with zero
    padding; ``conv``: sums with the sampled wavelet, which differ where a scale is but a few samples.
    """
    n = len(x)
    spectrum, value = WAVELETS[wavelet]
    centre_ = 0.25 if wavelet == "mexh" else centre
    if method == "conv":
        out = np.empty((len(scale), n), complex)
        t = np.arange(1 - n, n)
        for k, s in enumerate(scale):
            psi = value(t / s, bandwidth, centre) / np.sqrt(s)
            size = 1 << int(np.ceil(np.log2(max(2, 3 * n))))
            out[k] = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(psi, size))[n - 1 : 2 * n - 1]
        return centre_ / (scale * delta), out
    if method != "fft":
        raise ValueError(f"no such method: {method}")
    size = 1 << int(np.ceil(np.log2(max(2, 2 * n))))
    spec = np.fft.fft(x, size)
    f = np.fft.fftfreq(size)
    # Fourier transform of psi(t / s) / sqrt(s) for sample spacing one
    bank = np.sqrt(scale)[:, None] * spectrum(scale[:, None] * f, bandwidth, centre)
    return centre_ / (scale * delta), np.fft.ifft(spec * bank, axis=-1)[:, :n]


def local_peaks(z: np.ndarray, distance: int = 1, relative: float = 0.0) -> list[tuple[int, int]]:
    """Cells that are the largest within ``distance`` and above ``relative`` of the largest, by value
    descending; of equal cells within the distance the first stands."""
    if not z.size or not np.isfinite(z).any():
        return []
    top = np.nanmax(z)
    cand = [(r, c) for r, c in zip(*np.nonzero(z >= relative * top), strict=True) if z[r, c] > 0]
    order = sorted(cand, key=lambda p: (-z[p], p))
    taken = np.zeros(z.shape, bool)
    out = []
    for r, c in order:
        box = np.s_[max(0, r - distance) : r + distance + 1, max(0, c - distance) : c + distance + 1]
        if z[r, c] >= np.nanmax(z[box]) and not taken[box].any():
            taken[r, c] = True
            out.append((int(r), int(c)))
    return out
