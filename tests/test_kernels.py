import numpy as np
import pytest

from lagoon.kernels import filters, fourier, geodesic, spectral

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 31, 64])
def test_correlation_equals_direct_sum(n):
    x, y = RNG.normal(size=(2, 3, n))
    for a, b, r in zip(x, y, fourier.correlate(x, y), strict=True):
        assert np.allclose(r, np.correlate(a, b, "full"))
    same = fourier.correlate(x, x, True)
    assert np.allclose(same[:, n - 1], 1) and (np.argmax(same, 1) == n - 1).all()
    assert np.isnan(fourier.correlate(x, 0 * x, True)).all()


def test_positive_lag_means_first_is_delayed():
    x = np.zeros((1, 40))
    x[0, 10] = 1
    assert np.argmax(fourier.correlate(np.roll(x, 4), x)[0]) - 39 == 4


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (5, 4), (8, 8)])
def test_correlation_2d(shape):
    x, y = RNG.normal(size=(2, 1, *shape))
    r = fourier.correlate2d(x, y, False)[0]
    a, b = shape
    for dr in range(1 - a, a):
        for dc in range(1 - b, b):
            want = sum(x[0, i, j] * y[0, i - dr, j - dc] for i in range(a) for j in range(b) if 0 <= i - dr < a and 0 <= j - dc < b)
            assert abs(r[dr + a - 1, dc + b - 1] - want) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 5, 8, 31, 64])
def test_fourier_identities(n):
    x = RNG.normal(size=(2, n))
    s = fourier.spectrum(x)
    assert np.allclose(fourier.from_spectrum(s).real, x)
    assert np.allclose((np.abs(s) ** 2).sum(1) / n, (x**2).sum(1))
    for k in (0, 1, 3):
        assert np.allclose(fourier.timeshift(x, np.array([k, k]) * 0.5, 0.5), np.roll(x, k, axis=1))
    assert np.allclose(fourier.analytic(x).real, x)


def test_hilbert_of_cosine_is_sine():
    t = np.arange(200) / 200
    z = fourier.analytic(np.cos(2 * np.pi * 5 * t)[None])[0]
    assert np.allclose(z.imag, np.sin(2 * np.pi * 5 * t)) and np.allclose(fourier.envelope(np.cos(2 * np.pi * 5 * t)[None]), 1)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("kind,corner", [("lowpass", 5.0), ("highpass", 5.0), ("bandpass", (3.0, 9.0))])
def test_butterworth_gains(order, kind, corner):
    sos = filters.butterworth(order, corner, kind, 50.0)

    def power(f):
        w = np.exp(-2j * np.pi * f / 50 * np.arange(3))
        return abs(np.prod((sos[:, :3] @ w) / (sos[:, 3:] @ w))) ** 2

    for f in np.atleast_1d(corner):
        assert abs(power(f) - 0.5) < 1e-6
    if kind != "bandpass":
        for f in (1.0, 4.0, 12.0, 20.0):
            ratio = np.tan(np.pi * f / 50) / np.tan(np.pi * corner / 50)
            ratio = ratio if kind == "lowpass" else 1 / ratio
            assert abs(power(f) - 1 / (1 + ratio ** (2 * order))) < 1e-9
    for s in sos:
        assert np.abs(np.roots(s[3:])).max() < 1


def test_zero_phase_keeps_phase_and_constants():
    t = np.arange(1000) / 50
    sos = filters.butterworth(4, 3.0, "lowpass", 50.0)
    x = np.sin(2 * np.pi * t) + np.sin(2 * np.pi * 12 * t)
    assert np.abs(filters.zero_phase(sos, x[None])[0] - np.sin(2 * np.pi * t))[60:-60].max() < 1e-3
    assert np.allclose(filters.zero_phase(sos, np.full((1, 90), 7.0)), 7)
    assert np.allclose(filters.zero_phase(filters.butterworth(2, 3.0, "highpass", 50.0), np.full((1, 90), 7.0)), 0)
    assert filters.zero_phase(sos, np.ones((2, 1))).shape == (2, 1)
    with pytest.raises(ValueError):
        filters.butterworth(2, 30.0, "lowpass", 50.0)


def test_spectrogram_finds_a_tone_and_its_power():
    delta, n = 0.02, 2000
    x = 3 * np.sin(2 * np.pi * 5 * np.arange(n) * delta)
    f, p = spectral.spectrogram(x, delta, 2.0, padding=2)
    mid = p[:, n // 2]
    assert abs(f[np.argmax(mid)] - 5) < 0.3 and abs(mid.sum() * (f[1] - f[0]) - 4.5) < 0.3
    assert (p[:, :49] == 0).all() and spectral.spectrogram(x[:10], delta, 2.0)[1].sum() == 0
    _, sparse = spectral.spectrogram(x, delta, 2.0, hop=10)
    at = 50 + 10 * np.arange(190)
    assert np.allclose(sparse[:, at], p[:, at])


def test_wavelet_follows_frequency():
    x = np.sin(2 * np.pi * 0.1 * np.arange(512))
    f, z = spectral.cwt(x, 1.0, np.array([5.0, 10.0, 20.0]))
    assert np.allclose(f, [0.2, 0.1, 0.05]) and np.argmax(np.abs(z[:, 256])) == 1


def test_local_peaks():
    z = np.zeros((9, 9))
    z[2, 2], z[2, 3], z[7, 7], z[7, 1] = 5, 5, 3, 0.01
    assert spectral.local_peaks(z) == [(2, 2), (7, 7), (7, 1)]
    assert spectral.local_peaks(z, 1, 0.1) == [(2, 2), (7, 7)]
    assert spectral.local_peaks(z, 9) == [(2, 2)] and spectral.local_peaks(np.zeros((0, 0))) == []


def test_geodesic():
    d = geodesic.distance([50.06632, 0.0, 10.0], [-5.71475, 0.0, 20.0], [58.64402, 0.0, 10.0], [-3.07009, 1.0, 20.0])
    assert abs(d[0] - 969954.166) < 0.01 and abs(d[1] - 111319.491) < 0.01 and d[2] == 0
    assert np.isnan(geodesic.distance([0.0], [0.0], [0.1], [179.99]))[0]
