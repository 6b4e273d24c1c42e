"""Butterworth filters in second-order sections, forward or zero-phase."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, frequency: float | tuple[float, float], kind: str, rate: float) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of a low-, high- or bandpass of ``order``.

    Analog prototype poles, moved to the pre-warped edge frequencies and mapped by the bilinear
    transform; the gain is one at zero frequency, the Nyquist or the band's centre.
    """
    edges = np.atleast_1d(np.asarray(frequency, dtype=float))
    if (edges <= 0).any() or (edges >= rate / 2).any():
        raise ValueError("frequencies must lie between zero and the Nyquist frequency")
    warped = 2 * rate * np.tan(np.pi * edges / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, at = poles * warped[0], 0, 0.0
    elif kind == "highpass":
        poles, zeros, at = warped[0] / poles, order, rate / 2
    elif kind == "bandpass":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), order
        at = rate / np.pi * np.arctan(centre / (2 * rate))
    else:
        raise ValueError(f"no such filter: {kind}")
    z = (2 * rate + poles) / (2 * rate - poles)
    roots = np.concatenate([np.ones(zeros), -np.ones(len(z) - zeros)])
    # conjugate pairs make sections; zeros at 1 and -1 are dealt out in turn
    upper = sorted(z[z.imag > 1e-12], key=lambda p: abs(p))
    real = sorted(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(p, np.conj(p)) for p in upper]
    while real:
        pairs.append((real.pop(), real.pop() if real else 0.0))
    front, back = list(np.sort(roots)), []
    sections = []
    for p, q in pairs:
        lone = q == 0.0 and len(front) == 1
        take = [front.pop(0)] + ([] if lone or not front else [front.pop(-1)])
        b = np.poly(take)
        b = np.concatenate([b, np.zeros(3 - len(b))])
        a = np.real(np.poly([p, q])) if not lone else np.array([1.0, -np.real(p), 0.0])
        sections.append(np.concatenate([np.real(b), a]))
    sos = np.array(sections)
    w = np.exp(-2j * np.pi * at / rate * np.arange(3))
    gain = np.abs(np.prod((sos[:, :3] @ w) / (sos[:, 3:] @ w)))
    sos[0, :3] /= gain
    return sos


def _steady(section: np.ndarray) -> tuple[float, float]:
    """State of a section (transposed form) that a constant input of one leaves unchanged."""
    b, a = section[:3], section[3:]
    y = b.sum() / a.sum()
    s2 = b[2] - a[2] * y
    return b[1] - a[1] * y + s2, s2


def run(sos: np.ndarray, x: np.ndarray, steady: bool = False) -> np.ndarray:
    """Causal filter along the last axis; ``steady``: from the state of a constant first value."""
    out = np.array(x, dtype=float)
    for section in sos:
        b0, b1, b2, _, a1, a2 = section
        s1 = np.zeros(out.shape[:-1])
        s2 = np.zeros(out.shape[:-1])
        if steady:
            k1, k2 = _steady(section)
            s1, s2 = k1 * out[..., 0], k2 * out[..., 0]
        for i in range(out.shape[-1]):
            v = out[..., i].copy()
            y = b0 * v + s1
            s1 = b1 * v - a1 * y + s2
            s2 = b2 * v - a2 * y
            out[..., i] = y
    return out


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward; ends extended by point reflection, from steady states."""
    n = x.shape[-1]
    pad = min(3 * (2 * len(sos) + 1), n - 1)
    if pad < 1:
        return np.array(x, dtype=float)
    head = 2 * x[..., :1] - x[..., pad:0:-1]
    tail = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    ext = np.concatenate([head, x, tail], axis=-1)
    once = run(sos, ext, steady=True)
    back = run(sos, once[..., ::-1], steady=True)[..., ::-1]
    return back[..., pad : pad + n]
