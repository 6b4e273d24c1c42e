"""Distances on the WGS84 ellipsoid by Vincenty's inverse formula (published 1975)."""

from __future__ import annotations

import numpy as np

# WGS84 semi-axes in metres.
MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563


def distance(lat1, lon1, lat2, lon2, rounds: int = 200):
    """Metres, elementwise; NaN where the iteration does not settle (nearly antipodal points)."""
    f, a = FLATTENING, MAJOR
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, dtype=float)) for v in (lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    gap = lon2 - lon1
    lam = gap.copy() if isinstance(gap, np.ndarray) else np.array(gap)
    settled = np.zeros(np.shape(lam), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s > 0, sin_s, 1), 0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a > 0, cos2_a, 1), 0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = gap + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        u_sq = cos2_a * (a**2 - b**2) / b**2
        big = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        small = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        d = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return np.where(settled, b * big * (sigma - d), np.nan)
