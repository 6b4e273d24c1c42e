"""Receiver distances: spherical in SQL, ellipsoidal as an Arrow-batched kernel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.kernels import geodesic

RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


@F.pandas_udf(T.DoubleType())
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Kilometres on the WGS84 ellipsoid."""
    return pd.Series(geodesic.distance(lat1, lon1, lat2, lon2) / 1000)


def local_xy_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant coordinates about (lat0, lon0)."""
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl))))
    k = F.when(F.abs(c) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c))
    x = RADIUS_KM * k * F.cos(p) * F.sin(dl)
    y = RADIUS_KM * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))
    return x, y
