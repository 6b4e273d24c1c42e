"""Operators on square comparisons (time1 x time2) and on arrays of receivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tri_mask(a, b, k: int = 0):
    """Cells on and below the k-th diagonal."""
    return b <= (a + k if k else a)  # on the diagonal any ordered type will do


def tri_mirror(cells: DataFrame, keys: list[str], i: str, j: str, values: dict[str, bool], k: int = 0) -> DataFrame:
    """Lower-triangle cells kept, the rest filled from their mirror; ``values``: column -> sign turns."""
    cell = lambda x, y, turn: F.struct(F.col(x).alias(i), F.col(y).alias(j), *[(-F.col(v) if odd and turn else F.col(v)).alias(v) for v, odd in values.items()])
    # a cell and its mirror come from one row, so that what is upstream is computed once
    both = F.when(tri_mask(F.col(j), F.col(i), k), F.array(cell(i, j, False))).otherwise(F.array(cell(i, j, False), cell(j, i, True)))
    return cells.where(tri_mask(F.col(i), F.col(j), k)).select(*keys, F.explode(both).alias("_c")).select(*keys, "_c.*")


def norm2d(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values over the Frobenius norm of their group."""
    n = F.sqrt(F.sum(F.col(value) ** 2).over(Window.partitionBy(*keys)))
    return cells.withColumn(value, F.when(n > 0, F.col(value) / n))


def plane_wave(delays: DataFrame, keys: list[str], dx: str = "dx", dy: str = "dy", tau: str = "tau", n_pairs: int | None = None) -> DataFrame:
    """Least-squares slowness of a plane wave from couples' distances (m) and delays (s).

    Rows (keys, s_x, s_y in s/km, doa in degrees, vel in km/s, err in s^2). The normal equations are
    sums over couples whose delay is known, solved in closed form; a singular geometry gives NULL. A wave
    without slowness, which is everywhere at once, has infinite velocity. With ``n_pairs`` only keys that
    have so many delays are fitted.
    """
    t = F.col(tau)
    x, y = F.when(t.isNotNull(), F.col(dx)), F.when(t.isNotNull(), F.col(dy))
    s = delays.groupBy(*keys).agg(F.count(t).alias("_n"), *[F.sum(e).alias(n) for n, e in {"xx": x * x, "xy": x * y, "yy": y * y, "xt": x * t, "yt": y * t, "tt": t * t}.items()])
    if n_pairs is not None:
        s = s.where(F.col("_n") == n_pairs)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    sx = (F.col("yy") * F.col("xt") - F.col("xy") * F.col("yt")) / F.nullif(det, F.lit(0.0))
    sy = (F.col("xx") * F.col("yt") - F.col("xy") * F.col("xt")) / F.nullif(det, F.lit(0.0))
    s = s.withColumn("_sx", sx).withColumn("_sy", sy)
    norm = F.sqrt(F.col("_sx") ** 2 + F.col("_sy") ** 2)
    err = F.col("tt") - F.col("_sx") * F.col("xt") - F.col("_sy") * F.col("yt")
    doa = F.pmod(F.degrees(F.atan2("_sx", "_sy")) + 360, F.lit(360.0))
    return s.select(
        *keys, (F.col("_sx") * 1000).alias("s_x"), (F.col("_sy") * 1000).alias("s_y"),
        F.when(norm == 0, F.lit(0.0)).otherwise(doa).alias("doa"), F.when(norm == 0, F.lit(float("inf"))).otherwise(1 / F.nullif(norm * 1000, F.lit(0.0))).alias("vel"), F.greatest(err, F.lit(0.0)).alias("err"),
    )


def couples(receivers: DataFrame, receiver: str, x: str, y: str) -> DataFrame:
    """(rx_a, rx_b, dx, dy) for receivers a < b; an array has few receivers."""
    a = receivers.select(F.col(receiver).alias("rx_a"), F.col(x).alias("_xa"), F.col(y).alias("_ya"))
    b = receivers.select(F.col(receiver).alias("rx_b"), F.col(x).alias("_xb"), F.col(y).alias("_yb"))
    return a.join(b, F.col("rx_a") < F.col("rx_b")).select("rx_a", "rx_b", (F.col("_xb") - F.col("_xa")).alias("dx"), (F.col("_yb") - F.col("_ya")).alias("dy"))
