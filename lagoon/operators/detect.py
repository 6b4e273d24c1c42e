"""Signal-to-noise ratios, coincidence triggers and peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions.core import let
from lagoon.kernels import spectral
from lagoon.operators import transforms


def snr(x: Column, first: float | Column, delta: float, signal: tuple[Column, Column], noise: tuple[Column, Column], *, power: bool = False, decibels: bool = False, envelope: bool = False) -> Column:
    """Struct (s, lag_s_max, n, snr): largest |x| in the signal window and its lag, rms in the noise
    window. ``envelope`` takes the envelope of the whole series first."""
    base = transforms.envelope(x) if envelope else x

    def build(a: Column) -> Column:
        top = A.peak(A.between(a, first, delta, *signal))
        n = A.rms(A.values(A.between(a, first, delta, *noise)))

        def ratio(p: Column) -> Column:
            r = p["t"]["v"] / F.nullif(p["n"], F.lit(0.0))
            shown = A.decibel(r) if decibels else (r * r if power else r)
            s, nn = (p["t"]["v"] ** 2, p["n"] ** 2) if power and not decibels else (p["t"]["v"], p["n"])
            return F.struct(s.alias("s"), p["t"]["c"].alias("lag_s_max"), nn.alias("n"), shown.alias("snr"))

        return let(F.struct(top.alias("t"), n.alias("n")), ratio)

    return let(base, build)


def celerity_window(distance_km: Column, fastest: float | None, slowest: float | None, low: float, high: float) -> tuple[Column, Column]:
    """Lags of arrivals between celerities (m/s), within low .. high; no celerity is no bound."""
    a = F.lit(float(low)) if fastest is None else F.greatest(F.lit(float(low)), distance_km * 1000 / fastest)
    b = F.lit(float(high)) if slowest is None else F.least(F.lit(float(high)), distance_km * 1000 / slowest)
    return a, b


def _days(units: str) -> float:
    return {"seconds": 86400.0, "hours": 24.0, "days": 1.0}[units]


def coincidence_trigger(values: DataFrame, element: str, time: str, value: str, *, thr_on: float, thr_off: float | None = None, coincidence: int, step: int = 1, min_steps: int = 3, extend: int = 0) -> DataFrame:
    """Rows (time, period) of steps at which at least ``coincidence`` elements are triggered.

    ``time`` is an integer step number. An element is on from thr_on until it falls below thr_off (the
    same where not given). Runs shorter than ``min_steps`` steps go; runs are extended by ``extend``
    steps, joined where they touch, and numbered from 0 in time. All of it is
    native: counts and islands, and for two thresholds the last change of an element's state.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(element).alias("_e"), F.col(time).alias("_t"), F.col(value).alias("_v"))
    if thr_off is None or thr_off == thr_on:
        on = rows.where(F.col("_v") >= thr_on).select("_e", "_t")
    else:
        # the state is the last of on (1) and off (0) samples; a gap ends a trigger
        w = Window.partitionBy("_e").orderBy("_t")
        gap = F.coalesce(F.col("_t") != F.lag("_t").over(w) + step, F.lit(True))
        mark = F.when(F.col("_v") >= thr_on, 1).when((F.col("_v") < thr_off) | gap, 0)
        marked = rows.withColumn("_m", mark).withColumn("_on", F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        on = marked.where("_on = 1").select("_e", "_t")
    hits = on.groupBy("_t").agg(F.countDistinct("_e").alias("_n")).where(F.col("_n") >= coincidence)
    # a hit tells the steps beside it, so that one shuffle finds where runs begin and end; only these
    # ends, not the steps between, are then put in one order, in one pass
    tell = F.explode(F.array(*[F.struct((F.col("_t") + k * step).alias("t"), F.lit(k).alias("k")) for k in (-1, 0, 1)]))
    told = hits.select(tell.alias("_s")).groupBy(F.col("_s.t").alias("_t")).agg(F.collect_set("_s.k").alias("_k"))
    has = lambda k: F.array_contains("_k", k)
    ends = told.where(has(0) & ~(has(1) & has(-1))).select("_t", (~has(1)).alias("_begin"), (~has(-1)).alias("_stop"))
    order = Window.orderBy("_t")
    runs = ends.withColumn("_b", F.when(F.col("_stop"), F.col("_t")).otherwise(F.lead("_t").over(order)))
    runs = runs.where(F.col("_begin") & (F.col("_b") - F.col("_t") + step >= min_steps * step))
    # runs do not meet, so after each is extended alike only the one before can reach the next
    touch = F.col("_t") - F.lag("_b").over(order) <= (2 * extend + 1) * step
    numbered = runs.withColumn("_new", F.when(touch, 0).otherwise(1)).withColumn("period", F.sum("_new").over(order) - 1)
    spans = numbered.groupBy("period").agg((F.min("_t") - extend * step).alias("a"), (F.max("_b") + extend * step).alias("b"))
    return spans.select(F.explode(F.sequence("a", "b", F.lit(step).cast(dict(spans.dtypes)["a"]))).alias(time), F.col("period").cast("int").alias("period"))


def trigger_periods(trigs: DataFrame, time: str, units: str = "hours") -> DataFrame:
    """(period, start, end, days)."""
    return trigs.groupBy("period").agg(F.min(time).alias("start"), F.max(time).alias("end")).withColumn("days", (F.col("end") - F.col("start")) / _days(units))


def period_days(trigs: DataFrame, time: str, steps_a_day: int) -> DataFrame:
    """(period, day): the days that each period touches."""
    spans = trigs.groupBy("period").agg(F.min(time).alias("a"), F.max(time).alias("b"))
    day = lambda c: F.floor(F.col(c) / steps_a_day).cast("int")
    return spans.select("period", F.explode(F.sequence(day("a"), day("b"))).alias("day"))


def trigger_values(values: DataFrame, trigs: DataFrame, time: str) -> DataFrame:
    """Values at triggered times, with their period."""
    return values.join(trigs, time)


def peak_cap(values: DataFrame, trigs: DataFrame, element: str, time: str, value: str) -> DataFrame:
    """Values not above the largest, over triggered times, of the smallest element value of a time."""
    cap = trigger_values(values, trigs, time).groupBy(time).agg(F.min(value).alias("_m")).agg(F.max("_m").alias("_cap"))
    return values.crossJoin(F.broadcast(cap)).where(F.col(value) <= F.col("_cap")).drop("_cap")  # cap is one row


def peaks_long(cells: DataFrame, keys: list[str], row: str, col: str, value: str, threshold_rel: float = 0.0) -> DataFrame:
    """Local maxima of 3 x 3 neighbourhoods (ties: the first row, then column), ranked by value; native.

    Every cell is sent to its neighbours, so that neighbourhoods are sums of one shuffle.
    """
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = cells.select(*keys, row, col, value, near.alias("_d")).select(
        *keys, (F.col(row) + F.col("_d.dr")).alias(row), (F.col(col) + F.col("_d.dc")).alias(col),
        F.struct(F.col(value).alias("v"), (-F.col(row)).alias("r"), (-F.col(col)).alias("c")).alias("_n"),
        ((F.col("_d.dr") == 0) & (F.col("_d.dc") == 0)).alias("_own"),
    )
    best = sent.groupBy(*keys, row, col).agg(F.max("_n").alias("_b"), F.max(F.when(F.col("_own"), F.col("_n.v"))).alias(value))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    best = best.withColumn("_top", F.max(value).over(w))
    found = best.where((F.col("_b.r") == -F.col(row)) & (F.col("_b.c") == -F.col(col)) & (F.col(value) > 0) & (F.col(value) >= threshold_rel * F.col("_top")))
    rank = F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(value), row, col)) - 1
    return found.select(*keys, row, col, value, rank.alias("rank"), (F.col(value) / F.col("_top")).alias("threshold"))


def peak_local_max(spec: DataFrame, keys: list[str], *, distance: int = 1, threshold_rel: float = 0.0, value: str = "psd") -> DataFrame:
    """Ranked peaks of time-frequency rows (keys, freq, value array): (keys, freq, index, v, rank).

    A group is the matrix of one series, as the operator needs it whole.
    """
    kinds = ", ".join(f"{k} {spec.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("freq")
        z = np.stack([np.asarray(v, float) for v in frame[value]])
        f = frame["freq"].to_numpy()
        found = spectral.local_peaks(z, distance, threshold_rel)
        top = z.max() if z.size else 1.0
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "freq": f[r], "index": c, "v": z[r, c], "rank": i, "threshold": z[r, c] / top} for i, (r, c) in enumerate(found)], columns=[*keys, "freq", "index", "v", "rank", "threshold"])

    return spec.groupBy(*keys).applyInPandas(run, f"{kinds}, freq double, index int, v double, rank int, threshold double")
