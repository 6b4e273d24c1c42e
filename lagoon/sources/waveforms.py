"""Waveform traces as tables: selection, priority of sources, availability, archive days.

A trace row is ``receiver, starttime, delta, npts, data``; the rows of a receiver are its stream.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions import times
from lagoon.functions.core import let


def after(start: Column, seconds: Column) -> Column:
    """``start`` plus seconds, to the nearest microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * F.lit(1e6)).cast("long"), start)


def _samples(seconds: Column, delta: Column) -> Column:
    """Seconds in samples, without what rounding of times to microseconds adds to whole numbers."""
    return F.round(seconds / delta, 3)


def end_time(start: Column, delta: Column, npts: Column) -> Column:
    """Time of the last sample."""
    return after(start, (npts - 1) * delta)


def get_waveforms(traces: DataFrame, receiver: str, start: Column, stop: Column, buffer: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Samples of the traces of ``receiver`` (% is a wildcard) within start .. stop, widened on both
    sides by ``buffer`` times the span. Columns ``keep`` stay, and start and stop may be made of them."""
    extra = times.seconds(start, stop) * buffer
    lo, hi = after(start, -extra), after(stop, extra)
    # bounds in samples, each worked out once a row
    span = F.struct(times.seconds(F.col("starttime"), lo).alias("lo"), times.seconds(F.col("starttime"), hi).alias("hi"))
    first = lambda s: F.greatest(F.lit(0), F.ceil(_samples(s["lo"], F.col("delta")))).cast("int")
    last = lambda s: F.least(F.col("npts") - 1, F.floor(_samples(s["hi"], F.col("delta")))).cast("int")
    bounds = let(span, lambda s: let(first(s), lambda a: F.struct(a.alias("a"), (last(s) - a + 1).alias("n"))))
    t = traces.where(F.col("receiver").like(receiver) & (F.col("starttime") <= hi)).withColumn("_w", bounds).where("_w.n > 0").withColumn("_a", F.col("_w.a")).withColumn("_n", F.col("_w.n"))
    moved = after(F.col("starttime"), F.col("_a") * F.col("delta"))
    return t.select("receiver", moved.alias("starttime"), "delta", F.col("_n").alias("npts"), F.slice("data", F.col("_a") + 1, F.col("_n")).alias("data"), *(keep or []))


def waterfall(sources: list[DataFrame], keys: list[str], complete: Column) -> DataFrame:
    """Of the sources' rows for a key, those of the first source that is complete there, else of the
    last source that has the key. Adds ``source`` (its number)."""
    parts = [s.withColumn("source", F.lit(i)).withColumn("_ok", complete) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("_ok"), F.col("source"))).over(w)
    return rows.withColumn("_s", F.coalesce(first, F.max("source").over(w))).where("source = _s").drop("_s", "_ok")


def duration(traces: DataFrame) -> DataFrame:
    """Per receiver: npts, start, end, covered seconds (overlaps once), gaps and overlaps."""
    w = Window.partitionBy("receiver").orderBy("starttime", "end")
    t = traces.select("receiver", "starttime", "delta", "npts", after(F.col("starttime"), F.col("npts") * F.col("delta")).alias("end"))
    t = t.withColumn("_before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = times.seconds(F.col("_before"), F.col("starttime"))
    own = times.seconds(F.greatest(F.col("starttime"), F.coalesce(F.col("_before"), F.col("starttime"))), F.col("end"))
    return t.groupBy("receiver").agg(
        F.sum("npts").alias("npts"), F.min("starttime").alias("start"), F.max("end").alias("end"), F.sum(F.greatest(own, F.lit(0.0))).alias("seconds"),
        F.count(F.when(gap > 0, 1)).alias("gaps"), F.count(F.when(gap < 0, 1)).alias("overlaps"),
    )


def check_duration(durations: DataFrame, seconds: float, max_gap: float = 300.0) -> DataFrame:
    """Receivers whose covered time is short of ``seconds`` by at most ``max_gap``."""
    return durations.where(F.col("seconds") >= seconds - max_gap)


def slice_days(traces: DataFrame, min_seconds: float = 3600.0) -> DataFrame:
    """Traces cut at midnights; parts shorter than ``min_seconds`` go."""
    t = traces.withColumn("_end", end_time(F.col("starttime"), F.col("delta"), F.col("npts")))
    t = t.withColumn("day", F.explode(times.days(F.col("starttime"), F.col("_end"))))
    midnight = F.col("day").cast("timestamp_ntz")
    a = F.greatest(F.lit(0), F.ceil(_samples(times.seconds(F.col("starttime"), midnight), F.col("delta")))).cast("int")
    b = F.least(F.col("npts"), F.ceil(_samples(times.seconds(F.col("starttime"), F.timestamp_add("DAY", F.lit(1), midnight)), F.col("delta")))).cast("int")
    t = t.withColumn("_a", a).withColumn("_n", b - a).where((F.col("_n") > 0) & (F.col("_n") * F.col("delta") >= min_seconds))
    moved = after(F.col("starttime"), F.col("_a") * F.col("delta"))
    return t.select("receiver", "day", moved.alias("starttime"), "delta", F.col("_n").alias("npts"), F.slice("data", F.col("_a") + 1, F.col("_n")).alias("data"))


def archive(traces: DataFrame, path: str, min_seconds: float = 3600.0) -> None:
    """Writes day slices under ``path``; a (receiver, day) that is written again is replaced."""
    days = slice_days(traces, min_seconds).dropDuplicates(["receiver", "day", "starttime"])
    days.repartition("receiver", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("receiver", "day").parquet(path)


def availability(cells: DataFrame, receivers: DataFrame, receiver: str, day: str, first: int, last: int, least: int, count: str) -> DataFrame:
    """Every receiver and day: status 1 with at least ``least`` samples, 0 with some, -1 with none."""
    grid = receivers.select(receiver).distinct().select(receiver, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(day))
    have = cells.groupBy(receiver, day).agg(F.sum(count).alias("_n"))
    j = grid.join(have, [receiver, day], "left")
    return j.select(receiver, day, F.when(F.col("_n") >= least, 1).when(F.col("_n") > 0, 0).otherwise(-1).alias("status"))


def availability_rollup(status: DataFrame, receiver: str) -> DataFrame:
    """Share of available days by receiver and (NULL receiver) in all."""
    return status.rollup(receiver).agg(F.avg(F.when(F.col("status") == 1, 1.0).otherwise(0.0)).alias("available"), F.count("*").alias("n"))


def gating(times_: DataFrame, status: DataFrame, day: str, receiver: str, n_receivers: int, before: int, after: int) -> DataFrame:
    """Times with at least one day in time - before .. time + after on which all receivers are there."""
    ready = status.where("status = 1").groupBy(day).agg(F.countDistinct(receiver).alias("_n")).where(F.col("_n") == n_receivers)
    # the few days that a time looks at are exploded, which makes the range condition an equi-join
    looks = times_.select("time", F.explode(F.sequence(F.col("time") - before, F.col("time") + after)).alias(day))
    return times_.join(looks.join(ready, day, "left_semi").select("time").distinct(), "time", "left_semi")


def resample_nearest(samples: DataFrame, key: str, t: str, v: str, n: int, delta: int) -> DataFrame:
    """Regular grid of steps 0 .. n - 1 of ``delta``; a step takes the nearest sample within delta / 2
    (the earlier of two as near), else NULL. A sample is near at most two steps: an equi-join."""
    s = samples.where(F.col(v).isNotNull()).select(key, F.col(t).alias("_t"), F.col(v).alias("_v"), (F.col(t) / delta).alias("_p"))
    near = s.select(key, "_t", "_v", F.explode(F.array_distinct(F.array(F.floor("_p").cast("int"), F.ceil("_p").cast("int")))).alias("step"))
    near = near.withColumn("_d", F.abs(F.col("_t") - F.col("step") * delta)).where((F.col("_d") * 2 <= delta) & (F.col("step") >= 0) & (F.col("step") < n))
    best = near.groupBy(key, "step").agg(F.min_by("_v", F.struct("_d", "_t")).alias(v))
    grid = samples.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    return grid.join(best, [key, "step"], "left")


def merge(samples: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """One row per (key, t) of overlapping traces, gaps filled by straight lines.

    Native: the samples around each gap are found by window functions and the gap's steps exploded.
    """
    one = samples.groupBy(key, t).agg(F.max(v).alias(v))
    w = Window.partitionBy(key).orderBy(t)
    nxt = one.withColumn("_t", F.lead(t).over(w)).withColumn("_v", F.lead(v).over(w))
    steps = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_t") - F.col(t) - 1, F.lit(0)).cast("int"))).alias("_i")
    line = F.when(F.col("_i") == 0, F.col(v)).otherwise(F.col(v) + (F.col("_v") - F.col(v)) * F.col("_i") / (F.col("_t") - F.col(t)))
    return nxt.select(key, t, v, "_t", "_v", steps).select(key, (F.col(t) + F.col("_i")).alias(t), line.alias(v))


def rotate(north: Column, east: Column, back_azimuth: Column) -> tuple[Column, Column]:
    """Radial and transverse components; back azimuth in degrees."""
    b = F.radians(back_azimuth)
    r = F.zip_with(north, east, lambda n, e: -n * F.cos(b) - e * F.sin(b))
    t = F.zip_with(north, east, lambda n, e: n * F.sin(b) - e * F.cos(b))
    return r, t


def three_components(series: DataFrame, station: str | list[str], channel: str, needed: int = 3) -> DataFrame:
    """Rows of stations that have all components."""
    n = F.size(F.collect_set(channel).over(Window.partitionBy(station)))
    return series.withColumn("_n", n).where(F.col("_n") == needed).drop("_n")


def running_rms(samples: DataFrame, key: str, t: str, v: str, window: int) -> DataFrame:
    """rms of windows of ``window`` steps that do not overlap, at the windows' centres, with the band
    code of so slow a series (U from 100 steps, V from 10, else L)."""
    band = "U" if window >= 100 else "V" if window >= 10 else "L"
    w = F.floor(F.col(t) / window).cast("int")
    return samples.groupBy(key, w.alias("_w")).agg(F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms")).select(
        key, (F.col("_w") * window + window / 2).alias("centre"), F.lit(band).alias("band"), "rms"
    )


def trim(x: Column, first: int, n: int) -> Column:
    return F.slice(x, first + 1, n)


def remove_sensitivity(x: Column, gain: Column) -> Column:
    return F.transform(x, lambda v: v / gain)


def spectral_division(x: Column, delta: float, zeros: list[complex], poles: list[complex], gain: float, water_level: float = 60.0) -> Column:
    """Removes an instrument response given by poles and zeros (rad/s) down to a water level in dB."""
    import numpy as np

    from lagoon.operators.kernels import unary

    def run(a):
        n = a.shape[-1]
        s = 2j * np.pi * np.fft.rfftfreq(n, delta)
        h = gain * np.prod([s - z for z in zeros] or [np.ones_like(s)], axis=0) / np.prod([s - p for p in poles] or [np.ones_like(s)], axis=0)
        size = np.abs(h)
        floor = size.max() * 10 ** (-water_level / 20)
        h = np.where(size < floor, np.where(size > 0, h / np.where(size > 0, size, 1), 1) * floor, h)
        return np.fft.irfft(np.fft.rfft(a) / h, n)

    return unary(run, x)


def simulate(x: Column, delta: float, zeros: list[complex], poles: list[complex], gain: float) -> Column:
    """What an instrument of the given response would record."""
    import numpy as np

    from lagoon.operators.kernels import unary

    def run(a):
        s = 2j * np.pi * np.fft.rfftfreq(a.shape[-1], delta)
        h = gain * np.prod([s - z for z in zeros] or [np.ones_like(s)], axis=0) / np.prod([s - p for p in poles] or [np.ones_like(s)], axis=0)
        return np.fft.irfft(np.fft.rfft(a) * h, a.shape[-1])

    return unary(run, x)


def _decimate(factor: int, delta: float | None = None, lowpass: bool = True) -> list:
    """Every ``factor``-th sample after a zero-phase low-pass at 0.8 of the new Nyquist.

    The cut-off in units of samples depends on ``factor`` alone, so ``delta`` is not needed. ``lowpass``
    False takes the samples as they are, and what lies above the new Nyquist is aliased.
    """
    from lagoon.operators import transforms

    low = [lambda c: transforms.filter(c, 0.4 / (factor * (delta or 1.0)), "lowpass", delta or 1.0, 4)] if lowpass and factor > 1 else []
    return [*low, lambda c: A.decimate(c, factor)]


def _interpolate(factor: float | None = None, sampling_rate: float | None = None, delta: float | None = None, method: str = "linear", a: int = 20) -> list:
    """``factor`` times as many samples, or ``sampling_rate`` a second from steps of ``delta`` seconds;
    ``method`` linear or lanczos (``a`` samples to either side)."""
    from lagoon.operators import transforms

    if (factor is None) == (sampling_rate is None) or (sampling_rate is not None and delta is None):
        raise ValueError("interpolate needs either a factor, or a sampling rate and delta")
    if method == "linear" and isinstance(factor, int):
        return [lambda c: transforms.interpolate_linear(c, factor)]
    return [lambda c: transforms.interpolate(c, factor if sampling_rate is None else sampling_rate * delta, method, a)]


#: name -> function of the parameters that gives the steps, each a function of a series column
OPERATIONS = {
    "detrend": lambda type="linear": [A.detrend if type == "linear" else A.demean],  # noqa: A006
    "demean": lambda: [A.demean],
    "taper": lambda **p: [lambda c: A.taper(c, **p)],
    "normalize": lambda: [A.norm1d],
    "trim": lambda first, n: [lambda c: trim(c, first, n)],
    "decimate": _decimate,
    "remove_sensitivity": lambda gain: [lambda c: remove_sensitivity(c, F.lit(float(gain)))],
    "remove_response": lambda **p: [lambda c: spectral_division(c, **p)],
    "simulate": lambda **p: [lambda c: simulate(c, **p)],
}


def list_operations() -> list[str]:
    return sorted([*OPERATIONS, "filter", "resample", "interpolate"])


def apply_operations(df: DataFrame, column: str, operations: list, strict: bool = False) -> DataFrame:
    """``df`` with operations applied to a series column in order.

    An operation is (name, params) or any callable of a column. Unknown names are skipped with a warning,
    or raise where ``strict``. Each step is a projection of its own: neighbouring native ones are merged by
    Catalyst, kernels run where they stand.
    """
    from lagoon.operators import transforms

    known = OPERATIONS | {
        "filter": lambda type, frequency, delta, order=4: [lambda c: transforms.causal_filter(c, frequency, type, delta, order)],  # noqa: A006
        "resample": lambda n: [lambda c: transforms.resample(c, n)],
        "interpolate": _interpolate,
    }
    for op in operations:
        if callable(op):
            steps = [op]
        else:
            name, params = op
            if name not in known:
                if strict:
                    raise ValueError(f"no such operation: {name}")
                warnings.warn(f"skipped, no such operation: {name!r}", UserWarning, stacklevel=2)
                continue
            steps = known[name](**params)
        for step in steps:
            df = df.withColumn(column, step(F.col(column)))
    return df
