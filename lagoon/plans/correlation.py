"""Correlation runs: the plan of pairs and windows, processing, clean-up and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions import names
from lagoon.functions.core import let
from lagoon.operators import correlate, transforms

MISSING, TODO, DONE = -1, 0, 1


def init(receivers: DataFrame, receiver: str, first: int, last: int, window: int, step: int) -> DataFrame:
    """Rows (pair, rx_a, rx_b, start, time, status) for pairs a < b and half-open window starts.

    ``time`` is the window's centre. Steps are exploded on the pairs, which an array has few of.
    """
    r = receivers.select(F.col(receiver).alias("r")).distinct()
    pairs = r.withColumnRenamed("r", "rx_a").join(r.withColumnRenamed("r", "rx_b"), F.col("rx_a") < F.col("rx_b"))
    starts = F.explode(F.sequence(F.lit(first), F.lit(last - window), F.lit(step))).alias("start")
    return pairs.select(names.pair(F.col("rx_a"), F.col("rx_b")).alias("pair"), "rx_a", "rx_b", starts).withColumn("time", F.col("start") + window / 2).withColumn("status", F.lit(TODO))


def chunks(samples: DataFrame, receiver: str, t: str, v: str, first: int, last: int, length: int) -> DataFrame:
    """(receiver, k0, data): samples of first .. last - 1 as arrays, one for each ``length`` steps.

    Absent steps between a chunk's first and last are NULL. Each sample is sent once.
    """
    rows = samples.where((F.col(t) >= first) & (F.col(t) < last)).select(receiver, F.floor((F.col(t) - first) / length).alias("_c"), F.struct(F.col(t).alias("t"), F.col(v).alias("v")).alias("_p"))
    sets = rows.groupBy(receiver, "_c").agg(F.sort_array(F.collect_list("_p")).alias("_p"))

    def dense(p: Column) -> Column:
        gap = lambda i: F.coalesce(F.get(p, i + 1)["t"] - F.get(p, i)["t"] - 1, F.lit(0)).cast("int")
        plain = F.transform(p, lambda q: q["v"])
        filled = F.flatten(F.transform(p, lambda q, i: F.concat(F.array(q["v"]), F.array_repeat(F.lit(None).cast("double"), gap(i)))))
        return F.when(F.element_at(p, -1)["t"] - p[0]["t"] + 1 == F.size(p), plain).otherwise(filled)

    return sets.select(receiver, F.col("_p")[0]["t"].cast("long").alias("k0"), let(F.col("_p"), dense).alias("data"))


def trace_windows(traces: DataFrame, receiver: str, first: int, last: int, window: int, step: int) -> DataFrame:
    """(receiver, start, x, complete) from traces (receiver, k0, data), ``k0`` the step of the first sample.

    A trace meets a window as one slice, so samples never become rows; a window's slices are put in order,
    laps of later ones cut off, gaps and ends filled with NULL, in one pass over the samples.
    """
    n = F.size("data")
    low = F.greatest(F.lit(first), F.ceil((F.col("k0") - window + 1 - first) / step) * step + first)
    high = F.least(F.lit(last - window), F.floor((F.col("k0") + n - 1 - first) / step) * step + first)
    met = traces.where(n > 0).withColumn("_a", low.cast("int")).withColumn("_b", high.cast("int")).where("_a <= _b")
    met = met.select(receiver, "k0", "data", F.explode(F.sequence("_a", "_b", F.lit(step))).alias("start"))
    skip = F.greatest(F.lit(0), F.col("start") - F.col("k0")).cast("int")
    at = F.greatest(F.lit(0), F.col("k0") - F.col("start")).cast("int")
    part = F.slice("data", skip + 1, F.least(F.size("data") - skip, F.lit(window) - at))
    parts = met.groupBy(receiver, "start").agg(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.size(part).alias("n"), part.alias("v")))).alias("_p"))

    def assemble(p: Column) -> Column:
        # where the samples before a slice end, from the offsets alone
        ends = F.aggregate(p, F.array(F.lit(0)), lambda e, q: F.concat(e, F.array(F.greatest(F.element_at(e, -1), q["o"] + q["n"]))))
        nulls = lambda k: F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), k))

        def fit(e: Column) -> Column:
            pieces = F.transform(p, lambda q, i: F.concat(
                nulls(q["o"] - e[i]), F.slice(q["v"], F.greatest(F.lit(0), e[i] - q["o"]) + 1, q["n"])
            ))
            return F.concat(F.flatten(pieces), nulls(F.lit(window) - F.element_at(e, -1)))

        return F.when((F.size(p) == 1) & (p[0]["n"] == window), p[0]["v"]).otherwise(let(ends, fit))

    x = parts.select(receiver, "start", let(F.col("_p"), assemble).alias("x"))
    return x.withColumn("complete", F.size(F.array_compact("x")) == window)


def windows(grid: DataFrame, receiver: str, t: str, v: str, first: int, last: int, window: int, step: int) -> DataFrame:
    """(receiver, start, x, complete) of long samples: chunks of a step, then ``trace_windows``."""
    return trace_windows(chunks(grid, receiver, t, v, first, last, step), receiver, first, last, window, step)


def process(plan: DataFrame, wins: DataFrame, receiver: str, window: int, clip: tuple[int, int] | None = None, normalize: bool = False, parts: int = 1) -> DataFrame:
    """The plan's rows with ``cc`` and status: done where both receivers' windows are complete, else
    missing.

    A window's receivers meet in one task, where each series is transformed once and pairs are products
    of spectra. Where they are too many for a task, they are dealt into ``parts`` and a task has two of
    these: N receivers are then transformed ``parts`` times, not N - 1 times. Lags beyond ``clip``
    (samples) do not leave the kernel.
    """
    return correlate.process_cells(plan, wins.where("complete").select(receiver, "start", "x"), receiver, window, clip, normalize, parts).withColumn(
        "status", F.when(F.col("cc").isNotNull() | F.col("_both"), DONE).otherwise(MISSING)
    ).select("pair", "rx_a", "rx_b", "start", "time", "status", "cc")


def retry(done: DataFrame, plan: DataFrame, retry_missing: bool = False) -> DataFrame:
    """Rows of the plan that are still to do: those without a done (or, unless retried, missing) row."""
    settled = done.where(F.col("status").isin(DONE) if retry_missing else F.col("status") != TODO)
    return plan.join(settled.select("pair", "time"), ["pair", "time"], "left_anti")


def offsets(start_a: Column, start_b: Column, window_seconds: float, time: Column) -> Column:
    """Struct (pair_offset, time_offset, delay) in seconds from the traces' actual starts."""
    pair_offset = start_a - start_b
    time_offset = start_a + window_seconds / 2 - time
    return F.struct(pair_offset.alias("pair_offset"), time_offset.alias("time_offset"), (-(pair_offset + time_offset)).alias("delay"))


def postprocess(xc: DataFrame, *, n: int, first_lag: int, delta: float, highpass: float, order: int = 2, taper1: float, taper2: float, delay: Column | None = None, done_only: bool = True) -> DataFrame:
    """Done rows with ``cc`` cleaned: unbias, demean, taper, time shift, high-pass, taper.

    Consecutive native steps stay in one projection; shift and filter are one kernel each. A table that
    carries ``postprocessed`` is returned as it is.
    """
    if "postprocessed" in xc.columns:
        return xc
    rows = xc.where(F.col("status") == DONE) if done_only and "status" in xc.columns else xc
    cc = F.col("cc")
    rows = rows.withColumn("cc", A.taper(A.demean(A.unbias(cc, n, first_lag)), max_length=taper1, delta=delta))
    rows = rows.withColumn("cc", transforms.timeshift(cc, F.lit(0.0) if delay is None else delay, delta))
    rows = rows.withColumn("cc", transforms.filter(cc, highpass, "highpass", delta, order))
    return rows.withColumn("cc", A.taper(cc, max_length=taper2, delta=delta)).withColumn("postprocessed", F.lit(True))
