"""Analysis pipelines from correlations to signal-to-noise, triggers, spectra, peaks and beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.kernels import fourier
from lagoon.operators import detect, matrix, transforms
from lagoon.operators.kernels import binary


def snr(xc: DataFrame, keys: list[str], *, first: float, delta: float, signal: tuple[float, float], noise: tuple[float, float], **options) -> DataFrame:
    """Rows (keys, s, lag_s_max, n, snr) of series without missing samples."""
    window = lambda w: (F.lit(float(w[0])), F.lit(float(w[1])))
    good = xc.where(~A.has_nan(F.col("cc")))
    return good.withColumn("_s", detect.snr(F.col("cc"), first, delta, window(signal), window(noise), **options)).select(*keys, "_s.*")


def ct(snrs: DataFrame, element: str, time: str, **trigger) -> tuple[DataFrame, DataFrame]:
    """Coincidence periods of signal-to-noise ratios, and the ratios below the peak cap."""
    trigs = detect.coincidence_trigger(snrs, element, time, "snr", **trigger)
    return trigs, detect.peak_cap(snrs, trigs, element, time, "snr")


def psd(xc: DataFrame, keys: list[str], *, delta: float, duration: float, padding: int = 4, freq_max: float, periods: DataFrame | None = None, time: str = "time") -> DataFrame:
    """Spectrograms up to ``freq_max`` of the series whose time lies in a trigger period."""
    rows = xc if periods is None else xc.join(periods.select("period", time), time)
    keep = keys if periods is None else [*keys, "period"]
    return transforms.spectrogram(rows, keep, "cc", delta, duration, padding=padding, freq_lim=(0.0, freq_max))


def plmax(spec: DataFrame, keys: list[str], *, distance: int = 25, threshold_rel: float = 0.01) -> DataFrame:
    """Ranked peaks of spectrograms."""
    return detect.peak_local_max(spec, keys, distance=distance, threshold_rel=threshold_rel)


def timelapse(spec: DataFrame, pair: str, time: str, bands: list[tuple[float, float]], *, done: DataFrame | None = None, chunks: int = 4) -> DataFrame:
    """Peak of the 2-D correlation of spectrograms of every two times of a pair, per frequency band.

    Spectrograms are cut to a band and packed once per (pair, time). A pair's times are dealt into
    ``chunks``; a task has the spectrograms of two chunks and compares them there, lower triangle only,
    so a spectrogram is sent ``chunks`` times, not once for every other time. Cells are then mirrored
    (correlation even, shifts odd). ``done``: rows (pair, band, time1, time2) that exist already and are
    not computed again.
    """
    marks = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(bands)])
    cut = spec.select(pair, time, "freq", "psd", F.explode(marks).alias("_b")).where("freq >= _b.lo and freq < _b.hi")
    packs = cut.groupBy(pair, time, F.col("_b.band").alias("band")).agg(
        F.count("*").alias("rows"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("freq", "psd"))), lambda p: p["psd"])).alias("m")
    )
    chunk = lambda t: F.pmod(F.xxhash64(t), F.lit(chunks)).cast("int")
    cell = lambda x, y: [F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b")]
    sent = packs.select(pair, "band", F.col(time).alias("_t"), "rows", "m", chunk(time).alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_o"))
    sent = sent.select(pair, "band", *cell(F.col("_c"), F.col("_o")), "_t", "_c", "rows", "m")

    def compare(frame: pd.DataFrame, known: set) -> pd.DataFrame:
        frame = frame.sort_values("_t").reset_index(drop=True)
        z = [np.asarray(m, float).reshape(r, -1) for m, r in zip(frame["m"], frame["rows"], strict=True)]
        out = []
        for i in range(len(z)):
            for k in range(i + 1):
                # two times meet once: in the cell of their chunks
                if {frame["_c"][i], frame["_c"][k]} != {frame["_a"][0], frame["_b"][0]} or z[i].shape != z[k].shape or (frame["_t"][i], frame["_t"][k]) in known:
                    continue
                c = fourier.correlate2d(z[i][None], z[k][None])[0]
                at = None if np.isnan(c).all() else np.unravel_index(np.argmax(c), c.shape)
                peak = (None, None, None) if at is None else (c[at], float(at[0]) - (z[i].shape[0] - 1), float(at[1]) - (z[i].shape[1] - 1))
                out.append((frame[pair][0], frame["band"][0], frame["_t"][i], frame["_t"][k], *peak))
        return pd.DataFrame(out, columns=[pair, "band", "time1", "time2", "cc2", "delta_freq", "delta_lag"])

    kind = {f.name: f.dataType.simpleString() for f in spec.schema}
    schema = f"{pair} {kind[pair]}, band int, time1 {kind[time]}, time2 {kind[time]}, cc2 double, delta_freq double, delta_lag double"
    keys = [pair, "band", "_a", "_b"]
    if done is None:
        low = sent.groupBy(*keys).applyInPandas(lambda frame: compare(frame, set()), schema)
    else:
        old = done.select(pair, "band", *cell(chunk("time1"), chunk("time2")), "time1", "time2")

        def rest(frame: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            return compare(frame, set(zip(have["time1"], have["time2"], strict=True)))

        low = sent.groupBy(*keys).cogroup(old.groupBy(*keys)).applyInPandas(rest, schema)
    return matrix.tri_mirror(low, [pair, "band"], "time1", "time2", {"cc2": False, "delta_freq": True, "delta_lag": True})


def beamform(shifts: DataFrame, geometry: DataFrame, time: str, n_pairs: int) -> DataFrame:
    """Plane-wave fits of the times that have all pairs; ``shifts``: (time, rx_a, rx_b, tau)."""
    j = shifts.join(F.broadcast(geometry), ["rx_a", "rx_b"])  # an array's couples: a few rows
    return matrix.plane_wave(j, [time], n_pairs=n_pairs)


def swresp(two: DataFrame, keys: list[str], x: str, y: str, delta: float) -> DataFrame:
    """Response between two components: (keys, freq, magnitude, phase / pi), phase of y * conj(x)."""

    def run(a, b):
        f = np.fft.rfft(b) * np.conj(np.fft.rfft(a))
        return np.concatenate([np.abs(f) ** 2, np.angle(f) / np.pi], axis=-1)

    half = (F.size("_f") / 2).cast("int")
    rows = two.withColumn("_f", binary(run, F.col(x), F.col(y))).withColumn("_n", F.size(x))
    pairs = F.arrays_zip(F.slice("_f", F.lit(1), half).alias("magnitude"), F.slice("_f", half + 1, half).alias("phase"))
    return rows.select(*keys, "_n", F.posexplode(pairs).alias("_k", "_p")).select(*keys, (F.col("_k") / (F.col("_n") * delta)).alias("freq"), "_p.magnitude", "_p.phase")
