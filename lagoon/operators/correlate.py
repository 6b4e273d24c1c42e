"""Pairing and cross-correlation of series.

One row is one series: keys and an ``array<double>``. A full correlation has 2n - 1 lags; zero lag is
element n - 1 and a positive lag means that the first series is delayed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions import names
from lagoon.kernels import fourier
from lagoon.operators.kernels import binary


def dense_grid(cells: DataFrame, keys: DataFrame, key: str, step: str, n: int, value: str, fill: float | None = 0.0) -> DataFrame:
    """Every key at steps 0 .. n - 1; absent cells are ``fill`` (None keeps them NULL).

    The grid is made by exploding a sequence on the few keys, not by a cross join of tables.
    """
    grid = keys.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(step))
    v = F.col(value) if fill is None else F.coalesce(value, F.lit(fill))
    return grid.join(cells.select(key, step, value), [key, step], "left").select(key, step, v.alias(value))


def regular(rows: DataFrame, key: str, t: str, tolerance: float = 1e-10) -> DataFrame:
    """(key, regular): whether a key's times are evenly spaced, by the range of their differences."""
    gap = (F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))).cast("double")
    return rows.select(key, gap.alias("_d")).groupBy(key).agg((F.coalesce(F.max("_d") - F.min("_d"), F.lit(0.0)) <= tolerance).alias("regular"))


def to_series(grid: DataFrame, keys: list[str], step: str, value: str, out: str = "x") -> DataFrame:
    """One row per key; samples in the order of ``step``."""
    pairs = F.sort_array(F.collect_list(F.struct(step, value)))
    return grid.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.transform("_p", lambda p: p[value]).alias(out))


def to_long(series: DataFrame, keys: list[str], x: str, step: str = "k", value: str = "v", first: int = 0) -> DataFrame:
    return series.select(*keys, F.posexplode(x).alias("_k", value)).select(*keys, (F.col("_k") + first).alias(step), value)


def pair_up(series: DataFrame, receiver: str = "receiver", x: str = "x", on: list[str] | None = None) -> DataFrame:
    """Rows (pair, rx_a, rx_b, xa, xb) for receivers a < b, within equal ``on`` keys if given.

    With ``on`` this is an equi-join (the windows of a time); the pair condition is checked there.
    """
    on = on or []
    a = series.select(*on, F.col(receiver).alias("rx_a"), F.col(x).alias("xa"))
    b = series.select(*[F.col(c).alias(f"_b_{c}") for c in on], F.col(receiver).alias("rx_b"), F.col(x).alias("xb"))
    if on:
        same = F.col("rx_a") < F.col("rx_b")
        for c in on:
            same = (F.col(c) == F.col(f"_b_{c}")) & same
        j = a.join(b, same)
    else:
        # couples of names alone first: the series, which are large rows, then meet in equi-joins
        ids = series.select(receiver).distinct()
        couples = ids.select(F.col(receiver).alias("_a")).join(ids.select(F.col(receiver).alias("_b")), F.col("_a") < F.col("_b"))
        j = couples.join(a, F.col("_a") == F.col("rx_a")).join(b, F.col("_b") == F.col("rx_b"))
    return j.select(names.pair(F.col("rx_a"), F.col("rx_b")).alias("pair"), "rx_a", "rx_b", *on, "xa", "xb")


def cc(x: Column, y: Column, normalize: bool = False, *, unbiased: bool = False, pad: bool = True, single: bool = False) -> Column:
    """Full correlation by FFT. ``unbiased`` weighs lag k by n / (n - |k|); without ``pad`` it is circular,
    n lags with zero lag at n // 2; ``single`` gives floats."""

    def run(a, b):
        n = a.shape[-1]
        r = fourier.correlate(a, b, normalize) if pad else fourier.circular(a, b, normalize)
        if unbiased:
            r = r * (n / (n - np.abs(np.arange(r.shape[-1]) - (n - 1 if pad else n // 2))))
        return r

    out = binary(run, x, y)
    return out.cast("array<float>") if single else out


def _cell_batches(n: int, clip: tuple[int, int] | None, normalize: bool):
    """Correlations of a cell's pairs; rows come by cell, its windows before its pairs."""
    size = fourier.fast_length(2 * n - 1)

    def run(batches):
        cell, held = None, {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            kind = batch.column(1).to_pylist()
            who, other = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows, out, both = [], [], []
            for i, key in enumerate(keys):
                if key != cell:
                    cell, held = key, {}
                if kind[i] == 0:
                    held[who[i]] = fourier.transformed(batch.column(4)[i].values.to_numpy(zero_copy_only=False), size)
                    continue
                a, b = held.get(who[i]), held.get(other[i])
                rows.append(i)
                both.append(a is not None and b is not None)
                cc = fourier.correlate_spectra(a, b, n, size, normalize, clip) if both[-1] else None
                out.append(None if cc is None or np.isnan(cc).all() else cc)
                if sum(len(x) for x in out if x is not None) > 1 << 23:
                    yield _cells_out(batch, rows, out, both)
                    rows, out, both = [], [], []
            if rows:
                yield _cells_out(batch, rows, out, both)

    return run


def _cells_out(batch, rows, out, both):
    back = batch.column(5).take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*back.flatten(), pa.array(out, pa.list_(pa.float64())), pa.array(both)], names=[*[f.name for f in back.type], "cc", "_both"])


def process_cells(plan: DataFrame, ready: DataFrame, receiver: str, window: int, clip: tuple[int, int] | None, normalize: bool, parts: int) -> DataFrame:
    """The plan's rows with ``cc`` (NULL where a window is missing or has no energy) and ``_both``.

    ``ready``: complete windows (receiver, start, x). A cell is a window start and two parts of the
    receivers; its rows are sorted so that windows come first, and are streamed.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    cell = lambda a, b: F.struct(F.col("start").cast("long").alias("s"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    schema = plan.schema
    none = F.lit(None).cast("array<double>")
    row = F.struct(*plan.columns)
    pairs = plan.select(cell(part("rx_a"), part("rx_b")).alias("cell"), F.lit(1).alias("kind"), F.col("rx_a").alias("who"), F.col("rx_b").alias("other"), none.alias("x"), row.alias("row"))
    own = part(receiver)
    wins = ready.select(receiver, "start", "x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_o")) if parts > 1 else ready.withColumn("_o", F.lit(0))
    wins = wins.select(
        cell(own, F.col("_o")).alias("cell"), F.lit(0).alias("kind"), F.col(receiver).alias("who"), F.lit(None).cast("string").alias("other"),
        F.col("x").cast("array<double>").alias("x"), F.lit(None).cast(schema).alias("row"),
    )
    rows = wins.union(pairs).repartition("cell").sortWithinPartitions("cell", "kind")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(_cell_batches(window, clip, normalize), f"{kinds}, cc array<double>, _both boolean")


def cc_long(grid: DataFrame, receiver: str, step: str, value: str, max_lag: int) -> DataFrame:
    """Correlation at |lag| <= max_lag in plain SQL, on the long view: for few lags.

    Zero samples add nothing and are left out; lags are exploded on one side, so that the join is an
    equi-join on the step.
    """
    live = grid.where(F.col(value) != 0)
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    a = live.select(F.col(receiver).alias("rx_a"), F.col(step).alias("_s"), F.col(value).alias("va"))
    a = a.select("rx_a", "va", "_s", lags.alias("lag")).withColumn("_m", F.col("_s") - F.col("lag"))
    b = live.select(F.col(receiver).alias("rx_b"), F.col(step).alias("_m"), F.col(value).alias("vb"))
    return (
        a.join(b, "_m").where("rx_a < rx_b").groupBy("rx_a", "rx_b", "lag").agg(F.sum(F.col("va") * F.col("vb")).alias("cc"))
        .select(names.pair(F.col("rx_a"), F.col("rx_b")).alias("pair"), "lag", "cc")
    )


def shift(full: Column, delta: float = 1.0, digits: int | None = None) -> Column:
    """Delay at the largest correlation; of equal ones (to ``digits`` decimals, see ``argmax``) the first."""
    return (A.argmax(full, digits) - F.floor(F.size(full) / 2)) * F.lit(delta)


def delay(x: Column, y: Column, delta: float = 1.0) -> Column:
    """``shift`` of the full correlation of two series; equal sums are found equal."""
    return binary(fourier.peak_lag, x, y, "double") * F.lit(delta)


def shift_and_max(full: Column, delta: float = 1.0) -> Column:
    return F.struct(shift(full, delta).alias("shift"), F.array_max(full).alias("cc_max"))


def cc2d(x: Column, y: Column, shape: tuple[int, int], normalize: bool = True) -> Column:
    """Full 2-D correlation of flattened row-major matrices, flattened."""

    def run(a, b):
        n = len(a)
        return fourier.correlate2d(a.reshape(n, *shape), b.reshape(n, *shape), normalize).reshape(n, -1)

    return binary(run, x, y)
