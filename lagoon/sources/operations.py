"""Operations on streams: trace tables (receiver, starttime, delta, npts, data) in, trace tables out.

A recipe is a list of (name, parameters), kept for each channel. Start and end of the window and the
inventory are injected where an operation takes them. Sampling steps are read from the rows, so a table
may mix rates. Unknown names are skipped with a warning, or raise where ``strict``.

An inventory is a table (receiver, azimuth, dip, zeros, poles, gain): degrees, and zeros and poles in
rad/s as arrays of real and imaginary parts in turn; columns that are not needed may lack.

Further columns are keys that stay, such as the number of a window: traces that differ in one are never
merged or rotated together, so many windows pass through a recipe at once.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions import hashing, names, times
from lagoon.functions.core import let
from lagoon.kernels import filters, fourier
from lagoon.operators import transforms
from lagoon.operators.kernels import unary_with
from lagoon.sources import waveforms

TRACE = ["receiver", "starttime", "delta", "npts", "data"]
# SEED band codes, and the band codes of long periods by steps of a second or more.
BAND_CODES = "FGDCESHBMLVURPTQ"
SLOW_BANDS = ((100.0, "U"), (10.0, "V"), (1.0, "L"))


def _extras(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TRACE and c != "response"]


def _data(df: DataFrame, x: Column, delta: Column | None = None) -> DataFrame:
    """``df`` with other samples (and step); ``npts`` follows."""
    df = df.withColumn("data", x)
    df = df if delta is None else df.withColumn("delta", delta)
    return df.withColumn("npts", F.size("data"))


def merge(df: DataFrame, method: int = 1, fill_value: str | float | None = None, interpolation_samples: int = 0) -> DataFrame:
    """One trace a receiver and step: samples of the trace that begins first where traces overlap, gaps
    NULL, a number, or straight lines (``interpolate``). A window's traces of a receiver are few."""
    if method != 1 or interpolation_samples:
        raise ValueError("merge takes method 1 without samples of interpolation across overlaps")
    p = F.array_sort(F.collect_list(F.struct("starttime", F.col("npts").alias("n"), F.col("data").alias("v"))))
    sets = df.where("npts > 0").groupBy("receiver", "delta", *_extras(df)).agg(p.alias("_p"))
    at = lambda p, q: F.round(times.seconds(p[0]["starttime"], q["starttime"]) / F.col("delta")).cast("int")

    def joined(parts: Column) -> Column:
        """``parts``: (o, n, v) of which each goes beyond those before."""

        def piece(q: Column, i: Column) -> Column:
            before = F.get(parts, i - 1)
            end = F.coalesce(before["o"] + before["n"], F.lit(0))
            gap = F.greatest(F.lit(0), q["o"] - end)
            if fill_value == "interpolate":
                last = F.element_at(before["v"], -1)
                fill = F.transform(F.sequence(F.lit(1), gap), lambda k: last + (q["v"][0] - last) * k / (gap + 1))
                fill = F.when(gap > 0, fill).otherwise(F.array().cast("array<double>"))
            else:
                fill = F.array_repeat(F.lit(fill_value).cast("double"), gap)
            return F.concat(fill, F.slice(q["v"], F.greatest(F.lit(0), end - q["o"]) + 1, q["n"]))

        return F.flatten(F.transform(parts, piece))

    def whole(p: Column) -> Column:
        placed = F.transform(p, lambda q: F.struct(at(p, q).alias("o"), q["n"].alias("n"), q["v"].alias("v")))

        def beyond(parts: Column) -> Column:
            ends = F.aggregate(parts, F.array(F.lit(0)), lambda e, q: F.concat(e, F.array(F.greatest(F.element_at(e, -1), q["o"] + q["n"]))))
            return let(let(ends, lambda e: F.filter(parts, lambda q, i: q["o"] + q["n"] > e[i])), joined)

        return let(placed, beyond)

    out = sets.withColumn("starttime", F.col("_p")[0]["starttime"]).withColumn("data", let(F.col("_p"), whole))
    return out.withColumn("npts", F.size("data")).select(*TRACE, *_extras(df))


def select(df: DataFrame, network: str | None = None, station: str | None = None, location: str | None = None, channel: str | None = None, component: str | None = None, sampling_rate: float | None = None) -> DataFrame:
    """Traces whose receiver's fields match patterns with ``*`` and ``?``."""
    parts = names.receiver_struct(F.col("receiver"))
    for name, pattern in (("network", network), ("station", station), ("location", location), ("channel", channel)):
        if pattern is not None:
            df = df.where(parts[name].rlike(_glob(pattern)))
    if component is not None:
        df = df.where(F.right(F.col("receiver"), F.lit(1)).rlike(_glob(component)))
    return df if sampling_rate is None else df.where(F.abs(F.col("delta") * sampling_rate - 1) < 1e-9)


def _glob(pattern: str) -> str:
    import re

    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def trim(df: DataFrame, starttime: Column | None = None, endtime: Column | None = None) -> DataFrame:
    """Samples from ``starttime`` to ``endtime``, both included; traces outside go."""
    if starttime is None or endtime is None:
        raise ValueError("trim needs the start and the end of the window")
    return waveforms.get_waveforms(df, "%", starttime, endtime, keep=[c for c in df.columns if c not in TRACE])


def _stem(c: str = "receiver") -> Column:
    return F.substring(F.col(c), 1, F.length(F.col(c)) - 1)


def rotate(df: DataFrame, method: str = "->ZNE", back_azimuth: float | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """``->ZNE``: three components of any orientation to vertical, north and east, by the inventory's
    azimuths and dips (without one: 1 and N north, 2 and E east, Z up); stations that lack a component
    go. ``NE->RT``: radial and transverse for a back azimuth in degrees; other components stay."""
    comp = F.right(F.col("receiver"), F.lit(1))
    extras = _extras(df)
    by = ["_stem", "starttime", "delta", "npts", *extras]
    if method == "NE->RT":
        if back_azimuth is None:
            raise ValueError("NE->RT needs a back azimuth")
        rows = df.withColumn("_stem", _stem()).withColumn("_c", comp)
        two = rows.where(F.col("_c").isin("N", "E")).groupBy(*by).agg(*[F.max(F.when(F.col("_c") == c, F.struct("data")))["data"].alias(c) for c in "NE"]).where("N is not null and E is not null")
        r, t = waveforms.rotate(F.col("N"), F.col("E"), F.lit(float(back_azimuth)))
        turned = two.select(*by, F.explode(F.array(F.struct(F.lit("R").alias("c"), r.alias("data")), F.struct(F.lit("T").alias("c"), t.alias("data")))).alias("_x"))
        turned = turned.select(F.concat("_stem", "_x.c").alias("receiver"), "starttime", "delta", "npts", "_x.data", *extras)
        return turned.unionByName(df.where(~comp.isin("N", "E")).select(*TRACE, *extras))
    if method != "->ZNE":
        raise ValueError(f"no such rotation: {method}")
    if inventory is None:
        azimuth = F.when(comp.isin("2", "E"), 90.0).otherwise(0.0)
        rows = df.withColumn("azimuth", azimuth).withColumn("dip", F.when(comp == "Z", -90.0).otherwise(0.0))
    else:
        rows = df.join(inventory.select(F.col("receiver").alias("_r"), "azimuth", "dip"), F.col("receiver") == F.col("_r")).drop("_r")
    a, d = F.radians("azimuth"), F.radians("dip")
    part = F.struct(comp.alias("c"), (F.cos(d) * F.cos(a)).alias("n"), (F.cos(d) * F.sin(a)).alias("e"), (-F.sin(d)).alias("z"), F.col("data").alias("v"))
    three = rows.withColumn("_stem", _stem()).groupBy(*by).agg(F.array_sort(F.collect_list(part)).alias("_p")).where(F.size("_p") == 3)
    m = [[F.col("_p")[i][k] for k in "nez"] for i in range(3)]
    minor = lambda i, j: (
        m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    )
    det = reduce(lambda x, y: x + y, [m[0][j] * minor(0, j) for j in range(3)])
    # rows of the inverse matrix: what north, east and up take of each component
    inverse = F.array(*[F.array(*[minor(i, j) / F.nullif(det, F.lit(0.0)) for i in range(3)]) for j in range(3)])
    v = [F.col("_p")[i]["v"] for i in range(3)]
    mixed = lambda w: F.transform(v[0], lambda x, k: w[0] * x + w[1] * F.get(v[1], k) + w[2] * F.get(v[2], k))
    out = three.withColumn("_w", inverse).select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), mixed(F.col("_w")[j]).alias("data")) for j, c in enumerate("NEZ")])).alias("_x"))
    return out.select(F.concat("_stem", "_x.c").alias("receiver"), "starttime", "delta", "npts", "_x.data", *extras)


def attach_response(df: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Adds ``response`` (zeros, poles, gain) of the receiver, NULL where the inventory has none."""
    if inventory is None:
        raise ValueError("attach_response needs an inventory")
    found = inventory.select(F.col("receiver").alias("_r"), F.struct("zeros", "poles", "gain").alias("response"))
    return df.drop("response").join(found, F.col("receiver") == F.col("_r"), "left").drop("_r")


def _response(zeros, poles, gain: float, n: int, delta: float) -> tuple[np.ndarray, np.ndarray]:
    s = 2j * np.pi * np.fft.rfftfreq(n, delta)
    pairs = lambda x: [complex(a, b) for a, b in zip(x[::2], x[1::2], strict=True)]
    one = np.ones_like(s)
    return s, gain * np.prod([s - z for z in pairs(zeros)] or [one], axis=0) / np.prod([s - p for p in pairs(poles)] or [one], axis=0)


def remove_response(df: DataFrame, output: str = "VEL", water_level: float = 60.0, inventory: DataFrame | None = None) -> DataFrame:
    """Spectral division by each receiver's response to velocity, down to a water level in dB; ``output``
    DISP or ACC integrates or differentiates once. Receivers without a response go."""
    power = {"DISP": -1, "VEL": 0, "ACC": 1}[output]

    def run(data: pd.Series, delta: pd.Series, response: pd.DataFrame) -> pd.Series:
        out = []
        for x, d, z, p, g in zip(data, delta, response["zeros"], response["poles"], response["gain"], strict=True):
            x = None if x is None else np.array(x, dtype=float)
            if x is None or not len(x) or np.isnan(x).any():
                out.append(None)
                continue
            s, h = _response(z, p, g, len(x), d)
            size = np.abs(h)
            floor = size.max() * 10 ** (-water_level / 20)
            h = np.where(size < floor, np.where(size > 0, h / np.where(size > 0, size, 1), 1) * floor, h)
            spec = np.fft.rfft(x) / h
            if power:
                turn = np.where(s == 0, 0, np.where(s == 0, 1, s) ** power)
                spec = spec * turn
            out.append(np.fft.irfft(spec, len(x)))
        return pd.Series(out)

    df = df if inventory is None or "response" in df.columns else attach_response(df, inventory)
    if "response" not in df.columns:
        raise ValueError("remove_response needs an inventory or attached responses")
    kernel = F.pandas_udf(run, "array<double>").asNondeterministic()
    return df.where("response is not null").withColumn("data", kernel("data", "delta", "response"))


def remove_sensitivity(df: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Samples over the gain of each receiver; receivers without one go."""
    df = df if inventory is None or "response" in df.columns else attach_response(df, inventory)
    if "response" not in df.columns:
        raise ValueError("remove_sensitivity needs an inventory or attached responses")
    return df.where("response.gain is not null").withColumn("data", waveforms.remove_sensitivity(F.col("data"), F.col("response.gain")))


def running_rms(df: DataFrame, window: float = 1.0) -> DataFrame:
    """rms of windows of ``window`` seconds that follow one another, at their centres; the last window
    may be short. The channel's band code becomes that of so slow a series."""
    n = F.round(F.lit(window) / F.col("delta")).cast("int")
    starts = F.sequence(F.lit(0), F.floor((F.col("npts") - 1) / n).cast("int"))
    x = F.transform(starts, lambda i: A.rms(F.slice("data", i * n + 1, n)))
    band = next((b for least, b in SLOW_BANDS if window >= least), None)
    parts = names.receiver_struct(F.col("receiver"))
    renamed = F.col("receiver") if band is None else F.when(parts.isNull(), F.col("receiver")).otherwise(F.concat_ws(".", parts["network"], parts["station"], parts["location"], F.concat(F.lit(band), F.substring(parts["channel"], 2, 2))))
    out = df.where("npts > 0").withColumn("data", x).withColumn("starttime", waveforms.after(F.col("starttime"), (n - 1) * F.col("delta") / 2))
    return out.withColumn("receiver", renamed).withColumn("delta", n * F.col("delta")).withColumn("npts", F.size("data"))


def filter_(df: DataFrame, type: str, freq: float | None = None, freqmin: float | None = None, freqmax: float | None = None, corners: int = 4, zerophase: bool = False) -> DataFrame:  # noqa: A002
    """Butterworth filter, designed for each sampling step among the rows."""
    edges = (freqmin, freqmax) if type == "bandpass" else freq

    def run(a: np.ndarray, delta: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        for d in np.unique(delta):
            sos = filters.butterworth(corners, edges, type, 1 / d)
            out[delta == d] = (filters.zero_phase if zerophase else filters.run)(sos, a[delta == d])
        return out

    return df.withColumn("data", unary_with(run, F.col("data"), F.col("delta")))


def interpolate(df: DataFrame, sampling_rate: float, method: str = "lanczos", a: int = 20) -> DataFrame:
    """Samples at another rate, by the Lanczos sum or straight lines."""

    def run(x: np.ndarray, delta: np.ndarray) -> list:
        one = lambda v, d: fourier.lanczos(v, sampling_rate * d, a) if method == "lanczos" else fourier.straight(v, sampling_rate * d)
        return [one(v, d) for v, d in zip(x, delta, strict=True)]

    if method not in ("lanczos", "linear"):
        raise ValueError(f"no such interpolation: {method}")
    return _data(df, unary_with(run, F.col("data"), F.col("delta")), F.lit(1.0 / sampling_rate))


def resample(df: DataFrame, sampling_rate: float) -> DataFrame:
    """Fourier resampling to another rate."""

    def run(x: np.ndarray, delta: np.ndarray) -> list:
        return [fourier.resample(v[None], int(round(len(v) * d * sampling_rate)))[0] for v, d in zip(x, delta, strict=True)]

    return _data(df, unary_with(run, F.col("data"), F.col("delta")), F.lit(1.0 / sampling_rate))


def decimate(df: DataFrame, factor: int, no_filter: bool = False) -> DataFrame:
    """Every ``factor``-th sample after a zero-phase low-pass at 0.8 of the new Nyquist."""
    if not no_filter and factor > 1:
        df = df.withColumn("data", transforms.filter(F.col("data"), 0.4 / factor, "lowpass", 1.0, 4))
    return _data(df, A.decimate(F.col("data"), factor), F.col("delta") * factor)


def detrend(df: DataFrame, type: str = "linear") -> DataFrame:  # noqa: A002
    steps = {"linear": A.detrend, "demean": A.demean, "constant": A.demean}
    return df.withColumn("data", steps[type](F.col("data")))


def taper(df: DataFrame, max_percentage: float | None = 0.5, type: str = "hann", max_length: float | None = None, side: str = "both") -> DataFrame:  # noqa: A002
    """Tapered ends: the shorter of a share and a length in seconds, a Hann (cosine) ramp or another."""
    n = F.col("npts")
    share = F.round(n * F.lit(0.5 if max_percentage is None else max_percentage))
    size = share if max_length is None else F.round(F.lit(max_length) / F.col("delta"))
    size = size if max_length is None or max_percentage is None else F.least(share, size)
    ramp = F.least(size.cast("int"), F.floor(n / 2).cast("int"))
    kind = "hann" if type == "cosine" else type
    return df.withColumn("_r", ramp).withColumn("data", F.transform("data", lambda v, i: v * A.window_value(i, n, F.col("_r"), side, kind))).drop("_r")


def normalize(df: DataFrame) -> DataFrame:
    """Over the largest absolute value."""
    return df.withColumn("data", A.normalize_max(F.col("data")))


@dataclass(frozen=True)
class Operation:
    run: Callable[..., DataFrame]
    inject: tuple[str, ...] = ()


OPERATIONS = {
    "merge": Operation(merge), "select": Operation(select), "trim": Operation(trim, ("starttime", "endtime")), "rotate": Operation(rotate, ("inventory",)),
    "attach_response": Operation(attach_response, ("inventory",)), "remove_response": Operation(remove_response, ("inventory",)),
    "remove_sensitivity": Operation(remove_sensitivity, ("inventory",)), "running_rms": Operation(running_rms), "filter": Operation(filter_),
    "interpolate": Operation(interpolate), "resample": Operation(resample), "decimate": Operation(decimate), "detrend": Operation(detrend), "demean": Operation(lambda df: detrend(df, "demean")),
    "taper": Operation(taper), "normalize": Operation(normalize),
}


def list_operations() -> list[str]:
    return sorted(OPERATIONS)


def is_operation(name) -> bool:
    return isinstance(name, str) and name in OPERATIONS


def help(name: str | None = None) -> str:  # noqa: A001
    """What operations do and which parameters are injected."""
    if name is not None and not is_operation(name):
        raise ValueError(f"no such operation: {name}")
    shown = [name] if name else list_operations()
    return "\n".join(f"{n}: {' '.join((OPERATIONS[n].run.__doc__ or n).split())} Injected: {', '.join(OPERATIONS[n].inject) or 'nothing'}." for n in shown)


def inject(name: str, parameters: dict, **dynamic) -> dict:
    """Parameters with those of ``dynamic`` that the operation takes and that are not given."""
    return {k: dynamic[k] for k in OPERATIONS[name].inject if dynamic.get(k) is not None} | parameters


def process(traces: DataFrame, operations: list, *, starttime: Column | None = None, endtime: Column | None = None, inventory: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``traces`` after the operations in order: (name, parameters), or any callable of a table."""
    for item in operations:
        if not isinstance(item, tuple | list) or len(item) != 2:
            message, fits = f"not a pair of a name and parameters: {item!r}", False
        else:
            fits = is_operation(item[0]) or callable(item[0])
            message = f"no such operation: {item[0]!r}"
        if not fits:
            if strict:
                raise ValueError(message)
            warnings.warn(f"skipped, {message}", UserWarning, stacklevel=2)
            continue
        name, parameters = item
        if callable(name):
            traces = name(traces, **parameters)
        else:
            traces = OPERATIONS[name].run(traces, **inject(name, parameters, starttime=starttime, endtime=endtime, inventory=inventory))
    return traces


def process_channels(traces: DataFrame, recipes: dict[str, list], *, starttime: Column | None = None, endtime: Column | None = None, inventory: DataFrame | None = None, substitute: bool = True) -> DataFrame:
    """Each channel's traces after its recipe.

    Gaps are closed first: by the recipe's own merge, else by straight lines. A channel that ends in R or T
    is made of its station's three components (``substitute``), which its recipe rotates; stations that
    lack one give nothing. Channels without a recipe are only merged.
    """
    close = ("merge", {"fill_value": "interpolate"})
    extras = _extras(traces)
    run = lambda rows, ops: process(rows, ops, starttime=starttime, endtime=endtime, inventory=inventory).select(*TRACE, *extras)
    channel = names.channel(F.col("receiver"))
    parts = []
    for c, ops in filter_operations(recipes).items() if "sha256_hash" in recipes else recipes.items():
        recipe = ops if any(op[0] == "merge" for op in ops if not callable(op)) else [close, *ops]
        if substitute and c[-1] in "RT":
            three = traces.where((F.substring(channel, 1, 2) == c[:2]) & F.right(channel, F.lit(1)).isin(*"12ZNE")).withColumn("_s", _stem())
            three = waveforms.three_components(three, ["_s", *extras], "receiver").drop("_s")
            parts.append(run(three, recipe).where(channel == c))
        else:
            parts.append(run(traces.where(channel == c), recipe))
    parts.append(run(traces.where(~channel.isin(list(recipes))) if recipes else traces, [close]))
    return reduce(DataFrame.unionByName, parts)


def filter_operations(recipes: dict) -> dict:
    """The recipes of SEED channels: three characters that begin with a band code."""
    return {c: ops for c, ops in recipes.items() if len(c) == 3 and c[0] in BAND_CODES}


def hash_operations(recipes: dict) -> dict:
    """Recipes of channels with the hash of their canonical JSON."""
    kept = filter_operations(recipes)
    return kept | {"sha256_hash": hashing.hash_object(kept)}


def check_operations_hash(recipes: dict) -> bool:
    if "sha256_hash" not in recipes:
        raise ValueError("the operations have no hash")
    return recipes["sha256_hash"] == hash_operations(recipes)["sha256_hash"]


def operations_to_json(recipes: dict) -> str:
    return json.dumps(hash_operations(recipes), sort_keys=True)


def operations_to_dict(text: str) -> dict:
    """Recipes from JSON; raises ValueError where their hash is not theirs."""
    recipes = json.loads(text)
    if not check_operations_hash(recipes):
        raise ValueError("the operations have another hash")
    return hash_operations(recipes)
