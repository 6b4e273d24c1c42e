"""Arrow-batched application of NumPy kernels to array columns.

Rows of equal length are stacked, so that a kernel runs once for many rows. A row with a NULL series or
a NULL or NaN sample gives NULL: a transform needs every sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _complete(v) -> np.ndarray | None:
    if v is None:
        return None
    a = np.asarray(v, dtype=object if isinstance(v, list) and any(x is None for x in v) else float)
    if a.dtype == object or not len(a) or np.isnan(a).any():
        return None
    return a


def stacked(fn: Callable, columns: list[pd.Series], scalars: list[pd.Series]) -> pd.Series:
    n = len(columns[0])
    rows = [[_complete(c.iloc[i]) for c in columns] for i in range(n)]
    out: list = [None] * n
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, r in enumerate(rows):
        known = all(x is not None for x in r) and not any(pd.isna(s.iloc[i]) for s in scalars)
        if known:
            groups.setdefault(tuple(len(x) for x in r), []).append(i)
    for at in groups.values():
        args = [np.stack([rows[i][k] for i in at]) for k in range(len(columns))]
        got = fn(*args, *[s.iloc[at].to_numpy(dtype=float) for s in scalars])
        for i, v in zip(at, got, strict=True):
            out[i] = v
    return pd.Series(out)


def _opaque(run, returns: str):
    """A kernel that Catalyst neither repeats nor moves into filters and lambdas, as it could a cheap
    expression: kernels are the costly part of a plan and run once where they stand."""
    return F.pandas_udf(run, returns).asNondeterministic()


# Kernels name their series twice: a column that is read twice stays a projection of its own, so that
# native steps before a kernel are evaluated once and are not folded into the kernel's arguments.
# Equal arguments travel to Python once. A kernel's input must be a column, not a longer expression.


def unary(fn: Callable, x: Column, returns: str = "array<double>") -> Column:
    def run(a: pd.Series, _: pd.Series) -> pd.Series:
        return stacked(fn, [a], [])

    return _opaque(run, returns)(x, x)


def unary_with(fn: Callable, x: Column, scalar: Column, returns: str = "array<double>") -> Column:
    def run(a: pd.Series, s: pd.Series, _: pd.Series) -> pd.Series:
        return stacked(fn, [a], [s])

    return _opaque(run, returns)(x, scalar, x)


def binary(fn: Callable, x: Column, y: Column, returns: str = "array<double>") -> Column:
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return stacked(fn, [a, b], [])

    return _opaque(run, returns)(x, y, x, y)


def table_kernel(fn: Callable[[dict], Iterable[dict]]):
    """A ``mapInPandas`` function from a function of one row to rows."""

    def run(frames):
        for frame in frames:
            out = [r for row in frame.to_dict("records") for r in fn(row)]
            if out:
                yield pd.DataFrame(out)

    return run
