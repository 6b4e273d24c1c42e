"""Content hashes: canonical JSON of metadata and operations, bytes of series."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(obj, ignore: tuple[str, ...] = ("sha256_hash", "sha256_hash_metadata")) -> str:
    """JSON with sorted keys and without the keys that hold hashes."""
    if isinstance(obj, dict):
        obj = {k: v for k, v in obj.items() if k not in ignore}
    return json.dumps(obj, sort_keys=True, separators=(",", ":"))


def hash_object(obj) -> str:
    return hashlib.sha256(canonical(obj).encode()).hexdigest()


def check_hash(obj: dict) -> bool:
    """Whether a dict's own ``sha256_hash`` is that of the rest."""
    return obj.get("sha256_hash") == hash_object(obj)


def hash_text_series(keys: list[Column], x: Column, digits: int = 6) -> Column:
    """SHA-256 of keys and samples written as whole units of the last digit; the same in any SQL."""
    units = F.transform(x, lambda v: F.round(v * 10**digits).cast("long").cast("string"))
    return F.sha2(F.concat_ws("|", *keys, F.concat_ws(",", units)), 256)


@F.pandas_udf(T.StringType())
def hash_bytes(x: pd.Series) -> pd.Series:
    """SHA-256 of a series' little-endian doubles."""
    return x.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest())


def row_digest(keys: list[Column], x: Column, digits: int = 6) -> Column:
    """The four parts of 15 hexadecimal digits of a row's ``hash_text_series``, as whole numbers."""
    h = hash_text_series(keys, x, digits)
    return F.array(*[F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)])


def hash_table(df: DataFrame, keys: list[str], x: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """(by, hash): SHA-256 of a stream or a whole table of series, whatever the order of its rows.

    Row hashes are summed part by part, which tasks do before anything is sent.
    """
    by = by or []
    rows = df.select(*by, row_digest([F.col(k).cast("string") for k in keys], F.col(x), digits).alias("_d"))
    sums = [F.sum(F.col("_d")[k]).cast("string") for k in range(4)]
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("hash"))
