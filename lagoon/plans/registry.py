"""Registered queries of the time-series engine and the DuckDB SQL each is compared with."""

from __future__ import annotations

from lagoon.plans import oracles, queries_basic, queries_data, queries_spectral

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (queries_basic, queries_data, queries_spectral):
    QUERIES |= _module.Q.queries
    ORACLE |= _module.Q.oracle
ORACLE |= oracles.SQL
