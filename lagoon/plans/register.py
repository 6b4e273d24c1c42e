"""A decorator that collects queries, and the SQL fragments that oracles share."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, oracle: str | None = None, name: str | None = None):
        def add(fn):
            key = name or fn.__name__
            self.queries[key] = fn
            if oracle:
                self.oracle[key] = oracle
            return fn

        return add


#: e: hourly cells; g: dense grid of 720 hours
GRID = """e AS (SELECT event_type AS receiver, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 3600) AS INTEGER) AS h,
  round(sum(value), 2) AS v, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT DISTINCT receiver FROM e),
g AS (SELECT r.receiver, CAST(t.i AS INTEGER) AS h, coalesce(e.v, 0.0) AS v FROM r CROSS JOIN range(720) t(i) LEFT JOIN e ON e.receiver = r.receiver AND e.h = t.i)"""

#: cc: full correlations of all pairs
CROSS = GRID + """,
cc AS (SELECT a.receiver || '-' || b.receiver AS pair, a.h - b.h AS lag, sum(a.v * b.v) AS cc FROM g a JOIN g b ON a.receiver < b.receiver GROUP BY ALL)"""

#: v: elements of the embeddings as doubles
VECTORS = """v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"""
