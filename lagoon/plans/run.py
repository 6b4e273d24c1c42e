"""A whole correlation run: plan, gate, skip what is stored, process, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.plans import correlation
from lagoon.sources import store, waveforms


def run(
    grid: DataFrame, receiver: str, path: str, metadata: dict, *, first: int, last: int, window: int, step: int, origin: str, step_seconds: float = 3600.0,
    clip: tuple[int, int] | None = None, status: DataFrame | None = None, day_steps: int = 24, retry_missing: bool = False, test_run: bool = False,
) -> dict[str, int]:
    """Processes the windows that the table at ``path`` does not have yet and appends them.

    ``grid``: dense samples (receiver, t, v) with NULL gaps. ``status``: availability (receiver, day,
    status) that gates windows on days when all receivers are there. One job over all pairs and windows;
    ``test_run`` processes the first window to do and stores nothing;
    returns the numbers of planned and new windows, and of done and missing ones in the table.
    """
    spark = grid.sparkSession
    plan = correlation.init(grid, receiver, first, last, window, step)
    if status is not None:
        day = F.floor(F.col("time") / day_steps).cast("int")
        reach = -(-window // (2 * day_steps))
        n = status.select(receiver).distinct().count()
        ready = waveforms.gating(plan.select(day.alias("time")).distinct(), status, "day", receiver, n, reach, reach + window // day_steps)
        plan = plan.join(ready.select(F.col("time").alias("_d")), day == F.col("_d"), "left_semi")
    stamp = waveforms.after(F.expr(f"timestamp_ntz'{origin}'"), F.col("time") * step_seconds)
    todo = plan.withColumn("stamp", stamp)
    planned = todo.count()
    if store.exists(spark, path):
        have = store.merge([store.read(spark, path)])
        settled = have.where("status = 1") if retry_missing else have.where("status <> 0")
        todo = todo.join(settled.select("pair", F.col("time").alias("stamp")), ["pair", "stamp"], "left_anti")
    if test_run:
        todo = todo.orderBy("time", "pair").limit(1)
    wins = correlation.windows(grid, receiver, "t", "v", first, last, window, step)
    done = correlation.process(todo, wins, receiver, window, clip).withColumn("time", stamp).select("pair", "time", "status", "cc")
    new = todo.count()
    if test_run:
        tried = done.groupBy("status").agg(F.count("*").alias("n")).collect()
        return {"planned": planned, "new": new, "done": sum(r.n for r in tried if r.status == 1), "missing": sum(r.n for r in tried if r.status == -1)}
    if new:
        store.append(done, path, metadata)
    counts = {r.status: r.n for r in store.merge([store.read(spark, path)]).groupBy("status").agg(F.count("*").alias("n")).collect()} if store.exists(spark, path) else {}
    return {"planned": planned, "new": new, "done": counts.get(1, 0), "missing": counts.get(-1, 0)}
