"""Correlation runs from traces to a stored table by a configuration, all windows at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.functions import metadata, names, times
from lagoon.plans import correlation
from lagoon.sources import operations, store, waveforms

#: what a configuration may say, with what stands where it does not
DEFAULTS = {"step": None, "max_lag": None, "max_gap": 300.0, "buffer": 0.05, "normalize": True, "operations": {}, "inventory": None, "attributes": {}, "retry_missing": False, "parts": 1}


def window_start(origin: str, step: float):
    """The time of window number ``start``."""
    return waveforms.after(F.expr(f"timestamp_ntz'{origin}'"), F.col("start") * F.lit(float(step)))


def preprocess(traces: DataFrame, recipes: dict, *, origin: str, window: float, step: float, count: int, rate: float, max_gap: float = 300.0, buffer: float = 0.05, inventory: DataFrame | None = None) -> DataFrame:
    """(receiver, start, x, complete): windows ``start`` * ``step`` seconds after ``origin`` after the recipes of
    their channels, each of window * rate samples.

    A trace meets each window that it overlaps as one slice, wider by ``buffer`` of the window on both sides
    for the ends of filters. Windows that lack more than ``max_gap`` seconds are left out, and so are those
    that a recipe leaves at another rate or short.
    """
    zero = F.expr(f"timestamp_ntz'{origin}'")
    first = times.seconds(zero, F.col("starttime"))
    last = first + (F.col("npts") - 1) * F.col("delta")
    extra = buffer * window
    low = F.greatest(F.lit(0), F.ceil((first - window - extra) / step)).cast("int")
    high = F.least(F.lit(count - 1), F.floor((last + extra) / step)).cast("int")
    met = traces.select(*operations.TRACE).where("npts > 0").withColumn("_a", low).withColumn("_b", high).where("_a <= _b").withColumn("start", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    begin = window_start(origin, step)
    end = waveforms.after(begin, F.lit(float(window)))
    cut = waveforms.get_waveforms(met, "%", begin, end, buffer, keep=["start"])
    inside = F.greatest(F.lit(0.0), F.least(times.seconds(begin, F.col("starttime")) + F.col("npts") * F.col("delta"), F.lit(float(window))) - F.greatest(times.seconds(begin, F.col("starttime")), F.lit(0.0)))
    whole = cut.withColumn("_s", F.sum(inside).over(Window.partitionBy("receiver", "start"))).where(F.col("_s") >= window - max_gap).drop("_s")
    done = operations.process_channels(whole, recipes, starttime=begin, endtime=end, inventory=inventory)
    done = operations.trim(done, begin, end)
    n = round(window * rate)
    fits = (F.abs(F.col("delta") * rate - 1) < 1e-9) & (F.col("npts") >= n)
    x = F.slice("data", 1, n)
    return done.where(fits).select("receiver", "start", x.alias("x"), (F.size(F.array_compact(x)) == n).alias("complete"))


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Correlates pairs over windows as ``config`` says and appends what the table at ``out`` lacks.

    traces: paths of trace tables, in order of priority; pairs: names ``A-B``; origin, count, window, step,
    max_lag: timestamp, number of windows, seconds; rate: samples a second; operations: recipes by channel;
    inventory: path of a table; attributes: title, institution, author and source at least; out: path.
    """
    c = DEFAULTS | config
    step = c["step"] or c["window"]
    recipes = operations.filter_operations(c["operations"])
    if "sha256_hash" in c["operations"] and not operations.check_operations_hash(c["operations"]):
        raise ValueError("the operations have another hash")
    n = round(c["window"] * c["rate"])
    lags = n - 1 if c["max_lag"] is None else min(n - 1, round(c["max_lag"] * c["rate"]))
    parts = [spark.read.parquet(p).select(*operations.TRACE) for p in c["traces"]]
    days = [waveforms.slice_days(t, 0.0).groupBy("receiver", "day").agg(F.lit(i).alias("i")) for i, t in enumerate(parts)]
    traces = parts[0]
    for t, above in zip(parts[1:], days[:-1], strict=True):  # days that a table before has are not read from a later one
        mine = t.withColumn("day", F.to_date("starttime"))
        traces = traces.unionByName(mine.join(above.select("receiver", "day"), ["receiver", "day"], "left_anti").select(*operations.TRACE))
    ends = names.split_pair(F.col("pair"))
    pairs = spark.createDataFrame([(p,) for p in c["pairs"]], "pair string").select("pair", ends[0].alias("rx_a"), ends[1].alias("rx_b"))
    plan = pairs.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(c["count"] - 1)))).withColumn("time", waveforms.after(window_start(c["origin"], step), F.lit(c["window"] / 2)))
    attributes = metadata.global_attrs(c["attributes"])
    # the history says when a run was made, so it is no part of what tables must share
    meta = {k: v for k, v in attributes.items() if k != "history"} | {"preprocess": operations.operations_to_json(recipes), "window": c["window"], "step": step, "rate": c["rate"], "lags": lags}
    todo, planned = plan, len(c["pairs"]) * c["count"]
    if store.exists(spark, c["out"]):
        have = store.merge([spark.read.parquet(f"{c['out']}/xc")])
        todo = correlation.retry(have, plan, c["retry_missing"])
    new = todo.count()
    if new:
        inventory = spark.read.parquet(c["inventory"]) if c["inventory"] else None
        wins = preprocess(traces, recipes, origin=c["origin"], window=c["window"], step=step, count=c["count"], rate=c["rate"], max_gap=c["max_gap"], buffer=c["buffer"], inventory=inventory)
        done = correlation.process(todo, wins, "receiver", n, (-lags, lags), c["normalize"], c["parts"])
        store.append(done.select("pair", "time", "status", "cc"), c["out"], meta)
    counts = {r.status: r.n for r in store.merge([spark.read.parquet(f"{c['out']}/xc")]).groupBy("status").agg(F.count("*").alias("n")).collect()} if store.exists(spark, c["out"]) else {}
    return {"planned": planned, "new": new, "done": counts.get(1, 0), "missing": counts.get(-1, 0)}


def run_file(spark: SparkSession, path: str) -> dict[str, int]:
    """``run`` with a configuration in a JSON file."""
    with open(path) as f:
        return run(spark, json.load(f))
