"""Command line: ``python -m lagoon.cli snr|ct|psd|plmax|timelapse|swresp|beamform|list --xc PATH ... --out PATH``,
or ``run --config FILE``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.functions import names, times
from lagoon.operators import correlate, matrix
from lagoon.plans import pipelines, production
from lagoon.sources import client, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lagoon")
    p.add_argument("command", choices=["run", "list", "snr", "ct", "psd", "plmax", "timelapse", "swresp", "beamform"])
    p.add_argument("--config", help="run: JSON file that says what to correlate")
    p.add_argument("--xc", nargs="+", default=[], help="stored correlation tables (for ct: a table of ratios)")
    p.add_argument("--out", help="folder of the result")
    p.add_argument("--pair", default="%", help="LIKE pattern of pairs")
    p.add_argument("--start", help="first time, included")
    p.add_argument("--end", help="last time, excluded")
    p.add_argument("--first", type=float, default=0.0, help="coordinate of a series' first element")
    p.add_argument("--delta", type=float, default=1.0)
    p.add_argument("--signal", type=float, nargs=2, default=(0.0, 1.0))
    p.add_argument("--noise", type=float, nargs=2, default=(1.0, 2.0))
    p.add_argument("--envelope", action="store_true")
    p.add_argument("--threshold", type=float, default=10.0)
    p.add_argument("--coincidence", type=int, default=2)
    p.add_argument("--step", type=float, default=10800.0, help="seconds between windows")
    p.add_argument("--extend", type=int, default=0)
    p.add_argument("--duration", type=float, default=2.5)
    p.add_argument("--freq-max", type=float, default=20.0)
    p.add_argument("--distance", type=int, default=25)
    p.add_argument("--threshold-rel", type=float, default=0.01)
    p.add_argument("--bands", nargs="+", default=["3,6", "6,12"], help="frequency bands low,high")
    p.add_argument("--update", action="store_true", help="timelapse: keep what --out has")
    p.add_argument("--geometry", help="beamform: table (receiver, x, y) in metres")
    p.add_argument("--debug", action="store_true")
    return p


def _load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    xc = store.mfread(spark, a.xc)
    if xc is None:
        raise SystemExit("no valid table")
    xc = xc.where(F.col("pair").like(a.pair) & (F.col("status") == 1))
    if a.start:
        xc = xc.where(F.col("time") >= F.lit(a.start).cast("timestamp_ntz"))
    return xc.where(F.col("time") < F.lit(a.end).cast("timestamp_ntz")) if a.end else xc


def compute(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "ct":
        ratios = spark.read.parquet(*a.xc)
        # times on a regular axis of --step seconds as whole steps
        ratios = ratios.withColumn("step", F.round(times.seconds(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("time")) / a.step).cast("long"))
        trigs, _ = pipelines.ct(ratios, "pair", "step", thr_on=a.threshold, coincidence=a.coincidence, extend=a.extend)
        return trigs
    xc = _load(spark, a)
    if a.command == "list":
        return client.discover_pairs(xc, a.pair)
    if a.command == "snr":
        return pipelines.snr(xc, ["pair", "time"], first=a.first, delta=a.delta, signal=tuple(a.signal), noise=tuple(a.noise), envelope=a.envelope)
    if a.command == "beamform":
        couples = matrix.couples(spark.read.parquet(a.geometry), "receiver", "x", "y")
        ends = names.split_pair(F.col("pair"))
        shifts = xc.select("time", ends[0].alias("rx_a"), ends[1].alias("rx_b"), correlate.shift(F.col("cc").cast("array<double>"), a.delta).alias("tau"))
        return pipelines.beamform(shifts, couples, "time", couples.count())
    if a.command == "swresp":
        two = xc.groupBy("time").agg(F.sort_array(F.collect_list(F.struct("pair", "cc"))).alias("p")).where(F.size("p") == 2)
        return pipelines.swresp(two.select("time", F.col("p")[0]["cc"].cast("array<double>").alias("x"), F.col("p")[1]["cc"].cast("array<double>").alias("y")), ["time"], "x", "y", a.delta)
    spec = pipelines.psd(xc, ["pair", "time"], delta=a.delta, duration=a.duration, freq_max=a.freq_max)
    if a.command == "psd":
        return spec
    if a.command == "plmax":
        return pipelines.plmax(spec, ["pair", "time"], distance=a.distance, threshold_rel=a.threshold_rel)
    bands = [tuple(float(x) for x in b.split(",")) for b in a.bands]
    old = spark.read.parquet(a.out) if a.update else None
    return pipelines.timelapse(spec, "pair", "time", bands, done=old)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"lagoon-{a.command}").getOrCreate()
    spark.sparkContext.setLogLevel("DEBUG" if a.debug else "WARN")
    if a.command == "run":
        print(production.run_file(spark, a.config))
        return
    if not a.xc:
        raise SystemExit("--xc names no table")
    out = compute(spark, a)
    if a.out:
        out.write.mode("append" if a.update else "overwrite").parquet(a.out)
    else:
        out.show(truncate=False)


if __name__ == "__main__":
    main()
