"""Series made of the test tables: hourly event values as traces, embeddings as ready series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.functions import names, times
from lagoon.operators import correlate

ORIGIN = "2024-01-01 00:00:00"
HOURS = 720
HOUR = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receiver, h, v, n): the value and number of events of a type in an hour."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("receiver"), times.hour_number(F.col("ts"), ORIGIN).alias("h"), "value")
    return e.groupBy("receiver", "h").agg(F.round(F.sum("value"), 2).alias("v"), F.count("*").alias("n"))


def grid(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    c = cells(spark, sf_dir)
    return correlate.dense_grid(c, c, "receiver", "h", HOURS, "v", fill)


def series(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """(receiver, x) of HOURS samples."""
    return correlate.to_series(grid(spark, sf_dir, fill), ["receiver"], "h", "v")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x) of doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next of its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = vectors(spark, sf_dir)
    return v.select("vec_id", "x", F.lead("vec_id").over(w).alias("next_id"), F.lead("x").over(w).alias("y")).where("next_id is not null")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with events, one trace a run."""
    c = cells(spark, sf_dir)
    run = F.col("h") - F.row_number().over(Window.partitionBy("receiver").orderBy("h"))
    parts = c.withColumn("_g", run).groupBy("receiver", "_g").agg(F.min("h").alias("h0"), F.count("*").cast("int").alias("npts"), F.sort_array(F.collect_list(F.struct("h", "v"))).alias("_p"))
    start = F.timestamp_add("HOUR", F.col("h0"), F.expr(f"timestamp_ntz'{ORIGIN}'"))
    return parts.select("receiver", start.alias("starttime"), F.lit(HOUR).alias("delta"), "npts", F.transform("_p", lambda p: p["v"]).alias("data"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receiver, latitude, longitude) of the nations, by arithmetic on their keys."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("receiver"), (F.col("n_nationkey") * 5.0 - 60).alias("latitude"), (F.col("n_nationkey") * 13.0 - 150).alias("longitude"))


def cross(spark: SparkSession, sf_dir: str, normalize: bool = False) -> DataFrame:
    """(pair, cc) of all pairs of hourly series, all lags."""
    p = correlate.pair_up(series(spark, sf_dir))
    return p.select("pair", correlate.cc(F.col("xa"), F.col("xb"), normalize).alias("cc"))


def station_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stations(spark, sf_dir)
    a = s.select(F.col("receiver").alias("rx_a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"))
    b = s.select(F.col("receiver").alias("rx_b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"))
    return a.join(b, F.col("rx_a") < F.col("rx_b")).withColumn("pair", names.pair(F.col("rx_a"), F.col("rx_b")))
