from pyspark.sql import functions as F

from lagoon.streaming import ingest


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = [("A", f"2024-01-0{d} {h:02d}:00:00", float(h)) for d in (1, 2, 3) for h in range(24)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "receiver string, t string, value double").select("receiver", F.to_timestamp("t").alias("ts"), "value").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for name, df in (("win", ingest.window_state(stream, expected=24)), ("ses", ingest.trigger_sessions(stream, 20.0, "90 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    wins = spark.table("win").collect()
    assert len(wins) >= 2 and all(r.n == 24 and r.complete for r in wins)
    ses = spark.table("ses").collect()
    assert len(ses) >= 2 and all((r.n, r.peak) == (4, 23.0) for r in ses)
