"""A run by configuration, from traces with gaps to a stored table."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon import cli
from lagoon.kernels import filters
from lagoon.plans import production
from lagoon.sources import operations, store

T0 = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two receivers at 2 Hz for 400 s in traces of 100 s, one with gaps, and a second table that fills one."""
    rng = np.random.default_rng(8)
    data = {r: rng.normal(size=800).round(3) for r in ("X.A..BHZ", "X.B..BHZ")}
    rows = [(r, k, v[k : k + 200].tolist()) for r, v in data.items() for k in range(0, 800, 200)]
    rows = [(r, k, x[:150] if (r, k) == ("X.A..BHZ", 200) else x) for r, k, x in rows]
    path = str(tmp_path_factory.mktemp("traces"))
    start = F.timestamp_add("MICROSECOND", (F.col("k") * 500_000).cast("long"), F.expr(f"timestamp_ntz'{T0}'"))
    df = spark.createDataFrame(rows, "receiver string, k int, data array<double>").select("receiver", start.alias("starttime"), F.lit(0.5).alias("delta"), F.size("data").alias("npts"), "data")
    df.write.parquet(f"{path}/t")
    return path, data


def config(path, out, **more):
    base = {
        "traces": [f"{path}/t"], "pairs": ["X.A..BHZ-X.B..BHZ"], "origin": T0, "window": 100.0, "step": 50.0, "count": 7, "rate": 2.0, "max_lag": 10.0, "max_gap": 5.0, "out": out,
        "operations": {"BHZ": [["detrend", {"type": "demean"}], ["filter", {"type": "highpass", "freq": 0.1}], ["trim", {}], ["taper", {"type": "cosine", "max_percentage": 0.1}]]},
        "attributes": {"title": "t", "institution": "i", "author": "a", "source": "s"},
    }
    return base | more


def test_windows_pass_their_recipe(spark, tables):
    path, data = tables
    c = config(path, "")
    got = {(r.receiver, r.start): r for r in production.preprocess(spark.read.parquet(f"{path}/t"), c["operations"], origin=T0, window=100.0, step=50.0, count=7, rate=2.0, max_gap=5.0).collect()}
    assert {k for k in got if k[0] == "X.B..BHZ"} == {("X.B..BHZ", k) for k in range(7)}
    assert {k for r, k in got if r == "X.A..BHZ"} == {0, 1, 4, 5, 6}  # windows 2 and 3 lack 25 s
    for (r, k), row in got.items():
        lo, hi = max(0, 100 * k - 10), min(800, 100 * k + 211)  # wider by 5 per cent of the window
        if r == "X.A..BHZ" and lo < 400 and hi > 350:
            continue  # the buffer meets the gap, which a line closes
        x = data[r][lo:hi]
        y = filters.run(filters.butterworth(4, 0.1, "highpass", 2.0), (x - x.mean())[None])[0][100 * k - lo : 100 * k - lo + 201]
        n = len(y)
        ramp = round(n * 0.1)
        w = np.ones(n)
        w[:ramp] = 0.5 - 0.5 * np.cos(np.pi * np.arange(ramp) / ramp)
        w[n - ramp :] = 0.5 - 0.5 * np.cos(np.pi * np.arange(ramp, 0, -1) / ramp)
        assert row.complete and np.allclose(row.x, (y * w)[:200])


def test_run_by_configuration(spark, tables, tmp_path):
    path, _ = tables
    c = config(path, str(tmp_path / "xc"))
    file = tmp_path / "c.json"
    file.write_text(json.dumps(c | {"operations": operations.hash_operations(c["operations"])}))
    cli.main(["run", "--config", str(file)], spark)
    assert production.run(spark, c) == {"planned": 7, "new": 0, "done": 5, "missing": 2}
    t = store.mfread(spark, [c["out"]])
    assert sorted(str(r.time) for r in t.where("status = 1").collect()) == [f"2024-01-01 00:0{m}" for m in ("0:50", "1:40", "4:10", "5:00", "5:50")]
    assert all(len(r.cc) == 41 and max(abs(v) for v in r.cc) <= 1 for r in t.where("status = 1").collect())
    meta = store.read_metadata(spark, c["out"])
    assert store.validate(meta, preprocess_hash=operations.hash_operations(c["operations"])["sha256_hash"])
    with pytest.raises(ValueError, match="metadata"):
        production.run(spark, c | {"attributes": c["attributes"] | {"title": "other"}, "retry_missing": True})
    with pytest.raises(ValueError, match="hash"):
        production.run(spark, c | {"operations": c["operations"] | {"sha256_hash": "0"}})


def test_later_tables_fill_days(spark, tables, tmp_path):
    """A second table gives the days that the first does not have."""
    path, _ = tables
    t = spark.read.parquet(f"{path}/t")
    t.where("receiver = 'X.A..BHZ'").write.parquet(str(tmp_path / "a"))
    c = config(path, str(tmp_path / "xc"), traces=[str(tmp_path / "a"), f"{path}/t"])
    assert production.run(spark, c) == {"planned": 7, "new": 7, "done": 5, "missing": 2}
