import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lagoon.llm import warc as W


def expect(rows, min_bytes=0):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    first, out = {}, []
    for i, _, html in order:
        raw = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if len(raw) >= min_bytes and raw in first:
            out.append((i, len(raw), d, "revisit", first[raw]))
        else:
            if i is not None:
                first.setdefault(raw, i)
            out.append((i, len(raw), d, "response", None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(4)
    bodies = ["", None, "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "same"] + [f"<p>{rng.random()}</p>" * rng.randrange(1, 900) for _ in range(60)]
    return [(i * 3 - 50, rng.choice([None, "http://a.example/é x\r\ny", f"http://b.example/{i}"]), rng.choice(bodies)) for i in range(200)]


@pytest.mark.parametrize("min_bytes", [0, 1000])
def test_round_trip(spark, min_bytes):
    rows = pages() + [(None, "http://n.example", "only one"), (2**63 - 1, "u", "same"), (-(2**63), "v", "big")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(4)
    got = W.round_trip(df, min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expect(rows, min_bytes)


def test_archives_are_whole_and_split(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    manifest = W.write(df, folder, archive_bytes=20_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r.page_id: r for r in W.read(manifest, folder, with_payload=True).collect()}
    for i, _, html in rows:
        r = got[i] if got[i].record_type == "response" else got[got[i].refers_to]
        assert bytes(r.payload) == (html or "").encode()
    for f in (tmp_path / "w").iterdir():
        assert gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") >= 1


def test_reader_verifies():
    good = W.member(1, "http://a", b"hello", 5, W.base32(hashlib.sha1(b"hello").digest()), None)
    assert [r["page_id"] for r in W.read_records(io.BytesIO(good * 3))] == [1, 1, 1]
    plain = gzip.decompress(good)
    for wrong in (good[:-3], gzip.compress(plain.replace(b"hello", b"jello")), gzip.compress(plain[:-6]), gzip.compress(plain + b"x"), gzip.compress(plain.replace(b"WARC/1.1", b"HTTP/1.1")),
                  W.member(1, "http://a", b"hello", 5, W.base32(hashlib.sha1(b"other").digest()), None)):
        with pytest.raises((ValueError, zlib_error())):
            list(W.read_records(io.BytesIO(wrong)))
    for page in (None, 0, 5, -7, 2**63 - 1, -(2**63)):
        assert W.page_of(W.record_id(page)) == page


def zlib_error():
    import zlib

    return zlib.error


def test_repeated_ids_and_empty(spark):
    rows = [(1, "b", "x"), (1, "a", "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in W.round_trip(df).collect())
    assert got == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
    assert W.round_trip(df.limit(0)).count() == 0


def test_folder_uris(spark, tmp_path):
    from lagoon.llm.common import arrow_uri

    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "page_id long, url string, html string")
    for k, folder in enumerate((f"{tmp_path}/a", f"file:{tmp_path}/b", f"file://{tmp_path}/c")):
        manifest = W.write(df, folder)
        assert W.read(manifest, folder).count() == 3 and (tmp_path / "abc"[k]).is_dir()
    assert arrow_uri(spark, "s3a://bucket/a/b") == "s3://bucket/a/b" and arrow_uri(spark, "hdfs://host:8020/x") == "hdfs://host:8020/x"
    with pytest.raises(ValueError, match="no file system"):
        arrow_uri(spark, "ftp://host/x")


def test_folder_is_removed(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("warc-*"))
    assert W.round_trip(spark.createDataFrame(pages(), "page_id long, url string, html string")).count() == 200
    assert set(shared.glob("warc-*")) == before


def test_groups_beyond_the_broadcast_bound(spark, tmp_path):
    rows = pages() + [(None, None, "lone ids"), (None, "u", "lone ids")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = W.write(df, str(tmp_path), most_broadcast=3)
    got = W.read(manifest, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expect(rows)


def test_sql_agrees_on_repeated_ids(spark):
    import duckdb

    rows = [(1, "b", "x"), (1, "a", "x"), (1, "a", "x"), (2, None, "x"), (2, None, "z"), (2, "q", "z"), (None, "u", "n"), (None, None, "n"), (None, "k", "z"), (5, "k", None), (6, "k", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = con.sql(W.REPORT_SQL)
    got = [tuple(r) for r in W.report(df).select(*want.columns).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        W.report(spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string"))


def test_bloom_filter_lets_members_through(spark):
    import numpy as np

    from lagoon.llm.common import bloom

    members = spark.range(5000).select(F.xxhash64("id").alias("h"))
    may = bloom(members, 5000)
    inside = np.array([r.h for r in members.collect()])
    outside = np.array([r.h for r in spark.range(10**6, 10**6 + 20000).select(F.xxhash64("id").alias("h")).collect()])
    assert may(inside).all() and may(outside).mean() < 0.02
    assert not bloom(members.limit(0), 0)(inside).any()
