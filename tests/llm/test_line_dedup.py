import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lagoon.llm import line_dedup as L


def brute(rows, max_ratio, min_pages):
    pages, total = Counter(), Counter()
    key = lambda line: line.strip(" \t\r")
    for _, host, text in rows:
        total[host] += 1
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            pages[host, k] += 1
    bad = defaultdict(set)
    for (host, k), n in pages.items():
        if n >= min_pages and n > max_ratio * total[host]:
            bad[host].add(k)
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, host, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if key(x) not in bad[host]]
        out.append((i, host, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        host = rng.choice(["hot"] * 4 + ["a", "b", None])
        lines = [rng.choice(["Menu ", "\tMenu", "Footer é", "", "  ", f"own {i} {rng.random()}", "some\r"]) for _ in range(rng.randrange(0, 9))]
        rows.append((i, host, rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(lines)))
    rows += [(7, "hot", "Menu\nx"), (7, "hot", "Menu\nx"), (None, "hot", "Menu"), (900, "solo", "Menu\n" * 3), (901, "hot", "\n".join(f"l{k}" for k in range(30000)))]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    key = lambda r: tuple(str(x) for x in r)
    expect = sorted(brute(rows, L.MAX_RATIO, L.MIN_PAGES), key=key)
    assert sorted((tuple(r) for r in L.report(df).collect()), key=key) == expect
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in L.report(df).collect()), key=key) == expect
    strict = sorted(brute(rows, 0.02, 2), key=key)
    got = L.dedup_lines(df, max_ratio=0.02, min_pages=2, counts=True).select("doc_id", "source", "n_lines", "n_dropped", "text")
    assert sorted((tuple(r) for r in got.collect()), key=key) == strict


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "s", "x", 2)], "doc_id long, source string, text string, _b int").withColumn("n_lines", F.lit(1))
    clash = df.withColumn("_bh", F.lit(3)).withColumn("_new", F.lit(4)).withColumn("_h", F.lit(5))
    assert L.dedup_lines(clash).collect() == clash.collect() and L.dedup_lines(clash).columns == clash.columns
    assert L.dedup_lines(df.limit(0).drop("_b")).count() == 0
    plan = L.dedup_lines(df.drop("_b"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_lists_of_boilerplate(spark):
    """Ten thousand lines of a host, a thousand on each page: looked up by hash, not one by one."""
    import time

    rng = random.Random(5)
    rows = [(i, "site", "\n".join([*(f"line {k}" for k in rng.sample(range(10_000), 1000)), f"own {i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    began = time.perf_counter()
    got = L.dedup_lines(df, max_ratio=0.02, min_pages=2, counts=True).select("doc_id", "source", "n_lines", "n_dropped", "text").collect()
    assert time.perf_counter() - began < 45
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, 0.02, 2))


def test_url_host(spark):
    urls = ["http://A.Example/x", "https://u:p@b.org:8080/?q#f", "ftp://c", "no url", "", None, "http:///x", "HTTP://[::1]/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.h for r in df.select(L.url_host(F.col("url")).alias("h")).collect()]
    assert got[:7] == ["a.example", "b.org", "c", None, None, None, None]
