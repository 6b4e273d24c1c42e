import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lagoon.llm import quality_rules as R


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(covered), failed


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n\x0b\x0c\r", "é", "\x1c\x85\xa0 x", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "#*$%&|<> € " * 9]
    for _ in range(150):
        vocab = [rng.choice(["the", "and", "été", "#tag", "la", "x", "日本"]) + str(rng.randrange(3)) * rng.randrange(2) for _ in range(rng.choice([2, 6, 60]))]
        body = "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\n", "\t", " "]) for _ in range(rng.randrange(90)))
        out.append(body + (body[:200] if rng.random() < 0.4 else ""))
    out.append(" ".join(f"w{i}" for i in range(50_000)) + " w1 w2 w3 w4 w5 w6 w7 w8")
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(-1)).repartition(4)
    got = {r.doc_id: tuple(r)[1:7] for r in R.report(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    for r in R.report(df).where("base_failed and kept").collect():
        raise AssertionError(r)


def test_rules_and_plan(spark):
    clean = "The house stands at the end of the road and it is old but not empty for the family that lives there"
    rows = [(1, clean, "k"), (2, "### " * 30, "k"), (3, clean.replace(" ", " # "), "k"), (4, None, "k"), (5, clean, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("_m", F.lit(7))
    out = R.apply_rules(df)
    assert out.columns == df.columns and {r._m for r in out.collect()} == {7} and {r.doc_id for r in out.collect()} == {1, 5}
    plan = R.report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert R.report(df.limit(0)).count() == 0 and R.apply_rules(df.limit(0)).count() == 0
    custom = R.with_metrics(df).where(R.compile_rules([("n_words", 1, 29, 0)])).select("doc_id")
    assert {r.doc_id for r in custom.collect()} == {1, 5}


def test_sql_says_the_same(spark):
    """Every column, the method's verdict too, against plain SQL on rows at the edges of the rules."""
    import duckdb
    import pandas as pd

    rng = random.Random(31)
    rows = [(0, None), (1, ""), (2, " \n\t\x0b\x0c\r ")]
    for i in range(3, 400):
        n = rng.choice([0, 5, 19, 20, 21, 49, 50, 51, 120])
        pool = rng.choice([["the", "a1", "word", "of"], ["zz", "qq", "xx#"], ["#", "$$", "the"], ["Más", "también", "über", "…"], ["x" * 30, "y" * 25], ["i", "b"]])
        w = [rng.choice(pool) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(n)]
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "\n- ", "\n* ", "...\n", "… \n", "\t", " "]) for x in w)
        rows.append((i, text + (" " + text if rng.random() < 0.2 else "")))
    rows += [rows[-1], (None, "no id " * 30)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.sql(R.REPORT_SQL)
    got = R.report(spark.createDataFrame(rows, "doc_id long, text string")).select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)
    assert {r.kept for r in got} == {True, False} and any(not r.kept and not r.base_failed for r in got)
