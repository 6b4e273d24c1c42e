import random
import re

import pytest
from pyspark.sql import functions as F

from lagoon.llm import near_dedup as N


def brute(rows, shingle, percent):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall("[^\x20\x09-\x0d]+", t)

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i * 7 + 3, " ".join(w)))
        else:
            rows.append((i * 7 + 3, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 30, 90])))))
    return rows


@pytest.mark.parametrize("shingle,percent,block", [(3, 85, 2048), (5, 80, 2048), (3, 85, 8)])
def test_equals_brute_force(spark, shingle, percent, block):
    rows = corpus(shingle + block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.classes(df, shingle=shingle, percent=percent, block=block, set_block=block * 700).collect()
    assert {tuple(r) for r in got} == brute(rows, shingle, percent)
    assert len(got) == len(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "  \n", None), (4, "One two", "c"), (5, "one TWO", "c"), (None, "one two", "d"), (6, long, "e"), (7, long, "e"), (7, long, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.report(df, shingle=3, percent=85).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (6, 29998, 6, True), (7, 29998, 6, False)}
    df = df.withColumn("_dropped_id", df.doc_id)
    kept = N.dedup(df, shingle=3, percent=85)
    assert kept.columns == ["doc_id", "text", "root", "_dropped_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.report(df).count() == 0 and N.dedup(df).count() == 0


def test_half_keys_follow_the_threshold(spark, monkeypatch):
    class Seen(Exception):
        pass

    def sketch(size, halves, rows):
        raise Seen(halves, rows)

    monkeypatch.setattr(N, "_sketch_batches", sketch)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for percent, least in ((80, 16), (85, 12), (95, 12), (100, 12), (70, 12)):
        with pytest.raises(Seen) as seen:
            N.classes(df, percent=percent)
        halves, rows = seen.value.args
        assert (1 - (1 - (percent / 100) ** rows) ** halves) ** 2 >= 0.99997 and halves >= least
        assert percent == 70 or halves == least
    with pytest.raises(Seen) as seen:
        N.classes(df, percent=80, halves=3)
    assert seen.value.args[0] == 3


def test_repeated_rows_of_the_smallest_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(6, a), (6, a), (7, a), (8, b), (8, b), (9, ""), (9, ""), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_again", F.lit(1)).withColumn("tags", F.create_map(F.lit("k"), F.col("text"))).repartition(4)
    kept = N.dedup(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text, r.tags) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(str((i, t, {"k": t})) for i, t in [(6, a), (8, b), (9, ""), (None, a), (None, a)])
    # every row twice leaves the same documents
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string")
    assert sorted(map(tuple, N.dedup(docs.union(docs)).collect())) == sorted(map(tuple, N.dedup(docs).collect()))


def test_an_id_with_several_texts_is_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (9, a), (9, b), (12, b), (9, ""), (20, "one two three four")]
    got = {tuple(r) for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == brute(rows, 3, 85) == {(5, 38, 5), (9, 38, 5), (9, 28, 5), (12, 28, 5), (9, 0, 5), (20, 2, 20)}
    assert [r.doc_id for r in N.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != 20] == [5]


def test_ids_of_other_types(spark):
    rows = corpus(9, 60)
    want = {(i, c) for i, _, c in brute(rows, 3, 85)}
    named = [(f"doc-{i:05d}", t) for i, t in rows] + [(None, rows[0][1])]
    got = {tuple(r)[::2] for r in N.classes(spark.createDataFrame(named, "name string, text string"), "name", shingle=3, percent=85).collect()}
    assert got == {(f"doc-{i:05d}", f"doc-{c:05d}") for i, c in want} | {(None, None)}
    df = spark.createDataFrame(named, "name string, text string")
    assert {r.name for r in N.dedup(df, "name", shingle=3, percent=85).collect()} == {f"doc-{c:05d}" for _, c in want} | {None}


def test_links_close_to_the_threshold_are_found(spark):
    """Couples of 85 to 90 per cent: each alone, so that no other path joins them."""
    rng = random.Random(12)
    rows, linked, i = [], 0, 0
    while linked < 300:
        n = rng.randrange(60, 200)
        w = [f"c{i}x{k}" for k in range(n)]
        v = list(w)
        for k in rng.sample(range(n), rng.randrange(1, 6)):
            v[k] = "other"
        sets = [{tuple(x[k : k + 3]) for k in range(n - 2)} for x in (w, v)]
        share = 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if 84 <= share < 90:
            rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
            linked += share >= 85
            i += 2
    got = {r.doc_id: r.component_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        want = {c for _, _, c in brute([a, b], 3, 85)}
        assert {got[a[0]], got[b[0]]} == want


def test_large_groups_are_dealt(spark):
    """One group of near copies in which not all are like the smallest, and hot copies of one text."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 9])):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(base[:90])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for block, set_block in ((16, 10**6), (256, 2000)):
        assert {tuple(r) for r in N.classes(df, shingle=3, percent=85, block=block, set_block=set_block).collect()} == brute(rows, 3, 85)
