import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lagoon.llm import quality_model as Q
from lagoon.llm import textkernel as K
from lagoon.llm.quality_rules import STOP_WORDS


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def corpus(n=500):
    rng = random.Random(1)
    vocab = [f"{rng.choice(['the', 'or', 'lem', 'ip', 'sum', 'do', 'lor'])}{rng.choice(['a', 'e', 'i', 'ing'])}{rng.choice('xyzw')}" for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        bad = i % 3 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = Q.fit(x[:4000], y[:4000])
    assert auc(y[4000:], model.score(x[4000:])) > 0.99
    # the flattened arrays give what a walk from node to node gives
    for r in x[:20]:
        total = model.start
        for f, t, v in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if r[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert abs(total - model.margin(r[None])[0]) < 1e-9


def test_statistics_do_not_depend_on_batches():
    rng = random.Random(2)
    texts = ["", "a", "É\n\nx", "The THE!! the### | b.", "w " * 5000] + ["".join(rng.choice("ab A!\n.é|") for _ in range(rng.randrange(300))) for _ in range(50)]
    stats = Q.Statistics()
    together = stats(*K.from_strings(texts))
    assert together.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(together).all()
    assert np.allclose(together, np.concatenate([stats(*K.from_strings([t])) for t in texts]))
    f = dict(zip(Q.FEATURES, together[3], strict=True))
    assert abs(f["shout_words"] - 1 / 5) < 1e-6 and abs(f["share_break"]) < 1e-6 and f["tagged_words"] >= 2 / 5


def test_held_out_quality_and_edges(spark):
    docs, labels = corpus()
    extra = [(1000, None), (1001, ""), (None, "x y"), (1002, "word " * 200_000), (7, docs[7][1])]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("quality", F.lit(1)).withColumn("_y", F.lit(0)).withColumn("_text_to_score", F.lit("s")).repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1), (2000, 0), (3, None), (4, labels[4][1])], "doc_id long, quality int")
    got = Q.report(df, lab).collect()
    assert len(got) == len(docs) + len(extra)
    score = {r.doc_id: r.score for r in got}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(y, score[i]) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert auc(np.array([h[0] for h in held]), np.array([h[1] for h in held])) > 0.98
    # held-out labels have no influence
    flip = lab.withColumn("quality", F.when(Q.held_out("doc_id", 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in Q.report(df, flip).collect()} == {(r.doc_id, r.score) for r in got}
    kept = Q.keep_good(df, lab)
    assert kept.schema == df.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_no_labels_one_class_empty(spark):
    df = spark.createDataFrame(corpus(20)[0], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.report(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert min(r.score for r in Q.report(df, one).collect()) > 0.99
    assert Q.report(df.limit(0), one).count() == 0


def plain_statistics(text):
    """The statistics of one text, word by word."""
    raw = text.encode()
    kinds = [sum(Q._KIND[b] == k for b in raw) for k in range(len(Q.KINDS))]
    n = max(len(raw), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(raw).values())
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    some = max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / some
    share = lambda x: len(set(x)) / len(x) if x else 1.0
    runs = lambda k: [tuple(low[i : i + k]) for i in range(len(low) - k + 1)] if len(low) >= k else ([tuple(low)] if low else [])
    upper = [sum(65 <= b <= 90 for b in w) for w in words]
    same = [i > 0 and low[i] == low[i - 1] for i in range(len(low))]
    shout = [u >= 2 and 2 * u > len(w) for u, w in zip(upper, words, strict=True)]
    tagged = [Q._KIND[w[-1]] in (8, 9) or (Q._KIND[w[-1]] == 7 and s) for w, s in zip(words, shout, strict=True)]
    odd = [a or b or c for a, b, c in zip(same, shout, tagged, strict=True)]
    worst = max((sum(odd[i : i + 100]) / len(odd[i : i + 100]) for i in range(0, len(odd), 100)), default=0.0)
    lines = [x for x in bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split(b"\n") if x]
    stops = {w.encode() for w in STOP_WORDS}
    return [
        *(k / n for k in kinds), entropy, math.log1p(len(text)), math.log1p(len(words)), mean, math.sqrt(max(sum(v * v for v in lengths) / some - mean**2, 0)), max(lengths, default=0),
        share(low), share(runs(2)), share(runs(4)), sum(same) / some, sum(w in stops for w in low) / some, sum(65 <= w[0] <= 90 for w in words) / some, sum(shout) / some, sum(tagged) / some,
        len(text) / max(len(lines), 1), share(lines), len(words) / (1 + kinds[Q.KINDS.index("stop")]), worst,
    ]


def test_statistics_equal_a_plain_version():
    rng = random.Random(21)
    pool = ["the", "The", "Der", "été", "WORD!!", "AB", "x#", "a|", "ok!", "...", "12,5", "語語", "café", "(y)"]
    texts = ["", " ", "\n\n", "one", "A", "é", "x\n\ny\nx", "WOW!! WOW!! wow"]
    texts += ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.choice([1, 3, 4, 99, 100, 101, 350]))) for _ in range(60)]
    got = Q.Statistics()(*K.from_strings(texts))
    assert got.shape[1] == len(Q.FEATURES)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_statistics(t), rtol=1e-5, atol=1e-5), (t, [(f, a, b) for f, a, b in zip(Q.FEATURES, row, plain_statistics(t), strict=True) if abs(a - b) > 1e-4])


def test_repeated_documents_add_nothing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the house", "GO!! NOW!!", "is old"][: 1 + 2 * (i % 2)]) for _ in range(40))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, quality int")
    one, many = (spark.createDataFrame(rows * k, "doc_id long, text string") for k in (1, 3))
    a, b = Q.train(one, labels), Q.train(many.repartition(7), labels)
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.threshold, b.threshold)
