import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.llm import language_id as L
from lagoon.llm import textkernel as K

SYLLABLES = {"aa": "ba ke to", "bb": "zu örf ché", "cc": "mi lon tra", "dd": "ши ло да", "ee": "東 京 都"}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(3)) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def test_codewords_tell_classes_apart():
    for k in (2, 3, 4, 7, 12, 40):
        code = L.codewords(k)
        assert len({tuple(c) for c in code}) == k
        assert (code.min(0) != code.max(0)).all()
    assert L.codewords(4).shape == (4, 7) and L.codewords(1).shape == (1, 0)


def test_grams_equal_brute_force():
    texts = ["aB1c", "", "é", "x", "日本 語", "hello world"]
    data, off = K.from_strings(texts)
    got = Counter()
    for cell, row in L.grams(data, off):
        got.update(zip(row.tolist(), cell.tolist(), strict=True))
    expect = Counter()
    for r, t in enumerate(texts):
        b = [int(L._CLASS[x]) for x in t.encode()]
        for k, size in enumerate(L.SIZES):
            for i in range(len(b) - size + 1):
                code = 0
                for x in b[i : i + size]:
                    code = (code << 8 | x) & 0xFFFFFFFF
                expect[r, ((code * 2654435761) % 2**32 >> (32 - L.CELL_BITS)) + (k << L.CELL_BITS)] += 1
    assert got == expect


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(600) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?! €", "bb"), (1003, "örfché zu", None), (1004, "東", None), (None, "bakeke toke", "aa"), (1005, "ba " * 100_000, "aa"), (5, "ba ke to baba", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(4)
    got = L.report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    for i, _, lang in rows[:600]:
        if i == 5:
            continue
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].lang_pred == lang and 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert (by[1003].lang_pred, by[1004].lang_pred, by[1005].lang_pred, by[None].held_out) == ("bb", "ee", "aa", False)
    # labels of held-out rows, sources and ids do not matter
    wrong = df.withColumn("lang", F.when(L.held_out("doc_id", 3, 1), F.lit("zz")).otherwise(F.col("lang")))
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score)
    assert sorted(map(key, L.report(wrong).collect())) == sorted(map(key, got))


def test_one_language_none_and_empty(spark):
    one = spark.createDataFrame([(i, "abc", "xx") for i in range(9)] + [(50, "1", "xx")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.report(one).collect()} == {("xx", 1.0), ("und", 0.0)}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.report(none).collect()} == {"und"}
    assert L.report(one.limit(0)).count() == 0


def test_ambiguity():
    model = L.Model(["a", "b", "c"], L.codewords(3), np.zeros((L.CELLS, 3), np.float32))
    best, score, unsure = model.decode(np.array([[0.0, 0.0, 0.0], [-4.0, -4.0, -4.0]]) / 8)
    assert unsure[0] and abs(score[0] - 1 / 3) < 1e-9 and score[1] > 0.9 and best[1] == 0


def test_weights_are_the_log_odds_of_shares(spark):
    rows = corpus(120)
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    counts = {x: np.zeros(L.CELLS) for x in model.langs}
    for _, text, lang in rows:
        for cell, _ in L.grams(*L.K.from_strings([text])):
            np.add.at(counts[lang], cell, 1)
    share = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * L.CELLS) for x in model.langs])
    for b in range(model.code.shape[1]):
        one = model.code[:, b] == 1
        assert np.allclose(model.weights[:, b], np.log(share[one].mean(0)) - np.log(share[~one].mean(0)), atol=1e-4)


def test_many_labels(spark):
    """More labels than a task holds: the driver gets weights by bit, not counts by label."""
    rows = [(i * 150 + k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}qu " * 30, f"l{k:03d}") for i in range(4) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.train(df)
    assert len(model.langs) == 150 and model.weights.shape[1] < 80
    got = {r.doc_id: r.lang_pred for r in L.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.95 * len(rows)


@pytest.mark.parametrize("k", [2, 7, 8, 40, 201, 700])
def test_codewords_are_apart(k):
    code = L.codewords(k)
    assert len(np.unique(code, axis=0)) == k and (code.min(0) != code.max(0)).all()
    if k > 7:
        assert min((code[i] != code[j]).sum() for i in range(0, k, 7) for j in range(i)) >= 0.15 * code.shape[1]
