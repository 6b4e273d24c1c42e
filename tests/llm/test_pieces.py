import math
import random
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lagoon.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


def paths(lattice, text):
    """Every segmentation of a text and its probability, by brute force."""
    by = {lattice.names[i]: i for i in range(len(lattice.names)) if lattice.text[i] and not lattice.names[i].startswith("<0x")}
    s = "▁" + text.replace(" ", "▁")

    @cache
    def go(i):
        if i == len(s):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in by:
                p = by[s[i:j]]
                out += [((p, *rest), w + lattice.log[p]) for rest, w in go(j)]
        if s[i] not in by:
            b = s[i].encode()
            out += [((*(int(lattice.bytes[x]) for x in b), *rest), w + len(b) * lattice.byte_log) for rest, w in go(i + 1)]
        return out

    found = go(0)
    top = max(w for _, w in found)
    total = sum(math.exp(w - top) for _, w in found)
    return {p: math.exp(w - top) / total for p, w in found}


@pytest.mark.parametrize("text,alpha", [("the", 1.0), ("a be", 0.5), ("in é", 1.0), ("日x", 0.2), ("  on\n", 0.7)])
def test_samples_follow_the_exact_distribution(text, alpha):
    lattice = P.Lattice(PATH, alpha)
    exact = paths(lattice, text)
    n = 6000
    ids, begin = lattice.sample([text] * n, np.array([P.row_seed(1, k) for k in range(n)], dtype=np.uint64))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:], strict=True))
    assert set(seen) <= set(exact)
    for path, p in exact.items():
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "  two  spaces ", "▁ literal ▁▁", "日本語テキスト", "\x00\x01\n\t\r", "😀 é́", "a" * 3000, "x y " * 3000]
    return out + ["".join(rng.choice("abcdéß ▁ \n日-.,the ") for _ in range(rng.randrange(120))) for _ in range(200)]


def test_lossless_reproducible_and_independent_of_partitions(spark):
    rows = list(enumerate(texts())) + [(None, "no key"), (None, "no key"), (3, texts()[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    once = P.encode(df.repartition(7), PATH, alpha=0.5, seed=4, verify=True).collect()
    again = P.encode(df.coalesce(1), PATH, alpha=0.5, seed=4, verify=True).collect()
    key = lambda r: str(r)
    assert sorted(once, key=key) == sorted(again, key=key) and len(once) == len(rows)
    for r in once:
        if r.doc_id == 0:
            assert r.ids is None and r.lossless is None
        else:
            assert r.lossless and r.n_pieces == len(r.ids)
    other = {r.doc_id: r.ids for r in P.encode(df, PATH, alpha=0.5, seed=5).collect()}
    assert any(other[r.doc_id] != r.ids for r in once)
    back = {r.doc_id: r.text for r in P.decode(spark.createDataFrame(once), PATH).collect()}
    assert back == dict(rows)
    assert P.encode(df.limit(0), PATH).count() == 0


def test_kept_words_do_not_change_draws(monkeypatch):
    rows = [t for t in texts() if t]
    seeds = np.array([P.row_seed(2, k) for k in range(len(rows))], dtype=np.uint64)
    whole = P.Lattice(PATH, 0.5).sample(rows, seeds)
    monkeypatch.setattr(P, "KNOWN", 40)
    lattice = P.Lattice(PATH, 0.5)
    for k, t in enumerate(rows):
        ids, _ = lattice.sample([t], seeds[k : k + 1])
        assert ids.tolist() == whole[0][whole[1][k] : whole[1][k + 1]].tolist()
