import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.llm import fingerprint as P
from lagoon.llm import textkernel as K


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("shape", [{}, {"bins": 128, "bits": 8}, {"bits": 1}])
def test_estimates_similarity(shape):
    rng = random.Random(1)
    fp = P.Fingerprinter(**shape)
    errors = []
    for n in (40, 200, 1500):
        for keep in (0.0, 0.5, 0.9, 1.0):
            a = words(rng, n).split()
            k = int(n * keep)
            b = a[:k] + words(rng, n - k).split()
            s = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
            truth = len(s[0] & s[1]) / len(s[0] | s[1])
            codes, has = fp.codes(*K.from_strings([" ".join(a), " ".join(b)]))
            errors.append(fp.likeness(codes[:1], has[:1], codes[1:], has[1:])[0] - truth)
            if keep == 1.0:
                assert errors[-1] == 0
    assert np.abs(errors).mean() < 0.06 and np.abs(errors).max() < 0.3


def test_short_texts_do_not_agree_by_chance():
    fp = P.Fingerprinter()
    texts = [f"only{i}" for i in range(200)]
    codes, has = fp.codes(*K.from_strings(texts))
    est = fp.likeness(codes[:-1], has[:-1], codes[1:], has[1:])
    assert est.max() < 0.1


def brute(rows):
    rows = sorted(((i is not None, i or 0), t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        e = t[: len(t) - m] + u[:m]
        out.append((i[1] if i[0] else None, len(t), hashlib.sha256(e.encode()).hexdigest(), t, u, e))
    return out


@pytest.mark.parametrize("n", [1, 2, 9, 150])
def test_report_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6) if k else 5, rng.choice([None, "", "  ", "é" * 7, words(rng, rng.randrange(1, 60)), "same words again and again here"])) for k in range(n)]
    if n == 150:
        rows += [(None, "lost id one two three four"), (rows[3][0], "an id twice"), (rows[-1][0], rows[-1][1])]
        rows += [(77, " ".join(f"long{i}" for i in range(40_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("copy", F.lit(3))
    got = P.edited_report(df.repartition(4)).collect()
    fp = P.Fingerprinter()
    expect = []
    for i, size, sha, t, u, e in brute(rows):
        codes, has = fp.codes(*K.from_strings([t, u, e]))
        f = fp.pack(codes, has)
        near = [fp.likeness(codes[:1], has[:1], codes[k : k + 1], has[k : k + 1])[0] for k in (2, 1)]
        expect.append((i, size, sha, f[0], f[2], round(near[0], 9), round(near[1], 9)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] + (round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(expect, key=key)


def test_empty_table_and_hex_likeness(spark):
    assert P.edited_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    fp = P.Fingerprinter()
    rng = random.Random(4)
    t = words(rng, 90)
    texts = [t, t[:300] + words(rng, 30), "", "   "]
    codes, has = fp.codes(*K.from_strings(texts))
    f = fp.pack(codes, has)
    df = spark.createDataFrame([(f[a], f[b], float(fp.likeness(codes[a : a + 1], has[a : a + 1], codes[b : b + 1], has[b : b + 1])[0])) for a in range(4) for b in range(4)], "a string, b string, e double")
    assert df.where(F.abs(P.hex_likeness(F.col("a"), F.col("b")) - F.col("e")) > 1e-9).count() == 0
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == f


def mixed(x, salt):
    """splitmix64's finaliser on one number."""
    m = 2**64 - 1
    z = (x + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & m
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    return z ^ z >> 31


def plain(text, shingle=5, bins=512, bits=4):
    """One permutation, optimal densification and packing, a value at a time."""
    data, offsets = K.from_strings([text])
    starts, ends, first = K.spans(K.lower(data), offsets, K.SPACED)
    hashes, _ = K.shingles(K.word_hashes(K.lower(data), starts, ends), first, shingle)
    low = {}
    for h in hashes.tolist():
        slot, value = (h >> 40) % bins, (h << 24) % 2**64
        low[slot] = min(value, low.get(slot, value))
    if not low:
        return ""
    out = 0
    for slot in range(bins):
        at, attempt = slot, 0
        while at not in low:
            at = mixed((attempt << 32) + slot, 61) % bins
            attempt += 1
        out = out << bits | mixed(low[at] ^ mixed(slot, 63), 65) >> (64 - bits)
    return f"{out:0{bins * bits // 4}x}"


@pytest.mark.parametrize("shape", [{}, {"bins": 128, "bits": 8}, {"bits": 1}, {"bits": 2, "shingle": 3}])
def test_fingerprints_equal_a_plain_version(shape):
    rng = random.Random(8)
    texts = ["", " \n", "one", "One TWO", "a b c d e", "é É x", words(rng, 6), words(rng, 60), words(rng, 900), words(rng, 3000), words(rng, 40) * 3]
    fp = P.Fingerprinter(**shape)
    assert fp.pack(*fp.codes(*K.from_strings(texts))) == [plain(t, **shape) for t in texts]


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        P.edited_report(df)
    assert {r.doc_id: r.fingerprint == "" for r in P.fingerprints(df).collect()} == {"a": False, "b": True}
