import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.llm import license_scan as S
from lagoon.llm import textkernel as K


def words(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(text):
    w = words(text)
    at = sorted((i, p) for p in S.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    labels = ",".join(sorted({S.PHRASES[p] for _, p in at}))
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, labels


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(40):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        automaton = S.SuffixAutomaton(seqs)
        text = [rng.randrange(4) for _ in range(40)]
        inside = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        state = n = 0
        for i, t in enumerate(text):
            state, n = automaton.step(state, n, t)
            longest = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in inside))
            assert n == longest
            if n:
                part = text[i + 1 - n : i + 1]
                ends = {(k, e) for k, s in enumerate(seqs) for e in range(n, len(s) + 1) if s[e - n : e] == part}
                assert automaton.ends[state] == ends


@pytest.mark.parametrize("phrases", [{"a b": "1", "b": "2", "a b a": "3", "b a b": "4", "a a": "5"}])
def test_overlapping_phrases(phrases):
    rng = random.Random(7)
    scanner = S.Scanner(phrases, [("t", "a b c a b")])
    for _ in range(200):
        w = [rng.choice("abcx") for _ in range(30)]
        found, _ = scanner.scan(np.array([scanner.vocab.get(x, -1) for x in w]))
        expect = sorted((k, i) for k, p in enumerate(phrases) for i in range(30) if w[i : i + len(p.split())] == p.split())
        assert sorted(found) == expect


def test_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["Under the MIT License", "under the mit", "license", "Apache License, Version 2.0", "Apache-License version_2", "CC BY-NC", "cc by nc", "été", "word", "the", "a2"]
    texts = [None, "", "  .", "under the MIT licénse", "cc\x00by\x7fnc"] + [rng.choice([" ", "\n", "-", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)]
    texts.append("x " * 200_000 + "cc by nc")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("z")).repartition(4)
    got = {r.doc_id: r for r in S.scan(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute(t), t
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(",")))
        assert 0 <= got[i].score <= 1
    assert S.scan(df.limit(0)).count() == 0


def test_templates_survive_edits(spark):
    rng = random.Random(1)
    rows, long = [], [(i, label, t.split()) for i, (label, t) in enumerate(S.TEMPLATES) if len(t.split()) >= 12]
    for i, _, w in long:
        w = list(w)
        w[len(w) // 2] = "changed"
        noise = lambda: " ".join(f"n{rng.randrange(99)}" for _ in range(50))
        rows.append((i, f"{noise()} {' '.join(w).title()} {noise()}"))
    rows += [(100 + i, f"x {t} 3.") for i, (_, t) in enumerate(S.TEMPLATES)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label, _ in long:
        assert label in got[i].labels.split(","), got[i]
        span = [s for s in got[i].spans if s.label == label][0]
        assert 45 <= span.first_word <= 65 and span.cover >= S.MIN_COVER
    for i, (label, _) in enumerate(S.TEMPLATES):
        assert label in got[100 + i].labels.split(",")


def test_part_of_a_notice_is_no_label():
    scanner = S.Scanner()
    data, off = K.from_strings(["licensed under the terms of the general public", "this work is licensed under the"])
    assert [r[5] for r in scanner.report(data, off)] == ["", ""]


def test_every_notice_of_a_text_has_a_span():
    scanner = S.Scanner()
    k, (label, text) = max(enumerate(S.TEMPLATES), key=lambda t: len(t[1][1].split()))
    words = text.split()
    edited = [*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]]
    noise = [f"n{i}" for i in range(70)]
    row = [*noise, *words, *noise, *edited, *words, *noise, *words[: len(words) // 4], *noise]
    data, off = K.from_strings([" ".join(row), " ".join(words)])
    many, one = scanner.report(data, off)
    n = len(words)
    _, anchors = scanner.scan(np.array([scanner.vocab.get(w, -1) for w in row]))
    found = sorted((f, e) for _, f, e in scanner.chains(anchors)[scanner.base + k])
    assert found == [(70, 70 + n), (140 + n, 140 + 2 * n), (140 + 2 * n, 140 + 3 * n)]
    assert {(label, f, e) for f, e in found} <= {s[:3] for s in many[7]}
    assert many[5] == one[5] and many[6] == one[6] == 1.0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_a_whole_licence_is_covered():
    data, off = K.from_strings([MIT])
    row = next(iter(S.Scanner().report(data, off)))
    covered = set()
    for label, first, end, _ in row[7]:
        if label == "mit":
            covered |= set(range(first, end))
    assert row[5].split(",") == ["mit"] and len(covered) >= row[0] - 8  # the title and the owner's line are no passage


def plain_chain(anchors, size, gap):
    """The most words of a template that anchors cover in order, by trying every subset of a few."""
    best = 0
    for mask in range(1, 1 << len(anchors)):
        chosen = sorted(a for k, a in enumerate(anchors) if mask >> k & 1)
        ok, total = True, 0
        for k, (start, at, length) in enumerate(chosen):
            if k:
                s0, a0, n0 = chosen[k - 1]
                ok &= s0 + n0 <= start <= s0 + n0 + gap and a0 + n0 <= at <= a0 + n0 + gap
            total += length
        best = max(best, total if ok else 0)
    return min(1.0, best / size)


def test_chains_against_every_subset():
    """Edited copies of a passage whose matches do not overlap: the best chain is the best subset."""
    rng = random.Random(14)
    words = [f"t{k}" for k in range(60)]
    scanner = S.Scanner({}, [("x", " ".join(words))])
    for _ in range(60):
        text = list(words)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(text))
            change = rng.randrange(3)
            text[at : at + rng.choice([0, 1, 30]) * (change > 0)] = [f"n{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 30]) * (change < 2))]
        tokens = np.array([scanner.vocab.get(w, -1) for w in text])
        found, run = [], 0
        for i in range(len(text)):  # maximal runs that follow the template
            run = run + 1 if run and tokens[i] >= 0 and text[i] == f"t{int(text[i - 1][1:]) + 1}" else int(text[i][0] == "t")
            follows = i + 1 < len(text) and run and text[i + 1] == f"t{int(text[i][1:]) + 1}"
            if run >= S.MIN_MATCH and not follows:
                found.append((i + 1 - run, int(text[i][1:]) + 1 - run, run))
        _, anchors = scanner.scan(tokens)
        chains = scanner.chains(anchors)
        got = max((c for c, _, _ in chains.get(0, [])), default=0.0)
        assert abs(got - plain_chain(found, 60, S.MAX_GAP)) < 1e-9, text
