"""Each stage against a plain version on its own input, and the run as a whole."""

import random
from pathlib import Path

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagoon.llm.entry import tokenizer_path
from lagoon.llm.line_dedup import MAX_RATIO, MIN_PAGES
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_quality_rules import brute as brute_rules

STOPS = "the of and to in is that it for was".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ba", "ke", "to", "mi", "lo") for b in ("ra", "ne", "su", "ti", "go", "pa")] + STOPS
    docs, labels = [], []
    for i in range(240):
        if i % 5 == 4 and docs:
            text = docs[rng.randrange(len(docs))][1]
            if text and rng.random() < 0.5:
                w = text.split(" ")
                w[rng.randrange(len(w))] = "edited"
                text = " ".join(w)
            good = "!!" not in (text or "")
        else:
            good = rng.random() < 0.7
            words = [rng.choice(vocab) for _ in range(rng.randrange(25, 160))]
            text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
            if good and rng.random() < 0.6:
                text += "\nRead more on our site"
        docs.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, truth = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(C.STAGES)
    assert list(stages) == ["quality_classifier", "quality_rules", "line_dedup", "near_dedup", "packing"]
    rows = {r.doc_id: tuple(r) for r in docs.collect()}

    good = stages["quality_classifier"](spark, docs, sf_dir)
    kept = {r.doc_id: tuple(r) for r in good.collect()}
    assert good.columns == columns and all(rows[i] == r for i, r in kept.items())
    wrong = [i for i, q in truth.items() if (i in kept) != bool(q)]
    assert len(wrong) <= 4
    good = spark.createDataFrame(list(kept.values()), docs.schema)

    ruled = stages["quality_rules"](spark, good, sf_dir)
    after = {r.doc_id: tuple(r) for r in ruled.collect()}
    assert ruled.columns == columns
    assert set(after) == {i for i, r in kept.items() if not brute_rules(r[1])[5]}
    ruled = spark.createDataFrame(list(after.values()), docs.schema)

    cleaned = stages["line_dedup"](spark, ruled, sf_dir)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    expect = {r[0]: r[4] for r in brute_lines([(r[0], r[3], r[1]) for r in after.values()], MAX_RATIO, MIN_PAGES)}
    assert cleaned.columns == columns and texts == expect and texts != {i: r[1] for i, r in after.items()}
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    single = stages["near_dedup"](spark, cleaned, sf_dir)
    stay = {r.doc_id for r in single.collect()}
    assert single.columns == columns and stay == {c for _, _, c in brute_near(sorted(texts.items()), 5, 80)}

    t = Tokenizer.from_file(tokenizer_path())
    pieces = stages["packing"](spark, single, sf_dir).collect()
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in stay}

    key = lambda r: tuple(r)[:5]
    assert sorted(map(key, C.run(spark, sf_dir).collect())) == sorted(map(key, pieces))
    assert C.ORACLE_SQL is None


def written(spark, path, docs, like):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{like}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_repeated_rows_do_not_survive(spark, sf_dir, tmp_path):
    """Every row twice: the rows that are packed are the same, once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folders = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("pipeline-*/*"))
    before = folders()
    twice = C.run(spark, written(spark, f"{tmp_path}/twice", docs.union(docs), sf_dir))
    ids = [r.doc_id for r in twice.where("piece = 0").collect()]
    assert len(ids) == len(set(ids)) and len(folders() - before) == 1
    # the classifier and line dedup see other counts, so the kept ids are compared with the stages' own
    rows = [tuple(r) for r in dict(C.STAGES)["near_dedup"](spark, docs.union(docs), sf_dir).collect()]
    assert sorted(rows, key=str) == sorted((tuple(r) for r in dict(C.STAGES)["near_dedup"](spark, docs, sf_dir).collect()), key=str)


def test_empty_tables_and_extra_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert C.run(spark, written(spark, f"{tmp_path}/empty", docs.limit(0), sf_dir)).count() == 0
    extra = docs
    for c in ("id", "length", "cell", "root", "_t", "_m", "_h", "_b", "_new", "piece", "score", "kept", "_dropped_id", "_again", "num"):
        extra = extra.withColumn(c, F.lit("x"))
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    got = C.run(spark, written(spark, f"{tmp_path}/extra", extra, sf_dir))
    assert sorted(map(key, got.collect())) == sorted(map(key, C.run(spark, sf_dir).collect()))
