"""A cleaning pipeline over ``documents``: each stage works on what the one before kept.

1. quality classifier: documents scored below its threshold go;
2. quality rules: documents that fail a rule go;
3. line dedup: lines that are boilerplate of their source go from the texts (``n_chars`` follows);
4. MinHash near-dedup: one document of each near-duplicate group stays;
5. best-fit packing: what is left, packed into sequences (one row per piece).

Stages 1 to 4 return the columns of ``documents``. Rows pass from one to the next as Parquet, in a folder
of the run under the shared one; a stage's folder is removed once the next has written its own, so the
last one, which the result is read from, is what stays.

Defined cases, stage by stage in the functions below: null and empty texts, null and repeated ids, empty
tables and extra columns pass through every stage without an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import line_dedup, near_dedup, packing, quality_model, quality_rules
from lagoon.llm.common import remove, shared_dir, table
from lagoon.llm.entry import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores as good, as they are; it learns from ``labels``.

    Null and empty texts are scored like others (their statistics are zeros), repeated rows each; a row
    of null id is scored and never learned from; extra columns pass through; an empty table stays empty.
    """
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass every quality rule, as they are.

    Null and empty texts have no words and go; repeated rows are judged each; ids play no part; extra
    columns pass through.
    """
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that are boilerplate of their source; ``n_chars`` follows the text.

    A null text stays null (its ``n_chars`` too), a text all of whose lines go is empty; rows of null
    source are one source; repeated rows count as pages of their own; extra columns pass through.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8), that of the smallest id.

    Null and empty texts are in no group and stay; of rows that share an id the longest text stays,
    once; rows of null id all stay; extra columns pass through.
    """
    return near_dedup.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The other columns of ``documents`` are not carried on. Null and empty texts are the end id alone; rows
    of null or repeated id are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("packing", pack),
]

#: Classifier, tokens and similarity are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read back."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
