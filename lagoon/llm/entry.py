"""Queries of this package, one ``opN_<name>`` for each operator, and their DuckDB SQL."""

from __future__ import annotations

from lagoon.llm import fingerprint, language_id, license_scan, line_dedup, near_dedup, packing, pieces, quality_model, quality_rules, warc
from lagoon.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op2_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), alpha=1.0, verify=True)


def op3_fingerprint(spark, sf_dir):
    return fingerprint.edited_report(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op6_quality_model(spark, sf_dir):
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.report(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pieces": op2_pieces,
    "op3_fingerprint": op3_fingerprint,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_quality_model": op6_quality_model,
    "op7_near_dedup": op7_near_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.REPORT_SQL,
    "op5_warc": warc.REPORT_SQL,
    "op9_quality_rules": quality_rules.REPORT_SQL,
}
