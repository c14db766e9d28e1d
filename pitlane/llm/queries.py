"""The queries of this package and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitlane.llm import (
    bpe, class_lm, decontam, fim, html_text, licenses, mixing, near_dup, quality, secrets, sql, token_files, toxicity, whitening,
)
from pitlane.llm.tables import bounded_batches, table


def vocabulary() -> str:
    """The tokenizer's file: ``PITLANE_VOCABULARY``, or the public one this library's tests use."""
    if path := os.environ.get("PITLANE_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranks() -> tuple[str, str]:
    """The file of merge ranks (``PITLANE_RANKS``, or a public one) and the pattern that splits text before them."""
    import public_tokenizers

    return (os.environ.get("PITLANE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
            public_tokenizers.PATTERN)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents", "doc_id", "text"),
                           table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"),
                             table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                          table(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"),
                          table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents", "doc_id", "text"), *ranks())


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": _bounded(op1_decontamination),
    "op2_secrets": _bounded(op2_secrets),
    "op3_class_lm": _bounded(op3_class_lm),
    "op4_mixing": _bounded(op4_mixing),
    "op5_html_text": _bounded(op5_html_text),
    "op6_licenses": _bounded(op6_licenses),
    "op7_quality_rules": _bounded(op7_quality_rules),
    "op8_near_duplicates": _bounded(op8_near_duplicates),
    "op9_token_files": _bounded(op9_token_files),
    "op10_toxicity": _bounded(op10_toxicity),
    "op11_fill_in_middle": _bounded(op11_fill_in_middle),
    "op12_whitening": op12_whitening,
    "op13_byte_bpe": _bounded(op13_byte_bpe),
}

SQL: dict[str, str] = {
    "op1_decontamination": sql.CONTAMINATION,
    "op2_secrets": sql.SECRETS,
    "op7_quality_rules": sql.QUALITY,
    "op8_near_duplicates": sql.NEAR_DUPLICATES,
    "op11_fill_in_middle": sql.FILL_IN_MIDDLE,
}
