"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.near_dedup import near_duplicates
    return near_duplicates(_table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.quality import quality_facts
    return quality_facts(_table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.packing import pack
    from quern.llm.tokens import tokenizer_path
    return pack(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.secrets import secret_findings
    return secret_findings(_table(spark, folder, "documents"))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.pii import personal_data
    return personal_data(_table(spark, folder, "documents"))


def op6_contamination(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.decontaminate import contamination
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_language_scores(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.lm import language_scores
    return language_scores(_table(spark, folder, "documents"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.html import main_text
    return main_text(_table(spark, folder, "pages"))


def op9_section_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.token_counts import section_tokens
    from quern.llm.tokens import tokenizer_path
    return section_tokens(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.substrings import repeated_passages
    return repeated_passages(_table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.collocations import collocations
    return collocations(_table(spark, folder, "documents"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.manifest import verified_rows
    return verified_rows(_table(spark, folder, "documents"))


def op13_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.urls import judged_pages
    return judged_pages(_table(spark, folder, "pages"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_personal_data": op5_personal_data,
    "op6_contamination": op6_contamination,
    "op7_language_scores": op7_language_scores,
    "op8_main_text": op8_main_text,
    "op9_section_tokens": op9_section_tokens,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_collocations": op11_collocations,
    "op12_manifest": op12_manifest,
    "op13_url_verdicts": op13_url_verdicts,
    "pipeline": pipeline,
}
