"""The queries opN_* and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argusledger.llm import annsearch, chatformat, chattrie, decontaminate, embdedup, jaccard, langid, linededup, mixing, periodic, quality, substring, tokenpack
from argusledger.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents"))


def op3_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents"), linededup.dedup_passages)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.report(read(spark, sf_dir, "conversations"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(read(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.report(read(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.report(read(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.report(read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chattrie.report(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_mixing, op3_line_dedup, op3_line_passages, op4_jaccard_join, op5_chat_format, op6_substring_dedup, op7_nearest, op8_language_id, op9_quality, op10_token_pack, op11_embedding_dedup, op12_periodic_runs, op13_prefix_trie, pipeline)
}
#: None for 2, 7 to 11 and the pipeline: their tests hold them against brute force, round trips or held-out rows.
SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_line_dedup": linededup.SQL,
    "op3_line_passages": linededup.PASSAGES_SQL,
    "op4_jaccard_join": jaccard.SQL,
    "op5_chat_format": chatformat.SQL,
    "op6_substring_dedup": substring.SQL,
    "op12_periodic_runs": periodic.SQL,
    "op13_prefix_trie": chattrie.SQL,
}
