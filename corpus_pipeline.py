"""A training corpus from ``documents``: language ID, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; ``run`` writes
each one's rows as Parquet in the shared folder and reads them again for the next, and then deletes what the stage made.

All stages: an empty table gives an empty one; very long texts are read whole; documents need the columns doc_id, text, lang
(first stage) and source (fourth); any other columns, of any names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from argusledger.functions.tables import cut, drop_cut, scratch
from argusledger.llm import decontaminate, jaccard, langid, mixing, tokenpack
from argusledger.llm.common import limit_batches, read

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject.

    Null texts and texts without a letter are rejected; repeated rows are judged alike; nulls in other columns don't matter.
    """
    limit_batches(spark)
    return langid.recognised(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id's.

    Repeated rows are near duplicates.  Rows that share a doc_id, or have none, are judged each by its own text; rows without
    words (null and empty texts) stay.
    """
    limit_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.  Null and empty texts have none and stay; each row is judged alone."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a last partial take with the chosen blocks' text.

    Null texts and texts without words are taken 0 times; null sources are one source; repeated rows are documents of their own.
    """
    limit_batches(spark)
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its place among all ids, read back from the token files.

    Null and empty texts have the end id only; rows without doc_id come first, rows that share one by their texts' hashes.
    """
    limit_batches(spark)
    return tokenpack.report(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix_sources),
    ("token_output", token_output),
]
#: SQL can't express the first stage, nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        with scratch() as made:
            docs = cut(stage(spark, docs, sf_dir))
            made.remove(docs)
        if last is not None:
            drop_cut(last)
        last = docs
    return docs
