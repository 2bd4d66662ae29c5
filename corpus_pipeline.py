"""Documents to a clean, tokenised corpus, in stages that each read what the one before has written.

Every stage takes documents with any further columns, whatever their names, and leaves these as they are; an empty table gives an empty table. Null texts
and texts without words fail the quality rules. Line dedup and the join take rows that share an id and a text for one document, of which one row stays; null ids come
after all others. Very long texts take memory in proportion to themselves. Ties go to the least id, then to the least hash of the text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from hourloom.llm.common import shrink, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the perplexity bands reject."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that match an earlier line, and without documents that have no other lines."""
    return line_dedup.dedup(docs, least=1).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of the benchmark, and without documents that are mostly such passages."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def shrunk(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, on executors whose heaps no longer hold the memory of the stage before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", shrunk(quality_rules)),
    ("line dedup", shrunk(line_dedup_stage)),
    ("n-gram Jaccard join", shrunk(near_duplicates)),
    ("benchmark decontamination", shrunk(benchmark_decontamination)),
    ("byte-level BPE", shrunk(byte_level_bpe)),
]

#: The perplexity model of the first stage is beyond SQL; tests hold the other stages together against a brute-force version, and the first one's model, counts and verdicts apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
