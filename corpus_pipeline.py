"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and reads it again as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.llm import bpe, decontam, lines, neardup, quality
from cellspark.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules and their host's verdict keep."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated windows of three lines; n_chars, where there is one, counts what is left."""
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("doc.text").cast("long")).otherwise(F.col("doc.n_chars"))
        out = out.withColumn("doc", F.col("doc").withField("n_chars", chars))
    return out.select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row, nor a whole shorter item, with the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Weighted similarity of near-duplicates and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all of ``documents``; each stage but the last is written in between."""
    *first, last = STAGES
    docs = reduce(lambda docs, stage: materialise(stage[1](spark, docs, sf_dir), stage[0]), first, table(spark, sf_dir, "documents"))
    return last[1](spark, docs, sf_dir)
