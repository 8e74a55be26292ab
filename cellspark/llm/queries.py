"""The queries of this subpackage over the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, licenses, lines, neardup, quality, sentencepieces, shards, tokens, trie, urls, warc
from .common import shared_dir, table

MAX_TOKENS = 2048
#: Tokens of a stored sequence, the free id that ends documents, the key of the order, bytes of a shard.
SEQUENCE, END, ORDER_KEY, SHARD_BYTES = 256, 50256, 20240101, 64 << 20


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shards"
    layout = shards.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SEQUENCE, END, ORDER_KEY, SHARD_BYTES)
    rows = shards.read_shards(spark, path, layout)
    return rows.select("slot", "doc_id", "part", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc.doc_id", "doc.text", "n_lines", "n_removed")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    return warc.digest_rows(warc.assemble(warc.read_records(spark, path)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"]))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), "class_id", F.col("stays").alias("kept"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.turn_arrays(table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.digests(alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepieces.digests(sentencepieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], decode=True))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_training_order, op3_line_dedup, op4_decontamination, op5_warc, op6_byte_bpe, op7_quality_rules, op8_license_scan, op9_url_filters, op10_minhash_neardup, op11_prefix_trie, op12_token_alignment, op13_sentencepiece)}
