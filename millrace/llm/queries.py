"""Registered queries of the text operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, line_dedup, near_dedup, packing, pieces, pitman_yor, quality, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with begin and end ids, decode the ids, and give digests of both."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    return pieces.digest_documents(encoded)


@_query
def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from four of five folds."""
    return pitman_yor.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one made of control strings, and read them back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = f"{chat.TURN_END}{chat.TURN_START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digest(chat.format_turns(rows.unionByName(extra)))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 1024 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@_query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into rows of 2,048 ids, with digests of the matrices."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)
    return packing.pack_digest(packed)


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines and words that go as later copies of repeated runs, and a digest of what stays."""
    clean = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "removed_lines", "removed_words", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@_query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component by word pairs at a similarity of 0.8."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model that learned from labels outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 10-word windows of benchmark items, and those items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination_digest(decontaminate.mark_contamination(docs, items))
