"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as
Parquet to the shared folder and reads it again as the next stage's documents. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from millrace.session import shared_folder, ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality.keep_good(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those of which no word is left go."""
    ship(spark)
    clean = line_dedup.dedup_lines(docs)
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return clean.where(~emptied).select(*[chars if c == "n_chars" else F.col(c) for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.drop_contaminated(docs, items)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, digests of them, and whether the ids decode to the text."""
    ship(spark)
    encoded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        "piece_ids",
        F.sha2("piece_text", 256).alias("decoded_sha256"),
        F.coalesce(F.col("piece_text") == F.col("text"), F.lit(False)).alias("round_trip"),
    )


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", distinct_lines),
    ("near dedup", distinct_documents),
    ("benchmark decontamination", clean_of_benchmarks),
    ("sentencepiece", encoded_documents),
]

#: MinHash and SentencePiece can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
