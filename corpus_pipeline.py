"""Corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), with ``docs`` the rows that the stage
before it kept, and returns the columns of documents; the last returns ids. No
stage samples or caps rows. A stage finds its own columns by name and carries
all others along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common, decontaminate, near_dedup, quality_rules, secret_scan, sentencepiece_codec


#: Rows that Spark sends to Python at once. Its default of 10,000 makes batches of 30 MB and more of these texts, several in each task.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the word rules or the tokeniser-fertility bands reject."""
    _small_batches(spark)
    shield = common.Shield(docs)
    judged = quality_rules.quality_rules(shield.rows, None, shield.at["text"], shield.at["lang"])
    return shield.back(judged.where("kept"), made=[])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    _small_batches(spark)
    return near_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item."""
    _small_batches(spark)
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; no document is dropped. ``n_chars`` follows the text."""
    _small_batches(spark)
    shield = common.Shield(docs)
    found = secret_scan.scan(shield.rows, None, shield.at["text"], redact=True)
    out = found.withColumn(shield.at["text"], F.col("redacted_text"))
    if "n_chars" in shield.at:
        n = shield.at["n_chars"]
        out = out.withColumn(n, F.when(F.size("secrets") > 0, F.length("redacted_text").cast(found.schema[n].dataType)).otherwise(F.col(n)))
    return shield.back(out, made=[])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, verified against the sentencepiece library and by decoding."""
    _small_batches(spark)
    return sentencepiece_codec.encode(docs, keep=["doc_id"]).select("doc_id", "n_tokens", "n_byte_tokens", "ids", "parity", "round_trip")


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontamination", benchmark), ("secret_scan", secrets), ("sentencepiece", encode)]

#: The stages rest on tokenisers and sampling, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what passes between two stages is a written table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
