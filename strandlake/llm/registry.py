"""Registered queries of the text operators; SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import conversation_repair, cross_entropy, decontaminate, html_extraction, importance_resampling, near_dedup, quality_rules, secret_scan, sentencepiece_codec, token_counts, training_order, url_filters, vector_codes
from strandlake.llm.common import new_path, table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights, sampling keys and the Gumbel top-k decision of every row of documents."""
    out = importance_resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"), "kept")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every row of documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "n_links")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and template tree over the url of every row of pages."""
    return url_filters.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, as a digest, with what was verified."""
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return encoded.select("doc_id", "n_tokens", "n_byte_tokens", F.sha2("ids", 256).alias("ids_sha256"), "parity", "round_trip")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules and tokeniser-fertility bands over every row of documents."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *(F.round(m, 6).alias(m) for m in quality_rules.MEASURES), "band_key")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of documents, as it is read back from the shards that were written; ids as a digest."""
    path = new_path(spark, "shards")
    _, total = training_order.materialise(table(spark, sf_dir, "documents"), path)
    rows = training_order.read_shards(spark, path, total)
    return rows.select("slot", "shard", "record", "seq", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.spans_string().alias("spans"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a row of documents leaks, verbatim or re-parameterised."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_item_windows", "consistency")


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every row of documents."""
    scored = cross_entropy.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), stored=True)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "loss_difference")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults after the damage, cheapest repair and its digest, of every conversation."""
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every vector of embeddings, with the final codebooks' digest."""
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance_resampling, op2_near_dedup, op3_url_filters, op4_sentencepiece, op5_quality_rules, op6_training_order, op7_secret_scan, op8_html_extraction, op9_decontaminate, op10_cross_entropy, op11_token_counts, op12_conversation_repair, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": url_filters.ORACLE_SQL, "op12_conversation_repair": conversation_repair.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
