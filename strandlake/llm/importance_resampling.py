"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of the target text and one of
the raw corpus, give every document an importance weight: the log ratio of its
probability under both. Documents are then sampled without replacement in
proportion to their weights, by Gumbel top-k: the k largest ``weight + noise``.

The raw model counts every n-gram of every document. The target model counts the
documents that the labels call good; of their ids at most ``max_target`` are used,
the smallest by a seeded hash (a documented bound: the ids are broadcast). The
weight of a text is the log of the ratio of its probabilities under both models:
the sum over its n-grams. ``k`` is the labels' good share of all rows, unless given. Noise is a hash of seed, doc_id and text, so a rerun or a lost
executor gives the same sample.

Models are two arrays of ``buckets`` counts, summed per task before they are
shuffled. The k-th largest key is found by exact histogram refinement: no global
sort, nothing but bin counts reaches the driver.

Defined results: null and empty texts have no n-grams and weight 0 with no
evidence: they are never kept. Texts of any length count whole, in time linear in
their length. Extra columns are ignored, whatever their names. Repeated rows share one key and are kept or dropped
together, as are all rows with the k-th largest key, so ties may keep more than k.
An empty table gives an empty result. Without labels all weights are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

BUCKETS = 1 << 16
MAX_TARGET = 20_000
SMOOTHING = 1.0
BINS = 4096
WIDTH = 1024


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of words."""
    words = common.split_words(texts)
    h = words.hashes()
    doc = words.doc_of()
    if len(h) < 2:
        return doc, (h % common.U64(buckets)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = common.mix(h[:-1] * common.U64(0x9E3779B97F4A7C15) + h[1:])
    same = doc[:-1] == doc[1:]
    return np.concatenate([doc, doc[:-1][same]]), (np.concatenate([h, pair[same]]) % common.U64(buckets)).astype(np.int64)


def _target_ids(labels: DataFrame, max_target: int, seed: int) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_target)


def ngram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_target: int = MAX_TARGET, seed: int = 7) -> np.ndarray:
    """Counts [2, buckets] of all documents and of the target's; 2 * ``buckets`` numbers reach the driver."""
    target = F.broadcast(_target_ids(labels, max_target, seed).withColumn("__target", F.lit(True)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(target, "doc_id", "left").select("text", F.coalesce("__target", F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in common.text_chunks(batch):
                doc, bucket = ngram_buckets(part.column("text"), buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                chosen = np.asarray(part.column("target").to_pylist(), bool)
                total[1] += np.bincount(bucket[chosen[doc]], minlength=buckets)
        if total.any():
            yield common.block_rows(total.reshape(-1), WIDTH)

    return common.sum_blocks(rows.mapInArrow(run, common.BLOCKS), 2 * buckets, WIDTH).reshape(2, buckets)


def log_ratio(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability of each bucket; 0 everywhere without a target."""
    if not counts[1].any():
        return np.zeros(counts.shape[1])
    p = counts + smoothing * np.maximum(counts[:1] / max(1, counts[0].sum()) * counts.shape[1], 1e-3)  # smoothed towards the raw shares
    p = p / p.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, n_grams, log_weight, sample_key) of every row; null sample_key without n-grams."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    buckets = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_chunks(batch):
                doc, bucket = ngram_buckets(part.column("text"), buckets)
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.bincount(doc, shared.value[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(total.astype(np.float64))], names=["doc_id", "text_hash", "n_grams", "log_weight"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    gumbel = -F.log(-F.log(uniform))
    return made.withColumn("sample_key", F.when(F.col("n_grams") > 0, F.col("log_weight") + gumbel))


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = BINS) -> float | None:
    """The k-th largest value of a column, by repeated exact histograms of at most ``bins`` bins."""
    if k <= 0:
        return None
    present = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("x"))
    low, high, n = present.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        return None
    if k >= n:
        return low
    rest = k
    while low < high:
        step = (high - low) / bins
        inside = present.where(F.col("x").between(low, high))
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(step))).cast("int") if step > 0 else F.lit(0)
        counts = inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # at most ``bins`` rows
        for row in sorted(counts, key=lambda r: -r.at):
            if rest <= row.n:
                low, high = row.lo, row.hi
                break
            rest -= row.n
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, max_target: int = MAX_TARGET, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key and ``kept`` of every row."""
    docs, labels = common.only(docs, "doc_id", "text"), common.only(labels, "doc_id", "quality")
    ratio = log_ratio(ngram_counts(docs, labels, buckets, max_target, seed))
    keyed = common.written(weights(docs, ratio, seed), "importance")
    if k is None:
        n, good, of = keyed.count(), *labels.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("quality")).first()
        k = round(n * (good or 0) / of) if of else n
    threshold = kth_largest(keyed, "sample_key", k)
    kept = F.lit(False) if threshold is None else F.coalesce(F.col("sample_key") >= F.lit(threshold), F.lit(False))
    return keyed.withColumn("kept", kept).drop("text_hash")
