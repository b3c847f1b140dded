"""Bucketing of contigs and the q-gram index over buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.params import BUCKETS, Params

#: q up to which a task counts into an array of all q-grams (4**11 counts are 32 MB); codes that are sorted together above it.
DENSE_Q, _RUN = 11, 1 << 22
#: Buckets whose q-grams are found together.
_ROWS = 1024


def bucketize(contigs: DataFrame, p: Params, extra: int = 0, keep_tail: bool = False) -> DataFrame:
    """(bucket_id, ref_ord, idx, ref_offset, seq): slices of B bases and an overlap of L + ``extra``.

    A last slice that is overlap alone is dropped, unless ``keep_tail``. Map-only.
    """
    n = F.length("seq")
    slices = contigs.select("ref_ord", "seq", F.explode(S.positions(F.ceil(n / F.lit(p.B)))).alias("idx"))
    start = F.col("idx") * p.B
    piece = F.substring("seq", start + 1, F.lit(p.B + p.L + extra))
    in_reach = F.when(F.col("idx") < BUCKETS, F.col("ref_ord") * BUCKETS + F.col("idx")).otherwise(F.raise_error(F.lit(f"a contig has over {BUCKETS} buckets; take a larger B")))
    out = slices.select(in_reach.cast("long").alias("bucket_id"), "ref_ord", F.col("idx").cast("long").alias("idx"), start.cast("long").alias("ref_offset"), piece.alias("seq"))
    return out if keep_tail else out.where(F.length("seq") > p.L)


def prefix_sums(counts: DataFrame, key: str, n: str, block: int = 4096) -> DataFrame:
    """(key, before): the sum of ``n`` over lesser keys, of which each occurs once. Sums within blocks of keys, then of blocks: the window
    without partition sees one row for ``block`` keys, a quarter of a million for a thousand million."""
    cut = counts.select(key, F.col(n).alias("n"), F.floor(F.col(key) / F.lit(block)).alias("block"))
    inner = cut.withColumn("within", F.sum("n").over(W.partitionBy("block").orderBy(key)) - F.col("n"))
    blocks = cut.groupBy("block").agg(F.sum("n").alias("m")).withColumn("base", F.sum("m").over(W.orderBy("block")) - F.col("m"))
    return inner.join(blocks, "block").select(key, (F.col("base") + F.col("within")).cast("long").alias("before"))


def dense_ids(buckets: DataFrame, block: int = 4096) -> DataFrame:
    """Adds ``ordinal``: the bucket's number in contig order, by prefix sums of the contigs' counts."""
    first = prefix_sums(buckets.groupBy("ref_ord").agg(F.count(F.lit(1)).alias("n")), "ref_ord", "n", block)
    rank = F.row_number().over(W.partitionBy("ref_ord").orderBy("idx")) - 1
    return buckets.withColumn("rank", rank).join(first, "ref_ord").withColumn("ordinal", (F.col("before") + F.col("rank")).cast("long")).drop("rank", "before")


def with_qgrams(buckets: DataFrame, p: Params) -> DataFrame:
    """Adds ``qgrams``, the distinct indexed q-grams of each bucket: no shuffle, as a bucket is one row."""
    codes = S.kmer_codes("seq", p.q, distinct=True)
    return buckets.withColumn("qgrams", F.filter(codes, lambda g: S.sampled(g, p.f)) if p.f < 1 else codes)


def postings(indexed: DataFrame) -> DataFrame:
    """(qgram, bucket_id), distinct."""
    return indexed.select(F.explode("qgrams").alias("qgram"), "bucket_id")


def qgram_df(buckets: DataFrame, p: Params) -> DataFrame:
    """(qgram, df): in how many buckets each q-gram occurs. Tasks count into an array of all q-grams where q allows (``DENSE_Q``), else into
    sorted runs of ``_RUN`` codes; what they have counted is summed by q-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(4**p.q, np.int64) if p.q <= DENSE_Q else None
        held, size = [], 0

        def rows(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["qgram", "df"])

        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                codes = S.window_codes(batch.column("seq").slice(low, _ROWS), p.q, distinct=True).flatten().to_numpy(zero_copy_only=False)
                if counts is not None:
                    counts += np.bincount(codes, minlength=len(counts))
                    continue
                held.append(codes)
                size += len(codes)
                if size >= _RUN:
                    yield rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if counts is not None:
            at = np.flatnonzero(counts)
            yield rows(at, counts[at])
        elif held:
            yield rows(*np.unique(np.concatenate(held), return_counts=True))

    found = buckets.select("seq").mapInArrow(run, "qgram long, df long").groupBy("qgram").agg(F.sum("df").alias("df"))
    return found.where(S.sampled("qgram", p.f)) if p.f < 1 else found


def common_qgrams(df: DataFrame, n_buckets: int, p: Params) -> DataFrame:
    """The q-grams that are not rare: fewer than trunc(d * N) buckets lack them. A q-gram in no bucket is rare."""
    return df.where(F.lit(n_buckets) - F.col("df") < F.lit(int(p.d * n_buckets))).select("qgram")


def common_flags(df: DataFrame, n_buckets: int, p: Params) -> np.ndarray:
    """The q-grams that are not rare, as ``bitmap.flags``; more than half the buckets or so have each, so they are few, and 4 ** q at most."""
    from strandlake.operators.bitmap import flags

    return flags(np.array([r.qgram for r in common_qgrams(df, n_buckets, p).collect()], np.int64), p.q)
