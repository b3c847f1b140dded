"""Dictionaries of canonical k-mers: dense ids, a slot for windows with other characters, profiles by slot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators.index import prefix_sums

#: Codes of the dictionary of all k-mers that are numbered together.
_STRETCH = 1 << 12


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """(kmer, slot) of every code of length k: both strands of a k-mer have one slot, numbered by first appearance in the codes' order.

    A canonical code is the lesser of its two, so its slot is the number of canonical codes before it: counts of stretches of codes,
    and their prefix sums. The slot for windows with other characters is ``size(k)``.
    """
    code = spark.range(4**k).select(F.col("id").alias("kmer"))
    canonical = code.where(F.col("kmer") <= S.revcomp_code("kmer", k)).withColumn("stretch", F.floor(F.col("kmer") / F.lit(_STRETCH)))
    base = prefix_sums(canonical.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")), "stretch", "n")
    within = F.row_number().over(W.partitionBy("stretch").orderBy("kmer")) - 1  # _STRETCH codes at most
    slots = canonical.withColumn("within", within).join(base, "stretch").select("kmer", (F.col("before") + F.col("within")).cast("long").alias("slot"))
    return slots.unionByName(slots.select(S.revcomp_code("kmer", k).alias("kmer"), "slot")).distinct()


def size(k: int) -> int:
    """Canonical k-mers of length k: half of all, and half as many again as are their own reverse complement (of even length alone)."""
    return (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2


def seen_kmers(buckets: DataFrame, k: int) -> DataFrame:
    """(kmer, slot, bucket_id, at) of every canonical k-mer of the buckets, numbered by first appearance in bucket order.

    Each bucket's new k-mers are counted, the counts are summed up in blocks, and k-mers are ranked within their
    bucket alone; no sort is global, and the slots don't depend on splits.
    """
    flat = buckets.select("bucket_id", F.posexplode(S.kmer_codes("seq", k)).alias("at", "code")).where("code is not null")
    first = flat.groupBy(S.canonical("code", k).alias("kmer")).agg(F.min(F.struct("bucket_id", "at")).alias("f")).select("kmer", "f.bucket_id", "f.at")
    base = prefix_sums(first.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n")), "bucket_id", "n")
    rank = F.row_number().over(W.partitionBy("bucket_id").orderBy("at")) - 1
    return first.withColumn("rank", rank).join(base, "bucket_id").select("kmer", (F.col("before") + F.col("rank")).cast("long").alias("slot"), "bucket_id", "at")


def slot_profile(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, slot, n, share): windows of each sequence by slot of ``all_kmers``, those with other characters in the slot ``size(k)``.

    Sequences are counted in arrays of ``size(k) + 1`` slots, some thousand sequences at a time; no window is ever a row.
    """
    kind = seqs.schema[key].dataType.simpleString()
    slots = size(k) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.arange(4**k)
        rc = np.zeros_like(code)
        for i in range(k):
            rc = rc << 2 | 3 - (code >> 2 * i & 3)
        least = np.minimum(code, rc)
        table = np.append((np.cumsum(code == least) - 1)[least], slots - 1)
        step = max(1, (1 << 22) // slots)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists = S.window_codes(part.column("seq"), k)
                codes = lists.values.to_numpy(zero_copy_only=False)
                codes = np.where(np.isnan(codes), len(code), codes).astype(np.int64) if codes.dtype.kind == "f" else codes
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                n = np.bincount(row * slots + table[codes], minlength=part.num_rows * slots)
                at = np.flatnonzero(n)
                total = n.reshape(part.num_rows, slots).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at // slots)), pa.array(at % slots), pa.array(n[at]), pa.array(n[at] / total[at // slots])], names=[key, "slot", "n", "share"])

    return seqs.select(key, "seq").mapInArrow(run, f"{key} {kind}, slot long, n long, share double")
