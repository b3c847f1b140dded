"""Reports: FASTQ profiles, candidate statistics, SAM accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S


def fastq_profile(reads: DataFrame, least_quality: int = 25) -> DataFrame:
    """One row over all reads: counts, lengths, qualities, low-quality bases, estimated error rate."""
    q = S.phred("qual")
    total = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
    low = F.size(F.filter(q, lambda x: x < least_quality))
    errors = F.aggregate(q, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x / F.lit(-10.0)))
    per = reads.select(F.length("seq").cast("long").alias("n"), total.alias("t"), low.cast("long").alias("low"), errors.alias("err"))
    return per.agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum("n").alias("n_bases"), F.max("n").alias("max_length"), F.round(F.min(F.col("t") / F.col("n")), 6).alias("min_mean_quality"),
        F.round(F.sum("t") / F.sum("n"), 6).alias("mean_quality"), F.max("low").alias("max_low_bases"), F.round(F.avg("low"), 6).alias("avg_low_bases"), F.round(F.sum("err") / F.sum("n"), 9).alias("error_rate"),
    )


def candidate_stats(cands: DataFrame, n_reads: DataFrame) -> DataFrame:
    """One row: reads, reads with a candidate, and candidates per mapped read on each strand."""
    per_read = cands.groupBy("read_id").agg(F.count(F.when(F.col("is_original"), 1)).alias("fwd"), F.count(F.when(~F.col("is_original"), 1)).alias("rev"))
    whole = per_read.agg(F.count(F.lit(1)).alias("mapped"), F.coalesce(F.sum("fwd"), F.lit(0)).alias("fwd"), F.coalesce(F.sum("rev"), F.lit(0)).alias("rev"))
    return n_reads.agg(F.count(F.lit(1)).alias("n_reads")).join(F.broadcast(whole)).select("n_reads", "mapped", F.round(F.col("fwd") / F.col("mapped"), 6).alias("fwd_per_read"), F.round(F.col("rev") / F.col("mapped"), 6).alias("rev_per_read"))


def candidate_histogram(cands: DataFrame, reads: DataFrame) -> DataFrame:
    """(n_candidates, n_reads), reads without any included."""
    n = cands.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    return reads.select("read_id").join(n, "read_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_candidates")).agg(F.count(F.lit(1)).alias("n_reads"))


def candidate_recall(cands: DataFrame, truth: DataFrame, bucket: str = "true_bucket") -> DataFrame:
    """One row: reads, and reads with their true bucket among the candidates of the right strand."""
    right = cands.select("read_id", "is_original", "bucket_id").distinct()
    hit = truth.join(right.withColumnRenamed("bucket_id", bucket), ["read_id", "is_original", bucket], "left_semi")
    return truth.agg(F.count(F.lit(1)).alias("n_reads")).join(F.broadcast(hit.agg(F.countDistinct("read_id").alias("n_right"))))


def sam_report(sam: DataFrame, truth: DataFrame, tolerance: int = 5, by: str | None = None) -> DataFrame:
    """Accuracy of SAM rows against truth (qname, flag, rname, pos, is_random): one row, or with ``by`` one for each value of a SAM column.

    A row is usable if its read is known and it is mapped; acceptable if a truth of its read has its strand and
    contig and lies within ``tolerance``. ``mapped`` counts unique reads, random ones too, over the real reads. A read is unique without a
    second usable row. Two levels of aggregation, by read and then over all; what depends on the truth alone is counted once.
    """
    own = [by] if by else []
    known = truth.groupBy("qname").agg(F.max(F.col("is_random").cast("int")).alias("is_random"), F.count(F.lit(1)).alias("n_truth"))
    usable = sam.where(F.col("flag").bitwiseAND(4) == 0)
    t = truth.where(~F.col("is_random")).select(F.col("qname").alias("tq"), F.col("flag").alias("tf"), F.col("rname").alias("tr"), F.col("pos").alias("tp")).distinct()
    on = (F.col("qname") == F.col("tq")) & (F.col("flag").bitwiseAND(16) == F.col("tf").bitwiseAND(16)) & (F.col("rname") == F.col("tr")) & (F.abs(F.col("pos") - F.col("tp")) <= tolerance)
    per_read = usable.groupBy(*own, "qname").agg(F.count(F.lit(1)).alias("n_rows"))
    right = usable.join(t, on, "left_semi").groupBy(*own, "qname").agg(F.count(F.lit(1)).alias("n_right"))
    rows = per_read.join(right, [*own, "qname"], "left").join(known, "qname").withColumn("n_right", F.coalesce("n_right", F.lit(0)))
    real = F.col("is_random") == 0
    once = (F.col("n_rows") == 1) & real
    sums = rows.groupBy(*own).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.when(F.col("n_rows") == 1, 1)).alias("n_mapped"), F.count(F.when(once & (F.col("n_right") > 0), 1)).alias("n_unique_right"),
        F.count(F.when(~real & (F.col("n_rows") > 0), 1)).alias("n_random_mapped"), F.coalesce(F.sum("n_right"), F.lit(0)).alias("n_right"),
    )
    if by:  # files without a usable row
        sums = sam.select(by).distinct().join(sums, by, "left").fillna(0, ["n_rows", "n_mapped", "n_unique_right", "n_random_mapped", "n_right"])
    whole = known.agg(F.count(F.when(real, 1)).alias("n_reads"), F.count(F.when(~real, 1)).alias("n_random"), F.count(F.when(real & (F.col("n_truth") == 1), 1)).alias("n_one_truth"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return sums.crossJoin(F.broadcast(whole)).select(  # one row
        *own, "n_reads", "n_rows", ratio("n_mapped", "n_reads").alias("mapped"), ratio("n_unique_right", "n_one_truth").alias("sensitivity"), ratio("n_random_mapped", "n_random").alias("false_positive"), ratio("n_rows", "n_mapped").alias("locations_per_read"), ratio("n_right", "n_rows").alias("precision"),
    )


def locator_accuracy(sam: DataFrame, truth: DataFrame, almost: int = 5) -> DataFrame:
    """One row over reads (name, ref_ord, pos, is_rev): located ones, with a location on the right contig and strand, exactly and
    almost at the right place, and the mean distance of the nearest one."""
    placed = sam.select(F.col("qname").alias("name"), F.col("rname").alias("ref_ord"), (F.col("flag").bitwiseAND(16) != 0).alias("is_rev"), F.col("pos").alias("at"))
    some = placed.select("name").distinct().withColumn("located", F.lit(True))
    near = placed.join(truth, ["name", "ref_ord", "is_rev"]).groupBy("name").agg(F.min(F.abs(F.col("at") - F.col("pos"))).alias("off"))
    reads = truth.select("name").join(some, "name", "left").join(near, "name", "left")
    return reads.agg(
        F.count(F.lit(1)).alias("n_reads"), F.count("located").alias("n_located"), F.count("off").alias("n_right_contig"), F.count(F.when(F.col("off") == 0, 1)).alias("n_exact"),
        F.count(F.when(F.col("off") <= almost, 1)).alias("n_almost"), F.round(F.avg("off"), 6).alias("mean_offset"),
    )


def bucket_accuracy(found: DataFrame, truth: DataFrame, indel: int) -> DataFrame:
    """One row over located buckets (read_id, bucket_id, offset) and where reads come from (read_id, true_bucket, true_offset).

    Locations in the true bucket, the mean error of their offsets, those within ``indel`` of it, and such of reads with no other location;
    and reads by their number of locations.
    """
    per = found.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    right = found.join(truth, "read_id").where(F.col("bucket_id") == F.col("true_bucket")).join(per, "read_id")
    off = F.abs(F.col("offset") - F.col("true_offset"))
    hits = right.agg(
        F.count(F.lit(1)).alias("n_right_bucket"), F.round(F.avg(off), 6).alias("mean_offset_error"), F.count(F.when(off <= indel, 1)).alias("n_almost"),
        F.count(F.when((off <= indel) & (F.col("n") == 1), 1)).alias("n_unique_right"),
    )
    n = F.coalesce("n", F.lit(0))
    reads = truth.select("read_id").join(per, "read_id", "left").agg(
        F.count(F.lit(1)).alias("n_reads"), F.round(F.avg(n), 6).alias("buckets_per_read"), F.count(F.when(n == 0, 1)).alias("n_none"), F.count(F.when(n == 1, 1)).alias("n_unique"),
        F.count(F.when((n > 0) & (n <= 5), 1)).alias("n_upto_5"), F.count(F.when((n > 0) & (n <= 10), 1)).alias("n_upto_10"),
    )
    return reads.crossJoin(F.broadcast(hits))  # one row each


def uniqueness(answer: DataFrame, test: DataFrame) -> DataFrame:
    """(answer_unique, test_unique, n_reads): 2 x 2 contingency of reads with one row in each of two (read_id) tables."""
    one = lambda t, c: t.groupBy("read_id").agg((F.count(F.lit(1)) == 1).alias(c))
    both = one(answer, "a").join(one(test, "b"), "read_id", "full")
    return both.groupBy(F.coalesce("a", F.lit(False)).alias("answer_unique"), F.coalesce("b", F.lit(False)).alias("test_unique")).agg(F.count(F.lit(1)).alias("n_reads"))
