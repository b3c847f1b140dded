"""Mapping: segments, seeds and the fault-tolerant choice of candidate buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators.index import postings
from strandlake.params import Params


def segments(reads: DataFrame, p: Params) -> DataFrame:
    """(read_id, seg_off, seg_len, read_len, seq, qual): one segment, or G spread over a read of more than 2 L."""
    n = F.length("seq")
    starts = F.when(n > 2 * p.L, S.sampler(p.G, n - p.L - 1)).otherwise(F.array(F.lit(0).cast("long")))
    cut = reads.select("read_id", n.alias("read_len"), "seq", "qual", F.explode(F.transform(F.array_distinct(starts), lambda x: x.cast("int"))).alias("seg_off"))
    piece = lambda c: F.substring(c, F.col("seg_off") + 1, F.lit(p.L))
    return cut.select("read_id", "seg_off", "read_len", piece("seq").alias("seq"), piece("qual").alias("qual")).withColumn("seg_len", F.length("seq"))


def good_kmers(segs: DataFrame, p: Params, shape: str | None = None) -> DataFrame:
    """Adds ``good``: (pos, kmer) of the k-mers whose qualities sum to b * k or more, in order.

    With a gapped ``shape`` of length k, only the bases under its ones count, and b times their number is asked.
    """
    if shape is not None and len(shape) != p.k:
        raise ValueError(f"a shape of length {p.k} is needed")
    sums = S.window_sums(S.phred("qual"), p.k) if shape is None else S.shaped_sums(S.phred("qual"), shape)
    both = F.arrays_zip(S.positions(F.length("seq") - (p.k - 1)).alias("pos"), S.kmer_codes("seq", p.k).alias("kmer"), sums.alias("quality"))
    kept = F.filter(both, lambda x: x["quality"] >= p.b * (p.k if shape is None else shape.count("1")))
    return segs.withColumn("good", F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["kmer"].alias("kmer"))))


def distinguishable(segs: DataFrame, common: DataFrame, p: Params) -> DataFrame:
    """Keeps the good k-mers with an indexed q-gram that is rare; ``common``: the q-grams that are not.

    k-mers are exploded and judged once each, so no list of q-grams is broadcast.
    """
    kmers = segs.select(F.explode("good.kmer").alias("kmer")).distinct()
    grams = kmers.select("kmer", F.explode(S.subcodes("kmer", p.k, p.q)).alias("qgram"))
    grams = grams.where(S.sampled("qgram", p.f)) if p.f < 1 else grams
    passing = grams.join(common, "qgram", "left_anti").select("kmer").distinct()
    flat = segs.select("read_id", "seg_off", F.posexplode("good").alias("at", "g")).select("read_id", "seg_off", F.col("g.pos").alias("pos"), F.col("g.kmer").alias("kmer"))
    kept = flat.join(passing, "kmer", "left_semi").groupBy("read_id", "seg_off").agg(F.array_sort(F.collect_list(F.struct("pos", "kmer"))).alias("good"))
    return segs.drop("good").join(kept, ["read_id", "seg_off"])


def seeds(segs: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """(read_id, seg_off, ord, pos, kmer): n of the good k-mers, evenly spread; duplicates keep their ordinals.

    Segments with fewer than ``least`` * n good k-mers have none.
    """
    enough = segs.where((F.size("good") > 0) & (F.size("good") >= F.lit(least * n)))
    picked = F.transform(S.sampler(n, F.size("good") - 1), lambda i: F.element_at(F.col("good"), (i + 1).cast("int")))
    return enough.select("read_id", "seg_off", F.posexplode(picked).alias("ord", "s")).select("read_id", "seg_off", "ord", F.col("s.pos").alias("pos"), F.col("s.kmer").alias("kmer"))


def both_strands(rows: DataFrame, p: Params) -> DataFrame:
    """The seeds, and those of the reverse complement."""
    return rows.withColumn("is_original", F.lit(True)).unionByName(rows.withColumn("kmer", S.revcomp_code("kmer", p.k)).withColumn("is_original", F.lit(False)))


def kmer_buckets(kmers: DataFrame, indexed: DataFrame, df: DataFrame, p: Params) -> DataFrame:
    """(kmer, bucket_id): the buckets that hold every indexed q-gram of a k-mer.

    Each distinct k-mer joins the postings by its rarest q-gram alone; what it finds is then held against the
    postings of its other q-grams, the rarer first, by semi-joins on (qgram, bucket_id). So a frequent q-gram
    costs nothing where a rarer stands beside it, and only pairs of numbers are moved.
    """
    grams = kmers.select("kmer", F.explode(S.subcodes("kmer", p.k, p.q)).alias("qgram"))
    grams = grams.where(S.sampled("qgram", p.f)) if p.f < 1 else grams
    rarest_first = F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "qgram")))
    known = grams.join(df, "qgram", "left").groupBy("kmer").agg(rarest_first.alias("g")).where(F.col("g")[0]["df"] > 0).select("kmer", F.col("g.qgram").alias("g"))
    n = p.k - p.q + 1
    known = known.withColumn("g", F.concat("g", F.array_repeat(F.element_at("g", -1), F.lit(n) - F.size("g"))))  # a k-mer with fewer has its last again
    posted = postings(indexed)
    found = posted.join(known.withColumn("qgram", F.col("g")[0]), "qgram").select("kmer", "bucket_id", "g")
    for i in range(1, n):
        found = found.withColumn("qgram", F.col("g")[i]).join(posted, ["qgram", "bucket_id"], "left_semi").select("kmer", "bucket_id", "g")
    return found.select("kmer", "bucket_id")


def candidates(rows: DataFrame, found: DataFrame, p: Params) -> DataFrame:
    """(read_id, seg_off, is_original, bucket_id, misses): the buckets with the fewest misses, all ties, if under F.

    A strand with more than C of them has none. rows: seeds of both strands; found: (kmer, bucket_id).
    """
    key = ["read_id", "seg_off", "is_original"]
    counted = rows.groupBy(*key, "kmer").agg(F.count(F.lit(1)).alias("m")).join(found, "kmer").groupBy(*key, "bucket_id").agg((F.lit(p.S) - F.sum("m")).alias("misses")).where(F.col("misses") < p.faults)
    best = counted.groupBy(*key).agg(F.min("misses").alias("misses"))
    top = counted.join(best, [*key, "misses"])
    allowed = top.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= p.C).drop("n")
    return top.join(allowed, key, "left_semi")
