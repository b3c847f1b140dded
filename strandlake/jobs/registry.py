"""Registered queries of the sequence operators and their DuckDB twins.

All read ``documents`` whole. Tables that several steps of a job read (the bucket
index, segments, k-mer hits) are written once in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.jobs import store
from strandlake.operators import align, analysis, bitmap, dictionary, index, learn, locator, mapper, models
from strandlake.params import BUCKETS, DEFAULT, Params
from strandlake.sources import dna, formats
from strandlake.streaming import mapping

P = DEFAULT
#: A gapped shape of length k.
SHAPE = "110110111011"
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; in local mode, as in tests, one folder of our own for each application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _OWN_DIR[app] = _OWN_DIR.get(app) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_DIR[app]


def _new_path(spark: SparkSession, what: str) -> str:
    """A path for a table. All of an application lie in one folder, which can go when its results have been read."""
    return f"{shared_dir(spark)}/strandlake-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, rows_a_file: int = 0) -> DataFrame:
    """A table written in the shared folder, and read again. Of rows of some megabytes each has its file, as readers hold some thousand rows of a file."""
    spark = df.sparkSession
    path = _new_path(spark, what)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)  # a text of four letters takes some two bits a base
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _refs(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    return dna.refs(spark, sf, spread)


def _buckets(spark: SparkSession, sf: str, p: Params = P, spread: bool = False) -> DataFrame:
    return index.bucketize(_refs(spark, sf, spread), p)


def _reads(spark: SparkSession, sf: str, p: Params = P, spread: bool = False) -> DataFrame:
    return dna.reads(_refs(spark, sf, spread), p)


def _distinct_ids(spark: SparkSession, sf: str) -> bool:
    """Whether each contig is one row of the table, so that its counts, and its buckets', are whole where it is."""
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("doc_id").count().where("count > 1").isEmpty()


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf).select("ref_ord", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


def bucketize(spark: SparkSession, sf: str) -> DataFrame:
    return _buckets(spark, sf).select("bucket_id", "ref_ord", "idx", "ref_offset", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


def bucket_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return index.dense_ids(_buckets(spark, sf).drop("seq")).select("bucket_id", "ordinal")


def genome_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("seq")
    return _refs(spark, sf).agg(F.count(F.lit(1)).alias("n_refs"), F.sum(n).cast("long").alias("n_bases"), F.sum(F.ceil(n / F.lit(P.B))).cast("long").alias("n_slices"), F.max(n).cast("long").alias("longest"))


def qgram_df(spark: SparkSession, sf: str) -> DataFrame:
    return index.qgram_df(_buckets(spark, sf, spread=True), P)


def bucket_postings(spark: SparkSession, sf: str) -> DataFrame:
    b = index.with_qgrams(_buckets(spark, sf, spread=True), P)
    return b.select("bucket_id", F.size("qgrams").cast("long").alias("n_distinct"), F.array_min("qgrams").alias("least"), F.array_max("qgrams").alias("most"), F.md5(F.concat_ws(",", "qgrams")).alias("digest"))


def frac_min_hash(spark: SparkSession, sf: str) -> DataFrame:
    grams = index.qgram_df(_buckets(spark, sf, spread=True), P).select("qgram")
    return grams.select("qgram", S.frac_min_hash("qgram").alias("hash"), S.sampled("qgram", 0.25).alias("kept"))


def distinguishability(spark: SparkSession, sf: str) -> DataFrame:
    b = stored(_buckets(spark, sf, spread=True).select("bucket_id", "seq"), "buckets")
    n = b.count()
    df = index.qgram_df(b, P)
    zeros = F.lit(n) - F.col("df")
    return df.agg(F.count(F.lit(1)).alias("n_qgrams"), F.count(F.when(zeros >= int(P.d * n), 1)).alias("n_rare"), F.count(F.when(zeros > int(P.d * n), 1)).alias("n_rare_strict"), F.max("df").alias("most"))


def simulated_reads(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf)


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return mapper.segments(_reads(spark, sf), P).select("read_id", "seg_off", "seg_len", "read_len", "seq")


def good_kmers(spark: SparkSession, sf: str) -> DataFrame:
    g = mapper.good_kmers(mapper.segments(_reads(spark, sf, spread=True), P), P)
    return g.select("read_id", "seg_off", F.size("good").cast("long").alias("n_good"), F.concat_ws(",", "good.pos").alias("places"), F.concat_ws(",", "good.kmer").alias("kmers"))


def locating_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return locator.locating_seeds(mapper.segments(_reads(spark, sf), P), P)


def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    r = _reads(spark, sf, spread=True)
    first = F.substring("seq", 1, P.k)
    every = S.kmer_codes("seq", P.k)
    code = S.encode(first)
    return r.select("read_id", code.alias("code"), S.revcomp_code(code, P.k).alias("rc_code"), S.canonical(code, P.k).alias("canonical"), S.decode(code, P.k).alias("decoded"), S.revcomp("seq").alias("rc_seq"), F.to_json(S.subcodes(code, P.k, P.q)).alias("subcodes"),
        F.md5(F.concat_ws(",", F.transform(every, lambda c: S.canonical(c, P.k)))).alias("canonical_digest"), F.md5(F.concat_ws(",", F.reverse(F.transform(every, lambda c: S.revcomp_code(c, P.k))))).alias("rc_digest"))


def _mapped(spark: SparkSession, sf: str, p: Params = P) -> dict[str, DataFrame]:
    """Everything up to the candidates."""
    refs = stored(_refs(spark, sf, spread=True), "refs")
    buckets = stored(index.bucketize(refs, p).select("bucket_id", "seq"), "buckets")
    reads = stored(dna.reads(refs, p), "reads")
    discard(refs)
    segs = mapper.segments(reads, p)
    n = buckets.count()
    common = index.common_flags(index.qgram_df(buckets, p), n, p)
    seeds = stored(bitmap.packed_seeds(bitmap.picked_seeds(segs, common, p), p), "seeds", 1)
    n_seeds = seeds.select(F.coalesce(F.sum(F.size("read_ids")), F.lit(0)).alias("n")).first().n
    found = bitmap.packed_matches(buckets, seeds, n_seeds, p)
    return {"buckets": buckets, "reads": reads, "segs": segs, "found": found, "cands": bitmap.candidates(found, p)}


def candidate_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: candidate buckets of every segment of every read, on both strands."""
    return _mapped(spark, sf)["cands"].select("read_id", "seg_off", "is_original", "bucket_id", "misses")


def candidate_levels(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.levels(_mapped(spark, sf)["found"], P)


def candidate_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = _mapped(spark, sf)
    return analysis.candidate_stats(stored(m["cands"], "cands"), m["reads"].select("read_id"))


def candidate_histogram(spark: SparkSession, sf: str) -> DataFrame:
    m = _mapped(spark, sf)
    return analysis.candidate_histogram(m["cands"], m["reads"])


def _truth(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", (~F.col("is_rev")).alias("is_original"), (F.col("ref_ord") * BUCKETS + F.floor(F.col("pos") / P.B)).alias("true_bucket"))


def mapping_recall(spark: SparkSession, sf: str) -> DataFrame:
    m = _mapped(spark, sf)
    return analysis.candidate_recall(m["cands"], _truth(m["reads"]))


def unmapped_reads(spark: SparkSession, sf: str) -> DataFrame:
    m = _mapped(spark, sf)
    return m["reads"].select("read_id", "name").join(m["cands"].select("read_id"), "read_id", "left_anti")


def _located(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    m = _mapped(spark, sf)
    m["locations"] = stored(locator.locations(m["cands"], m["segs"], m["buckets"], P), "locations")
    m["merged"] = locator.merge_locations(m["locations"], m["reads"].select("read_id", F.length("seq").alias("read_len")), P)
    return m


def locations(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf)["locations"]


def best_locations(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf)["merged"]


def sam(spark: SparkSession, sf: str) -> DataFrame:
    m = _located(spark, sf)
    return locator.sam_rows(m["merged"], m["reads"], P)


def sam_report(spark: SparkSession, sf: str) -> DataFrame:
    m = _located(spark, sf)
    truth = m["reads"].select(F.col("name").alias("qname"), F.when(F.col("is_rev"), 16).otherwise(0).alias("flag"), F.col("ref_ord").alias("rname"), "pos", F.lit(False).alias("is_random"))
    return analysis.sam_report(stored(locator.sam_rows(m["merged"], m["reads"], P), "sam"), truth)


def fastq_profile(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.fastq_profile(_reads(spark, sf), P.b)


def kmer_profile(spark: SparkSession, sf: str) -> DataFrame:
    return models.canonical_profile(_refs(spark, sf, spread=True), "ref_ord", 4)


def gapped_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return models.gapped_counts(_buckets(spark, sf, spread=True), "bucket_id", [0, 2, 3, 5], whole=_distinct_ids(spark, sf))


def frequency_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.frequency_model(_refs(spark, sf, spread=True), "ref_ord", 5, whole=_distinct_ids(spark, sf)).select("ref_ord", "kmer", F.round("logp", 6).alias("logp"))


def frequency_model_spread(spark: SparkSession, sf: str) -> DataFrame:
    return models.frequency_model(_refs(spark, sf, spread=True), "ref_ord", 4, rate=0.01, whole=_distinct_ids(spark, sf)).select("ref_ord", "kmer", F.round("logp", 6).alias("logp"))


def markov_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.markov_model(_refs(spark, sf, spread=True), "ref_ord", 4, whole=_distinct_ids(spark, sf)).select("ref_ord", "prefix", "base", F.round("logp", 6).alias("logp"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Of every read its true contig's score and the best other, from tables of counts that blocks of contigs and reads are held against."""
    refs = stored(_refs(spark, sf, spread=True), "refs")
    reads = dna.reads(refs, P).select("read_id", F.col("ref_ord").alias("truth"), F.when(F.col("is_rev"), S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"))
    packed = stored(models.packed_counts(refs, "ref_ord", P.q), "contigs", 1)
    asked = stored(models.packed_counts(reads, "read_id", P.q), "queries", 1)
    discard(refs)
    n = asked.select(F.coalesce(F.sum(F.length("kmers")), F.lit(0)).alias("n")).first().n // (4 if P.q <= 15 else 8)
    return models.best_scores(models.block_scores(packed, asked, P.q, n))


def classified_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Each read's most likely contig by 9-mer frequencies."""
    if _distinct_ids(spark, sf):
        best = F.greatest("o", F.when(F.col("hit").isNotNull(), F.struct(F.col("hit").alias("score"), (-F.col("truth")).alias("neg"))))
        return _scores(spark, sf).select(F.col("query").alias("read_id"), best.alias("best")).select("read_id", (-F.col("best.neg")).alias("ref_ord"), F.col("best.score").alias("score"))
    model = models.frequency_model(_refs(spark, sf, spread=True), "ref_ord", P.q)
    reads = _reads(spark, sf).select("read_id", F.when(F.col("is_rev"), S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"))
    return models.classify(model, models.kmers(reads, "read_id", P.q), "ref_ord", "read_id")


def _similar(seqs: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """Similar pairs of the distinct sets of sequences with a row each: sets are told apart by their hashes, and packed once."""
    ids = stored(models.kmer_sets(seqs, key, k, ids_alone=True), "ids")
    first = ids.groupBy("id_a", "id_b").agg(F.min(key).alias(key)).select(key)
    packed = stored(models.packed_sets(seqs.select(key, "seq").join(first, key, "left_semi"), key, k), "packed", 1)
    n = packed.select(F.coalesce(F.sum(F.length("steps")), F.lit(0)).alias("n")).first().n // (4 if k <= 15 else 8)
    return models.similar_sets(packed, k, least, n)


def contig_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct k-mer sets with a similarity of half or more, by the least contig of each set."""
    if _distinct_ids(spark, sf):
        return _similar(stored(_refs(spark, sf, spread=True), "refs"), "ref_ord", 14, 0.5)
    sets = stored(models.kmer_sets(_refs(spark, sf, spread=True), "ref_ord", 14), "sets")
    return models.jaccard(stored(models.representatives(sets, "ref_ord").select("ref_ord", "s"), "distinct"), "ref_ord", 0.5)


def contig_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Every contig with the least contig that has the same canonical k-mers."""
    sets = models.kmer_sets(_refs(spark, sf, spread=True), "ref_ord", 14, ids_alone=True)
    return models.members(stored(sets, "sets"), "ref_ord")


def locator_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How far the best locations lie from where the reads were cut."""
    m = _located(spark, sf)
    return analysis.locator_accuracy(locator.sam_rows(m["merged"], m["reads"], P), m["reads"].select("name", "ref_ord", "pos", "is_rev"))


def bucket_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical 3-mers of every bucket."""
    return models.canonical_profile(_buckets(spark, sf, spread=True), "bucket_id", 3)


def bucket_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the best locations are in the buckets that the reads were cut from, and how far off."""
    m = _located(spark, sf)
    place = F.floor(F.col("pos") / P.B)
    truth = m["reads"].select("read_id", (F.col("ref_ord") * BUCKETS + place).alias("true_bucket"), (F.col("pos") - place * P.B).alias("true_offset"))
    return analysis.bucket_accuracy(stored(m["merged"], "merged"), truth, P.indel)


def sam_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Every location of every read, aligned: SAM rows with CIGARs of those with a mapping quality of 40 or more."""
    m = _located(spark, sf)
    return align.aligned_rows(m["locations"], m["reads"], m["buckets"], P)


def sampled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by an index of a quarter of the q-grams: a k-mer without any of them is a hit in every bucket."""
    return _mapped(spark, sf, replace(P, f=0.25))["cands"].select("read_id", "seg_off", "is_original", "bucket_id", "misses")


def sam_report_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """The report of several SAM files read back from one folder: best locations and all locations."""
    m = _located(spark, sf)
    refs = _refs(spark, sf).select(F.col("ref_ord").cast("string").alias("ref_id"), "seq")
    path = _new_path(spark, "sam")
    for name, found in (("best", m["merged"]), ("every", m["locations"])):
        formats.write_sam(locator.sam_rows(found, m["reads"], P), refs, f"{path}/{name}.sam")
    read = formats.read_sam(spark, f"{path}/*.sam").withColumn("mapper", F.regexp_extract("file", r"/(\w+)\.sam/[^/]*$", 1)).withColumn("pos", F.col("pos") - 1)
    truth = m["reads"].select(F.col("name").alias("qname"), F.when(F.col("is_rev"), 16).otherwise(0).alias("flag"), F.col("ref_ord").cast("string").alias("rname"), "pos", F.lit(False).alias("is_random"))
    return analysis.sam_report(read, truth, by="mapper")


def unique_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with one location among the best against reads with one candidate bucket."""
    m = _located(spark, sf)
    return analysis.uniqueness(m["merged"].select("read_id"), m["cands"].select("read_id", "bucket_id").distinct().select("read_id"))


def gapped_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality sums under a gapped shape of every window of every segment, and the k-mers that pass by them."""
    segs = mapper.good_kmers(mapper.segments(_reads(spark, sf, spread=True), P), P, SHAPE)
    return segs.select("read_id", "seg_off", F.to_json(S.shaped_sums(S.phred("qual"), SHAPE)).alias("sums"), F.to_json("good.pos").alias("good"))


def kmer_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of every contig by the slots of the dictionary of all canonical 5-mers; digits of the texts are unknown bases."""
    return dictionary.slot_profile(dna.refs(spark, sf, spread=True, unknown=True), "ref_ord", 5).select("ref_ord", "slot", "n", F.round("share", 9).alias("share"))


def kmer_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ids of all canonical 9-mers of the buckets, by first appearance; published as a version and loaded again."""
    base = _new_path(spark, "models")
    store.publish(dictionary.seen_kmers(_buckets(spark, sf, spread=True), P.q), base, "dictionary", {"k": P.q, "B": P.B, "L": P.L})
    return store.load(spark, base, "dictionary", {"k": P.q})


def bucket_frequency_model(spark: SparkSession, sf: str) -> DataFrame:
    """5-mer frequencies of every bucket; published as a version and loaded again."""
    base = _new_path(spark, "models")
    store.publish(models.frequency_model(_buckets(spark, sf, spread=True), "bucket_id", 5, whole=_distinct_ids(spark, sf)), base, "frequency", {"k": 5, "prior": 0.001})
    return store.load(spark, base, "frequency", {"k": 5, "prior": 0.001}).select("bucket_id", "kmer", F.round("logp", 6).alias("logp"))


def bucket_markov_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.markov_model(_buckets(spark, sf, spread=True), "bucket_id", 3, whole=_distinct_ids(spark, sf)).select("bucket_id", "prefix", "base", F.round("logp", 6).alias("logp"))


def bucket_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of buckets whose distinct 14-mers have a similarity of half or more, by the least bucket of each set."""
    if _distinct_ids(spark, sf):
        return _similar(stored(_buckets(spark, sf, spread=True).select("bucket_id", "seq"), "buckets"), "bucket_id", 14, 0.5)
    sets = stored(models.kmer_sets(_buckets(spark, sf, spread=True), "bucket_id", 14), "sets")
    return models.jaccard(stored(models.representatives(sets, "bucket_id").select("bucket_id", "s"), "distinct"), "bucket_id", 0.5)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    if _distinct_ids(spark, sf):
        return learn.judged(_scores(spark, sf), "read_id")
    model = stored(models.frequency_model(_refs(spark, sf, spread=True), "ref_ord", P.q), "model")
    reads = _reads(spark, sf, spread=True).select("read_id", F.when(F.col("is_rev"), S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"), "ref_ord")
    return learn.margins(model, models.kmers(reads, "read_id", P.q), reads.select("read_id", "ref_ord"), "ref_ord", "read_id")


def classification_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Log likelihood of every read's true contig, and the largest of all others."""
    return _judged(spark, sf)


def classification_harness(spark: SparkSession, sf: str) -> DataFrame:
    """Share of reads that the frequency model puts in their own contig, and its mean margin."""
    return learn.harness(_judged(spark, sf))


def profile_components(spark: SparkSession, sf: str) -> DataFrame:
    """Variance along the principal components of the buckets' canonical 3-mer profiles."""
    return learn.explained_variance(_buckets(spark, sf, spread=True), "bucket_id", 3)


def bucket_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out windows of each class of a trained classifier, and how many it puts in their own bucket."""
    buckets = stored(_buckets(spark, sf, spread=True).select("bucket_id", "seq"), "buckets")
    _, chosen, accuracy = learn.trained_classifier(buckets, P)
    return accuracy.join(chosen, "label").select("bucket_id", "n", "n_right")


def fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Contigs written as FASTA and read by record-aligned splits."""
    path = _new_path(spark, "fasta")
    formats.write_fasta(_refs(spark, sf).select(F.concat(F.lit("c"), "ref_ord").alias("ref_id"), "seq"), path)
    return formats.read_fasta(spark, path, 1 << 20).select("ref_id", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


def fastq_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written as FASTQ and read by record-aligned splits."""
    path = _new_path(spark, "fastq")
    formats.write_fastq(_reads(spark, sf), path)
    return formats.read_fastq(spark, path, 1 << 16).select("name", "seq", "qual")


def threshold_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinguishable q-grams at ten thresholds, written as logs and scraped from them."""
    buckets = stored(_buckets(spark, sf, spread=True).select("bucket_id", "seq"), "buckets")
    n = buckets.count()
    df = index.qgram_df(buckets, P)
    at = [i / 10 for i in range(10)]
    counts = df.agg(*(F.count(F.when(F.lit(n) - F.col("df") >= int(d * n), 1)).alias(f"n{i}") for i, d in enumerate(at))).first()
    path = _new_path(spark, "logs")
    for d, found in zip(at, counts, strict=True):  # ten small files
        lines = [(0, "[INFO] loading"), (1, f"[BENCHMARK] Number of Q-grams with distinguishability >= {d}: {found} q-grams"), (2, "[INFO] done")]
        spark.createDataFrame(lines, "i int, value string").coalesce(1).select("value").write.text(f"{path}/bucketmap_{d:g}_0_map.log")
    return formats.experiment_logs(spark, f"{path}/*").select("threshold", "n_qgrams")


def streamed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the reads as a stream of files, against a stored index."""
    base = _new_path(spark, "stream")
    _reads(spark, sf, spread=True).select("read_id", "name", "seq", "qual").write.parquet(f"{base}/reads")
    mapping.store_index(_refs(spark, sf, spread=True), P, f"{base}/index")
    mapping.map_stream(spark, f"{base}/reads", f"{base}/index", f"{base}/out", f"{base}/state", P).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("read_id", "seg_off", "is_original", "bucket_id", "misses")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            contigs, bucketize, bucket_ordinals, genome_stats, qgram_df, bucket_postings, frac_min_hash, distinguishability, simulated_reads, segments, good_kmers, locating_seeds, reverse_complement, candidate_buckets,
            candidate_levels, candidate_stats, candidate_histogram, mapping_recall, unmapped_reads, locations, best_locations, sam, sam_report, fastq_profile, kmer_profile, gapped_kmers, frequency_model,
            frequency_model_spread, markov_model, classified_reads, contig_jaccard, contig_sets, locator_accuracy, bucket_profile,
            bucket_accuracy, sam_aligned, sampled_candidates, sam_report_by_file, unique_reads, gapped_quality, kmer_slots, kmer_dictionary, bucket_frequency_model, bucket_markov_model, bucket_jaccard,
            classification_margins, classification_harness, profile_components, bucket_classifier, fasta_round_trip, fastq_round_trip, threshold_logs, streamed_candidates,
        )
    }


def oracle_sql() -> dict[str, str]:
    from strandlake.jobs import oracle

    return oracle.sql()
