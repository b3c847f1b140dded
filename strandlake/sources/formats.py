"""Readers and writers of sequence file formats, as DataFrames of any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources import records


def _numbered_lines(spark: SparkSession, path: str, split_bytes: int = records.SPLIT_BYTES) -> DataFrame:
    """(i, value): lines in file order."""
    return records.with_ordinals(records.load(spark, "numbered_lines", path, split_bytes), "i").select("i", "value")


def read_fasta(spark: SparkSession, path: str, split_bytes: int = records.SPLIT_BYTES) -> DataFrame:
    """(ref_ord, ref_id, seq): records parted by ``>``; blank lines and N are dropped, bases upper-cased."""
    return records.with_ordinals(records.load(spark, "fasta", path, split_bytes), "ref_ord").select("ref_ord", F.col("header").alias("ref_id"), "seq")


def write_fasta(refs: DataFrame, path: str) -> None:
    refs.select(F.concat(F.lit(">"), "ref_id", F.lit("\n"), "seq").alias("value")).write.text(path)


def name_ordinals(refs: DataFrame) -> DataFrame:
    """(name, ref_ord): names cut at the first slash or blank; of equal names the last counts."""
    return refs.groupBy(F.regexp_extract("ref_id", r"^([^/\s]*)", 1).alias("name")).agg(F.max("ref_ord").alias("ref_ord"))


def read_fastq(spark: SparkSession, path: str, split_bytes: int = records.SPLIT_BYTES) -> DataFrame:
    """(read_id, name, seq, qual) of four-line records."""
    return records.with_ordinals(records.load(spark, "fastq", path, split_bytes), "read_id").select("read_id", "name", "seq", "qual")


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, rname, pos, mapq, cigar, seq, qual, file) of alignment lines; names are normalised."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    return rows.select(read_name(f[0]).alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("long").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), F.input_file_name().alias("file"))


def write_sam(rows: DataFrame, refs: DataFrame, path: str) -> None:
    """Lines of a SAM file, headers with the contigs' true lengths in its first file; ``pos`` is written 1-based.

    Reads stay in their partitions, one file each; files in the order of their names are the whole.
    """
    header = refs.select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "ref_id"), F.concat(F.lit("LN:"), F.length("seq"))).alias("value"))
    cigar = F.col("cigar") if "cigar" in rows.columns else F.lit("*")
    body = rows.select(F.concat_ws("\t", "qname", "flag", "rname", F.col("pos") + 1, "mapq", cigar, F.lit("*"), F.lit(0), F.lit(0), "seq", "qual").alias("value"))
    header.coalesce(1).unionByName(body).write.text(path)


def read_name(name) -> F.Column:
    """Blanks become underscores, then the name is cut at the first slash."""
    return F.regexp_extract(F.regexp_replace(name, " ", "_"), r"^([^/\s]*)", 1)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, origin, pos, is_rev, cigar): lines in read order, blank-separated."""
    f = F.split("value", " ")
    return _numbered_lines(spark, path).select(F.col("i").alias("read_id"), f[0].cast("int").alias("origin"), f[1].cast("long").alias("pos"), (f[2] == "1").alias("is_rev"), f[3].alias("cigar"))


def read_maf_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, ref_ord, pos, is_rev) of alignments parted by blank lines; the contig is told by the read's name S<n>_<i>."""
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.size(t) >= 15)
    return rows.select(t[9].alias("name"), (F.regexp_extract(t[9], r"^S(\d+)_", 1).cast("int") - 1).alias("ref_ord"), t[3].cast("long").alias("pos"), (t[12] == "-").alias("is_rev"))


def truth_in_names(reads: DataFrame) -> DataFrame:
    """(name, contig, pos, is_rev, is_random) from simulated read names with fields parted by ``_`` and ``:``."""
    f = F.filter(F.split("name", "[_:]"), lambda x: x != "")
    return reads.select("name", F.concat_ws("_", f[0], f[1]).alias("contig"), f[2].cast("long").alias("pos"), (f[4] == "1").alias("is_rev"), (f[6] == "1").alias("is_random"))


def sam_as_truth(sam: DataFrame) -> DataFrame:
    """Another mapper's mapped rows as truth."""
    return sam.where(F.col("flag").bitwiseAND(4) == 0).select("qname", "flag", "rname", "pos", F.lit(False).alias("is_random"))


def timing_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, user_s, wall, rss_kb, major_faults, minor_faults) of time reports, one row a file."""
    fields = {"user_s": r"User time \(seconds\): ([\d.]+)", "wall": r"Elapsed .*: ([\d:.]+)", "rss_kb": r"Maximum resident set size \(kbytes\): (\d+)", "major_faults": r"Major .*faults: (\d+)", "minor_faults": r"Minor .*faults: (\d+)"}
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return lines.groupBy("file").agg(*(F.max(F.when(F.col("value").rlike(r), F.regexp_extract("value", r, 1))).alias(n) for n, r in fields.items()))


def rename_headers(lines: DataFrame) -> DataFrame:
    """Lines with the blanks of their headers (``@``) turned into underscores."""
    return lines.select(F.when(F.col("value").startswith("@"), F.regexp_replace("value", " ", "_")).otherwise(F.col("value")).alias("value"))


def strip_tag(lines: DataFrame, tag: str = "ZE:f:") -> DataFrame:
    """Lines of a SAM file without the optional field of this tag."""
    return lines.select(F.when(F.col("value").startswith("@"), F.col("value")).otherwise(F.regexp_replace("value", "\t" + tag + "[^\t]*", "")).alias("value"))


#: The line of each metric in a mapper's log, and where its number stands in the line.
METRICS = {
    "fwd_per_read": (r"Average number of buckets an original read is mapped to.* (-?\d+(?:\.\d+)?)[^\d]*$", "double"),
    "rev_per_read": (r"Average number of buckets a reverse complement of the read is mapped to.* (-?\d+(?:\.\d+)?)[^\d]*$", "double"),
    "n_qgrams": (r"Number of Q-grams with distinguishability.* (\d+) \S+\s*$", "long"),
}


def experiment_logs(spark: SparkSession, path: str) -> DataFrame:
    """(threshold, fwd_per_read, rev_per_read, n_qgrams): the metrics of one mapper's log for each threshold, which the file's or folder's
    name tells (``bucketmap_<threshold>_0_map.log``); the last line of a metric counts."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"bucketmap_([\d.]+)_0_map\.log", 1).alias("threshold"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    last = lambda r, kind: F.max_by(F.when(F.col("value").rlike(r), F.regexp_extract("value", r, 1)), F.when(F.col("value").rlike(r), F.struct("file", "block", "i"))).cast(kind)
    return lines.groupBy(F.col("threshold").cast("double").alias("threshold")).agg(*(last(r, kind).alias(n) for n, (r, kind) in METRICS.items()))
