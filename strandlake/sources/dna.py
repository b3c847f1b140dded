"""DNA tables derived from the given text tables: contigs, reads with known truth.

Letters become bases by their place in the alphabet, so contigs have the
repeats and near copies of the texts. Reads are cut from contigs at places, with
errors, strands and qualities that arithmetic on the document's id fixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.params import Params

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def refs(spark: SparkSession, sf_dir: str, spread: bool = False, unknown: bool = False) -> DataFrame:
    """(ref_ord, seq) of every document with a text, as read: map-only.

    With ``spread`` the sequences are dealt to the shuffle partitions, for work that costs far more than moving them, on rows of very
    uneven size or a table of a few files. With ``unknown`` the texts' digits are unknown bases (N).
    """
    letters, bases = (LETTERS + "0123456789", "ACGT" * 13 + "N" * 10) if unknown else (LETTERS, "ACGT" * 13)
    dna = F.translate(F.regexp_replace("text", "[^A-Za-z0-9]" if unknown else "[^A-Za-z]", ""), letters, bases)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    rows = docs.select(F.col("doc_id").alias("ref_ord"), dna.alias("seq"))
    return rows.repartition("ref_ord") if spread else rows


def reads(contigs: DataFrame, p: Params) -> DataFrame:
    """(read_id, name, seq, qual, ref_ord, pos, is_rev): a read of every contig that is longer than L + 1.

    Every third is three segments long where the contig allows it; one base is exchanged; every other is reversed.
    """
    n = F.length("seq")
    size = F.when((F.col("ref_ord") % 3 == 0) & (n > 3 * p.L), F.lit(3 * p.L)).otherwise(F.lit(p.L))
    cut = contigs.where(n > p.L + 1).withColumn("size", size)
    pos = (F.col("ref_ord") * 7919) % (n - F.col("size"))
    at = (F.col("ref_ord") * 31) % p.L
    piece = F.substring("seq", (F.col("pos") + 1).cast("int"), F.col("size"))
    error = F.translate(F.substring("piece", (F.col("at") + 1).cast("int"), F.lit(1)), "ACGT", "CGTA")
    wrong = F.concat(F.substring("piece", F.lit(1), F.col("at").cast("int")), error, F.substring("piece", (F.col("at") + 2).cast("int"), F.col("size")))
    qual = F.array_join(F.transform(S.positions(F.col("size")), lambda i: F.char(F.lit(53) + (i * 7 + F.col("ref_ord")) % 21)), "")
    return (
        cut.withColumn("pos", pos).withColumn("at", at).withColumn("piece", piece).withColumn("wrong", wrong).withColumn("is_rev", F.col("ref_ord") % 2 == 1)
        .select(F.col("ref_ord").alias("read_id"), F.concat(F.lit("r"), "ref_ord").alias("name"), F.when(F.col("is_rev"), S.revcomp("wrong")).otherwise(F.col("wrong")).alias("seq"), qual.alias("qual"), "ref_ord", "pos", "is_rev")
    )
