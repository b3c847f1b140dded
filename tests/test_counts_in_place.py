"""Models of sequences that have a row each: the same as by exchanges, without one."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import models


def _seqs(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGT" if i % 3 else "ACGTN") for _ in range(rng.choice([0, 2, 5, 40, 300])))) for i in range(60)] + [(99, None), (100, "ACxé漢GTACé漢GTA")]
    return spark.createDataFrame(rows, "ref_ord long, seq string").repartition(3)


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("make", [
    lambda s, whole: models.frequency_model(s, "ref_ord", 5, whole=whole),
    lambda s, whole: models.frequency_model(s, "ref_ord", 4, rate=0.01, whole=whole),
    lambda s, whole: models.markov_model(s, "ref_ord", 3, whole=whole),
    lambda s, whole: models.gapped_counts(s, "ref_ord", [0, 2, 3, 5], whole=whole),
])
def test_whole_sequences_are_counted_where_they_are(spark, make):
    seqs = _seqs(spark)
    assert _rows(make(seqs, True)) == _rows(make(seqs, False))
    assert _exchanges(make(seqs, True)) == _exchanges(seqs)


def test_gapped_counts_against_brute_force(spark):
    seqs, want = _seqs(spark), {}
    for r in seqs.where("seq is not null").collect():
        for i in range(len(r.seq) - 5):
            at = (r.ref_ord, r.seq[i] + r.seq[i + 2 : i + 4] + r.seq[i + 5])
            want[at] = want.get(at, 0) + 1
    assert {(r.ref_ord, r.gapped): r.n for r in models.gapped_counts(seqs, "ref_ord", [0, 2, 3, 5]).collect()} == want


def test_ids_of_sets_without_the_sets(spark):
    seqs = _seqs(spark).where("seq is not null")
    ids = models.kmer_sets(seqs, "ref_ord", 5, ids_alone=True)
    assert ids.columns == ["ref_ord", "id_a", "id_b"]
    whole = models.kmer_sets(seqs, "ref_ord", 5)
    assert _rows(ids) == _rows(whole.drop("s"))
    assert whole.select("s").distinct().count() == ids.select("id_a", "id_b").distinct().count()


def test_repeated_ids_are_counted_together(spark, tmp_path):
    from strandlake.jobs import registry

    spark.createDataFrame([(1, "ACGTACGTAC"), (1, "TTTTTTTT"), (2, "ACACACAC")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert not registry._distinct_ids(spark, str(tmp_path))
    got = registry.frequency_model(spark, str(tmp_path)).groupBy("ref_ord").agg(F.count("kmer").alias("n"), F.countDistinct("kmer").alias("d")).collect()
    assert {(r.ref_ord, r.n, r.d) for r in got} == {(1, 5, 5), (2, 2, 2)}
