"""Dictionaries, fitted models, the model store, record-aligned readers and logs."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.jobs import store
from strandlake.operators import analysis, dictionary, index, learn, mapper, models
from strandlake.params import Params
from strandlake.sources import dna, formats, records

SMALL = Params(B=64, L=16, q=5, k=7, S=6, P=5, C=30, n=0.1)
RC = str.maketrans("ACGT", "TGCA")


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def genome(n=6, size=300, seed=3):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("ACGT") for _ in range(size))) for i in range(n)]


def slots(k):
    out = {}
    for code in range(4**k):
        km = "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))
        if km not in out:
            out[km] = out[km[::-1].translate(RC)] = len(set(out.values()))
    return out


@pytest.mark.parametrize("k", [2, 3, 7])
def test_dictionary_of_all_kmers(spark, k):
    want = slots(k)
    got = {r.kmer: r.slot for r in dictionary.all_kmers(spark, k).select(S.decode("kmer", k).alias("kmer"), "slot").collect()}
    assert got == want and dictionary.size(k) == len(set(want.values()))


def test_seen_kmers_are_numbered_by_first_appearance_whatever_the_splits(spark):
    refs = [*genome(5, 200), (5, "AC"), (6, genome(5, 200)[0][1])]
    buckets = index.bucketize(spark.createDataFrame(refs, "ref_ord long, seq string"), SMALL)
    want = {}
    for r in sorted(buckets.collect(), key=lambda r: r.bucket_id):
        for i in range(len(r.seq) - 4):
            km = min(r.seq[i : i + 5], r.seq[i : i + 5][::-1].translate(RC))
            want.setdefault(km, len(want))
    for n in (1, 5):
        rows = dictionary.seen_kmers(buckets.repartition(n), 5).select(S.decode("kmer", 5).alias("kmer"), "slot").collect()
        assert {r.kmer: r.slot for r in rows} == want and len(rows) == len(want)


def test_slot_profile_and_unknown_bases(spark):
    want = slots(3)
    seqs = [(1, "ACGTNACG"), (2, ""), (3, "NNNN"), (4, None), (5, "AC")]
    got = {(r.ref_ord, r.slot): (r.n, r.share) for r in dictionary.slot_profile(spark.createDataFrame(seqs, "ref_ord long, seq string"), "ref_ord", 3).collect()}
    n = {}
    for key, s in seqs:
        for i in range(len(s or "") - 2):
            slot = want.get(s[i : i + 3], dictionary.size(3))
            n[key, slot] = n.get((key, slot), 0) + 1
    totals = {key: sum(x for (k, _), x in n.items() if k == key) for key, _ in seqs}
    assert got == {(k, s): (x, x / totals[k]) for (k, s), x in n.items()}


def test_components_equal_numpy(spark):
    """On the buckets of the smallest given table, in one task and in several."""
    buckets = index.bucketize(dna.refs(spark, "/root/testdata/sf0.001"), Params()).select("bucket_id", "seq").cache()
    table, width = slots(3), dictionary.size(3) + 1
    rows = []
    for r in buckets.collect():
        x = np.zeros(width)
        for i in range(len(r.seq) - 2):
            x[table[r.seq[i : i + 3]]] += 1
        rows.append(x / x.sum())
    want = np.linalg.eigvalsh(np.cov(np.array(rows), rowvar=False))[::-1]
    for n in (1, 7):
        values, vectors = learn.principal_components(buckets.repartition(n), "bucket_id", 3)
        assert np.allclose(values, np.maximum(want, 0), atol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(width), atol=1e-9)
    rows = learn.explained_variance(buckets, "bucket_id", 3).orderBy("component").collect()
    assert abs(rows[-1].cumulative - 1) < 1e-9 and rows[0].ratio >= rows[1].ratio
    assert learn.explained_variance(buckets.limit(0), "bucket_id", 3).count() == 0


def test_trained_classifier_on_held_out_windows(spark):
    """Held-out windows of 32 classes are put in their own bucket in nine of ten cases or more."""
    buckets = index.bucketize(dna.refs(spark, "/root/testdata/sf0.001"), Params()).select("bucket_id", "seq")
    model, chosen, accuracy = learn.trained_classifier(buckets, Params())
    n, right = accuracy.agg(F.sum("n"), F.sum("n_right")).first()
    assert chosen.count() == 32 and n > 400 and right / n >= 0.9
    one = learn.features(spark.createDataFrame([(1, "ACGT" * 16), (2, "")], "id long, seq string"), 4)
    assert model.transform(one).select("prediction").count() == 2


def test_margins_against_brute_force(spark):
    refs = [*genome(6, 120), (6, "ACGTACGTAC"), (7, genome(6, 120)[2][1])]
    reads = [(i, s[20:50], i) for i, s in refs] + [(90, "TTTTTTTTTT", 3), (91, refs[0][1][:30], 6)]
    k, prior = 4, 0.001
    model = models.frequency_model(spark.createDataFrame(refs, "ref_ord long, seq string"), "ref_ord", k)
    rows = spark.createDataFrame(reads, "read_id long, seq string, ref_ord long")
    got = {r.read_id: r for r in learn.margins(model, models.kmers(rows, "read_id", k), rows.select("read_id", "ref_ord"), "ref_ord", "read_id").collect()}
    wins = lambda s: [s[i : i + k] for i in range(len(s) - k + 1)]
    assert set(got) == {i for i, s, _ in reads if len(s) >= k}
    for i, s, truth in reads:
        if len(s) < k:
            continue
        score = {r: round(sum(np.log((wins(t).count(w) + prior) / (len(wins(t)) + prior * 4**k)) for w in wins(s)), 6) for r, t in refs}
        other, key = max((v, -r) for r, v in score.items() if r != truth)
        assert abs(got[i].hit - score[truth]) < 1e-5 and abs(got[i].other - other) < 1e-5
        assert got[i].correct == (score[truth] > other or score[truth] == other and truth < -key)
    report = learn.harness(learn.margins(model, models.kmers(rows, "read_id", k), rows.select("read_id", "ref_ord"), "ref_ord", "read_id")).first()
    assert report.n_queries == len(got) and report.n_right == sum(r.correct for r in got.values())


def test_store_versions(spark):
    base, params = folder(), {"k": 5, "prior": 0.001}
    model = models.frequency_model(spark.createDataFrame(genome(2), "ref_ord long, seq string"), "ref_ord", 5).cache()
    assert store.versions(spark, base, "m") == []
    assert [store.publish(model, base, "m", params), store.publish(model.limit(3), base, "m", params | {"k": 6})] == [1, 2]
    back = store.load(spark, base, "m", params, version=1)
    assert back.schema == model.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, model.collect()))
    with pytest.raises(ValueError):
        store.load(spark, base, "m", params)
    assert store.load(spark, base, "m", {"k": 6}).count() == 3
    with pytest.raises(FileNotFoundError):
        store.load(spark, base, "m", params, version=9)
    assert store.prune(spark, base, "m") == [1] and store.versions(spark, base, "m") == [2]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_any_splits_equal_those_of_one(spark, end):
    """Qualities that begin with @ or +, empty sequences, blank lines, several files: every split size gives the same records."""
    rng = random.Random(4)
    fq = [(f"r{i} x/{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+IJ!") for _ in range(n))) for i, n in enumerate([5, 1, 30, 0, 12, 7, 200, 3, 3, 90])]
    fa = [(f"c{i} h>h", "".join(rng.choice("ACGTacgtN") for _ in range(n))) for i, n in enumerate([10, 0, 150, 61, 60, 1])]
    path = folder()
    for name, rows, text in (("fq", fq, lambda r: f"@{r[0]}{end}{r[1]}{end}+{end}{r[2]}{end}"), ("fa", fa, lambda r: f">{r[0]}{end}" + "".join(r[1][i : i + 60] + end for i in range(0, len(r[1]), 60)) + end)):
        for part, some in (("a", rows[:4]), ("b", rows[4:])):
            with open(f"{path}/{name}_{part}", "w", newline="") as f:
                f.write("".join(map(text, some)))
    import os

    for name in ("fq", "fa"):
        os.mkdir(f"{path}/{name}")
        for part in ("a", "b"):
            os.rename(f"{path}/{name}_{part}", f"{path}/{name}/{part}")
    for size in (1 << 20, 100, 37, 11):
        assert [tuple(r) for r in formats.read_fastq(spark, f"{path}/fq", size).orderBy("read_id").collect()] == [(i, *r) for i, r in enumerate(fq)]
        assert [tuple(r) for r in formats.read_fasta(spark, f"file://{path}/fa", size).orderBy("ref_ord").collect()] == [(i, h, s.upper().replace("N", "")) for i, (h, s) in enumerate(fa)]
    assert formats._numbered_lines(spark, f"{path}/fq/b", 7).count() == 24
    with open(f"{path}/cut.fq", "w") as f:
        f.write("@a\nACGT\n+\nII")
    assert [tuple(r) for r in formats.read_fastq(spark, f"{path}/cut.fq").collect()] == [(0, "a", "ACGT", "II")]
    with open(f"{path}/bad.fq", "w") as f:
        f.write("@a\nACGT\n")
    with pytest.raises(Exception, match="cut off"):
        formats.read_fastq(spark, f"{path}/bad.fq").collect()
    open(f"{path}/none.fq", "w").close()
    assert formats.read_fastq(spark, f"{path}/none.fq").count() == 0
    with pytest.raises(Exception, match="missing"):
        formats.read_fasta(spark, f"{path}/missing").collect()


def test_truth_files_and_logs(spark):
    path = folder()
    with open(f"{path}/t.ground_truth", "w") as f:
        f.write("3 100 1 16=\n4 7 0 8=1X7=\n")
    assert [tuple(r) for r in formats.read_truth(spark, f"{path}/t.ground_truth").orderBy("read_id").collect()] == [(0, 3, 100, True, "16="), (1, 4, 7, False, "8=1X7=")]
    with open(f"{path}/a.time", "w") as f:
        f.write("\tUser time (seconds): 12.5\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.03\n\tMaximum resident set size (kbytes): 4096\n\tMajor (requiring I/O) page faults: 2\n\tMinor (reclaiming a frame) page faults: 9\n")
    assert tuple(formats.timing_logs(spark, f"{path}/a.time").select("user_s", "wall", "rss_kb", "major_faults", "minor_faults").first()) == ("12.5", "1:02.03", "4096", "2", "9")
    for threshold, text in (("0.1", "Average number of buckets an original read is mapped to: 2.25.\nAverage number of buckets a reverse complement of the read is mapped to: 0.5.\nNumber of Q-grams with distinguishability >= 0.1: 77 (10%)\n"), ("0.9", "nothing\nNumber of Q-grams with distinguishability >= 0.9: 5 (1%)\nNumber of Q-grams with distinguishability >= 0.9: 6 (1%)\n")):
        with open(f"{path}/bucketmap_{threshold}_0_map.log", "w") as f:
            f.write(text)
    assert sorted(map(tuple, formats.experiment_logs(spark, f"{path}/*.log").collect())) == [(0.1, 2.25, 0.5, 77), (0.9, None, None, 6)]
    lines = spark.createDataFrame([("@r 1 x",), ("AC GT",)], "value string")
    assert [r.value for r in formats.rename_headers(lines).collect()] == ["@r_1_x", "AC GT"]
    sam = spark.createDataFrame([("r\t0\tAS:i:1\tZE:f:0.5\tNM:i:0",), ("@CO\tZE:f:1",)], "value string")
    assert [r.value for r in formats.strip_tag(sam).collect()] == ["r\t0\tAS:i:1\tNM:i:0", "@CO\tZE:f:1"]
    answer = spark.createDataFrame([("a", 0, 1, 5), ("b", 4, 1, 5)], "qname string, flag int, rname long, pos long")
    assert [tuple(r) for r in formats.sam_as_truth(answer).collect()] == [("a", 0, 1, 5, False)]


def test_report_by_file(spark):
    truth = spark.createDataFrame([("a", 0, 1, 100, False), ("b", 16, 1, 100, False)], "qname string, flag int, rname long, pos long, is_random boolean")
    sam = spark.createDataFrame([("x", "a", 0, 1, 100), ("x", "b", 0, 1, 100), ("y", "a", 0, 1, 300), ("y", "a", 0, 1, 101), ("z", "a", 4, 1, 1)], "file string, qname string, flag int, rname long, pos long")
    got = {r.file: (r.n_reads, r.n_rows, r.mapped, r.sensitivity, r.precision) for r in analysis.sam_report(sam, truth, by="file").collect()}
    assert got == {"x": (2, 2, 1.0, 0.5, 0.5), "y": (2, 2, 0.0, 0.0, 0.5), "z": (2, 0, 0.0, 0.0, None)}
    assert analysis.sam_report(sam.drop("file").limit(0), truth).first().n_rows == 0


def test_bucket_accuracy(spark):
    found = spark.createDataFrame([(1, 10, 5), (1, 11, 0), (2, 10, 9), (3, 7, 1)], "read_id long, bucket_id long, offset int")
    truth = spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 8, 1), (4, 1, 1)], "read_id long, true_bucket long, true_offset long")
    r = analysis.bucket_accuracy(found, truth, 3).first()
    assert (r.n_reads, r.buckets_per_read, r.n_none, r.n_unique, r.n_upto_5, r.n_right_bucket, r.mean_offset_error, r.n_almost, r.n_unique_right) == (4, 1.0, 1, 2, 3, 2, 1.5, 2, 1)


def test_gapped_quality(spark):
    q = [30, 2, 30, 40, 1, 30, 30, 30]
    rows = spark.createDataFrame([(0, 0, "ACGTACGT", "".join(chr(33 + x) for x in q))], "read_id long, seg_off int, seq string, qual string")
    shape = "1010101"
    want = [sum(q[i + j] for j in (0, 2, 4, 6)) for i in range(2)]
    assert rows.select(S.shaped_sums(S.phred("qual"), shape)).first()[0] == want
    got = mapper.good_kmers(rows, SMALL, shape).first().good
    assert [g.pos for g in got] == [i for i, x in enumerate(want) if x >= SMALL.b * 4]
    with pytest.raises(ValueError):
        mapper.good_kmers(rows, SMALL, "101")
    with pytest.raises(ValueError):
        S.shaped_sums(F.array(F.lit(1)), "00")


def test_bucket_variants(spark):
    """Slices with one base more, and with short tails kept."""
    rows = spark.createDataFrame([(0, "A" * 80), (1, "A" * 81)], "ref_ord long, seq string")
    sizes = lambda **x: sorted((r.ref_ord, r.idx, len(r.seq)) for r in index.bucketize(rows, SMALL, **x).collect())
    assert sizes() == [(0, 0, 80), (1, 0, 80), (1, 1, 17)]
    assert sizes(extra=1, keep_tail=True) == [(0, 0, 80), (0, 1, 16), (1, 0, 81), (1, 1, 17)]


@pytest.mark.parametrize("wrong", [{"q": 8, "k": 7}, {"B": 0}, {"e": 1.5}, {"f": -0.1}, {"q": 5, "k": 32}, {"L": 6}, {"S": 1, "e": 0.0}])
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        Params(**({"B": 64, "L": 16, "q": 5, "k": 7, "S": 6, "P": 5} | wrong))
