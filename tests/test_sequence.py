"""Operators over sequences: golden values, brute force, file formats, streaming."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import align, analysis, bitmap, index, locator, mapper, models
from strandlake.params import BUCKETS, Params
from strandlake.sources import formats
from strandlake.streaming import mapping

SMALL = Params(B=64, L=16, q=5, k=7, S=6, P=5, C=30, n=0.1)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_codes(spark):
    r = one(spark, S.encode(F.lit("AACG")), S.encode(F.lit("CGTT")), S.revcomp_code(F.lit(6), 4), S.encode(F.lit("acgtacgta")), S.revcomp_code(F.lit(27756), 9), S.encode(F.lit("ACN")), S.decode(F.lit(6), 4), S.revcomp(F.lit("AACG")))
    assert tuple(r) == (6, 111, 111, 27756, 203547, None, "AACG", "CGTT")


@pytest.mark.parametrize("n,last,want", [(15, 99, [0, 7, 14, 21, 28, 35, 42, 50, 57, 64, 71, 78, 85, 92, 99]), (5, 699, [0, 175, 350, 525, 699]), (10, 3, [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]), (1, 9, [9]), (4, 0, [0, 0, 0, 0])])
def test_sampler(spark, n, last, want):
    assert one(spark, S.sampler(n, F.lit(last)))[0] == want


def test_thresholds():
    assert [S.ceil32(*x) for x in ((15, 0.4), (20, 0.6), (10, 0.4), (300, 0.02))] == [6, 12, 4, 6]


def test_frac_min_hash_keeps_a_quarter(spark):
    assert spark.range(4**9).where(S.sampled("id", 0.25)).count() == 67400


def test_window_sums_and_kmers(spark):
    r = one(spark, S.window_sums(F.array(*map(F.lit, [1, 2, 3, 4])), 3), S.kmer_codes(F.lit("ACGT"), 3), S.kmer_codes(F.lit("AC"), 3), S.phred(F.lit("!I")))
    assert list(r) == [[6, 9], [6, 27], [], [0, 40]]


def test_votes():
    assert locator.vote([[10, 50], [11, 90], [49]], 2) == {10: 2, 50: 2, 90: 1}
    assert locator.vote([[5, 6], [5]], 2) == {5: 2, 6: 2}
    assert locator.best_vote({9: 2, 4: 2, 1: 1}) == (4, 2) and locator.best_vote({}) is None


def test_bucket_edges(spark):
    sizes = [0, 16, 17, 64, 65, 80, 81, 129]
    rows = spark.createDataFrame([(i, "A" * n) for i, n in enumerate(sizes)], "ref_ord long, seq string")
    got = {(r.ref_ord, r.idx): r.n for r in index.bucketize(rows, SMALL).select("ref_ord", "idx", F.length("seq").alias("n")).collect()}
    want = {(i, j): min(64 + 16, n - j * 64) for i, n in enumerate(sizes) for j in range(-(-n // 64)) if min(80, n - j * 64) > 16}
    assert got == want
    assert [r.ordinal for r in index.dense_ids(index.bucketize(rows, SMALL), block=2).orderBy("ref_ord", "idx").collect()] == list(range(len(want)))


def genome(n=6, size=300, seed=3):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("ACGT") for _ in range(size))) for i in range(n)]


def brute_candidates(refs, reads, p):
    buckets = {r * BUCKETS + i: s[i * p.B : i * p.B + p.B + p.L] for r, s in refs for i in range(-(-len(s) // p.B)) if len(s) - i * p.B > p.L}
    grams = {b: {s[j : j + p.q] for j in range(len(s) - p.q + 1)} for b, s in buckets.items()}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    n, out = len(buckets), set()
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    code = lambda g: sum("ACGT".index(c) * 4 ** (p.q - 1 - i) for i, c in enumerate(g))
    indexed = lambda g: (12345 * code(g) + 678) % 116731 % 10000 <= int(10000 * p.f)
    subs = lambda s: [g for g in (s[i : i + p.q] for i in range(p.k - p.q + 1)) if indexed(g)]
    for read, s, qual in reads:
        size = len(s)
        starts = sorted({i * (size - p.L) // (p.G - 1) for i in range(p.G - 1)} | {size - p.L - 1}) if size > 2 * p.L else [0]
        for off in starts:
            seg, q = s[off : off + p.L], [ord(c) - 33 for c in qual[off : off + p.L]]
            good = [seg[i : i + p.k] for i in range(len(seg) - p.k + 1) if sum(q[i : i + p.k]) >= p.b * p.k]
            good = [x for x in good if any(n - df.get(g, 0) >= int(p.d * n) for g in subs(x))]
            if not good or len(good) < 0.2 * p.S:
                continue
            u = len(good) - 1
            picked = [good[i * (u + 1) // (p.S - 1)] for i in range(p.S - 1)] + [good[u]]
            for original in (True, False):
                misses = {b: sum(not all(x in g for x in subs(km if original else rc(km))) for km in picked) for b, g in grams.items()}
                least = min(misses.values())
                best = [b for b, m in misses.items() if m == least]
                if least < p.faults and len(best) <= p.C:
                    out |= {(read, off, original, b, least) for b in best}
    return out


def test_candidates_against_brute_force(spark):
    refs = genome()
    rng = random.Random(5)
    reads = []
    for i in range(30):
        _, s = rng.choice(refs)
        size = rng.choice([16, 20, 40])
        at = rng.randrange(len(s) - size)
        x = list(s[at : at + size])
        x[rng.randrange(size)] = "A"
        x = "".join(x)
        reads.append((i, x if i % 2 else x[::-1].translate(str.maketrans("ACGT", "TGCA")), "".join(chr(33 + rng.choice([20, 30, 40])) for _ in x)))
    buckets = index.with_qgrams(index.bucketize(spark.createDataFrame(refs, "ref_ord long, seq string"), SMALL), SMALL).cache()
    got = mapping.map_reads(spark.createDataFrame(reads, "read_id long, seq string, qual string"), buckets, index.qgram_df(buckets, SMALL), SMALL)
    assert {(r.read_id, r.seg_off, r.is_original, r.bucket_id, r.misses) for r in got.collect()} == brute_candidates(refs, reads, SMALL)


@pytest.mark.parametrize("f,d,block,part", [(1.0, 0.5, 4, 7), (1.0, 0.5, 2048, 10**6), (0.25, 0.5, 5, 9), (0.05, 0.0, 3, 1000)])
def test_bitmaps_against_brute_force(spark, f, d, block, part):
    """Bitmaps in blocks and parts, with samples of q-grams so thin that many k-mers have none: such a k-mer is a hit everywhere."""
    from dataclasses import replace

    p = replace(SMALL, f=f, d=d, C=8)
    refs, rng = genome(), random.Random(8)
    reads = []
    for i in range(60):
        _, s = rng.choice(refs)
        size = rng.choice([16, 20, 40])
        at = rng.randrange(len(s) - size)
        x = s[at : at + size]
        reads.append((i, x if i % 2 else x[::-1].translate(str.maketrans("ACGT", "TGCA")), "".join(chr(33 + rng.choice([25, 30, 40])) for _ in x)))
    buckets = index.bucketize(spark.createDataFrame(refs, "ref_ord long, seq string"), p).cache()
    n = buckets.count()
    segs = mapper.segments(spark.createDataFrame(reads, "read_id long, seq string, qual string").repartition(3), p)
    seeds = bitmap.picked_seeds(segs, index.common_flags(index.qgram_df(buckets, p), n, p), p).cache()
    found = bitmap.matches(buckets, seeds, n, seeds.count(), p, block, part).cache()
    got = {(r.read_id, r.seg_off, r.is_original, r.bucket_id, r.misses) for r in bitmap.candidates(found, p).collect()}
    assert got == brute_candidates(refs, reads, p) and got
    if f == 1:
        indexed = index.with_qgrams(buckets, p)
        assert got == {(r.read_id, r.seg_off, r.is_original, r.bucket_id, r.misses) for r in mapping.map_reads(spark.createDataFrame(reads, "read_id long, seq string, qual string"), indexed, index.qgram_df(buckets, p), p).collect()}


def test_locations_find_exact_reads(spark):
    refs = genome()
    df = spark.createDataFrame(refs, "ref_ord long, seq string")
    truth = [(i, refs[i % 6][0], 7 + 23 * i % 200) for i in range(12)]
    reads = spark.createDataFrame([(i, f"r{i}", refs[r][1][at : at + 16], "I" * 16) for i, r, at in truth], "read_id long, name string, seq string, qual string")
    buckets = index.with_qgrams(index.bucketize(df, SMALL), SMALL).cache()
    cands = mapping.map_reads(reads, buckets, index.qgram_df(buckets, SMALL), SMALL).cache()
    segs = mapper.segments(reads, SMALL)
    found = locator.locations(cands, segs, buckets, SMALL)
    merged = locator.merge_locations(found, reads.select("read_id", F.length("seq").alias("read_len")), SMALL)
    sam = locator.sam_rows(merged, reads, SMALL)
    at = {(r.qname, r.rname, r.pos) for r in sam.where("flag = 0").collect()}
    # a read at the very start of its only bucket is never reported
    assert at >= {(f"r{i}", r, p) for i, r, p in truth if p % 64}
    report = analysis.sam_report(sam, spark.createDataFrame([(f"r{i}", 0, r, p, False) for i, r, p in truth], "qname string, flag int, rname long, pos long, is_random boolean")).first()
    assert report.n_reads == 12 and report.precision > 0.5


def test_report_denominators(spark):
    truth = spark.createDataFrame([("a", 0, 1, 100, False), ("b", 16, 1, 100, False), ("c", 0, 2, 5, False), ("z", 0, 0, 0, True)], "qname string, flag int, rname long, pos long, is_random boolean")
    sam = spark.createDataFrame([("a", 0, 1, 105), ("b", 16, 1, 106), ("b", 16, 1, 101), ("c", 4, 2, 5), ("z", 0, 1, 1), ("unknown", 0, 1, 1)], "qname string, flag int, rname long, pos long")
    r = analysis.sam_report(sam, truth).first()
    assert (r.n_reads, r.n_rows, r.mapped, r.sensitivity, r.false_positive, r.locations_per_read, r.precision) == (3, 4, 0.666667, 0.333333, 1.0, 2.0, 0.5)
    both = analysis.uniqueness(spark.createDataFrame([(1,), (2,), (2,)], "read_id long"), spark.createDataFrame([(1,), (2,), (3,)], "read_id long"))
    assert {tuple(x) for x in both.collect()} == {(True, True, 1), (False, True, 2)}


def test_alignment_and_errors(spark):
    assert align.semi_global("ACGT", "TTACGTTT") == (0, 2, "====")
    assert align.semi_global("ACGT", "TTAGT") == (1, 2, "=I==")
    rows = align.align(spark.createDataFrame([("ACCGT", "TTACGTTT"), ("AAAAAAAA", "CCCCCCCC")], "seq string, window string"), least_mapq=55).collect()
    assert [(r.edits, r.mapq) for r in rows] == [(1, 59)] and rows[0].cigar.count("I") == 1
    assert one(spark, align.run_lengths(F.lit("===XDD")))[0] == "3=1X2D"
    reads = spark.createDataFrame([(1, "ACGT" * 10), (2, "")], "read_id long, seq string")
    a, b = (align.with_errors(reads, 0.1, 0.05, 0.05, seed=4).orderBy("read_id").collect() for _ in range(2))
    assert a == b and a[0].seq != "ACGT" * 10


def test_bit_parallel_alignment_against_the_whole_table():
    """3,000 pairs over word borders, with few and many edits, all with the same edits, start and operations."""
    rng = random.Random(2)
    reads, windows = [], []
    for t in range(3000):
        size = rng.choice([0, 1, 5, 16, 63, 64, 65, 128, 130, 192, 300])
        window = "".join(rng.choice("ACGT" if t % 3 else "AC") for _ in range(size + rng.choice([0, 1, 3, 12, 40])))
        at = rng.randrange(max(1, len(window) - size + 1))
        read = list(window[at : at + size])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 20, 40])):
            if read:
                i, kind = rng.randrange(len(read)), rng.random()
                read[i : i + 1] = [rng.choice("ACGT")] if kind < 0.4 else [] if kind < 0.7 else [rng.choice("ACGT"), read[i]]
        reads.append("".join(read))
        windows.append(window)
    whole = [align.semi_global(r, w) for r, w in zip(reads, windows, strict=True)]
    for limit in (3, 20):
        assert align.best_placements(reads, windows, limit) == [x if x[0] <= limit else None for x in whole]
    assert align.best_placements([], [], 5) == []


def test_aligned_rows_over_bucket_borders(spark):
    """Exact reads, on both strands and across the starts of buckets, are placed where they were cut, with a CIGAR of matches."""
    refs = genome(3, 400)
    df = spark.createDataFrame(refs, "ref_ord long, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows, found = [], []
    for i, (r, at) in enumerate([(0, 10), (1, 60), (2, 120), (0, 190), (1, 3)]):
        cut = refs[r][1][at : at + 20]
        rows.append((i, f"r{i}", cut if i % 2 else rc(cut), "I" * 20))
        bucket = (at + 15) // 64  # the bucket of a base inside, so that some starts lie before it
        found.append((i, r * BUCKETS + bucket, at - bucket * 64, 0, 9, i % 2 == 1))
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string, qual string")
    got = align.aligned_rows(spark.createDataFrame(found, "read_id long, bucket_id long, offset int, seg_off int, votes int, is_original boolean"), reads, index.bucketize(df, SMALL), SMALL).collect()
    assert sorted((r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar) for r in got) == [("r0", 16, 0, 10, 60, "20="), ("r1", 0, 1, 60, 60, "20="), ("r2", 16, 2, 120, 60, "20="), ("r3", 0, 0, 190, 60, "20="), ("r4", 16, 1, 3, 60, "20=")]


def test_formats_round_trip(spark):
    path = folder()
    with open(f"{path}/x.fa", "w") as f:
        f.write(">c1 first\nACGN\nacg\n>c2/1\nTTTT\n")
    refs = formats.read_fasta(spark, f"{path}/x.fa")
    assert [tuple(r) for r in refs.orderBy("ref_ord").collect()] == [(0, "c1 first", "ACGACG"), (1, "c2/1", "TTTT")]
    assert {tuple(r) for r in formats.name_ordinals(refs).collect()} == {("c1", 0), ("c2", 1)}
    reads = spark.createDataFrame([(0, "a", "ACGT", "@III"), (1, "b", "TT", "II")], "read_id long, name string, seq string, qual string").coalesce(1)
    formats.write_fastq(reads, f"{path}/fq")
    assert sorted(map(tuple, formats.read_fastq(spark, f"{path}/fq").collect())) == sorted(map(tuple, reads.collect()))
    sam = spark.createDataFrame([("a b/1", 16, "c1", 4, 60, "ACGT", "IIII")], "qname string, flag int, rname string, pos long, mapq int, seq string, qual string")
    formats.write_sam(sam, refs, f"{path}/sam")
    r = formats.read_sam(spark, f"{path}/sam").collect()
    assert [(x.qname, x.flag, x.pos, x.mapq) for x in r] == [("a_b", 16, 5, 60)]
    with open(f"{path}/t.maf", "w") as f:
        f.write("a\ns ref 10 4 + 100 ACGT\ns S2_7 0 4 - 4 ACGT\n\n")
    assert [tuple(x) for x in formats.read_maf_truth(spark, f"{path}/t.maf").collect()] == [("S2_7", 1, 10, True)]
    names = spark.createDataFrame([("chr_1_500_x_1_0_0_rest",)], "name string")
    assert tuple(formats.truth_in_names(names).first()) == ("chr_1_500_x_1_0_0_rest", "chr_1", 500, True, False)


def test_stream_equals_batch(spark):
    path = folder()
    refs = spark.createDataFrame(genome(), "ref_ord long, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", s[20:40], "I" * 20) for i, s in genome()], mapping.READS)
    reads.write.parquet(f"{path}/reads")
    mapping.store_index(refs, SMALL, f"{path}/index")
    mapping.map_stream(spark, f"{path}/reads", f"{path}/index", f"{path}/out", f"{path}/state", SMALL).awaitTermination()
    buckets, df = mapping.load_index(spark, SMALL, f"{path}/index")
    cols = ["read_id", "seg_off", "is_original", "bucket_id", "misses"]
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").select(cols).collect())) == sorted(map(tuple, mapping.map_reads(reads, buckets, df, SMALL).select(cols).collect()))
    with pytest.raises(ValueError):
        mapping.load_index(spark, Params(B=128, L=16, q=5, k=7), f"{path}/index")


def test_classifier_finds_the_source(spark):
    refs = spark.createDataFrame(genome(), "ref_ord long, seq string")
    model = models.frequency_model(refs, "ref_ord", 6)
    queries = models.kmers(spark.createDataFrame([(i, s[100:140]) for i, s in genome()], "read_id long, seq string"), "read_id", 6)
    assert all(r.read_id == r.ref_ord for r in models.classify(model, queries, "ref_ord", "read_id").collect())
    spread = {r.kmer: r.weight for r in models.spread_weights(spark.createDataFrame([(1, "AC")], "ref_ord long, seq string"), "ref_ord", 2, 0.1).collect()}
    assert len(spread) == 7 and spread[1] == 1.0 and abs(spread[0] - 0.1) < 1e-9


def test_jaccard_against_brute_force(spark):
    """All pairs of distinct sets, in groups of copies larger than any cap would allow."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    rows = [(i, texts[i % 6][: 60 - i // 12]) for i in range(120)] + [(200 + i, texts[0]) for i in range(40)] + [(300, "AC"), (301, "")]
    code = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    other = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    sets = {i: frozenset(min(code(t[j : j + 5]), code(other(t[j : j + 5]))) for j in range(len(t) - 4)) for i, t in rows}
    made = models.kmer_sets(spark.createDataFrame(rows, "ref_ord long, seq string"), "ref_ord", 5)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    assert {r.ref_ord: r.representative for r in models.members(made, "ref_ord").collect()} == {i: least[s] for i, s in sets.items()}
    distinct = models.representatives(made, "ref_ord")
    for t in (0.3, 0.5, 0.9):
        got = {(r.a, r.b): (r.shared, r.jaccard) for r in models.jaccard(distinct, "ref_ord", t).collect()}
        want = {(a, b): (len(x & y), round(len(x & y) / len(x | y), 9)) for x, a in least.items() for y, b in least.items() if a < b and x and y and len(x & y) / len(x | y) >= t}
        assert got == want


def test_window_codes_of_odd_input():
    import pyarrow as pa

    from strandlake.functions import seq as S

    got = S.window_codes(pa.array(["ACGT", None, "", "AC", "acNgta"]).slice(0), 3).to_pylist()
    assert got == [[6, 27], None, [], [], [None, None, None, 44]]
    assert S.window_codes(pa.array(["AAAAA", "ACGTACGT", "NN"]), 3, True).to_pylist() == [[0], [6, 27, 44, 49], []]


def test_locator_accuracy(spark):
    from strandlake.operators import analysis

    sam = spark.createDataFrame([("a", 0, 1, 10), ("a", 0, 1, 17), ("b", 16, 2, 9), ("c", 0, 5, 1)], "qname string, flag int, rname long, pos long")
    truth = spark.createDataFrame([("a", 1, 12, False), ("b", 2, 9, True), ("c", 4, 1, False), ("d", 1, 1, False)], "name string, ref_ord long, pos long, is_rev boolean")
    assert tuple(analysis.locator_accuracy(sam, truth).first()) == (4, 3, 2, 1, 2, 1.0)



def test_empty_inputs(spark):
    none = spark.createDataFrame([], "ref_ord long, seq string")
    assert index.bucketize(none, SMALL).count() == 0
    buckets = index.bucketize(spark.createDataFrame(genome(2), "ref_ord long, seq string"), SMALL)
    reads = spark.createDataFrame([(1, "r", "ACGTACGTACGTACGTAC", "I" * 18), (2, "s", "ACG", "III")], "read_id long, name string, seq string, qual string")
    segs = mapper.segments(reads, SMALL)
    for b, s in ((buckets.limit(0), segs), (buckets, segs.limit(0)), (buckets.limit(0), segs.limit(0))):
        seeds = bitmap.picked_seeds(s, index.common_flags(index.qgram_df(b, SMALL), b.count(), SMALL), SMALL)
        found = bitmap.matches(b, seeds, b.count(), seeds.count(), SMALL)
        cands = bitmap.candidates(found, SMALL)
        assert cands.count() == bitmap.levels(found, SMALL).count() == locator.locations(cands, s, b, SMALL).count() == 0
    nothing = spark.createDataFrame([], "read_id long, bucket_id long, offset int, seg_off int, votes int, is_original boolean")
    assert align.aligned_rows(nothing, reads, buckets, SMALL).count() == 0
    assert mapper.segments(spark.createDataFrame([], "read_id long, seq string, qual string"), SMALL).count() == 0
