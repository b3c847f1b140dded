"""Blocks of postings against brute force, and that mapping moves neither buckets nor seeds through an exchange once for each block."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.operators import bitmap, index
from strandlake.params import Params

SMALL = Params(B=64, L=16, q=5, k=7, S=6, P=5, C=30, n=0.1)


def _code(w):
    return sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))


@pytest.mark.parametrize("q,k", [(5, 7), (3, 7), (4, 4), (1, 3), (5, 14), (9, 12), (9, 30)])
def test_postings_hold_every_kmer_whose_qgrams_stand_in_the_bucket(q, k):
    rng = random.Random(q * 31 + k)
    p = Params(B=300, L=64, q=q, k=k, S=6, P=5)
    texts = ["".join(rng.choice("ACGT" if i % 3 else "AC") for _ in range(rng.choice([0, 3, 20, 90] if q > 3 else [0, 3, 20]))) for i in range(25)]
    texts += ["ACGTTGCATG" * 8, "ACGTTGCATGACCAACGTTACATGACCTACG" * 5, "ACGTNACGTTGCANTTGCATGACCA", "A" * 70]
    held = bitmap.Postings(np.arange(len(texts)) * 10, pa.array(texts), p)
    got = {i: set() for i in range(len(texts))}
    for x in held.pairs.tolist():
        name = x >> int(held.bits)
        got[x & (1 << int(held.bits)) - 1].add(name if held.names is None else int(held.names[name]))
    for i, t in enumerate(texts):
        grams = {t[j : j + q] for j in range(len(t) - q + 1) if "N" not in t[j : j + q]}
        words = set(grams)
        for _ in range(q, k):
            words = {w + c for w in words for c in "ACGT" if (w + c)[-q:] in grams}
        assert got[i] == {_code(w) for w in words}


def test_hits_in_groups_of_copies():
    """Segments with repeated seeds, and more equal buckets than are asked for, counted as by sets."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(10)]
    texts += [texts[0]] * 40 + [texts[1][:50] + t[50:] for t in texts[2:8]]
    held = bitmap.Postings(np.arange(len(texts)), pa.array(texts), SMALL)
    sets = [{t[j : j + 5] for j in range(76)} for t in texts]
    segments = []
    for t in texts[:20]:
        at = sorted(rng.choices(range(60), k=rng.choice([1, 3, 6])))
        segments.append([t[at[i * len(at) // 6] :][:7] for i in range(6)])
    row, lane, misses = held.hits(np.array([[_code(w) for w in s] for s in segments]))
    want = {(i, b): m for i, s in enumerate(segments) for b, g in enumerate(sets) if (m := sum(not all(w[j : j + 5] in g for j in range(3)) for w in s)) < SMALL.faults}
    assert dict(zip(zip(row.tolist(), lane.tolist(), strict=True), misses.tolist(), strict=True)) == want
    counts, fewest, rows, ids = held.levels(np.array([[_code(w) for w in s] for s in segments]))
    assert counts.sum() == len(want) and set(zip(rows.tolist(), ids.tolist(), strict=True)) == {(i, b) for (i, b), m in want.items() if m == fewest[i] and counts[i, m] <= SMALL.C}


def test_no_exchange_for_a_block(spark):
    """Twenty blocks: the plan deals nothing out, and copies of the seeds are read, not shuffled."""
    rng = random.Random(6)
    refs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(300))) for i in range(20)], "ref_ord long, seq string")
    seeds = spark.createDataFrame([(i, 0, [rng.randrange(4**7) for _ in range(6)]) for i in range(50)], "read_id long, seg_off int, kmers array<bigint>")
    found = bitmap.matches(index.bucketize(refs, SMALL), seeds, 100, 50, SMALL, 5, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_the_stream_joins_no_postings(spark, tmp_path):
    """The stored index has texts alone, and reads are mapped against it by blocks."""
    from strandlake.streaming import mapping

    rng = random.Random(7)
    refs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(300))) for i in range(5)], "ref_ord long, seq string")
    mapping.store_index(refs, SMALL, f"{tmp_path}/index")
    buckets, df = mapping.load_index(spark, SMALL, f"{tmp_path}/index")
    assert "qgrams" not in buckets.columns
    reads = refs.selectExpr("ref_ord as read_id", "substr(seq, 20, 20) as seq", "repeat('I', 20) as qual")
    got = mapping.map_reads(reads, buckets, df, SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    assert {(r.read_id, r.bucket_id // (1 << 20)) for r in got.where("is_original and misses = 0").collect()} == {(i, i) for i in range(5)}
