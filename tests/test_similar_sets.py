"""Similar sets by blocks against brute force, without an exchange of k-mers."""

import random

import pytest

from strandlake.operators import models


def _texts():
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.choice([40, 90, 300]))) for _ in range(12)]
    out = list(base) + ["", "AC", "A" * 50]
    for t in base:
        for _ in range(8):  # near copies of many degrees, cut and changed
            x = list(t[rng.randrange(20) :])
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                x[rng.randrange(len(x))] = rng.choice("ACGT")
            out.append("".join(x))
    return out


@pytest.mark.parametrize("codes,k,least", [(100, 5, 0.5), (1 << 22, 5, 0.5), (300, 5, 0.3), (300, 5, 0.9), (500, 14, 0.5), (500, 17, 0.5)])
def test_similar_sets_against_brute_force(spark, codes, k, least):
    other = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    sets = {}
    for i, t in enumerate(_texts()):
        s = frozenset(min(t[j : j + k], other(t[j : j + k])) for j in range(len(t) - k + 1))
        if s not in sets.values():
            sets[i] = s
    rows = [(i, t) for i, t in enumerate(_texts()) if i in sets]
    seqs = spark.createDataFrame(rows, "ref_ord long, seq string").repartition(3, "ref_ord")
    packed = models.packed_sets(seqs, "ref_ord", k, codes).cache()
    found = models.similar_sets(packed, k, least, sum(map(len, sets.values())))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    want = {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) / len(x | y) >= least}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.a, r.b): r.shared for r in rows} == want
    assert all(r.jaccard == round(r.shared / (len(sets[r.a]) + len(sets[r.b]) - r.shared), 9) for r in rows)


def test_rows_of_megabytes_have_a_file_each(spark):
    from strandlake.jobs import registry

    table = registry.stored(spark.range(5).selectExpr("id", "cast(repeat('x', 1000) as binary) as blob").coalesce(1), "packed", 1)
    assert len(table.inputFiles()) == 5 and table.count() == 5
