"""Locating: seed votes inside candidate buckets, merged to locations and SAM rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import bitmap
from strandlake.operators.mapper import good_kmers, seeds
from strandlake.params import BUCKETS, Params


def locating_seeds(segs: DataFrame, p: Params) -> DataFrame:
    """P seeds of each segment: of its good k-mers, or of all where none is good."""
    judged = good_kmers(segs, p)
    every = F.transform(S.kmer_codes("seq", p.k), lambda c, i: F.struct(i.alias("pos"), c.alias("kmer")))
    return seeds(judged.withColumn("good", F.when(F.size("good") > 0, F.col("good")).otherwise(every)), p.P)


def picked_seeds(segs: DataFrame, p: Params) -> DataFrame:
    """(read_id, seg_off, seg_len, read_len, at, kmers): ``locating_seeds`` as arrays, a row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, known, quality, n = bitmap._windows_of(batch, p)
            good = known & (quality >= p.b * p.k)
            row = np.repeat(np.arange(len(n)), n)
            some = np.bincount(row[good], minlength=len(n)) > 0
            use, at = bitmap.spread_over(good | ~some[row], n, p.P)
            rows = pa.array(use)
            own = at - (np.cumsum(n) - n)[use][:, None]
            kept = ("read_id", "seg_off", "seg_len", "read_len")
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in kept), bitmap._lists(own), bitmap._lists(code[at])], names=[*kept, "at", "kmers"])

    cols = segs.select("read_id", "seg_off", "seg_len", "read_len", "seq", "qual")
    return cols.mapInArrow(run, f"read_id {cols.schema['read_id'].dataType.simpleString()}, seg_off int, seg_len int, read_len int, at array<bigint>, kmers array<bigint>")


class BucketIndex:
    """Places of every k-mer of one bucket."""

    def __init__(self, seq: str, k: int):
        code = S.window_codes(pa.array([seq]), k).values.to_numpy(zero_copy_only=False)
        code = np.where(np.isnan(code), -1, code).astype(np.int64) if code.dtype.kind == "f" else code
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]

    def places(self, kmers: np.ndarray) -> list[np.ndarray]:
        """Ascending places of each k-mer."""
        low, high = np.searchsorted(self.codes, kmers), np.searchsorted(self.codes, kmers, "right")
        return [self.order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def vote(samples: list[list[int]], indel: int) -> dict[int, int]:
    """Votes of ordered samples, each an ascending list of proposed starts.

    The first sample with hits proposes all of them. A later hit votes for every proposal within
    ``indel``; without one it becomes a proposal, which the next hit already sees.
    """
    state: dict[int, int] = {}
    for hits in samples:
        if not state:
            state = dict.fromkeys(hits, 1)
            continue
        for hit in hits:
            near = [x for x in range(hit - indel, hit + indel + 1) if x in state]
            for x in near:
                state[x] += 1
            if not near:
                state[hit] = 1
    return state


def best_vote(votes: dict[int, int]) -> tuple[int, int] | None:
    """The proposal with most votes and their number; of equals the leftmost."""
    return min(votes.items(), key=lambda v: (-v[1], v[0])) if votes else None


def locations(cands: DataFrame, segs: DataFrame, buckets: DataFrame, p: Params) -> DataFrame:
    """(read_id, bucket_id, offset, seg_off, votes, is_original): each candidate whose best start has enough votes and is over 0.

    ``offset`` is the read's start, not the segment's; it may lie before its bucket. Every bucket is dealt with its candidates, and
    comes first: a task indexes one bucket at a time, if any candidate follows, and its text is moved once however many do.
    """
    null = lambda t: F.lit(None).cast(t)
    probes = cands.select("read_id", "seg_off", "is_original", "bucket_id").join(picked_seeds(segs, p), ["read_id", "seg_off"])
    asked = probes.select("bucket_id", F.lit(1).alias("stage"), null("string").alias("seq"), "read_id", "seg_off", "is_original", "seg_len", "read_len", "at", "kmers")
    kinds = {c: asked.schema[c].dataType.simpleString() for c in asked.columns[3:]}
    index = buckets.select("bucket_id", F.lit(0).alias("stage"), "seq", *(null(t).alias(c) for c, t in kinds.items()))
    dealt = index.unionByName(asked).repartition("bucket_id").sortWithinPartitions("bucket_id", "stage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held = "", None
        for batch in batches:
            out: list[tuple] = []
            rc = None
            for i, (stage, text, original, seg_len, read_len, seg_off) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("stage", "seq", "is_original", "seg_len", "read_len", "seg_off")), strict=True)):
                if stage == 0:
                    seq, held = text, None
                    continue
                if held is None:
                    held = BucketIndex(seq, p.k)
                if rc is None:
                    first = i
                    fwd = batch.column("kmers").slice(first).flatten().to_numpy().reshape(-1, p.P)
                    own = batch.column("at").slice(first).flatten().to_numpy().reshape(-1, p.P)
                    rc = bitmap.revcomp_codes(fwd, p.k)
                    number = np.cumsum(batch.column("stage").to_numpy() == 1) - 1
                r = number[i]
                kmers, at = (fwd[r], own[r]) if original else (rc[r, ::-1], (seg_len - p.k - own[r])[::-1])
                samples = [(places - a).tolist() for places, a in zip(held.places(kmers), at.tolist(), strict=True)]
                best = best_vote(vote([s for s in samples if s], p.indel))
                if best and best[1] >= p.least_votes and best[0] > 0:
                    out.append((i, best[0] - (seg_off if original else read_len - seg_off - seg_len), best[1]))
            if out:
                rows, offset, votes = zip(*out, strict=True)
                take = pa.array(rows, pa.int64())
                columns = {"offset": pa.array(offset, pa.int32()), "votes": pa.array(votes, pa.int32())} | {c: batch.column(c).take(take) for c in ("read_id", "bucket_id", "seg_off", "is_original")}
                names = ["read_id", "bucket_id", "offset", "seg_off", "votes", "is_original"]
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return dealt.mapInArrow(run, f"read_id {kinds['read_id']}, bucket_id long, offset int, seg_off int, votes int, is_original boolean")


def merge_locations(found: DataFrame, read_lengths: DataFrame, p: Params) -> DataFrame:
    """Locations of a read's segments vote for each other where they agree; all with most votes remain.

    In order of bucket, forward before reverse, then segment: a location near proposals of its bucket and strand
    adds its votes to each, else it is a proposal itself.
    """
    turn = F.when(F.col("is_original"), F.col("seg_off")).otherwise(-F.col("seg_off"))
    row = F.struct("bucket_id", (~F.col("is_original")).cast("int").alias("rev"), turn.alias("turn"), "offset", "votes")
    per_read = found.groupBy("read_id").agg(F.array_sort(F.collect_list(row)).alias("all")).join(read_lengths, "read_id")
    reach = F.col("read_len") * F.lit(p.n)
    start = F.expr("cast(array() as array<struct<bucket_id:bigint,offset:int,rev:int,votes:int>>)")
    own = lambda x, votes: F.struct(x["bucket_id"].alias("bucket_id"), x["offset"].alias("offset"), x["rev"].alias("rev"), votes.cast("int").alias("votes"))

    def cast(state: Column, x: Column) -> Column:
        low, high = (x["offset"] - reach).cast("int"), (x["offset"] + reach).cast("int")
        near = lambda y: (y["bucket_id"] == x["bucket_id"]) & (y["rev"] == x["rev"]) & y["offset"].between(low, high)
        added = F.transform(state, lambda y: own(y, y["votes"] + F.when(near(y), x["votes"]).otherwise(0)))
        return F.when(F.exists(state, near), added).otherwise(F.concat(state, F.array(own(x, x["votes"]))))

    merged = per_read.withColumn("state", F.aggregate("all", start, cast))
    most = F.array_max(F.transform("state", lambda y: y["votes"]))
    kept = merged.select("read_id", F.explode(F.filter("state", lambda y: y["votes"] == most)).alias("y"))
    return kept.select("read_id", F.col("y.bucket_id").alias("bucket_id"), F.col("y.offset").alias("offset"), (F.col("y.rev") == 0).alias("is_original"), F.col("y.votes").alias("votes"))


def sam_rows(merged: DataFrame, reads: DataFrame, p: Params) -> DataFrame:
    """qname, flag, rname, pos, mapq, seq, qual of every location; reads join last, so their texts move once.

    ``pos`` is 0-based on the contig. A location is placed by its bucket's offset, which its id tells.
    """
    at = (F.col("bucket_id") % BUCKETS) * p.B + F.col("offset")
    placed = merged.select("read_id", F.when(F.col("is_original"), 0).otherwise(16).alias("flag"), F.floor(F.col("bucket_id") / F.lit(BUCKETS)).cast("long").alias("rname"), at.cast("long").alias("pos"), F.least(F.lit(60), F.lit(6) * F.col("votes")).alias("mapq"))
    return placed.join(reads.select("read_id", "name", "seq", "qual"), "read_id").select(F.col("name").alias("qname"), "flag", "rname", "pos", "mapq", "seq", "qual")
