"""Alignment of reads in windows of their bucket, by bit-parallel edit distance, with CIGARs.

Rows of a batch are aligned together: a column of the table of costs is a few words for each row (a bit tells whether the cost rises or
falls by one to the next base), and a step of all rows to the next column is some twenty operations on arrays. Only the words within
reach of ``limit`` edits are computed. Rows that pass are aligned again with their columns kept, and traced back together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.params import BUCKETS, Params

_ONE, _ALL = np.uint64(1), ~np.uint64(0)
_TOP = np.uint64(63)
#: Rows that are aligned together, and bytes of columns that may be kept for tracing.
_ROWS, _KEPT = 4096, 64 << 20


def run_lengths(ops: Column) -> Column:
    """CIGAR text of a string with one operation a base."""
    return F.array_join(F.transform(F.regexp_extract_all(ops, F.lit(r"((.)\2*)"), F.lit(1)), lambda r: F.concat(F.length(r), F.substring(r, 1, 1))), "")


def semi_global(read: str, window: str) -> tuple[int, int, str]:
    """(edits, start in the window, operations) of the best placement, by the whole table; gaps before and after it in the window are free.

    What ``best_placements`` must equal; of equal ends the leftmost, and going back a base against a base before a gap in the window.
    """
    n, m = len(read), len(window)
    w = np.frombuffer(window.encode(), np.uint8)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    step = np.arange(m + 1)
    for i, c in enumerate(read.encode(), 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (w != c))
        row = np.concatenate([[i], row])
        cost[i] = np.minimum.accumulate(row - step) + step  # gaps in the read
    j = int(cost[n].argmin())
    edits, i, ops = int(cost[n, j]), n, []
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (read[i - 1] != window[j - 1]):
            ops.append("=" if read[i - 1] == window[j - 1] else "X")
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return edits, j, "".join(reversed(ops))


@dataclass
class _Batch:
    """Rows whose reads have the same number of words: base codes, 4 where there is none."""

    reads: np.ndarray  # (rows, longest read)
    windows: np.ndarray  # (rows, longest window)
    m: np.ndarray
    n: np.ndarray
    limit: int

    def __post_init__(self):
        rows, self.words = len(self.m), max(1, -(-int(self.m.max(initial=0)) // 64))
        self.peq = np.zeros((5, self.words, rows), np.uint64)
        for i in range(self.reads.shape[1]):
            bit = _ONE << np.uint64(i & 63)
            for c in range(4):
                self.peq[c, i >> 6] |= np.where(self.reads[:, i] == c, bit, np.uint64(0))
        slack = int((self.n - self.m).max(initial=0))
        # words of the rows that a placement of at most ``limit`` edits can touch in column j
        self.low = [min(max(0, j - slack - self.limit - 1) // 64, self.words - 1) for j in range(self.windows.shape[1] + 1)]
        self.high = [min((j + self.limit + 1) // 64, self.words - 1) for j in range(self.windows.shape[1] + 1)]

    def take(self, at: np.ndarray) -> _Batch:
        return _Batch(self.reads[at], self.windows[at], self.m[at], self.n[at], self.limit)

    def columns(self, keep: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Fewest edits at any end, the leftmost such end, and the words of each column if they are to be kept."""
        rows = len(self.m)
        vp, vn = np.full((self.words, rows), _ALL), np.zeros((self.words, rows), np.uint64)
        last = self.words - 1
        top = self.high[0]
        # cost at the last base of the lowest word in reach: a word beyond holds a rise for each of its bases
        depth = lambda w: np.minimum(64 * (w + 1), self.m) if w == last else np.full(rows, 64 * (w + 1))
        score = depth(top).astype(np.int64)
        best = np.where(self.m == 0, 0, self.m).astype(np.int64)
        end = np.zeros(rows, np.int64)
        kept = []
        bottom = ((self.m - 1) & 63).astype(np.uint64)
        for j in range(1, self.windows.shape[1] + 1):
            low, high = self.low[j], self.high[j]
            if high > top:
                score += depth(high) - depth(top)
                top = high
            base = self.windows[:, j - 1]
            # a word above the reach is left alone: what came into it could only cost more
            rise, fall = np.full(rows, low > 0), np.zeros(rows, bool)
            held = []
            for w in range(low, high + 1):
                p, n = vp[w], vn[w]
                eq = self.peq[base, w, np.arange(rows)]
                eq = eq | fall.astype(np.uint64)
                d0 = (((eq & p) + p) ^ p) | eq | n
                hp, hn = n | ~(d0 | p), p & d0
                bit = bottom if w == last else _TOP
                if w == high:
                    score += (hp >> bit & _ONE).astype(np.int64) - (hn >> bit & _ONE).astype(np.int64)
                if keep:
                    row_hp, row_hn = hp, hn
                rise, fall, into_p, into_n = (hp >> _TOP).astype(bool), (hn >> _TOP).astype(bool), rise, fall
                hp, hn = hp << _ONE | into_p.astype(np.uint64), hn << _ONE | into_n.astype(np.uint64)
                vp[w], vn[w] = hn | ~(d0 | hp), hp & d0
                if keep:
                    held.append((vp[w].copy(), vn[w].copy(), row_hp, row_hn))
            if keep:
                kept.append((low, held))
            if high == last:
                better = (score < best) & (j <= self.n)
                best = np.where(better, score, best)
                end = np.where(better, j, end)
        return best, end, kept


def _traced(batch: _Batch, edits: np.ndarray, end: np.ndarray, kept: list) -> tuple[np.ndarray, list[str]]:
    """Starts and operations of rows, all traced back at once from their ends."""
    rows = len(edits)
    low = np.array([k[0] for k in kept] or [0])
    widest = max((len(k[1]) for k in kept), default=1)
    table = np.zeros((4, len(kept), widest, rows), np.uint64)
    for j, (_, held) in enumerate(kept):
        for w, words in enumerate(held):
            table[:, j, w] = words

    def bit(kind: int, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The bit of base i (from 1) in column j (from 1)."""
        w = (i - 1 >> 6) - low[j - 1]
        inside = (w >= 0) & (w < widest)
        return np.where(inside, table[kind, j - 1, np.clip(w, 0, widest - 1), r] >> (i - 1 & 63).astype(np.uint64) & _ONE, np.uint64(0)).astype(np.int64)

    i, j = batch.m.astype(np.int64).copy(), end.astype(np.int64).copy()
    ops = np.zeros((rows, int(batch.m.max(initial=0)) + batch.limit + 1), "S1")
    steps = np.zeros(rows, np.int64)
    active = np.flatnonzero(i > 0)
    while len(active):
        a, b = i[active], j[active]
        col = np.maximum(b, 1)
        up = np.where(b > 0, bit(0, a, col, active) - bit(1, a, col, active), 1)  # cost minus that of a base less
        over = np.where(a > 1, bit(2, np.maximum(a - 1, 1), col, active) - bit(3, np.maximum(a - 1, 1), col, active), 0)  # of the base before: cost minus that of a column less
        same = batch.reads[active, a - 1] == batch.windows[active, np.maximum(b, 1) - 1]
        diagonal = (b > 0) & (up + over == np.where(same, 0, 1))
        insert = ~diagonal & (up == 1)
        ops[active, steps[active]] = np.where(diagonal, np.where(same, b"=", b"X"), np.where(insert, b"I", b"D"))
        steps[active] += 1
        i[active] -= diagonal | insert
        j[active] -= ~insert
        active = active[i[active] > 0]
    return j, [b"".join(ops[r, : steps[r]][::-1].tolist()).decode() for r in range(rows)]


_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def _padded(texts: list[str], code: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), code, np.uint8)
    flat = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    row = np.repeat(np.arange(len(texts)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def best_placements(reads: list[str], windows: list[str], limit: int) -> list[tuple[int, int, str] | None]:
    """``semi_global`` of each pair over ACGT with at most ``limit`` edits; None for the others."""
    out: list[tuple[int, int, str] | None] = [None] * len(reads)
    words = [-(-len(r) // 64) for r in reads]
    order = sorted((i for i in range(len(reads)) if len(reads[i]) - len(windows[i]) <= limit), key=lambda i: (words[i], len(windows[i])))
    at = 0
    while at < len(order):
        upto = at
        while upto < len(order) and upto - at < _ROWS and words[order[upto]] == words[order[at]]:
            upto += 1
        group = order[at:upto]
        at = upto
        (r, m), (w, n) = _padded([reads[i] for i in group], 4), _padded([windows[i] for i in group], 4)
        batch = _Batch(r, w, m, n, limit)
        edits, end, _ = batch.columns(False)
        passed = np.flatnonzero(edits <= limit)
        some = max(1, _KEPT // max(1, 32 * w.shape[1] * (max(b - a for a, b in zip(batch.low, batch.high, strict=True)) + 1)))
        for low in range(0, len(passed), some):
            part = passed[low : low + some]
            chosen = batch.take(part)
            best, ends, kept = chosen.columns(True)
            starts, ops = _traced(chosen, best, ends, kept)
            for k, e, s, o in zip(part.tolist(), best.tolist(), starts.tolist(), ops, strict=True):
                out[group[k]] = (e, s, o)
    return out


def align(pairs: DataFrame, least_mapq: int = 40) -> DataFrame:
    """Adds edits, start, mapq (60 less the edits) and cigar to (…, seq, window) and keeps rows with at least ``least_mapq``."""
    limit = 60 - least_mapq
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = best_placements(batch.column("seq").to_pylist(), batch.column("window").to_pylist(), limit)
            some = pa.array([i for i, f in enumerate(found) if f is not None], pa.int64())
            edits, start, ops = zip(*(f for f in found if f is not None), strict=True) if len(some) else ((), (), ())
            kept = [batch.column(c).take(some) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(edits, pa.int32()), pa.array(start, pa.int32()), pa.array(ops, pa.string())], names=[*batch.schema.names, "edits", "start", "ops"])

    out = pairs.mapInArrow(run, fields + ", edits int, start int, ops string")
    return out.withColumn("mapq", F.lit(60) - F.col("edits")).withColumn("cigar", run_lengths(F.col("ops"))).drop("ops")


def windows(found: DataFrame, read_lengths: DataFrame, buckets: DataFrame, p: Params) -> DataFrame:
    """Adds ``window`` and ``window_at`` (its place on the contig) to locations (read_id, bucket_id, offset, …): the bases from the read's
    start on, one and the allowed indels longer than the read, up to the bucket's end.

    A start before the bucket takes bases from the buckets before it; one before the contig begins there.
    """
    sized = found.join(read_lengths.select("read_id", "read_len"), "read_id").withColumn("loc", F.struct("bucket_id", "seg_off", "is_original"))
    index = F.col("bucket_id") % BUCKETS
    begin = F.greatest(F.lit(0).cast("long"), index * p.B + F.col("offset"))
    end = F.least(index * p.B + F.col("offset") + F.col("read_len") + 1 + F.floor(F.col("read_len") * F.lit(p.n)), (index + 1) * p.B + p.L)
    sized = sized.withColumn("window_at", begin).withColumn("window_end", end)
    pieces = sized.select("read_id", "loc", "window_at", "window_end", "bucket_id", F.explode(F.sequence(F.floor(F.col("window_at") / p.B), index)).alias("piece"))
    own = F.col("bucket_id") - index + F.col("piece")
    low = F.greatest("window_at", F.col("piece") * p.B)
    high = F.when(F.col("piece") == index, F.col("window_end")).otherwise(F.least(F.col("window_end"), (F.col("piece") + 1) * p.B))
    pieces = pieces.select("read_id", "loc", "piece", own.alias("at_bucket"), (low - F.col("piece") * p.B).cast("int").alias("skip"), (high - low).cast("int").alias("size"))
    cut = pieces.join(buckets.select(F.col("bucket_id").alias("at_bucket"), F.col("seq").alias("text")), "at_bucket").select("read_id", "loc", "piece", F.substring("text", F.col("skip") + 1, F.greatest(F.lit(0), F.col("size"))).alias("text"))
    whole = cut.groupBy("read_id", "loc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "text")))["text"], "").alias("window"))  # a read's length over B pieces
    return sized.join(whole, ["read_id", "loc"]).drop("loc", "window_end", "read_len")


def aligned_rows(found: DataFrame, reads: DataFrame, buckets: DataFrame, p: Params, least_mapq: int = 40) -> DataFrame:
    """SAM rows with CIGARs of every location of a read whose alignment passes: qname, flag, rname, pos, mapq, cigar, edits, seq, qual.

    A reverse location aligns the read's reverse complement, so position and CIGAR run along the contig.
    """
    placed = windows(found, reads.select("read_id", F.length("seq").alias("read_len")), buckets, p).join(reads.select("read_id", "name", "seq", "qual"), "read_id")
    turned = placed.withColumnRenamed("seq", "read_seq").withColumn("seq", F.when(F.col("is_original"), F.col("read_seq")).otherwise(S.revcomp("read_seq")))
    done = align(turned, least_mapq)
    return done.select(F.col("name").alias("qname"), F.when(F.col("is_original"), 0).otherwise(16).alias("flag"), F.floor(F.col("bucket_id") / F.lit(BUCKETS)).cast("long").alias("rname"), (F.col("window_at") + F.col("start")).cast("long").alias("pos"), "mapq", "cigar", "edits", F.col("read_seq").alias("seq"), "qual")


def with_errors(reads: DataFrame, substitution: float, insertion: float, deletion: float, seed: int = 1) -> DataFrame:
    """Reads (read_id, seq) with random errors whose numbers are Poisson; a read's errors depend on seed and id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for read_id, seq in zip(batch["read_id"], batch["seq"], strict=True):
                rng = np.random.default_rng([seed, int(read_id)])
                bases = list(seq)
                for _ in range(rng.poisson(deletion * len(seq))):
                    if bases:
                        at = int(rng.integers(len(bases)))
                        del bases[at]
                for _ in range(rng.poisson(insertion * len(seq))):
                    bases.insert(int(rng.integers(len(bases) + 1)), "ACGT"[rng.integers(4)])
                for _ in range(rng.poisson(substitution * len(seq))):
                    if bases:
                        at = int(rng.integers(len(bases)))
                        bases[at] = "ACGT"[("ACGT".index(bases[at]) + 1 + int(rng.integers(3))) % 4]
                out.append("".join(bases))
            yield batch.assign(seq=out)

    return reads.select("read_id", "seq").mapInPandas(run, reads.select("read_id", "seq").schema)
