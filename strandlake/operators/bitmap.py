"""Candidate buckets by blocks of buckets, each held against all seeds.

A task reads its blocks one by one, with the packed seeds beside each (a Cartesian product of a few large rows), so neither side is copied in
an exchange. Memory is one block's index and some seeds, whatever the number of reads and buckets.

Where all q-grams are indexed, a block is a sorted list of (k-mer, bucket) with every k-mer whose q-grams all stand in the bucket
(``Postings``): a segment's lists are sorted together and counted. With a sample of the q-grams (``f < 1``) a k-mer fits far more
buckets, so a block holds one bitmap a q-gram, a bit for each bucket (``Block``). The row of a k-mer is the AND of its q-grams' bitmaps; the
misses of all buckets are counted at once in bit planes, a carry-save counter that saturates where the misses reach the limit. A k-mer none of
whose q-grams are in the sample says nothing about any bucket: its row is all ones, which costs a word as any other row does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.params import Params

#: Buckets of a block of bitmaps, and segments of one row of packed seeds.
BLOCK, PART = 2048, 65_536
#: Bases of a block of postings (8 bytes of sorted pairs each), and segments (some 72 bytes each) that a task holds beside a block.
_BLOCK_BASES, _HELD = 8 << 20, 2 << 20
#: Segments that are answered together, and pairs of segment and bucket that are sorted together.
_STEP, _PAIRS = 16_384, 1 << 21
#: Segments that are counted together: their planes stay in the processor's cache.
_ROWS = 256
#: q up to which a table of all q-grams is held; above, q-grams are found by binary search.
DENSE_Q = 12
KEY = ["read_id", "seg_off", "is_original"]


def _sampled(codes: np.ndarray, p: Params) -> np.ndarray:
    """Which q-grams are in the index's sample: the hash of ``functions.seq``, over arrays."""
    if p.f >= 1:
        return np.ones(codes.shape, bool)
    limit = int(np.trunc(np.float32(10000) * np.float32(p.f)))
    return (12345 * codes.astype(np.int64) + 678) % 116731 % 10000 <= limit


def flags(codes: np.ndarray, q: int) -> np.ndarray:
    """What ``among`` looks up: a flag for every q-gram where q allows, else the sorted codes."""
    if q > DENSE_Q:
        return np.sort(codes)
    out = np.zeros(4**q, bool)
    out[codes] = True
    return out


def among(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    if known.dtype == bool:
        return known[grams]
    return known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams if len(known) else np.zeros(grams.shape, bool)


def subcodes(kmers: np.ndarray, p: Params) -> np.ndarray:
    """Codes of the q-grams inside each k-mer, along a new first axis."""
    return np.stack([kmers >> np.int64(2 * i) & np.int64(4**p.q - 1) for i in range(p.k - p.q + 1)])


def revcomp_codes(kmers: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(kmers)
    for i in range(k):
        out = out << np.int64(2) | np.int64(3) - (kmers >> np.int64(2 * i) & np.int64(3))
    return out


class Block:
    """Bitmaps of the q-grams of a block of buckets."""

    def __init__(self, bucket_ids: list[np.ndarray], seqs: list[pa.Array], p: Params):
        self.p = p
        self.ids = np.concatenate(bucket_ids) if bucket_ids else np.zeros(0, np.int64)
        lane, code = [], []
        at = 0
        for part in seqs:
            lists = S.window_codes(part, p.q, distinct=True)
            lane.append(np.repeat(np.arange(at, at + len(part)), np.diff(lists.offsets.to_numpy())))
            code.append(lists.values.to_numpy(zero_copy_only=False)[: len(lane[-1])])
            at += len(part)
        lane, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lane, code))
        kept = _sampled(code, p)
        lane, code = lane[kept], code[kept]
        self.grams, row = np.unique(code, return_inverse=True)
        n = len(self.grams)
        self.absent, self.unsampled = n, n + 1
        words = max(1, -(-len(self.ids) // 64))
        bits = np.zeros((words, n + 2), np.uint64)
        for word in range(words):  # lanes ascend, so a word's are together, and those of one lane are distinct rows
            low, high = np.searchsorted(lane, [64 * word, 64 * word + 64])
            edges = np.searchsorted(lane[low:high], np.arange(64 * word, 64 * word + 65)) + low
            for i in range(64):
                if edges[i] < edges[i + 1]:
                    bits[word, row[edges[i] : edges[i + 1]]] |= np.uint64(1) << np.uint64(i)
        self.valid = np.zeros(words, np.uint64)
        for i in range(len(self.ids)):
            self.valid[i >> 6] |= np.uint64(1) << np.uint64(i & 63)
        bits[:, self.unsampled] = self.valid
        self.bits = np.ascontiguousarray(bits.T)
        self.table = None
        if p.q <= DENSE_Q:
            every = np.arange(4**p.q)
            self.table = np.where(_sampled(every, p), self.absent, self.unsampled).astype(np.int32)
            self.table[self.grams] = np.arange(n)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[grams]
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        known = self.grams[at] == grams if len(self.grams) else np.zeros(grams.shape, bool)
        return np.where(known, at, np.where(_sampled(grams, self.p), self.absent, self.unsampled))

    def levels(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of segments (rows of S k-mers): buckets at each number of misses under the limit, and the bitmap of the fewest misses."""
        p = self.p
        row = self.rows(subcodes(kmers, p))  # (q-grams, segments, S)
        shape = (len(kmers), self.bits.shape[1])
        planes = [np.zeros(shape, np.uint64) for _ in range(max(p.faults - 1, 1).bit_length())]
        over = np.broadcast_to(~self.valid, shape).copy()
        for s in range(kmers.shape[1]):
            hit = self.bits[row[0, :, s]]
            for g in range(1, len(row)):
                hit &= self.bits[row[g, :, s]]
            carry = ~hit
            for i, plane in enumerate(planes):
                planes[i], carry = plane ^ carry, plane & carry
            over |= carry
        counts = np.zeros((len(kmers), p.faults), np.int64)
        best = np.zeros(shape, np.uint64)
        open_ = np.ones(len(kmers), bool)
        for m in range(p.faults):
            at = ~over
            for i, plane in enumerate(planes):
                at &= plane if m >> i & 1 else ~plane
            counts[:, m] = np.bitwise_count(at).sum(axis=1)
            new = open_ & (counts[:, m] > 0)
            best[new] = at[new]
            open_ &= ~new
        return counts, best


def picked_seeds(segs: DataFrame, common: np.ndarray | None, p: Params, least: float = 0.2) -> DataFrame:
    """(read_id, seg_off, kmers): S evenly spread good k-mers that have an indexed rare q-gram, of each segment with enough of them.

    ``common``: ``flags`` of the q-grams that are not rare (at most 4 ** q of them, whatever the data), or None to keep all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, known, quality, n = _windows_of(batch, p)
            good = known & (quality >= p.b * p.k)
            if common is not None:
                grams = subcodes(code, p)
                good &= (_sampled(grams, p) & ~among(grams, common)).any(axis=0)
            use, at = spread_over(good, n, p.S, least)
            rows = pa.array(use)
            yield pa.RecordBatch.from_arrays([batch.column("read_id").take(rows), batch.column("seg_off").take(rows), _lists(code[at])], names=["read_id", "seg_off", "kmers"])

    cols = segs.select("read_id", "seg_off", "seq", "qual")
    return cols.mapInArrow(run, f"read_id {cols.schema['read_id'].dataType.simpleString()}, seg_off int, kmers array<bigint>")


def _windows_of(batch: pa.RecordBatch, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a batch of segments: codes, whether they are bases alone, quality sums; and the windows of each segment."""
    lists = S.window_codes(batch.column("seq"), p.k)
    code = lists.values.to_numpy(zero_copy_only=False)
    known = ~np.isnan(code) if code.dtype.kind == "f" else np.ones(len(code), bool)
    return np.where(known, code, 0).astype(np.int64), known, S.window_sum_array(batch.column("qual"), p.k), np.diff(lists.offsets.to_numpy())


def _lists(flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def spread_over(good: np.ndarray, n: np.ndarray, size: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Segments (of ``n`` windows each) with at least ``least * size`` good windows, and ``size`` places of each among all windows,
    evenly spread over its good ones, both ends included; places repeat where there are fewer."""
    chosen = np.flatnonzero(good)
    count = np.bincount(np.repeat(np.arange(len(n)), n)[chosen], minlength=len(n))
    use = np.flatnonzero((count > 0) & (count >= least * size))
    last = count[use][:, None] - 1
    spread = np.floor(np.arange(size - 1) * (last + 1) / float(max(size - 1, 1))).astype(np.int64)
    at = np.concatenate([spread, last], axis=1) + (np.cumsum(count) - count)[use][:, None]
    return use, chosen[at] if len(use) else np.zeros((0, size), np.int64)


def _windows_at(digit: np.ndarray, at: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at`` of a block's digits, those from which a window of ``length`` has room, and the windows' codes."""
    at = at[room[at] >= length]
    code = np.zeros(len(at), np.int64)
    for j in range(length):
        code = code << np.int64(2) | digit[at + j]
    return at, code


def _every_window(digit: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of all places."""
    n = max(len(digit) - length + 1, 0)
    code = np.zeros(n, np.int64)
    for j in range(length):
        code <<= np.int64(2)
        code |= digit[j : n + j]
    at = np.flatnonzero(room[:n] >= length)
    return at, code[at]


def _turns(at: np.ndarray, lane: np.ndarray, code: np.ndarray, digit: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of ``length``, those that stand at several places of a lane; and of these, such as differ in the base before and in that after."""
    order = np.lexsort((code, lane)) if 2 * length + int(lane.max(initial=0)).bit_length() > 62 else np.argsort(lane << np.int64(2 * length) | code)
    new = np.append(True, (lane[order[1:]] != lane[order[:-1]]) | (code[order[1:]] != code[order[:-1]])) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    kept = np.repeat(size > 1, size)
    order, group = order[kept], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    place = at[order]
    varied = np.ones(len(place), bool)
    inside = (place > 0) & (room[np.maximum(place - 1, 0)] == room[place] + 1)  # the base before is of the lane
    before = np.where(inside, digit[np.maximum(place - 1, 0)], 4)
    after = np.where(room[place] > length, digit[np.minimum(place + length, len(digit) - 1)], 4)
    for base in (before, after):
        seen = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
        for c in range(5):
            has = np.zeros(len(seen), np.int64)
            has[group[base == c]] = 1
            seen += has
        varied &= (seen > 1)[group]
    return place, place[varied]


def _recombined(digit: np.ndarray, lane: np.ndarray, room: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(lane, code) of k-mers whose q-grams all stand in a lane, though the k-mer may not.

    Two words of a lane that overlap in all but a base each make one that is a base longer. It is new only if their overlap stands at several
    places with different bases before and after, or if one of the two is new; so words of each length are made from those around such places.
    """
    at, code = _every_window(digit, room, p.q - 1)
    wide = 2 * (p.k - 1) + int(lane.max(initial=0)).bit_length() > 62
    pair = [("lane", np.int64), ("code", np.int64)]

    def joined(lanes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not wide:
            return lanes << np.int64(2 * (p.k - 1)) | codes
        out = np.empty(len(codes), pair)
        out["lane"], out["code"] = lanes, codes
        return out

    made_lane, made = np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.zeros(0, np.int64)
    for length in range(p.q, p.k):
        if length > p.q:
            at, code = _windows_at(digit, at, room, length - 1)
        at, turns = _turns(at, lane[at], code, digit, room, length - 1)
        around = np.concatenate([turns - t for t in range(p.k - p.q + 1)])
        near = S.sorted_distinct(np.concatenate([near, around[around >= 0]]))
        place, codes = _windows_at(digit, near, room, length)
        known = S.sorted_distinct(joined(np.concatenate([lane[place], made_lane]), np.concatenate([codes, made])))
        place, first = _windows_at(digit, turns[turns > 0] - 1, room, length)
        firsts = S.sorted_distinct(joined(np.concatenate([lane[place], made_lane]), np.concatenate([first, made])))
        first_lane, first = (firsts["lane"], firsts["code"]) if wide else (firsts >> np.int64(2 * (p.k - 1)), firsts & np.int64(4 ** (p.k - 1) - 1))
        lanes_found, found = [], []
        for c in map(np.int64, range(4)):
            ends, begins = (first & np.int64(4 ** (length - 1) - 1)) << np.int64(2) | c, made >> np.int64(2) | c << np.int64(2 * (length - 1))
            for lanes, other, longer in ((first_lane, ends, first << np.int64(2) | c), (made_lane, begins, made | c << np.int64(2 * length))):
                asked = joined(lanes, other)
                hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(len(asked), bool)
                lanes_found.append(lanes[hit])
                found.append(longer[hit])
        made_lane, made = np.concatenate(lanes_found), np.concatenate(found)
    return made_lane, made


class Postings:
    """The buckets of a block by k-mer: those that hold every q-gram of it, as the bitmaps tell, kept as sorted pairs of k-mer and bucket."""

    def __init__(self, ids: np.ndarray, seqs: pa.Array, p: Params):
        self.p, self.ids = p, ids
        self.bits = np.int64(max(1, len(ids) - 1).bit_length())
        lanes, codes, low = [], [], 0
        while low < len(seqs):
            upto = min(len(seqs), low + max(1, S._BASES // (p.B + p.L)))
            data, offsets = S._text_bytes(seqs.slice(low, upto - low))
            digit = S._DIGIT[data]
            lane = np.repeat(np.arange(upto - low), np.diff(offsets))
            end = np.repeat(offsets[1:], np.diff(offsets))
            if (digit < 0).any():  # a window ends before a character that is no base
                wrong = np.append(np.flatnonzero(digit < 0), len(digit))
                end = np.minimum(end, wrong[np.searchsorted(wrong, np.arange(len(digit)))])
            room = end - np.arange(len(digit))
            place, code = _every_window(digit, room, p.k)
            more = _recombined(digit, lane, room, p) if p.k > p.q else (lane[:0], code[:0])
            lanes += [lane[place] + low, more[0] + low]
            codes += [code, more[1]]
            low = upto
        lane, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lanes, codes))
        del lanes, codes
        self.names = None
        if p.k > DENSE_Q:
            self.names, code = np.unique(code, return_inverse=True)
        code = code.astype(np.int64) << self.bits
        code |= lane
        del lane
        code.sort()
        self.pairs = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
        del code
        names = self.pairs >> self.bits
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
        self.starts = np.append(first, [len(names)] * 2).astype(np.int32)
        if self.names is None:
            self.table = np.full(4**p.k, len(first), np.int32)
            self.table[names[first]] = np.arange(len(first), dtype=np.int32)

    def hits(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, lane, misses) of the buckets with fewer misses than the limit, of segments (rows of S k-mers).

        The lists of a segment's rarer k-mers are sorted together and counted; what can still have enough is looked up under its two commonest,
        whose lists are a third of all.
        """
        p, size = self.p, kmers.shape[1]
        if self.names is None:
            name, at = kmers.astype(np.int64), self.table[kmers]
        else:
            at = np.minimum(np.searchsorted(self.names, kmers), max(len(self.names) - 1, 0))
            at = np.where(self.names[at] == kmers, at, len(self.names)) if len(self.names) else np.zeros(kmers.shape, np.int64)
            name = at
        low = self.starts[at]
        n = self.starts[at + 1] - low
        least = size - p.faults + 1
        alive = np.flatnonzero((n > 0).sum(axis=1) >= max(least, 1))
        rare = max(size - 2, min(size, p.faults))
        low, n, name = low[alive], n[alive], name[alive]
        order = np.argsort(n, axis=1)
        low, n = (np.take_along_axis(x, order[:, :rare], axis=1) for x in (low, n))
        rest = np.take_along_axis(name, order[:, rare:], axis=1)
        total = np.cumsum(n.sum(axis=1, dtype=np.int64))
        out, begin = [], 0
        while begin < len(alive):
            upto = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PAIRS, "right")))
            some, counts = n[begin:upto].ravel(), n[begin:upto].sum(axis=1)
            before = np.cumsum(some) - some
            place = np.arange(int(some.sum())) + np.repeat(low[begin:upto].ravel() - before, some)
            pair = np.repeat(np.arange(upto - begin), counts) << self.bits | self.pairs[place] & ((np.int64(1) << self.bits) - 1)
            if (upto - begin) << int(self.bits) < 1 << 31:
                pair = pair.astype(np.int32)
            pair.sort()
            edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
            held = np.diff(np.append(edge, len(pair)))
            enough = held >= max(rare - p.faults + 1, 1)
            pair, held = pair[edge[enough]].astype(np.int64), held[enough]
            row, lane = pair >> self.bits, pair & ((np.int64(1) << self.bits) - 1)
            for j in range(rest.shape[1]):
                asked = rest[begin:upto, j][row] << self.bits | lane
                held = held + (self.pairs[np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)] == asked)
                left = held + (rest.shape[1] - 1 - j) >= least
                row, lane, held = row[left], lane[left], held[left]
            out.append((alive[begin:upto][row], lane, size - held))
            begin = upto
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def levels(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets at each number of misses under the limit, of each segment; and (segment, bucket) of the fewest where they are at most C."""
        row, lane, misses = self.hits(kmers)
        counts = np.bincount(row * self.p.faults + misses, minlength=len(kmers) * self.p.faults).reshape(len(kmers), self.p.faults)
        fewest = (counts > 0).argmax(axis=1)
        few = counts[np.arange(len(kmers)), fewest] <= self.p.C
        best = few[row] & (misses == fewest[row])
        order = np.argsort(row[best], kind="stable")
        return counts, fewest, row[best][order], self.ids[lane[best][order]]


class Bitmaps:
    """The same of a block's bitmaps, for a sample of the q-grams."""

    def __init__(self, ids: np.ndarray, seqs: pa.Array, p: Params):
        self.held = Block([ids], [seqs], p)

    def levels(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.held.p
        done = [self.held.levels(kmers[low : low + _ROWS]) for low in range(0, len(kmers), _ROWS)]
        counts = np.concatenate([c for c, _ in done])
        fewest = (counts > 0).argmax(axis=1)
        few = counts.any(axis=1) & (counts[np.arange(len(kmers)), fewest] <= p.C)
        rows, lanes = [], []
        for i, (_, best) in enumerate(done):
            kept = np.flatnonzero(few[i * _ROWS : i * _ROWS + _ROWS])
            row, lane = np.nonzero(np.unpackbits(best[kept].view(np.uint8), axis=1, bitorder="little"))
            rows.append(kept[row] + i * _ROWS)
            lanes.append(lane)
        return counts, fewest, np.concatenate(rows), self.held.ids[np.concatenate(lanes)]


def packed_seeds(seeds: DataFrame, p: Params, part: int = PART) -> DataFrame:
    """(read_ids, seg_offs, kmers): ``part`` segments a row, the k-mers one behind the other."""
    kind, code = seeds.schema["read_id"].dataType.simpleString(), "int" if p.k <= 15 else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, offs = (whole.column(c).combine_chunks() for c in ("read_id", "seg_off"))
            kmers = np.concatenate([b.column("kmers").flatten().to_numpy() for b in held]).astype(np.int32 if code == "int" else np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([one(ids), one(offs), one(pa.array(kmers))], names=["read_ids", "seg_offs", "kmers"])

        held, n = [], 0
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                held.append(batch.slice(low, part - n))
                low, n = low + held[-1].num_rows, n + held[-1].num_rows
                if n == part:
                    yield row(held)
                    held, n = [], 0
        if held:
            yield row(held)

    return seeds.select("read_id", "seg_off", "kmers").mapInArrow(run, f"read_ids array<{kind}>, seg_offs array<int>, kmers array<{code}>")


def _packed_buckets(buckets: DataFrame, p: Params, block: int) -> DataFrame:
    """(bucket_ids, sizes, bases): up to ``block`` buckets a row, by the partitions that they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([b.column("bucket_id").to_numpy(zero_copy_only=False).astype(np.int64) for b in held])
            texts = [S._text_bytes(b.column("seq")) for b in held]
            parts = [ids, np.concatenate([np.diff(o) for _, o in texts]).astype(np.int64), np.concatenate([d for d, _ in texts])]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["bucket_ids", "sizes", "bases"])

        for batch in batches:
            low = 0
            while low < batch.num_rows:
                held.append(batch.slice(low, block - n))
                low, n = low + held[-1].num_rows, n + held[-1].num_rows
                if n == block:
                    yield row()
                    held, n = [], 0
        if held:
            yield row()

    return buckets.select("bucket_id", "seq").mapInArrow(run, "bucket_ids binary, sizes binary, bases binary")


def matches(buckets: DataFrame, seeds: DataFrame, n_buckets: int, n_seeds: int, p: Params, block: int | None = None, part: int = PART) -> DataFrame:
    """(read_id, seg_off, is_original, counts, misses, bucket_ids) for each strand of a segment and each block in which a bucket has
    fewer misses than the limit: buckets at each number of misses, the fewest of them, and the buckets that have it, where there are
    at most C. A strand with more than C is not mapped, so more are never asked for."""
    return packed_matches(buckets, packed_seeds(seeds, p, part), n_seeds, p, block)


def packed_matches(buckets: DataFrame, packed: DataFrame, n_seeds: int, p: Params, block: int | None = None) -> DataFrame:
    """``matches`` of ``packed_seeds``. Every block meets every row of seeds in a product that moves neither through an exchange: a task reads
    its blocks, and the stored seeds beside each. ``_HELD`` segments at most are in memory beside a block."""
    block = block or max(1, min(BLOCK if p.f < 1 else 1 << 30, _BLOCK_BASES // (p.B + p.L)))
    id_type = packed.schema["read_ids"].dataType.elementType.simpleString()
    pairs = _packed_buckets(buckets, p, block).crossJoin(packed.coalesce(max(1, -(-n_seeds // _HELD))).hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("bucket_ids")[i].as_buffer()
                if held is None or not own.equals(name):
                    held = None  # the last block's index goes before the next is made
                    sizes, bases = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("sizes", np.int64), ("bases", np.uint8)))
                    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int64())
                    seqs = pa.LargeStringArray.from_buffers(len(sizes), ends.buffers()[1], pa.py_buffer(bases.tobytes()))
                    name = pa.py_buffer(own.to_pybytes())
                    held = (Postings if p.f >= 1 else Bitmaps)(np.frombuffer(name, np.int64), seqs, p)
                ids, offs, kmers = (batch.column(c).slice(i, 1).flatten() for c in ("read_ids", "seg_offs", "kmers"))
                kmers = kmers.to_numpy().reshape(len(ids), -1)
                for low in range(0, len(ids), _STEP):
                    yield from _answers(held, ids.slice(low, _STEP), offs.slice(low, _STEP), kmers[low : low + _STEP], p)

    return pairs.mapInArrow(run, f"read_id {id_type}, seg_off int, is_original boolean, counts array<bigint>, misses int, bucket_ids array<bigint>")


def _answers(held: Postings | Bitmaps, ids: pa.Array, offs: pa.Array, kmers: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    for original in (True, False):
        counts, misses, row, bucket = held.levels(kmers if original else revcomp_codes(kmers.astype(np.int64), p.k))
        some = np.flatnonzero(counts.any(axis=1))
        if not len(some):
            continue
        take = pa.array(some)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids))[some])])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(take), offs.take(take), pa.array(np.full(len(some), original)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * p.faults + 1, p.faults), pa.int32()), pa.array(counts[some].ravel())),
                pa.array(misses[some], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bucket)),
            ],
            names=[*KEY, "counts", "misses", "bucket_ids"],
        )


def candidates(found: DataFrame, p: Params) -> DataFrame:
    """(read_id, seg_off, is_original, bucket_id, misses): the buckets with the fewest misses, all ties, of strands with at most C."""
    strand = found.groupBy(*KEY).agg(F.min("misses").alias("misses"), F.collect_list(F.struct("misses", F.get("counts", F.col("misses")).alias("n"), "bucket_ids")).alias("blocks"))
    top = F.filter("blocks", lambda b: b["misses"] == F.col("misses"))
    kept = strand.select(*KEY, "misses", top.alias("top")).where(F.aggregate("top", F.lit(0).cast("long"), lambda a, b: a + b["n"]) <= p.C)
    return kept.select(*KEY, F.explode(F.flatten("top.bucket_ids")).alias("bucket_id"), F.col("misses").cast("long").alias("misses"))


def levels(found: DataFrame, p: Params) -> DataFrame:
    """(read_id, seg_off, is_original, misses, n, n_upto): buckets at each number of misses under the limit, and up to it."""
    sums = found.groupBy(*KEY).agg(*(F.sum(F.get("counts", F.lit(m))).alias(f"n{m}") for m in range(p.faults)))
    total = F.lit(0).cast("long")
    each = []
    for m in range(p.faults):
        total = total + F.col(f"n{m}")
        each.append(F.struct(F.lit(m).cast("long").alias("misses"), F.col(f"n{m}").alias("n"), total.alias("n_upto")))
    return sums.select(*KEY, F.explode(F.array(*each)).alias("x")).select(*KEY, "x.*").where("n > 0")
