"""Column factories over DNA strings: encoding, reverse complement, windows, sampling, quality.

A k-mer's code is its base-4 number, A, C, G, T as 0..3, the first base most
significant. All are built-in expressions, so they stay in the JVM, but for the codes
and sums of windows, which work on whole Arrow arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode(kmer: Column | str) -> Column:
    """Base-4 code of a k-mer (k up to 31); null where a character isn't one of ACGT in either case."""
    s = F.upper(_col(kmer))
    return F.when(s.rlike("^[ACGT]+$"), encode_clean(s))


def encode_clean(kmer: Column | str) -> Column:
    """``encode`` for strings known to be over ACGT."""
    return F.conv(F.translate(_col(kmer), "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def revcomp(seq: Column | str) -> Column:
    return F.translate(F.reverse(_col(seq)), "ACGT", "TGCA")


def revcomp_code(code: Column | str, k: int) -> Column:
    """Code of the reverse complement: complement the bits, reverse the 2-bit groups."""
    c = _col(code)
    out = F.lit(0).cast("long")
    for i in range(k):
        out = F.shiftleft(out, 2).bitwiseOR(F.lit(3) - F.shiftright(c, 2 * i).bitwiseAND(F.lit(3)))
    return out


def canonical(code: Column | str, k: int) -> Column:
    """The lesser of a code and its reverse complement's: one number for both strands."""
    return F.least(_col(code), revcomp_code(code, k))


def subcodes(code: Column | str, k: int, q: int) -> Column:
    """Codes of the q-grams inside a k-mer, the rightmost first."""
    c, mask = _col(code), F.lit(4**q - 1).cast("long")
    return F.array(*(F.shiftright(c, 2 * i).bitwiseAND(mask) for i in range(k - q + 1)))


def positions(n: Column) -> Column:
    """[0, n) as an array; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row; inside a lambda it would be once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


_DIGIT = np.full(256, -1, np.int64)
for _i, _c in enumerate("ACGT"):
    _DIGIT[[ord(_c), ord(_c.lower())]] = _i


#: Bases whose windows are coded together: some 64 bytes of scratch arrays a base.
_BASES = 1 << 20


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array and the offsets of its texts; null is empty."""
    whole = texts.cast(pa.large_string()).fill_null("")
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _windows(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text, and of every window its text and its first byte."""
    n = np.maximum(np.diff(offsets) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    return n, row, np.arange(len(row)) - np.repeat(ends - n, n) + np.repeat(offsets[:-1], n)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` of integers; sorting is several times as fast as the hash table of some versions."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _codes_of(seqs: pa.Array, k: int, distinct: bool) -> pa.Array:
    data, offsets = _text_bytes(seqs)
    digit = _DIGIT[data]
    n, row, at = _windows(offsets, k)
    code = np.zeros(max(len(digit) - k + 1, 0), np.int64)
    for j in range(k):
        code = code * 4 + digit[j : len(digit) - k + 1 + j] if len(code) else code
    code = code[at]
    wrong = np.concatenate([[0], np.cumsum(digit < 0)])
    bad = wrong[at + k] > wrong[at] if wrong[-1] else np.zeros(len(at), bool)
    if distinct:
        pairs = np.unique(np.stack([row[~bad], code[~bad]]), axis=1) if 2 * k > 40 else sorted_distinct((row[~bad] << np.int64(2 * k)) | code[~bad])
        row, code = pairs if 2 * k > 40 else (pairs >> np.int64(2 * k), pairs & np.int64(4**k - 1))
        bad, n = np.zeros(len(code), bool), np.bincount(row, minlength=len(n))
    starts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(~seqs.is_valid().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(starts, pa.array(code, mask=bad))


def window_codes(seqs: pa.Array, k: int, distinct: bool = False) -> pa.Array:
    """Lists of the codes of each sequence's windows; null where a window has another character.

    Sequences are taken some ``_BASES`` bases at a time (a longer one by itself), so scratch arrays don't grow with the batch.
    """
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(seqs).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if sizes[-1] >= 1 << 31:
        raise ValueError("a batch has 2**31 bases or more: lower spark.sql.execution.arrow.maxRecordsPerBatch, or cut the contigs into buckets first")
    done, at = [], 0
    while at < len(seqs) or not done:
        upto = min(len(seqs), max(at + 1, int(np.searchsorted(sizes, sizes[at] + _BASES, "right")) - 1))
        done.append(_codes_of(seqs.slice(at, upto - at), k, distinct))
        at = upto
    return done[0] if len(done) == 1 else pa.concat_arrays(done)


def window_sum_array(quals: pa.Array, k: int) -> np.ndarray:
    """Sums of quality ranks over every window of length k of each quality string, one behind the other."""
    data, offsets = _text_bytes(quals)
    sums = np.concatenate([[0], np.cumsum(data.astype(np.int64) - 33)])
    at = _windows(offsets, k)[2]
    return sums[at + k] - sums[at]


def kmer_codes(seq: Column | str, k: int, distinct: bool = False) -> Column:
    """Codes of every window of length k, in order; with ``distinct`` each once, ascending.

    Arrow arrays in and out: built-in functions make a string for every window, at over ten times the cost.
    """

    @F.arrow_udf("array<bigint>")
    def codes(seqs: pa.Array) -> pa.Array:
        return window_codes(seqs, k, distinct)

    return codes(_col(seq))


def phred(qual: Column | str) -> Column:
    """Quality ranks of a FASTQ quality string."""
    s = _col(qual)
    return F.transform(positions(F.length(s)), lambda p: F.ascii(F.substring(s, p + 1, F.lit(1))) - 33)


def window_sums(values: Column, k: int) -> Column:
    """Sums over every window of k values."""
    total = lambda v: lambda p: F.aggregate(F.slice(v, p + 1, F.lit(k)), F.lit(0), lambda a, x: a + x)
    return let(values, lambda v: F.transform(positions(F.size(v) - (k - 1)), total(v)))


def shaped_sums(values: Column, shape: str) -> Column:
    """Sums over every window of the shape's length of the values where the shape has a 1."""
    at = [i for i, c in enumerate(shape) if c == "1"]
    if not at or set(shape) - {"0", "1"}:
        raise ValueError(f"{shape!r} is not a shape of 0 and 1 with a 1")
    one = lambda v, p: sum((F.get(v, p + i) for i in at[1:]), F.get(v, p + at[0]))
    return let(values, lambda v: F.transform(positions(F.size(v) - (len(shape) - 1)), lambda p: one(v, p)))


def sampler(n: int, last: Column) -> Column:
    """n ordinals spread over [0, last], both ends included; ordinals repeat where there are fewer than n."""
    if n == 1:
        return F.array(last.cast("long"))
    spread = F.array(*(F.floor(F.lit(i) * (last + 1) / F.lit(float(n - 1))) for i in range(n - 1)))
    return F.concat(spread, F.array(last.cast("long")))


def frac_min_hash(code: Column | str, x: int = 12345, y: int = 678) -> Column:
    """The sampling hash ((x * g + y) mod p) mod 10000; p is the least prime of the method's table above 100000 (fixed value)."""
    return F.pmod(F.pmod(F.lit(x).cast("long") * _col(code) + F.lit(y), F.lit(116731)), F.lit(10000))


def sampled(code: Column | str, fraction: float, x: int = 12345, y: int = 678) -> Column:
    """Whether a q-gram is in the sample of this fraction; the threshold itself is in."""
    return frac_min_hash(code, x, y) <= F.lit(int(np.trunc(np.float32(10000) * np.float32(fraction))))


def gapped(seq: Column, at: Column, offsets: list[int]) -> Column:
    """The characters at sorted offsets from a position."""
    return F.concat(*(F.substring(seq, at + (o + 1), F.lit(1)) for o in sorted(offsets)))


def ceil32(x: float, y: float) -> int:
    """ceil(x * y) in single precision, as thresholds are derived."""
    return int(np.ceil(np.float32(x) * np.float32(y)))
