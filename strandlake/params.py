"""Parameters of indexing, mapping and locating, with the thresholds that they imply."""

from __future__ import annotations

from dataclasses import dataclass

from strandlake.functions.seq import ceil32


@dataclass(frozen=True)
class Params:
    B: int = 512  # bucket length
    L: int = 64  # segment length, bucket overlap
    q: int = 9  # index seed
    k: int = 12  # query seed
    S: int = 15  # seeds a segment in mapping
    e: float = 0.4  # miss rate allowed
    d: float = 0.5  # distinguishability
    b: int = 25  # mean base quality
    n: float = 0.04  # indel rate
    P: int = 10  # seeds a segment in locating
    G: int = 5  # segments of a long read
    C: int = 30  # candidate buckets a strand
    f: float = 1.0  # share of q-grams indexed

    def __post_init__(self):
        for name in ("B", "L", "q", "S", "P", "G", "C"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        for name in ("e", "d", "n", "f"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share between 0 and 1")
        if self.k > 31:
            raise ValueError("the code of a seed of more than 31 bases does not fit 64 bits")
        if self.k > self.L:
            raise ValueError("a segment must hold a query seed")
        if self.k < self.q:
            raise ValueError("the query seed must not be shorter than the index seed")
        if self.faults < 1:
            raise ValueError("at least one fault level is needed")

    @property
    def faults(self) -> int:
        return ceil32(self.S, self.e)

    @property
    def least_votes(self) -> int:
        return self.P - ceil32(self.e, self.P)

    @property
    def indel(self) -> int:
        return ceil32(self.n, self.L)


DEFAULT = Params()
#: Buckets of one contig: a bucket's id is ref_ord * BUCKETS + its index, unique without a global sort.
BUCKETS = 1 << 20
