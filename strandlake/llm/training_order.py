"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

1. *Tokenise.* Texts become tokens (16-bit ids of a byte-level vocabulary, and an end
   mark), written once. Each split of the stored table gives one count; their sums, in the order of
   files and of places in them, give every token a global position. So the order depends on the
   stored table and the key alone, not on how Spark splits it, and filters leave no more counts.
2. *Cut.* Positions are cut into sequences of ``length`` tokens. Tokens are sent as
   pieces, one for each sequence that following texts touch, so a text of any length
   is spread over tasks.
3. *Permute.* A Feistel network keyed by ``key`` permutes the sequence numbers; its
   domain is the least even power of two above their count, and a number that
   falls outside walks the cycle until it is inside. So every sequence gets a slot
   of its own, with no sort, no table and no state.
4. *Write.* Slot ``s`` is record ``s % shard_records`` of shard ``s // shard_records``.
   A record has ``2 * length + 1`` bytes (ids, then a line feed), so a reader finds
   slot ``s`` by arithmetic and resumes anywhere. A shard is one task and one file.

Defined results: null and empty texts have no tokens and no end mark. The last
sequence is filled with the end mark. Sequence numbers follow the order in which
the table is stored; rows that are no stored table are written first. Repeated rows
are separate documents. Extra columns are ignored, whatever their names. An empty
table gives no sequences.
"""

from __future__ import annotations

import base64
import contextlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common
from strandlake.llm.quality_rules import BPE_PATTERN
from strandlake.llm.sentencepiece_codec import TOKENIZERS, read_model

LENGTH = 2048
SHARD_RECORDS = 4096
END_MARK = 50256
ROUNDS = 6
#: Distinct words that a worker keeps, the first that it meets.
CACHE = 400_000
_ODD_SPACE = re.compile(r"\s ")


class WordCache:
    """Encodes texts by words: a cut before a single space between two words changes no token of this vocabulary's pattern."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encode = tiktoken.Encoding("ids", pat_str=BPE_PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        import array

        return array.array("H", self.encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian 16-bit ids of a text."""
        if _ODD_SPACE.search(text) or text[:1] == " ":
            return self._ids(text)
        first, *rest = text.split(" ")
        known, parts = self.known, [self._ids(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self._ids(" " + word)
                if len(known) < CACHE:
                    known[word] = ids
            parts.append(ids)
        return b"".join(parts)


def _cache(ranks: bytes) -> WordCache:
    return common.tool(("words", ranks), lambda: WordCache(ranks))


def in_order(docs: DataFrame) -> DataFrame:
    """(file, split, row, text): every row with its place in the stored table. A split of a file is read by one task in the order of its
    rows, whichever of them a filter leaves."""
    place = lambda df: df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.row_index").alias("row"), "text")
    if _as_read(docs):
        with contextlib.suppress(AnalysisException):  # a format that does not number rows
            return place(docs)
    return place(common.written(common.only(docs, "text"), "texts"))


def _as_read(docs: DataFrame) -> bool:
    """Whether the rows are a stored table's, at most filtered: no exchange or join lies between."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().size() == 0 and "_metadata" not in docs.columns


def _tokenised(batches: Iterator[pa.RecordBatch], ranks: bytes, mark: bytes) -> Iterator[tuple[str, int, bytes]]:
    """File, split and ids of each text."""
    encode = _cache(ranks)
    for batch in batches:
        for part in common.text_chunks(batch):
            files, splits, texts = (part.column(c).to_pylist() for c in ("file", "split", "text"))
            for file, split, t in zip(files, splits, texts, strict=True):
                yield file, split, encode(t) + mark if t else b""


@cache
def _codec() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def _packed(ids: bytes) -> bytes:
    """A piece as it is shuffled: compressed."""
    return _codec()[0](ids)


def _unpacked(raw: bytes) -> bytes:
    return _codec()[1](raw)


def tokenised(rows: DataFrame, ranks: bytes, mark: bytes) -> DataFrame:
    """(file, split, start, n, ids): each text's split, where the text starts in it, and its ids.

    Written in the shared folder, compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, size = None, 0, 0
        held: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["file", "split", "start", "n", "ids"])
            held.clear()
            return batch

        for file, split, ids in _tokenised(batches, ranks, mark):
            if now != (file, split):
                now, start = (file, split), 0
            held.append((file, split, start, len(ids) // 2, ids))
            start, size = start + len(ids) // 2, size + len(ids)
            if size > 1 << 20:
                yield flushed()
                size = 0
        if held:
            yield flushed()

    return common.written(rows.mapInArrow(run, "file string, split long, start long, n long, ids binary"), "tokens")


def split_starts(tokens: DataFrame) -> tuple[dict[tuple[str, int], int], int]:
    """The position of the first token of each split; and the total. A row for each split of the stored table reaches the driver."""
    counted = sorted(tokens.groupBy("file", "split").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r.file, r.split))
    ends = list(accumulate((r.n for r in counted), initial=0))
    return {(r.file, r.split): at for r, at in zip(counted, ends, strict=False)}, ends[-1]


def permuted(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of [0, n): a Feistel network over the least even power of two, cycle-walked until inside."""
    half, shift, mask, keys = _network(n, key, rounds)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (common.mix(right + k) & mask)
        return (left << shift) | right

    return _walked(x, n, network)


def _network(n: int, key: int, rounds: int) -> tuple[int, np.uint64, np.uint64, np.ndarray]:
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    with np.errstate(over="ignore"):
        keys = common.mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key % 2**64) * np.uint64(0x9E3779B97F4A7C15))
    return half, np.uint64(half), np.uint64((1 << half) - 1), keys


def _walked(x: np.ndarray, n: int, network: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = network(np.asarray(x, np.uint64))
        while len(outside := np.flatnonzero(out >= np.uint64(n))):
            out[outside] = network(out[outside])
    return out.astype(np.int64)


def unpermuted(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The inverse of ``permuted``: the rounds backwards, walking the cycle back until inside."""
    half, shift, mask, keys = _network(n, key, rounds)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys[::-1]:
            left, right = right ^ (common.mix(left + k) & mask), left
        return (left << shift) | right

    return _walked(x, n, network)


def pieces(rows: DataFrame, length: int, key: int, ranks: bytes, mark: bytes) -> tuple[DataFrame, int, int]:
    """(slot, seq, at, ids): packed parts of sequences with their offset in tokens; and the numbers of sequences and tokens."""
    tokens = tokenised(rows, ranks, mark)
    starts, total = split_starts(tokens)
    n = -(-total // length)
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = shared.value
        seqs, ats, parts, size = [], [], [], 0
        held: list[bytes] = []  # the open piece: texts that follow each other in a sequence go as one
        begin = end = -1

        def close() -> None:
            if held:
                seqs.append(begin // length)
                ats.append(begin % length)
                parts.append(_packed(b"".join(held)))
                held.clear()

        def flushed() -> pa.RecordBatch:
            seq = np.array(seqs, np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(permuted(seq, n, key)), pa.array(seq), pa.array(ats, pa.int32()), pa.array(parts, pa.binary())], names=["slot", "seq", "at", "ids"])
            for x in (seqs, ats, parts):
                x.clear()
            return batch

        for batch in batches:
            for file, split, start, ids in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "start", "ids")), strict=True):
                position, used, size = bases[file, split] + start, 0, size + len(ids)
                while used < len(ids) // 2:
                    take = min(len(ids) // 2 - used, length - position % length)
                    if position != end or position % length == 0:
                        close()
                        begin = position
                    held.append(ids[2 * used : 2 * (used + take)])
                    position, used = position + take, used + take
                    end = position
                if size > 1 << 20 and seqs:
                    yield flushed()
                    size = 0
        close()
        if seqs:
            yield flushed()

    return tokens.select("file", "split", "start", "ids").mapInArrow(run, "slot long, seq long, at int, ids binary"), n, total


def sequences(docs: DataFrame, length: int = LENGTH, shard_records: int = SHARD_RECORDS, key: int = 2026, ranks_path: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", end_mark: int = END_MARK) -> tuple[DataFrame, int, int]:
    """(shard, slot, seq, n_tokens, ids) of every sequence, partitioned by shard and sorted by slot; and the numbers of sequences and tokens.

    ``ids`` has ``length`` little-endian 16-bit numbers. Shard s is partition s. The pieces of a
    sequence are joined as they stream by, so a task holds one sequence at a time.
    """
    parts, n, total = pieces(in_order(docs), length, key, read_model(ranks_path), end_mark.to_bytes(2, "little"))
    shards = max(1, -(-n // shard_records))
    placed = parts.withColumn("shard", F.floor(F.col("slot") / F.lit(shard_records)).cast("int"))
    ordered = placed.repartitionById(shards, "shard").sortWithinPartitions("slot", "at")
    fill = end_mark.to_bytes(2, "little") * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        slot = seq = None
        held: list[bytes] = []

        def close() -> None:
            whole = b"".join(held)
            out.append((slot // shard_records, slot, seq, len(whole) // 2, whole + fill[len(whole) :]))

        def flushed() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "slot", "seq", "n_tokens", "ids"])
            out.clear()
            return batch

        for batch in batches:
            for s, q, ids in zip(*(batch.column(c).to_pylist() for c in ("slot", "seq", "ids")), strict=True):
                if s != slot:
                    if held:
                        close()
                    slot, seq, held = s, q, []
                held.append(_unpacked(ids))
                if len(out) >= 1024:
                    yield flushed()
        if held:
            close()
        if out:
            yield flushed()

    return ordered.mapInArrow(run, "shard int, slot long, seq long, n_tokens int, ids binary"), n, total


def materialise(docs: DataFrame, path: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS, key: int = 2026, **options) -> tuple[DataFrame, int]:
    """Writes the shards to a folder that the cluster shares; (shard, first_slot, n_records), and the number of tokens.

    Task s writes the file part-s, its slots in order; the writer commits a task's file once, whichever
    executor ends it.
    """
    rows, n, total = sequences(docs, length, shard_records, key, **options)
    rows.select(F.col("ids").cast("string").alias("value")).write.mode("errorifexists").option("lineSep", "\n").text(path)
    shard = docs.sparkSession.range(-(-n // shard_records)).select(F.col("id").cast("int").alias("shard"))
    return shard.withColumn("first_slot", F.col("shard").cast("long") * shard_records).withColumn("n_records", F.least(F.lit(shard_records), F.lit(n) - F.col("first_slot")).cast("long")), total


def read_shards(spark: SparkSession, path: str, total: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS, key: int = 2026) -> DataFrame:
    """(shard, record, slot, seq, n_tokens, ids) of every record of the written shards, cut at their stride.

    ``total`` is the number of tokens; the last sequence has what is left of it. A shard is read whole by one task.
    """
    n, stride = -(-total // length), 2 * length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = raw.as_buffer()
                record = np.arange(raw.size // stride, dtype=np.int64)
                slot = shard * np.int64(shard_records) + record
                seq = unpermuted(slot, n, key)
                tokens = np.where(seq == n - 1, total - length * (n - 1), length)
                ids = pa.array([raw.slice(int(i) * stride, stride - 1).to_pybytes() for i in record], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(record), shard, np.int32)), pa.array(record), pa.array(slot), pa.array(seq), pa.array(tokens.astype(np.int32)), ids], names=["shard", "record", "slot", "seq", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    return rows.mapInArrow(run, "shard int, record long, slot long, seq long, n_tokens int, ids binary")
