"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target text and one of the whole corpus, share a
vocabulary (every word of the corpus), an order and a smoothing, and are matched in
mass: background counts are scaled to the target's total. A document's score is the
mean over its tokens of the target model's loss less the background model's: low
where the text reads more like the target than the corpus does.

Background counts are of every token of every document. The target's are of all
documents that a label calls good: their ids are counted, and broadcast up to
``BROADCAST_IDS``; beyond that they are joined by a shuffle, once, and the rows written with
what the join has found. No table of counts is capped, sampled or broadcast; they grow
with the corpus:

1. Runs of about ``CHUNK`` bytes of text are *chunks*. A chunk has words and (context,
   word) pairs, each under a key of ``KEY_BITS`` bits of hash (two of 10**11 keys share
   one with a probability of about 5e-5). Texts begin and end with one mark, so a word's
   count is also its count as a context.
2. A chunk sends its distinct keys with its own counts to the keys' *buckets* (their
   leading bits; the number of buckets follows the corpus). A bucket sums them and
   answers every chunk with the totals of the keys that it asked for. A frequent key
   is one entry a chunk, so none is hot.
3. A chunk's words are then scored by the answers to its requests.

A word's probability in the target is smoothed towards that in the corpus, and a
pair's towards its word's (Dirichlet), so both models give every token a loss.

The input is read twice, as texts would be more to shuffle than their counts: rows
that are not in a stored table, whose order another read might change, are written
first (``stored``).

Defined results: a null or empty text has no tokens and null scores. A text of any length
is read whole, as one chunk if it is longer than one. A document with several labels is target if any calls it good; without any target all
differences are 0. Repeated rows get equal scores. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

CHUNK = 6 << 20
KEY_BITS = 52
MIN_BUCKET_BITS, BUCKET_BYTES = 8, 16 << 20
BROADCAST_IDS = 200_000
SMOOTHING = 50.0
WORD_SMOOTHING = 1000.0
_MARK = common.U64(0x5851F42D4C957F2D)
#: The key whose count is the number of tokens.
_ALL = common.U64(0)
_REQUESTS = "chunk long, bucket int, keys binary, counts binary"
_ANSWERS = "chunk long, bucket int, counts binary"


def good_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids of good documents."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def bucket_bits(docs: DataFrame) -> int:
    """Bits of a bucket's number: a bucket has the keys of about ``BUCKET_BYTES`` of text, whatever the corpus' size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(MIN_BUCKET_BITS, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))


def _pack(x: np.ndarray) -> bytes:
    """Numbers in the least width that holds them, byte plane by byte plane (the high ones are nearly empty), compressed."""
    small = x.astype(np.min_scalar_type(int(x.max()))) if x.size else x.astype(np.uint8)
    return bytes([small.itemsize]) + _codec()[0](small.reshape(-1).view(np.uint8).reshape(-1, small.itemsize).T.tobytes())


def _unpack(raw: bytes, columns: int = 1) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(_codec()[1](raw[1:]), np.uint8).reshape(width, -1)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")
    return x.reshape(-1, columns) if columns > 1 else x


@cache
def _codec() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _pack(np.diff(keys, prepend=common.U64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw).astype(np.uint64), dtype=np.uint64)


@dataclass
class Chunk:
    """A run of texts of ``lengths`` words: word i is ``vocab[local[i]]``; the vocabulary's hashes are sorted and have the mark's."""

    vocab: np.ndarray
    local: np.ndarray
    lengths: np.ndarray
    chunk: int = 0
    doc_ids: pa.Array | None = None
    answers: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        """Predictions: each word after the one before it, the mark being before the first, and the mark after the last."""
        full = np.flatnonzero(self.lengths)
        ends = np.cumsum(self.lengths)[full]
        mark = int(np.searchsorted(self.vocab, _MARK))
        before = np.concatenate([[mark], self.local[:-1]]) if len(self.local) else self.local
        before[ends - self.lengths[full]] = mark
        self.doc = np.concatenate([np.repeat(np.arange(len(self.lengths)), self.lengths), full])
        self.word = np.concatenate([self.local, np.full(len(full), mark)])
        code, self.pair = np.unique(np.concatenate([before, self.local[ends - 1]]) * np.int64(len(self.vocab)) + self.word, return_inverse=True)
        self.pair_context, self.pair_word = np.divmod(code, len(self.vocab))
        with np.errstate(over="ignore"):
            pairs = common.mix(self.vocab[self.pair_context] * common.U64(0x9E3779B97F4A7C15) + self.vocab[self.pair_word])
        shift = common.U64(64 - KEY_BITS)
        every = np.concatenate([[_ALL], (self.vocab >> shift) | common.U64(1), (pairs >> shift) | common.U64(1)])
        self.keys, self.at = np.unique(every, return_inverse=True)

    def counts(self, target: np.ndarray) -> np.ndarray:
        """[keys, 2]: occurrences in the chunk's texts, and in those that are target."""
        out = []
        for pick in (slice(None), target[self.doc]):
            own = np.concatenate([[len(self.word[pick])], np.bincount(self.word[pick], minlength=len(self.vocab)), np.bincount(self.pair[pick], minlength=len(self.pair_word))])
            out.append(np.bincount(self.at, own, len(self.keys)).astype(np.int64))
        return np.stack(out, axis=1)

    def losses(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean loss in nats a prediction of each text under target and background, from the answers' counts."""
        totals = np.concatenate([_unpack(raw, 2) for raw in self.answers]).astype(np.float64)[self.at]
        n, words, pairs = totals[0], totals[1 : len(self.vocab) + 1], totals[len(self.vocab) + 1 :]
        background = words[:, 0] / max(n[0], 1)
        target = (words[:, 1] + WORD_SMOOTHING * background) / (n[1] + WORD_SMOOTHING)
        scale = n[1] / max(n[0], 1)  # matched mass
        found = []
        for own, share, column, by in ((target, pairs, 1, 1.0), (background, pairs, 0, scale)):
            p = (share[:, column] * by + SMOOTHING * own[self.pair_word]) / (words[self.pair_context, column] * by + SMOOTHING)
            found.append(np.bincount(self.doc, -np.log(p)[self.pair], len(self.lengths)) / np.maximum(self.lengths + 1, 1))
        return found[0], found[1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Chunk]]:
    """(chunk, texts, their words) in the order of the rows; a chunk's number is its first row's."""
    for batch in batches:
        for part in common.text_chunks(batch, limit=CHUNK):
            words = common.split_words(part.column("text"))
            vocab, local = np.unique(np.append(words.hashes(), _MARK), return_inverse=True)
            yield part.column("row")[0].as_py(), part, Chunk(vocab, local[:-1], np.diff(words.first))


def requests(rows: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, keys, counts): what each chunk tells and asks each bucket; rows: (row, doc_id, target, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, c in _chunks(batches):
            counts = c.counts(part.column("target").to_numpy(zero_copy_only=False))
            bucket = (c.keys >> common.U64(KEY_BITS - bits)).astype(np.int64)
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            spans = list(zip(begins, np.append(begins[1:], len(bucket)), strict=True))
            made = [pa.array([_pack_keys(c.keys[a:b]) for a, b in spans], pa.binary()), pa.array([_pack(counts[a:b]) for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spans), chunk), pa.int64()), pa.array(bucket[begins], pa.int32()), *made], names=["chunk", "bucket", "keys", "counts"])

    return rows.mapInArrow(run, _REQUESTS)


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, counts): the corpus' totals of each key that a chunk asked for, in its order."""

    def answer(chunk: list[int], bucket: int, keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        parts = [_unpack_keys(k) for k in keys]
        ends = np.cumsum([len(k) for k in parts])
        found, at = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate([_unpack(raw, 2) for raw in counts])
        totals = np.stack([np.bincount(at, own[:, c], len(found)).astype(np.int64) for c in (0, 1)], axis=1)
        made = [_pack(totals[at[b - len(k) : b]]) for b, k in zip(ends, parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([bucket] * len(made), pa.int32()), pa.array(made, pa.binary())], names=["chunk", "bucket", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, ([], [], [])
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "counts")), strict=True):
                if bucket != own and held[0]:
                    yield answer(held[0], own, held[1], held[2])
                    held = ([], [], [])
                own = bucket
                for part, x in zip(held, row, strict=True):
                    part.append(x)
        if held[0]:
            yield answer(held[0], own, held[1], held[2])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ANSWERS)


def words_of(rows: DataFrame) -> DataFrame:
    """(chunk, doc_ids, vocab, local, lengths): each chunk's words, a third of its text's size."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, c in _chunks(batches):
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
            made = [_pack_keys(c.vocab), _pack(c.local), _pack(c.lengths)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in made)], names=["chunk", "doc_ids", "vocab", "local", "lengths"])

    return rows.mapInArrow(run, f"chunk long, doc_ids array<{kind}>, vocab binary, local binary, lengths binary")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks from their words and the answers that follow them in the order of buckets."""
    now: dict | None = None
    for batch in batches:
        for i, (bucket, counts) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist(), strict=True)):
            if bucket >= 0:
                now["answers"].append(counts)
                continue
            if now is not None:
                yield Chunk(**now)
            vocab, local, lengths = (batch.column(c)[i].as_py() for c in ("vocab", "local", "lengths"))
            now = {"vocab": _unpack_keys(vocab), "local": _unpack(local).astype(np.int64), "lengths": _unpack(lengths).astype(np.int64), "chunk": batch.column("chunk")[i].as_py(), "doc_ids": batch.column("doc_ids")[i].values, "answers": []}
    if now is not None:
        yield Chunk(**now)


def score(docs: DataFrame, labels: DataFrame, stored: bool = False, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and loss_difference (nats a token) of every row.

    ``stored``: the rows are those of a table as it is stored, so that another read gives them in the same order.
    """
    docs = common.only(docs, "doc_id", "text")
    if not stored:
        docs = common.written(docs, "texts")
    bits = bucket_bits(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = common.cut(good_ids(common.only(labels, "doc_id", "quality"))).withColumn("target", F.lit(True))
    if ids.count() <= broadcast_ids:
        marked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    else:
        marked = common.written(docs.join(ids, "doc_id", "left"), "marked").select(F.monotonically_increasing_id().alias("row"), "*")
    rows = marked.select("row", "doc_id", F.coalesce("target", F.lit(False)).alias("target"), F.coalesce("text", F.lit("")).alias("text"))
    words = words_of(rows).withColumn("bucket", F.lit(-1)).withColumn("counts", F.lit(None).cast("binary"))
    every = words.unionByName(answers(requests(rows, bits)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _assembled(batches):
            none = c.lengths == 0
            target, background = c.losses()
            made = [pa.array(x, mask=none) for x in (target, background, target - background)]
            yield pa.RecordBatch.from_arrays([c.doc_ids, pa.array(c.lengths, pa.int64()), *made], names=["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"])

    return every.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, loss_difference double")
