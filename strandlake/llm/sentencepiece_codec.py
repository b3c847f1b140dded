"""SentencePiece models run by the tokenizers library.

``parse_model`` reads the model's protobuf (wire format, no generated classes).
``build_tokenizer`` rebuilds from it the normaliser, the metaspace marker, the
unigram scores (or, for a BPE model, the merges that its scores order) and the
byte fallback. Encoding and decoding go by *chunks*: a text is cut before every
run of spaces that follows another character. No piece has the marker after
another character (``Spec.splits`` checks it when the model is read), so no
merge crosses a cut and the pieces of the chunks, one after another, are the
pieces of the text. Distinct chunks are few, so each is encoded once and kept in
a bounded cache. Those without spaces are joined again to be encoded, a group of
them as one text, whose ids are parted at the marked pieces.

Parity: every distinct chunk is also encoded by the sentencepiece library, and
decoded by both; a text has parity where all its chunks agree.

Defined results: a null text is treated as empty; an empty text has no ids and
decodes to itself. Texts of any length are encoded whole, chunk by chunk. Rows are independent: repeated rows get equal results. Extra
columns pass through; one that has the name of an output column gives way to it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

MARK = "▁"
#: Where the public tokenizers are; a parameter of every operator that uses them.
TOKENIZERS = "/opt/tokenizers"
#: Distinct chunks that a worker keeps, the first that it meets (about 100 MB).
CACHE_CHUNKS = 400_000
#: Chunks that are encoded and decoded as one text.
GROUP = 256
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A run of spaces (or of the marker, which the model takes for one) and what follows it; those at the end stay with the last chunk.
_CHUNKS = re.compile(r"[ \u2581]*[^ \u2581]+(?:[ \u2581]+\Z)?|\A[ \u2581]+\Z")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: int, 4 or 8 bytes, or bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"protobuf wire type {kind} is not supported")
        yield key >> 3, value


@dataclass
class Spec:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    charsmap: bytes = b""

    @cached_property
    def splits(self) -> bool:
        """Whether a text may be cut before each run of spaces without changing its pieces."""
        return not self.charsmap and not self.remove_extra_spaces and self.escape_spaces and self.dummy_prefix and not any(
            MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER)
        )


def parse_model(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    spec.model_type = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.remove_extra_spaces = bool(v)
                elif n == 5:
                    spec.escape_spaces = bool(v)
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """A BPE model's merges: both ways to halve a piece into pieces, best score first."""
    usable = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in usable.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in usable and right in usable:
                found.append((-spec.pieces[i][1], i, usable[left], left, right))
    return [(a, b) for _, _, _, a, b in sorted(found)]


def build_tokenizer(spec: Spec):
    """A tokenizers.Tokenizer with the model's normaliser, marker, scores or merges, and byte fallback."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.model_type == 2:
        model = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(spec.pieces)},
            merges=merges_of(spec),
            unk_token=next((p for p, _, k in spec.pieces if k == UNKNOWN), None),
            fuse_unk=True,
            byte_fallback=spec.byte_fallback,
        )
    elif spec.model_type == 1:
        unknown = next((i for i, (_, _, k) in enumerate(spec.pieces) if k == UNKNOWN), 0)
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    tok = Tokenizer(model)
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if spec.splits:
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence([*undo, decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else undo)
    special = [AddedToken(p, normalized=False, special=False) for p, _, kind in spec.pieces if kind == USER]
    if special:
        tok.add_tokens(special)
    return tok


@dataclass
class Encoded:
    """Encoded chunks, one after another: chunk i has ``ids[first[i] : first[i + 1]]``; how many of them are bytes, and what held."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, "<u4"))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    n_bytes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parity: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    text_back: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def then(self, other: Encoded) -> Encoded:
        both = (np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("n_bytes", "parity", "text_back"))
        return Encoded(np.concatenate([self.ids, other.ids]), np.concatenate([self.first, self.first[-1] + other.first[1:]]), *both)

    def head(self, n: int) -> Encoded:
        return Encoded(self.ids[: self.first[n]].copy(), self.first[: n + 1].copy(), *(x[:n].copy() for x in (self.n_bytes, self.parity, self.text_back)))

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at these places, one after another, and where each chunk's begin and the last one's end."""
        size = self.first[at + 1] - self.first[at]
        before = _before(size)
        return self.ids[np.repeat(self.first[at] - before[:-1], size) + np.arange(before[-1])], before


def _before(sizes: np.ndarray) -> np.ndarray:
    """The sum of the sizes before each place, and of all."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


@lru_cache(4)
def _built(raw: bytes) -> tuple:
    """A model's tokenizer, kept for the worker's life: its threads keep a cache of their own for every tokenizer that was ever built,
    so one that is built anew in each stage grows the worker. It runs on the task's own core: Spark has a task for every core already."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    spec = parse_model(raw)
    return spec, build_tokenizer(spec)


class Codec:
    """Encodes and decodes texts by a SentencePiece model; keeps a bounded cache of chunks."""

    def __init__(self, raw: bytes, verify: bool = True, cache: int = CACHE_CHUNKS):
        self.spec, self.tok = _built(raw)
        self.size = cache
        self.index: dict[str, int] = {}
        self.known = Encoded()
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.spec.pieces])
        self.is_marked = np.array([MARK in p for p, _, _ in self.spec.pieces])
        #: Pieces of the user's are cut out of a text before it is normalised, so they see what a chunk is joined with.
        self.joins = self.spec.splits and not any(kind == USER for _, _, kind in self.spec.pieces)
        self.other = None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def chunks_of(self, text: str) -> list[str]:
        """Chunks without the space that the model adds or that parts them from the chunk before."""
        if not text:
            return []
        if not self.spec.splits:
            return [text]
        if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [c[1:] for c in _CHUNKS.findall(" " + text)]

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of the chunks, one after another, how many each has, and the chunks decoded."""
        encoded = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), "<u4", int(sizes.sum()))
        return ids, sizes, self.tok.decode_batch(encoded, skip_special_tokens=False)

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The same of chunks without spaces, encoded and decoded many at a time, as most of a call's time goes to each text of it.

        A chunk's only marker is its first character, so at most one of its pieces has one. Where a group has as many marked pieces as
        chunks, each begins a chunk; where it decodes to as many words, each chunk gave one space. Any other group is encoded chunk by chunk.
        """
        groups = [chunks[i : i + GROUP] for i in range(0, len(chunks), GROUP)]
        encoded = [e.ids for e in self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)]
        decoded = self.tok.decode_batch(encoded, skip_special_tokens=False)
        found = []
        for group, ids, text in zip(groups, encoded, decoded, strict=True):
            a, words = np.array(ids, "<u4"), text.split(" ")
            starts = np.flatnonzero(self.is_marked[a])
            fits = len(starts) == len(words) == len(group) and starts[0] == 0
            found.append((a, np.diff(starts, append=len(a)), words) if fits else self._alone(group))
        return np.concatenate([a for a, _, _ in found]), np.concatenate([n for _, n, _ in found]), [w for _, _, words in found for w in words]

    def _learn(self, missing: list[str]) -> tuple[list[str], Encoded]:
        """The chunks in the order in which they are encoded, and what is kept of them."""
        plain = [c for c in missing if " " not in c and MARK not in c] if self.joins else []
        odd = [c for c in missing if " " in c or MARK in c] if self.joins else missing
        done = [how(chunks) for how, chunks in ((self._joined, plain), (self._alone, odd)) if chunks]
        chunks, back = plain + odd, [t for _, _, texts in done for t in texts]
        ids, first = np.concatenate([a for a, _, _ in done]), _before(np.concatenate([n for _, n, _ in done]))
        parity = np.ones(len(chunks), bool)
        if self.other:
            theirs = self.other.encode(chunks, num_threads=1)
            flat, at = ids.tolist(), first.tolist()
            same = (flat[i:j] == other and a == b for i, j, other, a, b in zip(at, at[1:], theirs, back, self.other.decode(theirs, num_threads=1)))
            parity = np.fromiter(same, bool, len(chunks))
        text_back = np.fromiter(map(eq, back, chunks), bool, len(chunks))
        return chunks, Encoded(ids, first, np.diff(_before(self.is_byte[ids])[first]), parity, text_back)

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Encoded]:
        """Where each text's chunks begin and the last one's end, the place of every chunk among encoded ones, and those."""
        parts = [self.chunks_of(t) for t in texts]
        first = _before(np.fromiter(map(len, parts), np.int64, len(parts)))
        chunks = list(chain.from_iterable(parts))
        index, n, known = self.index, len(self.index), self.known
        missing = list(set(chunks).difference(index))
        if missing:
            missing, new = self._learn(missing)
            known = known.then(new)
            index.update(zip(missing, range(n, n + len(missing)), strict=True))
        at = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        self.known = known
        if len(index) > self.size:
            for c in missing[self.size - n :]:
                del index[c]
            self.known = known.head(self.size)
        return first, at, known

    def encode(self, texts: list[str]) -> list[pa.Array]:
        """The columns ``ENCODED`` of the texts."""
        first, at, known = self.learn(texts)
        ids, before = known.ids_of(at)
        ends, raw = before[first], ids.tobytes()
        parity, text_back = (np.diff(_before(~x[at])[first]) == 0 for x in (known.parity, known.text_back))
        return [
            pa.array([raw[4 * i : 4 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
            pa.array(np.diff(ends)),
            pa.array(np.diff(_before(known.n_bytes[at])[first])),
            pa.array(parity),
            pa.array(text_back & np.fromiter((MARK not in t for t in texts), bool, len(texts))),
        ]


def codec(raw: bytes, verify: bool = True) -> Codec:
    """One codec in a Python worker, which outlives tasks, and so does its cache."""
    return common.tool(("codec", raw, verify), lambda: Codec(raw, verify))


def read_model(path: str) -> bytes:
    """The model file's bytes, read once by the driver and sent with the job: executors need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


ENCODED = "ids binary, n_tokens long, n_byte_tokens long, parity boolean, round_trip boolean"


def encode(docs: DataFrame, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds to the columns ``keep`` (default: all) the text's ids, little-endian uint32, and what was verified.

    ``parity``: ids and decoded text equal the sentencepiece library's.
    ``round_trip``: decoding gives the text back, character for character; never where the text
    has the marker itself, which decodes to a space.
    """
    raw = read_model(model_path)
    shield = common.Shield(docs)
    cols = shield.columns if keep is None else [shield.at[c] for c in keep]
    carried, name = common.with_text(shield.rows, cols, shield.at[text])
    schema = common.schema_of(carried, cols, ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw)
        for batch in batches:
            for part in common.text_chunks(batch, name):
                made = c.encode(part.column(name).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(cols))), *made], names=[*cols, "ids", "n_tokens", "n_byte_tokens", "parity", "round_trip"])
        common.release()

    return shield.back(carried.mapInArrow(run, schema), keep)


def decode(encoded: DataFrame, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", keep: list[str] | None = None) -> DataFrame:
    """Adds the column ``decoded``: the text of the binary column ``ids``; null ids give null."""
    raw = read_model(model_path)
    shield = common.Shield(encoded)
    cols = [shield.at[c] for c in (encoded.columns if keep is None else keep) if c != "ids"]
    carried = shield.rows.select(*cols, F.col(shield.at["ids"]).alias("ids"))
    schema = common.schema_of(carried, cols, "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(raw, verify=False).tok
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = iter(tok.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids if x is not None], skip_special_tokens=False))
            made = pa.array([None if x is None else next(texts) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), made], names=[*cols, "decoded"])

    return shield.back(carried.mapInArrow(run, schema), [c for c in encoded.columns if c != "ids"] if keep is None else keep)


def describe(model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> str:
    """The parsed model's settings as JSON."""
    spec = parse_model(read_model(model_path))
    kinds: dict[int, int] = {}
    for _, _, kind in spec.pieces:
        kinds[kind] = kinds.get(kind, 0) + 1
    return json.dumps({"pieces": len(spec.pieces), "kinds": kinds, "model_type": spec.model_type, "byte_fallback": spec.byte_fallback, "dummy_prefix": spec.dummy_prefix, "splits": spec.splits})
