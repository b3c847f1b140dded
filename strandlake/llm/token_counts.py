"""Token counts of a byte-level BPE by rank-synchronous array merging.

The pre-tokens of a batch lie behind one another in one ragged array of symbols. A round finds the lowest merge rank of every
pre-token, applies it at all its places at once (of overlapping places the left one), and closes the gaps; the symbols that survive
all rounds are the tokens. No merge rule can apply across pre-tokens, so none waits for another. A long run without a cut (kilobytes
of letters or signs) has as many rounds as distinct merges: such runs are linked arrays with their places filed by rank, so that a
round touches only the places it merges.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Texts of any length are read whole, at most ``PIECES`` pre-tokens at
a time. Strings of added tokens inside a text count as the library counts them by default: one token each. Repeated rows are
counted each for itself; an empty table gives an empty one; extra columns of any name are carried (``keep`` selects).
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from strandlake.llm import common
from strandlake.llm.quality_rules import TOKENIZERS

#: Fixed value: the pattern that cuts a text into pre-tokens, as byte-level BPE defines it.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for ASCII texts, for the faster built-in module.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Pre-tokens that are held at once, and the characters of a text from which on they are read piece by piece.
PIECES = 200_000
LONG_TEXT = 1 << 20
#: Bytes from which on a pre-token is merged by linked arrays.
LONG_RUN = 128
#: Distinct pre-tokens whose counts a Python worker keeps, of at most so many characters each.
KEPT, KEPT_CHARS = 400_000, 40
_NONE = np.int64(1 << 40)


def _byte_names() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next free one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Merge ranks of a tokenizer file as sorted arrays."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without a normaliser is supported")
        if cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only the default cutting of byte-level BPE is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for name, byte in _byte_names().items():
            self.byte_ids[byte] = vocab[name]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], _NONE) if len(self.keys) else np.full(len(want), _NONE)


def _left_first(follows: np.ndarray) -> np.ndarray:
    """Of places in order, which to merge: every other one of a run in which each place overlaps the one before it (``follows``)."""
    n = np.arange(len(follows))
    start = np.maximum.accumulate(np.where(follows, 0, n))
    return (n - start) % 2 == 0


def merge_short(m: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Surviving symbols of each of many sequences of at least one symbol, all merged in the same rounds."""
    out = np.zeros(len(lengths), np.int64)
    own = np.arange(len(lengths))
    rank = np.full(len(symbols), _NONE)
    if len(symbols) > 1:
        rank[:-1] = m.ranks(symbols[:-1], symbols[1:])
    rank[np.cumsum(lengths) - 1] = _NONE
    while len(own):
        first = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(rank, first)
        going = least < _NONE
        if not going.all():
            out[own[~going]] = lengths[~going]
            stay = np.repeat(going, lengths)
            symbols, rank, own, lengths, least = symbols[stay], rank[stay], own[going], lengths[going], least[going]
            if not len(own):
                break
        at = np.flatnonzero(rank == np.repeat(least, lengths))
        at = at[_left_first(np.concatenate([[False], np.diff(at) == 1]))]
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        seq = np.repeat(np.arange(len(own)), lengths)
        lengths = lengths - np.bincount(seq[at], minlength=len(own))
        symbols[at] = m.made[rank[at]]
        stay = ~gone
        place = np.cumsum(stay)[at] - 1
        symbols, rank, seq = symbols[stay], rank[stay], seq[stay]
        touched = np.unique(np.concatenate([place, place[place > 0] - 1]))
        inner = touched[touched + 1 < len(symbols)]
        same = seq[inner] == seq[inner + 1]
        rank[touched] = _NONE
        inner = inner[same]
        rank[inner] = m.ranks(symbols[inner], symbols[inner + 1])
    return out


def merge_long(m: Merges, symbols: np.ndarray) -> int:
    """Surviving symbols of one long sequence: places are filed by rank, and a round takes those of the lowest."""
    n = len(symbols)
    symbols = symbols.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n + 1, _NONE)
    rank[: n - 1] = m.ranks(symbols[:-1], symbols[1:])
    files: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def file(places: np.ndarray) -> None:
        places = places[rank[places] < _NONE]
        if not len(places):
            return
        order = np.argsort(rank[places], kind="stable")
        places = places[order]
        values, starts = np.unique(rank[places], return_index=True)
        for value, part in zip(values.tolist(), np.split(places, starts[1:]), strict=True):
            if value not in files:
                files[value] = []
                heapq.heappush(queue, value)
            files[value].append(part)

    file(np.arange(n))
    left = n
    while queue:
        now = heapq.heappop(queue)
        at = np.unique(np.concatenate(files.pop(now)))
        at = at[rank[at] == now]  # others have been merged away or have another neighbour since
        if not len(at):
            continue
        at = at[_left_first(np.concatenate([[False], after[at[:-1]] == at[1:]]))]
        gone = after[at]
        symbols[at] = m.made[now]
        rank[gone] = _NONE
        then = after[gone]
        after[at] = then
        inside = then < n
        before[then[inside]] = at[inside]
        left -= len(at)
        back = before[at]
        touched = np.unique(np.concatenate([at, back[back >= 0]]))
        nxt = after[touched]
        rank[touched] = _NONE
        inner = touched[nxt < n]
        rank[inner] = m.ranks(symbols[inner], symbols[after[inner]])
        file(touched)
    return left


class Counter:
    """Counts tokens; keeps the counts of pre-tokens that were met."""

    def __init__(self, raw: bytes):
        from tokenizers import pre_tokenizers

        self.merges = Merges(raw)
        self.known: dict[str, int] = {}
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.seen = np.zeros(0x110000, bool)
        self.seen[:128] = True
        self.stand_in: dict[int, str] = {}

    def _classes(self, text: str) -> str:
        """The text in the library's view of letters, numbers and space: its Unicode version may be another than ours, so a character
        that it sees otherwise gets a stand-in. Every character of the text that was never met is asked for once."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for code in np.unique(codes[~self.seen[codes]]).tolist():
            c = chr(code)
            theirs = next((kind for kind in "a1!" if len(self.cut(kind + c)) == 1), "\t")
            ours = next((kind for kind in "a1!" if len(PATTERN.findall(kind + c)) == 1), "\t")
            if theirs != ours:
                self.stand_in[code] = {"a": "q", "1": "0", "!": "#", "\t": "\t"}[theirs]
            self.seen[code] = True
        return text.translate(self.stand_in) if self.stand_in else text

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Lists of at most about PIECES pre-tokens each, of a text without added tokens."""
        view, pattern = (text, ASCII_PATTERN) if text.isascii() else (self._classes(text), PATTERN)
        if len(text) < LONG_TEXT and view == text:
            yield pattern.findall(text)
            return
        found = pattern.finditer(view)
        while part := [text[f.start() : f.end()] for f in itertools.islice(found, PIECES)]:
            yield part

    def learn(self, missing: list[str]) -> dict[str, int]:
        raws = [t.encode() for t in missing]
        lengths = np.array([len(r) for r in raws], np.int64)
        short = lengths <= LONG_RUN
        symbols = self.merges.byte_ids[np.frombuffer(b"".join(r for r, s in zip(raws, short, strict=True) if s), np.uint8)]
        counts = np.zeros(len(raws), np.int64)
        counts[short] = merge_short(self.merges, symbols, lengths[short])
        for i in np.flatnonzero(~short):
            counts[i] = merge_long(self.merges, self.merges.byte_ids[np.frombuffer(raws[i], np.uint8)])
        return dict(zip(missing, counts.tolist(), strict=True))

    def _sum(self, lists: list[list[str]]) -> list[int]:
        known = self.known
        missing = list({t for tokens in lists for t in tokens if t not in known})
        if missing:
            new = self.learn(missing)
            room = KEPT - len(known)
            if all(len(t) <= KEPT_CHARS for t in missing) and len(missing) <= room:
                known.update(new)
            else:
                known.update(itertools.islice(((t, n) for t, n in new.items() if len(t) <= KEPT_CHARS), max(room, 0)))
                return [sum([new[t] if t in new else known[t] for t in tokens]) for tokens in lists]
        return [sum(map(known.__getitem__, tokens)) for tokens in lists]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. The pre-tokens of up to PIECES are learnt together."""
        totals = [0] * len(texts)
        held, of, size = [], [], 0

        def settle() -> None:
            for i, n in zip(of, self._sum(held), strict=True):
                totals[i] += n
            held.clear()
            of.clear()

        for i, text in enumerate(texts):
            plain = [text]
            if self.merges.added is not None and (cuts := [(f.start(), f.end()) for f in self.merges.added.finditer(text)]):
                totals[i] += len(cuts)
                edges = [0, *itertools.chain.from_iterable(cuts), len(text)]
                plain = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
            for part in plain:
                for tokens in self.pre_tokens(part):
                    held.append(tokens)
                    of.append(i)
                    size += len(tokens)
                    if size >= PIECES:
                        settle()
                        size = 0
        settle()
        return totals


def read_tokenizer(path: str) -> bytes:
    """The file's bytes, read once by the driver and sent with the job: executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """Adds to the columns ``keep`` (default: all) ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Map-only: no row leaves its task, whatever its source or length.
    """
    raw = read_tokenizer(tokenizer)
    shield = common.Shield(docs)
    cols = shield.columns if keep is None else [shield.at[c] for c in keep]
    carried, name = common.with_text(shield.rows, cols, shield.at[text])
    schema = common.schema_of(carried, cols, "n_bytes long, n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.tool(("token_counts", raw), lambda: Counter(raw))
        for batch in batches:
            for part in common.text_chunks(batch, name):
                texts = part.column(name).fill_null("")
                counts = np.array(counter.count(texts.to_pylist()), np.int64)
                made = [pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(cols))), *made], names=[*cols, "n_bytes", "n_tokens", "over_limit"])
        common.release()

    return shield.back(carried.mapInArrow(run, schema), keep)
