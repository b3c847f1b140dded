"""Quality rules: base word rules, then bands on how public tokenisers fit a text.

Fertility measures, over a text's words: characters per token under two public
vocabularies, the share of byte-fallback tokens, and the evenness of the token
distribution (its entropy over the logarithm of its length). A text is rejected
where a measure leaves its band. Bands are kept per language, where the language
column holds a 2- or 3-letter code, and else per script. They are either given
(``bands``) or set from quantiles over *all* rows of the corpus, Tukey fences
around the quartiles, so that a band follows the corpus's own languages.

Defined results: a null or empty text has no words: ``base_failed`` (fewer than
50 words), not kept. Texts with fewer than ``min_tokens`` tokens are judged by
the base rules alone. Texts of any length count whole. A null language is judged by its script. Repeated rows
get equal results. Extra columns pass through untouched; one that has the name of
an output column gives way to it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common
from strandlake.llm.sentencepiece_codec import TOKENIZERS, Codec, read_model

#: The pattern by which the byte-level vocabularies split a text (fixed value).
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SYMBOLS = "#*$%&|<>"
MEASURES = ["chars_per_token", "chars_per_token_multi", "byte_share", "evenness"]
#: How far, in interquartile ranges, a band reaches beyond the quartiles, and its least half-width:
#: a corpus of one kind of text has narrow quartiles, which say nothing about what is odd.
FENCE = 3.0
LEAST_MARGIN = {"chars_per_token": 0.1, "chars_per_token_multi": 0.1, "byte_share": 0.05, "evenness": 0.2}
#: Below so many tokens a band widens with the sampling error of a short text, as 1 / sqrt(tokens).
STEADY_TOKENS = 1000
MIN_TOKENS = 60
MIN_WORDS = 50
#: Distinct words that a worker keeps, the first that it meets (about 100 MB).
CACHE_WORDS = 400_000


class Fertility:
    """Token counts of distinct words under two vocabularies, in growing arrays."""

    def __init__(self, piece_model: bytes, multi_ranks: bytes):
        import tiktoken

        self.codec = Codec(piece_model, verify=False)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in multi_ranks.splitlines() if line)}
        self.multi = tiktoken.Encoding("multi", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.index: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.index = {}
        self.n_chars = np.zeros(0, np.int64)
        self.n_multi = np.zeros(0, np.int64)
        self.n_bytes = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, words: list[str]) -> None:
        pieces = [e.ids for e in self.codec.tok.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((i for p in pieces for i in p), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        bytes_before = np.concatenate([[0], np.cumsum(self.codec.is_byte[flat])])
        self.n_bytes = np.concatenate([self.n_bytes, bytes_before[ends] - bytes_before[ends - sizes]])
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.ids = np.concatenate([self.ids, flat])
        encode = self.multi.encode_ordinary
        self.n_multi = np.concatenate([self.n_multi, np.fromiter((len(encode(" " + w)) for w in words), np.int64, len(words))])
        self.n_chars = np.concatenate([self.n_chars, np.fromiter(map(len, words), np.int64, len(words))])
        at = len(self.index)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def measures(self, texts: list[str]) -> dict[str, np.ndarray]:
        parts = [t.split() for t in texts]
        known, n_known = self.index, len(self.index)
        missing = list({w for p in parts for w in p if w not in known})
        if missing:
            self.add(missing)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter((known[w] for p in parts for w in p), np.int64, int(counts.sum()))
        doc = np.repeat(np.arange(len(parts)), counts)
        size = self.first[at + 1] - self.first[at]

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, len(parts))

        tokens, multi = total(size), total(self.n_multi[at])
        before = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.first[at] - before[:-1], size) + np.arange(before[-1])
        keys = np.repeat(doc, size) * np.int64(1 << 32) + self.ids[where]
        _, inverse_first, count = np.unique(keys, return_index=True, return_counts=True)
        owner = keys[inverse_first] >> 32
        own = tokens[owner]
        entropy = np.bincount(owner, -(count / own) * np.log2(count / own), len(parts))
        safe = np.maximum(tokens, 1)
        chars = total(self.n_chars[at])
        found = {
            "n_tokens": tokens.astype(np.int64),
            "chars_per_token": chars / safe,
            "chars_per_token_multi": chars / np.maximum(multi, 1),
            "byte_share": total(self.n_bytes[at]) / safe,
            "evenness": np.where(tokens > 1, entropy / np.log2(np.maximum(tokens, 2)), 0.0),
        }
        if len(known) > CACHE_WORDS:
            self.forget(missing, max(n_known, CACHE_WORDS))
        return found

    def forget(self, added: list[str], size: int) -> None:
        """Drop the words added last, down to ``size`` of all."""
        for word in added[len(added) - (len(self.index) - size) :]:
            del self.index[word]
        self.n_chars, self.n_multi, self.n_bytes = (x[:size].copy() for x in (self.n_chars, self.n_multi, self.n_bytes))
        self.first = self.first[: size + 1].copy()
        self.ids = self.ids[: self.first[-1]].copy()


def _fertility(piece_model: bytes, multi_ranks: bytes) -> Fertility:
    return common.tool(("fertility", piece_model, multi_ranks), lambda: Fertility(piece_model, multi_ranks))


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words of each text."""
    words = common.split_words(texts)
    _, offsets = common.raw_bytes(texts)
    n = len(texts)

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    data = words.data
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    n_words = np.diff(words.first)
    covered = np.zeros(len(words.starts) + 2, bool)
    if len(words.starts) >= 3:
        h = words.hashes()
        doc = words.doc_of()
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        with np.errstate(over="ignore"):
            key = common.mix(h[inside] * common.U64(3) + common.mix(h[inside + 1]) * common.U64(5) + common.mix(h[inside + 2] ^ common.U64(0xABCD)) + common.mix(doc[inside].astype(common.U64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = inside[count[inverse] > 1]
        for j in range(3):
            covered[twice + j] = True
    cover = np.concatenate([[0], np.cumsum(covered[: len(words.starts)], dtype=np.int64)])
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~common._WS[data]) if n else np.zeros(0, np.int64),
        "n_symbols": per_text(symbol[data]),
        "n_repeat_words": cover[words.first[1:]] - cover[words.first[:-1]],
    }


_WORD = re.compile("[^ \t-\r]")


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif _WORD.search(line):
            seen.add(line)
    return n


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_token_multi double, byte_share double, evenness double, band_key string"


def measure(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", tokenizers: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` (none called text or lang, or by a measure's name) and every count and measure of each row; map-only."""
    piece = read_model(f"{tokenizers}/piece_bpe_32k.model")
    multi = read_model(f"{tokenizers}/byte_bpe_multi_50k.tiktoken")
    lang_col = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    rows, name = common.with_text(docs, keep, text, lang_col.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _fertility(piece, multi)
        for batch in batches:
            for part in common.text_chunks(batch, name):
                column = part.column(name).fill_null("")
                texts = column.to_pylist()
                counts = base_counts(column)
                counts["n_dup_lines"] = np.fromiter(map(dup_lines, texts), np.int64, len(texts))
                counts |= tool.measures(texts)
                counts["band_key"] = [
                    code if code and re.fullmatch("[a-z]{2,3}", code) else f"script:{common.script_of(t)}"
                    for code, t in zip(part.column("lang").to_pylist(), texts, strict=True)
                ]
                names = [x.split()[0] for x in MEASURED.split(", ")]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(counts[c]) for c in names)], names=[*keep, *names])
        common.release()

    return rows.mapInArrow(run, common.schema_of(rows, keep, MEASURED))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def corpus_bands(measured: DataFrame, fence: float = FENCE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per band key: low and high quartile and margin of each measure, from all rows that pass the base rules.

    Keys are 2- or 3-letter codes or script names, so the table has fewer than 20,000 rows however large the corpus.
    """
    judged = measured.where(~base_failed() & (F.col("n_tokens") >= min_tokens))
    quartiles = judged.groupBy("band_key").agg(*(F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in MEASURES))
    out = ["band_key"]
    for m in MEASURES:
        lo, hi = F.element_at(m, 1), F.element_at(m, 2)
        margin = F.greatest(F.lit(fence) * (hi - lo), F.lit(LEAST_MARGIN[m]))
        out += [lo.alias(f"{m}_lo"), hi.alias(f"{m}_hi"), margin.alias(f"{m}_margin")]
    return quartiles.select(*out)


def judge(measured: DataFrame, bands: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Adds base_failed and kept. ``bands`` is broadcast: fewer than 20,000 rows by its key."""
    inside = F.lit(True)
    widen = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(STEADY_TOKENS)) / F.greatest(F.col("n_tokens"), F.lit(1))))
    for m in MEASURES:
        margin = F.col(f"{m}_margin") * widen
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_lo") - margin, F.col(f"{m}_hi") + margin), F.lit(True))
    judged = measured.join(F.broadcast(bands), "band_key", "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ((F.col("n_tokens") < min_tokens) | inside)).drop(*(c for c in bands.columns if c != "band_key"))


def quality_rules(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", tokenizers: str = TOKENIZERS, bands: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), the counts and measures, ``base_failed`` and ``kept``.

    The measured rows are written once in the shared folder, since the bands need
    a pass over all of them before any row can be judged.
    """
    shield = common.Shield(docs)
    measured = measure(shield.rows, shield.columns if keep is None else [shield.at[c] for c in keep], shield.at[text], shield.at.get(lang, ""), tokenizers)
    if bands is None:
        measured = common.written(measured, "fertility")
        bands = corpus_bands(measured)
    return shield.back(judge(measured, bands), keep)
