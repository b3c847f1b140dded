"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after a number, and names
(capitalised words inside a sentence; a run of them is one) become typed
placeholders, the others their lower-case hash without outer punctuation. Windows
of template tokens of the benchmark are hash-joined with those of the corpus. A hit
is an alignment of a document with an item at one offset, give or take ``BAND``
tokens, as a word may be left out or put in. Its slots must be consistent: each
value of the item's stands for one value of the document's throughout, and the
other way round. So a question whose numbers or names were exchanged is still
found, while a chance agreement of placeholders is not.

A window of a document with too few literals (capitals throughout, a list of names
or numbers) says little as a template, so its values stand in for its placeholders;
items give all their windows in both forms. So a passage in capitals, or one dense
in names, is found where its words are the item's.

Only windows whose hash may be in the benchmark leave the map side: a bitmap of
fixed size (512 KB, whatever the benchmark's size) filters them, and the join on
the full hash then decides exactly. Nothing else is broadcast.

Parameters: windows of ``WINDOW`` tokens with at least ``LITERALS`` that are
not placeholders; shorter items are one window of all their tokens. An item is
leaked where aligned windows cover ``COVER`` of its own, or ``RUN`` of them, with
``CONSISTENT`` of the slot values consistent.

Defined results: null and empty texts (of documents and items) have no windows
and no hits. A row is known by doc_id (null-safe) and the hash of its text, so
repeated rows get equal results. A window that an item repeats counts once, so rows
grow with the text alone, however long. Extra columns are ignored (``leaks``) or
kept (``decontaminate``), whatever their names. Ties cannot arise: every leaked
item is listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

WINDOW = 8
LITERALS = 5
COVER = 0.5
RUN = 12
CONSISTENT = 0.8
BAND = 8
BITMAP_BITS = 22
_NUM, _NAME, _UNIT = (common.U64(x) for x in (0x11, 0x22, 0x33))

# Units that follow a number.
UNITS = (
    "km m cm mm kg g mg t l ml s ms min h hz khz mhz ghz kb mb gb tb w kw v a k c f mph kmh percent degrees dollars dollar euros euro pounds cents "
    "years year months month weeks week days day hours hour minutes minute seconds second meters metres miles feet foot inches inch grams kilograms "
    "liters litres tons jahre jahr tage tag stunden stunde minuten meter kilometer ans an jours jour heures heure mètres años año días día horas hora metros"
).split()

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}*#$%&|<>-_`~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:|"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[lead] += 32
    return out


def _unit_hashes() -> np.ndarray:
    return np.sort(common.split_words(pa.array(UNITS)).hashes())


@dataclass
class Tokens:
    """Tokens of a run of texts, their slot values (0: none), which are literal, the word each begins at, and each text's first."""

    tokens: np.ndarray
    values: np.ndarray
    literal: np.ndarray
    at: np.ndarray
    first: np.ndarray


def template_tokens(texts: pa.Array) -> tuple[Tokens, Tokens]:
    """The texts as templates, and as plain words, whose slots are the words themselves."""
    words = common.split_words(texts)
    data, starts, ends = words.data, words.starts, words.ends.copy()
    n = len(starts)
    if not n:
        none = Tokens(np.zeros(0, common.U64), np.zeros(0, common.U64), np.zeros(0, bool), np.zeros(0, np.int64), words.first)
        return none, none
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    has_digit = digit[ends] > digit[starts]
    upper = np.zeros(len(data) + 1, bool)
    upper[:-1] = (data >= 65) & (data <= 90)
    upper[: len(data) - 1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    s, e = starts.copy(), ends
    stops = _STOP[data[ends - 1]]
    for _ in range(4):  # outer punctuation; what is left of a longer run stays part of the word
        trim = (e - s > 1) & _PUNCT[data[s]]
        s[trim] += 1
        trim = (e - s > 1) & _PUNCT[data[e - 1]]
        e[trim] -= 1
    opens = np.zeros(n, bool)  # the first word of a text, a line or a sentence
    opens[words.first[:-1][np.diff(words.first) > 0]] = True
    opens[1:] |= stops[:-1]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens[1:] |= lines[starts[1:]] > lines[starts[:-1]]
    low = common.Words(_lowered(data), s, e, words.first)
    h = low.hashes()
    unit = np.zeros(n, bool)
    after = np.flatnonzero(has_digit[:-1]) + 1
    table = _unit_hashes()
    at = np.minimum(np.searchsorted(table, h[after]), len(table) - 1)
    unit[after] = (table[at] == h[after]) & ~opens[after] & ~has_digit[after]
    name = upper[s] & ~opens & ~has_digit & ~unit
    tokens = np.where(has_digit, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, h | common.U64(1 << 63))))
    values = np.where(has_digit | unit | name, h | common.U64(1), common.U64(0))
    plain = Tokens(h | common.U64(1 << 63), h | common.U64(1), values == 0, np.arange(n), words.first)
    more = np.zeros(n, bool)  # names after a name are one with it
    more[1:] = name[1:] & name[:-1]
    at = np.flatnonzero(~more)
    several = np.diff(np.append(at, n)) > 1
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(common.mix(h), at)
    tokens, values = tokens[at], values[at]
    values[several] = common.mix(sums[several]) | common.U64(1)
    return Tokens(tokens, values, values == 0, at, np.searchsorted(at, words.first)), plain


def windows(t: Tokens, size: int, template: bool, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in words, hash, first token) of the windows of ``size`` tokens: of templates those with enough literals, of words the others, or all."""
    n = len(t.tokens)
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, common.U64), none
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    known = np.concatenate([[0], np.cumsum(t.literal)])
    enough = known[size:] - known[:-size] >= _need(size)
    pick = (doc[: n - size + 1] == doc[size - 1 :]) & (enough if template else every | ~enough)
    with np.errstate(over="ignore"):
        acc = np.full(n - size + 1, common.U64(size if template else size + 64))
        for j in range(size):
            acc = acc * common.U64(0x5851F42D4C957F2D) + t.tokens[j : n - size + 1 + j]
    at = np.flatnonzero(pick)
    return doc[at], t.at[at] - t.at[t.first[doc[at]]], common.mix(acc[at]), at


def _need(size: int) -> int:
    """Literals that a window of so many words needs: the same share, rounded up."""
    return LITERALS if size >= WINDOW else max(1, -(-size * LITERALS // WINDOW))


_OUT = "pos int, size int, hash long, vals array<long>"


def _batch(ids: dict[str, pa.Array], pos: np.ndarray, size: int, h: np.ndarray, t: Tokens, at: np.ndarray) -> pa.RecordBatch:
    """Windows with their slot values, 0 where a token has none."""
    flat = common.signed(t.values[at[:, None] + np.arange(size)[None, :]].reshape(-1))
    vals = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(flat))
    return pa.RecordBatch.from_arrays([*ids.values(), pa.array(pos, pa.int32()), pa.array(np.full(len(at), size), pa.int32()), pa.array(common.signed(h)), vals], names=[*ids, "pos", "size", "hash", "vals"])


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_windows, pos, size, hash, vals) of every benchmark item, in both forms; ``n_windows`` counts windows of words."""
    kind = benchmark.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_chunks(batch):
                template, plain = template_tokens(part.column("text"))
                n_words = np.diff(plain.first)
                for t in (template, plain):
                    lengths = np.diff(t.first)
                    for size in range(1, WINDOW + 1):
                        doc, pos, h, at = windows(t, size, t is template, True)
                        own = np.flatnonzero(lengths[doc] == size) if size < WINDOW else np.arange(len(doc))
                        _, once = np.unique(np.stack([doc[own].astype(common.U64), h[own]]), axis=1, return_index=True)
                        own = own[np.sort(once)]
                        if len(own):
                            total = np.maximum(1, n_words[doc[own]] - WINDOW + 1)
                            ids = {"item_id": part.column("item_id").take(pa.array(doc[own])), "n_windows": pa.array(total, pa.int32())}
                            yield _batch(ids, pos[own], size, h[own], t, at[own])

    rows = benchmark.select(F.col(item).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, n_windows int, " + _OUT)


def bitmap(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the items' window hashes, of fixed size, and the window sizes that occur."""
    position = F.pmod(F.col("hash"), F.lit(1 << BITMAP_BITS)) + 1
    parts = items.groupBy(F.bitmap_bucket_number(position).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).collect()  # at most 2**22 / 2**15 + 1 rows of 4 KB
    bits = np.zeros((1 << BITMAP_BITS) // 8 + 8192, np.uint8)
    for row in parts:
        lo = (row.b - 1) * 4096
        bits[lo : lo + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    sizes = [r.size for r in items.select("size").distinct().collect()]  # at most WINDOW values
    return bits, sorted(sizes)


def doc_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, pos, size, hash, vals) of the documents' windows that the bitmap lets through."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tool(None)
        mask = np.uint64((1 << BITMAP_BITS) - 1)
        table = shared.value
        for batch in batches:
            for part in common.text_chunks(batch):
                template, plain = template_tokens(part.column("text"))
                for t in (template, plain):
                    for size in sizes:
                        doc, pos, h, at = windows(t, size, t is template, False)
                        spot = (h & mask).astype(np.int64)
                        hit = np.flatnonzero((table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1)
                        if len(hit):
                            ids = {c: part.column(c).take(pa.array(doc[hit])) for c in ("doc_id", "text_hash")}
                            yield _batch(ids, pos[hit], size, h[hit], t, at[hit])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, " + _OUT)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_item_windows, consistency) of every leaked item of every document."""
    docs = common.only(docs, "doc_id", "text")
    items = common.cut(item_windows(common.only(benchmark, "item_id", "text")))
    bits, sizes = bitmap(items)
    found = doc_windows(docs, bits, sizes)
    pairs = (
        found.distinct()  # repeated rows
        .alias("d")
        .join(items.alias("b"), ["hash", "size"])
        .select("d.doc_id", "d.text_hash", "b.item_id", "b.n_windows", (F.col("d.pos") - F.col("b.pos")).alias("shift"), F.col("b.pos").alias("item_pos"), F.arrays_zip(F.col("b.vals").alias("i"), F.col("d.vals").alias("v")).alias("slots"))
        .withColumn("band", F.explode(F.array(F.floor(F.col("shift") / (2 * BAND)) * 2, F.floor((F.col("shift") + BAND) / (2 * BAND)) * 2 + 1)))  # bands overlap by half
    )
    key = ["doc_id", "text_hash", "item_id", "n_windows", "band"]
    aligned = pairs.groupBy(*key).agg(F.count_distinct("item_pos").alias("hit"), F.array_distinct(F.flatten(F.collect_set(F.filter("slots", lambda s: (s["i"] != 0) | (s["v"] != 0))))).alias("slots"))
    n_pairs = F.size("slots")
    one_way = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    other_way = F.size(F.array_distinct(F.transform("slots", lambda s: s["v"])))
    consistency = F.when(n_pairs == 0, F.lit(1.0)).otherwise(F.least(one_way, other_way) / n_pairs)
    return (
        aligned.withColumn("consistency", consistency)
        .where((F.col("consistency") >= CONSISTENT) & ((F.col("hit") >= COVER * F.col("n_windows")) | (F.col("hit") >= RUN)))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct("hit", "consistency", "n_windows")).alias("best"))
        .select("doc_id", "text_hash", "item_id", F.col("best.hit").cast("long").alias("n_windows"), F.col("best.n_windows").cast("long").alias("n_item_windows"), F.round("best.consistency", 6).alias("consistency"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    shield = common.Shield(docs)
    i, t = shield.at["doc_id"], shield.at["text"]
    rows = shield.rows.withColumn("text_hash", F.xxhash64(t))
    bad = leaks(rows.select(F.col(i).alias("doc_id"), F.col(t).alias("text")), benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return shield.back(rows.join(bad, rows[i].eqNullSafe(bad["bad_id"]) & (rows["text_hash"] == bad["bad_hash"]), "left_anti").drop("text_hash"))
