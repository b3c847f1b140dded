"""Near-duplicate detection by improved consistent weighted sampling.

1. Texts become sets of five-word shingles (lower case) weighted by TF-IDF: sublinear
   term frequency (1 + ln tf) times an augmented inverse document frequency (0.5 to 1
   by the logarithm of the shingle's share of documents). Document frequencies are
   counted over every document, in hashed buckets (their share of documents, and
   so the weights, do not depend on the corpus' size), summed per task.
2. Every text is sampled ``BANDS * ROWS`` times by improved consistent weighted
   sampling; two texts agree on a sample with a probability equal to their
   weighted Jaccard similarity. ``ROWS`` samples make a band's key.
3. Equal texts are one node from here on, so copies cost nothing more. Nodes that
   share a band's key are candidates: all members of a bucket are compared with its
   pivot, the most central one. Buckets whose members are not all in one class
   after that are compared whole (``across``): every pair of members that is not in
   one class yet is compared, so no pair is left out and no round is capped.
4. Candidates are verified by their exact weighted Jaccard similarity, a pivot's
   members (or a block of a bucket's) streaming past it, in salted groups of bounded size.
5. Verified links are joined to classes by hash-to-min label propagation.

Joins on a key that may have a third of all rows (a node's copies, a bucket, a
pivot, a class) keep the rows of such keys where they are (``common.keyed_join``).

Result: one row per document with ``class_id``, the least doc_id of its class,
and ``class_size``. Nothing about single documents reaches the driver.

Defined results: texts without words, null and empty ones too, are one class
(null counts as empty); a text of fewer than five words is one shingle of all its
words. Texts of any length are compared whole, all their shingles. A null doc_id is ignored where the least is taken; a class with none has a
null class_id. Repeated rows are in one class, and ``deduplicate`` keeps one of
them. Ties in pivots are broken by hash, then node. Extra columns are ignored
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
DF_BITS = 18
#: Bits of a shingle's hash, and the most texts whose numbers fit beside it.
SHINGLE_BITS, MOST_TEXTS = 52, 4095
#: Augmented IDF: a shingle weighs between 1 - IDF_SHARE (in every document) and 1 (in hardly any). An IDF without
#: that floor would let the few words that differ outweigh what thousands of near copies share.
IDF_SHARE = 0.5
GROUP_WORDS = 200_000
#: Texts whose results (or node, 16 bytes) a task keeps so that copies are not computed (or sent) again; what is not kept is.
SEEN = 20_000
_WIDTH = 1024


def node_id(text: str = "text") -> Column:
    """128 bits of hash that stand for a text; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(20), t).alias("b"))


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


def _numbered(texts: pa.Array) -> tuple[np.ndarray, int]:
    """Text number (upper bits) and shingle (lower ``SHINGLE_BITS``) of every shingle, sorted; and the number of texts, under 4096."""
    words = common.split_words(_lower(texts))
    every, first = common.shingles(words, words.hashes(), SHINGLE)
    n = len(first) - 1
    with np.errstate(over="ignore"):
        key = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << common.U64(SHINGLE_BITS)) | (every >> common.U64(64 - SHINGLE_BITS))
    key.sort()
    return key, n


def weighted_shingles(texts: pa.Array, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted within each text, their weights, and the offsets of each text's run."""
    if len(texts) > MOST_TEXTS:
        parts = [weighted_shingles(texts.slice(at, MOST_TEXTS), idf) for at in range(0, len(texts), MOST_TEXTS)]
        e, weight, first = (np.concatenate(x) for x in zip(*((e, w, np.diff(f)) for e, w, f in parts), strict=True))
        return e, weight, np.concatenate([[0], np.cumsum(first)])
    key, n = _numbered(texts)
    at = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    e = key & common.U64((1 << SHINGLE_BITS) - 1)
    weight = 1 + np.log(tf)
    if idf is not None:
        weight = weight * idf[(e >> common.U64(SHINGLE_BITS - DF_BITS)).astype(np.int64)]
    return e, weight, np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << common.U64(SHINGLE_BITS))


def document_frequency(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Documents that have a shingle of each hashed bucket; and, last, the number of documents."""
    buckets = 1 << DF_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tool(None)
        total = np.zeros(buckets + _WIDTH, np.int64)
        for batch in batches:
            for part in common.text_chunks(batch):
                for at in range(0, part.num_rows, MOST_TEXTS):
                    key, _ = _numbered(part.column("text").slice(at, MOST_TEXTS))
                    pairs = key >> common.U64(SHINGLE_BITS - DF_BITS)  # sorted, as the keys are
                    pairs = pairs[np.diff(pairs, prepend=~pairs[:1]) != 0]
                    total[:buckets] += np.bincount((pairs & common.U64(buckets - 1)).astype(np.int64), minlength=buckets)
                total[buckets] += part.num_rows
        if total.any():
            yield common.block_rows(total, _WIDTH)

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return common.sum_blocks(rows.mapInArrow(run, common.BLOCKS), buckets + _WIDTH, _WIDTH)[: buckets + 1]


def damped_idf(df: np.ndarray) -> np.ndarray:
    """Weights in (1 - IDF_SHARE, 1] of each bucket, by its share of documents alone."""
    share = (df[:-1] + 1) / (df[-1] + 1)
    most = DF_BITS * np.log(2)
    return (1 - IDF_SHARE + IDF_SHARE * np.clip(-np.log(share) / most, 0, 1)).astype(np.float64)


_GAMMA_BITS = 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), by Newton's method on its distribution 1 - (1 + x) exp(-x)."""
    u = (np.arange(1 << _GAMMA_BITS) + 0.5) / (1 << _GAMMA_BITS)
    x = np.where(u < 0.3, np.sqrt(2 * u), 2 - np.log1p(-u))
    for _ in range(60):
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9, 60)
    return x.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling, vectorised over the shingles of many texts."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        self.bands, self.rows = bands, rows
        self.seeds = common.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.r = _gamma_quantiles()
        self.log_c = np.log(self.r)

    def band_keys(self, e: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Keys [texts, bands]; a text without shingles has keys of its emptiness."""
        n = len(first) - 1
        full = np.flatnonzero(np.diff(first) > 0)
        starts = first[full]
        sizes = np.diff(np.append(starts, len(e)))
        log_w = np.log(weight).astype(np.float32)
        keys = np.full((n, self.bands), 1, np.uint64)
        low = np.uint64((1 << _GAMMA_BITS) - 1)
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                key = np.full(len(full), np.uint64(band + 1))
                for row in range(self.rows):
                    z = common.mix(e ^ self.seeds[band * self.rows + row])
                    r = self.r[z & low]
                    log_c = self.log_c[(z >> np.uint64(16)) & low]
                    beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
                    t = np.floor(log_w / r + beta)
                    log_a = log_c - r * (t - beta) - r
                    if len(full):
                        least = np.minimum.reduceat(log_a, starts)
                        hit = np.flatnonzero(log_a == np.repeat(least, sizes))
                        at = hit[np.searchsorted(hit, starts)]
                        key = common.mix(key * np.uint64(0x5851F42D4C957F2D) + e[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                keys[full, band] = key
        return keys


def signatures(docs: DataFrame, idf: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, node, words, weight, keys) of every row: distinct shingles, their summed weight, the bands' keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tool(None)
        sampler, weights = Sampler(), shared.value
        seen: dict[bytes, bytes] = {}  # node to its words, weight and keys, as bytes
        row = np.dtype([("words", "<i8"), ("weight", "<f8"), ("keys", "<u8", (BANDS,))])
        for batch in batches:
            for part in common.text_chunks(batch, "text", 256 << 10):
                ids = np.stack([part.column("node").field(x).to_numpy(zero_copy_only=False) for x in (0, 1)], axis=1)
                nodes = [x.tobytes() for x in ids]
                fresh = {k: i for i, k in reversed(list(enumerate(nodes))) if k not in seen}
                own: dict[bytes, bytes] = {}
                if fresh:
                    e, w, first = weighted_shingles(part.column("text").take(pa.array(list(fresh.values()))), weights)
                    made = np.empty(len(fresh), row)
                    made["words"] = np.diff(first)
                    sums = np.concatenate([[0.0], np.cumsum(w)])
                    made["weight"] = sums[first[1:]] - sums[first[:-1]]
                    made["keys"] = sampler.band_keys(e, w, first)
                    own = {k: x.tobytes() for k, x in zip(fresh, made, strict=True)}
                found = np.frombuffer(b"".join([own[k] if k in own else seen[k] for k in nodes]), row)
                if len(seen) + len(own) <= SEEN:
                    seen.update(own)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(common.signed(np.ascontiguousarray(found["keys"]).reshape(-1))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(np.ascontiguousarray(found["words"])), pa.array(np.ascontiguousarray(found["weight"])), keys], names=["doc_id", "node", "words", "weight", "keys"])

    rows = docs.select("doc_id", node_id(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, node struct<a:long,b:long>, words long, weight double, keys array<long>")


def distinct_nodes(signed: DataFrame) -> DataFrame:
    """(node, least, n, words, weight, keys): a row for each distinct text, its least doc_id and its number of copies."""
    each = [F.first(F.col("keys")[i]).alias(f"k{i}") for i in range(BANDS)]  # longs, so that the aggregate is hashed
    grouped = signed.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "doc_id", "words", "weight", "keys").groupBy("a", "b")
    rows = grouped.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"), F.first("weight").alias("weight"), *each)
    return rows.select(F.struct("a", "b").alias("node"), "least", "n", "words", "weight", F.array(*(f"k{i}" for i in range(BANDS))).alias("keys"))


def texts_of(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, text) of the nodes asked for, one row each. Tasks drop the copies they have seen before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for i, k in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if k not in seen:
                    keep.append(i)
                    if len(seen) < SEEN:
                        seen.add(k)
            yield batch.take(pa.array(keep, pa.int64()))

    rows = docs.select(node_id(text).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("n.a", "n.b", "text").mapInArrow(run, "a long, b long, text string")
    asked = nodes.select("node.a", "node.b")
    return rows.join(asked, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select(F.struct("a", "b").alias("node"), "text")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets; two empty ones are equal."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common_ = b[0][at] == a[0]
    shared = np.minimum(a[1][common_], b[1][at[common_]]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """(pivot, node) of the pairs whose similarity is ``threshold`` or more; pairs: (pivot, node, words), texts: (node, text)."""
    size = common.cut(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1), F.ceil(F.sum("words") / F.lit(GROUP_WORDS))).alias("salts")))
    salted = common.keyed_join(pairs, size, ["pivot"], "n", pairs.count()).select("pivot", "node", F.pmod(F.xxhash64("node"), "salts").alias("salt"))
    members = salted.join(texts, "node").select("pivot", "salt", F.lit(1).alias("member"), "node", "text")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    pivots = size.join(texts.withColumnRenamed("node", "pivot"), "pivot").select("pivot", salts, F.lit(0).alias("member"), F.col("pivot").alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tool(None)
        weights, pivot, own = shared.value, None, None
        for batch in batches:
            for part in common.text_chunks(batch, "text", 1 << 20):
                e, w, first = weighted_shingles(part.column("text"), weights)
                keep = []
                for i, (p, member) in enumerate(zip(part.column("pivot").to_pylist(), part.column("member").to_pylist(), strict=True)):
                    vector = e[first[i] : first[i + 1]], w[first[i] : first[i + 1]]
                    if not member:
                        pivot, own = p, (vector[0].copy(), vector[1].copy())
                    elif p == pivot and similarity(own, vector) >= threshold:
                        keep.append(i)
                yield part.select(["pivot", "node"]).take(pa.array(keep, pa.int64()))

    rows = members.unionByName(pivots).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")
    return rows.mapInArrow(run, "pivot struct<a:long,b:long>, node struct<a:long,b:long>")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node of each node's component, by hash-to-min with pointer jumping.

    A node of many links, and a class of many nodes, are hot keys; both have their count beside them.
    """
    both = common.cut(links.select(F.col("pivot").alias("u"), F.col("node").alias("v")).union(links.select(F.col("node").alias("u"), F.col("pivot").alias("v"))).distinct())
    labels = common.cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp"), "degree"))
    n_links, n_nodes = both.count(), labels.count()
    while True:
        near = common.keyed_join(both, labels.select(F.col("node").alias("v"), F.col("comp").alias("c"), "degree"), ["v"], "degree", n_links)
        seen = near.groupBy("u").agg(F.min("c").alias("c"))
        nearer = common.cut(labels.join(seen, F.col("node") == F.col("u")).select("node", "degree", F.col("comp").alias("was"), F.least("comp", "c").alias("comp")))
        sizes = nearer.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        jump = sizes.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("jc")), "comp")
        step = common.cut(common.keyed_join(nearer, jump, ["comp"], "size", n_nodes).select("node", "degree", "was", F.least("comp", "jc").alias("comp")))
        changed = step.where(F.col("was") != F.col("comp")).limit(1).count()
        labels = step.select("node", "comp", "degree")
        del near, seen, nearer, sizes, jump, step
        common.tidy(links.sparkSession)
        if not changed:
            return labels.select("node", "comp")


def across(members: DataFrame, labels: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """(pivot, node): links between members of a bucket that are not in one class yet; every such pair is compared or joined on the way.

    Of a bucket all members but those of its largest class are dealt to blocks of bounded size, which are held; all members
    stream past the blocks, in salted groups. No list of pairs is made. Buckets with the same members count once.
    """
    inside = common.cut(members.select("key", "node", "words", "weight").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sums = inside.groupBy("key", "comp").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("b"))
    buckets = common.cut(
        sums.groupBy("key").agg(F.max(F.struct("w", "comp")).alias("most"), F.sum("w").alias("total"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("classes"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        .where("classes > 1")
        .groupBy("a", "b", "total").agg(F.min(F.struct("key", "most", "n")).alias("m"))
        .select("m.key", "m.n", F.col("m.most.comp").alias("largest"), F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("m.most.w")) / GROUP_WORDS)).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("total") / GROUP_WORDS)).alias("salts"))
    )
    dealt = (
        common.keyed_join(inside, buckets, ["key"], "n", inside.count()).withColumn("outside", F.col("comp") != F.col("largest"))
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "node"), "salts"))
        .join(texts, "node")
    )
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n)
    place = lambda block, salt, member: F.struct(block.alias("block"), salt.alias("salt"), F.lit(member).alias("member"))
    held = F.when(F.col("outside"), F.transform(upto(F.col("salts") - 1), lambda s: place(F.col("block"), s, 0))).otherwise(F.expr("cast(array() as array<struct<block:bigint,salt:bigint,member:int>>)"))
    past = F.transform(upto(F.when(F.col("outside"), F.col("block")).otherwise(F.col("blocks") - 1)), lambda b: place(b, F.col("salt"), 1))
    rows = dealt.withColumn("p", F.explode(F.concat(held, past))).select("key", "p.block", "p.salt", "p.member", "node", "comp", "weight", "text")
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, group = shared.value, None
        nodes, vectors, heavy, classes, parent = [], [], [], {}, {}
        sizes = label = np.zeros(0)

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for batch in batches:
            for part in common.text_chunks(batch, "text", 1 << 20):
                e, w, first = weighted_shingles(part.column("text"), weights)
                out: list[tuple[dict, dict]] = []
                columns = (part.column(c).to_pylist() for c in ("key", "block", "salt", "member", "node", "comp", "weight"))
                for i, (key, block, salt, member, node, comp, weight) in enumerate(zip(*columns, strict=True)):
                    if (key, block, salt) != group:
                        group, label = (key, block, salt), None
                        nodes, vectors, heavy, classes, parent = [], [], [], {}, {}
                    vector = e[first[i] : first[i + 1]], w[first[i] : first[i + 1]]
                    c = (comp["a"], comp["b"])
                    if not member:
                        nodes.append(node)
                        vectors.append((vector[0].copy(), vector[1].copy()))
                        heavy.append((weight, classes.setdefault(c, len(classes))))
                        continue
                    if label is None:
                        sizes, label = np.array([x for x, _ in heavy]), np.array([x for _, x in heavy], np.int64)
                    own = root(classes.setdefault(c, len(classes)))
                    near = (label != own) & (np.minimum(sizes, weight) >= threshold * 0.999999 * np.maximum(sizes, weight))
                    for j in np.flatnonzero(near):
                        if label[j] != own and similarity(vectors[j], vector) >= threshold:
                            out.append((nodes[j], node))
                            was = int(label[j])
                            parent[was] = own
                            label[label == was] = own
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pair), pa.array([n for _, n in out], pair)], names=["pivot", "node"])

    return rows.repartition("key", "block", "salt").sortWithinPartitions("key", "block", "salt", "member", "node").mapInArrow(run, "pivot struct<a:long,b:long>, node struct<a:long,b:long>")


def links_of(docs: DataFrame, nodes: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> tuple[DataFrame, DataFrame] | None:
    """(pivot, node): verified links, and (node, comp): their classes; None where no two texts share a band's key.

    The pivot of a bucket is the member that meets most others in all its buckets: among copies that were edited
    each in its own way, that is the text nearest to all of them, so the group is done at once though its copies
    are not similar to each other. A pair whose weights alone rule the threshold out is not compared: similarity
    is at most their ratio. The pivots have met all members; the others are then compared across classes.
    """
    flat = nodes.select("node", "words", "weight", F.explode("keys").alias("key"))
    shared_keys = common.cut(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if shared_keys.isEmpty():
        return None
    met_keys = common.keyed_join(flat, shared_keys, ["key"], "n", BANDS * nodes.count())
    members = common.cut(met_keys.groupBy("node", "words", "weight").agg(F.collect_list(F.struct("key", "n")).alias("k"), F.sum("n").alias("score")).select("node", "words", "weight", "score", F.explode("k").alias("k")).select("node", "words", "weight", "score", "k.key", "k.n"))  # at most BANDS keys a node
    texts = common.written(texts_of(docs, members.select("node").distinct(), text), "texts")
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    first = F.max(F.struct("score", F.xxhash64("node").alias("h"), "node", "weight"))
    pivots = common.cut(members.groupBy("key").agg(first.alias("p"), F.count(F.lit(1)).alias("n")).select("key", F.col("p.node").alias("pivot"), F.col("p.weight").alias("pivot_weight"), "n"))
    met = common.cut(common.keyed_join(members.drop("n", "score"), pivots, ["key"], "n", members.count()).where(F.col("node") != F.col("pivot")))
    near = F.least("weight", "pivot_weight") >= F.lit(threshold) * F.greatest("weight", "pivot_weight")
    links = common.cut(_undirected(verified(common.cut(met.where(near).select("pivot", "node", "words").distinct()), texts, shared, threshold)))
    del flat, met_keys, members, pivots, shared_keys
    labels = components(links)
    more = common.cut(across(met, labels, texts, shared, threshold))
    common.tidy(docs.sparkSession)
    if not more.isEmpty():
        links = common.cut(_undirected(links.union(more)))
        labels = components(links)
    common.discard(texts)
    return links, labels


def _undirected(links: DataFrame) -> DataFrame:
    return links.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()


def _classes(nodes: DataFrame, found: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """(node, n, class_id, class_size, n_links) of every distinct text."""
    alone = nodes.select("node", "n", "least")
    if found is None:
        return alone.select("node", "n", F.col("least").alias("class_id"), F.col("n").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    links, labels = found
    degree = links.select("node").union(links.select(F.col("pivot").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = common.cut(labels.join(degree, "node").join(alone, "node"))
    total = common.cut(linked.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("k")))
    known = common.keyed_join(linked, total, ["comp"], "k", linked.count()).select("node", "class_id", "class_size", "n_links", F.lit(True).alias("linked"))
    return alone.join(known, "node", "left").select(
        "node", "n", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("class_size", "n").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_id, class_size, n_links) of every row; n_links counts the text's verified links to other texts."""
    docs = common.only(docs, "doc_id", text)
    idf = damped_idf(document_frequency(docs, text))
    signed = common.written(signatures(docs, idf, text), "signatures")
    nodes = common.written(distinct_nodes(signed), "nodes")
    common.tidy(docs.sparkSession)
    classes = common.written(_classes(nodes, links_of(docs, nodes, idf, threshold, text)), "classes")
    rows = common.keyed_join(signed.select("doc_id", "node"), classes, ["node"], "n", signed.count())
    return rows.select("doc_id", "node", F.when(F.col("class_size") == 1, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_size", "n_links")


def deduplicate(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns: that of the least doc_id (without any, one of each distinct text).

    Of rows that are equal in doc_id and text one is kept. Only rows of which there are several are grouped for that.
    """
    shield = common.Shield(docs)
    i, t = shield.at["doc_id"], shield.at[text]
    keep = _kept(near_duplicates(shield.rows.select(F.col(i).alias("doc_id"), F.col(t).alias("text")), "text", threshold))
    node = node_id(t)
    rows = shield.rows.withColumn("own_id", _id_key(i)).withColumn("own_a", node["a"]).withColumn("own_b", node["b"])
    key = ["own_id", "own_a", "own_b"]
    found = common.keyed_join(rows, keep, key, "copies", docs.count())
    once = found.where("copies = 1").select(*shield.columns)
    return shield.back(once.unionByName(found.where("copies > 1").dropDuplicates(key).select(*shield.columns)))


def _id_key(column: str) -> Column:
    """A doc_id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _kept(classes: DataFrame) -> DataFrame:
    """(own_id, own_a, own_b, copies) to keep: of each class the row with its least doc_id; equal ids of other texts in the class don't matter."""
    first = classes.where(F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id")))
    each = first.groupBy("class_id", "node", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    least = each.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("own")).agg(F.min(F.struct("node", "doc_id", "copies")).alias("m"))
    return common.cut(least.select(_id_key("m.doc_id").alias("own_id"), F.col("m.node.a").alias("own_a"), F.col("m.node.b").alias("own_b"), F.col("m.copies").alias("copies")))
