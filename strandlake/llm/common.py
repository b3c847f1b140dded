"""Helpers shared by the text operators: reading tables, cutting lineage, hashing words.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Hashing is
vectorised over whole Arrow batches: a polynomial prefix sum modulo 2**64 gives
the hash of every word without a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers; any odd number is invertible modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 512 << 10
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIR: dict[str, str] = {}
#: A key with at least a 1/HOT_KEYS share of the rows is hot, so there are at most HOT_KEYS such keys.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none: the context's checkpoint folder, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_DIR.setdefault(context.applicationId, "") or _own_dir(context.applicationId)


def _own_dir(app: str) -> str:
    _OWN_DIR[app] = own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that nothing refers to any more. It does so when the driver's garbage is collected,
    which a driver that only plans does rarely, while every round of a job leaves files on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/strandlake-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table in the shared folder and read it: compressed, and readable by column."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:  # a flat folder: the first file tells it
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others are called (in another case, or the same again)."""
    own, at = _by_place(df)
    return own.select(*(F.col(f"c{at[n]}").alias(n) for n in names))


def _by_place(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {c: i for i, c in reversed(list(enumerate(df.columns)))}


class Shield:
    """The rows of a table under column names that no operator uses; ``back`` restores the names.

    An operator's own column takes the place of an extra one that has its name in any case.
    """

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.at = {c: f"carried_column_{i}" for i, c in reversed(list(enumerate(self.names)))}
        self.columns = [f"carried_column_{i}" for i in range(len(self.names))]
        self.rows = df.toDF(*self.columns)

    def back(self, out: DataFrame, keep: list[str] | None = None, made: list[str] | None = None) -> DataFrame:
        """The original columns (or ``keep`` of them) and then those that the operator made."""
        made = [c for c in out.columns if c not in self.columns] if made is None else made
        taken = {c.lower() for c in made}
        pairs = list(zip(self.names, self.columns, strict=True)) if keep is None else [(c, self.at[c]) for c in keep]
        return out.select(*(F.col(own).alias(c) for c, own in pairs if c.lower() not in taken), *made)


def with_text(rows: DataFrame, columns: list[str], text: str, *more: Column) -> tuple[DataFrame, str]:
    """The columns, and the text column beside them only where it is not among them, so that texts are sent to Python once; its name."""
    name = text if text in columns else "text"
    return rows.select(*columns, *([] if text in columns else [F.col(text).alias("text")]), *more), name


def schema_of(df: DataFrame, columns: list[str], made: str) -> str:
    """The schema of a task's output: some of the table's columns, then those that it makes."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema), made])


def keyed_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Rows joined with a table that has one row a key, and in ``n`` how many rows have it, of ``total`` in all.

    Keys with a share of at least 1 / HOT_KEYS are at most HOT_KEYS, so these alone are broadcast and their rows stay where
    they are; all others are joined by a shuffle in which no key has more than that share. The table is read twice.
    """
    own = F.xxhash64(*on)
    hot = [r.h for r in table.where(F.col(n) * HOT_KEYS >= F.lit(total)).select(own.alias("h")).collect()]  # at most HOT_KEYS numbers
    if not hot:
        return rows.join(table, on, how)
    is_hot = own.isin(hot)
    cold = rows.where(~is_hot).join(table.where(~is_hot), on, how)
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), on).select(*cold.columns).unionByName(cold)


def release() -> None:
    """Give memory that a task has freed back to the system: workers outlive tasks, and executors have several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


_TOOL: list[tuple] = []


def tool(key: tuple | None, make: Callable[[], object] = lambda: None) -> object:
    """The tool of this key in this Python worker. Workers outlive tasks, so one keeps the tool that it used last, and no other:
    models and caches of several operators together would fill an executor's memory. Without a key, it keeps none."""
    if not _TOOL or _TOOL[0][0] != key:
        _TOOL.clear()
        release()
        _TOOL.append((key, make()))
    return _TOOL[0][1]


_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(_BASE))]), dtype=U64)
            _INV = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(inverse))]), dtype=U64)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``data``; words of text i are ``[first[i], first[i+1])``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        at = 0
        while at < len(self.starts):
            lo = int(self.starts[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, lo + (4 << 20), "right")))
            hi = int(self.ends[upto - 1])
            power, inverse = _powers(hi - lo + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(hi - lo + 1, U64)
                np.cumsum((self.data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=sums[1:])
                s, e = self.starts[at:upto] - lo, self.ends[at:upto] - lo
                out[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64))
            at = upto
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[o[0] : o[-1]], o - o[0]


def split_words(texts: pa.Array) -> Words:
    data, offsets = raw_bytes(texts)
    n = len(data)
    space = _WS[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | begins[1:n]
    ends = ~space
    ends[: n - 1] &= space[1:] | begins[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, s, e, np.searchsorted(s, offsets))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so that scratch arrays stay small."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def shingles(words: Words, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and the offsets of each text's run; a shorter text is one shingle."""
    counts = np.diff(words.first)
    full = np.maximum(counts - size + 1, 0)
    with np.errstate(over="ignore"):
        m = len(hashes)
        acc = np.zeros(max(m - size + 1, 0), U64)
        for j in range(size):
            acc += hashes[j : m - size + 1 + j] * U64(pow(_BASE, j + 1, 1 << 64)) if len(acc) else acc
    acc = mix(acc)
    runs = np.where(counts == 0, 0, np.maximum(full, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(int(first[-1]), U64)
    long = full > 0
    # positions of full shingles: words from the start of each text to size - 1 words before its end
    docs = np.repeat(np.arange(len(counts)), runs)
    within = np.arange(len(out)) - first[docs]
    at = words.first[docs] + within
    whole = long[docs]
    out[whole] = acc[at[whole]]
    for i in np.flatnonzero((counts > 0) & ~long):
        with np.errstate(over="ignore"):
            h = U64(counts[i])
            for w in hashes[words.first[i] : words.first[i + 1]]:
                h = h * U64(_BASE) + w
            out[first[i]] = mix(np.array([h]))[0]
    return out, first


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return x.astype(U64).view(np.int64)


def with_schema(batch_columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_columns[f.name], f.type) for f in schema], schema=schema)


def script_of(text: str) -> str:
    """The most frequent script among the letters at the text's start and throughout, by code-point block."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    block = np.searchsorted(_SCRIPT_FROM, codes, "right") - 1
    counts = np.bincount(block, minlength=len(_SCRIPT_NAME))
    counts[[i for i, s in enumerate(_SCRIPT_NAME) if s == "other"]] = 0
    totals: dict[str, int] = {}
    for name, c in zip(_SCRIPT_NAME, counts, strict=True):
        totals[name] = totals.get(name, 0) + int(c)
    best = max(totals, key=lambda k: totals[k])
    return best if totals[best] else "other"


# First code points of Unicode blocks and the script they are counted as.
_BLOCKS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"),
    (0x00C0, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
_SCRIPT_FROM = np.array([a for a, _ in _BLOCKS])
_SCRIPT_NAME = [b for _, b in _BLOCKS]


def null_safe_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def block_rows(counts: np.ndarray, width: int) -> pa.RecordBatch:
    """A task's count vector as compressed blocks of ``width`` counts; empty blocks are left out."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    blocks = counts.reshape(-1, width)
    at = np.flatnonzero(blocks.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([pack(blocks[i].astype(np.int64).tobytes()) for i in at], pa.binary())], names=["block", "counts"])


BLOCKS = "block int, counts binary"


def sum_blocks(parts: DataFrame, size: int, width: int) -> np.ndarray:
    """Sum of the tasks' count vectors. Blocks are summed as a stream, so no group is held in memory; ``size`` counts reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(unpack(raw), np.int64)
                total[block] = total[block] + part if block in total else part
        if total:
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x.tobytes()) for x in total.values()], pa.binary())], names=["block", "counts"])

    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = np.zeros((size // width, width), np.int64)
    for row in parts.repartition("block").mapInArrow(add, BLOCKS).collect():  # size / width rows
        out[row.block] = np.frombuffer(unpack(row.counts), np.int64)
    return out.reshape(-1)
