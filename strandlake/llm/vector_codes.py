"""Product codes of vectors by member-resident Lloyd rounds.

A vector is cut into ``POSITIONS`` equal parts, and every part belongs to an entry of its position's codebook. Rows are parts, dealt by
(position, entry, salt) and kept where they are: the owners of an entry sum the members that they hold, the driver gets one sum
for each entry (bounded by the codebooks' size, whatever the input) and sends the new codebooks out, and each owner compares
its members with them in place. Only parts whose nearest entry has changed go through the next round's shuffle. The salt is part
of the row's number, so the members of an entry that holds a third of all parts lie in ``SALTS`` groups.

All arithmetic is on integers: products of floats are used only where they are exact, Python's integers where 64 bits would not do.

Defined cases: a vector that is null or holds a null or non-finite component is dropped, and so is one whose length is not the same
multiple of ``POSITIONS`` as that of the first kept ``vec_id``. Null ids come after all others. Repeated rows and ids are rows of
their own. Ties go to the lower entry, equal ids at the codebooks' start in order of their vectors. Fewer rows than entries make
smaller codebooks; an empty table gives an empty one. Errors beyond a long are its largest value. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from strandlake.llm import common

POSITIONS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Groups into which the members of one entry are dealt.
SALTS = 64
_MOST = (1 << 63) - 1
#: Integers up to here are exact as doubles.
_EXACT = 1 << 53
_SLICE = 8192
#: Entries a codebook can have.
ENTRIES_MOST = 1 << 16


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python's where one is larger. Numbers that large have no fraction."""
    x = x.astype(np.float64)
    if np.abs(x).max(initial=0) < _EXACT / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= _EXACT else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and the squared distance, of integer rows."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    bound = 4 * most * most * parts.shape[1]
    if bound < _EXACT:  # every sum below is an integer that a double holds
        p, b = parts.astype(np.float64), book.astype(np.float64)
        d = (p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1)[None, :]
    else:
        kind = np.int64 if bound < _MOST else object
        p, b = parts.astype(kind), book.astype(kind)
        d = np.stack([((p - entry) ** 2).sum(1) for entry in b], axis=1)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(at)), at]


def _components(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _by_position(batch: pa.RecordBatch, width: int, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer parts of a batch of part rows, their nearest entries and the distances."""
    parts = _integers(_components(batch.column("part"), width))
    position = batch.column("position").to_numpy(zero_copy_only=False)
    entry, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
    for p in np.unique(position):
        own = np.flatnonzero(position == p)
        entry[own], error[own] = nearest(parts[own], books[p])
    return parts, entry, error


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has only finite components, numbered; the numbers follow the splits, which are read again in the same way."""
    v = F.col("embedding")
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(finite)


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("position", "entry", "salt")


def _sums(members: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the members of each used entry: owners sum in place, entries are summed over owners."""

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            parts = _integers(_components(batch.column("part"), width))
            key = batch.column("position").to_numpy(zero_copy_only=False).astype(np.int64) * ENTRIES_MOST + batch.column("entry").to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            keys, starts, counts = np.unique(key[order], return_index=True, return_counts=True)
            for k, n, total in zip(keys.tolist(), counts.tolist(), np.add.reduceat(parts[order], starts, axis=0).tolist() if len(keys) else [], strict=True):
                held = totals.setdefault(k, [0, [0] * width])
                held[0] += n
                held[1] = [a + int(b) for a, b in zip(held[1], total, strict=True)]
        if totals:
            made = [(k // ENTRIES_MOST, k % ENTRIES_MOST, n, [str(x) for x in total]) for k, (n, total) in totals.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("position", "entry", "n", "total"), m, strict=True)) for m in made], pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))]))

    owned = members.select("position", "entry", "part").mapInArrow(owner, "position int, entry int, n long, total array<string>")
    each = owned.select("position", "entry", "n", F.posexplode("total").alias("component", "value"))
    whole = each.groupBy("position", "entry", "component").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    rows = whole.groupBy("position", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("component", "total"))).alias("totals"))  # width entries each
    return {(r.position, r.entry): (r.n, [int(t.total) for t in r.totals]) for r in rows.collect()}  # at most POSITIONS * ENTRIES rows


def _updated(books: list[np.ndarray], sums: dict) -> list[np.ndarray]:
    return [np.array([[t // sums[p, e][0] for t in sums[p, e][1]] if (p, e) in sums else entry.tolist() for e, entry in enumerate(book)], object) for p, book in enumerate(books)]


def _fitting(books: list[np.ndarray]) -> list[np.ndarray]:
    return [b.astype(np.int64) if all(abs(x) < 1 << 62 for x in b.ravel().tolist()) else b for b in books]


def encode(vectors: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, code, error) of every kept vector, written in the shared folder, and the final codebooks."""
    vectors = common.only(vectors, "vec_id", "embedding", "label")
    kept = kept_vectors(vectors)
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    lead = kept.where(F.size("embedding") > 0).where(F.size("embedding") % positions == 0).orderBy(*by_id).limit(1).collect()
    length = len(lead[0].embedding) if lead else positions
    width = length // positions
    kept = kept.where(F.size("embedding") == length)
    smallest = [r.embedding for r in kept.orderBy(*by_id).limit(entries).collect()]  # ``entries`` vectors
    start = _integers(np.array(smallest, np.float64).reshape(-1, length))
    books = _fitting([start[:, p * width : (p + 1) * width] for p in range(positions)])
    item = kept.schema["embedding"].dataType.elementType.simpleString()
    label_type, id_type = kept.schema["label"].dataType.simpleString(), kept.schema["vec_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of whole vectors with their nearest entries; id and label go with the first part."""
        for batch in batches:
            for low in range(0, batch.num_rows, _SLICE):
                rows = batch.slice(low, _SLICE)
                whole = _integers(_components(rows.column("embedding"), length))
                flat = rows.column("embedding").flatten()
                number = rows.column("row").to_numpy()
                for p in range(positions):
                    entry, _ = nearest(whole[:, p * width : (p + 1) * width], books[p])
                    take = (np.arange(len(number))[:, None] * length + np.arange(p * width, (p + 1) * width)).ravel()
                    part = pa.ListArray.from_arrays(pa.array(np.arange(0, len(take) + 1, width), pa.int32()), flat.take(pa.array(take)))
                    carried = [rows.column(c) if p == 0 else pa.nulls(len(number), rows.column(c).type) for c in ("vec_id", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array(number), *carried, pa.array(np.full(len(number), p), pa.int32()), pa.array(entry, pa.int32()), part], names=["row", "vec_id", "label", "position", "entry", "part"])

    salt = (F.xxhash64("row") % SALTS).alias("salt")
    numbered = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    part_rows = f"row long, vec_id {id_type}, label {label_type}, position int, entry int, part array<{item}>"
    members = _dealt(numbered.mapInArrow(cut, part_rows).select("*", salt)).persist(StorageLevel.DISK_ONLY)
    held = [members]
    for step in range(rounds):
        books = _fitting(_updated(books, _sums(members, width)))
        if step == rounds - 1:
            break

        def compared(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entry = _by_position(batch, width, books)[1]
                yield batch.append_column("nearest", pa.array(entry, pa.int32()))

        judged = members.mapInArrow(compared, f"{part_rows}, salt long, nearest int")
        staying = judged.where("nearest = entry").drop("nearest")
        moving = _dealt(judged.where("nearest <> entry").withColumn("entry", F.col("nearest")).drop("nearest"))
        members = staying.unionByName(moving).persist(StorageLevel.DISK_ONLY)
        held.append(members)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, entry, error = _by_position(batch, width, books)
            capped = pa.array([min(int(x), _MOST) for x in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "position")), pa.array(entry, pa.int32()), capped], names=["row", "vec_id", "label", "position", "entry", "error"])

    codes = members.mapInArrow(coded, f"row long, vec_id {id_type}, label {label_type}, position int, entry int, error long")
    digits = [F.max(F.when(F.col("position") == p, F.lower(F.lpad(F.hex("entry"), 2, "0")))) for p in range(positions)]
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    out = codes.groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.concat(*digits).alias("code"), _as_long(total).alias("error"))
    out = common.written(out.drop("row"), "codes")
    for df in held:
        df.unpersist()
    return out, books


def _as_long(x):
    return F.least(x, F.lit(_MOST).cast("decimal(38,0)")).cast("long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by position, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    out, books = encode(vectors)
    rows = out.select("vec_id", "code", "error", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_key"))
    by = ["no_label", "label_key"]
    totals = rows.groupBy(*by).agg(_as_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = common.keyed_join(rows, totals, by, "n", out.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    return f"""{name} AS (SELECT vec_id, label, p, any_value(x) AS x, min(d * {ENTRIES} + k) % {ENTRIES} AS k, min(d * {ENTRIES} + k) // {ENTRIES} AS d FROM
    (SELECT q.vec_id, q.label, q.p, q.x, b.k, list_sum(list_transform(list_zip(q.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts q JOIN {book} b ON q.p = b.p) GROUP BY ALL)"""


def _moved(name: str, members: str, book: str) -> str:
    return f"""{name}_s AS (SELECT p, k, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS y, unnest(range(0, len(x))) AS i FROM {members}) GROUP BY ALL),
{name}_m AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM {name}_s GROUP BY p, k),
{name} AS (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN {name}_m m ON b.p = m.p AND b.k = m.k)"""


#: DuckDB SQL for ``codes``, for tables whose ids are distinct.
ORACLE_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, e[p * (len(e) // {POSITIONS}) + 1 : (p + 1) * (len(e) // {POSITIONS})] AS x FROM (SELECT *, unnest(range(0, {POSITIONS})) AS p FROM v)),
first AS (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM first)),
{_assigned('a0', 'b0')}, {_moved('b1', 'a0', 'b0')},
{_assigned('a1', 'b1')}, {_moved('b2', 'a1', 'b1')},
{_assigned('a2', 'b2')},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2),
r AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""
