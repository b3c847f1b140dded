"""Conversation repair as a shortest path, found by an auction over an integer-cost lattice.

A node is (rows read, role that ended last): start, system, user or assistant. Arcs are the edits: Keep, Rerole, Delete and Insert,
labelled K, R, D and I. The auction keeps a price for every node, never above an arc's cost plus the price at its end, and a path
from the origin: where the path's end is cheaper than every way on, its price rises and the path contracts, else the path
extends along the cheapest arc. When the path arrives, the origin's price is the cost; every cheapest path runs over tight arcs
(price equals cost plus price at the end), and the audit is the least such path, read label by label. Long conversations
are auctioned in blocks from the end, with the prices at a block's far side fixed, so the work is linear in their rows.

Rows of a conversation are read in order by one task, because its result has one hash over all its texts in order. The task holds
none of them: every row comes twice, first without its text (one byte is kept, then four prices), then with it, when it goes
straight into the hash. Which rows repeat an earlier one is found by an aggregation over (conversation, role, digest of the text),
whose results are sorted in between the rows as markers, so that no task holds a set of what it has seen, and no join has a hot key.

Defined cases: a null role or text is one space, a null ``turn`` comes first and counts in no gap, a null ``conv_id`` is a
conversation of its own. Rows of the same turn are taken by role and the digest of their text; repeated rows are duplicates. An empty
role has no initial, so such a row can be reroled or deleted, not kept. Texts and conversations of any length are read
whole; an empty table gives an empty one; extra columns of any name are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

START, SYSTEM, USER, ASSISTANT = range(4)
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
#: The role that may follow, by state, for Rerole and Insert.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What is left to insert after the last row, by state: a user turn without its answer needs one, a lone system turn two.
END_PRICE = (0, 2 * COST["I"], COST["I"], 0)
#: Rows that are auctioned together.
BLOCK = 16
DELETE = "d"
_SPACE = r"[ \x09-\x0D]"


def _follows(state: int, initial: str) -> int | None:
    """The state after a row of this initial, or None where it may not stand."""
    role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
    if role == SYSTEM:
        return SYSTEM if state == START else None
    return role if role == NEXT[state] else None


def _arcs(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(label, cost, rows read, next state) of every edit at a row, by label. A row's code is its initial or x, a capital where it is
    truncated, or d where it must go."""
    extra = TRUNCATED_COST if code.isupper() else 0
    out = [("D", COST["D"], 1, state), ("I", COST["I"], 0, NEXT[state])]
    if code != DELETE:
        if (kept := _follows(state, code.lower())) is not None:
            out.append(("K", COST["K"] + extra, 1, kept))
        out.append(("R", COST["R"] + extra, 1, NEXT[state]))
    return out


#: Arcs of each code and state, as offsets from the node's number (four nodes a row).
ARCS = {ord(code): [[(label, cost, 4 * rows + to - state) for label, cost, rows, to in _arcs(code, state)] for state in range(4)] for code in "suaxSUAX" + DELETE}


def auction(codes: bytes, price: array, origin: int, far: int) -> None:
    """Raises prices until the path from ``origin`` has come to node ``far`` or beyond, whose prices are final."""
    path = [origin]
    while path[-1] < far:
        at = path[-1]
        best = None
        for _, cost, step in ARCS[codes[at >> 2]][at & 3]:
            if best is None or cost + price[at + step] < best:
                best, to = cost + price[at + step], at + step
        if price[at] < best:
            price[at] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def trace(codes: bytes, price: array) -> str:
    """Labels of the least path over tight arcs from the start; the last inserts follow."""
    end = 4 * len(codes)
    path, labels, tried = [START], [], [0]
    dead: set[int] = set()  # of the nodes ahead that tight arcs reach and do not lead on from
    while path[-1] < end:
        at = path[-1]
        arcs = ARCS[codes[at >> 2]][at & 3]
        k = tried[-1]
        while k < len(arcs) and (price[at] != arcs[k][1] + price[at + arcs[k][2]] or at + arcs[k][2] in dead):
            k += 1
        if k < len(arcs):
            tried[-1] = k + 1
            path.append(at + arcs[k][2])
            labels.append(arcs[k][0])
            tried.append(0)
        else:
            dead.add(at)
            path.pop()
            tried.pop()
            labels.pop()
    return "".join(labels) + "I" * (END_PRICE[path[-1] & 3] // COST["I"])


def solve(codes: bytes) -> tuple[int, str]:
    """Least cost and the least audit of that cost."""
    n = len(codes)
    price = array("q", bytes(32 * (n + 1)))
    price[4 * n :] = array("q", END_PRICE)
    for low in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        high = min(low + BLOCK, n)
        base = min(price[4 * high : 4 * high + 4])
        price[4 * low : 4 * high] = array("q", [base]) * (4 * (high - low))
        for state in range(4) if low else [START]:
            auction(codes, price, 4 * low + state, 4 * high)
    return price[START], trace(codes, price)


#: Most conversations are short and alike.
_solved = functools.lru_cache(1 << 16)(solve)


def repair(codes: bytes) -> tuple[int, str]:
    return _solved(codes) if len(codes) <= 64 else solve(codes)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_LEGAL = {"su", "ua", "au"}


class Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.fresh = False
        self.before: str | None = None
        self.solution: tuple[int, str] | None = None
        self.at, self.state, self.sent = 0, START, False
        self.hash = hashlib.sha256()

    def row(self, turn: int | None, initial: str, blank: bool, truncated: bool) -> None:
        """A row without its text; the marker of a first occurrence came right before it."""
        if turn is not None:
            self.low, self.high = (turn if self.low is None else self.low), turn  # turns ascend
            self.turns += self.turn != turn
            self.turn = turn
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        first, self.fresh = self.fresh, False
        code = initial if initial in ("s", "u", "a") else "x"
        if blank:
            self.blank += 1
            code = DELETE
        elif not first:
            self.duplicate += 1
            code = DELETE
        elif truncated:
            self.truncated += 1
            code = code.upper()
        self.codes += code.encode()

    def _send(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.sent else "") + role + ":").encode())
        self.hash.update(text.encode())
        self.sent = True

    def _inserts(self) -> None:
        audit = self.solution[1]
        while self.at < len(audit) and audit[self.at] == "I":
            self.state = NEXT[self.state]
            self._send(NAMES[self.state], "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        """A row again, now with its text: it goes into the hash as the audit says."""
        self._solve()
        self._inserts()
        edit = self.solution[1][self.at]
        self.at += 1
        if edit == "K":
            self.state = _follows(self.state, role[:1])
            self._send(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._send(NAMES[self.state], text)

    def _solve(self) -> None:
        if self.solution is None:
            self.solution = repair(bytes(self.codes))

    def result(self) -> tuple:
        self._solve()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.solution, self.hash.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the crc32 of ``conv_id:turn`` picks: dropped, emptied, without end marks, repeated, or by the user."""
    one_space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", one_space(F.col("role")).alias("role"), one_space(F.col("text")).alias("text"))
    pick = F.crc32(F.concat(one_space(F.col("conv_id")), F.lit(":"), one_space(F.col("turn"))).cast("binary")) % 20
    rows = rows.withColumn("pick", pick).where("pick <> 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("pick") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _records(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Every conversation, then its rows without texts behind the markers of first occurrences, then its rows with texts."""

    def as_record(df: DataFrame, stage: int, kind: int, text: Column | None = None) -> DataFrame:
        null = F.lit(None)
        got = lambda c, t: F.col(c) if c in df.columns else null.cast(t).alias(c)
        own = [got("turn", rows.schema["turn"].dataType), got("role", "string"), got("digest", "binary")]
        return df.select("conv_id", F.lit(stage).alias("stage"), *own, F.lit(kind).alias("kind"), got("blank", "boolean"), got("truncated", "boolean"), (null.cast("string") if text is None else text).alias("text"))

    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    seen = rows.select("conv_id", "turn", "role", "digest", (~F.col("text").rlike(r"[^ \x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?]" + _SPACE + r"*\z")).alias("truncated"))
    # nulls come first: a struct orders by its first field, and null as the least of its second
    first = seen.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("at"))
    first = first.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest")
    known = conversations.select("conv_id").distinct()
    parts = [as_record(known, 0, 0), as_record(first, 1, 0), as_record(seen, 1, 1), as_record(rows, 2, 0, F.col("text"))]
    return functools.reduce(DataFrame.unionByName, parts)


def repaired(conversations: DataFrame) -> DataFrame:
    """A row for each ``conv_id``: faults after the damage, cost and audit of the cheapest repair, hash of the repaired conversation."""
    conversations = common.only(conversations, "conv_id", "turn", "role", "text")
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    records = _records(conversations, damaged(conversations)).repartition("conv_id").sortWithinPartitions("conv_id", "stage", "turn", "role", "digest", "kind")
    schema = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            columns = (batch.column(c) for c in ("conv_id", "stage", "turn", "role", "kind", "blank", "truncated", "text"))
            for conv_id, stage, turn, role, kind, blank, truncated, text in zip(*(c.to_pylist() for c in columns), strict=True):
                if stage == 0:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                elif stage == 2:
                    now.text(role, text)
                elif kind == 0:
                    now.fresh = True
                else:
                    now.row(turn, role[:1], blank, truncated)
            if done:
                yield _batch(done, batch.schema.field("conv_id").type)
        if now is not None:
            yield _batch([now.result()], batch.schema.field("conv_id").type)

    return records.mapInArrow(run, schema)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *RESULT])


_NEXT_SQL = "CASE {0} WHEN 2 THEN 3 ELSE 2 END"
_CRC_SQL = "xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
#: DuckDB SQL for ``repaired``: the least (cost, audit) of each state is carried forward row by row, with what is kept of the texts.
ORACLE_SQL = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_SQL.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS pick FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role, CASE pick WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN pick = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE pick <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, i > min(i) OVER (PARTITION BY conv_id, role, text) AS is_copy, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS is_cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o),
r AS (SELECT conv_id, i, role, text, NOT (is_blank OR is_copy) AS may_stay, CASE WHEN is_cut AND NOT (is_blank OR is_copy) THEN 1 ELSE 0 END AS extra, CASE substr(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 END AS own FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, unnest([0, 2, 3]) AS st, unnest(['00000000', '00000002I', '00000004II']) AS k, unnest([NULL, 'user:', 'user:' || chr(10) || 'assistant:']) AS out FROM ids
    UNION ALL
    SELECT conv_id, i, st, min(k), arg_min(out, k) FROM (
        SELECT conv_id, i, CASE ins WHEN 0 THEN st WHEN 1 THEN {_NEXT_SQL.format('st')} ELSE {_NEXT_SQL.format('(' + _NEXT_SQL.format('st') + ')')} END AS st,
            lpad(CAST(cost + {COST['I']} * ins AS VARCHAR), 8, '0') || audit || repeat('I', ins) AS k,
            CASE WHEN ins = 0 THEN out ELSE coalesce(out || chr(10), '') || CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN ins = 2 THEN chr(10) || CASE st WHEN 2 THEN 'user:' ELSE 'assistant:' END ELSE '' END END AS out
        FROM (SELECT *, unnest([0, 1, 2]) AS ins FROM (
            SELECT conv_id, i, CASE op WHEN 'D' THEN st WHEN 'K' THEN own ELSE {_NEXT_SQL.format('st')} END AS st,
                CAST(substr(k, 1, 8) AS BIGINT) + CASE op WHEN 'D' THEN {COST['D']} WHEN 'K' THEN extra ELSE {COST['R']} + extra END AS cost, substr(k, 9) || op AS audit,
                CASE WHEN op = 'D' THEN out ELSE coalesce(out || chr(10), '') || CASE WHEN op = 'K' THEN role WHEN st = 2 THEN 'assistant' ELSE 'user' END || ':' || text END AS out
            FROM (SELECT dp.conv_id, r.i, dp.st, dp.k, dp.out, r.role, r.text, r.may_stay, r.extra, r.own, unnest(['D', 'K', 'R']) AS op FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)
            WHERE op = 'D' OR may_stay AND (op = 'R' OR own = 1 AND st = 0 OR own > 1 AND own = {_NEXT_SQL.format('st')})))) GROUP BY conv_id, i, st),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND is_copy) AS duplicate,
    count(*) FILTER (NOT is_blank AND NOT is_copy AND is_cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM f GROUP BY conv_id),
e AS (SELECT dp.conv_id, min(k) AS k, arg_min(out, k) AS out FROM dp JOIN ids ON dp.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.st IN (0, 3) AND dp.i = coalesce(n.rows, 0) GROUP BY dp.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(substr(k, 1, 8) AS BIGINT) AS cost, substr(k, 9) AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""
