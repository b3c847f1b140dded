"""Token counts against the library, conversation repair and vector codes against brute force, with the edge cases of each."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import conversation_repair, token_counts, vector_codes

TOKENIZER = f"{token_counts.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_tokenizer(TOKENIZER))


# op11


def test_counts_equal_the_library(counter, library):
    rng = random.Random(1)
    pieces = ["a", "b", "'s", " ", "  ", "\n", "<|endoftext|>", "é", "中", "12", "՘", "!", "\t", "\U0001f600", "th", "e", "'ll", "\x1c", "\x85", " ", "ﬀ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(2000)) for _ in range(10)]
    assert counter.count(texts) == library(texts)


def test_every_character_is_cut_as_by_the_library(counter, library):
    """Each code point beside letters, digits, signs and space: the library's Unicode version counts."""
    codes = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}  {chr(c)}" for c in codes[i : i + 512]) for i in range(0, len(codes), 512)]
    assert counter.count(texts) == library(texts)


def test_long_runs_without_a_cut(counter, library):
    rng = random.Random(2)
    texts = [" " * 5000, "a" * 5001, "=" * 999, "ab" * 3000 + " x", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "é" * 4000, "\n" * 70_000]
    assert counter.count(texts) == library(texts)


def test_ways_of_merging_agree(counter):
    rng = random.Random(3)
    raws = ["".join(rng.choice("abcdeth s") for _ in range(rng.randrange(1, 300))).encode() for _ in range(300)]
    m = counter.merges
    symbols = m.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
    together = token_counts.merge_short(m, symbols, np.array([len(r) for r in raws]))
    assert together.tolist() == [token_counts.merge_long(m, m.byte_ids[np.frombuffer(r, np.uint8)]) for r in raws]


def test_a_text_longer_than_a_piece_and_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECES", 100)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 500)
    monkeypatch.setattr(token_counts, "KEPT", 50)
    small = token_counts.Counter(token_counts.read_tokenizer(TOKENIZER))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (5000, 3, 0, 700, 99)]
    assert small.count(texts) == library(texts) and len(small.known) <= 50


def test_count_tokens_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "one two", "z"), (3, "one two", "z"), (None, "é" * 3, "w"), (5, "word " * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string").withColumn("TEXT_", F.lit(1))
    got = token_counts.count_tokens(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]), strict=True))
    assert token_counts.count_tokens(df.limit(0)).count() == 0
    assert token_counts.count_tokens(df, keep=["doc_id"]).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    with pytest.raises(ValueError):
        token_counts.Merges((token_counts.read_tokenizer(f"{token_counts.TOKENIZERS}/word_bpe_49k.json")))


# op12

STEP = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows, kinds):
    """(cost, audit, repaired) by carrying the least (cost, audit) of each state forward."""

    def inserted(states):
        for _ in range(4):
            for state, (cost, audit, out) in list(states.items()):
                n = STEP[state]
                new = (cost + 2, audit + "I", (*out, (NAMES[n], "")))
                if n not in states or new[:2] < states[n][:2]:
                    states[n] = new
        return states

    states = inserted({"": (0, "", ())})
    for (role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for state, (cost, audit, out) in states.items():
            moves = [(3, "D", state, out)]
            if kind != "must go":
                extra, n, own = kind == "cut", STEP[state], role[:1]
                moves.append((2 + extra, "R", n, (*out, (NAMES[n], text))))
                if own == "s" and state == "" or own and own == n:
                    moves.append((0 + extra, "K", own, (*out, (role, text))))
            for price, label, n, kept in moves:
                new = (cost + price, audit + label, kept)
                if n not in after or new[:2] < after[n][:2]:
                    after[n] = new
        states = inserted(after)
    return min((v for s, v in states.items() if s in ("", "a")), key=lambda v: v[:2])


def brute_repair(rows):
    conv = defaultdict(list)
    spaced = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        own = conv[conv_id]
        pick = zlib.crc32(f"{spaced(conv_id)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        own += [(turn, "user" if pick == 4 else role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)
    out = []
    for conv_id, own in conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, kinds, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = re.sub("[ \t-\r]", "", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append("" if fault is None else ("must go", "must go", "cut")[fault])
            if fault is not None:
                faults[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = cheapest([r[1:] for r in own], kinds)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((str(conv_id), gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out)


def repaired(df):
    return sorted((str(r[0]), *r[1:]) for r in conversation_repair.repaired(df).collect())


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", None, "tool", "", "User"], [None, "", "a.", "b?", "no end", " \n", "c! ", "d. ", "long. " * 50, "é ", "."]
    rows = [(rng.choice([None, *range(1, 30)]), rng.choice([None, *range(11)]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    rows += [(50, i, "user", f"x{i % 3}.") for i in range(100)] + [(51, i, rng.choice(["user", "assistant"]), f"t{i}{rng.choice(['.', ''])}") for i in range(400)]
    rows += [(52, 1, "user", "same.")] * 30 + [(53, None, None, None)] + [(54, i, "user" if i % 2 == 0 else "assistant", "very long " * 30_000 + f"{i}.") for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Role_", F.lit(1)).withColumn("kind", F.lit("x"))
    assert repaired(df.repartition(5)) == brute_repair(rows)
    assert repaired(df.limit(0)) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string")) == [(str(dropped), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_auction_against_all_edit_sequences():
    """Every conversation of up to three rows, every sequence of edits with up to two inserts at a place."""
    follows = lambda state, c: {"s": "s" if state == "" else None, "u": "u" if STEP[state] == "u" else None, "a": "a" if STEP[state] == "a" else None}.get(c)
    for size in range(4):
        for codes in itertools.product("suaxUd", repeat=size):
            best = None
            for edits in itertools.product("DKR", repeat=size):
                for inserts in itertools.product(range(3), repeat=size + 1):
                    state, cost, audit = "", 0, ""
                    for i in range(size + 1):
                        for _ in range(inserts[i]):
                            state, cost, audit = STEP[state], cost + 2, audit + "I"
                        if i == size:
                            break
                        audit += edits[i]
                        if edits[i] == "D":
                            cost += 3
                            continue
                        state = None if codes[i] == "d" else STEP[state] if edits[i] == "R" else follows(state, codes[i].lower())
                        if state is None:
                            break
                        cost += codes[i].isupper() + 2 * (edits[i] == "R")
                    if state in ("", "a") and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            assert conversation_repair.solve("".join(codes).encode()) == best


def test_auction_of_long_conversations():
    rng = random.Random(6)
    for n in (15, 16, 17, 33, 64, 300):
        codes = "".join(rng.choice("uauauauaususUAdx") for _ in range(n))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "t") for c in codes]
        kinds = ["must go" if c == "d" else "cut" if c.isupper() else "" for c in codes]
        assert conversation_repair.solve(codes.encode()) == cheapest(rows, kinds)[:2]


# op13


def brute_codes(rows, positions=16, entries=64, rounds=2):
    kept = [(v, [math.floor(256 * x) for x in e], l, e) for v, e, l in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    w = len(kept[0][1]) // positions
    cut = [[r[1][p * w : (p + 1) * w] for p in range(positions)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(positions)]

    def assigned():
        out = []
        for c in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(c[p], entry, strict=True)), k) for k, entry in enumerate(books[p])) for p in range(positions)]
            out.append(([k for _, k in near], sum(d for d, _ in near)))
        return out

    for _ in range(rounds):
        now = assigned()
        for p in range(positions):
            for k in range(len(books[p])):
                own = [c[p] for c, (ks, _) in zip(cut, now, strict=True) if ks[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    done = assigned()
    by_label = defaultdict(int)
    for r, (_, error) in zip(kept, done, strict=True):
        by_label[r[2]] += error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    most = 2**63 - 1
    return sorted((str(r[0]), "".join(f"{k:02x}" for k in ks), min(error, most), min(by_label[r[2]], most), sha) for r, (ks, error) in zip(kept, done, strict=True))


def coded(df):
    return sorted((str(r[0]), *r[1:]) for r in vector_codes.codes(df).collect())


def test_codes_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(200)]
    rows += [(300 + i, rows[0][1], 5) for i in range(100)]  # a hot vector, a hot label
    rows += [(None, rows[3][1], 1), (3, rows[4][1], 1), (3, rows[3][1], 1), rows[7], rows[7]]
    bad = [(400, None, 1), (401, [1.0, None] * 16, 2), (402, [float("nan")] * 32, 1), (403, [float("-inf")] * 32, 1), (404, [1.0] * 16, 1), (405, [], 1)]
    kind = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows + bad, kind).withColumn("Label_", F.lit(1)).withColumn("error", F.lit("x"))
    want = brute_codes(rows)
    assert coded(df.repartition(5)) == want and coded(df.coalesce(1)) == want
    few = spark.createDataFrame(rows[:9], kind)
    assert coded(few) == brute_codes(rows[:9])
    assert coded(df.limit(0)) == []


def test_codes_of_numbers_beyond_64_bits(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), [rng.choice([1e6, 1.5, -2.25, 3e20, -1e30, 0.001]) for _ in range(32)], rng.choice([None, 1])) for _ in range(80)]
    got, want = coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)), brute_codes(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]


def test_nearest_in_each_arithmetic():
    rng = np.random.default_rng(9)
    for scale in (100, 1 << 24, 1 << 29, 1 << 40):
        parts, book = (rng.integers(-scale, scale, (n, 4)) for n in (50, 20))
        book[7] = book[3]
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(book)) for p in parts]
        at, error = vector_codes.nearest(parts, book)
        assert [(int(e), int(k)) for k, e in zip(at, error, strict=True)] == want
