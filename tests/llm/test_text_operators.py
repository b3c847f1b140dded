"""Text operators against brute force, round trips and held-out accuracy, with the edge cases of each."""

import hashlib
import html
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import (
    common,
    cross_entropy,
    decontaminate,
    html_extraction,
    html_tree,
    importance_resampling,
    near_dedup,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    training_order,
    url_filters,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n\t ", None, "s", 4), (None, "odd é ﬀ 字 \x1f words", "en", None, None), (903, "one", "en", "s", 3), (903, "one", "en", "s", 3)]


def words(rng, n, syllables=("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")):
    return [("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# shared helpers


def test_word_hashes_agree_with_strings():
    texts = ["a bb  ccc", "", None, "bb\n a", "é x" * 1000]
    w = common.split_words(pa.array(texts))
    h = w.hashes()
    plain = [re.findall("[^ \t-\r]+", t or "") for t in texts]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    seen = {}
    for x, y in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    s, first = common.shingles(w, h)
    assert np.diff(first).tolist() == [0 if not p else max(1, len(p) - 4) for p in plain]
    assert len(s) == first[-1]


# 5


def brute_base(text):
    w = re.findall("[^ \t-\r]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        dup += line in seen and bool(re.search("[^ \t-\r]", line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_rules(spark, edge, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 80 + i))) for i in range(60)]
    rows += [(100, "a b c " * 40), (101, "x\ny\nx\n\n\nx"), (102, " ".join(x.upper() + "!!" for x in words(rng, 400))), (103, " ".join(x + "%%%" for x in words(rng, 400)))]
    docs = docs_of(spark, rows).unionByName(edge).withColumn("kept_", F.lit(1))
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows) + len(EDGE)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= set(range(60)) and not kept & {100, 101, 102, 103, 900, 901, 903}
    assert quality_rules.quality_rules(empty).count() == 0


# 4


def test_codec_matches_sentencepiece(spark, edge, empty):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=f"{sentencepiece_codec.TOKENIZERS}/piece_bpe_32k.model")
    texts = ["plain words here", "  two  spaces ", "tail   ", "a\n\tb  c", "字 é ﬀ \x00", "x" * 3000, "<s> <0x0A> ▁ ▁▁a", " ", "    "]
    docs = docs_of(spark, list(enumerate(texts))).unionByName(edge)
    rows = sentencepiece_codec.encode(docs).collect()
    assert len(rows) == len(texts) + len(EDGE)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode(r.text or ""), r.text
        assert r.parity and r.n_tokens == len(r.ids) // 4
    clean = [r for r in rows if "▁" not in (r.text or "")]
    assert all(r.round_trip for r in clean)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs).select("doc_id", "text", "ids")).collect()
    assert all(r.decoded == (r.text or "") for r in back if "▁" not in (r.text or ""))
    assert sentencepiece_codec.encode(empty).count() == 0


def test_parsed_model():
    spec = sentencepiece_codec.parse_model(sentencepiece_codec.read_model(f"{sentencepiece_codec.TOKENIZERS}/piece_bpe_32k.model"))
    assert len(spec.pieces) == 32000 and spec.model_type == 2 and spec.byte_fallback and spec.splits
    unigram = sentencepiece_codec.Spec(pieces=[("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.0, 1), ("▁a", -0.5, 1)], remove_extra_spaces=False)
    assert sentencepiece_codec.build_tokenizer(unigram).encode("a a", add_special_tokens=False).tokens == ["▁a", "▁a"]


def test_distinct_chunks_are_encoded_in_groups():
    raw = sentencepiece_codec.read_model(f"{sentencepiece_codec.TOKENIZERS}/piece_bpe_32k.model")
    rng = random.Random(4)
    letters = "abcdefgé字\n\t\u00a0\x00<>0A"
    plain = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(500)) for _ in range(8)]
    odd = ["", " ", "  a", "a  b ", "▁", "a▁b c", "▁▁a  ▁", "<s> <0x20> </s> <unk>", "a\u2028b \u3000 c", "\n \n", "x" * 3000]
    asked = []

    class Counting:
        def __init__(self, tok):
            self.tok, self.decode_batch = tok, tok.decode_batch

        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return self.tok.encode_batch_fast(texts, **more)

    def made(c, *batches):
        return [row for batch in batches for row in zip(*(column.to_pylist() for column in c.encode(batch)), strict=True)]

    c = sentencepiece_codec.Codec(raw)
    tok, c.tok = c.tok, Counting(c.tok)
    want = made(c, plain)
    assert 0 < sum(asked) <= len({w for t in plain for w in t.split(" ")}) // 100
    for text, (ids, n, n_bytes, parity, back) in zip(plain + odd, want + made(c, odd), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == c.other.encode(text) and n == len(ids) and parity and back == ("▁" not in text)
        assert n_bytes == sum(tok.id_to_token(i).startswith("<0x") for i in ids)
    for change in ({"joins": False}, {"is_marked": np.zeros_like(c.is_marked)}, {"size": 10}, {"size": 0}):
        other = sentencepiece_codec.Codec(raw)
        vars(other).update(change)
        assert made(other, plain[:5], odd, plain[3:], []) == want[:5] + made(c, odd) + want[3:]
        assert len(other.index) == len(other.known.parity) <= other.size
    other.other.encode = lambda chunks, **more: [[5] if x == "bad" else c.other.encode(x) for x in chunks]
    assert [r[3] for r in made(other, ["good", "a bad one", "good one"])] == [True, False, True]


# 7


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), "assign", m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], order[x[1]])))


def test_secret_scan(spark, edge, empty):
    rng = random.Random(2)
    bits = ['password = "hunter22"', "Token:abc", "token=token:abcdefgh", "api_key='x.y-z_9='", "APIKEY == deadbeefdeadbeefdeadbeef00", "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "0123456789abcdef01234567", "ſecret=longvalue", "é secret: zzzzzz", "paſſword=abcdef"]
    rows = [(i, " ".join(rng.sample(bits, 4))) for i in range(40)] + [(50, "the bearer token is q8Zk3LmPx72VbTnR4sWd0fYh and so on"), (51, "the word token means tionthinghatienrethand here"), (52, "token " * 3000)]
    got = secret_scan.scan(docs_of(spark, rows).unionByName(edge), redact=True).withColumn("all", secret_scan.spans_string()).collect()
    for r in got:
        base = brute_secrets(r.text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(r.all.split(","))
        assert (r.redacted_text is None) == (r.text is None)
        assert r.text is None or not brute_secrets(r.redacted_text)
    by_id = {r.doc_id: r for r in got}
    assert by_id[50].all == "novel:20:44" and by_id[51].all == "" and by_id[52].all == ""
    assert secret_scan.scan(empty).count() == 0


# 3


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.EXAMPLE.org/en/12?x#y", "https://example.org/en/2", "https://a.com/de/1", "https://a.com/fr/1", "https://notorg/x", "x://h?q", "x://h#f", "x://", "https://xexample.org/es/", "https://example.org/es", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    got = {r.page_id: r for r in url_filters.url_filter(pages).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert [got[i].rule for i in (4, 5, 6, 7, 11, 12)] == ["org/", "com/de/", "com/fr/", None, "org/", "org/"]
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (0, 1, 2, 8, 9, 10, 13)] == [("", "", "allow")] * 3 + [("h", "", "allow"), ("h", "", "allow"), ("", "", "allow"), ("b:", "//c/d", "allow")]
    assert url_filters.url_filter(pages.limit(0)).count() == 0
    rows = [(i, f"https://x.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120)] + [(0, 0)], "page_id long, bad int")
    out = url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in out)
    # a template without labels is judged by its host's, smoothed; deep paths are read whole
    deep = "/".join(["a"] * 300)
    urls = [f"https://b.com/de/{i}" for i in range(30)] + [f"https://c.com/{x}/{i}" for x in ("de", "fr") for i in range(30)] + ["https://b.com/en/1", f"https://b.com/en/{deep}/x", "https://c.com/en/1", f"https://c.com/en/{deep}/y", "https://d.com/en/1"]
    out = {r.url: (r.rule, r.verdict) for r in url_filters.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    assert [out[u] for u in urls[-5:]] == [(None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert out["https://b.com/de/3"] == ("com/de/", "block") and out["https://c.com/fr/3"] == ("com/fr/", "allow")


# 8


def test_html_blocks_and_accuracy(spark):
    page = '<html><head><title>t</title><script>var a="</p><p>x";</script></head><body><nav><a href="/">menu</a></nav><article><h1>A &amp; B</h1><p>one  two<br>three<p>four &eacute;</p></article><footer>f</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<" * 500), (5, "u", "<p>" * 3000)], "page_id long, url string, html string").withColumn("title", F.lit("x"))
    made = [html_extraction._made_page(random.Random(i), ["the and of re. words in a row, and more of them; for a while. "]) for i in range(3)]
    model = html_extraction.train(made, made=300)
    got = [tuple(r) for r in html_extraction.extract(rows, keep=["page_id", "url"], model=model).collect()]
    want = "A & B\n\none two three\n\nfour é"
    assert got.count((1, "u", want, len(want))) == 2
    assert (2, None, "", 0) in got and (3, "u", "", 0) in got and len(got) == 6
    rng, scores = random.Random(77), []
    for _ in range(150):
        p = html_tree.read(html_extraction._made_page(rng, ["other text than in training, which has its own words. it goes on."]))
        truth = html_extraction._spread(p, p.truth)
        main = html_extraction.decode(p, model.margins([p])[0])
        a, b = ({i for i, (o, _) in enumerate(p.runs) if x[o]} for x in (main, truth))
        scores.append(2 * len(a & b) / max(1, len(a) + len(b)))
        assert all(not m or p.parent[i] < 0 or main[p.parent[i]] for i, m in enumerate(main))
    assert np.mean(scores) > 0.85
    assert html_extraction.extract(rows.limit(0), model=model).count() == 0
    assert html.unescape("&eacute;") == "é"


# 2


def test_near_duplicates(spark, edge, empty):
    rng = random.Random(4)
    base = [words(rng, 120) for _ in range(12)]
    rows = []
    for i, w in enumerate(base):
        rows.append((10 * i, " ".join(w)))
        rows.append((10 * i + 1, " ".join(w)))
        edited = w[:]
        edited[60] = "changed"
        rows.append((10 * i + 2, " ".join(edited)))
        rows.append((10 * i + 3, " ".join(w[:40] + words(rng, 80))))
    docs = docs_of(spark, rows).unionByName(edge)
    got = near_dedup.near_duplicates(docs.withColumn("node", F.lit(1))).collect()
    assert len(got) == len(rows) + len(EDGE)
    cls = {r.doc_id: r.class_id for r in got}
    for i in range(12):
        assert cls[10 * i] == cls[10 * i + 1] == cls[10 * i + 2] == 10 * i
        assert cls[10 * i + 3] == 10 * i + 3
    assert cls[900] == cls[901] == 900 and cls[903] == 903
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in near_dedup.deduplicate(docs).select("doc_id").collect())
    ids = [i for none, i in kept if not none]
    assert ids == [x for i in range(12) for x in (10 * i, 10 * i + 3)] + [900, 903] and len(kept) == len(ids) + 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = np.sort(rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64))
    w = rng.uniform(0.5, 2, 400)
    a, b = slice(0, 300), slice(100, 400)
    s = near_dedup.Sampler(bands=600, rows=1)
    keys = s.band_keys(np.concatenate([e[a], e[b]]), np.concatenate([w[a], w[b]]), np.array([0, 300, 600]))
    exact = near_dedup.similarity((e[a], w[a]), (e[b], w[b]))
    assert abs((keys[0] == keys[1]).mean() - exact) < 0.07


def test_components(spark):
    pair = lambda a, b: ((a, 0), (b, 0))
    links = spark.createDataFrame([pair(i, i + 1) for i in range(9)] + [pair(20, 21)], "pivot struct<a:long,b:long>, node struct<a:long,b:long>")
    assert {r.node.a: r.comp.a for r in near_dedup.components(links).collect()} == {**{i: 0 for i in range(10)}, 20: 20, 21: 20}


def test_near_duplicates_of_derivation_chains(spark):
    """Texts derived from earlier ones, against all pairs of every bucket."""
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        family = [words(rng, 120)]
        while len(family) < 150:
            new = list(rng.choice(family))
            for _ in range(rng.randint(1, 3)):
                new[rng.randrange(len(new))] = f"x{rng.getrandbits(30)}"
            family.append(new)
        texts += [" ".join(t) for t in family]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = near_dedup.damped_idf(near_dedup.document_frequency(docs))
    e, w, first = near_dedup.weighted_shingles(pa.array(texts), idf)
    vectors = [(e[a:b], w[a:b]) for a, b in zip(first[:-1], first[1:])]
    buckets = {}
    for i, keys in enumerate(near_dedup.Sampler().band_keys(e, w, first).tolist()):
        for k in keys:
            buckets.setdefault(k, []).append(i)
    least = list(range(len(texts)))
    for a, b in {(a, b) for m in buckets.values() for a in m for b in m if a < b}:
        if least[a] != least[b] and near_dedup.similarity(vectors[a], vectors[b]) >= near_dedup.THRESHOLD:
            lo, hi = sorted((least[a], least[b]))
            least = [lo if x == hi else x for x in least]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(least))


# 9


def test_decontamination(spark, edge, empty):
    rng = random.Random(6)
    item = "If Anna has 12 apples and gives 5 apples to Bob then how many apples does Anna still have after 3 days of walking home"
    other = " ".join(words(rng, 30))
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, "tiny one here"), (4, None), (5, "")], "item_id long, text string")
    noise = " ".join(words(rng, 40))
    swapped = item.replace("12", "40").replace("5 ", "9 ").replace("3 days", "8 days").replace("Anna", "Clara").replace("Bob", "Eve")
    mixed = "If Anna has 12 apples and gives 5 apples to Bob then how many apples does Zed still have after 3 days of walking home"
    rows = [(1, f"{noise} {item} {noise}"), (2, noise), (3, f"{noise}. {swapped} {noise}"), (4, other), (5, other[: len(other) // 4]), (6, f"{noise}\ntiny one here {noise}")]
    found = {(r.doc_id, r.item_id): r.consistency for r in decontaminate.leaks(docs_of(spark, [*rows, *rows[:1]]).unionByName(edge), benchmark).collect()}
    assert set(found) == {(1, 1), (3, 1), (4, 2), (6, 3)} and found[3, 1] == 1.0
    cased = [(20, f"{noise} {item.upper()} {noise}"), (21, f"{noise} {other.title()} {noise}"), (22, f"{noise} " + " ".join(x for i, x in enumerate(other.split()) if i != 14) + f" {noise}"), (23, f"{noise} {item.replace('Anna', 'Anna Maria Lee')} {noise}"), (24, f"{noise} {item.upper().replace('APPLES', 'X')}"), (25, " ".join(["Anna has 12 apples"] * 5000))]
    hits = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, cased), benchmark).collect()}
    assert hits == {(20, 1), (21, 2), (22, 2), (23, 1)}
    low = {r.doc_id: r.consistency for r in decontaminate.leaks(docs_of(spark, [(1, mixed)]), benchmark).collect()}
    assert low.get(1, 0) < 1.0
    kept = decontaminate.decontaminate(docs_of(spark, rows).unionByName(edge), benchmark)
    assert kept.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 5, 900, 901, 902, 903, 903]
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(edge, benchmark.limit(0)).count() == 0


# 1 and 10


@pytest.fixture(scope="module")
def two_kinds(spark):
    rng = random.Random(8)
    good = [(i, " ".join(words(rng, 100))) for i in range(80)]
    bad = [(100 + i, " ".join(words(rng, 100, ("zz", "qq", "xx", "vv")))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(100 + i, 0, 0) for i in range(0, 20, 2)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    return docs_of(spark, good + bad), labels


def test_importance_resampling(spark, two_kinds, edge, empty):
    docs, labels = two_kinds
    got = importance_resampling.resample(docs.unionByName(edge), labels).collect()
    assert len(got) == 106
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i in range(80)} <= kept and len(kept & set(range(100, 120))) <= 8 and not kept & {900, 901, 902}
    assert importance_resampling.resample(empty, labels).count() == 0
    none = importance_resampling.resample(docs, labels.limit(0), k=10).collect()
    assert sum(r.kept for r in none) == 10 and all(r.log_weight == 0 for r in none)


def test_kth_largest(spark):
    rng = random.Random(9)
    x = [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    for k in (1, 7, 250, 499, 500, 900):
        assert importance_resampling.kth_largest(df, "x", k, bins=8) == sorted(x, reverse=True)[min(k, 500) - 1]
    assert importance_resampling.kth_largest(df, "x", 0) is None


def test_cross_entropy(spark, two_kinds, edge, empty):
    docs, labels = two_kinds
    got = {r.doc_id: r for r in cross_entropy.score(docs.unionByName(edge), labels).collect()}
    assert max(got[i].loss_difference for i in range(80)) < min(got[i].loss_difference for i in range(100, 120))
    assert got[900].loss_difference is None and got[900].n_tokens == 0 and got[903].n_tokens == 1
    assert cross_entropy.score(empty, labels).count() == 0
    assert all(r.loss_difference == 0 for r in cross_entropy.score(docs, labels.limit(0)).collect())


def test_cross_entropy_counts_are_exact(spark):
    """Against plain counters, over more words than hashed slots keep apart."""
    rng = random.Random(7)
    rare = [f"w{rng.getrandbits(40):x}" for _ in range(12_000)]
    texts = [" ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.3 else rare[int(rng.random() ** 3 * len(rare))] for _ in range(rng.randint(1, 200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    good = {i for i in range(300) if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(300)], "doc_id long, quality int")
    tokens = {i: [*t.split(), "|"] for i, t in enumerate(texts)}
    uni, bi = ([Counter(), Counter()] for _ in range(2))
    for i, ws in tokens.items():
        for m in (0, 1) if i in good else (0,):
            uni[m].update(ws)
            bi[m].update(zip(["|", *ws], ws))
    n, s = [c.total() for c in uni], cross_entropy.SMOOTHING
    share = [{w: uni[0][w] / n[0] for w in uni[0]}]
    share.append({w: (uni[1][w] + cross_entropy.WORD_SMOOTHING * share[0][w]) / (n[1] + cross_entropy.WORD_SMOOTHING) for w in uni[0]})

    def loss(m, ws):
        scale = n[1] / n[m]
        return sum(-np.log((bi[m][c, w] * scale + s * share[m][w]) / (uni[m][c] * scale + s)) for c, w in zip(["|", *ws], ws)) / len(ws)

    got = {r.doc_id: r for r in cross_entropy.score(docs, labels).collect()}
    assert len(got) == 300
    for i, ws in tokens.items():
        assert got[i].n_tokens == len(ws) - 1
        assert got[i].target_loss == pytest.approx(loss(1, ws), abs=1e-9) and got[i].background_loss == pytest.approx(loss(0, ws), abs=1e-9)


# 6


def test_permutation():
    for n in (1, 2, 5, 64, 1000, 4097):
        for key in (1, 2**70 + 3):
            got = training_order.permuted(np.arange(n), n, key)
            assert sorted(got.tolist()) == list(range(n))
            assert training_order.unpermuted(got, n, key).tolist() == list(range(n))
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()


def test_training_order(spark, edge, empty):
    import os

    import tiktoken

    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randint(1, 60))) for _ in range(50)] + ["a  b   c\n d", " lead", "tail ", "x\n\n y"]
    docs = docs_of(spark, list(enumerate(texts))).unionByName(edge)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    docs = common.written(docs, "docs")  # its order is fixed now
    shards, total = training_order.materialise(docs, path, length=16, shard_records=8, key=5)
    shards = shards.orderBy("shard").collect()
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    assert len(files) == len(shards)
    raw = b"".join(open(f"{path}/{f}", "rb").read() for f in files)
    stride = 2 * 16 + 1
    n = sum(s.n_records for s in shards)
    assert len(raw) == n * stride
    rows, m, _ = training_order.sequences(docs, 16, 8, 5)
    by_slot = {r.slot: r for r in rows.collect()}
    back = {r.slot: r for r in training_order.read_shards(spark, path, total, 16, 8, 5).collect()}
    assert {s: (r.shard, r.seq, r.n_tokens, bytes(r.ids)) for s, r in back.items()} == {s: (r.shard, r.seq, r.n_tokens, bytes(r.ids)) for s, r in by_slot.items()}
    assert all(r.slot == 8 * r.shard + r.record for r in back.values())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # other splits, the same order
    try:
        again = training_order.sequences(spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0]), 16, 8, 5)[0].collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.slot: bytes(r.ids) for r in again} == {s: bytes(r.ids) for s, r in by_slot.items()}
    assert training_order.sequences(docs_of(spark, [(1, "long " * 40_000)]), 16, 8, 5)[1] == -(-40_001 // 16)
    assert m == n and sorted(by_slot) == list(range(n)) and sorted(r.seq for r in by_slot.values()) == list(range(n))
    assert sorted(raw[i * stride : i * stride + 32] for i in range(n)) == sorted(bytes(r.ids) for r in by_slot.values())
    cache = training_order._cache(training_order.read_model(f"{training_order.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    assert isinstance(tiktoken.__version__, str)
    every = [t for t in [*texts, *(e[1] for e in EDGE)] if t]
    for t in every:
        assert np.frombuffer(cache(t), "<u2").tolist() == cache.encode(t)
    stream = b"".join(bytes(by_slot[s].ids)[: 2 * by_slot[s].n_tokens] for s in sorted(by_slot, key=lambda s: by_slot[s].seq))
    docs_back = [x for x in np.split(np.frombuffer(stream, "<u2"), np.flatnonzero(np.frombuffer(stream, "<u2") == training_order.END_MARK) + 1) if len(x)]
    assert sorted(tuple(x[:-1]) for x in docs_back) == sorted(tuple(cache.encode(t)) for t in every)
    assert training_order.sequences(empty)[0].count() == 0


# pipeline


def test_pipeline_against_brute_force(spark):
    rng = random.Random(12)
    base = [" ".join(words(rng, 120)) for _ in range(40)]
    leaked = " ".join(words(rng, 30))
    rows = [(i, t) for i, t in enumerate(base)] + [(100, base[0]), (101, base[1].replace(" th ", " tha ", 1)), (102, "short"), (103, None), (104, base[2] + " " + leaked + " " + " ".join(words(rng, 90))), (105, " ".join(words(rng, 100)) + " password = s3cr3tvalue9")]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs_of(spark, rows).withColumn("n_words", F.lit(-1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")] + ["n_words"]
        docs = common.written(docs, name)
        names.append(sorted(r.doc_id for r in docs.collect()))
    quality, dedup, bench, secrets = names
    assert quality == [*range(40), 100, 101, 104, 105]
    assert dedup == [*range(40), 104, 105] and bench == [*range(40), 105] and secrets == bench
    row = docs.where("doc_id = 105").first()
    assert "s3cr3t" not in row.text and row.n_chars == len(row.text)
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in out) == secrets and all(r.parity and r.round_trip for r in out)
