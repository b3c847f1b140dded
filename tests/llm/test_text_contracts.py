"""What text operators must find or keep: planted secrets, pages without markup, filtered tables, clashing names, brute-force weights and bands."""

import random
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import conversation_repair, cross_entropy, decontaminate, html_extraction, html_tree, importance_resampling, near_dedup, quality_rules, secret_scan, sentencepiece_codec, token_counts, training_order, url_filters, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GIVEN = "/root/testdata/sf0.01"


def given(table, column, n=None):
    return [t or "" for t in pq.read_table(f"{GIVEN}/{table}.parquet", columns=[column]).column(column).to_pylist()][:n]


# op7


@pytest.mark.parametrize(
    "alphabet,size",
    [("abcdefghijklmnopqrstuvwxyz", 24), ("abcdefghijklmnopqrstuvwxyz", 40), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 32), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 32), ("abcdefghijklmnopqrstuvwxyz0123456789", 24), ("0123456789", 24), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 40)],
)
def test_planted_secrets_are_found(alphabet, size):
    """Random strings of each kind in given documents: nine of ten or more are reported, letters of one case as well."""
    rng, novelty, texts = random.Random(size), secret_scan.Novelty(), given("documents", "text")
    found = 0
    for _ in range(50):
        text = rng.choice(texts)[:3000]
        at = rng.randrange(len(text) + 1)
        secret = "".join(rng.choice(alphabet) for _ in range(size))
        whole = f"{text[:at]} the bearer token is {secret} and {text[at:]}"
        start = at + len(" the bearer token is ")
        found += any(s <= start and e >= start + size for s, e, _ in secret_scan.all_spans(whole, novelty)[1])
    assert found >= 45


def test_words_are_no_secrets():
    """Words of the given documents, and long compounds, after a sensitive word."""
    rng, novelty = random.Random(3), secret_scan.Novelty()
    words = [w for t in given("documents", "text", 300) for w in t.split() if w.isalpha()]
    reported = sum(bool(secret_scan.all_spans(f"{' '.join(rng.sample(words, 20))} secret {w} {' '.join(rng.sample(words, 20))}", novelty)[1]) for w in rng.sample(words, 500))
    assert reported == 0
    assert not secret_scan.all_spans("the password is internationalisation of course", novelty)[1]


# op8


def test_pages_without_semantic_markup():
    """The given pages with article and main renamed and classes removed: at least 95 % have exactly the text of the pages as they are."""
    pages = given("pages", "html")
    rng = random.Random(0)
    sample = [h for h in pages if 200 <= len(h) <= 50_000]
    rng.shuffle(sample)
    judges = html_extraction.train(sample[:200])
    text = lambda source: html_extraction.main_text(p := html_tree.read(source), html_extraction.decode(p, judges.margins([p])[0]))
    bare = lambda h: re.sub(r"""\s(class|id|role|itemprop)=("[^"]*"|'[^']*')""", "", re.sub(r"(</?)(article|main)\b", r"\1div", h))

    def truth(source):
        page = html_tree.read(source)
        labels = html_extraction.weak_labels(page)
        return "\n\n".join(t for o, t in page.runs if labels[o])

    want = [truth(h) for h in pages]
    assert [text(h) for h in pages] == want
    assert sum(text(bare(h)) == w for h, w in zip(pages, want, strict=True)) >= 0.95 * len(pages)
    assert "x = 2" in text("<article><p>so <math><mi>x</mi> = <mn>2</mn></math> holds, as we have seen in the text before.</p></article>")


# op6


def test_order_of_a_filtered_table(spark):
    """Half of the rows of a stored table in small splits: the order is that of the rows left, and a split gives one count, not a row each."""
    rows = [(i, f"text number {i} " * (1 + i % 5), "en", "s", 1) for i in range(500)]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/docs"
    spark.createDataFrame(rows, DOCS).coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        docs = spark.read.parquet(path).where("doc_id % 2 = 1")
        ranks = training_order.read_model(f"{training_order.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
        tokens = training_order.tokenised(training_order.in_order(docs), ranks, b"\x50\xc4")
        starts, total = training_order.split_starts(tokens)
        got, n, _ = training_order.sequences(docs, 16, 8, 5)
        by_seq = {r.seq: bytes(r.ids)[: 2 * r.n_tokens] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(starts) < 60
    cache = training_order._cache(ranks)
    want = b"".join(cache(t) + np.array([training_order.END_MARK], "<u2").tobytes() for i, t, *_ in rows if i % 2)
    assert b"".join(by_seq[i] for i in range(n)) == want and total == len(want) // 2
    again = training_order.sequences(docs.repartition(3).sortWithinPartitions("doc_id"), 16, 8, 5)  # no stored order: any, but whole
    assert again[1] == n


# op1, op2, op5 against brute force


def test_importance_weights_against_plain_counts(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(70, None), (71, ""), (72, "solo"), (72, "solo"), (73, "long " * 20_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(40)]
    got = {(r.doc_id, r.n_grams): r.log_weight for r in importance_resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), buckets=1 << 12).collect()}
    import pyarrow as pa

    grams = {i: importance_resampling.ngram_buckets(pa.array([t or ""]), 1 << 12)[1].tolist() for i, t in docs}
    raw, target = Counter(), Counter()
    good = {i for i, q in labels if q}
    for i, _ in docs:
        raw.update(grams[i])
        target.update(grams[i] if i in good else [])
    n = sum(raw.values())
    p = {b: [raw[b] + importance_resampling.SMOOTHING * max(raw[b] / n * (1 << 12), 1e-3), target[b] + importance_resampling.SMOOTHING * max(raw[b] / n * (1 << 12), 1e-3)] for b in range(1 << 12)}
    sums = [sum(x[j] for x in p.values()) for j in (0, 1)]
    for i, t in docs:
        want = sum(np.log(p[b][1] / sums[1]) - np.log(p[b][0] / sums[0]) for b in grams[i])
        assert abs(got[i, len(grams[i])] - want) < 1e-6 * max(1, abs(want))
    words = lambda t: len((t or "").split())
    assert all(len(grams[i]) == (2 * words(t) - 1 if t and words(t) else 0) for i, t in docs)


def test_target_ids_beyond_the_broadcast(spark):
    """Scores are the same whether the ids of good documents are broadcast or joined by a shuffle; none is left out."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("aa bb cc dd ee".split() if i % 2 else "dd ee ff gg".split()) for _ in range(30))) for i in range(40)] + [(50, None), (None, "aa bb")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = lambda n: sorted((str(r.doc_id), r.n_tokens, round(r.loss_difference or 0, 9)) for r in cross_entropy.score(docs, labels, broadcast_ids=n).collect())
    assert rows(0) == rows(100) and len({x[2] for x in rows(0)}) > 10


def test_recall_of_near_duplicates_over_all_pairs(spark):
    """Every pair of texts, not those of shared bands alone: of the pairs at 0.85 or more, at least 99 in 100 share a class; none below is linked."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(300)) for _ in range(120)] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = "edited" + str(rng.randrange(10**6))
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa

    idf = near_dedup.damped_idf(near_dedup.document_frequency(docs))
    e, w, first = near_dedup.weighted_shingles(pa.array(texts), idf)
    vectors = [(e[first[i] : first[i + 1]], w[first[i] : first[i + 1]]) for i in range(len(texts))]
    cls = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similarity(vectors[i], vectors[j]) >= 0.85]
    assert len(near) > 50 and sum(cls[i] == cls[j] for i, j in near) >= 0.99 * len(near)
    for i in range(len(texts)):
        for j in range(i):
            assert cls[i] != cls[j] or i // 8 == j // 8


def test_bands_against_sorted_values(spark):
    """A document that passes the base rules is rejected if and only if a measure lies beyond the fences of its key's sorted values."""
    odd = [(10**6, " ".join(["the rain in the plain of seldom seen rivers"] * 40 + ["word"] * 9), "en"), (10**6 + 1, " ".join(f"q{i}zx\u0378\u0379" for i in range(200)), "en"), (10**6 + 2, None, "en")]
    rows = spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    measured = {r.doc_id: r for r in quality_rules.measure(rows, ["doc_id"]).collect()}
    judged = {r.doc_id: r for r in quality_rules.quality_rules(rows, keep=["doc_id"]).collect()}
    base = {i: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words for i, r in measured.items()}
    values = {}
    for i, r in measured.items():
        if not base[i] and r.n_tokens >= quality_rules.MIN_TOKENS:
            for m in quality_rules.MEASURES:
                values.setdefault((r.band_key, m), []).append(r[m])
    rejected = 0
    for i, r in measured.items():
        inside = True
        for m in quality_rules.MEASURES:
            if r.n_tokens >= quality_rules.MIN_TOKENS and (own := sorted(values.get((r.band_key, m), []))):
                low, high = (own[-(-len(own) * q // 4) - 1] for q in (1, 3))
                margin = max(quality_rules.FENCE * (high - low), quality_rules.LEAST_MARGIN[m]) * max(1.0, (quality_rules.STEADY_TOKENS / max(r.n_tokens, 1)) ** 0.5)
                inside &= low - margin <= r[m] <= high + margin
        assert judged[i].base_failed == base[i] and judged[i].kept == (not base[i] and inside)
        rejected += not base[i] and not inside
    assert rejected > 10 and not judged[10**6 + 1].kept


# clashing names and very long texts, for every operator

EXTRA = {"Doc_ID": "1", "TEXT": "'x'", "text_hash": "2", "kept": "'k'", "n_tokens": "3", "Class_ID": "4", "host": "'h'", "verdict": "5", "URL": "'u'", "title": "6", "ids": "7", "Spans": "'s'", "node": "8", "seg": "9", "n": "10", "file": "'f'"}


def crowded(df):
    """The rows beside many extra columns, some of which differ from the operator's own in case alone."""
    own = df.select([F.col(c) for c in df.columns] + [F.expr(v).alias(f"x{i}") for i, v in enumerate(EXTRA.values())])
    return own.toDF(*df.columns, *EXTRA)


PASSAGE = "if anna picks twelve apples and gives four of them to her brother how many apples does she still have at home"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of and rain plain mountain river seldom always".split()) for _ in range(80)), "en", "s", 1) for i in range(12)]
    return spark.createDataFrame([*rows, (90, "word " * 60_000, "en", "s", 1), (91, "x" * 200_000, "en", "s", 1), (92, None, None, None, None), (93, f"before it {PASSAGE} and after", "en", "s", 1)], DOCS)


OPERATORS = {
    "op1": lambda s, d: importance_resampling.resample(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).select("doc_id", "n_grams"),
    "op2": lambda s, d: near_dedup.near_duplicates(d).select("doc_id", "class_id"),
    "op4": lambda s, d: sentencepiece_codec.encode(d, keep=["doc_id"]).select("doc_id", "n_tokens", "parity"),
    "op5": lambda s, d: quality_rules.quality_rules(d, keep=["doc_id"]).select("doc_id", "n_words", "kept"),
    "op6": lambda s, d: training_order.sequences(d, 64, 8)[0].select("seq", "n_tokens"),
    "op7": lambda s, d: secret_scan.scan(d, keep=["doc_id"]).select("doc_id", "base_sha256"),
    "op9": lambda s, d: decontaminate.leaks(d, s.createDataFrame([(1, PASSAGE), (2, "word " * 30)], "item_id long, text string")).select("doc_id", "item_id"),
    "op10": lambda s, d: cross_entropy.score(d, s.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")).select("doc_id", "n_tokens"),
    "op11": lambda s, d: token_counts.count_tokens(d, keep=["doc_id"]).select("doc_id", "n_tokens"),
    "quality stage": lambda s, d: corpus_pipeline.quality(s, d, GIVEN).select(F.col("doc_id")) if "Doc_ID" not in d.columns else corpus_pipeline.quality(s, d, GIVEN).toDF(*[f"c{i}" for i in range(len(d.columns))]).select(F.col("c0").alias("doc_id")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_names_and_long_texts(spark, texts, name):
    rows = lambda df: sorted(map(str, df.collect()))
    plain = rows(OPERATORS[name](spark, texts))
    assert plain and rows(OPERATORS[name](spark, crowded(texts))) == plain


def test_clashing_names_of_other_tables(spark):
    rows = lambda df: sorted(map(str, df.collect()))
    pages = spark.createDataFrame([(1, "https://a.com/de/1", "<article><p>one two three</p></article>"), (2, None, None), (3, "https://b.org/" + "x/" * 5000, "<p>" + "long " * 50_000)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1, 0)], "page_id long, bad int, BAD int")
    assert rows(url_filters.url_filter(crowded(pages), labels=labels)) == rows(url_filters.url_filter(pages, labels=labels.toDF("page_id", "bad", "other").drop("other")))
    judges = html_extraction.train([], made=60)
    one = lambda df: rows(html_extraction.extract(df, keep=["page_id"], model=judges).select("page_id", "n_chars"))
    assert one(crowded(pages)) == one(pages)
    talk = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    assert rows(conversation_repair.repaired(crowded(talk))) == rows(conversation_repair.repaired(talk))
    vectors = spark.createDataFrame([(i, [float(i)] * 16, i % 2) for i in range(5)], "vec_id long, embedding array<float>, label int")
    assert rows(vector_codes.codes(crowded(vectors))) == rows(vector_codes.codes(vectors))
