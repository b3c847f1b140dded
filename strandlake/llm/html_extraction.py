"""Main-text extraction: gradient-boosted trees over the features of DOM nodes, decoded down the tree.

Every block-level node has features of its subtree (text length and density, link
share, paragraphs, controls), its attribute tokens and those above it, its depth
and its siblings. Boosted trees give the probability that a node belongs to, or
contains, the main text. Decoding picks the labels of all nodes of a page at
once: a node that is not main has no main node below it, so an ancestor and a
descendant never contradict each other.

Training: no page is labelled, so labels are weak. Of at most ``sample`` pages
(the smallest by a hash of their content: a documented bound) those with
semantic markup teach it, by their article or main element. Pages without such an
element are judged by trees of their own: they learn from the same pages without that
markup, without class names, and without any tag that tells its role, so that no tag or
name decides alone. Only pages of 200 to 50,000 characters are sampled. Their texts are also
set into pages of other layouts, drawn at random by a fixed seed, whose main
parts are known: with and without semantic tags, under many class names, with
menus, sidebars, notices, adverts, forms and comments about them. The fit runs on
the driver on that bounded sample; every page is then judged in map-only tasks.

Text: character references are decoded, white space inside a block is one space,
blocks are joined in page order by an empty line. Nothing else is dropped.

Defined results: pages of any length are read whole, some 4 MB at a time. A null or empty page, and one without main text, gives an empty
text. Repeated rows get equal results. An extra column that has the name of an
output column gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common, html_tree
from strandlake.llm.html_tree import FEATURES, Page

SAMPLE_PAGES = 200
MADE_PAGES = 600
ROUNDS, DEPTH, RATE, BINS, LEAST = 50, 4, 0.2, 32, 8.0


class Boosted:
    """Binary boosted trees of fixed depth over binned features; a tree is arrays of features, thresholds and leaves."""

    def __init__(self):
        self.bias = 0.0
        self.features: list[np.ndarray] = []
        self.thresholds: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # x <= edge: left
        self.bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        margin = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            feature, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf)
            at = np.zeros(len(y), np.int64)  # node within the level
            for level in range(depth):
                width, base = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-6)
                cut = np.full(width, BINS)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = at * BINS + binned[:, j]
                    g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < LEAST / 4) | (ht - h < LEAST / 4)] = 0
                    gain[:, len(e) :] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(width), top] > best
                    best[better] = gain[np.arange(width), top][better]
                    feature[base : base + width][better] = j
                    threshold[base : base + width][better] = e[top[better]]
                    cut[better] = top[better]
                own = base + at
                at = at * 2 + (binned[np.arange(len(y)), feature[own]] > cut[at])
            g, h = (np.bincount(at, v, 1 << depth) for v in (grad, hess))
            leaf = rate * g / (h + 1)
            margin += leaf[at]
            self.features.append(feature)
            self.thresholds.append(threshold)
            self.leaves.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The most probable labels with no main node below one that is not."""
    n = len(page.tag)
    yes = -np.logaddexp(0, -margin)
    no = -np.logaddexp(0, margin)
    all_no = no.tolist()
    best_main = yes.tolist()
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        best[i] = max(all_no[i], best_main[i])
        p = page.parent[i]
        if p >= 0:
            all_no[p] += all_no[i]
            best_main[p] += best[i]
    main = [False] * n
    for i in range(n):
        p = page.parent[i]
        main[i] = (p < 0 or main[p]) and best_main[i] >= all_no[i]
    return main


def main_text(page: Page, main: list[bool]) -> str:
    return "\n\n".join(text for owner, text in page.runs if main[owner])


_SEMANTIC_NOT = frozenset("nav header footer aside form menu dialog".split())


def weak_labels(page: Page) -> list[int] | None:
    """Labels by semantic markup, or None for a page without an article or main element."""
    roots = [i for i, t in enumerate(page.tag) if t == "article"] or [i for i, t in enumerate(page.tag) if t == "main"]
    if not roots:
        return None
    return _spread(page, [1 if i in set(roots) else 0 if t in _SEMANTIC_NOT else -1 for i, t in enumerate(page.tag)])


def _spread(page: Page, marks: list[int]) -> list[int]:
    """Marks passed down to descendants; a node is main if it, or anything below, has main text."""
    n = len(page.tag)
    state = [0] * n
    for i in range(n):
        state[i] = marks[i] if marks[i] >= 0 else state[page.parent[i]] if page.parent[i] >= 0 else 0
    own = [False] * n
    for owner, _ in page.runs:
        own[owner] = True
    label = [int(state[i] == 1 and own[i]) for i in range(n)]
    for i in range(n - 1, 0, -1):
        label[page.parent[i]] |= label[i]
    return label


def _made_page(rng: random.Random, texts: list[str]) -> str:
    """A page of a random layout around paragraphs of sampled pages; main parts are marked for training."""

    def words(lo: int, hi: int) -> str:
        source = rng.choice(texts).split()
        at = rng.randrange(len(source))
        return html.escape(" ".join((source[at:] + source)[: rng.randint(lo, hi)]))

    def element(names: list[str], classes: list[str], inner: str, main: int) -> str:
        name = rng.choice(names)
        attr = rng.choice([f' class="{rng.choice(classes)}"', f' id="{rng.choice(classes)}"', f' class="x1 {rng.choice(classes)}"', ""]) if name != "div" or rng.random() < 0.9 else ""
        return f'<{name}{attr} data-training-main="{main}">{inner}</{name}>'

    def links(lo: int, hi: int) -> str:
        each = [f'<a href="#">{words(1, 4)}</a>' for _ in range(rng.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>" if rng.random() < 0.7 else " | ".join(each)

    def prose(lo: int, hi: int) -> str:
        if rng.random() < 0.25:
            return f"<p>{words(lo, hi)} <a href='#'>{words(1, 3)}</a> {words(2, 8)}</p>"
        return f"<p>{words(lo, hi)}</p>" if rng.random() < 0.9 else f"<div>{words(lo, hi)}</div>"

    menu = lambda: element(["nav", "div", "div"], ["menu", "navbar", "main-nav", "navigation", "breadcrumbs"], links(3, 12), 0)
    head = lambda: element(["header", "div"], ["header", "site-header", "masthead", "topbar"], rng.choice(["", f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>"]) + rng.choice(["", menu()]), 0)
    foot = lambda: element(["footer", "div"], ["footer", "site-footer", "copyright", "bottom"], f"&copy; {words(2, 30)} " + rng.choice(["", links(2, 6)]), 0)
    side = lambda: element(["aside", "div", "section"], ["sidebar", "related", "widget", "recommended", "right-rail"], f"<h3>{words(1, 4)}</h3>" + rng.choice([links(3, 9), prose(5, 40)]), 0)
    advert = lambda: element(["div", "aside", "section"], ["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], rng.choice([words(3, 40), prose(3, 40)]), 0)
    notice = lambda: element(["div", "section", "dialog"], ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup"], f"<p>{words(5, 40)}</p><button>{words(1, 2)}</button>", 0)
    form = lambda: element(["form", "div"], ["search-form", "newsletter", "login", "subscribe"], f"<label>{words(1, 4)}</label><input type='text'>" + rng.choice(["", f"<p>{words(3, 15)}</p>"]) + f"<button>{words(1, 2)}</button>", 0)
    comments = lambda: element(["div", "section", "ol"], ["comments", "comment-list", "discussion", "reader-comments", "replies"], f"<h3>{words(1, 3)}</h3>" + "".join(element(["div", "li", "article"], ["comment", "reply", "comment-body"], prose(3, 60), 0) for _ in range(rng.randint(1, 6))), 0)
    body = f"<h1>{words(2, 12)}</h1>" if rng.random() < 0.8 else ""
    most = rng.choice([4, 15, 60, 150, 150])  # some articles are a few words
    for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 8, 10, 14]) if most > 4 else 1):
        kind = rng.random()
        body += prose(1, most) if kind < 0.85 else f"<h2>{words(1, 8)}</h2>" if kind < 0.92 else f"<ul><li>{words(2, 15)}</li><li>{words(2, 15)}</li></ul>" if kind < 0.96 else f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if rng.random() < 0.06:
            body += rng.choice([advert, side, form])()
    article = element(["article", "article", "main", "div", "div", "section"], ["article", "post", "content", "entry-content", "post-body", "main-content", "story", "article-body"], body, 1)
    if rng.random() < 0.4:
        article = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'row', 'col-8'])}'>{article}{rng.choice(['', side(), comments()])}</div>"
    before = [f() for f in (notice, head, menu, advert, side, form) if rng.random() < 0.45]
    after = [f() for f in (advert, side, comments, form, foot, notice) if rng.random() < 0.45]
    return f"<html><head><title>{words(1, 6)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


_NEUTRAL = {t: "div" for t in ("article", "main", "section")}
_BARE = _NEUTRAL | {t: "div" for t in ("nav", "header", "footer", "aside", "dialog", "menu")}


def neutral(page: Page, tags: dict[str, str], named: bool) -> Page:
    """The page with other tags for some of its elements and, unless ``named``, without the kinds that attributes name."""
    return replace(page, tag=[tags.get(t, t) for t in page.tag], kinds=page.kinds if named else [frozenset()] * len(page.kinds))


def is_marked(page: Page) -> bool:
    """Whether an element says which part is main."""
    return "article" in page.tag or "main" in page.tag


@dataclass
class Judges:
    """Trees for pages with an article or main element, and for pages without."""

    marked: Boosted
    bare: Boosted

    def margins(self, pages: list[Page]) -> list[np.ndarray]:
        """Margins of the nodes of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        for trees, marked in ((self.marked, True), (self.bare, False)):
            own = [i for i, p in enumerate(pages) if is_marked(p) == marked]
            each = [html_tree.features(pages[i]) for i in own]
            margin = trees.margin(np.array([r for rows in each for r in rows], np.float64).reshape(-1, len(FEATURES)))
            ends = np.cumsum([len(rows) for rows in each]) if own else []
            for i, part in zip(own, np.split(margin, ends[:-1]) if own else [], strict=True):
                out[i] = part
        return out


def train(sample: list[str], made: int = MADE_PAGES, seed: int = 11) -> Judges:
    """Fits the trees on weakly labelled pages and on pages of known layout made from their texts."""
    known, texts = [], []
    for source in sample:
        page = html_tree.read(source)
        label = weak_labels(page)
        if label is None:
            texts += [t for _, t in page.runs if len(t) > 60]
            continue
        known.append((page, label))
        texts += [t for owner, t in page.runs if len(t) > 20]
    rng = random.Random(seed)
    texts = texts or ["lorem ipsum dolor sit amet, consectetur adipiscing elit. sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."]
    drawn = []
    for _ in range(made):
        page = html_tree.read(_made_page(rng, texts))
        drawn.append((page, _spread(page, page.truth)))

    def fit(pages: list[tuple[Page, list[int]]]) -> Boosted:
        rows = [r for page, _ in pages for r in html_tree.features(page)]
        return Boosted().fit(np.array(rows, np.float64), np.array([x for _, label in pages for x in label], np.float64))

    bare = [(neutral(page, tags, named), label) for page, label in known for tags, named in ((_NEUTRAL, True), (_NEUTRAL, False), (_BARE, False))]
    bare += [(neutral(page, *((_NEUTRAL, True), (_NEUTRAL, True), (_NEUTRAL, False), (_BARE, False))[i % 4]), label) for i, (page, label) in enumerate(drawn)]
    return Judges(fit(known + drawn), fit(bare))


def sample_pages(pages: DataFrame, column: str = "html", n: int = SAMPLE_PAGES) -> list[str]:
    """At most ``n`` pages, the smallest by a hash of their content.

    The least hashes are found first, so no page is moved but those chosen.
    """
    rows = pages.where(F.length(column).between(200, 50_000)).select(F.xxhash64(column).alias("k"), F.col(column).alias("h"))
    least = [r.k for r in rows.select("k").distinct().orderBy("k").limit(n).collect()]
    chosen = rows.where(F.col("k").isin(least)).groupBy("k").agg(F.min("h").alias("h")).collect() if least else []
    return [r.h for r in sorted(chosen, key=lambda r: r.k)]


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None, model: Judges | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), ``text`` and ``n_chars`` of every row."""
    shield = common.Shield(pages)
    cols = shield.columns if keep is None else [shield.at[c] for c in keep]
    rows = shield.rows.select(*cols, F.coalesce(F.col(shield.at[column]), F.lit("")).alias("html"))
    if model is None:
        model = train(sample_pages(shield.rows, shield.at[column]))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = shared.value
        for whole in batches:
            for batch in common.text_chunks(whole, "html", 4 << 20):
                read = [html_tree.read(h) for h in batch.column("html").to_pylist()]
                texts = [main_text(page, decode(page, margin)) for page, margin in zip(read, judges.margins(read), strict=True)]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), *made], names=[*cols, "text", "n_chars"])

    return shield.back(rows.mapInArrow(run, common.schema_of(rows, cols, "text string, n_chars long")), keep)
