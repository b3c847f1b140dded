"""A small, forgiving HTML reader: block-level nodes with their features and texts."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("head select option button svg canvas object audio video datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose own text is judged with them; text directly in others is a node of its own.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre caption figcaption summary address".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag that ends an open element of the same group, and the elements it doesn't look beyond.
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z_:][-\w:.]*)""")
TOKEN = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Attribute tokens by what they commonly name.
TOKENS = {
    "content": "article articlebody content contents post entry story text body main blog prose copy paragraph richtext",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip links",
    "header": "header masthead banner topbar logo branding hero",
    "footer": "footer copyright colophon legal imprint bottom",
    "side": "sidebar aside related recommended recommendations widget rail secondary popular trending more",
    "advert": "ad ads advert adverts advertisement adsense promo promotion sponsor sponsored banner campaign",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning banner toast announcement",
    "comment": "comment comments commentlist reply replies discussion disqus respond reader feedback thread",
    "form": "form search login signup subscribe newsletter register contact input",
    "share": "share sharing social follow like tweet print meta tags byline",
}
KIND_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        KIND_OF.setdefault(_w, []).append(_i)
N_KINDS = len(TOKENS)
TAGS = ["p", "h", "li", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "table", "quote"]
TAG_AT = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": 1 for i in range(1, 7)} | {"blockquote": 13, "pre": 13, "td": 12, "tr": 12, "th": 12, "ul": 2, "ol": 2}
STRUCTURE = ["nav", "header", "footer", "aside", "form", "article", "main"]
FEATURES = (
    ["chars", "own_chars", "link_share", "density", "paragraphs", "depth", "position", "siblings", "sibling_at", "page_share", "punctuation", "mean_block", "items", "controls", "links"]
    + [f"tag_{t}" for t in TAGS] + [f"attr_{k}" for k in TOKENS] + [f"above_{k}" for k in TOKENS] + [f"in_{t}" for t in STRUCTURE] + ["before_chars", "after_chars"]
)


@dataclass
class Page:
    """Block-level nodes in page order (a parent before its children) and the runs of text between their borders."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    kinds: list[frozenset] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, text)


_KINDS_CACHE: dict[str, tuple[frozenset, int]] = {}


def _attributes(raw: str) -> tuple[frozenset, int]:
    """Kinds that a tag's class, id, role and itemprop tokens name; and the training mark: 1 main, 0 not, -1 none."""
    if raw in _KINDS_CACHE:
        return _KINDS_CACHE[raw]
    kinds, mark = set(), -1
    for m in ATTRIBUTE.finditer(raw):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for token in TOKEN.findall(value):
                kinds.update(KIND_OF.get(token.lower(), ()))
        elif name == "data-training-main":
            mark = int(value == "1")
    found = frozenset(kinds), mark
    if len(_KINDS_CACHE) < 20_000:
        _KINDS_CACHE[raw] = found
    return found


def read(source: str) -> Page:
    page = Page()

    def node(tag: str, parent: int, kinds: frozenset, truth: int) -> int:
        page.tag.append(tag)
        page.parent.append(parent)
        page.kinds.append(kinds)
        page.truth.append(truth)
        for counts in (page.links, page.link_chars, page.controls, page.inline):
            counts.append(0)
        return len(page.tag) - 1

    root = node("root", -1, frozenset(), -1)
    stack: list[tuple[str, int]] = [("root", root)]  # (element, its block node)
    dropped = in_link = 0
    pieces: list[str] = []
    owner = root

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                at_node = owner if page.tag[owner] in LEAVES else node("#text", owner, frozenset(), -1)
                page.runs.append((at_node, text))
            pieces = []

    def pop() -> None:
        nonlocal dropped, in_link
        name, _ = stack.pop()
        dropped -= name in DROPPED
        in_link -= name == "a"

    at, end, low = 0, len(source), None
    while at < end:
        m = TAG.search(source, at)
        text = source[at : m.start() if m else end]
        if text and not dropped:
            pieces.append(text)
            if in_link:
                page.link_chars[stack[-1][1]] += len(text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br" or name == "p" and not any(t == "p" for t, _ in stack):
                pieces.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in BLOCK or any(t in BLOCK for t, _ in stack[i:]):
                        flush()
                    while len(stack) > i:
                        pop()
                    owner = stack[-1][1]
                    break
                if name not in BLOCK and stack[i][0] in BLOCK and stack[i][0] != "p":
                    break  # an inline end tag doesn't close blocks
            continue
        if name in RAW:
            if low is None:
                low = source.lower()
                if len(low) != end:
                    low = source
            close = low.find(f"</{name}", at)
            gt = source.find(">", close) if close >= 0 else -1
            at = gt + 1 if gt >= 0 else end
            if name == "textarea":
                page.controls[stack[-1][1]] += 1
            continue
        if name in VOID:
            if name == "input":
                page.controls[stack[-1][1]] += 1
            if name == "hr":
                flush()
            elif name in ("br", "wbr"):
                pieces.append(" " if name == "br" else "")
            continue
        if name in CLOSES_P or name in SAME:
            ends, stop = SAME.get(name, ({"p"}, set()))
            if name in CLOSES_P:
                ends = ends | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    flush()
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in stop or stack[i][0] in BLOCK and stack[i][0] not in ends and "li" not in ends:
                    break
        if name in BLOCK:
            flush()
            while dropped and len(stack) > 1 and any(t == "head" for t, _ in stack):  # an unclosed head ends where content begins
                pop()
            kinds, mark = _attributes(m[3])
            own = node(name, stack[-1][1], kinds, mark)
        else:
            own = stack[-1][1]
            page.inline[own] += 1
            if name == "a":
                page.links[own] += 1
                in_link += 1
            elif name in ("select", "button"):
                page.controls[own] += 1
        if name in DROPPED:
            dropped += 1
        if not m[3].endswith("/") or name in BLOCK:
            stack.append((name, own))
        else:
            dropped -= name in DROPPED
            in_link -= name == "a"
        owner = stack[-1][1]
    flush()
    return page


PUNCTUATION = re.compile("[.,;:!?]")


def features(page: Page) -> list[list[float]]:
    """One row of ``FEATURES`` for every block-level node."""
    n = len(page.tag)
    own = [0] * n
    blocks = [0] * n
    punct = [0] * n
    before_at = [0] * n
    total = 0
    starts: dict[int, int] = {}
    for owner, text in page.runs:
        size = len(text)
        own[owner] += size
        blocks[owner] += 1
        punct[owner] += len(PUNCTUATION.findall(text))
        starts.setdefault(owner, total)
        total += size
    chars, n_blocks, n_punct = own[:], blocks[:], punct[:]
    links, link_chars, controls = page.links[:], page.link_chars[:], page.controls[:]
    paragraphs = [int(t == "p") for t in page.tag]
    items = [int(t in ("li", "td", "dd")) for t in page.tag]
    size = [1 + x for x in page.inline]
    children = [0] * n
    first = [starts.get(i, -1) for i in range(n)]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        n_blocks[p] += n_blocks[i]
        n_punct[p] += n_punct[i]
        links[p] += links[i]
        link_chars[p] += link_chars[i]
        controls[p] += controls[i]
        paragraphs[p] += paragraphs[i]
        items[p] += items[i]
        size[p] += size[i]
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    depth = [0] * n
    nth = [0] * n
    seen = [0] * n
    above: list[frozenset] = [frozenset()] * n
    inside: list[frozenset] = [frozenset()] * n
    out = []
    whole = max(total, 1)
    n_tags, n_structure = len(TAGS), len(STRUCTURE)
    structure = {t: i for i, t in enumerate(STRUCTURE)}
    at_text = 0
    for i in range(n):
        p = page.parent[i]
        tag = page.tag[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            nth[i] = seen[p]
            seen[p] += 1
            above[i] = above[p] | page.kinds[p] if page.kinds[p] else above[p]
            inside[i] = inside[p] | {structure[page.tag[p]]} if page.tag[p] in structure else inside[p]
        c = chars[i]
        before = first[i] if first[i] >= 0 else at_text
        at_text = before
        row = [
            math.log1p(c), math.log1p(own[i]), min(1.0, link_chars[i] / max(c, 1)), math.log1p(c / size[i]), math.log1p(paragraphs[i]), depth[i], i / n,
            children[p] if p >= 0 else 1, nth[i], c / whole, n_punct[i] / max(c, 1) * 100, math.log1p(c / max(n_blocks[i], 1)), items[i] / max(n_blocks[i], 1), controls[i], math.log1p(links[i]),
        ]
        flags = [0.0] * (n_tags + 2 * N_KINDS + n_structure)
        if tag in TAG_AT:
            flags[TAG_AT[tag]] = 1.0
        for k in page.kinds[i]:
            flags[n_tags + k] = 1.0
        for k in above[i]:
            flags[n_tags + N_KINDS + k] = 1.0
        for k in inside[i]:
            flags[n_tags + 2 * N_KINDS + k] = 1.0
        row += flags
        row.append(before / whole)
        row.append((total - before - c) / whole)
        out.append(row)
    return out
