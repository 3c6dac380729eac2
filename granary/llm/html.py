"""Main text of web pages: boosted trees over the nodes of the DOM, decoded along the tree.

A page is read into a tree of block elements; inline elements belong to the block
around them. Boosted trees give every block the chance that its own text is part
of the main text, from its tag, its attribute tokens and its ancestors', depth,
siblings and the density of its subtree. The best consistent choice over the tree
is then found bottom up: once a subtree is dropped, nothing below it comes back.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches

#: Pages whose nodes help to train, at most about so many, and made pages beside them.
TRAINING_PAGES, MADE_PAGES = 300, 900
#: Weight of the given pages' nodes in all, against one for the made ones', so that one build cannot outvote them.
GIVEN_WEIGHT = 0.5

# Elements by how a page is read.
SKIPPED = frozenset("script style noscript template svg head title iframe object canvas math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Which open elements a start tag of this name ends, and what stops the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}

# A tag with well-formed attributes, else (stray quotes) anything up to the next angle bracket;
# possessive, so that no page takes more than linear time between two brackets.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/<>]*+)([^<>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-label|itemprop|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    """A block element: its own pieces of text and its child blocks, in page order."""

    tag: str
    tokens: frozenset[str]
    parent: int
    depth: int
    parts: list = field(default_factory=list)  # texts (str) and child numbers (int)
    link: int = 0  # characters inside links


def parse(page: str) -> list[Node]:
    """The blocks of a page, each after its parent; the first is the page itself.

    Forgiving: end tags that nothing opened are passed over, what is left open
    ends with the page, and paragraphs, items and cells end where the next begins.
    Linear in the page, however broken: where the open elements of a name stand is
    known, and so is which skipped elements have no end tag any more.
    """
    nodes = [Node("page", frozenset(), -1, 0)]
    stack: list[tuple[str, int, int]] = [("page", 0, 0)]  # all open elements: block they belong to, last that is not inline
    opened: dict[str, list[int]] = defaultdict(list)  # their places in the stack by name
    endless: set[str] = set()  # skipped elements that nothing ends from here on
    links = at = 0
    n = len(page)

    def last(names: Iterable[str]) -> int:
        return max((opened[x][-1] for x in names if opened[x]), default=0)

    def end_from(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag].pop()
            links -= tag == "a"

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            here = nodes[stack[-1][1]]
            here.parts.append(text)
            if links:
                here.link += len(text)
        if not m:
            break
        at = m.end()
        closing, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if closing:
            if opened[name]:
                end_from(opened[name][-1])
            elif name in ("p", "br"):
                nodes[stack[-1][1]].parts.append(" ")
            continue
        if name in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = n
                else:
                    endless.add(name)
            continue
        if name in VOID:
            nodes[stack[-1][1]].parts.append("" if name in ("img", "wbr") else " ")
            continue
        if name in CLOSES_P and stack[stack[-1][2]][0] == "p":
            end_from(stack[-1][2])
        if name in ENDS:
            ended, stops = ENDS[name]
            k = last(ended)
            if k > last(stops):
                end_from(k)
        block = stack[-1][1]
        opened[name].append(len(stack))
        if name in INLINE:
            stack.append((name, block, stack[-1][2]))
            links += name == "a"
            continue
        tokens = frozenset(
            t for key, *values in _ATTRIBUTE.findall(attributes) for t in _TOKEN.findall((key + " " if key.lower() == "hidden" else "") + "".join(values).lower())
        ) if attributes else frozenset()
        nodes.append(Node(name, tokens, block, nodes[block].depth + 1))
        nodes[block].parts.append(len(nodes) - 1)
        stack.append((name, len(nodes) - 1, len(stack)))
    return nodes


# Groups of tags and of attribute tokens that are features of their own.
TAGS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section"},
    {"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "button", "label", "select", "option", "textarea", "fieldset", "legend", "input"},
    {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html", "page"},
]
TOKENS = [
    set("article content main post entry story body text prose richtext articlebody maincontent".split()),
    set("nav navigation menu navbar breadcrumb breadcrumbs topbar tabs toc pagination pager skip".split()),
    set("header masthead branding logo banner hero top".split()),
    set("footer foot bottom copyright legal colophon imprint".split()),
    set("sidebar aside side rail widget related recommended recommendations popular trending more links tags".split()),
    set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adslot teaser".split()),
    set("cookie cookies consent gdpr notice notices alert popup modal overlay dialog warning message toast".split()),
    set("comment comments commentlist reply replies disqus discussion respond reader responses feedback thread".split()),
    set("form search subscribe newsletter signup login register contact poll survey input".split()),
    set("share sharing social follow meta byline author date tools print hidden none".split()),
]


def features(nodes: Sequence[Node]) -> np.ndarray:
    """One row of features per node."""
    n = len(nodes)
    own, link = np.zeros(n), np.zeros(n)
    words, marks = np.zeros(n), np.zeros(n)
    kinds = np.zeros((n, len(TAGS)))
    tokens = np.zeros((n, len(TOKENS)))
    above_kinds, above_tokens = np.zeros((n, len(TAGS))), np.zeros((n, len(TOKENS)))
    parent = np.array([x.parent for x in nodes])
    children, place = np.zeros(n), np.zeros(n)
    seen: dict[tuple[int, str], int] = {}
    alike = np.zeros(n)
    for i, x in enumerate(nodes):
        for t in x.parts:
            if isinstance(t, str):
                size = len(t.strip())
                own[i] += size
                if size > 2:
                    words[i] += t.count(" ") + 1
                    marks[i] += t.count(",") + t.count(".")
        link[i] = x.link
        for k, tags in enumerate(TAGS):
            if x.tag in tags:
                kinds[i, k] = 1
        if x.tokens:
            for k, group in enumerate(TOKENS):
                if not group.isdisjoint(x.tokens):
                    tokens[i, k] = 1
        p = x.parent
        if p >= 0:
            above_kinds[i] = np.maximum(above_kinds[p], kinds[p])
            above_tokens[i] = np.maximum(above_tokens[p], tokens[p])
            place[i] = children[p]
            children[p] += 1
            seen[p, x.tag] = seen.get((p, x.tag), 0) + 1
    before = np.cumsum(own) - own
    deep, deep_link, deep_nodes, deep_marks = own.copy(), link.copy(), np.ones(n), marks.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        deep[p] += deep[i]
        deep_link[p] += deep_link[i]
        deep_nodes[p] += deep_nodes[i]
        deep_marks[p] += deep_marks[i]
    up = np.maximum(parent, 0)
    paragraphs = np.zeros(n)  # text in a node's own paragraphs
    for i, x in enumerate(nodes):
        if x.parent >= 0:
            alike[i] = seen[x.parent, x.tag]
            if x.tag == "p":
                paragraphs[x.parent] += deep[i]
    total = max(own.sum(), 1)
    columns = [
        np.log1p(own), np.log1p(words), marks / np.maximum(words, 1), link / np.maximum(own, 1), np.log1p(deep),
        deep_link / np.maximum(deep, 1), np.log1p(deep / deep_nodes), deep_marks / np.maximum(deep, 1) * 100, deep / total,
        before / total, np.array([x.depth for x in nodes], float), children, children[up], place, place / np.maximum(children[up], 1),
        alike, np.log1p(paragraphs[up]), paragraphs[up] / total, np.log1p(deep[up]), deep_link[up] / np.maximum(deep[up], 1), deep / np.maximum(deep[up], 1),
    ]
    return np.concatenate([np.stack(columns, axis=1), kinds, tokens, above_kinds, above_tokens], axis=1).astype(np.float32)


@dataclass
class BoostedTrees:
    """Regression trees of fixed depth on binned features, summed to a logit."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, cut, leaf

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def boosted(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 32
) -> BoostedTrees:
    """Fit by Newton boosting of the weighted logistic loss, splits taken from feature histograms."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    mean = np.average(y, weights=weight).clip(1e-3, 1 - 1e-3)
    model = BoostedTrees(float(np.log(mean / (1 - mean))))
    score = np.full(n, model.start)
    flat = binned + np.arange(width) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                inside = np.flatnonzero(at == node)
                if len(inside) < 20:
                    continue
                cells = flat[inside].ravel()
                gs = np.bincount(cells, np.repeat(g[inside], width), width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[inside], width), width * bins).reshape(width, bins).cumsum(axis=1)
                left = gs**2 / (hs + 1)
                right = (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
                gain = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-3 and b < len(cuts[j]):
                    feature[node], cut[node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf_of = at - (2**depth - 1)
        leaf = rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + 1)
        model.trees.append((feature, cut, leaf))
        score += leaf[leaf_of]
    return model


def decoded(nodes: Sequence[Node], logit: np.ndarray) -> np.ndarray:
    """Which nodes' own text is main: the consistent choice of greatest likelihood.

    A node is above the main text, in it, or dropped. Below a node above it all
    three may follow; below one in it, in or dropped; below a dropped one, only
    dropped. A node weighs by the logarithm of its own text, so a short line does
    not outvote a long one.
    """
    n = len(nodes)
    weight = np.array([1 + np.log1p(sum(len(t.strip()) for t in x.parts if isinstance(t, str))) for x in nodes])
    keep = -np.logaddexp(0, -logit) * weight
    drop = -np.logaddexp(0, logit) * weight
    best = np.stack([drop, keep, drop], axis=1)  # above, in, dropped
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        best[p] += [best[i].max(), best[i, 1:].max(), best[i, 2]]
    state = np.zeros(n, np.int64)
    for i in range(1, n):
        s = state[nodes[i].parent]
        state[i] = s + best[i, s:].argmax()
    return state == 1


def text_of(nodes: Sequence[Node], kept: np.ndarray) -> str:
    """The text of kept nodes in page order, white space as single spaces."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            out.append(" ".join(entities.unescape("".join(run)).split()))
            run.clear()

    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, at = todo.pop()
        parts = nodes[i].parts
        while at < len(parts):
            part = parts[at]
            at += 1
            if isinstance(part, int):
                close()
                todo.append((i, at))
                todo.append((part, 0))
                break
            if kept[i]:
                run.append(part)
        else:
            close()
    return " ".join(t for t in out if t)


#: Stands in front of the main text of made pages; from a private range of code points.
_MARK = ""


def made_page(r: random.Random, words: Sequence[str]) -> str:
    """A page of some common build, its main texts marked."""

    def some(a: int, b: int) -> str:
        text = " ".join(r.choice(words) for _ in range(r.randint(a, b)))
        return entities.escape(text[:1].upper() + text[1:] + r.choice([".", ".", "", "!"]), quote=False)

    opaque, brief = r.random() < 0.3, r.random() < 0.2

    def named(names: str) -> str:
        if opaque:  # names that say nothing: another language's, or a style tool's
            return r.choice(["", f' class="{r.choice(words)}"', f' id="{r.choice(words)}"', f' class="{r.choice("abcdefgh")}{r.randrange(16**5):x}"'])
        name = r.choice(names.split())
        name = r.choice([name, name + "-" + r.choice(["box", "wrap", "area", "block", "1", "inner"]), "c-" + name])
        return r.choice([f' class="{name}"', f' id="{name}"', f" class='{name} {r.choice(words)}'", f' class="x {name}"'])

    def tag(name: str, inside: str, names: str = "") -> str:
        return f"<{name}{named(names) if names else ''}>{inside}</{name}>"

    def links(a: int, b: int) -> str:
        each = "".join(
            r.choice(["<li><a href='/{0}'>{0}</a></li>", '<li><a href="/x">{0} {0}</a>']).format(r.choice(words)) for _ in range(r.randint(a, b))
        )
        return r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(each) if r.random() < 0.8 else re.sub("</?li>", " ", each)

    def paragraphs(a: int, b: int, mark: str = "", close: bool = True) -> str:
        ends = "</p>" if close else ""
        return "".join(
            f"<p>{mark}{r.choice(['', '<b>' + some(1, 3) + '</b> ', '<a href=/y>' + some(1, 3) + '</a> '])}{some(*r.choice([(1, 8), (3, 30), (10, 90)]))}{ends}\n" for _ in range(r.randint(a, b))
        )

    def menu() -> str:
        return tag("nav", links(3, 9)) if r.random() < 0.5 else tag("div", links(3, 12), "nav menu navbar navigation topnav breadcrumbs")

    def top() -> str:
        inside = tag(r.choice(["div", "p", "h1", "span"]), some(1, 5)) + r.choice(["", menu()])
        return tag("header", inside) if r.random() < 0.5 else tag("div", inside, "header masthead site-header branding")

    def bottom() -> str:
        inside = r.choice([some(3, 14), tag("p", "&copy; 2024 " + some(2, 20)), links(2, 8) + tag("p", some(2, 8))])
        return tag("footer", inside) if r.random() < 0.6 else tag("div", inside, "footer site-footer colophon legal copyright")

    def advert() -> str:
        inside = r.choice([some(3, 30), tag("p", some(4, 30)), tag("p", some(5, 20)) + "<a href='#'>" + some(1, 3) + "</a>"])
        return tag(r.choice(["div", "div", "section", "aside", "p"]), inside, "ad ads advert advertisement sponsored promo banner-ad ad-slot")

    def notice() -> str:
        return tag(r.choice(["div", "section", "aside"]), tag("p", some(4, 40)) + "<button>" + some(1, 2) + "</button>", "cookie-notice cookie consent notice alert popup modal gdpr")

    def form() -> str:
        inside = tag("label", some(1, 4)) + "<input type=text>" + tag("button", some(1, 2)) + r.choice(["", tag("p", some(4, 18))])
        return tag("form", inside) if r.random() < 0.6 else tag("div", tag("form", inside), "newsletter subscribe search signup")

    def side() -> str:
        inside = tag("h3", some(1, 4)) + r.choice([links(2, 6), paragraphs(1, 2), tag("p", some(4, 40))])
        return tag("aside", inside, r.choice(["", "sidebar"])) if r.random() < 0.5 else tag("div", inside, "sidebar related widget popular recommended")

    def comments() -> str:
        item = lambda: tag(r.choice(["div", "li", "article"]), tag(r.choice(["p", "div"]), some(3, 60)) + r.choice(["", some(1, 3)]), "comment reply comment-body")
        inside = tag("h3", some(1, 3)) + "".join(item() for _ in range(r.randint(1, 6)))
        return tag(r.choice(["div", "section", "ol"]), inside, "comments commentlist discussion responses comment-section")

    def extra() -> str:
        return r.choice([advert, notice, form, side, advert, lambda: tag("div", links(2, 5), "share social related tags"), lambda: tag("nav", links(2, 5))])()

    close = r.random() < 0.8
    body = [tag(r.choice(["h1", "h1", "h2"]), _MARK + some(2, 12))] if r.random() < 0.85 else []
    if brief:
        body.append("".join(f"<p>{_MARK}{some(1, 12)}</p>" for _ in range(r.randint(0 if body else 1, 2))))
    for _ in range(0 if brief else r.randint(1, 4)):
        body.append(paragraphs(1, 5, _MARK, close))
        body.append(
            r.choice(
                ["", "", "", tag("h2", _MARK + some(1, 8)), tag("ul", "".join(tag("li", _MARK + some(2, 20)) for _ in range(r.randint(2, 6)))),
                 tag("blockquote", tag("p", _MARK + some(5, 40))), tag("table", tag("tr", tag("td", _MARK + some(1, 6)) + tag("td", _MARK + some(1, 6)))),
                 tag("pre", _MARK + some(3, 20)), tag("div", _MARK + some(5, 60)), tag("figure", "<img src=x>" + tag("figcaption", _MARK + some(2, 10)))]
            )
        )
        if r.random() < 0.25:
            body.append(extra())
    if r.random() < 0.15 and not brief:
        body.append(comments())
    inside = "".join(body)
    build = r.random()
    main = (
        tag("article", inside, r.choice(["", "post", "entry"])) if build < 0.4 else tag("main", inside) if build < 0.55
        else tag("main", tag("article", inside)) if build < 0.65 else tag("div", inside, "content article post entry story main-content text-body") if build < 0.9
        else tag(r.choice(["div", "section"]), inside)
    )
    before = [x() for x in (top, menu, advert, notice, side, form) if r.random() < 0.45]
    after = [x() for x in (comments, side, advert, form, notice, menu) if r.random() < 0.35]
    r.shuffle(before)
    r.shuffle(after)
    whole = "".join(before) + main + "".join(after) + (bottom() if r.random() < 0.85 else "")
    for _ in range(r.choice([0, 0, 1, 2])):
        whole = tag("div", whole, r.choice(["", "wrapper", "page container"]))
    end = "</body></html>" if r.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{}}</style></head><body>{whole}<script>var a='<p>';</script>{end}"


def node_labels(nodes: Sequence[Node], main: Sequence[bool]) -> np.ndarray:
    """1 for nodes with main text of their own, or without any but with mostly main text below."""
    n = len(nodes)
    own = np.array([sum(len(t.strip()) for t in x.parts if isinstance(t, str)) for x in nodes], float)
    good = np.where(main, own, 0)
    deep, deep_good = own.copy(), good.copy()
    for i in range(n - 1, 0, -1):
        deep[nodes[i].parent] += deep[i]
        deep_good[nodes[i].parent] += deep_good[i]
    return np.where(own > 0, main, deep_good > deep / 2).astype(float)


def _marked(nodes: Sequence[Node]) -> list[bool]:
    return [any(isinstance(t, str) and _MARK in t for t in x.parts) for x in nodes]


def _semantic(nodes: Sequence[Node]) -> list[bool] | None:
    """Labels of a page that says itself where its one article is; None if it doesn't."""
    if sum(x.tag in ("article", "main") for x in nodes) != 1:
        return None
    away = set().union(*TAGS[8:13])
    state: list[bool | None] = []
    for x in nodes:
        above = state[x.parent] if x.parent >= 0 else None
        out = x.tag in away or any(not group.isdisjoint(x.tokens) for group in TOKENS[1:])
        state.append(False if above is False or (above and out) else True if above or x.tag in ("article", "main") else None)
    return [bool(s) for s in state]


def trained(pages: DataFrame, most: int = TRAINING_PAGES, made: int = MADE_PAGES, seed: int = 3) -> BoostedTrees:
    """Trees fitted on the nodes of made pages and of about `most` of the given ones.

    The given pages, drawn by a hash, lend their words to the made ones, and those
    that mark their one article as such also their nodes. This bounds the
    training only; every page is extracted.
    """
    share = max(1, pages.count() // most)
    rows = pages.where("html is not null").where(F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0)
    drawn = sorted((str(r.page_id), r.html) for r in rows.select("page_id", "html").limit(4 * most).toLocalIterator())
    return fit([h for _, h in drawn], made, seed)


def fit(pages: Sequence[str], made: int = MADE_PAGES, seed: int = 3) -> BoostedTrees:
    r = random.Random(seed)
    parsed = [parse(h) for h in pages]
    words = [w for nodes in parsed for x in nodes for t in x.parts if isinstance(t, str) for w in t.split()[:40]][:50_000]
    words = words or "some words that stand for any text there may be on a page in the end".split()
    xs, ys = [], []
    for nodes in parsed:
        main = _semantic(nodes)
        if main:
            xs.append(features(nodes))
            ys.append(node_labels(nodes, main))
    given = sum(map(len, xs))
    for _ in range(made):
        nodes = parse(made_page(r, words))
        xs.append(features(nodes))
        ys.append(node_labels(nodes, _marked(nodes)))
    if not xs:
        return BoostedTrees()
    x = np.concatenate(xs)
    weight = np.ones(len(x))
    if made and given:
        weight[:given] = min(1.0, GIVEN_WEIGHT * (len(x) - given) / given)
    return boosted(x, np.concatenate(ys), weight)


def main_texts(pages: Sequence[str], model: BoostedTrees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    sizes = np.cumsum([len(p) for p in parsed])[:-1]
    logits = np.split(model.logit(np.concatenate([features(p) for p in parsed])), sizes)
    return [text_of(nodes, decoded(nodes, x)) for nodes, x in zip(parsed, logits)]


def extract_main_text(pages: DataFrame, model: BoostedTrees) -> DataFrame:
    """page_id, url and text of each (page_id, url, html) row.

    Text is the main text with character references decoded, white space inside a
    block as one space, and blocks in page order joined by one space; empty where
    the page has none, is empty or null. Nothing else is dropped or cut. Repeated
    rows each get theirs, null ids and urls stay, other columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            htmls = [h or "" for h in batch.column("html").to_pylist()]
            texts = [t for i in range(0, len(htmls), 200) for t in main_texts(htmls[i : i + 200], trees)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), extract, "page_id long, url string, text string")
