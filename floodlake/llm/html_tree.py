"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in it is a node with two states,
content or not.  Node potentials are log-linear in what the node looks like
(tag, words of class and id, length, links); edge potentials join
the states of parent and child, by the kind of child.  On a tree, sum-product
messages passed up and then down give exact marginals.  The weights maximise
the likelihood of labelled pages, whose gradient needs just these marginals.

Pages are spread over Spark tasks; in a task the nodes of a batch of pages are
handled together, one depth of the trees at a time.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template head title iframe object svg canvas select option textarea button".split())
IN_HEAD = set("base link meta noscript script style template title".split())
BLOCK = set(
    "html body article main section div nav aside header footer form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr center dialog".split()
)
CLOSES_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"} | {"p"}
#: A start tag that ends an open element of these kinds, up to a border.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAG_GROUPS = [
    {"article"}, {"main"}, {"section"}, {"div", "center"}, {"nav"}, {"aside"}, {"header"}, {"footer"}, {"form", "fieldset", "dialog"}, {"ul", "ol", "dl"},
    {"li", "dt", "dd"}, {"table", "thead", "tbody", "tfoot", "tr"}, {"td", "th", "caption"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"},
    {"blockquote", "pre"}, {"figure", "figcaption"}, {"address", "details", "summary"}, {"html", "body"},
]
#: Words of class, id and role, by what they hint at.
NAME_GROUPS = [
    set("nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs skip pager pagination".split()),
    set("header masthead banner logo brand branding tagline".split()),
    set("footer copyright colophon legal contentinfo imprint bottom".split()),
    set("sidebar side rail aside complementary widget widgets related recommended trending popular more archive categories tags tagcloud".split()),
    set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense outbrain taboola".split()),
    set("cookie cookies consent gdpr notice notification alert popup modal overlay toast dialog message warning disclaimer paywall".split()),
    set("form login signin signup register subscribe subscription newsletter search contact feedback poll".split()),
    set("comment comments commentlist reply replies respond discussion discuss disqus reader readers responses thread review reviews".split()),
    set("share sharing social follow facebook twitter buttons meta byline author date print".split()),
    set("article content post entry story main body text page copy maincontent articlebody".split()),
]
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """The nodes of one page in page order; node 0 is the root and comes first."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["html"])
    names: list[int] = field(default_factory=lambda: [0])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    label: list[str | None] = field(default_factory=lambda: [None])

    def add(self, parent: int, tag: str, names: int = 0, text: str | None = None, linked: int = 0, label: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label)
        return len(self.parent) - 1


def _hints(attrs: Iterable[tuple[str, str | None]]) -> tuple[int, bool, str | None]:
    """Name groups as bits, whether the element is hidden, and its label in labelled pages."""
    bits, hidden, label = 0, False, None
    for key, value in attrs:
        value = value or ""
        if key in ("class", "id", "role"):
            for word in _NAME.findall(value):
                word = word.lower()
                for g, group in enumerate(NAME_GROUPS):
                    if word in group:
                        bits |= 1 << g
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif key == "data-label":
            label = value
    return bits, hidden, label


class _Builder(HTMLParser):
    """Builds the tree of blocks; inline elements only add their text to the run around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = Tree()
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements, the block each stands in, and whether it is hidden
        self.open: dict[str, int] = {}
        self.run: list[str] = []
        self.links = self.linked = self.dropped = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.tree.add(self.stack[-1][1], "#text", text=text, linked=min(self.linked, len(text)))
        self.run, self.linked = [], 0

    def push(self, tag: str, block: int, hidden: bool) -> None:
        self.stack.append((tag, block, hidden))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.links += 1
        if hidden:
            self.dropped += 1

    def pop(self) -> None:
        tag, _, hidden = self.stack[-1]
        if tag in BLOCK:
            self.flush()
        self.stack.pop()
        self.open[tag] -= 1
        if tag == "a":
            self.links -= 1
        if hidden:
            self.dropped -= 1

    def close_within(self, tags: set[str], border: set[str]) -> None:
        """Close the innermost open element of ``tags`` unless one of ``border`` is nearer."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in border:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.pop()  # the end tag of a head may be left out
        if tag == "br":
            self.run.append(" ")
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in CLOSES_P:
            self.close_within({"p"}, {"td", "th", "table", "button", "object"})
        if tag in CLOSED_BY:
            self.close_within(*CLOSED_BY[tag])
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        block = self.stack[-1][1]
        bits, hidden, label = _hints(attrs) if attrs else (0, False, None)
        if tag in BLOCK:
            block = self.tree.add(block, tag, bits, label=label)
        self.push(tag, block, hidden or tag in DROPPED)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("br",) and self.stack[-1][0] == tag and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.close_within({tag}, set())

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.pop()
        if not self.dropped:
            self.run.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str | None) -> Tree:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    return builder.tree


#: Kinds of child for the edge potentials: text, headline, paragraph or item, other block.
KINDS = 4
_KIND = {"#text": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "p": 2, "li": 2, "blockquote": 2, "pre": 2, "td": 2, "dd": 2, "dt": 2}
_GROUP = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group}
_N_TAGS, _N_NAMES = len(TAG_GROUPS), len(NAME_GROUPS)
_FEATURES = 1 + _N_TAGS * 2 + _N_NAMES * 2 + 12


@dataclass
class Forest:
    """Trees of several pages, concatenated; parents precede their children."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    features: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.parent)


def forest(trees: list[Tree]) -> Forest:
    first = np.concatenate([[0], np.cumsum([len(t.parent) for t in trees])]).astype(np.int64)
    n = int(first[-1])
    shift = np.repeat(first[:-1], np.diff(first))
    parent = np.concatenate([np.asarray(t.parent, dtype=np.int64) for t in trees] or [np.zeros(0, np.int64)])
    root = parent < 0
    parent = np.where(root, -1, parent + shift)
    depth = np.concatenate([np.asarray(t.depth) for t in trees] or [np.zeros(0, np.int64)])
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(1, (depth.max() if n else 0) + 2))
    levels = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    tags = [tag for t in trees for tag in t.tag]
    kind = np.array([_KIND.get(tag, 3) for tag in tags], dtype=np.int64)
    group = np.array([_GROUP.get(tag, -1) for tag in tags], dtype=np.int64)
    names = np.array([b for t in trees for b in t.names], dtype=np.int64)
    texts = [x or "" for t in trees for x in t.text]
    chars = np.array([len(x) for x in texts], dtype=float)
    words = np.array([x.count(" ") + 1 if x else 0 for x in texts], dtype=float)
    rights = np.array(["©" in x or "(c)" in x for x in texts], dtype=float)
    linked = np.array([x for t in trees for x in t.linked], dtype=float)
    is_text = kind == 0
    total = np.column_stack([chars, linked, is_text.astype(float), (chars > 120).astype(float)])
    for level in reversed(levels):
        np.add.at(total, parent[level], total[level])
    page = total[np.repeat(first[:-1], np.diff(first))] if n else total
    f = np.zeros((n, _FEATURES))
    if not n:
        return Forest(parent, levels, kind, f, first)
    up = np.maximum(parent, 0)
    f[:, 0] = 1
    own = np.flatnonzero(group >= 0)
    f[own, 1 + group[own]] = 1
    text = np.flatnonzero(is_text & (group[up] >= 0))  # a run of text also shows its block's tag and names
    f[text, 1 + _N_TAGS + group[up][text]] = 1
    at = 1 + 2 * _N_TAGS
    bits = (names[:, None] >> np.arange(_N_NAMES)) & 1
    f[:, at : at + _N_NAMES] = bits
    f[:, at + _N_NAMES : at + 2 * _N_NAMES] = bits[up] * is_text[:, None]
    at += 2 * _N_NAMES
    dense = total[:, 1] / np.maximum(total[:, 0], 1)
    f[:, at] = np.log1p(total[:, 0]) / 5
    f[:, at + 1] = dense
    f[:, at + 2] = np.log1p(total[:, 2]) / 3
    f[:, at + 3] = total[:, 0] / np.maximum(page[:, 0], 1)
    f[:, at + 4] = np.log1p(total[:, 3])
    f[:, at + 5] = (dense > 0.5) * ~is_text
    f[:, at + 6] = is_text * (chars < 40)
    f[:, at + 7] = is_text * np.minimum(words / 20, 3)
    f[:, at + 8] = is_text * dense
    f[:, at + 9] = rights
    f[:, at + 10] = is_text * (words <= 3)
    f[:, at + 11] = ~is_text * (total[:, 0] / np.maximum(total[:, 2], 1) > 80)
    return Forest(parent, levels, kind, f, first)


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(np.minimum(a, b) - top))


def sum_product(trees: Forest, theta: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every node (n, 2) and of every edge (n, parent state, child state).

    ``theta`` weighs the features for the content state; ``psi[kind]`` are the
    log potentials of the edge above a node of that kind.
    """
    n = len(trees)
    score = trees.features @ theta
    belief = np.column_stack([np.zeros(n), score])  # node potential and messages from below
    message = np.zeros((n, 2))
    edge = psi[trees.kind]
    for level in reversed(trees.levels):
        joint = edge[level] + belief[level][:, None, :]
        message[level] = _logsum(joint[:, :, 0], joint[:, :, 1])
        np.add.at(belief, trees.parent[level], message[level])
    full = belief.copy()  # with the message from above
    for level in trees.levels:
        above = full[trees.parent[level]] - message[level]
        joint = edge[level] + above[:, :, None]
        full[level] = belief[level] + _logsum(joint[:, 0], joint[:, 1])
    node = np.exp(full - _logsum(full[:, 0], full[:, 1])[:, None])
    pair = np.zeros((n, 2, 2))
    for level in trees.levels:
        above = full[trees.parent[level]] - message[level]
        joint = edge[level] + above[:, :, None] + belief[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        pair[level] = np.exp(joint) / np.exp(joint).sum(axis=(1, 2), keepdims=True)
    return node, pair


@dataclass
class TreeModel:
    theta: np.ndarray
    psi: np.ndarray

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """The marginal of the content state for each node of each tree."""
        f = forest(trees)
        node, _ = sum_product(f, self.theta, self.psi)
        return [node[a:b, 1] for a, b in zip(f.first[:-1], f.first[1:], strict=True)]

    def extract(self, trees: list[Tree]) -> list[str]:
        return ["\n\n".join(x for x, p in zip(t.text, m.tolist(), strict=True) if x and p >= 0.5) for t, m in zip(trees, self.content(trees), strict=True)]


def states(tree: Tree) -> np.ndarray:
    """States of a labelled page: text by the nearest data-label ("content" or "other") above it, blocks by most of their text."""
    n = len(tree.parent)
    label: list[bool] = [False] * n
    for i in range(n):
        own = tree.label[i]
        label[i] = own == "content" if own is not None else i > 0 and label[tree.parent[i]]
    share = np.zeros((n, 2))
    for i in range(n - 1, -1, -1):
        if tree.text[i]:
            share[i, int(label[i])] += len(tree.text[i])
        if i:
            share[tree.parent[i]] += share[i]
    block = share[:, 1] >= np.maximum(share[:, 0], 1)
    return np.where([t == "#text" for t in tree.tag], label, block).astype(np.int64)


def fit(labelled: Iterable[str], rounds: int = 300, ridge: float = 0.004) -> TreeModel:
    """Maximum likelihood by gradient steps (Adam); the gradient is what is seen less what the marginals expect."""
    trees = [parse(page) for page in labelled]
    f = forest(trees)
    y = np.concatenate([states(t) for t in trees])
    child = f.parent >= 0
    up = y[np.maximum(f.parent, 0)]
    seen_pair = np.zeros((KINDS, 2, 2))
    np.add.at(seen_pair, (f.kind[child], up[child], y[child]), 1)
    w = np.zeros(_FEATURES + KINDS * 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        theta, psi = w[:_FEATURES], w[_FEATURES:].reshape(KINDS, 2, 2)
        node, pair = sum_product(f, theta, psi)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[child], pair[child])
        grad = np.concatenate([f.features.T @ (y - node[:, 1]), (seen_pair - expected).ravel()]) / len(trees) - ridge * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return TreeModel(w[:_FEATURES], w[_FEATURES:].reshape(KINDS, 2, 2))


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Labelled pages in many layouts, for training; the words mean nothing, as no feature looks at words."""
    rng = random.Random(seed)
    parts = "lo mi ra ten sol ver da ki on per ast ule nor fi gra".split()
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))

    styles = (" ",)  # what stands between words: most pages are plain prose, some hold odd text throughout

    def sentence(k: int) -> str:
        words = [word() for _ in range(max(1, k))]
        if rng.random() < 0.1:
            words[rng.randrange(len(words))] = f'<a href="/{word()}">{word()} {word()}</a>'
        style = rng.choice(styles)
        return style.join(words).capitalize() + (rng.choice(".....!?") if style == " " else "")

    def para() -> str:
        k = rng.choice((1, 1, 2, 4, 8, 15, 30, 60, 90, 150))
        body = " ".join(sentence(rng.randint(1, min(18, k))) for _ in range(max(1, k // 10)))
        return rng.choice((f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<p><b>{word()}</b> {body}</p>"))

    def links(k: int) -> str:
        item = lambda: f'<a href="/{word()}">{word()}{" " + word() if rng.random() < 0.4 else ""}</a>'
        return rng.choice(("<ul>" + "".join(f"<li>{item()}</li>" for _ in range(k)) + "</ul>", " | ".join(item() for _ in range(k)), "".join(f"<p>{item()}</p>" for _ in range(k))))

    def named(names: str, inner: str, tags: str = "div section") -> str:
        name = rng.choice(names.split())
        how = rng.choice((f'class="{name}"', f'id="{name}"', f'class="{word()} {name}-{word()}"'))
        tag = rng.choice(tags.split())
        return f'<{tag} {how} data-label="other">{inner}</{tag}>'

    def prose(most: int = 4) -> str:
        return "".join(para() for _ in range(rng.randint(1, most))) if rng.random() < 0.6 else sentence(rng.randint(3, 20))

    side = [
        lambda: f'<nav data-label="other">{links(rng.randint(3, 9))}</nav>',
        lambda: named("nav menu navbar breadcrumb pagination", links(rng.randint(2, 8))),
        lambda: f'<header data-label="other"><h1>{word()} {word()}</h1>{"<p>" + sentence(6) + "</p>" if rng.random() < 0.5 else ""}{links(3) if rng.random() < 0.3 else ""}</header>',
        lambda: named("header masthead banner", f"<h2>{word()}</h2>{sentence(5)}"),
        lambda: named("ad ads advert sponsored promo", prose(2), "div div aside section"),
        lambda: f'<aside data-label="other"><h3>{word()}</h3>{rng.choice((links(5), prose(3)))}</aside>',
        lambda: named("sidebar widget related trending", f"<h3>{word()} {word()}</h3>{rng.choice((links(5), prose(2)))}", "div aside section"),
        lambda: named("cookie consent notice alert popup", prose(2) + (f"<button>{word()}</button>" if rng.random() < 0.5 else "")),
        lambda: f'<form data-label="other"><p>{sentence(8)}</p><label>{word()}</label><input name="q"><button>{word()}</button></form>',
        lambda: named("newsletter subscribe login search", f"<h4>{word()}</h4><p>{sentence(9)}</p><form><input></form>"),
        lambda: named("share social follow", links(4)),
    ]
    end = [
        lambda: f'<footer data-label="other">&copy; {word()}.{word()} &middot; {sentence(rng.randint(3, 14))}</footer>',
        lambda: f'<footer data-label="other">{links(4)}<p>{sentence(10)}</p></footer>',
        lambda: named("footer copyright legal", f"<p>&copy; {word()} {sentence(8)}</p>"),
    ]
    comments = [
        lambda: named("comments discussion responses", f"<h3>{word()}</h3>" + "".join(f'<div class="{rng.choice(("comment", word()))}"><b>{word()}</b>{para()}{para() if rng.random() < 0.4 else ""}</div>' for _ in range(rng.randint(1, 6)))),
        lambda: '<ol class="commentlist" data-label="other">' + "".join(f"<li><cite>{word()}</cite>{para()}</li>" for _ in range(rng.randint(1, 6))) + "</ol>",
    ]

    def article() -> str:
        out = [f"<h1>{sentence(rng.randint(2, 12))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 2, 4, 7, 12, 20))):
            x = rng.random()
            if x < 0.8:
                out.append(para())
            elif x < 0.86:
                out.append(f"<h{(k := rng.randint(2, 4))}>{sentence(4)}</h{k}>")
            elif x < 0.9:
                out.append("<ul>" + "".join(f"<li>{sentence(rng.randint(1, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif x < 0.93:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif x < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(rng.choice((side[4], side[6], side[8], side[10]))())
        return "".join(out)

    pages = []
    for _ in range(n):
        styles = rng.choice(((" ",), (" ",), (" ",), (" ", " | "), (" | ",), (", ",), ("### ", "%% "), (" - ",)))
        tag, how = rng.choice((("article", ""), ("article", ""), ("article", f' class="{word()}"'), ("main", ""), ("div", ' id="content"'), ("div", ' class="post"'), ("section", ' class="entry-body"'), ("div", ""), ("div", f' class="{word()}"'), ("td", "")))
        main = f'<{tag}{how} data-label="content">{article()}{rng.choice(comments)() if rng.random() < 0.1 else ""}</{tag}>'
        if tag == "td":
            main = f'<table><tr><td data-label="other">{links(5)}</td>{main}</tr></table>'
        if rng.random() < 0.3:
            main = f"<main>{main}</main>"
        if rng.random() < 0.3:
            main = f'<div class="{rng.choice(("wrapper", "container", "row", word()))}">{main}{rng.choice(side)() if rng.random() < 0.5 else ""}</div>'
        before = "".join(rng.choice(side)() for _ in range(rng.randint(0, 4)))
        after = "".join(rng.choice(side)() for _ in range(rng.randint(0, 2))) + (rng.choice(comments)() if rng.random() < 0.4 else "") + (rng.choice(end)() if rng.random() < 0.85 else "")
        pages.append(f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{before}{main}{after}{'</body></html>' if rng.random() < 0.9 else ''}")
    return pages


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages(page_id, url, html)``.

    Blocks of content in page order, white space folded, joined by an empty
    line; nothing else is dropped.  A null html counts as empty; a page without
    content has the empty text.  Rows that repeat are read each for itself;
    columns besides the three are ignored; an empty table gives an empty
    result.  Without a model, one is fitted on ``labelled_pages``.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))
    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = shared.value.extract([parse(x.as_py()) for x in part.column("html")])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
