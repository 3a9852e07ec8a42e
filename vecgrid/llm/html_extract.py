"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text is a node with a hidden label, content or not. Node potentials come from
hashed features (tag, class and id words, length, share of links), parent-child potentials tie a node to its parent.
One pass of sum-product messages up the tree and one down give exact marginals; runs whose marginal reaches one half are the text.
The weights maximise the likelihood of labelled pages with the same two passes.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrid.llm.common import per_text, text_of

FEATURES = 1 << 16
MAX_LABELLED = 100  # bound of the pages of the table that are labelled by their own article element
MAX_LABELLED_CHARS = 50_000  # longer pages are not drawn into that sample; all are extracted
_PAGES = 256  # handled together

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>?", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose whole content is never shown as text.
SKIPPED = frozenset("script style noscript template iframe svg title textarea select".split())
#: Of these, the ones that hold raw text: without an end tag they go on to the end of the page.
RAW_TEXT = frozenset("script style textarea title".split())
_SKIPPED_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW_TEXT))})(?=[\s/>]).*?(?:</(?i:\1)(?=[\s/>])|\Z)"
    rf"|<(/?)({'|'.join(sorted(SKIPPED - RAW_TEXT))})(?=[\s/>])[^>]*+>?",
    re.S | re.I,
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that flow within a line and so neither make a node nor end a run.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var nobr object canvas audio video math mi mn mo ms mtext mspace mrow mfrac msqrt mroot "
    "mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction "
    "semantics annotation annotation-xml".split()
)
#: An opening tag closes an open element of these kinds within the given scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
#: Elements that are boilerplate by their meaning in HTML.
ASIDE = frozenset("nav footer aside form menu button header dialog".split())


@dataclass
class Tree:
    """Nodes of one page in document order, node 0 the root; ``text`` is None for elements."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    text: list[str | None] = field(default_factory=lambda: [None])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    links: list[float] = field(default_factory=lambda: [0.0])

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, links: float = 0.0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def skipped_ends(page: str) -> dict[int, int]:
    """Where each skipped element that has an end tag of its own ends, by where it begins; raw-text elements aside."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for m in _SKIPPED_TAG.finditer(page):
        if m.group(3) is None or m.group(0).endswith("/>"):
            continue
        begun = opened.setdefault(m.group(3).lower(), [])
        if not m.group(2):
            begun.append(m.start())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


def parse(page: str | None) -> Tree:
    """Tolerant tree of a page. Runs are decoded, white space in them is one space, blank runs make no node."""
    page = page or ""
    tree, stack, at = Tree(), [0], 0
    run: list[str] = []
    linked = 0
    in_link = False
    ends_at: dict[int, int] | None = None

    def end_run() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                tree.add(stack[-1], "#text", (), text, min(1.0, linked / max(1, len(text))))
            run.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            run.append(raw)
            if in_link:
                linked += len(raw)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in SKIPPED:
            if not closing and tag not in RAW_TEXT:
                if ends_at is None:
                    ends_at = skipped_ends(page)
                at = ends_at.get(m.start(), at)  # without an end tag only the tag goes
            elif not closing and not m.group(0).endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                if end is None:
                    break
                at = page.find(">", end.end() - 1)
                at = len(page) if at < 0 else at + 1
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                end_run()
            continue
        end_run()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[k]] == tag:
                    del stack[k:]
                    break
            continue
        ends, scope = CLOSES.get(tag, ({"p"}, set()))
        for k in range(len(stack) - 1, 0, -1):
            open_tag = tree.tag[stack[k]]
            if open_tag in ends:
                del stack[k:]
                if tag != "tr":
                    break
            if open_tag in scope or not scope:
                break
        if m.group(0).endswith("/>") and tag not in ("p", "div"):
            continue
        names = []
        for a in _ATTRIBUTE.finditer(m.group(3)):
            value = a.group(2) or a.group(3) or a.group(4) or ""
            names += [w.lower() for w in _WORD.findall(value)]
        stack.append(tree.add(stack[-1], tag, tuple(dict.fromkeys(names))))
    end_run()
    return tree


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _node_features(tree: Tree, v: int) -> list[str]:
    if tree.text[v] is None:
        return ["element", f"tag {tree.tag[v]}", *[f"name {n}" for n in tree.names[v]]]
    text, above = tree.text[v], tree.tag[tree.parent[v]]
    size, share = len(text).bit_length(), int(4 * tree.links[v])
    mark = "end" if text[-1] in ".!?…。”\"" else "open"
    return ["run", f"size {size}", f"links {share}", f"in {above}", mark, f"{share} {size >> 1}"]


@dataclass
class Forest:
    """Trees of several pages as arrays."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray  # 1 for runs
    feature: np.ndarray
    of_node: np.ndarray
    starts: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, starts, strict=False)])
    depth = np.concatenate([np.array(t.depth) for t in trees])
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    kind = np.array([x is not None for t in trees for x in t.text], np.int8)
    cache: dict[str, int] = {}
    flat, counts = [], []
    for t in trees:
        for v in range(len(t.parent)):
            names = _node_features(t, v)
            counts.append(len(names))
            for n in names:
                if n not in cache:
                    cache[n] = _hash(n)
                flat.append(cache[n])
    return Forest(parent, levels, kind, np.array(flat, np.int64), np.repeat(np.arange(len(kind)), counts), starts)


@dataclass(frozen=True)
class TreeModel:
    """``weights``: log odds of content by feature. ``edges[kind, y_parent, y]``: log potentials by kind of child."""

    weights: np.ndarray
    edges: np.ndarray


def messages(f: Forest, model: TreeModel) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of content by node, marginals of (parent, child) labels by node) from one upward and one downward pass."""
    n = len(f.kind)
    inward = np.zeros((n, 2))  # own potential and all messages from below
    inward[:, 1] = np.bincount(f.of_node, model.weights[f.feature], n)
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    pair = model.edges[f.kind]  # n x 2 x 2
    for nodes in f.levels[:0:-1]:
        up[nodes] = np.logaddexp.reduce(inward[nodes][:, None, :] + pair[nodes], axis=2)
        np.add.at(inward, f.parent[nodes], up[nodes])
    joint = np.zeros((n, 2, 2))
    for nodes in f.levels[1:]:
        above = f.parent[nodes]
        rest = inward[above] + down[above] - up[nodes]
        scores = rest[:, :, None] + pair[nodes]
        down[nodes] = np.logaddexp.reduce(scores, axis=1)
        scores = scores + inward[nodes][:, None, :]
        scores -= np.logaddexp.reduce(scores.reshape(len(nodes), 4), axis=1)[:, None, None]
        joint[nodes] = np.exp(scores)
    belief = inward + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def fit(labelled: Iterable[tuple[Tree, list[int]]], epochs: int = 200, rate: float = 0.5, decay: float = 3e-6) -> TreeModel:
    """Fit on pages with a label for every node, by gradient ascent on their likelihood (AdaGrad).

    Without pages every node is content.
    """
    pages = list(labelled)
    weights, edges = np.zeros(FEATURES), np.zeros((2, 2, 2))
    if not pages:
        weights[[_hash("element"), _hash("run")]] = 5.0
        return TreeModel(weights, edges)
    f = forest([t for t, _ in pages])
    y = np.concatenate([np.array(labels) for _, labels in pages])
    inner = np.flatnonzero(f.parent >= 0)
    observed = np.zeros((2, 2, 2))
    np.add.at(observed, (f.kind[inner], y[f.parent[inner]], y[inner]), 1.0)
    seen, seen_edges = np.full(FEATURES, 1e-8), np.full((2, 2, 2), 1e-8)
    for _ in range(epochs):
        p, joint = messages(f, TreeModel(weights, edges))
        grad = np.bincount(f.feature, (y - p)[f.of_node], FEATURES) / len(y) - decay * weights
        expected = np.stack([joint[inner[f.kind[inner] == k]].sum(axis=0) for k in (0, 1)])
        grad_edges = (observed - expected) / len(y) - decay * edges
        seen += grad * grad
        seen_edges += grad_edges * grad_edges
        weights = weights + rate * grad / np.sqrt(seen)
        edges = edges + rate * grad_edges / np.sqrt(seen_edges)
    return TreeModel(weights, edges)


def with_elements(tree: Tree, content: list[bool]) -> list[int]:
    """Node labels from labels of the runs: an element is content if at least half of the characters below it are."""
    good, every = np.zeros(len(tree.parent)), np.zeros(len(tree.parent))
    for v in range(len(tree.parent) - 1, -1, -1):
        if tree.text[v] is not None:
            every[v], good[v] = len(tree.text[v]), len(tree.text[v]) * content[v]
        if tree.parent[v] >= 0:
            every[tree.parent[v]] += every[v]
            good[tree.parent[v]] += good[v]
    return [int(content[v]) if t is not None else int(2 * good[v] >= every[v] > 0) for v, t in enumerate(tree.text)]


# Labelled layouts ------------------------------------------------------------------------------------------------------

#: Usual names of the parts of a page.
MAIN = "article main content post story entry body text".split()
BOILERPLATE = {
    "nav": "nav menu navbar breadcrumb breadcrumbs pagination topbar toc navigation".split(),
    "header": "header masthead branding logo banner".split(),
    "footer": "footer copyright legal colophon".split(),
    "aside": "sidebar aside related widget recommended popular trending promo teaser more".split(),
    "div": "ad ads advert advertisement adsense sponsor sponsored promoted cookie consent notice alert gdpr popup modal "
    "overlay share social sharing tags meta subscribe newsletter paywall".split(),
    "form": "form search login signup subscribe newsletter contact".split(),
    "section": "comments comment respond responses discussion reply replies disqus reader".split(),
}


def layouts(n: int = 500, seed: int = 1) -> list[tuple[Tree, list[int]]]:
    """Labelled pages of many shapes: semantic or plain containers, named or nameless, boilerplate around and inside."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(lo: int, hi: int) -> str:
        return " ".join("word"[: int(rng.integers(1, 5))] * int(rng.integers(1, 3)) for _ in range(int(rng.integers(lo, hi))))

    def prose() -> str:
        short = rng.random() < 0.25
        return words(2, 9) + pick([".", ".", ""]) if short else words(10, 150) + pick([".", ".", ".", "!", "?", ""])

    def attr(name: str) -> str:
        form = pick(["{}", "{}", "{}-box", "site-{}", "{}_wrap", "page-{}"]).format(name)
        return pick([f' class="{form}"', f' class="{form}"', f' id="{form}"'])

    def piece(content: bool) -> str:
        flag = "C" if content else "B"  # marks the run with its label; taken off again below
        return f"\x01{flag}{prose()}"

    def boiler() -> str:
        tag = pick(list(BOILERPLATE))
        name = pick(BOILERPLATE[tag])
        form = rng.random()
        if form < 0.55:
            outer = pick([tag, tag, "div", "section", "ul" if tag == "nav" else "div"])
            head = f"<{outer}{attr(name)}>"
        else:
            outer, head = (tag, f"<{tag}>") if tag not in ("div", "section") else ("div", f"<div{attr(name)}>")
        kind = rng.random()
        if tag == "section" or kind < 0.3:
            each = f"<div{attr(name)}><p>" if rng.random() < 0.3 else f"<{pick(['p', 'div', 'li'])}>"
            inner = "".join(f"{each}{piece(False)}" for _ in range(int(rng.integers(1, 5))))
        elif kind < 0.7:
            inner = "<ul>" + "".join(f'<li><a href="/x">\x01B{words(1, 4)}</a></li>' for _ in range(int(rng.integers(2, 9)))) + "</ul>"
        else:
            inner = f"\x01B{words(1, 30)}"
        if rng.random() < 0.35:
            level = pick(["h1", "h2", "h3", "h4"])
            inner = f"<{level}>\x01B{words(1, 6)}</{level}>{inner}"
        return f"{head}{inner}</{outer}>"

    def main() -> str:
        tag = pick(["article", "article", "main", "div", "div", "section", "td"])
        head = f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.6 else f"<{tag}{attr(pick(MAIN))}>"
        parts = []
        if rng.random() < 0.8:
            level = pick(["h1", "h1", "h2"])
            parts.append(f"<{level}>\x01C{words(2, 14)}</{level}>")
        for _ in range(int(rng.integers(1, 9))):
            shape = rng.random()
            if shape < 0.68:
                parts.append(f"<p>{piece(True)}</p>")
            elif shape < 0.74:
                parts.append("<ul>" + "".join(f"<li>{piece(True)}</li>" for _ in range(3)) + "</ul>")
            elif shape < 0.78:
                parts.append(f"<blockquote><p>{piece(True)}</p></blockquote>")
            elif shape < 0.82:
                parts.append(f"<h2>\x01C{words(1, 8)}</h2>")
            elif shape < 0.86:
                parts.append(f"<div>{piece(True)}</div>")
            elif shape < 0.89:
                parts.append(f"<table><tr><td>\x01C{words(1, 6)}</td><td>\x01C{words(1, 6)}</td></tr></table>")
            elif shape < 0.91:
                parts.append(f"<pre>{piece(True)}</pre>")
            else:
                parts.append(boiler())
        return head + "".join(parts) + f"</{tag}>"

    out = []
    for _ in range(n):
        before = "".join(boiler() for _ in range(int(rng.integers(1, 5))))
        after = "".join(boiler() for _ in range(int(rng.integers(1, 5))))
        core = main()
        if rng.random() < 0.4:  # the text with its surroundings, in a container of its own
            around = core + "".join(boiler() for _ in range(int(rng.integers(0, 3))))
            core = pick([f"<main>{around}</main>", f"<main>{around}</main>", f"<div{attr(pick(MAIN))}>{around}</div>"])
        body = before + core + after
        if rng.random() < 0.3:
            body = f"<div{attr(pick(['wrapper', 'container', 'page', 'layout']))}>{body}</div>"
        page = f"<html><head><title>x</title></head><body>{body}</body></html>"
        if rng.random() < 0.08:  # bare text
            page = "".join(f"{pick(['', '<p>', '<p>'])}{piece(True)}" for _ in range(int(rng.integers(1, 4))))
        tree = parse(page)
        content = [False] * len(tree.parent)
        for v, text in enumerate(tree.text):
            if text is not None:
                content[v] = text.startswith("\x01C")
                tree.text[v] = text[2:] or "x"
        out.append((tree, with_elements(tree, content)))
    return out


def label_by_article(tree: Tree) -> list[int] | None:
    """Labels of a page that says itself where its text is: one article (or main) element, without parts inside
    that are boilerplate by their element or name. None for other pages."""
    roots = [v for v, t in enumerate(tree.tag) if t == "article"] or [v for v, t in enumerate(tree.tag) if t == "main"]
    if len(roots) != 1:
        return None
    known = {n for names in BOILERPLATE.values() for n in names}
    inside = [False] * len(tree.parent)
    for v in range(1, len(tree.parent)):
        inside[v] = v == roots[0] or inside[tree.parent[v]]
        if inside[v] and v != roots[0] and (tree.tag[v] in ASIDE or known & set(tree.names[v])):
            return None
    return with_elements(tree, inside) if any(inside) else None


def labelled_sample(
    pages: DataFrame,
    id_col: str = "page_id",
    html_col: str = "html",
    max_pages: int = MAX_LABELLED,
    max_chars: int = MAX_LABELLED_CHARS,
) -> list[tuple[Tree, list[int]]]:
    """At most ``max_pages`` pages, drawn by the hash of the id, labelled by their own article element."""
    order = F.xxhash64(F.col(id_col))
    n = pages.count()
    share = 1_000_000 if n <= 4 * max_pages else int(4_000_000 * max_pages / n) + 1
    rows = (
        pages.filter(F.pmod(order, F.lit(1_000_000)) < share)
        .filter(F.length(text_of(html_col)).between(1, max_chars))
        .select(order.alias("o"), F.col(html_col).alias("h"))
        .orderBy("o", "h")
        .limit(max_pages)
        .collect()
    )
    trees = [parse(r["h"]) for r in rows]
    found = [(t, label_by_article(t)) for t in trees]
    return [(t, labels) for t, labels in found if labels is not None]


# Extraction ------------------------------------------------------------------------------------------------------------


def extract_texts(pages: list[str | None], model: TreeModel, threshold: float = 0.5) -> list[str]:
    out = []
    for lo in range(0, len(pages), _PAGES):
        trees = [parse(p) for p in pages[lo : lo + _PAGES]]
        f = forest(trees)
        p, _ = messages(f, model)
        for t, s in zip(trees, f.starts, strict=False):
            runs = [x for v, x in enumerate(t.text) if x is not None and p[s + v] >= threshold]
            out.append("\n\n".join(runs))
    return out


def extractor(model: TreeModel, threshold: float = 0.5) -> Callable[[Column], Column]:
    """Column function: struct with ``text``, the blocks that are content, in page order, two line ends between them.

    NULL, empty and textless pages give an empty text. Whole pages are read; nothing else is dropped.
    """
    sparse = np.flatnonzero(model.weights)
    packed = (sparse, model.weights[sparse], model.edges)

    def make():
        weights = np.zeros(FEATURES)
        weights[packed[0]] = packed[1]
        local = TreeModel(weights, packed[2])
        return lambda pages: [pa.array(extract_texts(pages.to_pylist(), local, threshold), pa.string())]

    return per_text(make, "text string")
