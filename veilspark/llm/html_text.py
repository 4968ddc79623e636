"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Two boosters see each element: one says how likely all of its text is article, one how likely none
is.  Decoding goes from the leaves up: a node is taken whole, left out whole, or opened into its
children, whichever is likeliest by characters, so a choice for a node rules its descendants.
The boosters are trained here, on generated pages of many layouts (html_pages.py).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SENTENCE_ENDS = re.compile(r"[.!?](?:\s|$)")

# Fixed values of HTML: what holds no page text, what has no end tag, and what is a block.
SILENT = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "select", "option", "textarea", "title", "head", "datalist", "audio", "video"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
FOREIGN = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# A start tag closes an open element of these names, unless one of the second list stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr"}, {"table"}),
}
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}

TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "nav", "header", "footer", "aside", "form", "a", "b", "span", "blockquote", "pre", "body", "html", "figure", "button", "label", "dl"]


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    nth: int
    names: tuple[str, ...]
    kids: list = field(default_factory=list)  # child numbers, and texts
    chars: int = 0
    linked: int = 0
    tags: int = 0
    links: int = 0
    paragraphs: int = 0
    commas: int = 0
    ends: int = 0
    inputs: int = 0
    longest: int = 0
    same: int = 0


@lru_cache(maxsize=20_000)
def attribute_names(attrs: str) -> tuple[str, ...]:
    found = []
    for m in ATTRIBUTE.finditer(attrs):
        found += [p.lower() for p in NAME_PARTS.findall(m[2] or m[3] or m[4] or "")]
    return tuple(found)


def parse(page: str | None) -> list[Node]:
    """Elements in page order; tags left open end with their parents."""
    nodes = [Node("html", -1, 0, 0, ())]
    stack = [0]
    page = page or ""
    at, skip = 0, None
    last_end: dict[str, int] = {}

    def left_open(tag: str, start: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((e.start() for e in re.finditer(rf"</{re.escape(tag)}\b", page, re.I)), default=-1)
        return last_end[tag] < start

    def text(part: str) -> None:
        part = html.unescape(part)
        if part:
            nodes[stack[-1]].kids.append(part)

    def close(depth: int) -> None:
        del stack[depth:]

    for m in iter_tokens(page):
        start, end, closing, tag, attrs = m
        if start > at and skip is None:
            text(page[at:start])
        at = end
        if tag is None:
            continue
        if skip is not None:
            if closing and tag == skip:
                skip = None
                continue
            # A block ends drawings and formulas, and silent elements that nothing ends; so does the end
            # of what holds them.
            if tag not in BLOCKS or not (skip in FOREIGN or left_open(skip, start)) or (closing and not any(nodes[k].tag == tag for k in stack)):
                continue
            skip = None
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
                if nodes[stack[k]].tag in ("table", "article", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in ("html", "body") and len(nodes) > 1 and tag == "html":
            continue
        if tag in SILENT:
            if not attrs.rstrip().endswith("/") and tag != "head":
                skip = tag
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    close(k)
                    break
                if nodes[stack[k]].tag in BLOCKS:
                    break
        ends, walls = IMPLIED.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            if nodes[stack[k]].tag in ends:
                close(k)
                break
            if nodes[stack[k]].tag in walls:
                break
        parent = stack[-1]
        if tag == "br":
            nodes[parent].kids.append(" ")
            nodes[parent].tags += 1
            continue
        number = len(nodes)
        nodes.append(Node(tag, parent, len(stack), sum(not isinstance(k, str) for k in nodes[parent].kids), attribute_names(attrs) if attrs else ()))
        nodes[parent].kids.append(number)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(number)
    if skip is None and at < len(page):
        text(page[at:])
    return nodes


def iter_tokens(page: str) -> Iterator[tuple]:
    """start, end, closing, tag, attributes of tags; tag None for comments and declarations.  The
    inside of raw elements is passed over."""
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            return
        tag = m[2] or m[5]
        if tag is None:
            yield m.start(), m.end(), False, None, ""
            at = m.end()
            continue
        tag, closing, attrs = tag.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        yield m.start(), m.end(), closing, tag, attrs
        at = m.end()
        if tag in RAW and not closing and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            if end is None:
                yield at, len(page), True, None, ""
                return
            at = end.start()


def measure(nodes: list[Node]) -> None:
    """Adds up every subtree, children before parents."""
    for number in range(len(nodes) - 1, -1, -1):
        n = nodes[number]
        own = [k for k in n.kids if isinstance(k, str)]
        for t in own:
            size = len(t) if t.strip() else 0
            n.chars += size
            if size:
                n.commas += t.count(",")
                n.ends += len(SENTENCE_ENDS.findall(t))
                n.longest = max(n.longest, size)
        if n.tag == "a":
            n.linked, n.links = n.chars, n.links + 1
        n.paragraphs += n.tag == "p"
        n.inputs += n.tag in ("input", "button", "textarea", "form", "label")
        kids = [nodes[k] for k in n.kids if not isinstance(k, str)]
        n.same = len(kids)
        if n.parent >= 0:
            p = nodes[n.parent]
            for f in ("chars", "linked", "links", "paragraphs", "commas", "ends", "inputs"):
                setattr(p, f, getattr(p, f) + getattr(n, f))
            p.tags += n.tags + 1
            p.longest = max(p.longest, n.longest)


def numbers(nodes: list[Node]) -> list[list[float]]:
    """What the boosters see besides tags and attribute names; each row also knows its parent."""
    whole = max(nodes[0].chars, 1)
    total = len(nodes)
    rows = []
    for number, n in enumerate(nodes):
        p = nodes[n.parent] if n.parent >= 0 else n
        rest = max(p.chars, 1)
        rows.append([
            np.log1p(n.chars), n.chars / whole, n.chars / rest, n.linked / max(n.chars, 1), n.chars / (n.tags + 1), np.log1p(n.tags), np.log1p(n.links), n.links / (n.tags + 1),
            np.log1p(n.paragraphs), n.commas / (n.chars / 100 + 1), n.ends / (n.chars / 100 + 1), np.log1p(n.ends), float(n.inputs), np.log1p(n.longest), n.depth, n.nth, p.same,
            n.nth / max(p.same, 1), number / total, p.linked / rest, rest / (p.tags + 1), np.log1p(p.paragraphs), float(p.inputs), n.same,
        ])
    return rows


WIDTH = 24  # of a row of numbers


@dataclass
class Tree:
    """A full binary tree: feature and limit by inner node, value by leaf."""

    features: np.ndarray
    limits: np.ndarray
    values: np.ndarray


class Booster:
    """Gradient boosting of full trees on the logistic loss, by histograms."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.25, bins: int = 24):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins
        self.trees: list[Tree] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Booster:
        """The first WIDTH columns are numbers, the others 0 or 1."""
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x[:, :WIDTH].T]
        coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x[:, :WIDTH].T)], axis=1)
        flags = np.ascontiguousarray(x[:, WIDTH:], np.float64)
        share = np.average(y, weights=weight)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            place = np.zeros(len(y), np.int64)
            features, limits = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                size = 2**level
                gain, feature, cut = np.full(size, 1e-6), np.zeros(size, np.int64), np.full(size, -1)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    width = len(c) + 1
                    slot = place * width + coded[:, f]
                    gs = np.bincount(slot, g, size * width).reshape(size, width)
                    hs = np.bincount(slot, h, size * width).reshape(size, width)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    won = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    at = won.argmax(1)
                    better = won[np.arange(size), at] > gain
                    gain[better], feature[better], cut[better] = won[np.arange(size), at][better], f, at[better]
                held = np.zeros((size, len(y)))
                held[place, np.arange(len(y))] = 1
                gr, hr = (held * g) @ flags, (held * h) @ flags
                gt, ht = (held @ g)[:, None], (held @ h)[:, None]
                won = gr**2 / (hr + 1) + (gt - gr) ** 2 / (ht - hr + 1) - gt**2 / (ht + 1)
                at = won.argmax(1)
                better = won[np.arange(size), at] > gain
                feature[better], cut[better] = WIDTH + at[better], 0
                base = size - 1
                for k in range(size):
                    if cut[k] >= 0:
                        features[base + k] = feature[k]
                        limits[base + k] = cuts[feature[k]][cut[k]] if feature[k] < WIDTH else 0.5
                right = x[np.arange(len(y)), features[base + place]] > limits[base + place]
                place = 2 * place + right
            leaves = 2**self.depth
            values = self.rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + 1)
            margin += values[place]
            self.trees.append(Tree(features, limits, values))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in self.trees:
            place = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                inner = 2**level - 1 + place
                place = 2 * place + (x[rows, t.features[inner]] > t.limits[inner])
            margin += t.values[place]
        return 1 / (1 + np.exp(-margin))


class Extractor:
    def __init__(self, names: list[str]):
        self.names = {n: k for k, n in enumerate(names)}
        self.tags = {t: k for k, t in enumerate(TAGS)}
        self.taken, self.left = Booster(), Booster()

    def matrix(self, pages: list[list[Node]]) -> np.ndarray:
        """Numbers, tags, own and inherited attribute names of all nodes of some pages."""
        n = sum(map(len, pages))
        x = np.zeros((n, WIDTH + 2 * len(self.tags) + 2 * len(self.names)), np.float32)
        x[:, :WIDTH] = [r for nodes in pages for r in numbers(nodes)]
        t, own = WIDTH, WIDTH + 2 * len(self.tags)
        above = own + len(self.names)
        at = 0
        for nodes in pages:
            first = at
            for node in nodes:
                row = x[at]
                if node.parent >= 0:
                    # Ancestors' tags and names come down with the parent's row.
                    up = x[first + node.parent]
                    row[t + len(self.tags) : own] = np.maximum(up[t + len(self.tags) : own], up[t : t + len(self.tags)])
                    row[above:] = np.maximum(up[above:], up[own:above])
                k = self.tags.get(node.tag)
                if k is not None:
                    row[t + k] = 1
                for name in node.names:
                    k = self.names.get(name)
                    if k is not None:
                        row[own + k] = 1
                at += 1
        return x

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [parse(p) for p in pages]
        for nodes in trees:
            measure(nodes)
        x = self.matrix(trees)
        taken, left = self.taken.predict(x), self.left.predict(x)
        out, at = [], 0
        for nodes in trees:
            out.append(decode(nodes, taken[at : at + len(nodes)], left[at : at + len(nodes)]))
            at += len(nodes)
        return out


def decode(nodes: list[Node], taken: np.ndarray, left: np.ndarray) -> str:
    """The likeliest consistent choice by characters, as text."""
    cost = [0.0] * len(nodes)
    choice = [""] * len(nodes)
    cost_in, cost_out = -np.log(np.maximum(taken, 1e-9)), -np.log(np.maximum(left, 1e-9))
    for number in range(len(nodes) - 1, -1, -1):
        n = nodes[number]
        kids = [k for k in n.kids if not isinstance(k, str)]
        options = [(n.chars * cost_in[number], "in"), (n.chars * cost_out[number], "out")]
        loose = sum(len(k) for k in n.kids if isinstance(k, str) and k.strip())
        if kids and n.tag not in ("p", "a", "li", "h1", "h2", "h3"):
            # Text of its own between children follows the node's own better half.
            options.append((sum(cost[k] for k in kids) + loose * min(cost_in[number], cost_out[number]) + 0.01, "open"))
        cost[number], choice[number] = min(options)
    blocks: list[list[str]] = [[]]

    def walk(number: int, mode: str) -> None:
        todo = [(number, mode, False)]
        while todo:
            item, mode, done = todo.pop()
            if isinstance(item, str):
                blocks[-1].append(item)
                continue
            n = nodes[item]
            if done:
                blocks.append([])
                continue
            now = mode if mode != "open" else choice[item]
            if now == "out":
                if n.tag in BLOCKS:
                    blocks.append([])
                continue
            block = n.tag in BLOCKS
            if block:
                blocks.append([])
                todo.append((item, mode, True))
            own = now == "in" or cost_in[item] <= cost_out[item]
            for k in reversed(n.kids):
                if not isinstance(k, str):
                    todo.append((k, now, False))
                elif own:
                    todo.append((k, now, False))

    walk(0, "open")
    made = [" ".join("".join(b).split()) for b in blocks]
    return "\n".join(b for b in made if b)


def extract(page: Column, model: Extractor) -> Column:
    """Main text of a page's whole html (null: empty)."""

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in pages:
            some = [p if isinstance(p, str) else None for p in some]
            yield pd.Series([t for at in range(0, len(some), 64) for t in model.texts(some[at : at + 64])], dtype="object")

    return run(page)


def main_texts(pages: DataFrame, model: Extractor) -> DataFrame:
    """page_id, url, text, n_chars for every row; null, empty and markup-only pages give an empty text."""
    return pages.select("page_id", "url", extract(F.col("html"), model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
