"""Generated pages of many layouts, with the article's text marked, to train the extractor on."""

from __future__ import annotations

import random
from collections import Counter
from functools import lru_cache

import numpy as np

from .html_text import Extractor, measure, parse

#: Pages generated for training, and attribute names that the boosters may look at.
PAGES, NAMES = 1200, 120
#: Article text is generated between these marks, which no other text holds.
OPEN, CLOSE = "", ""

# Attribute names by the part of a page that they stand for.
PARTS = {
    "menu": "menu nav navbar navigation breadcrumbs breadcrumb topbar toolbar tabs skip links",
    "header": "header masthead banner top site-header branding logo page-header hero-top",
    "footer": "footer bottom copyright legal site-footer colophon page-footer credits imprint",
    "side": "sidebar side widget aside rail secondary related recommended popular trending archive tags tagcloud",
    "notice": "notice cookie cookie-banner consent alert gdpr message popup modal newsletter subscribe paywall overlay disclaimer",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox commercial",
    "form": "search login signup contact form feedback poll survey",
    "share": "share social sharing buttons toolbar meta-links actions",
    "comments": "comments comment respond discussion replies reply thread disqus user-comments reader-comments comment-list",
    "article": "article content main post entry story text body article-body post-content entry-content page-content main-content single",
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = [a + b for a in "b d f g h k l m n p r s t v".split() for b in "a e i o u an en or é ü".split()]
        self.words = ["".join(self.r.choices(parts, k=self.r.randint(1, 3))) for _ in range(600)]

    def run(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        return " ".join(w + ("," if self.r.random() < 0.06 else "") for w in words)

    def sentences(self, low: int, high: int) -> str:
        text = " ".join(self.run(3, 18).capitalize() + "." for _ in range(self.r.randint(low, high)))
        return text.replace(" ", " &amp; ", 1) if self.r.random() < 0.1 else text

    def attrs(self, part: str, likely: float = 0.75) -> str:
        if self.r.random() > likely:
            return self.r.choice(["", ' class="row"', ' class="box col"', ' class="wrap"', ' id="x1"'])
        name = self.r.choice(PARTS[part].split())
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="box {name}"', f" class={name.split('-')[0]}", f' class="{name} {self.r.choice(PARTS[part].split())}"'])

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.r.choice(self.words)}">{self.run(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}" + ("</li>" if self.r.random() < 0.8 else "") for i in items) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(items)

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return r.choice([f"<nav{self.attrs(kind, 0.3)}>{self.links()}</nav>", f"<div{self.attrs(kind)}>{self.links()}</div>", f"<ul{self.attrs(kind, 1)}><li>{self.links(1, 3)}</li></ul>"])
        if kind == "header":
            inner = f"<a href='/'>{self.run(1, 3)}</a>" + r.choice(["", f"<p>{self.run(2, 9)}</p>", f"<h2>{self.run(1, 4)}</h2>", self.links(2, 5)])
            return r.choice([f"<header{self.attrs(kind, 0.4)}>{inner}</header>", f"<div{self.attrs(kind, 0.95)}>{inner}</div>"])
        if kind == "footer":
            inner = r.choice(["&copy; ", "&#169; 20", "", "Copyright "]) + self.run(1, 4) + r.choice(["", " &middot; ", "<br>", " | "]) + r.choice([self.sentences(1, 4), self.links(2, 6), self.run(2, 8), f"<p>{self.sentences(1, 3)}</p>"])
            return r.choice([f"<footer{self.attrs(kind, 0.3)}>{inner}</footer>", f"<div{self.attrs(kind, 0.95)}>{inner}</div>"])
        if kind == "side":
            inner = f"<h3>{self.run(1, 3)}</h3>" + r.choice([self.links(), f"<p>{self.sentences(1, 3)}</p>", self.links(2, 4) + f"<p>{self.sentences(1, 2)}</p>"])
            return r.choice([f"<aside{self.attrs(kind, 0.5)}>{inner}</aside>", f"<div{self.attrs(kind, 0.97)}>{inner}</div>", f"<section{self.attrs(kind, 1)}>{inner}</section>"])
        if kind in ("notice", "ad"):
            inner = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.sentences(1, 1) + f" <a href='/p'>{self.run(1, 3)}</a>", f"<p>{self.run(3, 12)}</p><button>{self.run(1, 2)}</button>"])
            tag = r.choice(["div", "div", "section", "p", "aside"])
            return f"<{tag}{self.attrs(kind, 1)}>{inner}</{tag}>"
        if kind == "form":
            inner = "".join(f"<label>{self.run(1, 3)}</label><input name='{r.choice(self.words)}'>" for _ in range(r.randint(1, 4))) + r.choice(["", f"<p>{self.sentences(1, 2)}</p>"]) + f"<button>{self.run(1, 2)}</button>"
            return f"<form{self.attrs(kind, 0.4)}>{inner}</form>"
        if kind == "share":
            return f"<div{self.attrs(kind, 1)}>{self.links(2, 5)}</div>"
        remarks = []
        for _ in range(r.randint(1, 6)):
            body = r.choice([f"<p>{self.sentences(1, 5)}</p>", f"<b>{self.run(1, 2)}</b><p>{self.sentences(1, 4)}</p>", self.sentences(1, 4)])
            tag = r.choice(["div", "li", "div", "li", "div", "article"])
            remarks.append(f"<{tag}{self.attrs('comments', 1 if tag == 'article' else 0.8)}>{body}</{tag}>")
        tag = r.choice(["div", "section", "ol"])
        return f"<{tag}{self.attrs('comments', 1)}>" + r.choice(["", f"<h3>{self.run(1, 3)}</h3>"]) + "".join(remarks) + r.choice(["", self.part("form")]) + f"</{tag}>"

    def marked(self, text: str) -> str:
        return f"{OPEN}{text}{CLOSE}"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        end = r.random() < 0.9
        if kind < 0.72:
            text = self.marked(self.sentences(1, 9) if r.random() < 0.75 else self.run(1, 9) + ".")
            if r.random() < 0.15:
                text = f"<b>{text}" + r.choice(["</b>", "<br>", ""])
            elif r.random() < 0.2:
                text += f' <a href="/x">{self.marked(self.run(1, 4))}</a> ' + self.marked(self.run(2, 9) + ".")
            return f"<p>{text}" + ("</p>" if end else "")
        if kind < 0.82:
            tag = r.choice(["h2", "h3", "h4"])
            return f"<{tag}>{self.marked(self.run(1, 7))}</{tag}>"
        if kind < 0.9:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.marked(self.run(2, 14))}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote><p>{self.marked(self.sentences(1, 3))}</p></blockquote>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.marked(self.run(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return r.choice([f"<pre>{self.marked(self.run(4, 20))}</pre>", f"<figure><figcaption>{self.marked(self.run(3, 9))}</figcaption></figure>"])

    def article(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.part(r.choice(["ad", "side", "share", "notice"])))
        head = r.choice([f"<h1>{self.marked(self.run(2, 12))}</h1>"] * 3 + [""])
        if r.random() < 0.15:
            head = f"<header>{head}</header>"
        body = head + "".join(blocks)
        kind = r.random()
        if kind < 0.6:
            body = f"<article{self.attrs('article', 0.3) if r.random() < 0.4 else ''}>{body}</article>"
        elif kind < 0.9:
            body = f"<div{self.attrs('article', 0.85)}>{body}</div>"
        if r.random() < 0.3:
            body = f"<main>{body}</main>"
        return body

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("header", 0.5), ("menu", 0.8), ("notice", 0.3), ("ad", 0.4), ("form", 0.15), ("side", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.25), ("side", 0.4), ("comments", 0.4), ("ad", 0.3), ("form", 0.2), ("notice", 0.15), ("footer", 0.85)) if r.random() < p]
        body = "".join(map(self.part, before)) + (self.article() if r.random() < 0.97 else "") + "".join(map(self.part, after))
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.attrs('article', 0.2)}>{body}</div>"
        head = f"<title>{self.run(1, 6)}</title><style>p{{margin:0}}</style><script>var a=\"</p>\";</script>"
        page = f"<!DOCTYPE html><html><head>{head}</head><body><!-- x -->{body}</body></html>"
        return page[: -r.randint(0, 30)] if r.random() < 0.2 else page


def labelled(page: str):
    """Nodes without the marks, and each one's characters of article."""
    nodes = parse(page)
    inside = [0] * len(nodes)
    for number, n in enumerate(nodes):
        for k, kid in enumerate(n.kids):
            if isinstance(kid, str) and (OPEN in kid or CLOSE in kid):
                inside[number] += sum(len(p.split(CLOSE)[0]) for p in kid.split(OPEN)[1:])
                n.kids[k] = kid.replace(OPEN, "").replace(CLOSE, "")
    for number in range(len(nodes) - 1, 0, -1):
        inside[nodes[number].parent] += inside[number]
    measure(nodes)
    return nodes, inside


@lru_cache(maxsize=1)
def trained(seed: int = 11, pages: int = PAGES) -> Extractor:
    """The extractor, trained on generated pages; the same on every run."""
    made = Pages(seed)
    known = [labelled(made.page()) for _ in range(pages)]
    counts = Counter(name for nodes, _ in known for n in nodes for name in set(n.names))
    model = Extractor([n for n, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c >= 5][:NAMES])
    x = model.matrix([nodes for nodes, _ in known])
    chars = np.array([n.chars for nodes, _ in known for n in nodes], float)
    inside = np.array([i for _, held in known for i in held], float)
    weight = np.where(chars > 0, 1 + np.log1p(chars), 0)
    use = weight > 0
    share = inside[use] / chars[use]
    weight = weight[use] / weight[use].mean()
    model.taken.fit(x[use], (share > 0.97).astype(float), weight)
    model.left.fit(x[use], (share < 0.03).astype(float), weight)
    return model
