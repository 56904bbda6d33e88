"""Main text of web pages by boosted trees over DOM-node features.

Each block-level node gets features of itself (tag, attribute tokens, depth,
density of text and links in its subtree), of its siblings and of what is above it.
Boosted trees give the log odds that a node belongs to the main text if its parent
does. Decoding is hierarchical: a node's chance is its own times its parent's, so it
is never above its parent's, and keeping nodes whose chance is over a half can't
contradict a choice above or below them.

The trees are trained here, on pages that a seeded generator writes with known
main text, in many layouts of common page furniture.

Defined cases: null and empty html give an empty text; rows without a page_id are
left out; repeated rows are each extracted; ties between keeping and dropping
drop; unclosed and stray tags are read as browsers do in the common cases; an
empty table gives no rows. Other columns are not read (``url`` is, if it is there).
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import boosting
from loomstead.llm.common import slices
from loomstead.llm.dom import Node, parse

# Tags and attribute tokens that are features of their own.
TAGS = (
    "html head body article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section "
    "script style textarea title select button option table td th tr tbody ul noscript iframe template dialog details label"
).split()
TOKENS = (
    "ad ads advert advertisement sponsor sponsored promo banner nav navigation menu breadcrumb breadcrumbs header masthead footer bottom copyright sidebar side rail aside widget related "
    "recommended more share social follow comment comments reply replies discussion disqus cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup login "
    "search form tags category categories pagination pager archive author byline meta date hidden skip toolbar "
    "article content main post entry story body text page primary container wrapper inner row col layout"
).split()
_TAG_PLACE, _TOKEN_PLACE = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(TOKENS)}
_ABOVE = {t: i for i, t in enumerate("article main nav header footer aside form section ul table figure blockquote".split())}
NUMBERS = 24
#: Nodes whose features are made at once.
SLICE_NODES = 1 << 15


class Features:
    """Features of the nodes of some pages: numbers, the tag, its own attribute tokens, tokens and tags above it; made for a slice of nodes at a time."""

    WIDTH = NUMBERS + len(TAGS) + 2 * len(TOKENS) + len(_ABOVE)

    def __init__(self, pages: list[list[Node]]):
        self.size = size = sum(map(len, pages))
        own = np.zeros((9, size), np.float32)  # chars, words, links, link chars, commas, is p, depth, children, inline
        self.parent, self.page, ends = (np.zeros(size, np.int32) for _ in range(3))
        tag, codes, same = np.full(size, -1, np.int16), np.zeros(size, np.int16), {}
        self.tokens, self.above, self.tags_above = [0] * size, [0] * size, [0] * size
        base, first, known = 0, [], {}
        for nodes in pages:
            first.append(base)
            for i, d in enumerate(nodes, base):
                if d.runs:
                    own[0, i] = sum(len(t) for _, t in d.runs)
                    own[1, i] = sum(t.count(" ") + 1 for _, t in d.runs)
                    own[4, i] = sum(t.count(",") + t.count(". ") for _, t in d.runs)
                own[2, i], own[3, i], own[5, i], own[6, i], own[7, i], own[8, i] = d.links, d.link_chars, d.tag == "p", d.depth, d.n_children, d.inline
                up = base + d.parent.order if d.parent else i
                self.parent[i], ends[i] = up, base + d.end
                tag[i], codes[i] = _TAG_PLACE.get(d.tag, -1), same.setdefault(d.tag, len(same))
                mine = 0
                for t in d.tokens:
                    at = _TOKEN_PLACE.get(t)
                    if at is not None:
                        mine |= 1 << at
                self.tokens[i] = known.setdefault(mine, mine)
                if up != i:
                    over = self.above[up] | self.tokens[up]
                    self.above[i] = known.setdefault(over, over)
                    at = _ABOVE.get(d.parent.tag)
                    self.tags_above[i] = self.tags_above[up] | (1 << at if at is not None else 0)
            self.page[base : base + len(nodes)] = base
            base += len(nodes)
        self.own, self.tag = own, tag
        # place among the siblings, siblings, and those of the same tag; a root has itself alone
        family = self.parent.astype(np.int64)
        family[first] = size + np.arange(len(first))
        order = np.argsort(family, kind="stable")
        ranked = family[order]
        self.place, self.siblings, self.same = (np.empty(size, np.int32) for _ in range(3))
        starts = np.searchsorted(ranked, ranked)
        self.place[order] = np.arange(size) - starts
        self.siblings[order] = np.searchsorted(ranked, ranked, side="right") - starts
        _, back, n = np.unique(family * max(1, len(same)) + codes, return_inverse=True, return_counts=True)
        self.same[:] = n[back]
        start = np.arange(size)

        def subtree(v):
            total = np.concatenate([[0], np.cumsum(v, dtype=np.float64)])
            return (total[ends] - total[start]).astype(np.float32)

        self.below = [subtree(v) for v in (*own[:6], np.ones(size, np.float32))]

    def rows(self, a: int, b: int) -> np.ndarray:
        """A row for each node from a to b."""
        at, up, page = slice(a, b), self.parent[a:b], self.page[a:b]
        chars, words, links, link_chars, commas, paragraphs, n = self.below
        some, whole = lambda i: np.maximum(1.0, chars[i]), np.maximum(1.0, chars[page])
        own = self.own[:, at]
        numbers = (
            own[6], own[7], self.siblings[at], self.place[at] / np.maximum(1, self.siblings[at] - 1), self.same[at] / self.siblings[at], (np.arange(a, b) - page) / n[page],
            np.log1p(own[0]), np.log1p(own[1]), np.log1p(chars[at]), chars[at] / whole, chars[at] / n[at],
            link_chars[at] / some(at), links[at] / np.maximum(1.0, words[at] / 10), commas[at] / np.maximum(1.0, words[at]), np.log1p(paragraphs[at]), paragraphs[at] / n[at],
            np.log1p(chars[up]), link_chars[up] / some(up), np.log1p(paragraphs[up]), chars[up] / whole, chars[at] / some(up),
            own[8], own[2], np.log1p(n[at]),
        )
        x = np.zeros((b - a, self.WIDTH), np.float32)
        for j, v in enumerate(numbers):
            x[:, j] = v
        known = np.flatnonzero(self.tag[at] >= 0)
        x[known, NUMBERS + self.tag[at][known]] = 1
        column = NUMBERS + len(TAGS)
        for masks, bits in ((self.tokens, len(TOKENS)), (self.above, len(TOKENS)), (self.tags_above, len(_ABOVE))):
            width = (bits + 7) // 8
            packed = np.frombuffer(b"".join([m.to_bytes(width, "little") for m in masks[at]]), np.uint8).reshape(-1, width)
            x[:, column : column + bits] = np.unpackbits(packed, axis=1, count=bits, bitorder="little")
            column += bits
        return x


def features(pages: list[list[Node]]) -> np.ndarray:
    made = Features(pages)
    return made.rows(0, made.size)


def log_odds(trees: boosting.Trees, pages: list[list[Node]]) -> np.ndarray:
    """Of each node of some pages; SLICE_NODES rows of features exist at a time."""
    made = Features(pages)
    parts = [trees.log_odds(made.rows(a, min(a + SLICE_NODES, made.size))) for a in range(0, made.size, SLICE_NODES)]
    return np.concatenate([np.zeros(0), *parts])


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Whether each node is kept: its chance given its parent's, times the chances above it, is over a half."""
    odds = np.where([d.tag in ("#root", "html", "body") for d in nodes], 50.0, odds)  # the page itself is no choice
    chance = np.exp(-np.logaddexp(0, -odds))
    for i, d in enumerate(nodes):
        if d.parent is not None:
            chance[i] *= chance[d.parent.order]
    return chance > 0.5


# ---- training pages

_SYLLABLES = "an ber con da el fi gro ha in jo ka lu men no or pa qui re sto ta un ve wi xo yl zu schaft tion ment able ing".split()
_CHROME = {
    "nav": ["<nav class='main-nav'>{links}</nav>", "<nav>{links}</nav>", "<div class='menu'>{links}</div>", "<div id='navigation'>{links}</div>", "<ul class='nav menu'>{items}</ul>", "<div class='breadcrumbs'>{inline}</div>"],
    "header": ["<header>{title}{inline}</header>", "<div id='header'>{title}</div>", "<header class='masthead'><p>{short}</p></header>", "<div class='header banner'><h2>{short}</h2></div>"],
    "footer": ["<footer>&copy; {short} &middot; {sentence}</footer>", "<footer><p>{sentence}</p>{links}</footer>", "<div class='footer'>{sentence}</div>", "<div id='bottom'><p>&copy; {short}</p></div>"],
    "side": ["<aside>{links}</aside>", "<aside><h3>{short}</h3><p>{sentence}</p></aside>", "<div class='sidebar'><h3>{short}</h3>{links}<p>{sentence}</p></div>", "<div id='related' class='widget'><h4>{short}</h4>{items}</div>", "<section class='recommended'>{links}</section>"],
    "ad": ["<div class='ad'>{sentence}</div>", "<div class='advert sponsored'><p>{sentence}</p></div>", "<div id='banner-ad'>{sentence}</div>", "<section class='promo'><p>{sentence}</p></section>", "<p class='ads'>{sentence}</p>"],
    "notice": ["<div class='cookie-notice'><p>{sentence}</p><button>{short}</button></div>", "<div id='consent' role='dialog'>{sentence}</div>", "<div class='newsletter popup'><h3>{short}</h3><p>{sentence}</p></div>", "<div class='alert notice'>{sentence}</div>"],
    "form": ["<form>{short}<input name=q><button>{short}</button></form>", "<form class='search'><label>{short}</label><select><option>{short}</option><option>{short}</option></select></form>", "<form id='subscribe'><p>{sentence}</p><textarea>{short}</textarea></form>", "<fieldset><legend>{short}</legend>{sentence}</fieldset>"],
    "comments": ["<div class='comments'><h3>{short}</h3><div class='comment'><p>{sentence}</p></div><div class='comment'><p>{sentence} {sentence}</p></div></div>", "<section id='comments'><ol><li><p>{sentence}</p></li><li><p>{sentence}</p></li></ol></section>", "<div class='discussion'><p>{sentence}</p><p>{sentence}</p></div>", "<ul class='replies'><li>{sentence}</li></ul>"],
    "share": ["<div class='share social'>{inline}</div>", "<div class='tags'>{inline}</div>", "<div class='pagination'>{inline}</div>"],
    "code": ["<script>var a='<p>';f(1);</script>", "<style>p{{margin:0}}</style>", "<noscript>{sentence}</noscript>", "<!-- ad 1 -->", "<iframe>{short}</iframe>"],
}
_MAINS = ["<article>{0}</article>", "<main>{0}</main>", "<main><article>{0}</article></main>", "<div class='content'>{0}</div>", "<div id='main'><div class='post entry'>{0}</div></div>", "<section class='article-body'>{0}</section>", "<article class='story'><div class='text'>{0}</div></article>", "<div class='container'><div class='row'><article>{0}</article>{1}</div></div>", "<div class='page'><div id='primary'>{0}</div>{1}</div>"]
_BLOCKS = ["<p>{0}</p>", "<p>{0}</p>", "<p>{0}</p>", "<p>{0}", "<p><b>{0}</b></p>", "<h2>{0}</h2>", "<h3>{0}</h3>", "<ul><li>{0}</li><li>{0}</li></ul>", "<blockquote><p>{0}</p></blockquote>", "<pre>{0}</pre>", "<p>{0}<br>{0}</p>", "<p><b>{0}<br>", "<figure><figcaption>{0}</figcaption></figure>", "<table><tr><td>{0}</td><td>{0}</td></tr></table>", "<div>{0}</div>", "<ol><li>{0}<li>{0}</ol>", "<section><h2>{0}</h2><p>{0}</p></section>", "<p>{0} <a href='/x'>{1}</a> {0}</p>"]


def training_page(r: random.Random) -> str:
    """A page whose main text is marked by the character U+E000 at the start of each of its words."""

    def word(mark=""):
        return mark + "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))

    def sentence(low, high, mark=""):
        return " ".join(word(mark) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))).capitalize() + "."

    def furniture(kind):
        links = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(r.randint(2, 8)))
        inline = " ".join(f"<a href='#'>{word()}</a>" for _ in range(r.randint(1, 5)))
        return r.choice(_CHROME[kind]).format(links=f"<ul>{links}</ul>", items=links, inline=inline, title=f"<h2>{word()}</h2>", short=sentence(1, 3), sentence=sentence(3, 40))

    def block():
        text = lambda: " ".join(sentence(1, r.choice([1, 2, 5, 14]), "") for _ in range(r.choice([1, 1, 2, 6])))
        return r.choice(_BLOCKS[: 4 if r.random() < 0.6 else None]).format(text(), sentence(1, 3, ""))

    titled = r.random() < 0.8
    main = (f"<h1>{sentence(1, 10, chr(0xE000))}</h1>" if titled else "") + "".join(
        block() + (furniture(r.choice(["ad", "share", "code", "side", "form"])) if r.random() < 0.06 else "") for _ in range(r.choice([1 - titled, 1, 1, 2, 4, 8, 16]))
    )
    if r.random() < 0.2:
        main += furniture("comments")
    some = lambda kinds: "".join(furniture(k) for k in kinds if r.random() < 0.5)
    body = r.choice(_MAINS).format(main, furniture("side"))
    page = some(["notice", "header", "nav", "code", "form", "ad", "ad"]) + body + some(["comments", "share", "side", "ad", "nav", "notice", "form", "footer", "footer", "code"])
    head = f"<head><meta charset=utf-8><title>{sentence(1, 8)}</title>{furniture('code') if r.random() < 0.5 else ''}</head>"
    return f"<!DOCTYPE html><html lang=en>{head}<body>{page}" + ("</body></html>" if r.random() < 0.8 else "")


def train(pages: int = 400, seed: int = 11) -> boosting.Trees:
    """The trees, from generated pages. A node counts if its parent holds main text, and is main text if most of the text below it is."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(training_page(r))
        n = len(nodes)
        marked, chars = np.zeros(n + 1), np.zeros(n + 1)
        for d in nodes:
            chars[d.order + 1] = sum(len(t) for _, t in d.runs)
            marked[d.order + 1] = sum(len(t) for _, t in d.runs if "" in t)
            d.runs = [(p, t.replace("", "")) for p, t in d.runs]
        marked, chars = np.cumsum(marked), np.cumsum(chars)
        ends, start = np.array([d.end for d in nodes]), np.arange(n)
        inside, total = marked[ends] - marked[start], chars[ends] - chars[start]
        wrapper = np.array([not d.runs for d in nodes])
        # a wrapper leads to main text if it holds any; a node with text of its own must be main text
        y = np.where(wrapper, inside > 0, inside > 0.5 * total) & (total > 0)
        asked = np.array([d.parent is not None and (y[d.parent.order] or d.parent.parent is None) for d in nodes])
        xs.append(features([nodes])[asked])
        ys.append(y[asked])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def main_text(nodes: list[Node], odds: np.ndarray) -> str:
    kept = decode(nodes, odds)
    runs = sorted(run for d, k in zip(nodes, kept) if k for run in d.runs)
    return "\n\n".join(t for _, t in runs)


def extract(pages: DataFrame, trees: boosting.Trees | None = None) -> DataFrame:
    """page_id, url, text of every row of (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or train())

    def run(batches):
        found = shared.value
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                parsed = [parse(h or "") for h in batch.column(2).to_pylist()]
                sizes = np.cumsum([0, *map(len, parsed)])
                odds = log_odds(found, parsed)
                texts = [main_text(p, odds[a:b]) for p, a, b in zip(parsed, sizes[:-1], sizes[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    return pages.where("page_id is not null").select("page_id", url, "html").mapInArrow(run, "page_id long, url string, text string")
