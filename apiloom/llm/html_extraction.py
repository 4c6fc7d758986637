"""Main-text extraction with a tree-structured graphical model over the block elements of a page.

Each block element is a binary variable, content or not. Its own potential adds learned weights of the tag and
the words of class, id and role of the element and of its parent, how long its text is and how much of it are links, and which share of
the page's text lies in it; an edge to its parent has a learned 2x2 potential, so that a subtree leans as a whole.
Messages pass up and then down the tree once (sum-product, exact on a tree) and give each element's marginal; text of
elements above one half is the result.

The weights maximise the likelihood of labelled pages, the gradient being observed minus expected features under the
same message passing. Labelled pages are (a) at most `max_pages` pages of the table (default 60, the smallest hashes;
pages of up to 65,536 characters first) that mark their article with the element of that name, where elements inside it
are content and all others, and menus, asides, forms and the like inside it, are not; (b) the small pages of
LABELLED_PAGES, where content is marked by hand; and (c) six made-up layouts of each of their articles: the article in a
container of another name or of none, its paragraphs as `p`, `div`, `span`, nested `div` or bare text between `br`, with
menus, notices, adverts, forms and reader comments around it and inside it, so that no element, name or place alone decides;
and each article as the bare text of a page. All pages are one forest, and a gradient step passes messages depth by depth.
The extraction itself runs over all pages. Comments inside the article's own element are told from it by their names or
elements: in a plain `div` of an unknown name they stay.

Defined results: null or empty html and pages without content give an empty text; unclosed elements end with their
container or page; repeated rows and null ids keep a row each; other columns are carried along.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import documents, in_batches, slices
from apiloom.llm.html_dom import Tree, attributes, block_text, parse

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_CONTENT = frozenset("nav aside footer form button select textarea menu noscript iframe dialog head title fieldset".split())

#: Pages labelled by hand: elements with the attribute `data-main` and all inside them are content, up to `data-off`.
LABELLED_PAGES = [
    """<html><body><header class="site-header"><div class="logo">The Site</div><ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></header>
    <div class="cookie-notice">We use cookies. <button>Accept</button></div>
    <div id="content" class="post-content" data-main><h1>A long walk</h1><p>The road went on over the hills, and we walked all day.</p><p>At night the wind fell, and it was quiet again.</p>
    <ul><li>Bread and cheese for two days</li><li>A map of the hills, folded twice</li></ul><div class="ad advert" data-off>Buy shoes now</div></div>
    <div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Ten tips</a></li><li><a href="/b">Best of</a></li></ul></div>
    <div id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>Great walk, thank you for writing about it.</p></div><div class="comment"><p>I was there too, last summer with friends.</p></div></div>
    <footer><p>Copyright, all rights reserved.</p></footer></body></html>""",
    """<html><body><nav><ul><li><a href="/">Start</a></li></ul></nav><main data-main><h1>Report</h1><p>Sales rose in the north and fell in the south this year.</p>
    <table><tr><td>North</td><td>Sales of the first half, as reported</td></tr></table><blockquote><p>We are pleased, said the head of the firm.</p></blockquote>
    <aside class="related" data-off><p>See also: older reports</p></aside><form class="newsletter signup" data-off><p>Subscribe to our letter</p></form></main>
    <aside class="widget promo"><p>Advertisement: a great offer for you today.</p></aside><footer class="footer">Imprint and terms</footer></body></html>""",
    """<html><body><div class="banner notice">This site is moving soon, please update your links.</div><div class="navbar nav"><a href="/">Home</a> <a href="/x">More</a></div>
    <article data-main><header><h1>Seeds</h1><p>By a gardener, in spring.</p></header><section class="article-body"><p>Sow them early, in a warm place, and keep the soil wet.</p><pre>water daily</pre></section>
    <section class="comments reader-comments" data-off><h2>Reader comments</h2><p>Mine never came up, what did I do wrong?</p></section>
    <div class="share social" data-off><a href="/s">Share</a></div><footer class="tags" data-off><a href="/t">garden</a></footer></article>
    <div class="login form"><p>Log in to write a comment.</p></div></body></html>""",
    """<html><body><div class="wrapper"><div class="top header"><p>Daily paper of the town and the valley</p></div><div class="main entry" data-main><h2>Bridge opened</h2>
    <p>The new bridge was opened on Sunday, and many people came.</p><p>It replaces the old one, which had stood for ninety years.</p><figure><figcaption>The bridge at noon</figcaption></figure></div>
    <div class="ads sponsored"><p>Sponsored: new cars at low rates, come and see.</p></div><div class="disqus comment-list"><p>About time that they built it, we waited for years.</p></div>
    <div class="bottom legal"><p>Terms of use, privacy and contact.</p></div></div></body></html>""",
]


#: Containers of made-up layouts.
_WRAPPERS = [
    "article", "main", "div", "section", 'div id="content"', 'div class="post-content"', 'div id="story"', 'div class="entry"', 'section class="article-body"',
    'div role="main"', 'article class="post"', 'div class="text column"', 'div id="main"', 'div class="story-body"', 'div class="page wide"', 'td', 'td class="text"', 'td class="body"', 'div class="c1"',
]
#: What stands around and inside articles and is no content; {a}, {b} are texts, {l} is a list of links.
_JUNK = [
    "<nav>{l}</nav>", '<div class="menu">{l}</div>', '<ul class="nav links">{l}</ul>', '<div id="navbar">{l}</div>', '<div class="breadcrumb">{l}</div>',
    "<aside>{t}</aside>", "<form>{t}</form>", '<nav><a href="/">{t}</a></nav>', "<aside><p>{a}</p></aside>", '<aside class="sidebar"><h3>{t}</h3>{l}</aside>', '<div class="sidebar widget"><h3>{t}</h3><p>{a}</p></div>', '<div class="related"><h3>{t}</h3>{l}</div>',
    '<div class="ad">{t}</div>', '<div class="advert">{t}</div>', '<div class="advert"><p>{a}</p></div>', '<div class="ads advertisement">{a}</div>', '<div class="sponsored promo"><p>{a}</p><p>{b}</p></div>', '<section class="banner">{t}</section>',
    '<div class="notice">{a}</div>', '<div class="cookie-notice"><p>{a}</p><button>{t}</button></div>', '<div id="consent" role="dialog"><p>{a}</p></div>', '<div class="alert warning">{t}</div>',
    "<form><p>{t}</p><input><button>{t}</button></form>", '<form class="newsletter"><p>{a}</p></form>', '<div class="newsletter"><p>{a}</p></div>', '<div class="subscribe signup"><p>{t}</p></div>', '<div class="login">{t}</div>', '<div class="search"><p>{t}</p></div>',
    '<section class="comments"><h2>{t}</h2><p>{a}</p><p>{b}</p></section>', '<div id="comments"><div class="comment"><p>{a}</p></div><div class="comment"><p>{b}</p></div></div>', '<ol class="comment-list"><li>{a}</li><li>{b}</li></ol>',
    '<div class="discussion replies"><p>{a}</p><blockquote><p>{b}</p></blockquote></div>', '<div class="disqus thread"><p>{a}</p></div>', '<div class="comments"><p>{a}</p></div>', '<div class="reader-comments responses"><p>{b}</p></div>',
    "<footer>{t}</footer>", '<footer class="footer"><p>{a}</p>{l}</footer>', '<div class="footer legal"><p>{a}</p></div>', '<div id="copyright">{t}</div>', '<div class="share social">{l}</div>', '<div class="tags">{l}</div>', '<div class="author bio"><p>{a}</p></div>',
]
#: Heads of pages.
_HEADS = ["<header><p>{t}</p></header>", '<header class="site"><h1>{t}</h1>{l}</header>', '<div class="header top"><div class="logo">{t}</div>{l}</div>', '<div class="masthead">{t}</div>', ""]


def restyled(inner: str, how: str) -> str:
    """The inner markup of an article with its paragraphs written another way."""
    if how == "bare":
        return re.sub(r"<p\b[^>]*>", "", inner).replace("</p>", "<br><br>")
    if how == "mixed":
        return re.sub(r"<p\b[^>]*>(.*?)</p>", r"\1<br>", inner, count=2, flags=re.S)
    if how == "span":
        return re.sub(r"<p\b[^>]*>", "<span>", inner).replace("</p>", "</span><br>")
    if how == "div":
        return re.sub(r"<p\b[^>]*>", "<div>", inner).replace("</p>", "</div>")
    if how == "nested":
        return "<div>" + re.sub(r"<p\b[^>]*>", "<div><div>", inner).replace("</p>", "</div></div>") + "</div>"
    return inner


_STYLES = ["p"] * 6 + ["bare", "bare", "bare", "mixed", "span", "div", "div", "nested"]
_NAMED = re.compile(r"""\s(?:class|id)=(?:"[^"]*"|'[^']*')""")


def made_layouts(articles: list[str], *, seed: int = 0, each: int = 6) -> list[str]:
    """Pages with these articles (their inner markup), with `data-main` and `data-off` as labels.

    Paragraphs are written in several ways. Names of containers are left out or made up at random, more often outside the
    article than in it, so that no list of names decides alone."""
    rng = random.Random(seed)
    plain = [re.sub(r"<[^>]*>", " ", a).split() for a in articles]
    plain = [w for w in plain if len(w) > 20] or [["text"] * 40]

    def words(low: int, high: int) -> str:
        w = rng.choice(plain)
        at = rng.randrange(len(w))
        return " ".join((w[at:] + w)[: rng.randint(low, high)])

    def unnamed(markup: str, often: float) -> str:
        if rng.random() >= often:
            return markup
        name = "".join(rng.choices("bcdfghklmnprstaeiou", k=rng.randint(3, 9)))
        return _NAMED.sub("" if rng.random() < 0.5 else f' class="{name}"', markup)

    def junk(template: str, often: float) -> str:
        links = lambda: "<ul>" + "".join(f'<li><a href="/">{words(1, 4)}</a></li>' for _ in range(rng.randint(1, 6))) + "</ul>" if rng.random() < 0.6 else " ".join(f'<a href="/">{words(1, 4)}</a>' for _ in range(rng.randint(1, 6)))
        made = template.format(a=words(4, 60), b=words(4, 60), t=words(1, 8), l=links() if "{l}" in template else "")
        return re.sub(r"^<(\w+)", r"<\1 data-off", unnamed(made, often))

    pages = []
    for article in articles:
        for _ in range(each):
            pieces = re.split(r"(?=<(?:p|h[1-6]|ul|ol|table|pre|figure|div|span)\b)", restyled(article, rng.choice(_STYLES)))
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                pieces.insert(rng.randint(1, len(pieces)), junk(rng.choice(_JUNK), 0.0))
            wrapper = rng.choice(_WRAPPERS)
            tag = wrapper.split()[0]
            inside = unnamed(f"<{wrapper} data-main>", 0.4) + f"{''.join(pieces)}</{tag}>"
            if rng.random() < 0.06:
                inside = f"<main data-main>{''.join(pieces)}</main>"
            elif tag == "td":
                inside = f"<table><tr>{inside}</tr></table>"
            elif rng.random() < 0.4:
                inside = f'<div class="{rng.choice(["wrapper", "container", "row", "layout", "page"])}">{inside}</div>'
            before = "".join(junk(rng.choice(_JUNK), 0.3) for _ in range(rng.randint(0, 3)))
            after = "".join(junk(rng.choice(_JUNK), 0.5) for _ in range(rng.randint(0, 4)))
            head = rng.choice(_HEADS)
            pages.append(f"<html><body>{junk(head, 0.1) if head else ''}{before}{inside}{after}</body></html>")
        pages.append(f"<html><body data-main>{restyled(article, rng.choice(['bare', 'span', 'mixed']))}</body></html>")
    return pages


def article_inside(page: str) -> str | None:
    """The inner markup of the page's article element or of the part marked by hand."""
    m = re.search(r"<article\b[^>]*>(.*)</article>", page, re.S | re.I)
    return m[1] if m else None


@lru_cache(4096)
def _own_names(tag: str, attrs: str) -> tuple[str, ...]:
    found = attributes(attrs) if attrs else {}
    words = {w.lower() for key in ("class", "id", "role") for w in _WORD.findall(found.get(key, ""))}
    return (f"tag={tag}", *(f"word={w}" for w in sorted(words)))


@lru_cache(4096)
def _parent_names(tag: str, attrs: str) -> tuple[str, ...]:
    return tuple(f"in {name}" for name in _own_names(tag, attrs))


def _features(tree: Tree, texts: list[str]) -> list[tuple[str, ...]]:
    size = [0] * len(tree.tags)
    for (node, _), text in zip(tree.blocks, texts, strict=True):
        size[node] += len(text)
    below = list(size)
    for i in range(len(below) - 1, 0, -1):
        below[tree.parent[i]] += below[i]
    whole = below[0] or 1
    paragraphs = [0] * len(tree.tags)
    largest = [0] * len(tree.tags)
    for i, tag in enumerate(tree.tags):
        if size[i] >= 40 and 2 * tree.links[i] < size[i]:
            paragraphs[tree.parent[i]] += tag in ("p", "div")
        if i:
            largest[tree.parent[i]] = max(largest[tree.parent[i]], below[i])
    out = []
    for i, tag in enumerate(tree.tags):
        n, linked = size[i], tree.links[i]
        share = "none" if not n else "no" if not linked else "some" if linked < n / 2 else "most"
        p = tree.parent[i]
        out.append((*_own_names(tag, tree.attributes[i]), *(_parent_names(tree.tags[p], tree.attributes[p]) if i else ()), f"size={min(8, n.bit_length())}", f"{tag} size={min(8, n.bit_length())}", f"links={share}", f"share={-(-4 * below[i] // whole)}", f"paragraphs={min(3, paragraphs[i])}", f"own={min(4, -(-4 * n // whole))}", f"first={i == 0 or below[i] == largest[p]}"))
    return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _messages(parent: list[int], own: list[float], pair: list[list[float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product over the tree, as log odds: of all below each node, of the whole page, and of the parent without it."""
    (a00, a01), (a10, a11) = pair
    up = list(own)
    sent = [0.0] * len(own)
    log = math.log
    for i in range(len(own) - 1, 0, -1):
        s = _sigmoid(up[i])
        sent[i] = log((a10 * (1 - s) + a11 * s) / (a00 * (1 - s) + a01 * s))
        up[parent[i]] += sent[i]
    full = list(up)
    rest = [0.0] * len(own)
    for i in range(1, len(own)):
        rest[i] = full[parent[i]] - sent[i]
        s = _sigmoid(rest[i])
        full[i] = up[i] + log((a01 * (1 - s) + a11 * s) / (a00 * (1 - s) + a10 * s))
    return up, full, rest


class Model:
    def __init__(self, weights: dict[str, float], edge: list[list[float]]):
        self.weights = weights
        self.edge = edge

    @property
    def pair(self) -> list[list[float]]:
        return [[math.exp(x) for x in row] for row in self.edge]

    def marginals(self, tree: Tree, texts: list[str], pair: list[list[float]] | None = None) -> list[float]:
        get = self.weights.get
        own = [sum(get(f, 0.0) for f in names) for names in _features(tree, texts)]
        _, full, _ = _messages(tree.parent, own, pair or self.pair)
        return [_sigmoid(x) for x in full]

    def extract(self, page: str | None, pair: list[list[float]] | None = None) -> str:
        if not page:
            return ""
        tree = parse(page)
        texts = [block_text(p) for _, p in tree.blocks]
        p = self.marginals(tree, texts, pair)
        return " ".join(t for (node, _), t in zip(tree.blocks, texts, strict=True) if t and p[node] > 0.5)


def hand_labels(tree: Tree) -> list[int]:
    out = [0] * len(tree.tags)
    for i in range(1, len(out)):
        attrs = tree.attributes[i]
        out[i] = 0 if "data-off" in attrs else 1 if "data-main" in attrs else out[tree.parent[i]]
    return out


def landmark_labels(tree: Tree) -> list[int] | None:
    """Content inside the page's article element; None for a page without one."""
    if "article" not in tree.tags:
        return None
    out = [0] * len(tree.tags)
    for i in range(1, len(out)):
        tag = tree.tags[i]
        out[i] = 1 if tag == "article" else 0 if tag in _NOT_CONTENT else out[tree.parent[i]]
    return out


def train(pages: list[str], *, models: int = 4, **options: float) -> Model:
    """The mean weights of several fits, each on made-up layouts of its own: single fits differ at the margin."""
    fits = [_fitted(pages, seed=10 * k, **options) for k in range(models)]
    mean = lambda values: sum(values) / models
    names = sorted({n for m in fits for n in m.weights})
    return Model({n: mean(m.weights.get(n, 0.0) for m in fits) for n in names}, [[mean(m.edge[i][j] for m in fits) for j in (0, 1)] for i in (0, 1)])


def _fitted(pages: list[str], *, rounds: int = 60, rate: float = 0.7, l2: float = 0.02, seed: int = 0) -> Model:
    """Weights fitted on landmark-labelled pages, the pages labelled by hand and layouts made up of their articles."""
    own = [x for p in pages if (x := article_inside(p))]
    rng = random.Random(seed)
    told = [x for p in LABELLED_PAGES for x in re.findall(r"<p>([^<]{30,})</p>", p)]
    said = lambda: " ".join(rng.choices(told, k=rng.choice([1, 1, 2, 4, 8])))
    block = lambda: rng.choice(["<p>{}</p>"] * 6 + ["<ul><li>{}</li><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<h2>{}</h2>", "<table><tr><td>{}</td><td>{}</td></tr></table>"]).format(said(), rng.choice(told))
    short = [f"<h1>{rng.choice(told)[:40]}</h1>{''.join(block() for _ in range(rng.randint(2, 12)))}" for _ in range(max(30, 120 - len(own)))]
    short += ["<p>" + "</p><p>".join(rng.choice(told)[: rng.randint(1, 12)] for _ in range(rng.randint(1, 3))) + "</p>" for _ in range(6)]
    made = made_layouts(short, seed=seed) + made_layouts(own, seed=seed + 1)
    cases = []
    for source, label in ((pages, landmark_labels), (LABELLED_PAGES, hand_labels), (made, hand_labels)):
        worth = max(1.0, len(pages) / 20) if source is LABELLED_PAGES else 1.0
        for page in source:
            tree = parse(page)
            if (gold := label(tree)) is not None:
                cases.append((tree.parent, _features(tree, [block_text(p) for _, p in tree.blocks]), gold, worth))
    return _maximised(cases, rounds, rate, l2)


def _maximised(cases: list[tuple], rounds: int, rate: float, l2: float) -> Model:
    """Gradient steps over all pages at once: the trees are one forest, and messages pass depth by depth."""
    names: dict[str, int] = {}
    parent, depth, gold, worth, used, starts = [], [], [], [], [], []
    for tree, features, labels, weight in cases:
        base = len(parent)
        for i, own in enumerate(features):
            parent.append(base + tree[i] if i else -1)
            depth.append(depth[base + tree[i]] + 1 if i else 0)
            starts.append(len(used))
            used += [names.setdefault(f, len(names)) for f in own]
        gold += labels
        worth += [weight] * len(labels)
    parent, depth, used, starts = np.array(parent), np.array(depth), np.array(used), np.array(starts)
    gold, worth = np.array(gold, float), np.array(worth, float)
    lengths = np.diff(starts, append=len(used))
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    below = np.flatnonzero(depth > 0)
    of = parent[below]
    chances = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    weights, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    edge, seen_edge = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    real = np.zeros((2, 2))
    np.add.at(real, (gold[of].astype(int), gold[below].astype(int)), worth[below])
    for _ in range(rounds):
        (a00, a01), (a10, a11) = np.exp(edge)
        up = np.add.reduceat(weights[used], starts)
        sent, rest = np.zeros(len(up)), np.zeros(len(up))
        for level in reversed(levels):
            s = chances(up[level])
            sent[level] = np.log((a10 * (1 - s) + a11 * s) / (a00 * (1 - s) + a01 * s))
            np.add.at(up, parent[level], sent[level])
        full = up.copy()
        for level in levels:
            rest[level] = full[parent[level]] - sent[level]
            s = chances(rest[level])
            full[level] = up[level] + np.log((a01 * (1 - s) + a11 * s) / (a00 * (1 - s) + a10 * s))
        step = np.bincount(used, np.repeat(worth * (gold - chances(full)), lengths), len(names)) - l2 * weights
        s, t = chances(rest[below]), chances(up[below])
        joint = np.exp(edge)[:, :, None] * np.stack([1 - s, s])[:, None, :] * np.stack([1 - t, t])[None, :, :]
        moves = real - (joint / joint.sum(axis=(0, 1)) * worth[below]).sum(axis=2) - l2 * edge
        seen += step * step
        weights += rate * step / np.sqrt(seen)
        seen_edge += moves * moves
        edge += rate * moves / np.sqrt(seen_edge)
    return Model(dict(zip(names, weights.tolist(), strict=True)), edge.tolist())


def fit(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", max_pages: int = 60, usual: int = 65_536) -> Model:
    """Train on at most `max_pages` pages of the table and the pages labelled by hand. Only hashes are ranked; then the
    chosen pages are fetched."""
    marked = pages.where(F.col(html_col).contains("<article")).select(F.xxhash64(id_col, html_col).alias("place"), F.col(html_col).alias("html"))
    chosen = marked.select("place", (F.char_length("html") > usual).alias("long")).distinct().orderBy("long", "place").limit(max_pages)
    got = marked.join(F.broadcast(chosen.select("place")), "place").dropDuplicates(["place"]).orderBy("place").collect()
    return train([r["html"] for r in got])


def extract_text(pages: DataFrame, model: Model, *, html_col: str = "html") -> DataFrame:
    """The rows without the html, with `text` and `n_chars` (code points)."""
    kept = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    rows = pages.select(*[f"`{f.name}`" for f in kept], F.col(html_col).alias("__html"))
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        pair = m.pair
        for batch in slices(batches, "__html"):
            texts = [m.extract(page, pair) for page in batch.column("__html").to_pylist()]
            columns = [batch.column(f.name) for f in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["text", "n_chars"])

    return in_batches(rows, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars long"]))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = documents(spark, sf_dir, "pages")
    return extract_text(pages.select("page_id", "url", "html"), fit(pages))
