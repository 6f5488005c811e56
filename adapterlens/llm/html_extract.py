"""Main-text extraction by gradient-boosted trees over DOM-node features.

Each page becomes a tree of nodes; each node gets features of its tag and attributes, its depth
and siblings, and the density of text, links and tags in its subtree. Boosted trees (fitted with
MLlib on a bounded sample) give every node the odds that it holds main text. Decoding is
hierarchical: the best assignment in which nothing below a dropped node is kept.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.common import batch_column, bounded_sample, cut, table

#: Pages that the trees are fitted on, about: those with a low hash of page_id.
SAMPLE_PAGES = 240
TREES, DEPTH = 16, 4

# Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe select".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mrow ms msqrt msub msup mtext noscript object svg g text tspan template".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
GROUPS = (
    "html body", "article", "main", "section", "div", "p", "h1 h2 h3", "h4 h5 h6", "ul ol dl", "li dt dd", "a", "nav menu", "header", "footer", "aside",
    "form fieldset", "table tbody tr td th", "figure figcaption", "blockquote pre", "button input label", "#text",
)
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
MAIN_GROUPS, SIDE_GROUPS = [GROUP[t] for t in ("article", "main")], [GROUP[t] for t in ("nav", "header", "footer", "aside", "form", "button")]
# Attribute tokens that speak for and against main text.
FOR = frozenset("article articlebody body content entry hentry main maincontent page post postbody story text".split())
AGAINST = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments complementary cookie cookies consent contact copyright cta dialog disqus "
    "disclaimer donate footer form header hidden legal links login masthead menu meta modal nav navbar navigation navigational newsletter notice pagination "
    "popup promo promoted recommended related reply respond search share sharing sidebar signup site skip social sponsor sponsored subscribe tags teaser toolbar widget".split()
)

NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
STOP = re.compile("[\"'>]")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")
CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
KEEP = "data-main"

IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody body article section div main".split())


def tags_in(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of the tags, comments and declarations of a page in order, by a
    scan that never goes back; the caller may send the place to go on from. A closing tag's name
    begins with a slash; comments and declarations have none. What is not closed before the page
    ends is text, but for a comment, which then reaches to the end.
    """
    last = {c: source.rfind(c) for c in "\"'>"}
    quotes, cdata, at = True, True, 0
    while 0 <= (at := source.find("<", at)) < last[">"] or source.startswith("<!--", at):
        name, attrs, end = "", "", -1
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(source)
        elif cdata and source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            cdata, end = end >= 0, end + 3 if end >= 0 else source.find(">", at) + 1
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at) + 1
        elif m := NAME.match(source, at + 1):
            name, to = m[0].lower(), m.end()
            while quotes:
                stop = STOP.search(source, to)
                if stop is None:  # every later end of a tag is inside of quotes: they count no more
                    quotes = False
                elif stop[0] == ">":
                    end = stop.end()
                    break
                else:
                    to = stop.end() if stop.start() == last[stop[0]] else source.find(stop[0], stop.end()) + 1
            if not quotes:
                end = source.find(">", m.end()) + 1
            attrs = source[m.end() : end - 1]
        if end <= 0:
            at += 1
            continue
        on = yield at, end, name, attrs
        at = end if on is None else on


class Page:
    """Nodes of one page in page order (node 0 is the root) and its pieces of text.

    texts: (node, block number, text); a block ends where a block-level element begins or ends. Time
    is in proportion to the length of the page, whatever is unclosed, stray or nested in it.
    """

    __slots__ = ("attrs", "depth", "keep", "open", "parent", "places", "tags", "texts")

    def __init__(self, source: str):
        self.tags, self.parent, self.attrs, self.keep, self.depth = ["body"], [-1], [""], [False], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.open: list[int] = [0]  # open nodes, outermost first
        self.places: dict[str, list[int]] = {}  # by name, where they stand there
        block, done = 0, 0
        endless: set[str] = set()  # raw elements without an end from here on
        scan, on = tags_in(source), None
        while True:
            try:
                at, end, name, attrs = scan.send(on) if on is not None else next(scan)
            except StopIteration:
                break
            on = None
            if at > done:
                self.texts.append((self.open[-1], block, source[done:at]))
            done = end
            if not name:
                continue
            if name[0] == "/":
                name = name[1:]
                if name not in INLINE:
                    block += 1
                if self.places.get(name):
                    self._shut(self.places[name][-1])
            elif name in RAW or name == "head":
                block += name == "title"
                if not attrs.endswith("/") and name not in endless:
                    found = re.compile(rf"</{re.escape(name)}\b[^<>]*>" if name != "head" else r"</head\s*>|<body\b[^<>]*>", re.I).search(source, done)
                    if found or name in ("script", "style"):
                        on = done = found.end() if found else len(source)
                    else:
                        endless.add(name)
            elif name in VOID:
                block += 1
                if name == "input":
                    self._add(name, self.open[-1], attrs)
            elif name not in ("html", "body"):
                if name not in INLINE:
                    block += 1
                if name in CLOSES_P:
                    self._close(("p",), (*SCOPE, "li", "td", "th"))
                if name in IMPLIED:
                    self._close(IMPLIED[name], ("ul", "ol", "dl", "table"))
                node = self._add(name, self.open[-1], attrs)
                if not attrs.endswith("/"):
                    self.places.setdefault(name, []).append(len(self.open))
                    self.open.append(node)
        if done < len(source):
            self.texts.append((self.open[-1], block, source[done:]))
        self._split_texts()

    def _add(self, tag: str, parent: int, attrs: str) -> int:
        self.tags.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.keep.append(KEEP in attrs)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tags) - 1

    def _shut(self, place: int) -> None:
        """Close the open elements from a place on."""
        for node in self.open[place:]:
            self.places[self.tags[node]].pop()
        del self.open[place:]

    def _close(self, names: Iterable[str], scope: Iterable[str]) -> None:
        """Close the innermost open element of `names`, unless one of `scope` stands inside it."""
        inmost = lambda tags: max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        place = inmost(names)
        if place and place > inmost(t for t in scope if t not in names):
            self._shut(place)

    def _split_texts(self) -> None:
        """Text beside block-level children becomes a node of its own."""
        mixed = {p for p, t in zip(self.parent, self.tags, strict=True) if p >= 0 and t not in INLINE}
        mixed.add(0)
        out, last = [], None
        for node, block, text in self.texts:
            if node in mixed and not text.isspace():
                if last is None or last[0] != (node, block):
                    last = ((node, block), self._add("#text", node, ""))
                    self.keep[-1] = self.keep[node]
                node = last[1]
            if not text.isspace() or node not in mixed:
                out.append((node, block, entities.unescape(text) if "&" in text else text))
        self.texts = out

    def text(self, kept: np.ndarray) -> str:
        """The text of kept nodes: blocks in page order, white space inside them and between as one space."""
        blocks: list[str] = []
        now, parts = -1, []
        for node, block, text in self.texts:
            if kept[node]:
                if block != now:
                    blocks.append("".join(parts))
                    now, parts = block, []
                parts.append(text)
        return " ".join(" ".join([*blocks, "".join(parts)]).split())


NUMBERS = (
    "depth", "place", "siblings", "order", "words", "links", "link_share", "tags", "density", "marks", "page_share", "paragraphs", "items", "inputs", "own_words",
    "word_length", "for_self", "against_self", "for_above", "against_above", "in_main", "in_side", "parent_words", "parent_link_share", "parent_paragraphs", "children", "sentence",
)
FEATURES = (*NUMBERS, *(f"tag:{g}" for g in GROUPS))


def _attribute_tokens(attrs: str) -> tuple[int, int]:
    if not attrs:
        return 0, 0
    f = a = 0
    for m in NAMES.finditer(attrs):
        for t in PART.findall(CASE.sub(" ", m[1] or m[2] or m[3] or "")):
            t = t.lower()
            f, a = f + (t in FOR), a + (t in AGAINST)
    return f, a


def node_table(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents, depths) of all nodes of the pages; parents count through the whole list."""
    base = np.cumsum([0, *(len(p.tags) for p in pages)])
    n = int(base[-1])
    parent, group = np.empty(n, np.int64), np.empty(n, np.int64)
    own = np.zeros((n, 4))  # words, sentence marks, characters, texts with a mark
    seen: dict[str, tuple[int, int]] = {}
    tokens = np.zeros((n, 2))
    for at, page in zip(base.tolist(), pages, strict=False):
        end = at + len(page.tags)
        parent[at:end] = page.parent
        parent[at + 1 : end] += at
        group[at:end] = [GROUP.get(t, -1) for t in page.tags]
        for i, attrs in enumerate(page.attrs):
            if attrs:
                got = seen.get(attrs)
                if got is None:
                    got = seen[attrs] = _attribute_tokens(attrs)
                tokens[at + i] = got
        for node, _, text in page.texts:
            words = text.split()
            own[at + node] += (len(words), text.count(".") + text.count(","), sum(map(len, words)), 1 if "." in text else 0)
    depth = np.concatenate([np.array(p.depth) for p in pages])
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1])
    root = depth == 0
    link = np.zeros(n, bool)
    in_main, in_side, f_up, a_up = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    is_main, is_side = np.isin(group, MAIN_GROUPS), np.isin(group, SIDE_GROUPS)
    for nodes in levels[1:]:
        up = parent[nodes]
        link[nodes] = link[up] | (group[nodes] == GROUP["a"])
        in_main[nodes], in_side[nodes] = np.maximum(in_main[up], is_main[up]), np.maximum(in_side[up], is_side[up])
        f_up[nodes], a_up[nodes] = np.maximum(f_up[up], tokens[up, 0] > 0), np.maximum(a_up[up], tokens[up, 1] > 0)
    sums = np.column_stack([own, np.where(link, own[:, 0], 0), np.ones(n), group == GROUP["p"], group == GROUP["li"], group == GROUP["button"]])
    for nodes in reversed(levels[1:]):
        np.add.at(sums, parent[nodes], sums[nodes])
    words, marks, chars, _, links, tags, paragraphs, items, inputs = sums.T
    page = np.repeat(np.arange(len(pages)), np.diff(base))
    total = np.maximum(words[base[:-1]], 1)[page]
    up = np.where(parent >= 0, parent, 0)
    siblings = np.bincount(up[~root], minlength=n).astype(float)
    by = np.lexsort((np.arange(n), up))
    by = by[~root[by]]
    place = np.zeros(n)
    if len(by):
        start = np.flatnonzero(np.r_[True, up[by][1:] != up[by][:-1]])
        place[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
    share = links / np.maximum(words, 1)
    numbers = [
        depth, place, siblings[up], (np.arange(n) - base[:-1][page]) / np.diff(base)[page], np.log1p(words), np.log1p(links), share, np.log1p(tags), words / tags, marks / np.maximum(words, 1),
        words / total, np.log1p(paragraphs), np.log1p(items), inputs, np.log1p(own[:, 0]), chars / np.maximum(words, 1), tokens[:, 0], tokens[:, 1], f_up, a_up, in_main, in_side,
        np.log1p(words[up]), share[up], np.log1p(paragraphs[up]), siblings, own[:, 3] > 0,
    ]
    x = np.column_stack([*numbers, *(group == g for g in range(len(GROUPS)))]).astype(np.float32)
    return x, parent, depth


class Trees:
    """Fitted trees as flat arrays: feature, threshold, left and right child, value."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float]):
        self.trees = [tuple(np.array(c) for c in zip(*t, strict=True)) for t in trees]
        self.weights = weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = left[at] >= 0
                low = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out += w * value[at]
        return 2 * out


def decode(log_odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the most likely assignment where kept nodes have kept parents.

    Roots are kept. Relative to dropping a node with all below it, keeping it gains its log odds
    and what its children gain, where they gain.
    """
    gain = log_odds.astype(float).copy()
    by_depth = np.argsort(-depth, kind="stable")
    bounds = np.searchsorted(-depth[by_depth], -np.arange(depth.max(initial=0), -1, -1), side="right")
    start = 0
    for end in bounds:
        nodes = by_depth[start:end]
        nodes = nodes[parent[nodes] >= 0]
        np.add.at(gain, parent[nodes], np.maximum(gain[nodes], 0))
        start = end
    kept = (gain > 0) | (parent < 0)
    for nodes in np.split(by_depth[::-1], np.cumsum(np.bincount(depth))[:-1]):
        inner = nodes[parent[nodes] >= 0]
        kept[inner] &= kept[parent[inner]]
    return kept


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    """Main texts of pages."""
    pages = [Page(s or "") for s in sources]
    x, parent, depth = node_table(pages)
    kept = decode(trees.log_odds(x), parent, depth)
    ends = np.cumsum([len(p.tags) for p in pages])
    return [p.text(k) for p, k in zip(pages, np.split(kept, ends[:-1]), strict=True)]


def training_pages(source: str, seed: int) -> list[str]:
    """Pages with known main text (marked by an attribute) made from the text of a page.

    The page itself counts its article or main element as main text. Others set the same
    paragraphs in many layouts, with the side matter that pages have around and inside the article.
    """
    r = random.Random(seed)
    plain = [" ".join(entities.escape(t).split()) for _, _, t in Page(source).texts]
    body = [p for p in plain if len(p.split()) > 3] or ["Some words of text that stand here."]
    bits = [w for p in plain for w in p.split()] or ["word"]
    few = lambda a, b: " ".join(r.choice(bits) for _ in range(r.randint(a, b)))
    name = lambda *options: r.choice(options)
    marked = re.sub(r"(?i)<(article|main)\b", rf"<\1 {KEEP}", source)
    out = [marked] if marked != source else []
    for _ in range(3):
        def links(n: int) -> str:
            return "".join(f'<li><a href="/{k}">{few(1, 4)}</a></li>' for k in range(n))

        def side() -> str:
            kind = r.randrange(9)
            text = r.choice(body) if r.random() < 0.5 else few(3, 40)
            if kind == 0:
                return f'<{name("aside", "div", "section")} class="{name("sidebar", "side-bar widget", "right sidebar")}"><h3>{few(1, 4)}</h3><ul>{links(r.randint(2, 8))}</ul><p>{text}</p></{name("aside", "div")}>'
            if kind == 1:
                return f'<div class="{name("ad", "ads", "advert box", "ad-slot", "sponsored", "promo banner")}">{text}</div>'
            if kind == 2:
                return f'<div {name("id", "class")}="{name("cookie-notice", "cookie-consent", "notice", "banner", "popup modal")}"><p>{text}</p><button>{few(1, 2)}</button></div>'
            if kind == 3:
                return f'<form{name("", "", " class=newsletter", " id=search", " class=signup-form")}><label>{few(1, 5)}</label><input type="text"><p>{few(2, 12)}</p><button>{few(1, 2)}</button></form>'
            if kind == 4:
                return f'<div class="{name("share", "social-share", "related", "related-posts", "tags", "breadcrumbs")}"><ul>{links(r.randint(2, 6))}</ul></div>'
            if kind == 5:
                return f'<{name("nav", "menu")}><ul>{links(r.randint(3, 10))}</ul></{name("nav", "menu")}>'
            if kind == 6:
                return f"<aside><p>{text}</p></aside>"
            if kind == 7:
                return f'<aside class="{name("note", "box", "pull")}">{text}</aside>'
            return f'<div class="{name("menu", "nav", "navbar", "links")}">{" ".join(f"<a href=#>{few(1, 3)}</a>" for _ in range(r.randint(2, 9)))}</div>'

        def paragraph(p: str) -> str:
            words = p.split()
            if len(words) > 6 and r.random() < 0.3:
                k = r.randrange(len(words) - 2)
                words[k] = f"<{(t := name('b', 'em', 'strong', 'a href=/x', 'span', 'i'))}>{words[k]}</{t.split()[0]}>"
            kind = r.random()
            p = " ".join(words)
            if kind < 0.08:
                return f"<ul><li>{p}</li><li>{few(2, 15)}</li></ul>"
            if kind < 0.12:
                return f"<blockquote>{p}</blockquote>"
            if kind < 0.15:
                return f"<pre>{p}</pre>"
            if kind < 0.19:
                return f"<h2>{few(1, 8)}</h2><p>{p}</p>"
            if kind < 0.22:
                return f"<table><tr><td>{p}</td><td>{few(1, 5)}</td></tr></table>"
            if kind < 0.27:
                return f"<p>{few(1, 3)}.</p><p>{p}</p>"
            if kind < 0.32:
                return f"<p><b>{p}<br>"
            if kind < 0.36:
                return f"<div>{p}</div>"
            return f"<p>{p}</p>"

        chosen = [r.choice(body) for _ in range(r.choice([1, 2, 4, 8, 14]))]
        inner = [f"<h1>{few(2, 12)}</h1>" if r.random() < 0.8 else "", *map(paragraph, chosen)]
        wrap = r.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="post-content"'), ("div", ' id="content"'), ("section", ' class="story"'), ("div", ' class="c7 x1"'), ("div", ""), ("div", ' itemprop="articleBody"'), ("div", ' role="main"')])
        pieces = [f"<{wrap[0]}{wrap[1]}>", *(p if not p else re.sub(r"<(\w+)", rf"<\1 {KEEP}", p, count=0) for p in inner)]
        for _ in range(r.choice([0, 0, 1, 2])):
            pieces.insert(r.randint(2, len(pieces)), side())
        pieces.append(f"</{wrap[0]}>")
        comments = ""
        if r.random() < 0.5:
            each = "".join(f'<{name("div", "li")} class="{name("comment", "reply", "comment-body")}"><p>{name(r.choice(body), few(2, 30))}</p></div>' for _ in range(r.randint(1, 6)))
            comments = f'<{name("section", "div")} {name("id", "class")}="{name("comments", "comment-list", "respond", "disqus_thread")}"><h3>{few(1, 3)}</h3>{each}</div>'
        if comments and r.random() < 0.3:
            pieces.insert(-1, comments)
            comments = ""
        top = f'<header{name("", " class=site-header")}><{name("div", "p", "h2")}>{few(1, 6)}</div><nav><ul>{links(r.randint(2, 8))}</ul></nav></header>' if r.random() < 0.6 else f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>"
        foot = f'<{name("footer", "footer", "div class=footer", "div id=footer")}>&copy; {few(1, 4)} &middot; {name(few(2, 25), r.choice(body))}</footer>'
        before, after = "".join(side() for _ in range(r.choice([0, 1, 1, 2]))), "".join(side() for _ in range(r.choice([0, 1, 2])))
        box = r.choice([("", ""), ('<div id="page">', "</div>"), ('<div class="container"><div class="row">', "</div></div>")])
        out.append(f"<html><head><title>{few(2, 6)}</title></head><body>{box[0]}{top}{before}{''.join(pieces)}{after}{comments}{foot}{box[1]}</body></html>")
    return out


def labelled_nodes(source: str, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, main or not) of the training pages made from one page.

    A node is main if a marked node with text, or the marked part of it, lies in its subtree.
    """
    for text in training_pages(source, seed):
        page = Page(text)
        x, parent, depth = node_table([page])
        side = np.isin([GROUP.get(t, -1) for t in page.tags], SIDE_GROUPS) | np.array([_attribute_tokens(a)[1] > 0 for a in page.attrs])
        marked = np.array(page.keep)
        order = np.argsort(depth, kind="stable")
        for i in order.tolist():  # marks reach down, side matter inside stays out
            if parent[i] >= 0 and (marked[parent[i]] and not side[i]):
                marked[i] = True
            if side[i] and not page.keep[i]:
                marked[i] = False
        has = np.zeros(len(marked), bool)
        has[[n for n, _, _ in page.texts]] = True
        main = marked & has
        for i in order[::-1].tolist():
            if parent[i] >= 0 and main[i]:
                main[parent[i]] = True
        filled = x[:, FEATURES.index("words")] > 0
        filled[0] = False
        yield x[filled], main[filled]


def fit_trees(pages: DataFrame, most: int = SAMPLE_PAGES) -> Trees:
    """Fit the trees with MLlib on nodes of about `most` pages, which tasks make into rows.

    Without a page to learn from, nothing is known and all nodes count as main.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    picked = bounded_sample(pages.select("page_id", "html"), most, "page_id").where("html is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, source in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for x, y in labelled_nodes(source, page_id or 0):
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), pa.array(y.astype(float))], names=["x", "label"])

    rows = cut(picked.repartition(8, "page_id").mapInArrow(run, "x array<float>, label double"))
    nodes = rows.select(array_to_vector("x").alias("features"), "label")
    if nodes.select("label").distinct().count() < 2:
        return Trees([[(-1, 0.0, -1, -1, 1.0)]], [1.0])
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, maxBins=32, seed=1, cacheNodeIds=False).fit(nodes)

    def flat(node, out: list) -> int:
        at = len(out)
        out.append((-1, 0.0, -1, -1, node.prediction()))
        if node.subtreeDepth() > 0:
            split = node.split()
            left = flat(node.leftChild(), out)
            right = flat(node.rightChild(), out)
            out[at] = (split.featureIndex(), split.threshold(), left, right, node.prediction())
        return at

    trees = []
    for t in model.trees:
        out: list = []
        flat(t._java_obj.rootNode(), out)
        trees.append(out)
    return Trees(trees, list(model.treeWeights))


def extract_pages(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of pages(page_id, url, html).

    Without trees, they are fitted on a bounded sample of the same pages. A null or empty html
    gives an empty text, as does a page without main text. Text outside any element counts as a
    node like others. Repeated rows are read each. Further columns are ignored. Empty in, empty out.
    """
    trees = fit_trees(pages) if trees is None else trees
    texts = batch_column(lambda sources: extract(sources, trees), "string")
    return pages.select("page_id", "url", texts("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Nulls, empty, long and malformed pages: as `extract_pages` says."""
    return extract_pages(table(spark, sf_dir, "pages"))
