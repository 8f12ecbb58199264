"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into element nodes. Each node gets features (density of text, links and blocks in
its subtree, tokens of its tag and attributes, depth, siblings), boosted trees give it a log-odds of
being main content, and a path from the root may only go outside -> main -> cut, once each: the best
such assignment of the whole tree is found by dynamic programming, so an ancestor and a descendant
never contradict one another.

The trees are trained by Spark on nodes of pages rendered anew: the prose of a bounded sample of pages
is laid out in many skeletons with menus, notices, adverts, forms, sidebars and reader comments, where
every node's role is known (a header inside main content is the article's own). Extraction is one pass over the pages without a shuffle.

Defined results: a null or empty html, or a page without main content, gives an empty text; broken
markup is closed as it ends, a head
without an end tag by the first tag or text that can't be in one; scripts, styles, titles and form controls never give text; repeated rows
are extracted each; an empty table gives an empty result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from timberline.session import materialize

from .words import slices, texts_of

#: Pages whose prose is rendered anew for training, and skeletons for each.
SAMPLE_PAGES = 150
SKELETONS = 6
#: What leaving main content costs on a path, in units of log-odds times the root of the characters.
CUT_COST = 12.0

#: Fixed values of the HTML language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title iframe object svg math button select textarea option canvas audio video".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that stay in the head; any other, and text, end it, as its end tag may be left out.
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Silent elements that hold no blocks: on a page that leaves one open, a block ends it.
SHORT_SILENT = "title button textarea select".split()
#: What a start tag closes: open elements of these tags, up to the nearest of the scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of tags and attributes by what they name.
LEXICON = {
    "main": "article main content post entry story body text maincontent articlebody prose",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager tabs sitemap skip",
    "edge": "header footer head foot masthead banner copyright legal branding colophon topbar bottom",
    "side": "aside sidebar side widget related recommended more rail social share sharing tags trending popular",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "notice": "notice cookie cookies consent gdpr popup modal alert overlay newsletter subscribe signup paywall warning",
    "form": "form search login register fieldset input",
    "comment": "comment comments reply replies respond discussion disqus thread reader feedback",
}
KINDS = list(LEXICON)
NAMED = {w: k for k, words in enumerate(LEXICON.values()) for w in words.split()}
_TOKEN = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_STARTS, _ENDS = (re.compile(rf"<{x}({'|'.join(SHORT_SILENT)})\b", re.I) for x in ("", "/"))


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    kinds: tuple
    index: int
    twins: int = 0
    children: list = field(default_factory=list)
    tags: dict = field(default_factory=dict)


class Page(HTMLParser):
    """Element nodes and text blocks of one page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1, 0, (0,) * len(KINDS), 0)]
        self.open = [0]
        self.opened: Counter = Counter()
        starts, ends = (Counter(x.lower() for x in found.findall(html)) for found in (_STARTS, _ENDS))
        self.unclosed = [t for t in SHORT_SILENT if starts[t] > ends[t]]
        self.silent = 0
        self.blocks: list[tuple[int, str]] = []  # (node, text) in page order
        self.links: list[int] = []
        self.runs: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self.end_block()

    def end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.runs)).strip()
        if text:
            # inline elements belong to the block that holds them
            at = self.open[-1]
            while at and self.nodes[at].tag not in BLOCKS:
                at = self.nodes[at].parent
            self.blocks.append((at, text))
            self.links.append(min(self.linked, len(text)))
        self.runs, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_block()
            for name in self.unclosed:
                self._close_to(name)
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCKS:
            # a block ends an open paragraph
            self._close_to("p")
        elif tag == "br":
            self.runs.append(" ")
        if tag in CLOSES and any(map(self.opened.__getitem__, CLOSES[tag][0])):
            ends, scope = CLOSES[tag]
            for depth in range(len(self.open) - 1, 0, -1):
                name = self.nodes[self.open[depth]].tag
                if name in scope:
                    break
                if name in ends:
                    self._cut(depth)
        if tag in VOID:
            return
        parent = self.open[-1]
        up = self.nodes[parent]
        named = [0] * len(KINDS)
        told = " ".join([tag, *(v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label"))])
        for word in _TOKEN.findall(told):
            if (k := NAMED.get(word.lower())) is not None:
                named[k] += 1
        node = Node(tag, parent, up.depth + 1, tuple(named), len(up.children))
        node.twins = up.tags.get(tag, 0)
        up.tags[tag] = node.twins + 1
        up.children.append(len(self.nodes))
        self.open.append(len(self.nodes))
        self.opened[tag] += 1
        self.nodes.append(node)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _cut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.opened[self.nodes[i].tag] -= 1
            self.silent -= self.nodes[i].tag in SILENT
        del self.open[depth:]

    def _end_head(self) -> None:
        if self.nodes[self.open[-1]].tag == "head":
            self._close_to("head")

    def _close_to(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                self._cut(depth)
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        self._close_to(tag)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.silent:
            self.runs.append(data)
            if self.opened["a"]:
                self.linked += len(data)


def node_features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.nodes)
    own = np.zeros((n, 5))  # characters, linked characters, blocks, sentence marks, long blocks
    for (at, text), linked in zip(page.blocks, page.links):
        own[at] += (len(text), linked, 1, sum(map(text.count, ".!?,")), len(text) > 80)
    below, within, named = own.copy(), np.zeros((n, len(KINDS))), np.array([x.kinds for x in page.nodes], float)
    headings = np.array([x.tag in ("h1", "h2") for x in page.nodes], float)
    paragraphs = np.array([x.tag == "p" for x in page.nodes], float)
    above = np.zeros((n, len(KINDS)))
    for i in range(n - 1, 0, -1):
        up = page.nodes[i].parent
        below[up] += below[i]
        headings[up] += headings[i]
        paragraphs[up] += paragraphs[i]
        within[up] += within[i] + (named[i] > 0)
    for i in range(1, n):
        above[i] = above[page.nodes[i].parent] + (named[page.nodes[i].parent] > 0)
    chars = np.maximum(below[:, 0], 1)
    whole = max(below[0, 0], 1)
    siblings = np.array([len(page.nodes[max(x.parent, 0)].children) for x in page.nodes], float)
    return np.column_stack([
        np.log1p(below[:, 0]), below[:, 0] / whole, below[:, 1] / chars, below[:, 3] / chars * 20,
        np.log1p(below[:, 2]), below[:, 0] / np.maximum(below[:, 2], 1) / 100, below[:, 4], np.log1p(paragraphs), headings > 0,
        named > 0, above > 0, named[:, 1:].sum(1), above[:, 1:].sum(1), (named[:, 1:] + above[:, 1:]).sum(1) > 0,
        np.minimum([x.depth for x in page.nodes], 8), np.minimum(siblings, 10), np.minimum([x.twins for x in page.nodes], 5),
        within[:, 0] > 0, within[:, 1:].sum(1), np.log1p(own[:, 0]), [x.tag in ("li", "a", "td") for x in page.nodes],
    ]).astype(np.float64)


# ---------------------------------------------------------------- training pages

def skeleton(prose: list[str], other: list[str], rng: random.Random) -> str:
    """A page around ``prose`` with boilerplate from ``other``; main containers carry ``data-role``."""
    pick = lambda k: rng.choice(LEXICON[k].split())
    few = lambda n: [escape(rng.choice(other)) for _ in range(n)] if other else ["more"] * n
    short = lambda: " ".join(rng.choice(other or ["more"]).split()[:rng.randint(1, 3)])

    def box(kind: str, inner: str, tags: str) -> str:
        tag = rng.choice(tags.split())
        plain = tag in NAMED and rng.random() < 0.5
        named = "" if plain else f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "page_"])}{pick(kind)}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    listed = lambda: "<ul>" + "".join(f'<li><a href="/x">{escape(short())}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"
    paragraphs = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    extra = {
        "menu": lambda: box("menu", listed(), "nav div ul"),
        "edge": lambda: box("edge", rng.choice([f"<p>&copy; {escape(short())}</p>", listed(), *few(1)]), "footer header div"),
        "side": lambda: box("side", rng.choice([listed(), paragraphs(few(2)), *few(1)]), "aside div section"),
        "advert": lambda: box("advert", rng.choice([*few(1), paragraphs(few(1))]), "div aside section"),
        "notice": lambda: box("notice", rng.choice([*few(1), paragraphs(few(1))]), "div section aside"),
        "form": lambda: box("form", f"<label>{escape(short())}</label><input>" + paragraphs(few(rng.randint(0, 1))), "form div"),
        "comment": lambda: box("comment", "".join(box("comment", paragraphs(few(rng.randint(1, 2))), "div li article") for _ in range(rng.randint(1, 5))), "section div ol"),
    }
    kinds = list(extra)
    some = lambda n: "".join(extra[rng.choice(kinds)]() for _ in range(rng.randint(0, n)))
    marks = ["{}"] * 5 + ["<b>{}<br>", "<b>{}</b>", "<em>{}</em> <a href='/y'>{}</a>", "<span>{}</span>"]
    title, *rest = [rng.choice(marks).format(*[escape(p)] * 2) for p in prose] or ["x"]
    inner = [f"<h1>{title}</h1>" if rng.random() < 0.8 else f"<p>{title}</p>", *(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<h2>{}</h2>"][:2 + (rng.random() < 0.4) * 4]).format(p) for p in rest)]
    if rng.random() < 0.2:
        inner[0] = f"<header>{inner[0]}</header>"
    if rng.random() < 0.4:
        inner.insert(rng.randint(1, len(inner)), extra[rng.choice(["advert", "side", "notice", "form"])]())
    if rng.random() < 0.3:
        inner.append(extra["comment"]())
    tag = rng.choice(["article", "main", "div", "section"])
    named = "" if tag in ("article", "main") and rng.random() < 0.7 else f' class="{pick("main")}"'
    main = f'<{tag} data-role="main"{named}>{"".join(inner)}</{tag}>'
    if rng.random() < 0.2:
        return main + some(2)
    if rng.random() < 0.4:
        main = f"<div{rng.choice(['', ' id=\"wrap\"', ' class=\"container\"'])}>{some(1)}{main}{some(2)}</div>"
    return f"<html><head><title>{title}</title></head><body>{some(3)}{extra['menu']()}{main}{some(3)}{extra['edge']()}</body></html>"


class _Marked(Page):
    """Also notes which nodes are main containers."""

    def __init__(self, html: str):
        self.main: set[int] = set()
        super().__init__(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if ("data-role", "main") in attrs:
            self.main.add(len(self.nodes) - 1)


def labelled_nodes(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes that hold text; main means below a main container, in no other kind."""
    page = _Marked(html)
    x = node_features(page)
    label = np.zeros(len(page.nodes), int)
    for i, node in enumerate(page.nodes):
        if i in page.main:
            label[i] = 1
        elif i and label[node.parent] and (node.tag == "header" or not any(node.kinds[1:])):
            label[i] = 1
    has = np.flatnonzero(x[:, 0] > 0)
    return x[has], label[has]


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.to_pylist()
        parsed = []
        for row in pages:
            page = Page(row["html"] or "")
            parsed.append([t for _, t in page.blocks])
        rows, labels = [], []
        for k, (row, blocks) in enumerate(zip(pages, parsed)):
            rng = random.Random(str(row["page_id"]))
            long = [b for b in blocks if len(b) > 60] or blocks or ["x"]
            long += [x.strip() for b in long for x in b.split(".") if x.strip()]
            other = [b for b in parsed[(k + 1) % len(parsed)]] or ["more"]
            made = [skeleton(rng.sample(long, min(len(long), rng.randint(1, 12))), other, rng) for _ in range(SKELETONS)]
            for x, y in map(labelled_nodes, made):
                rows += x.tolist()
                labels += y.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], names=["x", "label"])


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, rounds: int = 15, depth: int = 4) -> list:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, with their weights."""
    chosen = pages.filter("html is not null").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    nodes = materialize(chosen.mapInArrow(_training, "x array<double>, label double"), "nodes")
    if nodes.select("label").distinct().count() < 2:
        return []
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7, subsamplingRate=1.0).fit(
        nodes.select(array_to_vector("x").alias("features"), "label"))

    def tree(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return (split.featureIndex(), split.threshold(), tree(node.leftChild()), tree(node.rightChild()))

    return [(w, tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]


def log_odds(x: np.ndarray, trees: list) -> np.ndarray:
    """Twice the boosted margin: the log-odds of main content."""
    out = np.zeros(len(x))

    def add(node, rows, weight):
        if not isinstance(node, tuple):
            out[rows] += weight * node
        elif len(rows):
            left = x[rows, node[0]] <= node[1]
            add(node[2], rows[left], weight)
            add(node[3], rows[~left], weight)

    for weight, root in trees:
        add(root, np.arange(len(x)), 2 * weight)
    return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Nodes whose own text is main content, by the best assignment outside -> main -> cut on every path."""
    n = len(page.nodes)
    own = np.zeros(n)
    for at, text in page.blocks:
        own[at] += len(text)
    gain = np.sqrt(own) * np.clip(odds, -6, 6)
    # best[i] for the state of i: outside, main, cut; a child may stay or move one way only
    best = np.zeros((n, 3))
    best[:, 1] = gain
    for i in range(n - 1, 0, -1):
        up = page.nodes[i].parent
        best[up, 0] += max(best[i, 0], best[i, 1])
        best[up, 1] += max(best[i, 1], best[i, 2] - CUT_COST)
        best[up, 2] += best[i, 2]
    state = np.zeros(n, int)
    state[0] = 0
    for i in range(1, n):
        up = state[page.nodes[i].parent]
        if up == 0:
            state[i] = int(best[i, 1] > best[i, 0])
        elif up == 1:
            state[i] = 1 if best[i, 1] >= best[i, 2] - CUT_COST else 2
        else:
            state[i] = 2
    return state == 1


def main_texts(htmls: list[str], trees: list) -> list[str]:
    """Main text of each page; the nodes of all are scored together."""
    pages = [Page(h) for h in htmls]
    if not pages or not trees:
        return [""] * len(pages)
    odds = log_odds(np.concatenate([node_features(p) for p in pages]), trees)
    out, at = [], 0
    for page in pages:
        main = decode(page, odds[at:at + len(page.nodes)])
        at += len(page.nodes)
        out.append("\n".join(text for node, text in page.blocks if main[node]))
    return out


def main_text(html: str, trees: list) -> str:
    return main_texts([html], trees)[0]


def extract(pages: DataFrame, trees: list) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            texts = main_texts(texts_of(batch, "html").to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
