"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of block elements. Each node is content or not; unary potentials come from features of the node
(its tag, words of its class, id and role, link density, length of text, depth) and pairwise potentials from parent and
child labels by the kind of the child. Sum-product messages go upward and downward and give each node's marginal; text
of nodes that are content with a marginal over one half is the main text.

The weights maximise the likelihood of labelled pages by gradient ascent, whose expected counts are the marginals of the
same messages. The labelled pages are a bounded sample of the table (`SAMPLE_PAGES`, about, picked by a hash), labelled by
their own semantic elements: what lies in `article` or `main` and in none of the elements of `ASIDE` is content, and
a set of pages with other layouts that is written down here. Messages run for all pages of a batch at once, one array
step for each depth.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones
left out, the rest joined in page order by one newline. A block is what stands between the borders of block elements.
Elements of `HIDDEN` never hold text. Null counts as empty; a page without content has an empty text. Rows repeat as they
come; additional columns are not read, whatever their names.

A page is read in one pass whose time is linear in its length, so pages of any length are taken whole. Unclosed tags
are closed by their ancestors' ends. An end tag of a block closes what is open in it, but not beyond the table cell it
stands in; an end tag of an inline element closes no block. A comment without an end lasts to the page's end, as does
the content of a script or style without one; a tag that the page's end cuts off is dropped. An attribute's quotation mark
without a partner ends with its tag. Ties: a marginal of exactly one half is not content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common
from granary.session import ship, table

SAMPLE_PAGES = 400
STEPS, RATE, DECAY = 150, 0.5, 1e-3

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head button select option datalist svg math canvas object audio video map".split())
ASIDE = frozenset("nav aside footer form header menu dialog".split())
#: Elements that a start tag closes when they are open below the nearest block of another kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which the end tag of another block doesn't reach.
CELLS = ("table", "caption", "td", "th")
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = frozenset("class id role itemprop aria-label".split())
BARS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_NAME = re.compile(r"[^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=]*)\s*")
_BARE = re.compile(r"[^\s>]*")
_BLANK = re.compile(r"\s*")
_WORD = re.compile(r"[a-z]+")

#: Fixed groups of words in class, id and role values.
WORDS = {
    "advert": "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored sponsors",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay banner newsletter subscribe subscription paywall message disclaimer",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending more teaser toc tags",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs links skip",
    "edge": "header footer foot head masthead copyright legal credits logo",
    "form": "form search login signin signup register input",
    "share": "share sharing social follow twitter facebook",
    "content": "article content main post entry story body text prose page articlebody entrycontent maincontent",
}
_GROUP = {w: g for g, words in WORDS.items() for w in words.split()}
TAGS = sorted(BLOCKS)
FEATURES = ["bias", *(f"tag:{t}" for t in TAGS), *(f"word:{g}" for g in WORDS), *(f"in:{t}" for t in sorted(ASIDE)), *(f"in-word:{g}" for g in WORDS), "in:article", "in:main", "links:some", "links:most", "text:none", "text:short", "text:middle", "text:long", "depth:low", "stop"]
INDEX = {f: i for i, f in enumerate(FEATURES)}
KINDS = {"list": {"ul", "ol", "li", "dl", "dt", "dd", "menu"}, "table": {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, "text": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}, "edge": set(ASIDE)}
KIND_NAMES = ["other", *KINDS]
_KIND = {t: next(i for i, k in enumerate(KIND_NAMES) if i and t in KINDS[k]) for t in set().union(*KINDS.values())}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: frozenset[str]
    above: frozenset[str]
    chars: int = 0
    linked: int = 0
    stops: int = 0
    label: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text


class Scanner:
    """Markup pieces of a page, from left to right; nothing is looked at more than a few times."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.missing: set[str] = set()  # strings that don't occur any more

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def __iter__(self) -> Iterator[tuple[str, str, list[str], bool]]:
        """("text", text, ...), ("open", name, values of the named attributes, closed at once) and ("close", name, ...)."""
        source, size = self.source, len(self.source)
        while self.at < size:
            mark = self.find("<", self.at)
            while 0 <= mark < size - 1 and not (source[mark + 1] in "/!?" or (source[mark + 1].isascii() and source[mark + 1].isalpha())):
                mark = self.find("<", mark + 1)
            if mark < 0 or mark == size - 1:
                yield "text", source[self.at :], [], False
                return
            if mark > self.at:
                yield "text", source[self.at : mark], [], False
            after = source[mark + 1]
            self.at = size
            if source.startswith("<!--", mark):
                if source.startswith((">", "->"), mark + 4):
                    self.at = source.index(">", mark + 4) + 1
                elif (end := self.find("-->", mark + 4)) >= 0:
                    self.at = end + 3
            elif after in "!?" or (after == "/" and not (source[mark + 2 : mark + 3].isascii() and source[mark + 2 : mark + 3].isalpha())):
                if (end := self.find(">", mark + 1)) >= 0:
                    self.at = end + 1
            elif after == "/":
                name = _NAME.match(source, mark + 2)
                if (end := self.find(">", name.end())) >= 0:
                    self.at = end + 1
                    yield "close", name[0].lower(), [], False
            else:
                name = _NAME.match(source, mark + 1)
                end, values = self.attributes(name.end())
                if end >= 0:
                    self.at = end + 1
                    yield "open", name[0].lower(), values, source[end - 1] == "/"

    def attributes(self, at: int) -> tuple[int, list[str]]:
        """The place of the tag's end, or -1, and the values of the named attributes."""
        source, size, values = self.source, len(self.source), []
        while at < size:
            name = _ATTR_NAME.match(source, at)
            at = name.end()
            if at >= size:
                return -1, values
            if source[at] == ">":
                return at, values
            if source[at] != "=":
                continue
            at = _BLANK.match(source, at + 1).end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                end = self.find(quote, at + 1)
                if end < 0:  # without a partner
                    return self.find(">", at + 1), values
                value, at = source[at + 1 : end], end + 1
            else:
                bare = _BARE.match(source, at)
                value, at = bare[0], bare.end()
            if name[1].lower() in NAMED:
                values.append(value)
        return -1, values


_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}


def raw_end(name: str, source: str, at: int) -> tuple[int, int] | None:
    """Where the end tag of a raw element begins and ends. If the first one has no `>`, no later one has."""
    found = _RAW_ENDS[name].search(source, at)
    close = source.find(">", found.end()) if found else -1
    return (found.start(), close + 1) if close >= 0 else None


class Open:
    """The open elements: their names, nodes and, by name, their places."""

    def __init__(self):
        self.stack: list[list] = [["html", 0, True]]  # name, node, whether it still counts
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append([name, node, True])

    def pop(self) -> str | None:
        """The name of the innermost element, None for an inline one that was closed before."""
        name, _, counts = self.stack.pop()
        if counts:
            self.places[name].pop()
        return name if counts else None

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost element of these names, 0 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def count(self, name: str) -> int:
        return len(self.places.get(name, ()))


def parse(source: str | None) -> Page:
    """The tree of block elements and the text blocks in page order."""
    page = Page([Node("html", -1, 0, frozenset(), frozenset())])
    opened, scanner = Open(), Scanner(source or "")
    stack, parts = opened.stack, []
    hidden = linked = 0
    blocks_at: list[int] = [0]  # places of the open blocks

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                node = page.nodes[stack[-1][1]]
                page.blocks.append((stack[-1][1], text))
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += text.count(". ") + text.endswith((".", "!", "?"))
            parts.clear()
        linked = 0

    def close(place: int) -> None:
        nonlocal hidden
        while len(stack) > place:
            if stack[-1][0] in BLOCKS:
                flush()
                blocks_at.pop()
            name = opened.pop()
            hidden -= name in HIDDEN

    for kind, name, values, ended in scanner:
        if kind == "text":
            if not hidden:
                parts.append(name)
                linked += len(name) if opened.count("a") else 0
            continue
        if kind == "close":
            place = opened.last((name,))
            if name == "br" and not hidden:
                parts.append(" ")
            elif not place:
                if name == "p":
                    flush()
            elif name in BLOCKS:
                if name in TABLE_PARTS or place > opened.last(CELLS):
                    close(place)
            elif place > blocks_at[-1]:
                close(place)
            else:  # an inline element that holds open blocks: it ends, they stay
                opened.places[name].pop()
                stack[place][2] = False
                hidden -= name in HIDDEN
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br" and not hidden:
                parts.append(" ")
            continue
        if name in RAW:
            end = raw_end(name, scanner.source, scanner.at) if name not in scanner.missing else None
            if end is None:
                scanner.missing.add(name)
            scanner.at = end[1] if end else len(scanner.source)
            continue
        if (ended and name not in BLOCKS) or name == "html" or (name == "body" and opened.count("body")):
            continue
        if name in CLOSES:
            place = opened.last(CLOSES[name])
            if place > opened.last(BARS[name]):
                close(min(p for n in CLOSES[name] if (p := (opened.places.get(n) or [0])[-1]) > opened.last(BARS[name])))
        elif name in BLOCKS:
            place = opened.last(("p",))
            if place > opened.last(CELLS):
                close(place)
            if name in HEADINGS and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
        elif name == "a" and (place := opened.last(("a",))) > blocks_at[-1]:
            close(place)
        if name in BLOCKS:
            flush()
            words = _WORD.findall(" ".join(values).lower())
            up = stack[-1][1]
            parent = page.nodes[up]
            above = {parent.tag} | {f"word:{g}" for g in parent.groups}
            above = parent.above if above <= parent.above else parent.above | above
            page.nodes.append(Node(name, up, parent.depth + 1, frozenset(_GROUP[w] for w in words if w in _GROUP), above))
            blocks_at.append(len(stack))
            opened.push(name, len(page.nodes) - 1)
        else:
            opened.push(name, stack[-1][1])
        hidden += name in HIDDEN
    close(1)
    flush()
    return page


def unary(page: Page) -> list[list[int]]:
    """Feature numbers of each node."""
    found = []
    for n in page.nodes:
        f = ["bias", f"tag:{n.tag}" if n.tag in BLOCKS else "bias"]
        f += [f"word:{g}" for g in n.groups]
        f += [f"in:{t}" for t in n.above if t in ASIDE or t in ("article", "main")]
        f += [f"in-{g}" for g in n.above if g.startswith("word:")]
        if 5 * n.linked > n.chars:
            f.append("links:most" if 2 * n.linked > n.chars else "links:some")
        f.append("text:none" if not n.chars else "text:short" if n.chars < 40 else "text:middle" if n.chars < 200 else "text:long")
        if n.depth <= 2:
            f.append("depth:low")
        if n.stops:
            f.append("stop")
        found.append(sorted({INDEX[x] for x in f}))
    return found


@dataclass
class Forest:
    """The nodes of many pages as arrays; parents stand before their children."""

    features: np.ndarray  # feature numbers of all nodes, one node after the other
    owner: np.ndarray  # the node of each
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # nodes of each depth, the roots first

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each node, the sum of its features' weights."""
        return np.bincount(self.owner, weights[self.features], len(self.parent))

    def totals(self, values: np.ndarray) -> np.ndarray:
        """For each feature, the sum of the values of the nodes that have it."""
        return np.bincount(self.features, values[self.owner], len(FEATURES))


def forest(pages: list[Page]) -> Forest:
    parent, depth, kind, rows = [], [], [], []
    for page in pages:
        base = len(parent)
        rows += unary(page)
        for n in page.nodes:
            parent.append(n.parent + base if n.parent >= 0 else -1)
            depth.append(n.depth)
            kind.append(_KIND.get(n.tag, 0))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    features = np.fromiter((x for r in rows for x in r), np.int64, len(owner))
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    return Forest(features, owner, np.array(parent, np.int64), np.array(kind, np.int64), np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else [])


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((len(KIND_NAMES), 2, 2)))  # kind, parent, child


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis, keepdims=True))).squeeze(axis)


#: Levels of fewer nodes are worked on node by node: a page may be one deep chain.
NARROW = 4


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(node is content) and, for each node but roots, P(parent, child), by messages up and then down the trees."""
    n = len(trees.parent)
    own = np.zeros((n, 2))
    own[:, 1] = trees.sums(model.weights)
    up = np.zeros((n, 2))  # of a node to its parent
    below = own.copy()
    pairs = model.pairs.tolist()
    for level in reversed(trees.levels[1:]):
        if len(level) < NARROW:
            for i in level.tolist():
                a, b = below[i].tolist()
                (w, x), (y, z) = pairs[trees.kind[i]]
                up[i] = message = (_log_add(a + w, b + x), _log_add(a + y, b + z))
                below[trees.parent[i]] += message
            continue
        up[level] = _log_sum(below[level][:, None, :] + model.pairs[trees.kind[level]], 2)
        np.add.at(below, trees.parent[level], up[level])
    down = np.zeros((n, 2))
    for level in trees.levels[1:]:
        if len(level) < NARROW:
            for i in level.tolist():
                above = trees.parent[i]
                a, b = (below[above] - up[i] + down[above]).tolist()
                (w, x), (y, z) = pairs[trees.kind[i]]
                down[i] = (_log_add(a + w, b + y), _log_add(a + x, b + z))
            continue
        above = trees.parent[level]
        rest = below[above] - up[level] + down[above]
        down[level] = _log_sum(rest[:, :, None] + model.pairs[trees.kind[level]], 1)
    pair = np.zeros((n, 2, 2))
    child = np.flatnonzero(trees.parent >= 0)
    above = trees.parent[child]
    joint = (below[above] - up[child] + down[above])[:, :, None] + model.pairs[trees.kind[child]] + below[child][:, None, :]
    joint = np.exp(joint - joint.max((1, 2), keepdims=True)) if len(child) else joint
    pair[child] = joint / joint.sum((1, 2), keepdims=True)
    belief = below + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


def fit(pages: list[Page], steps: int = STEPS, rate: float = RATE) -> Model:
    """Gradient ascent on the likelihood of the pages' labels."""
    model = Model()
    if not pages:
        return model
    trees = forest(pages)
    label = np.array([n.label for p in pages for n in p.nodes])
    child = trees.parent >= 0
    seen = trees.totals(label)
    seen_pairs = np.zeros_like(model.pairs)
    np.add.at(seen_pairs, (trees.kind[child], label[trees.parent[child]], label[child]), 1)
    uses, pair_uses = np.maximum(np.bincount(trees.features, minlength=len(FEATURES)), 1), np.maximum(np.bincount(trees.kind[child], minlength=len(KIND_NAMES)), 1)[:, None, None]
    for _ in range(steps):
        content, pair = marginals(trees, model)
        expected = np.zeros_like(model.pairs)
        np.add.at(expected, trees.kind[child], pair[child])
        model.weights += rate * ((seen - trees.totals(content)) / uses - DECAY * model.weights)
        model.pairs += rate * ((seen_pairs - expected) / pair_uses - DECAY * model.pairs)
    return model


def label_by_elements(page: Page) -> bool:
    """Label nodes by `article` and `main`; False if the page has neither."""
    inside = False
    for n in page.nodes:
        apart = n.tag in ASIDE or n.above & ASIDE or n.groups - {"content"} or any(g.startswith("word:") and g != "word:content" for g in n.above)
        n.label = int(("article" in n.above or "main" in n.above or n.tag in ("article", "main")) and not apart)
        inside |= n.label == 1
    return inside


_TEXT = "The river rose for three days before the town took notice of it. People carried their things upstairs and waited. "
#: Labelled layouts: (page, main text blocks).
LAYOUTS = [
    ('<body><div id="header"><h1>Site name</h1><ul class="menu"><li><a>Home</a><li><a>About</a></ul></div><div id="content"><h2>Title</h2><p>{t}{t}</p><p>{t}</p><ul><li>{t}</li><li>One more item of the list.</li></ul></div><div id="sidebar"><h3>Related</h3><ul><li><a>Another story to read</a></ul></div><div id="footer"><p>All rights reserved.</p></div></body>', ("Title", "The river", "One more")),
    ('<body><div class="cookie-notice"><p>We use cookies to improve this site. Read more in our terms.</p></div><div class="topbar"><a>Login</a></div><div class="post"><h1>Title</h1><div class="entry"><p>{t}</p><blockquote><p>{t}</p></blockquote><p>Short one.</p></div></div><div class="comments"><h3>Comments</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>I agree with all of this. Thank you.</p></div></div></body>', ("Title", "The river", "Short one")),
    ('<body><header><h1>Paper</h1><p>News since 1900</p></header><nav><a>World</a> <a>Sport</a></nav><main><h1>Title</h1><p>{t}</p><div class="ad"><p>Buy one now. You will not regret it at all.</p></div><p>{t}{t}</p><aside><p>{t}</p></aside><table><tr><td>Level</td><td>Four metres</td></tr></table><section class="comments"><p>{t}</p></section></main><footer><p>Contact us by mail.</p></footer></body>', ("Title", "The river", "Level", "Four metres")),
    ('<body><article><header><h1>Title</h1></header><p>{t}</p><form><p>Sign up for news. It is free.</p></form><h2>Then</h2><p>{t}</p><div class="share"><a>Share</a></div></article><div class="related"><p>{t}</p></div><div class="comments"><ul><li><p>{t}</p></li></ul></div><footer>Imprint</footer></body>', ("Then", "The river")),
    ('<body><table><tr><td class="nav"><a>Start</a><br><a>News</a></td><td class="text"><p>{t}</p><p>{t}{t}</p></td><td class="banner"><p>Best prices in town. Come and see.</p></td></tr></table></body>', ("The river",)),
    ('<body><div><div><p>{t}</p><p>{t}</p><h3>Heading</h3><p>{t}</p></div></div><div class="newsletter"><p>Our letter comes every week. Sign up now.</p></div></body>', ("The river", "Heading")),
]


def written_pages() -> list[Page]:
    """The labelled layouts as pages: a block that begins like one of the main texts is content unless a marked ancestor
    or neighbour sets it apart, and so are the elements that hold content alone."""
    pages = []
    for source, starts in LAYOUTS:
        page = parse(source.format(t=_TEXT))
        for i, n in enumerate(page.nodes):
            apart = n.tag in ASIDE or n.above & ASIDE or (n.groups - {"content"}) or any(g.startswith("word:") and g != "word:content" for g in n.above)
            own = [t for k, t in page.blocks if k == i]
            n.label = int(not apart and bool(own) and all(t.startswith(starts) for t in own))
        for i in range(len(page.nodes) - 1, 0, -1):
            held = [c for c in page.nodes if c.parent == i]
            n = page.nodes[i]
            if held and not n.chars and n.tag != "body" and not (n.groups - {"content"}) and n.tag not in ASIDE and not n.above & ASIDE:
                n.label = int(any(c.label for c in held) and not any(k.startswith("word:") and k != "word:content" for k in n.above))
        pages.append(page)
    return pages


def train(pages: DataFrame, key: str = "page_id", column: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    total = max(1, pages.count())
    share = min(1_000_000, sample * 1_000_000 // total + 1)
    rows = pages.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).select(column).toLocalIterator()
    labelled = [p for p in (parse(r[0]) for r in rows) if label_by_elements(p)]
    return fit(labelled + written_pages() * max(1, len(labelled) // 40))


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    content, _ = marginals(forest(pages), model)
    found, base = [], 0
    for page in pages:
        found.append("\n".join(text for node, text in page.blocks if content[base + node] > 0.5))
        base += len(page.nodes)
    return found


def extract(pages: DataFrame, model: Model, key: str = "page_id", column: str = "html") -> DataFrame:
    """`key`, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = main_texts(common.texts(batch, column), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[key, "url", "text", "n_chars"])

    return common.map_batches(pages.select(key, "url", column), run, f"`{key}` {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(ship(spark), sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages))
