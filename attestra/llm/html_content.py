"""Main text of web pages by a tree-structured graphical model.

The elements of a page are the nodes of a tree; each is content or not. A node has a
potential from its own features (element, names, length, links) and shares one with its
parent, by kind of edge. Sum-product messages go up and down the tree once and give each
node's exact marginal. The weights are fitted by gradient ascent on the likelihood of
labelled pages, whose gradient the same messages give. Text of a block is kept if its
node is more likely content than not.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bounded, table
from attestra.llm.html_pages import labelled_pages

#: A tag with its attributes as HTML reads them: a quote opens a value only right after the equals sign, and a value without quotes ends
#: at white space or ``>``. A quote that nothing closes opens none. Nothing is tried twice, so the time is linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >]*+))?+)*+)(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r >]*+)))?+""")
NAMED = {"class", "id", "role", "data-y"}
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "title", "textarea", "iframe", "xmp"}  # no tags inside; but for xmp the text is none of the page's
FOREIGN = {"svg", "math"}
HTML_IN_FOREIGN = {"~foreignobject", "~desc", "~annotation-xml", "~mi", "~mo", "~mn", "~ms", "~mtext"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "b", "i", "em", "strong", "u", "s", "small", "sub", "sup", "code", "mark", "span", "font", "abbr", "cite", "q", "kbd", "samp", "var", "time", "del", "ins", "big", "tt", "bdi", "bdo", "dfn", "label", "button", "svg", "math", "object"}
CLOSES_P = {"p", "div", "article", "section", "aside", "nav", "header", "footer", "main", "ul", "ol", "dl", "table", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "hr", "fieldset", "address", "details", "dialog", "xmp"}
SIBLING = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

GROUPS = [
    {"p"}, {"article"}, {"main"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend"},
    {"div"}, {"section"}, {"table", "tr", "td", "th", "tbody", "thead", "caption"}, {"blockquote", "pre", "figure", "figcaption", "xmp"}, {"dialog", "button", "label"}, {"html", "body"}, INLINE,
]
NAMES = [
    {"article", "content", "post", "entry", "story", "main", "body", "text"},
    {"nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"},
    {"header", "masthead", "topbar", "branding", "logo", "banner", "top"},
    {"footer", "copyright", "legal", "bottom", "colophon", "foot"},
    {"sidebar", "aside", "widget", "related", "recommended", "recommend", "trending", "popular", "side", "more"},
    {"ad", "ads", "advert", "advertisement", "adbox", "promo", "promotion", "sponsored", "sponsor", "commercial", "adsense"},
    {"cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "disclaimer", "overlay", "privacy", "warning"},
    {"newsletter", "subscribe", "signup", "login", "search", "form", "register", "subscription"},
    {"comment", "comments", "discussion", "reply", "replies", "review", "reviews", "disqus", "respond"},
    {"share", "social", "sharing", "follow", "tags", "byline", "meta", "author"},
    {"wrapper", "container", "layout", "row", "page", "wrap"},
]
FEATURES = 1 + len(GROUPS) + len(NAMES) + 12
EDGE_KINDS = 3
INSIDE_BLOCKS = INLINE | {"td", "th", "noscript", "template", "select"}
NEXT_TAG = re.compile(r"</?[a-zA-Z]|<!--")


def named(attributes: str) -> dict[str, str]:
    """The values of the attributes that name an element, of repeated ones the first."""
    values: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        if k.lower() in NAMED:
            values.setdefault(k.lower(), a or b or c)
    return values


def inside_block(tag: str) -> bool:
    """Whether an element ends no block: also any element of a formula or drawing, which has ``~`` before its name."""
    return tag in INSIDE_BLOCKS or tag[0] == "~"


def closed_at_once(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not the end of a value."""
    return attributes.endswith("/") and max((m.end() for m in ATTRIBUTE.finditer(attributes)), default=0) < len(attributes)


class Stack(list):
    """Open elements with their nodes, and how many of each name are open."""

    def __init__(self) -> None:
        super().__init__([("#page", 0)])
        self.open: Counter = Counter()

    def append(self, item: tuple[str, int]) -> None:
        super().append(item)
        self.open[item[0]] += 1

    def pop(self) -> tuple[str, int]:
        item = super().pop()
        self.open[item[0]] -= 1
        return item

    def cut(self, at: int) -> None:
        while len(self) > at:
            self.pop()

    def set_node(self, node: int) -> None:
        self[-1] = (self[-1][0], node)


class Page:
    """The elements of a page in order, its runs of text, and where blocks end."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.label = ["#page"], [-1], [""], [0]
        self.runs: list[tuple[int, str, bool] | None] = []  # element, text, inside a link; None ends a block
        self._read(html)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        names, label = "", 0
        for k, value in named(attributes).items():
            if k == "data-y":
                label = int(value == "1")
            else:
                names += " " + value
        self.tag.append(tag), self.parent.append(parent), self.names.append(names), self.label.append(label)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack = Stack()  # plain inline elements share their parent's node
        at, n, links, runs = 0, len(html), 0, self.runs
        endless: set[str] = set()
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                runs.append((stack[-1][1], html[at:lt], links > 0))
            if lt == n:
                break
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if html[lt + 1 : lt + 2] in ("!", "?"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(html, lt)
            if not m:
                runs.append((stack[-1][1], "<", links > 0))
                at = lt + 1
                continue
            at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
            if closing:
                links -= self._close(tag, stack)
                continue
            foreign = stack[-1][0] in FOREIGN or stack[-1][0][0] == "~"
            if tag in RAW:
                begin = stop = at
                if not closed_at_once(attributes):
                    end = None if tag in endless else re.compile(rf"</{tag}(?=[\t\n\f\r />])[^>]*(?:>|$)", re.I).search(html, at)
                    if end:
                        stop, at = end.start(), end.end()
                    else:  # never closed: the page goes on at the next tag
                        endless.add(tag)
                        end = NEXT_TAG.search(html, at)
                        stop = at = end.start() if end else n
                if tag == "xmp":
                    links -= self._close("p", stack) if stack.open["p"] else 0
                    runs += [None, (self._open(tag, stack[-1][1], attributes), entities.escape(html[begin:stop], False), links > 0)]
                runs.append(None) if tag not in ("script", "style") and not foreign else None
                continue
            if tag in VOID:
                runs.append((stack[-1][1], " ", False) if tag != "hr" else None)
                continue
            if tag in ("html", "head", "body"):
                if tag == "body" and stack[-1][0] == "#page":
                    stack.append((tag, self._open(tag, 0, attributes)))
                continue
            if foreign and stack[-1][0] not in HTML_IN_FOREIGN:
                if tag not in CLOSES_P:
                    if not closed_at_once(attributes):
                        stack.append((f"~{tag}", stack[-1][1]))
                    runs.append((stack[-1][1], " ", False))
                    continue
                while stack[-1][0] in FOREIGN or stack[-1][0][0] == "~":  # a block ends a formula or drawing
                    stack.pop()
            if tag in FOREIGN and closed_at_once(attributes):
                continue
            if tag in CLOSES_P and stack.open["p"]:
                links -= self._close("p", stack)
            if tag in SIBLING:
                same, scope = SIBLING[tag]
                for i in range(len(stack) - 1, 0, -1) if any(stack.open[t] for t in same) else ():
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in same:
                        links -= sum(t == "a" for t, _ in stack[i:])
                        stack.cut(i)
                        runs.append(None)
                        break
            if tag == "a":
                links += 1
            if tag in INLINE and not named(attributes):
                stack.append((tag, stack[-1][1]))
                if tag == "button":
                    stack.set_node(self._open(tag, stack[-1][1], attributes))
            else:
                stack.append((tag, self._open(tag, stack[-1][1], attributes)))
                if tag in ("td", "th"):
                    runs.append((stack[-1][1], " ", False))
                elif not inside_block(tag):
                    runs.append(None)

    def _close(self, tag: str, stack: Stack) -> int:
        """End the innermost element of a name; how many links that ends."""
        same = (tag, f"~{tag}")
        for i in range(len(stack) - 1, 0, -1) if stack.open[tag] or stack.open[same[1]] else ():
            if stack[i][0] in same:
                gone = stack[i:]
                if tag in INLINE and any(t not in INLINE and t[0] != "~" for t, _ in gone[1:]):
                    return 0  # a stray inline end doesn't end blocks
                stack.cut(i)
                if not all(inside_block(t) for t, _ in gone):
                    self.runs.append(None)
                return sum(t == "a" for t, _ in gone)
        if tag in ("p", "br"):
            self.runs.append(None if tag == "p" else (stack[-1][1], " ", False))
        return 0

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, linked, own, marks, blocks = (np.zeros(n) for _ in range(5))
        for run in self.runs:
            if run:
                node, text, link = run
                k = len(text) - text.count(" ")
                own[node] += k
                linked[node] += k * link
                marks[node] += text.count(".") + text.count("?") + text.count("!") + text.count(",")
        chars += own
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            blocks[p] += self.tag[i] == "p"
        x = np.zeros((n, FEATURES))
        x[:, 0] = 1
        for i, (tag, names) in enumerate(zip(self.tag, self.names, strict=True)):
            for k, group in enumerate(GROUPS):
                if tag in group:
                    x[i, 1 + k] = 1
                    break
            if names:
                words = {w.lower() for w in NAME_WORDS.findall(names)}
                for k, known in enumerate(NAMES):
                    if not known.isdisjoint(words):
                        x[i, 1 + len(GROUPS) + k] = 1
        k = 1 + len(GROUPS) + len(NAMES)
        density = linked / np.maximum(chars, 1)
        for j, value in enumerate((chars == 0, chars < 20, chars < 80, chars > 300, chars > 1500, own > 80, density > 0.3, density > 0.7, marks > chars / 60, blocks > 0, blocks > 2, np.log1p(chars) / 8)):
            x[:, k + j] = value
        return x

    def edges(self) -> np.ndarray:
        """Kind of each node's edge to its parent: below the page itself, into an inline element, other."""
        return np.array([0 if p <= 0 or self.tag[p] == "body" else 1 if t in INLINE else 2 for t, p in zip(self.tag, self.parent, strict=True)])

    def text(self, content: np.ndarray) -> str:
        blocks, part = [], []
        for run in [*self.runs, None]:
            if run is None:
                if part and (block := " ".join("".join(part).split())):
                    blocks.append(block)
                part = []
            elif content[run[0]]:
                part.append(entities.unescape(run[1]) if "&" in run[1] else run[1])  # a reference ends with its run
        return "\n".join(blocks)


class Forest:
    """Nodes of many pages, by depth, for messages in whole levels."""

    def __init__(self, pages: list[Page]):
        self.features = np.concatenate([p.features() for p in pages])
        self.kind = np.concatenate([p.edges() for p in pages])
        sizes = np.array([len(p.tag) for p in pages])
        self.start = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, self.start, strict=True)])
        self.parent[self.start] = -1
        depth: list[int] = []
        for p in self.parent.tolist():
            depth.append(depth[p] + 1 if p >= 0 else 0)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginal of each node, of each edge by both ends, and the logarithm of the normaliser."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = self.features @ weights
        up, below = np.zeros((n, 2)), own.copy()  # below: own potential and all messages from children
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(edge[self.kind[level]] + below[level][:, None, :], axis=2)
            np.add.at(below, self.parent[level], up[level])
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = below[self.parent[level]] + down[self.parent[level]] - up[level]
            joint = edge[self.kind[level]] + above[:, :, None]
            down[level] = np.logaddexp.reduce(joint, axis=1)
            joint = joint + below[level][:, None, :]
            pair[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
        total = below + down
        norm = np.logaddexp.reduce(total, axis=1)
        return np.exp(total[:, 1] - norm), pair, float(norm[self.levels[0]].sum())


@lru_cache(maxsize=2)
def trained(pages: int = 700, seed: int = 11, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and edges, by gradient ascent on the labelled pages' likelihood with a small penalty."""
    parsed = [Page(h) for h in labelled_pages(pages, seed)]
    forest = Forest(parsed)
    y = np.concatenate([np.array(p.label) for p in parsed]).astype(float)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(FEATURES + 4 * EDGE_KINDS)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, pair, _ = forest.marginals(theta[:FEATURES], theta[FEATURES:].reshape(EDGE_KINDS, 2, 2))
        expected = np.zeros((EDGE_KINDS, 2, 2))
        np.add.at(expected, forest.kind[inner], pair[inner])
        slope = np.concatenate([forest.features.T @ (y - p), (seen - expected).ravel()]) / pages - 0.002 * theta
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        theta = theta + 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-8)
    return theta[:FEATURES], theta[FEATURES:].reshape(EDGE_KINDS, 2, 2)


def extract_texts(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    parsed = [Page(h or "") for h in pages]
    if not parsed:
        return []
    forest = Forest(parsed)
    p, _, _ = forest.marginals(*model)
    cuts = [*forest.start.tolist(), len(p)]
    return [page.text(p[a:b] > 0.5) for page, a, b in zip(parsed, cuts, cuts[1:], strict=False)]


def extract_content(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch_chars: int = 1_000_000) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    The whole html is read; null counts as empty. ``text`` is empty where no block is
    content. Repeated and null ids pass through, an empty table gives an empty result.
    Other columns are not read.
    """
    model = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part, chars = [], [], 0
            for h in batch.column(2).to_pylist():
                part.append(h)
                chars += len(h or "")
                if chars >= batch_chars:
                    texts += extract_texts(part, model)
                    part, chars = [], 0
            texts += extract_texts(part, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(bounded(read, 2), "page_id long, url string, text string, n_chars long")


def op2_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(table(spark, sf_dir, "pages"))
