"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is cut at block-level tags into flat blocks of text. Each block has its word count and link density, those of the blocks
before and after it, and what kind of element it stands in. A decision tree, trained in numpy on the small labelled table below,
says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import append_columns

# Fixed values of HTML: elements that end a block, elements that nest.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul video audio".split())
_NESTING = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section "
    "table ul p span li td tr button".split())
_CHROME = frozenset("nav footer aside form menu dialog fieldset button".split())
_CONTENT = frozenset(("article", "main"))
# Class, id or role words of what surrounds an article.
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|sidebar|side|aside|nav\w*|menus?|breadcrumbs?|footer|masthead|comments?|commentlist|replies|reply|disqus|respond|"
    r"share|sharing|social|related|recommended|login|signup|search|pagination|pager|toolbar|skip|complementary|contentinfo|widget)(?:$|[\s_-])", re.I)
# The same of what holds the page's own heading: around an article, but not within one.
_HEAD_NAME = re.compile(r"(?:^|[\s_-])(?:header|topbar|branding|logo)(?:$|[\s_-])", re.I)
# Of what holds the article where no element says so.
_CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Within an article only whole class tokens and roles of these say that something is not part of it: its parts are named by their subjects.
_CONTAINERS = frozenset("div section aside ul".split())
_CLASS_OR_ROLE = re.compile(r"""(?<![\w-])(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Without a closing tag, HTML reads the first group of elements to the end of the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|title|textarea|iframe)(?![a-z0-9:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)

# Elements that go with what they hold up to their closing tag; without one, the tag alone goes.
_DROPPED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("svg", "select")}
# HTML elements that end an svg, unless they stand in a part of it that holds HTML.
_ENDS_SVG = re.compile(
    r"<(/?)(foreignobject|desc|title)(?![a-z0-9:-])|<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|"
    r"ol|p|pre|ruby|s|small|span|strike|strong|sub|sup|table|tt|u|ul|var)(?![a-z0-9:-])", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "in_chrome", "in_content", "page_has_content", "is_heading")

# The labelled table: features in the order above, then 1 for main text. Word counts are counts, densities shares of words.
LABELLED = np.array([
    # pages with an article element: its paragraphs, short ones and headings too
    (120, 0.00, 80, 0.0, 60, 0.0, 0, 1, 1, 0, 1), (45, 0.05, 120, 0.0, 90, 0.0, 0, 1, 1, 0, 1), (1, 0.00, 60, 0.0, 45, 0.0, 0, 1, 1, 0, 1),
    (3, 0.00, 2, 0.0, 3, 0.0, 0, 1, 1, 0, 1), (7, 0.00, 9, 0.0, 40, 0.0, 0, 1, 1, 1, 1), (9, 1.00, 40, 0.0, 30, 0.0, 0, 1, 1, 0, 1),
    (300, 0.01, 7, 0.0, 5, 0.0, 0, 1, 1, 0, 1), (15, 0.00, 0, 0.0, 0, 0.0, 0, 1, 1, 0, 1), (12, 0.60, 30, 0.1, 20, 0.0, 0, 1, 1, 0, 1),
    (2, 0.00, 1, 1.0, 200, 0.0, 0, 1, 1, 1, 1), (60, 0.00, 10, 1.0, 8, 0.0, 0, 1, 1, 0, 1), (5, 0.00, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 1),
    (11, 0.00, 8, 0.0, 90, 0.0, 0, 1, 1, 1, 1), (9, 0.00, 1, 1.0, 2, 0.0, 0, 1, 1, 1, 1), (4, 0.00, 3, 1.0, 3, 1.0, 0, 1, 1, 0, 1),
    (2, 1.00, 3, 1.0, 2, 1.0, 0, 1, 1, 0, 1), (8, 0.90, 9, 0.5, 7, 1.0, 0, 1, 1, 0, 1), (5, 0.50, 12, 0.0, 0, 0.0, 0, 1, 1, 0, 1),
    (50, 0.60, 2, 1.0, 3, 0.5, 0, 1, 1, 0, 1), (6, 0.00, 70, 0.0, 4, 1.0, 0, 1, 1, 0, 1), (1, 0.00, 0, 0.0, 0, 0.0, 0, 1, 1, 0, 1),
    (14, 0.00, 4, 0.6, 12, 0.6, 0, 1, 1, 0, 1), (3, 0.70, 25, 0.6, 60, 0.1, 0, 1, 1, 1, 1), (10, 0.00, 6, 0.9, 1, 1.0, 0, 1, 1, 0, 1),
    # what stands around and inside it
    (1, 1.00, 1, 1.0, 1, 1.0, 1, 0, 1, 0, 0), (8, 0.00, 1, 1.0, 7, 0.0, 1, 0, 1, 0, 0), (12, 0.00, 45, 0.0, 0, 0.0, 1, 0, 1, 0, 0),
    (60, 0.00, 80, 0.0, 50, 0.0, 1, 0, 1, 0, 0), (40, 0.00, 120, 0.0, 30, 0.0, 1, 1, 1, 0, 0), (9, 0.00, 60, 0.0, 70, 0.0, 1, 1, 1, 0, 0),
    (90, 0.00, 30, 0.0, 40, 0.0, 1, 1, 1, 0, 0), (3, 1.00, 90, 0.0, 3, 1.0, 1, 1, 1, 0, 0), (2, 0.00, 9, 0.0, 30, 0.0, 1, 1, 1, 1, 0),
    (4, 0.00, 0, 0.0, 1, 1.0, 0, 0, 1, 1, 0), (25, 0.00, 90, 0.0, 3, 1.0, 0, 0, 1, 0, 0), (6, 0.00, 3, 1.0, 9, 0.0, 0, 0, 1, 0, 0),
    (70, 0.00, 4, 0.0, 6, 1.0, 0, 0, 1, 0, 0), (2, 1.00, 60, 0.0, 2, 1.0, 0, 0, 1, 0, 0), (5, 0.50, 8, 0.0, 8, 0.0, 0, 0, 1, 1, 0),
    # pages without one: long blocks with few links, and short ones between them
    (80, 0.00, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (35, 0.05, 3, 1.0, 80, 0.0, 0, 0, 0, 0, 1), (25, 0.00, 6, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (18, 0.00, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (4, 0.00, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (1, 0.00, 30, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (6, 0.00, 2, 1.0, 70, 0.0, 0, 0, 0, 1, 1), (7, 0.00, 0, 0.0, 40, 0.0, 0, 0, 0, 1, 1), (3, 0.00, 45, 0.0, 20, 0.1, 0, 0, 0, 1, 1),
    (200, 0.10, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1), (22, 0.20, 35, 0.1, 30, 0.0, 0, 0, 0, 0, 1), (16, 0.00, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (1, 1.00, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (2, 1.00, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (5, 0.00, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (8, 0.90, 40, 0.0, 5, 1.0, 0, 0, 0, 0, 0), (40, 0.80, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (6, 0.00, 4, 0.5, 3, 1.0, 0, 0, 0, 0, 0),
    (9, 0.00, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (30, 0.60, 20, 0.7, 30, 0.6, 0, 0, 0, 0, 0), (4, 0.00, 3, 1.0, 6, 0.0, 0, 0, 0, 0, 0),
    (30, 0.00, 60, 0.0, 50, 0.0, 1, 0, 0, 0, 0), (10, 0.00, 40, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (90, 0.00, 9, 0.0, 40, 0.0, 1, 0, 0, 0, 0),
    (3, 1.00, 3, 1.0, 3, 1.0, 1, 0, 0, 0, 0), (12, 0.00, 2, 1.0, 90, 0.0, 1, 0, 0, 0, 0), (2, 0.00, 60, 0.0, 8, 0.0, 1, 0, 0, 1, 0),
])


@dataclass
class Tree:
    """A binary tree: rows with feature <= threshold go left."""

    feature: int = -1
    threshold: float = 0.0
    label: bool = False
    left: Tree | None = field(default=None)
    right: Tree | None = field(default=None)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.label)
        goes_left = x[:, self.feature] <= self.threshold
        out = np.empty(len(x), bool)
        out[goes_left] = self.left.predict(x[goes_left])
        out[~goes_left] = self.right.predict(x[~goes_left])
        return out


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Grow a tree by Gini impurity; of equal splits the first feature and the smallest threshold win."""
    leaf = Tree(label=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return leaf
    best = (np.inf, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for threshold in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= threshold
            impurity = sum(len(part) * (part.mean() * (1 - part.mean())) for part in (y[left], y[~left]))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(threshold))
    if best[1] < 0:
        return leaf
    left = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], leaf.label, train_tree(x[left], y[left], depth - 1), train_tree(x[~left], y[~left], depth - 1))


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    chrome: bool
    content: bool
    heading: bool


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order. Character references are decoded; white space is one space."""
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    # Open nesting elements: name, whether it is around the article, whether it is content, whether it is in an article element.
    stack: list[tuple[str, bool, bool, bool]] = []
    chrome = content = heading = in_link = False

    def close_block() -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                link_words = len("".join(linked).split())
                found.append(Block(whole, whole.count(" ") + 1, link_words, chrome, content, heading))
            text.clear()
            linked.clear()

    def add(raw: str) -> None:
        decoded = html.unescape(raw)
        text.append(decoded)
        if in_link:
            linked.append(decoded + " ")

    at = 0
    unclosed: set[str] = set()

    def end_of(name: str, start: int) -> int:
        """Where an element of _DROPPED that is open at `start` ends."""
        end = None if name in unclosed else _DROPPED[name].search(page, start)
        if end is None:
            unclosed.add(name)
            return start
        if name == "svg":
            depth = 0
            for m in _ENDS_SVG.finditer(page, start, end.start()):
                if m.group(2):
                    depth += -1 if m.group(1) else 1
                elif depth <= 0:
                    return m.start()
        return end.end()

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(2) == "/"
        if name in _DROPPED and not closing and not (name == "svg" and m.group(4).rstrip().endswith("/")):
            at = end_of(name, at)
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = not closing
        if name in _BLOCK:
            close_block()
            in_link = in_link and name == "a"
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
        if name not in _NESTING:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(s[1] != stack[i - 1][1] if i else s[1] for s in stack[i:]) and text:
                        close_block()
                    del stack[i:]
                    break
        elif not m.group(4).rstrip().endswith("/"):
            attributes = m.group(4)
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            around, inside, in_article = stack[-1][1:] if stack else (False, False, False)
            if name in _CONTENT:
                around, inside, in_article = around and inside, True, True
            elif name in _CHROME or name == "header" and not in_article:
                around = True
            if attributes and name not in _CONTENT:
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
                if in_article:
                    tokens = " ".join(a or b or c for a, b, c in _CLASS_OR_ROLE.findall(attributes)).split() if name in _CONTAINERS else []
                    is_chrome = any(m and m.end() - m.start() == len(t) for t in tokens for m in [_CHROME_NAME.match(t)])
                else:
                    is_chrome = bool(_CHROME_NAME.search(names))
                if is_chrome or _HEAD_NAME.search(names) and not in_article or _HIDDEN.search(attributes):
                    if text:
                        close_block()
                    around = True
                elif _CONTENT_NAME.search(names):
                    inside = True
            stack.append((name, around, inside, in_article))
        chrome, content = stack[-1][1:3] if stack else (False, False)
    if at < len(page):
        add(page[at:] if "<" not in page[at:] else re.sub(r"<[a-zA-Z/!][^>]*\Z", "", page[at:]))
    close_block()
    return found


def features_of(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    own = np.array([(b.words, b.link_words / b.words) for b in blocks], float).reshape(n, 2)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0:2] = own
    x[1:, 2:4] = own[:-1]
    x[:-1, 4:6] = own[1:]
    x[:, 6] = [b.chrome for b in blocks]
    x[:, 7] = [b.content for b in blocks]
    x[:, 8] = any(b.content and not b.chrome for b in blocks)
    x[:, 9] = [b.heading for b in blocks]
    return x


def main_text(page: str | None, tree: Tree) -> str:
    """The main text of one page: its main blocks joined by line breaks; empty for a null or empty page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = tree.predict(features_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """`pages` with `text` (main text of the whole page, empty if it has none) and `n_chars` (its code points).

    Null pages count as empty ones; equal pages get equal texts; rows are neither dropped nor merged. Input columns named
    `text` or `n_chars` are replaced.
    """
    tree = train_tree(LABELLED[:, :-1], LABELLED[:, -1] > 0)
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(page, tree) for page in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    # A page column that is itself called like a result is read before it is replaced.
    source = pages.withColumn("__page", F.col(html_column)) if html_column in fields.names else pages
    name = "__page" if html_column in fields.names else html_column
    out = append_columns(source, name, compute, fields)
    return out.drop("__page")
