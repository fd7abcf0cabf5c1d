"""Main text of web pages by composite text density.

A page becomes a tree of its elements, menus, adverts, forms and other furniture pruned. Every
element's density is its characters per tag, adjusted by how much of its text stands in links; the
sum of its children's densities tells how much running text hangs under it. The block of the largest
sum is where the text is; from it the way leads towards the body as long as elements are at least as
dense as the body, the threshold. No element counts as the text for its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title textarea select option button svg canvas iframe object audio video map datalist".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - {"br", "body", "html", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of class, id and role that name furniture.
MARKS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promotion related replies respond share sharing "
    "sidebar social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo search dialog alert".split()
)
#: What closes when such an element opens, up to the element that holds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: Words that beside "header" tell that it heads a text, and marks of what readers wrote.
HEADS_TEXT = frozenset("article content entry post section story title".split())
OF_READERS = frozenset("comment comments commentlist discussion disqus replies respond".split())
#: Elements of running text: there a mark only counts as the last word of a name, as in cookie-notice, not in social-history.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote span em strong b i".split())


class Node:
    __slots__ = ("tag", "up", "parts", "hidden", "marks", "chars", "tags", "link_chars", "link_tags", "density", "total", "run", "titled", "article")

    def __init__(self, tag: str, up: Node | None, hidden: bool = False, marks: frozenset[str] = frozenset()):
        self.tag, self.up, self.hidden, self.marks = tag, up, hidden, marks
        self.parts: list[Node | str] = []
        self.density = self.total = 0.0
        self.run, self.titled, self.article = 0, tag in ("h1", "main"), tag == "article"


def _marks(tag: str, attrs: list) -> frozenset[str]:
    """Words of class, id and role that name furniture."""
    found = set()
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            for name in v.lower().split():
                words = [w for w in re.split(r"[^a-z]+", name) if w]
                own = MARKS.intersection(words[-1:] if tag in RUNNING else words)
                found |= own - {"header"} if not HEADS_TEXT.isdisjoint(words) else own
    return frozenset(found)


class Tree(HTMLParser):
    """A forgiving tree builder: end tags may be missing or stray."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.open: Counter[str] = Counter()  # elements of every name above the place that is reached

    def _leave(self, node: Node) -> None:
        """Go on in the element that holds the node."""
        while self.at is not node.up:
            self.open[self.at.tag] -= 1
            self.at = self.at.up

    def _close(self, wanted: set[str], within: set[str]) -> None:
        if not any(self.open[t] for t in wanted):
            return
        node = self.at
        while node.up is not None and node.tag not in within:
            if node.tag in wanted:
                self._leave(node)
                return
            node = node.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"table", "td", "th", "li", "button", "article", "section", "div", "main", "body"})
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I) for k, v in attrs)
        node = Node(tag, self.at, hidden, _marks(tag, attrs) if attrs and tag not in ("html", "body", "article", "main") else frozenset())
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up is not None and self.open[tag]:
            if node.tag == tag:
                self._leave(node)
                return
            if tag not in BLOCK and node.tag in BLOCK:
                return  # a stray inline end tag closes no block
            node = node.up

    def unknown_decl(self, data: str) -> None:
        """Declarations of no known kind hold no text."""

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known keyword: it ends with the next bracket
            end = self.rawdata.find(">", i)
            return len(self.rawdata) if end < 0 else end + 1

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _furniture(node: Node) -> bool:
    """Whether an element is furniture whatever it holds; a header is where it heads the page, in the page's body or its first element."""
    if node.tag == "header":
        return node.hidden or node.up.tag in ("body", "html", "#root") or any(not isinstance(x, str) and x.tag == "nav" for x in node.parts)
    return node.hidden or node.tag in SILENT or node.tag in FURNITURE


def _dropped(node: Node, most: int) -> bool:
    """Whether an element goes with all that it holds.

    Names are evidence only: what they call furniture stays if more than half of the page's running
    text hangs under it together with a title or, unless readers wrote it, an article.
    """
    if _furniture(node) or not node.marks:
        return _furniture(node)
    return 2 * node.run <= most or not (node.titled or node.article and OF_READERS.isdisjoint(node.marks))


def _measured(root: Node) -> list[Node]:
    """Prune furniture, then count characters, tags and link text bottom-up; nodes in page order."""
    every, todo = [], [root]
    while todo:
        node = todo.pop()
        every.append(node)
        if node.tag != "a":
            todo.extend(x for x in node.parts if not isinstance(x, str) and not _furniture(x))
    for node in reversed(every):
        node.run += sum(len(x) for x in node.parts if isinstance(x, str)) if node.tag != "a" else 0
        if node.up is not None:
            node.up.run += node.run
            node.up.titled |= node.titled
            node.up.article |= node.article
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.parts = [x for x in node.parts if isinstance(x, str) or not _dropped(x, root.run)]
        todo.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9) + 1)
        # Inline elements are text of their block: what is bold throughout is no container.
        node.total = sum(x.density if x.tag in BLOCK else x.total for x in node.parts if not isinstance(x, str))
    return order


def _chosen(order: list[Node]) -> Node:
    """The element that holds the main text.

    From the block of the largest sum the way leads up towards the body, as long as the next element
    is no sparser than the body as a whole: titles, leads and further sections of the text join,
    columns of short or linked text would make it sparser.
    """
    body = next((n for n in order if n.tag == "body"), order[0])
    best = max((n for n in order if n.tag in BLOCK or n is body), key=lambda n: n.total, default=body)
    if not best.total:
        return body
    threshold = body.density
    while best is not body and best.up is not None and best.up is not body and best.up.density >= threshold:
        best = best.up
    return best


def _blocks(node: Node) -> Iterator[str]:
    """Text pieces in page order; a None between them marks the edge of a block."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None or isinstance(x, str):
            yield x
        elif x.tag in BLOCK:
            todo.append(None)
            todo.extend(reversed(x.parts))
            todo.append(None)
        else:
            todo.extend(reversed(x.parts))


def main_text(html: str | None) -> str:
    """The article text of one page: white space in a block is one space, blocks are joined by one space."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    out, block = [], []
    for x in (*_blocks(_chosen(_measured(tree.root))), None):
        if x is not None:
            block.append(x)
        elif block:
            if text := " ".join("".join(block).split()):
                out.append(text)
            block = []
    return " ".join(out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text and n_chars (code points).

    Null, empty or tag-only pages give an empty text. Repeated rows are extracted each by itself;
    other columns are ignored; an empty table gives an empty result. Pages of any length are parsed
    whole, one at a time.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInPandas(kernel, "page_id long, url string, text string, n_chars long")
