"""Main text of web pages by scoring the element tree.

The page is parsed into a tree with the usual repairs of unclosed elements.  Every paragraph passes
points for its length and its commas to its ancestors, a half less with each step, discounted by the
share of its text that is in links.  The container with most points is kept (or the article or main
element around it), with those of its siblings that carry text or score well.  Menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles are taken out before the scoring; so is a
header within an article, with what it holds.

The work grows in proportion to the page: lengths, commas and points are passed up once, from the leaves
to the root, and an end tag without an open element costs one look-up.

Null counts as an empty page, which has an empty text; markup that stops in the middle is read as far
as it goes, and an unfinished tag or declaration is not text.  Unknown declarations count as comments.  An empty table gives no rows, repeated rows give the same text, extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea iframe svg canvas object video audio "
    "dialog menu".split()
)
KEPT = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion promoted sidebar "
    "sidebars sidenav menu menus nav navbar navigation topnav breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist reply replies respond discussion disqus widget widgets toolbar pagination pager copyright "
    "disclaimer skip".split()
)
PARAGRAPH = frozenset("p pre blockquote li dd td th h1 h2 h3 h4 h5 h6 figcaption".split())
LISTS = frozenset("ul ol div section table dl".split())
# an opening tag closes an open element of these, unless one of the bounds lies between
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
P_BOUNDS = frozenset("html body article main section div td th table li blockquote header footer aside nav form button object".split())


SCOPES = frozenset("article main td th table".split())
UNFINISHED = re.compile(r"<[!?/a-zA-Z]")


class Node:
    __slots__ = ("tag", "dropped", "kids", "parent", "points", "n", "linked", "commas", "place")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.kids: list = []
        self.points, self.n, self.linked, self.commas, self.place = 0.0, 0, 0, 0, 0


def _unwanted(tag: str, attrs: list) -> bool:
    if tag in DROPPED:
        return True
    if tag in KEPT:
        return False
    for k, v in attrs:
        v = (v or "").lower()
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in ROLES:
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True
        if k in ("class", "id") and not MARKS.isdisjoint(re.split(r"[\s_\-:.]+", v)):
            return True
    return False


class Tree(HTMLParser):
    """Builds the tree; ``dropped`` marks elements whose content is not wanted."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        # how many elements of a tag are open, in all and below the last element that inline end tags do not leave
        self.open, self.inside = Counter(), [Counter()]

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _enter(self, node: Node) -> None:
        self.at.kids.append(node)
        self.at = node
        self.open[node.tag] += 1
        if node.tag in SCOPES:
            self.inside.append(Counter())
        else:
            self.inside[-1][node.tag] += 1

    def _leave(self, node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        while True:
            x = self.at
            self.at = x.parent
            self.open[x.tag] -= 1
            if x.tag in SCOPES:
                self.inside.pop()
            else:
                self.inside[-1][x.tag] -= 1
            if x is node:
                return

    def _close(self, tags, bounds) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in bounds:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.at is self.root:
            return
        if tag in VOID:
            self.at.kids.append(Node(tag, self.at, tag != "br" and tag != "hr"))
            return
        if tag in BLOCK:
            self._close(("p",), P_BOUNDS)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self._enter(Node(tag, self.at, _unwanted(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not (self.open[tag] if tag in BLOCK else self.inside[-1][tag]):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self._leave(node)

    def handle_data(self, data):
        if data:
            self.at.kids.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    if UNFINISHED.match(tree.rawdata):
        tree.rawdata = ""
    tree.close()
    return tree.root


def _walk(root: Node):
    """Wanted elements in page order, each before its children."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def _measure(nodes: list[Node]) -> None:
    """Length and commas of the text of each element, and length of its links, from the leaves up."""
    for i, node in enumerate(nodes):
        node.place = i
    for node in reversed(nodes):
        own = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        kids = [k for k in node.kids if isinstance(k, Node) and not k.dropped]
        node.n = own + sum(k.n for k in kids)
        node.commas = sum(k.count(",") for k in node.kids if isinstance(k, str)) + sum(k.commas for k in kids)
        node.linked = node.n if node.tag == "a" else sum(k.linked for k in kids)


def _density(node: Node) -> float:
    return node.linked / node.n if node.n else 0.0


def _inline_text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            stack.extend(reversed(x.kids))
    return "".join(out)


def _score(nodes: list[Node]) -> None:
    """Pass points up, from the leaves: what reaches an element that takes points goes on by half."""
    passed: dict[Node, float] = {}
    for node in reversed(nodes):
        points = 0.0
        if node.n and (node.tag in PARAGRAPH or node.tag in LISTS | KEPT and any(isinstance(k, str) and k.strip() for k in node.kids)):
            commas = node.commas if node.tag in PARAGRAPH else sum(k.count(",") for k in node.kids if isinstance(k, str))
            points = (min(1.0, node.n / 25) + commas + min(node.n / 100, 3.0)) * (1 - _density(node))
        up = passed.pop(node, 0.0) + (0.0 if node.tag in PARAGRAPH else points)
        if node.tag not in PARAGRAPH or node.tag in ("td", "li", "dd", "blockquote"):
            node.points += up
            up /= 2
        if node.tag in PARAGRAPH:
            up += points
        if up and node.parent is not None:
            passed[node.parent] = passed.get(node.parent, 0.0) + up


def _blocks(root: Node, out: list[str], lists: bool = True) -> None:
    """Texts of the blocks below an element, in page order; ``lists``: with those that are mostly links."""
    parts: list[str] = []

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
        parts.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.dropped or not lists and x is not root and x.tag in LISTS and x.n and _density(x) > 0.5:
            continue
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(x.kids))
        else:
            stack.extend(reversed(x.kids))
    flush()


def _common(nodes: list[Node], best: Node) -> tuple[Node, set[Node]]:
    """The highest element with several branches that score near the best (else the best's parent), and these branches."""
    value = lambda x: x.points * (1 - _density(x))
    branches: dict[Node, set[Node]] = {}
    for x in nodes:
        if value(x) < value(best) * 0.5 or x.parent is None:
            continue
        while x.parent is not None and x not in branches.get(x.parent, ()):
            branches.setdefault(x.parent, set()).add(x)
            x = x.parent
    found, up = best.parent, best.parent
    while up is not None:
        if len(branches[up]) > 1:
            found = up
        up = up.parent
    return found, branches[found]


def main_text(html: str | None) -> str:
    """Main text of a page: blocks joined by line breaks, empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    nodes = list(_walk(root))
    _measure(nodes)
    if not root.n:
        return ""
    _score(nodes)
    best = max(nodes, key=lambda x: (x.points * (1 - _density(x)), -x.place))
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    out: list[str] = []
    if up is not None:
        _blocks(up, out)
    elif best.parent is None or best.points <= 0:
        _blocks(root, out, lists=False)
    else:
        parent, near = _common(nodes, best)
        least = max(3.0, best.points * 0.2)
        for x in parent.kids:
            if not isinstance(x, Node) or x.dropped:
                continue
            heading = x.tag in ("h1", "h2", "h3")
            prose = x.tag == "p" and _density(x) < 0.25 and (x.n > 80 or "." in _inline_text(x))
            if x in near or heading or prose or x.points >= least and _density(x) < 0.5:
                _blocks(x, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` (all columns but the markup) with text and n_chars."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(main_text)

    cols = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    out = pages.select(*cols, text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
