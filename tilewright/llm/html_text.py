"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements. Elements that are never article text (menus, adverts,
forms, scripts and so on) are left out. Every paragraph passes points for its length and its
commas to its ancestors, less the further up; a container's points are discounted by the share
of its text that stands in links. From the best container the way goes up to the article around
it, which is kept whole. A page that marks no article keeps all that stands beside the container and
is no header, footer or block of links, however short; blocks are put out in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "fieldset", "footer", "form", "head", "iframe", "input", "map", "math", "menu",
    "meter", "nav", "noscript", "object", "optgroup", "option", "progress", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
#: Dropped elements that nothing leads to.
INVISIBLE = {"input", "link", "noscript", "script", "style", "template"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Words of a class or id that mark an element as no part of the article.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "banners", "breadcrumb", "breadcrumbs",
    "comment", "comments", "commentlist", "consent", "cookie", "cookies", "dialog", "disclaimer", "disqus", "dropdown", "footer", "gdpr", "login",
    "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay",
    "pager", "pagination", "paywall", "popup", "promo", "promos", "promotion", "recommended", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "topbar",
    "widget", "widgets",
}
#: Marks that are also plain words: on a paragraph or heading they don't say that it is no part of the article.
WEAK = {"dialog", "disclaimer", "overlay", "promotion", "recommended", "related", "respond", "search", "share", "sharing", "skip", "subscription"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PLAIN = {"p", "pre", "blockquote", *HEADINGS}
#: An open element that a new one of the given name closes, unless a barrier stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"ul", "ol", "dl", "table", "menu"}
#: Elements whose class says nothing about their text.
UNMARKED = {"html", "body", "article", "main"}
_COMMENT_END = re.compile(r"--!?>")
#: Words before a mark that turn it round, and marks of parts that readers write.
NEGATIONS = {"no", "non", "not", "without", "with", "has", "have", "hide", "free"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
#: Share of the page's unlinked text above which a compound class name doesn't drop an element.
MOST = 0.5
#: How a line begins that closes a page without a footer element.
_FOOTER = re.compile(r"\s*(\u00a9|\(c\)|copyright\b)", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Node:
    __slots__ = ("tag", "parent", "children", "drop", "doubt", "score", "size", "linked", "prior")

    def __init__(self, tag: str, parent: _Node | None, drop: bool = False, doubt: str = "", prior: float = 0.0):
        self.tag, self.parent, self.children, self.drop, self.doubt = tag, parent, [], drop, doubt
        self.score, self.size, self.linked, self.prior = 0.0, 0, 0, prior


def _dropped(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is never article text, by its tag, role, style, or a class or id that is a mark."""
    if tag in DROPPED:
        return True
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and _HIDDEN.search(value.lower()):
            return True
        if name in ("class", "id") and tag not in UNMARKED:
            marks = MARKS.intersection(value.lower().split())
            if marks - WEAK if tag in PLAIN else marks:
                return True
    return False


def _doubt(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """A mark that is part of a compound class name or id without a word that turns it round; empty if there is none."""
    if tag in UNMARKED:
        return ""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for one in value.lower().split():
                words = _WORDS.findall(one)
                marks = [w for i, w in enumerate(words) if w in MARKS and not (tag in PLAIN and w in WEAK) and NEGATIONS.isdisjoint(words[:i] + words[i + 1 : i + 2])]
                if marks:
                    return "comment" if not COMMENTS.isdisjoint(marks) else marks[0]
    return ""


class _Tree(HTMLParser):
    """Builds the tree of a page that is fed at once; unclosed and misplaced tags are mended the way browsers do in common cases.

    Open elements are counted by name, inline ones for each open block, so that an end tag without
    a start costs nothing and every other one closes what it passes.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root", None)
        self.doubts = False
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[_Node, Counter[str]]] = [(self.root, Counter())]

    # Comments, declarations and tags without an end reach to the end of the page.
    def parse_comment(self, i, report=True):
        for short in (">", "->"):
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def _to_bracket(self, i):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            return end + 3 if end >= 0 else len(self.rawdata)
        return self._to_bracket(i)

    def parse_bogus_comment(self, i, report=1):
        return self._to_bracket(i)

    def parse_pi(self, i):
        return self._to_bracket(i)

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        return len(self.rawdata) if end < 0 else end

    def parse_endtag(self, i):
        end = super().parse_endtag(i)
        return len(self.rawdata) if end < 0 else end

    def _push(self, node: _Node) -> None:
        self.at.children.append(node)
        self.at = node
        self.open[node.tag] += 1
        if node.tag in BLOCKS:
            self.blocks.append((node, Counter()))
        else:
            self.blocks[-1][1][node.tag] += 1

    def _close(self, node: _Node) -> None:
        """Close ``node`` and all that is open inside it."""
        while True:
            at = self.at
            self.at = at.parent
            self.open[at.tag] -= 1
            if at.tag in BLOCKS:
                self.blocks.pop()
            else:
                self.blocks[-1][1][at.tag] -= 1
            if at is node:
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.at.children.append(" ")
            elif tag == "hr":
                self._close_paragraph()
                self.at.children.append(_Node("hr", self.at))
            return
        if tag in BLOCKS:
            self._close_paragraph()
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag]):
            for node, _ in reversed(self.blocks):
                if node.tag in BARRIERS:
                    break
                if node.tag in CLOSES[tag]:
                    self._close(node)
                    break
        drop = _dropped(tag, attrs)
        doubt = _doubt(tag, attrs) if attrs and not drop else ""
        self.doubts = self.doubts or bool(doubt)
        self._push(_Node(tag, self.at, drop, doubt, 25.0 if tag in ("article", "main") else 0.0))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close_paragraph(self):
        block = self.blocks[-1][0]
        if block.tag == "p":
            self._close(block)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            if self.open[tag]:
                self._close(next(node for node, _ in reversed(self.blocks) if node.tag == tag))
        elif self.blocks[-1][1][tag]:  # an inline end tag closes nothing outside its block
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._close(node)

    def handle_data(self, data):
        self.at.children.append(data)


def _settle_doubts(root: _Node) -> None:
    """Drop the elements in doubt, but for those that hold most of the page's unlinked text.

    Parts that readers write hold the article only if its own element or main heading is in them.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        stack += [(c, inside or c.tag == "a") for c in node.children if isinstance(c, _Node) and not c.drop]
    plain: dict[int, int] = {}
    holds: set[int] = set()
    for node, inside in reversed(order):
        below = [c for c in node.children if isinstance(c, _Node)]
        plain[id(node)] = sum(plain.get(id(c), 0) for c in below) + (0 if inside else sum(len(c.strip()) for c in node.children if isinstance(c, str)))
        if any(c.tag in ("article", "main", "h1") or id(c) in holds for c in below):
            holds.add(id(node))
    total = plain[id(root)]
    for node, _ in order:
        if node.doubt and (plain[id(node)] <= MOST * total or (node.doubt == "comment" and id(node) not in holds)):
            node.drop = True


def _measure(node: _Node, linked: bool) -> None:
    """Sizes of text and of linked text below each kept element, and the points of its paragraphs."""
    stack = [(node, linked, False)]
    while stack:
        at, inside, done = stack.pop()
        if done:
            for c in at.children:
                if isinstance(c, _Node) and not c.drop:
                    at.size += c.size
                    at.linked += c.linked
            if at.tag in BLOCKS or at.tag == "#root":
                _credit(at)
            continue
        stack.append((at, inside, True))
        for c in at.children:
            if isinstance(c, str):
                n = len(c.strip())
                at.size += n
                at.linked += n if inside else 0
            elif not c.drop:
                stack.append((c, inside or c.tag == "a", False))


def _own_text(node: _Node) -> str:
    """Text that stands in the element itself and not in a block below it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.drop and c.tag not in BLOCKS:
            stack += reversed(c.children)
    return _SPACE.sub(" ", "".join(parts)).strip()


def _credit(node: _Node) -> None:
    text = _own_text(node)
    if not text or node.tag in HEADINGS:
        return
    points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else len(text) / 25
    if node.tag not in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote"):
        node.score += points  # loose text is a paragraph of its own container
        up, share = node.parent, 0.5
    else:
        up, share = node.parent, 1.0
    while up is not None and share > 0.05:
        up.score += points * share
        up, share = up.parent, share / 2


def _final(node: _Node) -> float:
    return (node.score + (node.prior if node.size else 0)) * (1 - node.linked / max(1, node.size))


def _is_menu(node: _Node) -> bool:
    """A list of links only."""
    return node.tag in ("ul", "ol", "dl") and node.size > 0 and node.linked >= 0.9 * node.size


def _in_article(node: _Node) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _text(node: _Node) -> str:
    """The first characters of an element's text."""
    out, stack, n = [], [node], 0
    while stack and n < 40:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
            n += len(c.strip())
        elif not c.drop:
            stack += reversed(c.children)
    return "".join(out)


def _beside(parent: _Node, best: _Node) -> list:
    """What stands beside the best container of a page that marks no article: all of it but what is no article text.

    Left out are page headers, blocks of mostly links, footer lines, and a heading (no h1) right
    before what is left out. Length decides nothing.
    """
    kept, headings = [], []
    for c in parent.children:
        if isinstance(c, str):
            if c.strip():
                kept += [*headings, c]
                headings = []
        elif c.tag in HEADINGS and not c.drop:
            headings.append(c)
        elif c.drop or (c is not best and c.size and (c.tag == "header" or c.linked > 0.5 * c.size or _FOOTER.match(_text(c)))):
            if headings and headings[-1].tag != "h1" and c.tag not in INVISIBLE:
                headings.pop()  # it leads to what is left out
        elif c.size or c.tag in VOID:
            kept += [*headings, c]
            headings = []
    return kept + headings


def _blocks(node: _Node, out: list[str]) -> None:
    """Blocks of an element in page order.

    A list of links is a menu where it leads or ends a container that is no article; with text
    before and after it, or inside an article, it is part of the text.
    """
    parts: list[str] = []
    found: list[tuple[str, bool]] = []
    menu = 0  # menus that the walk is in

    def flush():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append((text, menu > 0))
        parts.clear()

    stack: list = [node]
    end, end_menu = object(), object()
    listed = node.tag not in ("article", "main")
    while stack:
        c = stack.pop()
        if c is end:
            flush()
        elif c is end_menu:
            flush()
            menu -= 1
        elif isinstance(c, str):
            parts.append(c)
        elif not c.drop:
            if c.tag in BLOCKS:
                flush()
                if listed and _is_menu(c):
                    menu += 1
                    stack.append(end_menu)
                else:
                    stack.append(end)
            if c.tag == "header" and c is not node and (listed and not _in_article(c) or c.linked > 0.5 * c.size):
                stack += [x for x in reversed(c.children) if isinstance(x, _Node) and (x.tag in HEADINGS or x.tag == "hgroup")]
            else:
                stack += reversed(c.children)
    flush()
    own = [i for i, (_, m) in enumerate(found) if not m]
    out += [text for text, _ in found[own[0] : own[-1] + 1]] if own else []


def _whole(best: _Node) -> _Node:
    """The article around the best container: the nearest article or main element, else the highest element below the body with little linked text."""
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    node = best
    while node.parent is not None and node.parent.tag not in ("body", "html", "#root") and node.parent.linked <= 0.25 * node.parent.size:
        node = node.parent
    return node


def main_text(html: str) -> str:
    """The page's main text: blocks joined by two line feeds; empty if there is none."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    if tree.doubts:
        _settle_doubts(tree.root)
    _measure(tree.root, False)
    best, nodes, stack = None, [], [tree.root]
    while stack:
        at = stack.pop()
        nodes.append(at)
        stack += [c for c in reversed(at.children) if isinstance(c, _Node) and not c.drop]
    for at in nodes:
        if (at.tag in BLOCKS or at.tag == "#root") and at.size and at.tag not in ("p", *HEADINGS) and (best is None or _final(at) > _final(best)):
            best = at
    if best is None:
        best = tree.root
    best = _whole(best)
    out: list[str] = []
    if not _in_article(best):
        around = best if best.parent is None or best.tag in ("body", "html") else best.parent
        beside = _Node(around.tag, None)
        beside.children, beside.size, beside.linked = _beside(around, best), around.size, around.linked
        _blocks(beside, out)
    else:  # an article says itself what belongs to it; others beside it are kept if they score well
        least = max(10.0, 0.2 * _final(best))
        leading: list[_Node] = []  # headings since the last other element
        for c in best.parent.children:
            if isinstance(c, str) or c.drop or c.tag not in BLOCKS | {"#root"}:
                continue
            if c.tag in HEADINGS:
                leading.append(c)
                continue
            good = c.size - c.linked >= 80 and c.linked <= 0.25 * c.size
            if c is best or (c.tag == "p" and good) or (c.tag not in ("header", "p") and _final(c) >= least):
                for x in [*leading, c]:
                    _blocks(x, out)
            leading = []
    return "\n\n".join(out)


def extract_text(html: Column) -> Column:
    """Main text of a column of pages; empty for null and empty ones."""

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) if p else "" for p in pages.tolist()], dtype=object)

    return of(F.coalesce(html, F.lit("")))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every row of ``pages``.

    Each row is read alone and whole: repeated rows stay, an empty table stays empty, a null
    or empty page has an empty text. Pages of any length are read in linear time. Columns of the input named like the added ones are replaced.
    """
    return pages.withColumn("__text", extract_text(F.col(html_col))).withColumns(
        {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    ).drop("__text")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", "n_chars")
