"""Main text of HTML pages by composite text density.

For a node with C characters, T tags, LC characters and LT tags of links inside it,

    density = C / T * log_b(C / LC * T / LT),   b = ln(LC * C / (C - LC) + C * LC_body / C_body + e)

(zero counts are one).  A node's sum is that of its children's densities; the page's text is the subtree with the
largest sum among the nodes that are at least as dense as the sparsest node on the path from
the body to the densest sum.  If that node lies inside an ``article`` or ``main`` element, or holds
just one, this element is the subtree; otherwise headings before it on the way up to the body come with it.

Before, what cannot be article text is left out: menus, headers, footers, sidebars, forms, scripts, styles and
embedded objects by their tags, and notices, adverts, sharing bars, reader comments and the like by the words of
their ``class``, ``id`` and ``role``, unless they hold the page's first-level heading or main element.  Lists and boxes inside the
article that are nothing but links are menus.

Null and empty pages and pages without text give an empty text.  Broken markup is read as browsers read it where
that matters for text: unclosed paragraphs, list items, cells and comments end where the next begins or the page ends,
a reference or tag cut off by the end of the page is text or markup.  Repeated rows give repeated rows; an empty table
gives none; other columns stay and may have any name but ``__text``.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)?"""
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^A-Za-z>][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/=]|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)|'([^']*)|([^\s>]+)))?""", re.I)

# The kinds of HTML elements.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
           "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What ends an open element of a kind, and what an end must not reach across.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
_WALLS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "select", "aside", "nav"}
_LEFT_OUT = {"head", "nav", "menu", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "template", "svg", "math", "canvas",
             "audio", "video", "object", "applet", "map", *_RAW}
_LEFT_OUT_WORDS = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "masthead", "header",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "paywall", "promo", "promotion", "ad", "ads", "adsense", "adslot", "advert", "adverts",
    "advertisement", "advertising", "sponsor", "sponsored", "share", "sharing", "social", "related", "recommended", "recommendations",
    "comment", "comments", "commentlist", "disqus", "discussion", "replies", "respond", "toolbar", "pagination", "pager", "widget", "widgets",
    "search", "searchbox", "skip", "complementary", "contentinfo", "dialog",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NEVER_LEFT_OUT = {"html", "body", "main", "article", "p", *_HEADINGS}


class Page:
    """Nodes in page order (a node's subtree is a range of numbers) and the texts between tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.out = ["#"], [-1], [0], [False]
        self.pieces: list[tuple[int, str]] = []  # (node, text); a space for the end of a block
        open_, stack = {}, [0]

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                self.end[node] = len(self.tag)
                open_[self.tag[node]] -= 1

        def depth_of(names: set[str] | tuple[str, ...], walls: set[str]) -> int:
            """Of the innermost open element with one of the names, 0 if none."""
            if any(open_.get(n) for n in names):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in names:
                        return depth
                    if tag in walls:
                        return 0
            return 0

        at = 0
        for found in iter(lambda: _MARKUP.search(source, at), None):
            self._text(stack[-1], source[at:found.start()])
            at = found.end()
            closing, name, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3)
            if not name:
                continue
            inline = name in _INLINE
            if not inline:
                self.pieces.append((stack[-1], " "))
            if closing:
                depth = depth_of((name,), set() if not inline else _WALLS | {"p", "td", "th", "li"} | _HEADINGS)
                if depth:
                    close_to(depth)
            elif name not in _VOID:
                if not inline:
                    depth = depth_of(("p",), {"table", "td", "th", "button", "object"})
                    if depth:
                        close_to(depth)
                    for_walls = _WALLS if name in ("li", "dt", "dd") else {"table", "select"}
                    while name in _ENDED_BY and (depth := depth_of(_ENDED_BY[name], for_walls)):
                        close_to(depth)
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.end.append(node + 1)
                self.out.append(name in _LEFT_OUT or (bool(attributes) and self._left_out(name, attributes)))
                if name in _RAW:  # up to its own end tag
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = close.start() if close else len(source)
                stack.append(node)
                open_[name] = open_.get(name, 0) + 1
            if not inline:
                self.pieces.append((stack[-1], " "))
        self._text(stack[-1], source[at:])
        close_to(1)
        self.end[0] = len(self.tag)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.pieces.append((node, html.unescape(text)))

    @staticmethod
    def _left_out(name: str, attributes: str) -> bool:
        if name in _NEVER_LEFT_OUT - {"article", "p"}:
            return False
        for kind, *value in _NAMED.findall(attributes):
            text = "".join(value).lower()
            if kind.lower() == "hidden" or (kind.lower() == "style" and re.search(r"display\s*:\s*none", text)):
                return True
            if kind.lower() in ("class", "id", "role") and any(w in _LEFT_OUT_WORDS for w in re.split(r"[^a-z]+", text)):
                return True
        return False

    def inside(self, node: int, tags: set[str]) -> bool:
        while node > 0:
            if self.tag[node] in tags:
                return True
            node = self.parent[node]
        return False


def _excluded(page: Page) -> list[bool]:
    """Which nodes are left out, with all below them."""
    n = len(page.tag)
    holds = [t in ("h1", "main") for t in page.tag]
    for node in range(n - 1, 0, -1):
        holds[page.parent[node]] |= holds[node]
    gone = [False] * n
    for node in range(1, n):
        tag = page.tag[node]
        own = page.out[node] and (tag in _LEFT_OUT or not holds[node])
        if tag == "header":  # a page's header, not an article's with its heading
            own = not (holds[node] and page.inside(page.parent[node], {"article", "main"}))
        gone[node] = gone[page.parent[node]] or own
    return gone


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    base = math.log(lc * c / max(1, c - lc) + c * share + math.e)
    t, lc, lt = max(1, t), max(1, lc), max(1, lt)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1e-3) if c > 1 else 0.0


def main_text(source: str | None) -> str:
    """The article of a page, in one line."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    gone = _excluded(page)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    link = [False] * n
    for node in range(1, n):
        link[node] = link[page.parent[node]] or page.tag[node] == "a"
    for node, text in page.pieces:
        if not gone[node]:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += size if link[node] else 0
    for node in range(n - 1, 0, -1):
        if not gone[node]:
            up = page.parent[node]
            chars[up] += chars[node]
            tags[up] += tags[node] + 1
            link_chars[up] += link_chars[node]
            link_tags[up] += link_tags[node] + (page.tag[node] == "a")
    if not chars[0]:
        return ""
    _without_menus(page, gone, chars, link_chars, link_tags)
    body = next((k for k in range(1, n) if page.tag[k] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density = [0.0 if gone[k] else _density(chars[k], tags[k], link_chars[k], link_tags[k], share) for k in range(n)]
    total = [0.0] * n
    for node in range(1, n):
        total[page.parent[node]] += density[node]
    best = max(range(n), key=lambda k: (total[k], chars[k], -k))
    path = _path(page, best, body)
    threshold = min(density[k] for k in path)
    dense = [k for k in range(n) if not gone[k] and density[k] >= threshold]
    best = max(dense, key=lambda k: (total[k], chars[k], -k), default=best)
    chosen = _article(page, best, gone, chars)
    kept = [(chosen, page.end[chosen])]
    if page.tag[chosen] not in ("article", "main"):
        for node in _path(page, chosen, body)[:-1]:  # headings before it
            kept += [(k, page.end[k]) for k in range(page.parent[node] + 1, node)
                     if page.parent[k] == page.parent[node] and page.tag[k] in ("h1", "h2") and not gone[k]]
    texts = [text for node, text in page.pieces if not gone[node] and any(lo <= node < hi for lo, hi in kept)]
    return " ".join("".join(texts).split())


def _path(page: Page, node: int, body: int) -> list[int]:
    """From a node up to the body, or the top for one outside it."""
    out = [node]
    while node not in (body, 0):
        node = page.parent[node]
        out.append(node)
    return out


def _article(page: Page, best: int, gone: list[bool], chars: list[int]) -> int:
    """The article or main element around the node, or the only one inside it; else the node."""
    node, around = best, 0
    while node > 0:
        if page.tag[node] in ("article", "main"):
            around = node
            if page.tag[node] == "article":
                return _article_in(page, around, best)
        node = page.parent[node]
    if around:
        return around
    inner = [k for k in range(best + 1, page.end[best]) if page.tag[k] in ("article", "main") and not gone[k] and chars[k]]
    outer = [k for k in inner if not any(j < k < page.end[j] for j in inner)]
    return outer[0] if len(outer) == 1 and 2 * chars[outer[0]] >= chars[best] else best


def _article_in(page: Page, article: int, best: int) -> int:
    """The outermost article around an article."""
    node = page.parent[article]
    while node > 0:
        if page.tag[node] == "article":
            article = node
        node = page.parent[node]
    return article


def _without_menus(page: Page, gone: list[bool], chars: list[int], link_chars: list[int], link_tags: list[int]) -> None:
    """Leaves out lists and boxes of which all text is links, three or more."""
    for node in range(1, len(page.tag)):
        if gone[page.parent[node]]:
            gone[node] = True
        elif page.tag[node] in ("ul", "ol", "div", "section", "table") and link_tags[node] >= 3 and link_chars[node] == chars[node] < chars[0]:
            gone[node] = True


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with __text, the main text of the column html."""
    @F.arrow_udf("string")
    def text_of(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(s.as_py()) for s in sources], pa.string())

    return pages.withColumn("__text", text_of(pages["html"]))
