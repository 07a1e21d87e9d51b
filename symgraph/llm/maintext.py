"""Main text of web pages by composite text density.

A page is read into a tree of its block elements. For every node the density
is its characters per tag, adjusted by links: with C characters and T tags, LC
and LT of them in links, and R the page's share of linked characters,

    density = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + R * C + e))

where an empty denominator counts as one. The sum of the densities of a node's
children (each stretch of text of its own is a child as well) is greatest at
the node that holds the running text. The least density on the path from that
node up to the body is the page's threshold; from the body down, each node that
reaches it brings in the subtree with the greatest sum below it. So an article
in several parts is found whole, and what is thinner than the page stays out.

What no article consists of goes before densities are computed: elements whose
name says so (navigation, footers, asides, scripts, styles and so on), and
elements whose class, id or role names a menu, sidebar, notice, advert or
comment, headers outside of articles, and forms, unless they hold the page's
article (or, on a page without one, its main heading).

Tags that only format text (b, i, br and so on) are no nodes and do not count
as tags; a break is white space. Blocks with open formatting or paragraphs end
them, as pages often leave them open.

Cases: a null or empty page and a page without text give an empty text. Pages
cut off in the middle of a tag, comment or script are read up to there. Pages
of any length and depth are read whole, in time linear in their length. Repeated
rows give equal results; an empty table gives no rows. Columns asked for pass
through; a new column gets underscores added where its name would clash with
one of them.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

TOKEN = re.compile(
    r"""(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<stray><)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements that are nodes of the tree; all others only format text.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li",
    "main", "menu", "nav", "noscript", "object", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "svg", "table",
    "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul", "canvas", "audio", "video", "math",
}
#: Elements that are never part of an article.
NEVER = RAW | {
    "aside", "audio", "button", "canvas", "dialog", "fieldset", "footer", "head", "legend", "menu", "nav", "noscript", "object", "option",
    "search", "select", "svg", "template", "video",
}
#: A start tag in the first set ends an open element of the second, unless one of the third lies between them.
IMPLIED = [
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"option", "optgroup"}, {"option"}, {"select"}),
    ({"td", "th"}, {"td", "th"}, {"table"}),
    ({"tr"}, {"tr", "td", "th"}, {"table"}),
    ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
]
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a class, id or role that mark what surrounds an article.
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "alertdialog", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "nav", "navbar",
    "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "complementary", "widget", "footer", "contentinfo", "masthead", "topbar",
    "comment", "comments", "commentlist", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "pagination", "pager",
    "toolbar", "login", "search",
}
#: Those of readers' comments, which are often articles themselves.
COMMENT_HINTS = {"comment", "comments", "commentlist", "respond", "disqus"}


#: Where the content of each raw element ends.
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


class Node:
    __slots__ = ("name", "parent", "children", "hinted", "heads", "inside", "core", "chars", "tags", "linked", "links", "density", "total", "best", "marked")

    def __init__(self, name: str, parent: Node | None, hints: set[str] = frozenset()):
        self.name, self.parent = name, parent
        #: Nodes and texts in page order.
        self.children: list[Node | str] = []
        self.hinted = bool(hints & HINTS) and name not in HEADINGS and name not in ("html", "body", "main")
        #: Whether this is a header, and whether it lies in an article.
        self.heads = name == "header" or "header" in hints and name not in HEADINGS
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        #: Whether this is, or comes to hold, the page's article.
        self.core = name == "main" or name == "article" and not hints & COMMENT_HINTS
        self.chars = self.tags = self.linked = self.links = 0
        self.marked = False


def visible(text: str) -> int:
    """Characters that are not white space."""
    return sum(map(len, text.split()))


def _hints(rest: str) -> set[str]:
    return {w for m in ATTRIBUTE.finditer(rest) for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())}


def read_tree(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, each behind its parent. Characters, tags and links are counted for each node's own content."""
    root = Node("#root", None)
    nodes, stack, at, link = [root], [root], 0, None  # link: the node in which a link is open
    places = {}  # how often each name is open

    def close(depth: int) -> None:
        nonlocal link
        for node in stack[depth:]:
            places[node.name] -= 1
            link = None if link is node else link
        del stack[depth:]

    def close_within(names: set[str], bounds: set[str]) -> None:
        """End the open elements of these names above the last bound, and what they hold."""
        if any(places.get(n) for n in names):
            depth = None
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].name in bounds:
                    break
                depth = d if stack[d].name in names else depth
            if depth:
                close(depth)

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["stray"]
        if text:
            text = unescape(text) if "&" in text else text
            node, n = stack[-1], visible(text)
            node.children.append(text)
            node.chars += n
            node.linked += n if link else 0
            continue
        if not m["name"]:
            continue
        name, ends = m["name"].lower(), bool(m["end"])
        if name in RAW:
            if not ends:
                closing = RAW_END[name].search(page, at)
                at = closing.end() if closing else len(page)
        elif name in ("br", "hr"):
            stack[-1].children.append(" ")
        elif name == "a":
            link = None if ends else stack[-1]
            stack[-1].links += not ends
        elif name in BLOCKS and not ends:
            if places.get("p"):
                close_within({"p"}, {"td", "th", "caption", "button", "object", "table", "article", "section", "div", "li"})
            for starts, ended, bounds in IMPLIED:
                if name in starts:
                    close_within(ended, bounds)
            if name in HEADINGS and stack[-1].name in HEADINGS:
                close(len(stack) - 1)
            node = Node(name, stack[-1], _hints(m["rest"]) if "=" in m["rest"] else frozenset())
            stack[-1].children.append(node)
            nodes.append(node)
            if not m["rest"].endswith("/") or name not in ("svg", "object", "canvas", "math"):
                stack.append(node)
                places[name] = places.get(name, 0) + 1
        elif name in BLOCKS and places.get(name):
            if name not in ("body", "html"):  # what follows their ends is still theirs
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                close(depth)
    return root, nodes


def density(chars: int, tags: int, linked: int, links: int, share: float) -> float:
    """Characters per tag, adjusted by links; ``share`` is the page's share of linked characters."""
    if not chars:
        return 0.0
    plain = chars / max(tags, 1)
    if not share:
        return plain
    base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
    return plain * math.log(max(chars / max(linked, 1) * max(tags, 1) / max(links, 1), 1.0)) / math.log(base)


def main_text(page: str | None) -> str:
    root, nodes = read_tree(page or "")
    if not any(n.core for n in nodes):  # then the main heading tells where it is
        for node in nodes:
            node.core = node.name == "h1"
    for node in reversed(nodes[1:]):
        node.parent.core |= node.core
    chars, linked = sum(n.chars for n in nodes if n.name != "head"), sum(n.linked for n in nodes)
    share = linked / chars if chars else 0.0
    body = next((n for n in nodes if n.name == "body"), root)

    # Parents come first, so a node under what goes has gone already when it is reached.
    kept: set[Node] = set()
    for node in nodes:
        surrounds = node.hinted or node.name == "form" or node.heads and not node.inside
        if (node.parent is None or node.parent in kept) and node.name not in NEVER and (node.core or not surrounds):
            kept.add(node)

    for node in reversed(nodes):
        if node not in kept:
            continue
        node.tags += node.links
        node.density = density(node.chars, node.tags, node.linked, node.links, share)
        own = [c for c in node.children if isinstance(c, str)]
        node.total = sum(density(visible(c), 1, 0, 0, share) for c in own)
        node.best = node
        for child in node.children:
            if isinstance(child, Node) and child in kept:
                node.total += child.density
        for child in node.children:
            if isinstance(child, Node) and child in kept and child.best.total > node.best.total:
                node.best = child.best
        if node.parent is not None:
            up = node.parent
            up.chars, up.linked, up.links, up.tags = up.chars + node.chars, up.linked + node.linked, up.links + node.links, up.tags + node.tags - node.links + 1

    if body not in kept or not body.chars:
        return ""
    node = body.best
    least = node.density
    while node is not body:
        node = node.parent
        least = min(least, node.density)
    waiting = [body]
    while waiting:
        node = waiting.pop()
        if node.density >= least:
            node.best.marked = True
            waiting += [c for c in node.children if isinstance(c, Node) and c in kept]
    return _told(body, kept)


def _told(body: Node, kept: set[Node]) -> str:
    """The texts of marked subtrees in page order; a block's edge parts words as white space does."""
    out: list[str] = []
    waiting: list[tuple[Node | str, bool]] = [(body, body.marked)]
    while waiting:
        item, marked = waiting.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        out.append(" ")
        waiting.append((" ", True))
        for child in reversed(item.children):
            if isinstance(child, Node):
                if child in kept:
                    waiting.append((child, marked or child.marked))
            elif marked:
                waiting.append((child, True))
    return " ".join("".join(out).split())


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text``, the main text, and ``n_chars``, its code points."""

    def read(texts: list[str | None]) -> tuple[list[str], list[int]]:
        found = [main_text(t) for t in texts]
        return found, list(map(len, found))

    return map_texts(pages, keep, {"text": ("string", pa.string()), "n_chars": ("long", pa.int64())}, read, text=html)
