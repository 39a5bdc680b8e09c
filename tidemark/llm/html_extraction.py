"""Main-text extraction by tree scoring.

A page is read into a tree with the usual tolerance: omitted end tags are implied, stray ones ignored. Elements that
are no content (scripts, styles, navigation, and by role, class or id menus, sidebars, adverts and reader comments) are
cut off, page headers and footers too. Elements whose class only hints (notices, promotions, headers and the like) are
cut off unless they hold more than half of the page's points, forms unless they hold nine tenths of all text. Every
paragraph, that is every block with text of its own, passes points to its ancestors: one, one a comma, and one a hundred
characters; its parent gets all, its grandparent half, the next a third. What a paragraph passes and what an element has
are discounted by its link density, the part of its text in links. The element with most points is the container; if it
lies in an ``article``, that is taken instead, with the other articles beside it that have a fifth of its points. Siblings
of a container are kept with it if they have a fifth of its points, are long paragraphs of few links, or are a heading
before it.

Character references are decoded in each piece of text by itself, white space in a block becomes one space, and blocks
are joined in page order by a line feed. If the rules on classes leave nothing, they are dropped for that page.

A null or empty page gives an empty text. Long pages and deep trees are read without recursion, in time linear in
their length. Repeated rows give a row each. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "aside", "button", "select", "option", "menu", "dialog", "svg", "object", "canvas", "audio", "video", "map", "fieldset", "label"}
EDGE = {"header", "footer"}
HEAD = RAW - {"textarea", "iframe", "xmp"} | {"base", "link", "meta"}  # others end an open head
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"td", "th", "li", "div", "article", "section", "blockquote", "body", "main"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form"}
JUNK = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "pager", "pagination", "replies", "sidebar", "skip", "sponsor",
    "sponsored",
}
HINTS = {
    "banner", "modal", "notice", "notices", "notification", "popup", "promo", "promoted", "promotion", "related", "share", "sharing", "social", "subscribe",
    "toolbar", "widget",
}
CONTENT = {"article", "content", "entry", "post", "story"}  # a header of one of these is its title
HEADINGS = {"h1", "h2"}


class Node:
    __slots__ = ("tag", "parent", "children", "junk", "hinted", "in_article", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, junk: bool = False, hinted: bool = False) -> None:
        self.tag, self.parent, self.junk, self.hinted = tag, parent, junk, hinted
        self.children: list[Node | str] = []
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.points, self.chars, self.linked = 0.0, 0, 0


def _verdict(tag: str, attributes: str, inside: bool, by_class: bool) -> tuple[bool, bool]:
    """Whether an element is no content, and whether it only may be none."""
    if tag in DROPPED or tag in EDGE and not inside or tag == "footer":
        return True, False
    hinted = form = tag == "form"
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return False, hinted
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            if by_class and words & JUNK:
                return True, False
            hinted |= by_class and bool(words & HINTS or "header" in value and not inside and not words & CONTENT)
        elif name == "role":
            if value in ROLES and not (form and value == "form"):
                return True, False
        elif name == "hidden" or name == "aria-hidden" and value == "true" or re.search(r"display\s*:\s*none", value):
            return True, False
    return False, hinted


def parse(page: str, by_class: bool = True) -> tuple[Node, list[Node]]:
    """The root and all elements, parents first."""
    at = root = Node("#root", None)
    nodes, opened = [root], Counter()
    place, raw_until = 0, None
    for m in TOKEN.finditer(page):
        if raw_until is not None:
            if not (m[1] or m[4]) or (m[2] or m[5]).lower() != raw_until:
                continue
            raw_until, place = None, m.start()
        if m.start() > place:
            if at.tag == "head" and page[place : m.start()].strip():
                at = _close(at, "head", opened)
            at.children.append(page[place : m.start()])
        place = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                while at.tag != tag:
                    opened[at.tag] -= 1
                    at = at.parent
                opened[tag] -= 1
                at = at.parent
            continue
        if opened["head"] and tag not in HEAD:
            at = _close(at, "head", opened, frozenset())
        if tag in VOID:
            at.children.append(" " if tag in INLINE else "\n")
            if tag not in INLINE:
                at.children.append(Node(tag, at))
            continue
        block = tag not in INLINE
        if block and opened["p"]:
            at = _close(at, "p", opened)
        if tag in ENDS and tag != "p":
            for other in ENDS[tag]:
                if opened[other]:
                    at = _close(at, other, opened, HOLDS[tag])
        attributes = m[3] or m[6] or ""
        junk, hinted = _verdict(tag, attributes, at.in_article, by_class)
        node = Node(tag, at, at.junk or junk, hinted)
        at.children.append(node)
        nodes.append(node)
        if attributes.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            raw_until = tag
        at = node
        opened[tag] += 1
    if raw_until is None and place < len(page):
        if at.tag == "head" and page[place:].strip():
            at = _close(at, "head", opened)
        at.children.append(page[place:])
    return root, nodes


def _close(at: Node, tag: str, opened: Counter, stop: set[str] = frozenset({"td", "th", "table", "object", "button"})) -> Node:
    """Close the open element ``tag``, unless a ``stop`` lies before it."""
    node = at
    while node.tag != tag:
        if node.tag in stop or node.parent is None:
            return at
        node = node.parent
    while at is not node.parent:
        opened[at.tag] -= 1
        at = at.parent
    return at


def _own_text(node: Node) -> str:
    return "".join(c for c in node.children if isinstance(c, str))


def _judge(nodes: list[Node]) -> None:
    """Make hinted elements junk, but for those that hold more than half of the page's points, and forms that hold nearly all.

    Points of forms count what else was cut off as well, as a form around a page holds its menus too.
    """
    if not any(n.hinted for n in nodes):
        return
    points, whole, filled, block_of = dict.fromkeys(map(id, nodes), 0.0), dict.fromkeys(map(id, nodes), 0.0), set(), {}
    for n in nodes:
        block = block_of[id(n)] = n if n.tag not in INLINE or n.parent is None else block_of[id(n.parent)]
        if n.tag not in RAW and (own := _own_text(n)).strip():
            mine = own.count(",") + len(own) / 100 + (id(block) not in filled)
            filled.add(id(block))
            whole[id(n)] += mine
            points[id(n)] += 0 if n.junk else mine
    all_points, all_whole = sum(points.values()), sum(whole.values())
    for n in reversed(nodes):
        if n.parent is not None:
            points[id(n.parent)] += points[id(n)]
            whole[id(n.parent)] += whole[id(n)]
    for n in nodes:
        spared = whole[id(n)] > 0.9 * all_whole if n.tag == "form" else points[id(n)] > 0.5 * all_points
        n.junk = n.junk or n.parent is not None and n.parent.junk or n.hinted and not spared


def _score(nodes: list[Node]) -> None:
    """Points and text lengths of all elements."""
    block_of: dict[int, Node] = {}
    text_of: dict[int, list[str]] = {}
    for n in nodes:
        block = n if n.tag not in INLINE or n.parent is None else block_of[id(n.parent)]
        block_of[id(n)] = block
        if not n.junk:
            own = _own_text(n)
            if own.strip():
                text_of.setdefault(id(block), []).append(own)
                n.chars += len(own.strip())
    for n in reversed(nodes):  # children before parents
        if n.tag == "a":
            n.linked = n.chars
        if n.parent is not None and not n.junk:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    for n in nodes:
        if id(n) in text_of:
            text = " ".join(text_of[id(n)])
            points, share = (1 + text.count(",") + len(text) / 100) * (1 - _density(n)), 1
            up = n.parent or n
            while up is not None and share <= 3:
                up.points += points / share
                up, share = up.parent, share + 1
    for n in nodes:
        n.points *= 1 - _density(n)


def _density(n: Node) -> float:
    return min(1.0, n.linked / n.chars) if n.chars else 0.0


def _kept(root: Node, nodes: list[Node]) -> list[Node]:
    """The container and the siblings kept with it, in page order."""
    _score(nodes)
    found = [n for n in nodes if not n.junk and n.points > 0 and n.chars and n.tag not in INLINE]
    if not found:
        return []
    best = max(found, key=lambda n: n.points)
    if (up := _article_of(best)) is not None:
        others = [n for n in up.parent.children if isinstance(n, Node) and n.tag == "article" and not n.junk]
        return [n for n in others if n is up or n.points >= 0.2 * up.points]
    if best.parent is None or best.tag in ("body", "html", "main"):
        return [best]
    beside = [n for n in best.parent.children if isinstance(n, Node) and not n.junk]
    place = next(i for i, n in enumerate(beside) if n is best)
    alike = lambda n: n is best or n.points >= 0.2 * best.points or n.tag == "p" and n.chars > 80 and _density(n) < 0.25
    return [n for i, n in enumerate(beside) if alike(n) or i < place and _is_heading(n)]


def _article_of(n: Node | None) -> Node | None:
    while n is not None and n.tag != "article":
        n = n.parent
    return n


def _is_heading(n: Node) -> bool:
    """Whether an element is a heading, or has one that is most of its text."""
    todo, chars = [n], 0
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS and not x.junk:
            chars += x.chars
        else:
            todo.extend(c for c in x.children if isinstance(c, Node))
    return 2 * chars > n.chars


def _lines(top: Node) -> list[str]:
    """The blocks of a subtree, white space collapsed."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(html.unescape(x) if "&" in x else x)
        elif not x.junk:
            if x.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    for by_class in (True, False):
        root, nodes = parse(page, by_class)
        _judge(nodes)
        lines = [line for top in _kept(root, nodes) for line in _lines(top)]
        if lines:
            return "\n".join(lines)
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in W.slices(b, ["html"]):
            text = pa.array([main_text(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Return (page_id, url, text) of each page."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return pages.mapInArrow(_extract, "page_id long, url string, text string")
