"""Main text of web pages by scoring the tree of block elements.

Each paragraph passes points, one and one for each comma and for each hundred characters up to three, to the elements
around it: all to the nearest, half to the next, a third of the distance's share to those above. An element's score is that and a bias for
its tag and class, times one less its link density. The best element, or the article or main element around it, is kept whole, with the other
articles that have a fifth of its text. Outside such elements the siblings of the best element, and of each element around it, are kept too, however
short: all that is not mostly links, and lists of links that follow a heading or stand between texts. Elements that are no part of an article by
their tag or by their class or id (menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden ones) are left out,
unless they hold most of the page's points. A class or id counts only as a whole ("comment-list", not "comments-on-the-law").
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, staged

BLOCKS = frozenset(
    "html head body title p div article section main header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr caption "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption hr address details summary menu dialog search hgroup center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset(("br", "td", "th", "img"))
#: Their content is no text.
RAW = frozenset("script style noscript template textarea iframe svg select canvas audio video title xmp noframes noembed".split())
DROPPED = frozenset("head title nav footer aside menu dialog search hr".split())
FORMS = frozenset(("form", "fieldset"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body article main".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"html", "head", "body", "title"}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "thead": set(), "tbody": {"thead", "tr"}, "tfoot": {"tbody", "tr"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
UNLIKELY = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar header "
    "comment comments disqus respond replies reply discussion share sharing social related recommended newsletter subscribe subscription signup login search tags toc skip hidden".split()
)
#: Words that say nothing beside one of these.
NEUTRAL = frozenset("area bar block body box btn button buttons col column container content count footer form group header inner item items left link links list main message panel post row section site slot text title top bottom right thread wrap wrapper".split())
LIKELY = frozenset("article body content entry main page post text blog story prose".split())
BIAS = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 3.0, "blockquote": 3.0, "pre": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}
TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
BUTTON_END = re.compile(r"</button\s*>", re.I)
#: A button within one of these is part of its sentence.
INLINE = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A line of the page's owner, as footers have it.
NOTICE = re.compile(r"\s*(?:©|\(c\)\s|copyright\b).{0,200}\Z", re.I | re.S)
#: Further articles of a page have so much of the best one's text outside links.
SHARE = 0.2


class Node:
    __slots__ = ("tag", "parent", "children", "names", "other", "hidden", "points", "inner", "size", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        names = [[w.lower() for w in WORD.findall(token)] for m in NAMED.finditer(attributes) for token in m[1].split()] if "=" in attributes else []
        self.names = frozenset(w for token in names for w in token)
        self.other = any(UNLIKELY.intersection(token) and all(w in UNLIKELY or w in NEUTRAL or len(w) == 1 for w in token) for token in names)
        self.hidden = bool(attributes) and HIDDEN.search(attributes) is not None
        self.points = self.inner = 0.0
        self.size = self.linked = self.links = 0


def parse(page: str) -> Node:
    """The tree of block elements; a child is a Node or a block of text (text, characters in links, links)."""
    root = node = Node("html", None)
    parts: list[str] = []
    in_link = linked = links = 0
    at = unseen = 0
    unseen_tag = ""

    def flush():
        nonlocal linked, links, unseen
        unseen = 0
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                node.children.append((text, min(linked, len(text)), links))
            parts.clear()
        linked = links = 0

    def add(text: str):
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            if in_link:
                linked += len(text)

    while (m := TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS and tag not in VOID:  # of inline elements hidden ones count as much as blocks do, to their end or the block's
            if unseen:
                unseen += (tag == unseen_tag) * (-1 if close else 1)
            elif not close and attributes and HIDDEN.search(attributes):
                unseen, unseen_tag = 1, tag
        if tag == "a":
            if not close:
                links += 1
            in_link = 0 if close else 1
        elif tag in RAW:
            if not close and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if tag in ("script", "style", "title", "textarea") else at)
        elif tag in SPACED:
            add(" ")
        elif tag == "button" and not close and node.tag not in INLINE:
            end = BUTTON_END.search(page, at)
            at = end.end() if end else at
        if tag not in BLOCKS or tag in RAW:
            continue
        flush()
        if close:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node, in_link = up.parent, 0
            continue
        if tag in ("html", "body", "head") and any(x == tag for x in _path(node)):
            continue
        if tag in ENDS_P and node.tag == "p":
            node, in_link = node.parent, 0
        if tag in HEADINGS and node.tag in HEADINGS:
            node = node.parent
        if tag in ENDS_SAME:
            up = node
            while up is not None and up.tag not in SCOPE.get(tag, ()) and up.tag not in ENDS_SAME[tag]:
                up = up.parent
            if up is not None and up.tag in ENDS_SAME[tag] and up.parent is not None:
                node = up.parent
        if tag == "body" and node.tag == "head":
            node = node.parent
        child = Node(tag, node, attributes)
        node.children.append(child)
        if tag not in VOID:
            node = child
    add(page[at:])
    flush()
    return root


def _path(node: Node | None) -> Iterator[str]:
    while node is not None:
        yield node.tag
        node = node.parent


def _score(root: Node) -> list[Node]:
    """Fills in points, sizes and links; all nodes, outer ones first."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        own = node
        for child in node.children:
            if isinstance(child, Node):
                stack.append(child)
                continue
            text, linked, links = child
            for name, value in (("size", len(text)), ("linked", linked), ("links", links)):
                setattr(own, name, getattr(own, name) + value)
            if len(text) >= 25 and not node.hidden:
                points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
                node.inner += points
                up, level = (node if node.tag in ("div", "section", "article", "main", "body", "html") else node.parent), 0
                while up is not None:
                    up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    up, level = up.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.inner += node.inner
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links
    return nodes


def _rank(node: Node) -> float:
    bias = BIAS.get(node.tag, 0.0) + 25 * bool(node.names & LIKELY) - 25 * node.other
    return (node.points + bias) * (1 - node.linked / max(1, node.size))


def main_text(page: str | None) -> str:
    """Blocks in page order, parted by an empty line; empty if there are none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _score(root)
    def left_out(node: Node) -> bool:
        within = node.tag == "header" and any(t in ("article", "main") for t in _path(node.parent))
        holds_most = node.inner > 0.5 * root.inner and node.size > 0.5 * root.size
        if node.tag in ("html", "body") or node.tag in ("article", "main") and not node.other:
            return node.hidden
        if node.hidden or node.tag in DROPPED:
            return True
        if node.tag == "header":
            return not within
        return (node.tag in FORMS or node.other) and not holds_most

    inside: set[int] = set()
    kept = []
    for node in nodes:
        if (node.parent is None or id(node.parent) in inside) and not left_out(node):
            inside.add(id(node))
            kept.append(node)
    scored = [n for n in kept if n.points > 0 and n.tag not in HEADINGS and n.tag != "p"]
    if scored:
        best = max(scored, key=_rank)
    else:
        best = next((n for n in kept if n.tag in ("article", "main")), None) or next((n for n in kept if n.tag == "body"), root)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.tag in ("article", "main"):
        chosen = {id(n) for n in kept if n.tag == best.tag and n.size - n.linked >= SHARE * (best.size - best.linked)} | {id(best)}
        around: set[int] = {id(n) for n in nodes}
    else:
        chosen, around = {id(best)} if best.tag not in ("html", "body") else set(), set()
        up = best if best.tag in ("html", "body") else best.parent
        while up is not None:
            around.add(id(up))
            chosen |= _siblings(up, inside) - around
            up = up.parent
    blocks: list[str] = []
    stack: list = [(root, False)]
    while stack:
        item, whole = stack.pop()
        if not isinstance(item, Node):
            blocks.append(item[0])
        elif id(item) in inside:
            whole = whole or id(item) in chosen
            if whole or id(item) in around:
                stack.extend((child, whole) for child in reversed(item.children) if whole or isinstance(child, Node) or best.tag not in ("article", "main") and _prose(child))
    return "\n\n".join(blocks)


def _prose(text: tuple[str, int, int]) -> bool:
    """Whether a text that stands in no element of its own, or a paragraph's, is part of what is told."""
    said, linked, _ = text
    return (linked < 0.5 * len(said) or said[-1] in ".!?:") and not NOTICE.match(said)


def _siblings(parent: Node, inside: set[int]) -> set[int]:
    """Those children of an element around the best one that belong to the text, however short: what is not mostly links. Lists of links do where they
    follow a heading or stand between such children."""
    found, links, last, text = set(), [], None, False
    for child in parent.children:
        if not isinstance(child, Node):
            worthy = _prose(child)
        elif id(child) not in inside or not child.size:
            continue
        else:
            first = next((c for c in child.children if not isinstance(c, Node)), None)
            if child.tag == "p" or child.tag in HEADINGS:
                worthy = all(_prose(c) for c in child.children if not isinstance(c, Node))
            else:
                worthy = child.linked < 0.25 * child.size and not (first and len(child.children) == 1 and not _prose(first))
            if worthy:
                found.add(id(child))
            elif child.tag in ("ul", "ol", "dl"):
                if last in HEADINGS and text:
                    found.add(id(child))
                elif text:
                    links.append(id(child))
        if worthy:
            found.update(links)
            links.clear()
            text = text or not isinstance(child, Node) or child.tag not in HEADINGS
        last = child.tag if isinstance(child, Node) else None
    return found


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), a row for each page. Pages are taken whole, one at a time.

    Null or empty html, and a page without text, give an empty text; a null id or url stays null. Of elements that score the
    same the first in the page is the best. Repeated rows give equal rows, an empty table gives none; other columns are not looked at.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    with batches_of(pages.sparkSession, 512):
        found = staged(rows.mapInPandas(extract, "page_id long, url string, text string, n_chars long"), "pages")
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
