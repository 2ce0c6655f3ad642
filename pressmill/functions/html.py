"""Page parsing as vectorised functions over an ``html`` column.

The parser keeps just enough structure for the extraction rules: elements, attributes
and text in document order.  All date, URL and relevance rules stay in SQL expressions.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill import fixed_values as fv
from pressmill.functions.selectors import firsts, matches, select

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
# fixed value: blocks that never count as text of an article
_DROPPED = frozenset(("script", "style", "noscript", "svg", "form", "nav", "header", "footer", "aside"))
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.parent, self.items = tag, parent, []
        self.attrs = {k: v or "" for k, v in attrs}

    def walk(self, skip=frozenset()):
        stack = [iter(self.items)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif not isinstance(child, str) and child.tag not in skip:
                yield child
                stack.append(iter(child.items))

    def pieces(self, skip):
        stack = [iter(self.items)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                if child.strip():
                    yield child.strip()
            elif child.tag not in skip:
                stack.append(iter(child.items))

    def text(self, skip=_HIDDEN):
        return " ".join(self.pieces(skip))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.here)
        self.here.items.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.items.append(Node(tag, attrs, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        # adjacent runs form one piece, as they do in a document tree
        if self.here.items and isinstance(self.here.items[-1], str):
            self.here.items[-1] += data
        else:
            self.here.items.append(data)


#: Declarations in square brackets that are no CDATA end at the next sign, as in a browser.
_BRACKETS = re.compile(r"<!\[(?!CDATA\[)[^>]*>?")


def parse(html: str) -> Node:
    """The tree of a page; markup the parser gives up on ends the tree there, never the job."""
    tree = _Tree()
    try:
        tree.feed(_BRACKETS.sub("", html or ""))
        tree.close()
    except (AssertionError, ValueError):
        pass
    return tree.root


def _tidy(value) -> str:
    return _BLANK.sub(" ", value or "").strip()


def _absolute(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


_TITLES = ("title", "h1", "meta[property='og:title']", "meta[name='twitter:title']")


def _title_values(root: Node) -> list[str]:
    found = [x for x in firsts(root, _TITLES) if x is not None]
    return [x.attrs.get("content", "") if x.tag == "meta" else x.text() for x in found]


def _main_text(root: Node) -> str:
    nodes = list(root.walk(_DROPPED))
    best = None
    for selector in fv.CONTENT_SELECTORS:
        for node in nodes:
            if matches(node, selector):
                text = node.text(_DROPPED)
                if best is None or len(text) > len(best):
                    best = text
    if best is None:
        body = next((x for x in nodes if x.tag == "body"), root)
        best = body.text(_DROPPED)
    return best


def _date_values(root: Node) -> list[str]:
    found = [x for x in firsts(root, fv.DATE_SELECTORS, _DROPPED) if x is not None]
    return [x.attrs.get("content") or x.attrs.get("datetime") or x.text() for x in found]


def _json_ld_values(root: Node) -> list[str]:
    values = []
    for script in select(root, "script[type='application/ld+json']"):
        try:
            payload = json.loads("".join(i for i in script.items if isinstance(i, str)) or "{}")
        except ValueError:
            continue
        for item in payload if isinstance(payload, list) else [payload]:
            if isinstance(item, dict):
                value = item.get("datePublished") or item.get("dateCreated") or item.get("dateModified")
                values.append(str(value or ""))
    return values


# The date tags of dropped blocks never count, and neither do dropped scripts: a page's
# structured data lives in a script block, so it is only seen when kept on request.
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_ARTICLE_TYPE = _struct(title=_TEXT, text=_TEXT, dates=_TEXTS, json_ld=_TEXTS)


@F.pandas_udf(_ARTICLE_TYPE)
def article_parts(html: pd.Series) -> pd.DataFrame:
    """Title, main text and raw date values of each page."""
    rows = []
    for page in html:
        root = parse(page)
        title = next((t for t in map(_tidy, _title_values(root)) if t), "")
        rows.append((title, _tidy(_main_text(root)), _date_values(root), _json_ld_values(root)))
    return pd.DataFrame(rows, columns=["title", "text", "dates", "json_ld"])


#: The same of pages that a join has opened. A filter on these parts stays above the join; moved below, it parses every page.
opened_parts = F.pandas_udf(article_parts.func, _ARTICLE_TYPE).asNondeterministic()


def _opening(node: Node, size: int) -> str:
    """The first characters of the node's text; reads no further than they reach."""
    parts, length = [], -1
    for piece in node.pieces(_HIDDEN):
        parts.append(_tidy(piece))
        length += len(parts[-1]) + 1
        if length >= size:
            break
    return " ".join(parts)[:size]


def _title_near(node: Node, known: dict[int, str]) -> str:
    """First heading below a node, else the beginning of its text; found once for each node."""
    if id(node) not in known:
        headings = (_tidy(x.text()) for x in firsts(node, fv.HEADING_SELECTORS) if x is not None)
        heading = next((x for x in headings if x), "")
        known[id(node)] = heading or _opening(node, 140)
    return known[id(node)]


def _anchor_title(anchor: Node, known: dict[int, str]) -> str:
    title = _tidy(anchor.text() or anchor.attrs.get("title", ""))
    up = anchor.parent
    for _ in range(4):
        if title or up is None:
            break
        title = _title_near(up, known)
        up = up.parent
    return title


_LINK_TYPE = T.ArrayType(_struct(
    pos=T.IntegerType(), href=_TEXT, url=_TEXT, title=_TEXT, own_text=_TEXT, selector_rank=T.IntegerType()
))


@F.pandas_udf(_LINK_TYPE)
def page_links(html: pd.Series, base: pd.Series, selectors: pd.Series) -> pd.Series:
    """Anchors of each page, once each, in selector order; links resolved against the base."""
    out = []
    for page, url, wanted in zip(html, base, selectors):
        root, seen, links, known = parse(page), set(), [], {}
        for rank, selector in enumerate(wanted if wanted is not None and len(wanted) else fv.LINK_SELECTORS):
            for anchor in select(root, selector):
                if id(anchor) in seen:
                    continue
                seen.add(id(anchor))
                href = anchor.attrs.get("href", "")
                links.append({
                    "pos": len(links), "href": href, "url": _absolute(url, href), "title": _anchor_title(anchor, known),
                    "own_text": _tidy(anchor.text()), "selector_rank": rank,
                })
        out.append(links)
    return pd.Series(out)


@F.pandas_udf(_TEXTS)
def page_feeds(html: pd.Series, base: pd.Series) -> pd.Series:
    """Feeds a page advertises in its head."""
    out = []
    for page, url in zip(html, base):
        found = []
        for node in select(parse(page), "link[href]"):
            kind = node.attrs.get("type", "").lower()
            if "alternate" in node.attrs.get("rel", "").split() and any(k in kind for k in ("rss", "atom", "xml")):
                found.append(_absolute(url, node.attrs["href"]))
        out.append(found)
    return pd.Series(out)


_BODY_TYPE = _struct(blocks=_TEXTS, paragraphs=_TEXTS, body=_TEXT, h1=_TEXT, title=_TEXT)


@F.pandas_udf(_BODY_TYPE)
def body_parts(html: pd.Series) -> pd.DataFrame:
    """First block of each body selector, the paragraphs and the whole visible body."""
    rows = []
    for page in html:
        root = parse(page)
        *first, body, h1, title = firsts(root, (*fv.BODY_SELECTORS, "body", "h1", "title"))
        blocks = [_tidy(n.text()) for n in first if n is not None]
        paragraphs = [_tidy(n.text()) for n in select(root, "p")]
        body = root if body is None else body
        rows.append((
            blocks, paragraphs, _tidy(body.text()),
            _tidy(h1.text()) if h1 is not None else "", _tidy(title.text()) if title is not None else "",
        ))
    return pd.DataFrame(rows, columns=["blocks", "paragraphs", "body", "h1", "title"])


def article_score(text: Column, sentence_pattern: str, navigation_markers) -> Column:
    from pressmill.functions.text import has_any_exact

    navigation = has_any_exact(F.substring(text, 1, 500), navigation_markers)
    score = (
        F.when(F.length(text) >= 300, 2).otherwise(0)
        + F.when(text.rlike(sentence_pattern), 2).otherwise(0)
        + F.when(~navigation, 1).otherwise(0)
    )
    return F.when(text == "", F.lit(0)).otherwise(score)


def article_body(parts: Column, sentence_pattern: str, navigation_markers, tail_markers) -> Column:
    """Best body text of :func:`body_parts`: first good block, else paragraphs, else body."""
    from pressmill.functions.text import has_any_exact, keep_tail

    good = F.filter(parts["blocks"], lambda b: article_score(b, sentence_pattern, navigation_markers) >= 4)
    lines = F.array_distinct(
        F.filter(parts["paragraphs"], lambda p: (F.length(p) >= 25) & ~has_any_exact(p, navigation_markers))
    )
    joined = F.nullif(F.array_join(lines, " "), F.lit(""))
    return keep_tail(F.coalesce(F.get(good, F.lit(0)), joined, parts["body"]), tail_markers)
