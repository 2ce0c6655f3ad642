"""CSS selectors over the page parser's nodes, compiled once.

Understood: tag, ``*``, ``.class``, ``#id``, attribute tests (``= ~= |= ^= $= *=``), ``:not(...)`` of such tests,
``:first-child``, lists with commas and the four combinators. A selector with anything else is
logged once and finds nothing.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

_TEST = re.compile(
    r"(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>(?:[\w-]|[^\x00-\x7f])+)|\#(?P<ident>(?:[\w-]|[^\x00-\x7f])+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?)=\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]"
    r"|:not\((?P<inner>[^()]*)\)|(?P<first>:first-child)"
)
_GAP = re.compile(r"\s*([>+~,])\s*|\s+")


def _attribute(name: str, op: str, wanted: str) -> Callable:
    if op == "":
        return lambda n: n.attrs.get(name) == wanted
    if op == "~":
        return lambda n: bool(wanted) and wanted in n.attrs.get(name, "").split()
    if op == "|":
        return lambda n: name in n.attrs and (n.attrs[name] == wanted or n.attrs[name].startswith(wanted + "-"))
    if not wanted:
        return lambda n: False
    if op == "^":
        return lambda n: n.attrs.get(name, "").startswith(wanted)
    if op == "$":
        return lambda n: n.attrs.get(name, "").endswith(wanted)
    return lambda n: wanted in n.attrs.get(name, "")


def elements(node) -> list:
    return [x for x in node.items if not isinstance(x, str)]


def _test(found: re.Match) -> Callable | None:
    part = found.groupdict()
    if part["tag"]:
        tag = part["tag"].lower()
        return None if tag == "*" else lambda n: n.tag == tag
    if part["cls"]:
        cls = part["cls"]
        return lambda n: cls in n.attrs.get("class", "").split()
    if part["ident"]:
        ident = part["ident"]
        return lambda n: n.attrs.get("id") == ident
    if part["attr"]:
        name = part["attr"].lower()
        if part["value"] is None:
            return lambda n: name in n.attrs
        return _attribute(name, part["op"], part["value"].strip("\"'"))
    if part["inner"] is not None:
        inner = [_compound(x.strip()) for x in part["inner"].split(",")]
        return lambda n: not any(all(t(n) for t in tests) for tests in inner)
    return lambda n: n.parent is not None and elements(n.parent)[0] is n


def _compound(text: str) -> list[Callable]:
    tests, at = [], 0
    while at < len(text):
        found = _TEST.match(text, at)
        if found is None or found["tag"] and at:
            raise ValueError(text)
        test = _test(found)
        if test is not None:
            tests.append(test)
        at = found.end()
    if not text:
        raise ValueError("empty")
    return tests


def _split(selector: str) -> list[list[tuple[str, list[Callable]]]]:
    """Alternatives, each a list of (combinator before it, tests) from left to right."""
    chains: list[list[tuple[str, list[Callable]]]] = [[]]
    at, joint = 0, ""
    while at < len(selector):
        gap = _GAP.match(selector, at)
        if gap and gap.end() > at:
            joint = gap[1] or joint or " "
            if joint == ",":
                chains.append([])
                joint = ""
            at = gap.end()
            continue
        start = at
        while at < len(selector) and (found := _TEST.match(selector, at)) and (at == start or not found["tag"]):
            at = found.end()
        if at == start:
            raise ValueError(selector)
        chains[-1].append((joint, _compound(selector[start:at])))
        joint = ""
    if joint or not all(chains) or any(chain[0][0].strip() for chain in chains):
        raise ValueError(selector)
    return chains


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    try:
        return tuple(_split(selector.strip()))
    except ValueError:
        logging.getLogger(__name__).warning("selector not understood: %s", selector)
        return ()


def _before(node, joint: str) -> Iterator:
    """Where the part left of a combinator may be."""
    if joint in (" ", ">"):
        up = node.parent
        while up is not None and up.tag:
            yield up
            if joint == ">":
                return
            up = up.parent
    elif node.parent is not None:
        siblings = elements(node.parent)
        place = next(k for k, x in enumerate(siblings) if x is node)
        yield from siblings[place - 1 : place] if joint == "+" else siblings[:place]


def _fits(node, chain: list, last: int) -> bool:
    joint, tests = chain[last]
    if not all(test(node) for test in tests):
        return False
    return last == 0 or any(_fits(x, chain, last - 1) for x in _before(node, joint or " "))


def matches(node, selector: str) -> bool:
    return any(_fits(node, chain, len(chain) - 1) for chain in compiled(selector))


def select(root, selector: str, skip=frozenset()) -> Iterator:
    """The nodes below root that the selector finds, in page order."""
    if compiled(selector):
        for node in root.walk(skip):
            if matches(node, selector):
                yield node


def firsts(root, selectors: tuple[str, ...], skip=frozenset()) -> list:
    """The first node of each selector (None where there is none), found in one walk."""
    found: list = [None] * len(selectors)
    open_ = [k for k, s in enumerate(selectors) if compiled(s)]
    for node in root.walk(skip):
        hit = [k for k in open_ if matches(node, selectors[k])]
        if hit:
            for k in hit:
                found[k] = node
            open_ = [k for k in open_ if found[k] is None]
            if not open_:
                break
    return found
