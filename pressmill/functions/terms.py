"""All terms of a dictionary and of any number of lists, found in one pass over a text.

The needles become one automaton, built once in each worker. A text is read once, however many terms there
are, and the list tests that follow are set operations on the few numbers of terms that were found.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.config import Keyword

MATCH_TYPE = "array<struct<category:string,keyword:string,weight:double>>"
_PARTS = ("low", "title", "body", "both")


@lru_cache(maxsize=16)
def automaton(needles: tuple[str, ...]):
    """Automaton of different needles; a hit gives the needle's number and length. None without needles."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        if needle:
            made.add_word(needle, (i, len(needle)))
    if not len(made):
        return None
    made.make_automaton()
    return made


def found_numbers(needles: tuple[str, ...], text: str, empty: frozenset[int]) -> set[int]:
    made = automaton(needles)
    return set(empty) if made is None else {i for _, (i, _) in made.iter(text)} | empty


class Found:
    """Numbers of the needles found in one text, with the list tests on them."""

    def __init__(self, numbers: Column, ids: dict[str, int]):
        self.numbers, self.ids = numbers, ids

    def _of(self, terms: Iterable[str]) -> list[int]:
        return [self.ids[t.lower()] for t in terms]

    def hits(self, terms: Iterable[str]) -> Column:
        """Number of the terms found; a term that a list repeats counts each time."""
        wanted = self._of(terms)
        if not wanted:
            return F.lit(0)
        if len(set(wanted)) == len(wanted):
            return F.size(F.array_intersect(self.numbers, F.array(*map(F.lit, wanted))))
        return F.size(F.filter(F.array(*map(F.lit, wanted)), lambda i: F.array_contains(self.numbers, i)))

    def any(self, terms: Iterable[str]) -> Column:
        wanted = self._of(terms)
        return F.arrays_overlap(self.numbers, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


class TermIndex:
    """Needles of dictionary entries (in their order) and of term lists."""

    def __init__(self, entries: Sequence[Keyword] = (), lists: Iterable[Iterable[str]] = ()):
        self.entries = list(entries)
        self.ids: dict[str, int] = {}
        for term in [k.term for k in self.entries] + [t for terms in lists for t in terms]:
            self.ids.setdefault(term.lower(), len(self.ids))
        self.needles = tuple(self.ids)
        self.empty = frozenset(i for t, i in self.ids.items() if not t)
        owners: dict[int, list[int]] = {}
        for place, k in enumerate(self.entries):
            owners.setdefault(self.ids[k.term.lower()], []).append(place)
        self.owners = owners

    def _matches(self):
        """Function from found numbers to the entries of the dictionary that they stand for."""
        owners, rows = self.owners, [{"category": k.category, "keyword": k.term, "weight": k.weight} for k in self.entries]
        return lambda numbers: [rows[i] for i in sorted(i for n in numbers if n in owners for i in owners[n])]

    def matches(self, lower_text: Column) -> Column:
        """Dictionary entries found in lower-cased text, in dictionary order."""
        needles, empty, matched = self.needles, self.empty, self._matches()

        @F.pandas_udf(MATCH_TYPE)
        def match(texts: pd.Series) -> pd.Series:
            return pd.Series([matched(found_numbers(needles, t, empty)) if t is not None else [] for t in texts])

        return match(lower_text)

    def in_article(self, title: Column, text: Column, warning: Column, preview: Column) -> Column:
        """``struct<matches, low, title, body, both>`` of lower-cased parts of an article.

        ``low`` is found in title, text and warning joined by spaces, ``title`` and ``body`` in those parts, ``both`` in
        title and body joined; the body is the text, or the preview of an article without one. Where a hit ends tells which
        of them it belongs to, so that one pass serves all four.
        """
        needles, empty, matched = self.needles, self.empty, self._matches()

        def scan(first: str, body: str, rest: str) -> list[set[int]]:
            low, title, inside, both = set(empty), set(empty), set(empty), set(empty)
            made = automaton(needles)
            if made is not None:
                edge, end_of_both = len(first), len(first) + 1 + len(body)
                for end, (i, size) in made.iter(f"{first} {body}{rest}"):
                    low.add(i)
                    if end < end_of_both:
                        both.add(i)
                        if end < edge:
                            title.add(i)
                        elif end - size >= edge:
                            inside.add(i)
            return [low, title, inside, both]

        kinds = ", ".join(["matches: " + MATCH_TYPE, *[f"{p}: array<int>" for p in _PARTS]])

        @F.pandas_udf(f"struct<{kinds.replace(': ', ':').replace(', ', ',')}>")
        def find(titles: pd.Series, texts: pd.Series, warnings: pd.Series, previews: pd.Series) -> pd.DataFrame:
            out = {"matches": [], **{p: [] for p in _PARTS}}
            for first, body, warning, preview in zip(titles, texts, warnings, previews, strict=True):
                found = scan(first, body, f" {warning}")
                if not body and preview:
                    found = [found[0], *scan(first, preview, "")[1:]]
                out["matches"].append(matched(found[0]))
                for name, numbers in zip(_PARTS, found, strict=True):
                    out[name].append(sorted(numbers))
            return pd.DataFrame(out)

        return find(title, text, warning, preview)

    def found(self, numbers: Column) -> Found:
        return Found(numbers, self.ids)
