"""Weighted keyword dictionaries: matching, score and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.config import Keyword
from pressmill.functions.terms import MATCH_TYPE, TermIndex
from pressmill.functions.text import col, text_array


def dictionary(keywords: Sequence[Keyword]) -> list[Keyword]:
    """Trimmed entries without blanks, first one of each (category, term)."""
    seen: dict[tuple[str, str], Keyword] = {}
    for k in keywords:
        term = k.term.strip()
        if term:
            seen.setdefault((k.category, term), Keyword(k.category, term, float(k.weight)))
    return list(seen.values())


def match_keywords(lower_text: Column | str, keywords: Sequence[Keyword]) -> Column:
    """Dictionary entries found in lower-cased text, in dictionary order: one pass over each text, of any number of terms."""
    entries = dictionary(keywords)
    if not entries:
        return F.array().cast(MATCH_TYPE)
    return TermIndex(entries).matches(col(lower_text))


def keyword_score(matches: Column | str, cap: float = 30.0) -> Column:
    total = F.aggregate(col(matches), F.lit(0.0), lambda s, m: s + m["weight"])
    return F.least(F.lit(cap), total)


def keyword_text(matches: Column | str) -> Column:
    """``cat: a, b; cat2: c`` with categories in order of first match."""
    found = col(matches)
    categories = F.array_distinct(F.transform(found, lambda m: m["category"]))
    return F.array_join(
        F.transform(
            categories,
            lambda c: F.concat(
                c, F.lit(": "),
                F.array_join(F.transform(F.filter(found, lambda m: m["category"] == c), lambda m: m["keyword"]), ", "),
            ),
        ),
        "; ",
    )


def matched_terms(matches: Column | str) -> Column:
    return F.transform(col(matches), lambda m: m["keyword"])


def matched_categories(matches: Column | str) -> Column:
    return F.transform(col(matches), lambda m: m["category"])


def history_bonus(matches: Column | str, history_terms: Sequence[str]) -> Column:
    """1.5 for each distinct matched term that history knows, at most 5."""
    terms = F.array_distinct(F.transform(matched_terms(matches), lambda t: F.lower(F.trim(t))))
    known = F.size(F.array_intersect(terms, text_array(sorted(history_terms))))
    return F.least(F.lit(5.0), known * F.lit(1.5))
