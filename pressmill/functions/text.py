"""Text expressions: cleaning, previews, hit counts, romanisation, model JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions.terms import Found

# fixed values: character classes
_SPACE = r"(?U)[\s\x1c-\x1f]+"
HANGUL = r"[\x{ac00}-\x{d7a3}]"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
CJK_BASIC = r"[\x{4e00}-\x{9fff}]"
NOT_CJK_BASIC = r"[^\x{4e00}-\x{9fff}]"
KANA_OR_HANGUL = r"[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    A lambda variable is never replaced by its definition, so expressions built this way
    stay small when filters are pushed through projections.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def text_array(values: Iterable[str]) -> Column:
    """Literal ``array<string>``, typed even when empty."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def clean(value: Column | str) -> Column:
    """One space for every whitespace run, trimmed; missing becomes empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), _SPACE, " "))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def first_text(*values: Column | str) -> Column:
    """First value that is neither missing nor empty, else empty text."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def preview(value: Column | str, limit: int = 500) -> Column:
    return let(
        clean(value),
        lambda text: F.when(
            F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("..."))
        ).otherwise(text),
    )


def cut(value: Column | str, limit: int = 500) -> Column:
    return F.substring(col(value), 1, limit)


def lowered(terms: Iterable[str]) -> list[str]:
    return [t.lower() for t in terms]


def hits(lower_text: Column | Found, terms: Iterable[str]) -> Column:
    """Number of the terms found in already lower-cased text."""
    if isinstance(lower_text, Found):
        return lower_text.hits(terms)
    terms = lowered(terms)
    if not terms:
        return F.lit(0)
    # bound first: otherwise the text would be lower-cased again for every term
    return let(lower_text, lambda v: F.size(F.filter(text_array(terms), lambda t: F.contains(v, t))))


def has_any(lower_text: Column | Found, terms: Iterable[str]) -> Column:
    if isinstance(lower_text, Found):
        return lower_text.any(terms)
    return has_any_exact(lower_text, lowered(terms))


def has_any_exact(text: Column, terms: Iterable[str]) -> Column:
    """Case-sensitive form of :func:`has_any`."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return let(text, lambda v: F.exists(text_array(terms), lambda t: F.contains(v, t)))


def keep_tail(value: Column, markers: Iterable[str], min_tail: int = 200) -> Column:
    """After each marker in turn keep what follows its last occurrence, if long enough."""
    out = value
    for marker in markers:
        tail = F.substring_index(out, marker, -1)
        out = F.when(F.length(tail) > min_tail, tail).otherwise(out)
    return out


def array_text(values: Column, separator: str) -> Column:
    return F.array_join(values, separator)


def has_hangul(value: Column) -> Column:
    return value.rlike(HANGUL)


def has_cjk(value: Column) -> Column:
    return value.rlike(CJK)


def cjk_chars(value: Column) -> Column:
    return F.length(F.regexp_replace(value, NOT_CJK_BASIC, ""))


def valid_translation(translated: Column | str, original: Column | str) -> Column:
    old = clean(original)
    return let(clean(translated), lambda new: (new != "") & (new != old) & has_cjk(new) & ~has_hangul(new))


def needs_translation(title: Column | str, translated: Column | str, language: Column | str) -> Column:
    korean = F.lower(F.coalesce(col(language), F.lit(""))) == "ko"
    wanted = let(clean(title), lambda text: (text != "") & (korean | has_hangul(text)))
    return wanted & ~valid_translation(translated, title)


def romanize_hangul(value: Column | str) -> Column:
    """Hangul runs to Latin letters, the first letter of each run in upper case."""
    chars = F.split(col(value), "(?!^)")
    code = F.transform(chars, lambda c: F.ascii(c) - F.lit(0xAC00))
    in_range = lambda k: (k >= 0) & (k <= 11171)
    initials, vowels, finals = map(text_array, (fv.HANGUL_INITIALS, fv.HANGUL_VOWELS, fv.HANGUL_FINALS))

    def syllable(k: Column) -> Column:
        return F.concat(
            F.get(initials, F.floor(k / 588).cast("int")),
            F.get(vowels, F.floor((k % 588) / 28).cast("int")),
            F.get(finals, (k % 28).cast("int")),
        )

    def letter(c: Column, i: Column) -> Column:
        k = F.get(code, i)
        previous = F.coalesce(F.get(code, i - 1), F.lit(-1))
        latin = syllable(k)
        at_start = ~in_range(previous)
        capital = F.concat(F.upper(F.substring(latin, 1, 1)), F.substring(latin, 2, 8))
        return F.when(~in_range(k), c).when(at_start, capital).otherwise(latin)

    return F.array_join(F.transform(chars, letter), "")


def normalize_translation(translated: Column | str) -> Column:
    return let(
        clean(translated),
        lambda text: F.when(has_cjk(text) & has_hangul(text), romanize_hangul(text)).otherwise(text),
    )


def strip_thinking(value: Column | str) -> Column:
    return F.regexp_replace(col(value), r"(?is)<think>.*?</think>", "")


def model_json(value: Column | str) -> Column:
    """Model output as VARIANT: the text itself, else its outermost braces, else NULL."""
    return let(
        strip_thinking(value),
        lambda text: F.coalesce(
            F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
        ),
    )


def json_tags(value: Column | str) -> Column:
    return F.coalesce(F.from_json(col(value), "array<string>"), text_array([]))


_SEPARATORS = "[、,;；|]"


def _after_colon(word: Column) -> Column:
    narrow = F.trim(F.substring_index(word, ":", -1))
    return F.trim(F.substring_index(narrow, "：", -1))


def keywords_from_text(value: Column | str) -> Column:
    """Keyword text to array: split, keep what follows the last colon, drop repeats.

    White space is tidied once in the whole text, so that its parts only need trimming.
    """
    parts = F.transform(F.split(clean(value), _SEPARATORS), lambda w: _after_colon(F.trim(w)))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def keywords_from_array(value: Column | str) -> Column:
    words = F.transform(F.coalesce(col(value), text_array([])), clean)
    return F.filter(words, lambda w: w != "")


def merge_warnings(*values: Column | str) -> Column:
    """Join several ``;`` lists without repeats, accepting both widths of semicolon."""
    joined = F.concat_ws(";", *[F.coalesce(col(v), F.lit("")) for v in values])
    parts = F.transform(F.split(F.translate(joined, "；", ";"), ";"), lambda p: clean(p))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "; ")


def append_warning(existing: Column | str, status: Column) -> Column:
    """Add a window status to a warning list unless it is clean or already there."""
    current = F.coalesce(col(existing), F.lit(""))
    parts = F.filter(F.transform(F.split(current, ";"), lambda p: F.trim(p)), lambda p: p != "")

    def added(state: Column) -> Column:
        listed = F.array_join(F.array_append(parts, state), "; ")
        present = F.when(F.array_contains(parts, state), F.array_join(parts, "; ")).otherwise(listed)
        return F.when(state.isin(fv.IN_WINDOW, fv.IN_WINDOW_DATE), current).otherwise(present)

    return let(status, added)


def extraction_warning(title: Column | str, text: Column | str, published: Column | str) -> Column:
    flags = F.array(
        F.when(F.coalesce(col(title), F.lit("")) == "", F.lit(fv.WARN_TITLE)),
        F.when(F.length(F.coalesce(col(text), F.lit(""))) < 200, F.lit(fv.WARN_SHORT)),
        F.when(F.coalesce(col(published), F.lit("")) == "", F.lit(fv.WARN_DATE)),
    )
    return F.array_join(F.array_compact(flags), "; ")


def is_selected(value: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(col(value).cast("string"), F.lit(""))))
    return text.isin(*fv.SELECTED_SPELLINGS)


def candidate_id(url: Column | str, title: Column | str) -> Column:
    return F.substring(F.sha1(clean(first_text(url, title))), 1, 12)


def marker_id(date: Column, index: Column, title: Column, url: Column) -> Column:
    payload = F.concat_ws("|", date, index.cast("string"), clean(title), clean(url))
    return F.substring(F.sha1(payload), 1, 16)


def is_missing(value: Column | str) -> Column:
    return clean(value).isin("", fv.UNKNOWN, fv.UNCLASSIFIED)


def or_unclassified(value: Column | str) -> Column:
    return F.coalesce(blank_to_null(clean(value)), F.lit(fv.UNCLASSIFIED))


def first_known(*values: Column | str) -> Column:
    """First value that counts as known metadata; else the first value as it is."""
    known = [F.when(~is_missing(v), col(v)) for v in values]
    return F.coalesce(*known, *[col(v) for v in values])


def source_text(full: Column | str, short: Column | str) -> Column:
    return clean(first_text(full, short))
