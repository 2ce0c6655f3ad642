"""URL expressions: parts, canonical form, dates in paths, address checks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill import fixed_values as fv
from pressmill.functions.text import clean, col, text_array

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), _URL, group)


def url_scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 1))


def url_host(url: Column | str) -> Column:
    return _part(url, 2)


def url_path(url: Column | str) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def url_query(url: Column | str) -> Column:
    return _part(url, 4)


def url_fragment(url: Column | str) -> Column:
    return _part(url, 5)


def strip_session_id(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"(?i);jsessionid=[^/?#]+", "")


def is_feed_url(url: Column | str) -> Column:
    path = F.lower(url_path(url))
    return path.endswith(".xml") | path.endswith(".rss") | path.contains("/rss/")


def is_http(url: Column | str) -> Column:
    return url_scheme(url).isin("http", "https")


def _decoded(piece: Column) -> Column:
    return F.coalesce(F.try_url_decode(piece), F.translate(piece, "+", " "))


def _encoded(piece: Column) -> Column:
    # Java keeps "*" and escapes "~"; the wanted form is the other way round.
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    halves = F.transform(
        pairs,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(
        halves,
        lambda h: ~F.lower(h["k"]).isin(*fv.TRACKING_KEYS) & ~F.lower(h["k"]).startswith("utm_"),
    )
    return F.array_join(F.transform(kept, lambda h: F.concat(_encoded(h["k"]), F.lit("="), _encoded(h["v"]))), "&")


def canonical_url(url: Column | str) -> Column:
    """Comparison key of a URL: no tracking, session, fragment or trailing slash."""
    text = clean(url)
    # each part appears once, so the expression stays small wherever it is used
    path = F.regexp_replace(strip_session_id(_part(text, 3)), "^$", "/")
    path = F.regexp_replace(path, "(?s)^(?!/$)(.*?)/+$", "$1")
    query = F.concat(F.lit("?"), F.nullif(_clean_query(_part(text, 4)), F.lit("")))
    full = F.concat(
        F.lower(_part(text, 1)), F.lit("://"), F.lower(_part(text, 2)), path, F.coalesce(query, F.lit(""))
    )
    complete = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")
    return F.when(complete, full).otherwise(F.regexp_replace(text, "/+$", ""))


def canonical_key(url: Column | str) -> Column:
    """Canonical URL as a join key: NULL when there is no URL."""
    return F.nullif(canonical_url(url), F.lit(""))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def date_from_url(url: Column | str) -> Column:
    """Date text found in a URL by six patterns in order; not calendar-checked."""
    path, whole = url_path(url), F.coalesce(col(url), F.lit(""))
    # fixed values: path patterns with year, month and day groups
    patterns = (
        (path, r"(?:release_|/site/press/)(20\d{2})(\d{2})(\d{2})", ""),
        (path, r"/press/(20\d{2})/(\d{2})/(?:20\d{4})?(\d{2})[^/]*\.html$", ""),
        (whole, r"AKR(20\d{2})(\d{2})(\d{2})", ""),
        (path, r"pt(20\d{2})(\d{2})(\d{2})\d+\.html", ""),
        (path, r"/articles/(\d{2})(\d{2})/(\d{1,2})/", "20"),
        (path, r"/(20\d{2})/(\d{1,2})/(\d{1,2})/", ""),
    )
    found = []
    for subject, pattern, century in patterns:
        y, m, d = (F.regexp_extract(subject, pattern, i) for i in (1, 2, 3))
        found.append(F.when(y != "", _iso(F.concat(F.lit(century), y), m, d)))
    return F.coalesce(*found, F.lit(""))


def resolve_link(base: Column | str, href: Column | str) -> Column:
    """Column form of joining an absolute, ``//host``, ``/path`` or bare link to a base."""
    link = F.coalesce(col(href), F.lit(""))
    scheme, host = _part(base, 1), _part(base, 2)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link == "", col(base))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(col(base), "(?s)#.*$", ""), link))
        .when(link.startswith("?"), F.concat(root, _part(base, 3), link))
        .otherwise(F.concat(root, folder, link))
    )


def same_host(url: Column | str, base: Column | str, *, empty_host_ok: bool = True) -> Column:
    """http(s) link on the host of ``base``; a base without host accepts any host."""
    host, wanted = url_host(url), url_host(base)
    same = (wanted == "") | (host == wanted)
    if empty_host_ok:
        same = same | (host == "")
    return is_http(url) & same


def name_for_host(host: Column, markers) -> Column:
    """First ``(marker, name)`` pair whose marker is in the host, in the given order."""
    out = F.lit(fv.UNKNOWN)
    for marker, name in reversed(list(markers)):
        out = F.when(F.contains(host, F.lit(marker)), F.lit(name)).otherwise(out)
    return F.when(host == "", F.lit(fv.UNKNOWN)).otherwise(out)


def source_from_url(url: Column | str, markers) -> Column:
    return name_for_host(F.lower(url_host(url)), markers)


@F.pandas_udf(T.BooleanType())
def _is_reserved_address(hosts: pd.Series) -> pd.Series:
    def reserved(host: str) -> bool:
        try:
            return not ipaddress.ip_address(host).is_global
        except ValueError:
            return False

    return hosts.map(reserved)


# fixed values: reasons shown when an address is refused
ONLY_HTTP = "只支持完整的 http/https URL"
NOT_LOCAL = "不允许诊断本机地址"
NOT_PRIVATE = "不允许诊断私有或本机 IP"


def hostname(url: Column | str) -> Column:
    """Host without user, port and IPv6 brackets, lower-cased."""
    host = F.regexp_replace(F.lower(url_host(url)), "^.*@", "")
    bracketed = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    return F.when(bracketed != "", bracketed).otherwise(F.regexp_replace(host, ":.*$", ""))


def public_url_error(url: Column | str) -> Column:
    """Empty text for a public http(s) URL, else the reason for refusing it.

    Hosts that are no address literals go to the Python check as empty text.
    """
    trimmed = F.trim(F.coalesce(col(url), F.lit("")))
    host = hostname(trimmed)
    literal = host.rlike(r"^[0-9.]+$") | F.contains(host, F.lit(":"))
    return (
        F.when(~is_http(trimmed) | (host == ""), F.lit(ONLY_HTTP))
        .when((host == "localhost") | host.endswith(".local"), F.lit(NOT_LOCAL))
        .when(_is_reserved_address(F.when(literal, host).otherwise("")), F.lit(NOT_PRIVATE))
        .otherwise("")
    )


def expand_entry_urls(urls: Column | str, run_date: Column | str) -> Column:
    """Fill ``{year}`` and ``{run_date}``, drop blanks and repeats, keep the order."""
    day = F.coalesce(col(run_date).cast("string"), F.lit(""))
    year = F.regexp_extract(day, r"(20\d{2})", 1)
    filled = F.transform(
        F.coalesce(col(urls), text_array([])),
        lambda u: F.replace(F.replace(u, F.lit("{year}"), year), F.lit("{run_date}"), day),
    )
    return F.array_distinct(F.filter(filled, lambda u: u != ""))
