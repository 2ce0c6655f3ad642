"""Discovered links: entry URLs, relevance rules, scan limits, ranking."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import LinkRules, RankedSiteRules
from pressmill.functions.text import clean, col, has_any, has_any_exact, lowered, text_array
from pressmill.functions.urls import (
    date_from_url, is_feed_url, is_http, strip_session_id, url_fragment, url_host, url_path,
)
from pressmill.operators.keyed import first_per_key, top_per_key, without_known

log = logging.getLogger(__name__)

# columns a link takes from its source
SOURCE_ATTRIBUTES = (
    "source", "source_type", "source_priority", "country_region", "language", "base_url", "tags",
    "rate_limit_seconds", "max_articles_per_run",
)


def active_sources(sources: DataFrame, include_login: bool = False) -> DataFrame:
    kept = F.col("enabled") & (F.col("source_type") != "manual")
    if not include_login:
        kept = kept & (F.col("source_type") != "login_browser")
    return sources.where(kept)


def attach_source(links: DataFrame, sources: DataFrame, *, source: str = "source", url: str = "url", title: str = "title_original") -> DataFrame:
    """Add source attributes, session-free URL, date from the URL, host and tidy title."""
    attributes = sources.select(
        F.col("name").alias("source"), "source_type", F.col("priority").alias("source_priority"),
        "country_region", "language", "base_url", "tags", "rate_limit_seconds", "max_articles_per_run",
    )
    stale = [c for c in SOURCE_ATTRIBUTES if c in links.columns and c != source]
    plain = strip_session_id(url)
    return (
        links.drop(*stale).join(attributes, source)
        .withColumn(url, plain)
        .withColumn("published_date", date_from_url(url))
        .withColumn("source_domain", url_host(url))
        .withColumn(title, clean(title))
    )


def generic_relevance(url: Column | str, title: Column | str, rules: LinkRules = LinkRules()) -> Column:
    """Is the link likely to be an article?  The first rule that applies decides."""
    u = col(url)
    lower_url, heading = F.lower(u), F.coalesce(col(title), F.lit(""))
    lower_title = F.lower(heading)
    bare = F.regexp_replace(url_path(u), "/+$", "")
    path, host = F.lower(bare), F.lower(url_host(u))
    verdict = F.when(url_fragment(u) != "", False).when(is_feed_url(u), False)
    verdict = verdict.when(path.endswith("/index.html") & ~path.rlike(r"/20\d{2}/"), False)
    for rule in rules.domain_rules:
        here = F.contains(host, F.lit(rule.host))
        if rule.accept:
            verdict = verdict.when(here & path.rlike(rule.accept), True)
        if rule.require:
            verdict = verdict.when(here & ~path.rlike(rule.require), False)
    for extension in rules.blocked_extensions:
        verdict = verdict.when(lower_url.endswith(extension), False)
    return (
        verdict.when(bare.isin(*rules.section_roots), False)
        .when(has_any(lower_url, rules.negative_hints), False)
        .when(lower_title.isin(*lowered(rules.navigation_titles)), False)
        .when(has_any(lower_url, rules.positive_hints), True)
        .when(lower_url.rlike(r"/20\d{2}[/-]?\d{0,2}[/-]?\d{0,2}"), True)
        .otherwise((F.length(heading) >= 12) & has_any(lower_title, rules.topic_words))
    )


def source_relevance(source: Column | str, url: Column | str, title: Column | str, rules: LinkRules) -> Column:
    """Extra conditions some sources put on their links; no rule means accepted."""
    name, path = col(source), F.lower(url_path(url))
    combined = F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), path)
    out = F.lit(True)
    for rule in rules.source_rules:
        ok = F.lit(False)
        for pattern in rule.allow:
            ok = ok | path.rlike(pattern)
        if rule.terms:
            ok = ok | has_any_exact(combined, rule.terms)
        for ending in rule.forbid:
            ok = ok & ~path.endswith(ending)
        out = F.when(name == rule.source, ok).otherwise(out)
    return out


def valid_patterns(patterns: Sequence[str]) -> list[str]:
    """Drop patterns that do not compile; a bad registry entry must not fail the job."""
    good = []
    for pattern in patterns:
        try:
            re.compile(pattern)
            good.append(pattern)
        except re.error:
            log.warning("URL pattern ignored: %s", pattern)
    return good


def pattern_relevance(url: Column | str, include: Column, exclude: Column) -> Column:
    """Any exclude hit rejects; then any include hit accepts; no include list accepts."""
    def hit(patterns: Column) -> Column:
        return F.exists(F.coalesce(patterns, text_array([])), lambda p: F.rlike(col(url), F.concat(F.lit("(?i)"), p)))

    open_list = F.size(F.coalesce(include, text_array([]))) == 0
    return F.when(hit(exclude), False).when(open_list, True).otherwise(hit(include))


def link_relevance(
    url: str, title: str, source: str, include: str, exclude: str, rules: LinkRules = LinkRules()
) -> Column:
    """URL patterns of the source decide when given, else the generic and source rules."""
    size = lambda c: F.size(F.coalesce(F.col(c), text_array([])))
    return F.when(size(include) + size(exclude) > 0, pattern_relevance(url, F.col(include), F.col(exclude))).otherwise(
        generic_relevance(url, title, rules) & source_relevance(source, url, title, rules)
    )


def listing_relevance(url: Column | str, title: Column | str) -> Column:
    """Older, laxer test: a long title or a hint in the URL."""
    return (F.length(F.coalesce(col(title), F.lit(""))) >= 12) | has_any(F.lower(col(url)), fv.LISTING_HINTS)


def target_limit(max_articles: Column | str, multiplier: Column | int) -> Column:
    base = F.coalesce(F.nullif(col(max_articles).try_cast("int"), F.lit(0)), F.lit(1))
    return F.greatest(F.lit(1), F.least(F.lit(300), base * multiplier))


def scan_limit(target: Column, tightly_scoped: Column | str) -> Column:
    wide = F.greatest(target, F.least(F.lit(300), target * 3))
    return F.when(F.coalesce(col(tightly_scoped), F.lit(False)), target).otherwise(wide)


def longest_title_per_url(links: DataFrame, *, keys: Sequence[str] = (), url: str = "url", title: str = "title_original", seq: str = "seq") -> DataFrame:
    return first_per_key(links, [*keys, url], [-F.length(F.coalesce(F.col(title), F.lit(""))), F.col(seq)], position=seq)


def first_source_per_url(links: DataFrame, order: Sequence[str], *, url: str = "url") -> DataFrame:
    """A URL found by several sources belongs to the first one in registry order."""
    return first_per_key(links, [url], order)


def without_stored(links: DataFrame, stored: DataFrame, run_date: Column | None, *, url: str = "url", seq: str = "seq") -> DataFrame:
    """Drop links whose exact URL is stored under another run date."""
    other = stored if run_date is None else stored.where(F.col("run_date") != run_date)
    return without_known(links, other, F.nullif(F.col(url), F.lit("")), F.nullif(F.col(url), F.lit("")), spread=seq)


def keep_previous(new: DataFrame, previous: DataFrame, stored: DataFrame, run_date: Column | None, *, source: str = "source", url: str = "url", seq: str = "seq") -> DataFrame:
    """New links plus the previous ones of every source that found nothing this time."""
    silent = previous.where((clean(source) != "") & (F.coalesce(F.col(url), F.lit("")) != "") & ~is_feed_url(url))
    silent = silent.join(new.select(source).distinct(), source, "left_anti")
    silent = without_stored(silent, stored, run_date, url=url, seq=seq)
    silent = silent.join(new.select(url).distinct(), url, "left_anti")
    kept = first_per_key(silent, [url], [seq])
    return new.withColumn("carried_over", F.lit(False)).unionByName(
        kept.withColumn("carried_over", F.lit(True)), allowMissingColumns=True
    )


def ordered_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of several lists; of equal keys the one in the earliest list stays."""
    whole = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("list_no", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    return first_per_key(whole.where(F.coalesce(F.col(key), F.lit("")) != ""), [key], ["list_no", "seq"])


# ---------------------------------------------------------------------------
# sites whose articles are ranked before they are read


def link_priority(title: Column | str, section: Column | str, rules: RankedSiteRules) -> Column:
    place = F.coalesce(col(section), F.lit(""))
    combined = F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), place))
    high = F.when(has_any(combined, rules.high_value_terms), 80.0).otherwise(0.0)
    by_section = (
        F.when(has_any_exact(place, rules.top_sections), 35.0)
        .when(has_any_exact(place, rules.second_sections), 20.0).otherwise(0.0)
    )
    return high + by_section + F.when(has_any_exact(combined, rules.policy_terms), 30.0).otherwise(0.0)


def low_value_link(title: Column | str, url: Column | str, rules: RankedSiteRules) -> Column:
    return has_any(F.lower(F.concat_ws(" ", col(title), col(url))), rules.low_value_terms)


def priority_section(title: Column | str, url: Column | str, rules: RankedSiteRules) -> Column:
    combined = F.lower(F.concat_ws(" ", col(title), col(url)))
    return ~has_any(combined, rules.negative_section_hints) & has_any(combined, rules.section_hints)


def section_page_relevant(url: Column | str, page_title: Column | str, rules: RankedSiteRules) -> Column:
    """Topic pages must still mention an allowed term; other pages always pass."""
    path, title = url_path(url), F.coalesce(col(page_title), F.lit(""))
    topic = F.lit(False)
    for prefix in rules.topic_prefixes:
        topic = topic | path.startswith(prefix)
    if rules.site_name:
        title = F.regexp_replace(title, rf"[-｜|]\s*{re.escape(rules.site_name)}.*$", "")
        title = F.replace(title, F.lit(rules.site_name), F.lit(""))
    allowed = (*rules.section_hints, *rules.high_value_terms, *rules.topic_terms)
    return ~topic | has_any(F.lower(F.concat_ws(" ", col(url), title)), allowed)


def section_label(default: Column | str, url: Column | str, rules: RankedSiteRules) -> Column:
    lower, out = F.lower(col(url)), col(default)
    for marker, label in reversed(rules.section_labels):
        out = F.when(F.contains(lower, F.lit(marker)), F.lit(label)).otherwise(out)
    return out


def section_links(links: DataFrame, rules: RankedSiteRules, *, page: str = "page_url", limit: int = 8) -> DataFrame:
    """First priority sections a page links to, once each."""
    wanted = links.where(
        (url_host("url") == rules.host) & ~F.contains(url_path("url"), F.lit("/article/"))
        & priority_section("title", "url", rules)
    )
    return top_per_key(first_per_key(wanted, [page, "url"], ["pos"]), [page], [F.col("pos")], limit, seq="pos")


def article_links(links: DataFrame, rules: RankedSiteRules, limit: int, *, page: str = "page_url") -> DataFrame:
    """First articles a section page links to, once each."""
    wanted = links.where(
        (url_host("url") == rules.host) & F.contains(url_path("url"), F.lit("/article/"))
        & ~low_value_link("title", "url", rules)
    )
    return top_per_key(first_per_key(wanted, [page, "url"], ["pos"]), [page], [F.col("pos")], limit, seq="pos")


def section_cap(total: int) -> int:
    return max(8, min(30, total // 6))


def capped_sections(links: DataFrame, total: int, *, section: str = "section_no", pos: str = "pos", url: str = "url") -> DataFrame:
    """At most ``section_cap`` links per section, a URL once, ``total`` links in all."""
    per_section = top_per_key(links, [section], [F.col(pos)], section_cap(total), seq=pos)
    return first_per_key(per_section, [url], [section, pos]).orderBy(section, pos).limit(total)


def rank_links(scored: DataFrame, rules: RankedSiteRules, k: int, *, title: str = "title_original", section: str = "source_section", score: str = "score", seq: str = "seq") -> DataFrame:
    """Top ``k`` links by score plus link priority, earlier links first on ties."""
    return (
        scored.withColumn("link_rank_score", F.col(score) + link_priority(title, section, rules))
        .orderBy(F.desc("link_rank_score"), F.asc(seq)).limit(k)
    )


def usable_body(text: Column | str, page_body: Column | str, rules: RankedSiteRules) -> Column:
    body = F.coalesce(col(text), F.lit(""))
    size = F.length(clean(body))
    partial = has_any_exact(F.coalesce(col(page_body), F.lit("")), rules.paywall_markers)
    navigation = has_any_exact(F.substring(body, 1, 900), rules.navigation_markers)
    return (size >= rules.min_body_chars) & ~navigation & ~(partial & (size < rules.partial_body_chars))


def access_state(body: Column | str, rules: RankedSiteRules) -> Column:
    text = F.coalesce(col(body), F.lit(""))
    signed_in = has_any_exact(text, (*rules.logged_in_markers, *rules.member_markers))
    return (
        F.when(signed_in, "true").when(has_any_exact(text, rules.logged_out_markers), "false").otherwise("unknown")
    )
