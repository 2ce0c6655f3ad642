"""Candidate score: parts, penalties, exclusions, explanation and classification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import Profile, TermLists, TitleRules
from pressmill.functions.keywords import matched_categories
from pressmill.functions.terms import Found
from pressmill.functions.text import (
    clean, col, has_any, has_any_exact, hits, is_missing, let, lowered, text_array,
)

POLICY_TOPIC_BONUS = 3.0


def _words(pattern: str) -> list[str]:
    """The words of a pattern that is only a list of words; none if it is more."""
    words = pattern.lower().split("|")
    return words if all(w.isalnum() for w in words) else []


def searched_lists(terms: TermLists, profile: Profile) -> list[Sequence[str]]:
    """Every list whose terms the parts of a score look for in lower-cased text."""
    of_terms = [getattr(terms, f.name) for f in fields(terms) if f.name != "soft_text" and not f.name.endswith("_categories")]
    return [*of_terms, profile.region_terms, profile.preferred_regions, (fv.WARN_DATE, fv.NO_DATE), *map(_words, fv.INFO_PATTERNS)]


def _matches(lower: Column, found: Found, pattern: str) -> Column:
    """Search lower-cased text for a case-blind pattern.

    A pattern that is only a list of words is looked up among the found terms, and one that needs a
    digit is tried only on text that has one; both are far cheaper than the regex.
    """
    if _words(pattern):
        return found.any(_words(pattern))
    # letters of classes such as \d are lower case already
    return lower.rlike(r"\d") & lower.rlike(pattern.lower())


def info_score(lower: Column, found: Found) -> Column:
    """Specificity of lower-cased text: concrete figures, dates, milestones and units."""
    patterns = sum(F.when(_matches(lower, found, p), 1).otherwise(0) for p in fv.INFO_PATTERNS)
    long_text = F.when(F.length(lower) > 800, 1).otherwise(0)
    return F.least(F.lit(25.0), (patterns + long_text) * F.lit(5.0))


def strategic_score(lower: Column | Found, terms: TermLists) -> Column:
    return F.least(F.lit(20.0), hits(lower, terms.strategic) * F.lit(5.0))


def novelty_score(lower: Column | Found, terms: TermLists) -> Column:
    return F.least(F.lit(10.0), hits(lower, terms.novelty) * F.lit(3.0))


def authority_score(source_type: Column | str, priority: Column | str) -> Column:
    kind = F.lower(F.coalesce(col(source_type), F.lit("")))
    p = F.coalesce(F.nullif(col(priority).try_cast("int"), F.lit(0)), F.lit(1)).cast("double")
    return (
        F.when(kind == "official", F.least(F.lit(10.0), p + 5))
        .when(kind == "rss", F.least(F.lit(10.0), p + 3))
        .when(kind == "login_browser", F.least(F.lit(6.0), p * 0.6 + 2))
        .otherwise(F.least(F.lit(10.0), p * 1.5))
    )


def compilable_score(title: Column, text: Column) -> Column:
    size = F.length(text)
    return (
        F.when(title == "", 0.0).when(size >= 500, 5.0).when(size >= 200, 3.0).when(size > 0, 1.0).otherwise(0.0)
    )


def policy_score(lower: Column | Found, source_type: Column | str, terms: TermLists) -> Column:
    found = hits(lower, terms.high_value_policy)
    official = F.when(F.lower(F.coalesce(col(source_type), F.lit(""))) == "official", 4.0).otherwise(0.0)
    topic = F.when(has_any(lower, terms.policy_topic), POLICY_TOPIC_BONUS).otherwise(0.0)
    bonus = F.least(F.lit(12.0), found * F.lit(3.0)) + official + topic
    return F.when(found > 0, F.least(F.lit(18.0), bonus)).otherwise(0.0)


def negative_penalty(text: Column, lower: Column | Found, terms: TermLists) -> Column:
    weighted = (
        hits(lower, terms.negative) * 4
        + hits(lower, terms.low_value_business) * 3
        + hits(lower, terms.low_scope_consumer) * 8
        + hits(lower, terms.market_title) * 12
        + hits(lower, terms.market_body) * 5
    )
    undated = F.when(has_any(lower, (fv.WARN_DATE, fv.NO_DATE)), 8).otherwise(0)
    tiny = F.when(F.length(text) < 150, 6).otherwise(0)
    return F.least(F.lit(35.0), (weighted + undated + tiny).cast("double"))


def consumer_topic(lower: Column | Found, terms: TermLists) -> Column:
    return has_any(lower, terms.low_scope_consumer) & ~has_any(lower, terms.core_topic)


def market_topic(lower_title: Column | Found, lower_text: Column | Found, terms: TermLists) -> Column:
    signals = hits(lower_text, terms.market_body) + hits(lower_text, terms.market_title)
    off_core = ~has_any(lower_title, terms.core_topic) & (hits(lower_text, terms.core_topic) < 2)
    return has_any(lower_title, terms.market_title) | ((signals >= 3) & off_core)


def excluded_topic(title: Column, text: Column, terms: TermLists) -> Column:
    """True for market-only, sports, operational and consumer items (inputs cleaned)."""
    lowered_once = F.struct(
        F.lower(title).alias("title"), F.lower(text).alias("text"), F.lower(F.concat(title, F.lit(" "), text)).alias("both")
    )

    return let(lowered_once, lambda v: excluded_by_terms(v["title"], v["text"], v["both"], terms))


def excluded_by_terms(title: Column | Found, text: Column | Found, both: Column | Found, terms: TermLists) -> Column:
    """The same for lower-cased texts, or for the terms found in them."""
    sports = has_any(title, terms.sports_title) & ~has_any(title, terms.sports_technology)
    operational = has_any(both, terms.operational) & ~has_any(both, terms.operational_strategic)
    return market_topic(title, text, terms) | sports | has_any(title, terms.operational) | consumer_topic(both, terms) | operational


def region_preference(lower: Column | Found, country_region: Column | str, terms: TermLists, profile: Profile) -> Column:
    """``struct<bonus, penalty, entity, from_region>`` of the profile's regional preference."""
    if not profile.preferred_regions and not profile.region_terms:
        zero = F.lit(0.0)
        return F.struct(
            zero.alias("bonus"), zero.alias("penalty"),
            F.lit(False).alias("entity"), F.lit(False).alias("from_region"),
        )
    entity_terms = profile.region_terms or terms.target_region
    weak = set(lowered(profile.preferred_regions))
    strong = has_any(lower, [t for t in entity_terms if t.lower() not in weak])
    low_priority = has_any(lower, terms.low_priority_global)
    entity = strong | (has_any(lower, entity_terms) & ~low_priority)
    home = F.lower(F.coalesce(col(country_region), F.lit(""))).isin(*(weak or {""}))
    if not weak:
        home = F.lit(False)
    missing = 18.0 if profile.require_preferred_region else 0.0
    bonus = F.when(entity, 12.0).when(home, 4.0).otherwise(0.0)
    penalty = F.when(entity | home, 0.0).otherwise(missing) + F.when(
        low_priority, F.when(entity, 4.0).otherwise(10.0)
    ).otherwise(0.0)
    return F.struct(
        F.least(F.lit(15.0), bonus).alias("bonus"),
        F.least(F.lit(25.0), penalty).alias("penalty"),
        entity.alias("entity"), (home & ~entity).alias("from_region"),
    )


def similarity_bonus(similarity: Column) -> Column:
    return F.least(F.lit(5.0), F.coalesce(similarity, F.lit(0.0)) * 5)


def reference_score(similarity_part: Column, history_part: Column) -> Column:
    return F.bround(F.least(F.lit(10.0), similarity_part + history_part) / 10 * 100, 1)


def total_score(raw: Column, consumer: Column, excluded: Column) -> Column:
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))
    capped = F.when(consumer, F.least(total, F.lit(32.0))).otherwise(total)
    return F.bround(F.when(excluded, F.lit(0.0)).otherwise(capped), 1)


def explanation(parts: dict[str, Column], region_label: str) -> Column:
    """Labels of positive parts and fired rules, in fixed order."""
    labels = [F.when(parts[name] > 0, F.lit(label)) for name, label in fv.PART_LABELS]
    labels += [
        F.when(parts["policy"] > 0, F.lit(fv.REASON_POLICY)),
        F.when(parts["history_bonus"] > 0, F.lit(fv.REASON_HISTORY)),
        F.when(parts["region_entity"], F.lit(fv.REASON_REGION_ENTITY.format(label=region_label))),
        F.when(parts["from_region"], F.lit(fv.REASON_REGION_SOURCE.format(label=region_label))),
        F.when(parts["negative_penalty"] > 0, F.lit(fv.REASON_NEGATIVE)),
        F.when(parts["consumer"], F.lit(fv.REASON_CONSUMER)),
        F.when(parts["excluded"], F.lit(fv.REASON_EXCLUDED)),
        F.when(parts["region_penalty"] > 0, F.lit(fv.REASON_REGION_PENALTY)),
    ]
    return F.array_join(F.array_compact(F.array(*labels)), fv.REASON_SEPARATOR)


def suggested_type(matches: Column | str, lower: Column | Found, terms: TermLists) -> Column:
    categories = matched_categories(matches)
    policy = F.arrays_overlap(categories, text_array(terms.policy_categories)) | has_any(lower, terms.policy_text)
    industry = F.arrays_overlap(categories, text_array(terms.industry_categories)) | has_any(lower, terms.industry_text)
    return F.when(policy, fv.POLICY).when(industry, fv.INDUSTRY).otherwise(fv.TECHNOLOGY)


def suggested_soft_hard(matches: Column | str, text: Column, terms: TermLists) -> Column:
    soft = F.arrays_overlap(matched_categories(matches), text_array(terms.soft_categories))
    return F.when(soft | has_any_exact(text, terms.soft_text), fv.SOFT_SCIENCE).otherwise(fv.HARD_SCIENCE)


def type_from_title(known_type: Column | str, title: Column | str, url: Column | str, rules: TitleRules) -> Column:
    linked = clean(url) != ""

    def by_title(lower: Column) -> Column:
        return (
            F.when(has_any(lower, rules.policy), fv.POLICY).when(has_any(lower, rules.industry), fv.INDUSTRY)
            .when((lower != "") | linked, fv.TECHNOLOGY).otherwise(fv.UNCLASSIFIED)
        )

    by_rules = let(F.lower(clean(title)), by_title)
    return let(clean(known_type), lambda k: F.when(k.isin(fv.POLICY, fv.TECHNOLOGY, fv.INDUSTRY), k).otherwise(by_rules))


def soft_hard_from_title(known: Column | str, title: Column | str, url: Column | str, kind: Column, rules: TitleRules) -> Column:
    linked = clean(url) != ""
    bound = F.struct(clean(known).alias("given"), F.lower(clean(title)).alias("lower"), kind.alias("kind"))
    return let(
        bound,
        lambda v: F.when(v["given"].isin(fv.SOFT_SCIENCE, fv.HARD_SCIENCE), v["given"])
        .when((v["kind"] == fv.POLICY) & has_any(v["lower"], rules.soft), fv.SOFT_SCIENCE)
        .when(has_any(v["lower"], rules.hard), fv.HARD_SCIENCE)
        .when(v["kind"].isin(fv.TECHNOLOGY, fv.INDUSTRY) | linked, fv.HARD_SCIENCE)
        .otherwise(fv.UNCLASSIFIED),
    )


def keywords_from_title(title: Column | str, rules: TitleRules) -> Column:
    found = lambda text: F.filter(text_array(rules.keywords), lambda t: F.contains(text, t))
    return F.slice(let(clean(title), found), 1, rules.max_keywords)


def metadata_quality(*values: Column | str) -> Column:
    return sum(F.when(is_missing(v), 0).otherwise(1) for v in values)
