"""Articles from discovered links, full text of selected rows, sites read behind a login."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import Profile, RankedSiteRules, ScoreSettings
from pressmill.functions import html
from pressmill.functions.dates import (
    normalize_local_date_text, page_date, published_date, status_keeps, text_window_status,
)
from pressmill.functions.text import append_warning, clean, cut, extraction_warning, first_text, merge_warnings
from pressmill.functions.urls import url_host
from pressmill.operators import links as lk
from pressmill.operators.digests import MIN_SELECTED, merge_full_text
from pressmill.operators.lineage import cut_lineage
from pressmill.operators.review import without_excluded
from pressmill.operators.scored import score_articles

_COLLECTION_FAILED = "collection_failed: page not crawled"


def extracted_pages(pages: DataFrame, *, structured_data: bool = False) -> DataFrame:
    """``url, title, text, published_date`` of crawled pages.

    Dates in script blocks are used only on request: the extraction this follows drops
    scripts before it looks for a date.
    """
    parsed = pages.withColumn("_a", html.article_parts("html"))
    json_ld = F.col("_a.json_ld") if structured_data else F.array().cast("array<string>")
    return parsed.select(
        *[c for c in pages.columns if c != "html"], F.col("_a.title").alias("title"), F.col("_a.text").alias("text"),
        page_date(F.col("_a.dates"), json_ld, F.col("_a.text")).alias("page_date"),
    )


def article_columns(df: DataFrame) -> DataFrame:
    """The stored article row, with its 500-character preview and the source's limit."""
    extra = [c for c in ("run_date", "ingest_seq", "seq") if c in df.columns]
    return df.select(
        *extra, "title_original", "source", "country_region", "language", "published_date", "url", "raw_text",
        F.trim(cut("raw_text")).alias("raw_text_preview"),
        F.coalesce(F.nullif(F.col("source_priority").try_cast("int"), F.lit(0)), F.lit(1)).alias("source_priority"),
        "source_type", first_text("source_domain", url_host("url")).alias("source_domain"), "tags",
        "extraction_warning", "max_articles_per_run",
    )


def collect(discovered: DataFrame, pages: DataFrame, *, structured_data: bool = False) -> DataFrame:
    """Join links to crawled pages and extract; links whose page is missing keep a warning."""
    wanted = discovered.where(F.coalesce("url", F.lit("")) != "")
    needed = pages.join(wanted.select("url").distinct(), "url", "left_semi").select("url", "html")
    found = extracted_pages(needed, structured_data=structured_data).select(
        F.col("url").alias("_url"), F.col("title").alias("_title"), F.col("text").alias("_text"), F.col("page_date").alias("_date")
    )
    existing = F.col("extraction_warning") if "extraction_warning" in discovered.columns else F.lit("")
    joined = wanted.join(found, F.col("url") == F.col("_url"), "left").withColumn("_w", existing)
    got = F.col("_url").isNotNull()
    title, text = clean(first_text("_title", "title_original")), clean("_text")
    rows = joined.withColumn("_t", title).withColumn("raw_text", F.when(got, text).otherwise(""))
    rows = rows.withColumn("_d", published_date("_date", "published_date", F.col("_t"), F.col("raw_text")))
    warning = merge_warnings("_w", F.when(got, extraction_warning("_t", "raw_text", "_d")).otherwise(_COLLECTION_FAILED))
    rows = rows.withColumn("extraction_warning", warning).withColumn(
        "title_original", F.when(got, F.col("_t")).otherwise(F.col("title_original"))
    ).withColumn("published_date", F.when(got, F.col("_d")).otherwise(F.col("published_date")))
    return article_columns(rows)


def enrich_selected(candidates: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable selected rows with the longer text, and the report on every row."""
    needed = pages.join(candidates.select(F.trim("url").alias("url")).distinct(), "url", "left_semi").select("url", "html")
    fetched = extracted_pages(needed).select(
        "url", F.col("title").alias("title_original"), F.col("page_date").alias("published_date"), F.col("text").alias("raw_text"),
        F.when(F.length("text") >= MIN_SELECTED, "").otherwise(fv.WARN_FULLTEXT_SHORT).alias("extraction_warning"),
    )
    merged = merge_full_text(candidates, fetched)
    report = merged.select(
        "title_original", "source", "url", "before_chars", F.col("selected_fulltext_chars").alias("after_chars"),
        F.col("selected_fulltext_status").alias("status"), F.col("selected_fulltext_warning").alias("warning"),
    )
    return merged.where(F.col("selected_fulltext_status") != "failed").drop("before_chars"), report


def ranked_links(links: DataFrame, settings: ScoreSettings, rules: RankedSiteRules, k: int, samples: DataFrame | None = None) -> DataFrame:
    """Score links by their titles alone and keep the best ``k``."""
    as_articles = links.select(
        "seq", "url", "title_original", "source_section", F.col("title_original").alias("raw_text"),
        F.lit(rules.source).alias("source"), F.lit(rules.country_region).alias("country_region"),
        F.lit(rules.language).alias("language"), F.lit(rules.priority).alias("source_priority"),
        F.lit("login_browser").alias("source_type"), F.lit(rules.host).alias("source_domain"),
    )
    scored = score_articles(as_articles, settings, samples)
    return lk.rank_links(scored.select("seq", "url", "title_original", "source_section", "score"), rules, k)


def section_page_links(pages: DataFrame, rules: RankedSiteRules, total: int) -> DataFrame:
    """Article links of section pages ``url, html, section, section_no``, capped per section."""
    from pressmill.plans.discover import page_link_rows

    fit = pages.withColumn("_b", html.body_parts("html")).where(lk.section_page_relevant("url", "_b.title", rules)).drop("_b")
    rows = page_link_rows(fit, keep=("section", "section_no"))
    rows = rows.withColumn("title", F.col("own_text"))
    chosen = lk.article_links(rows, rules, lk.section_cap(total))
    capped = lk.capped_sections(chosen, total)
    return capped.select(
        (F.col("section_no").cast("bigint") * (1 << 32) + F.col("pos")).alias("seq"), "url",
        F.col("title").alias("title_original"), F.col("section").alias("source_section"),
    )


def collect_ranked(
    links: DataFrame, pages: DataFrame, settings: ScoreSettings, rules: RankedSiteRules, run_date: str, limit: int,
    samples: DataFrame | None = None, profile: Profile | None = None,
) -> DataFrame:
    """Articles of ranked links: readable body, in the window, not excluded, best ``limit``."""
    profile, day = profile or settings.profile, F.lit(run_date).cast("date")
    wanted = links.select("seq", "url", F.col("title_original").alias("_link_title"), "source_section")
    opened = pages.select("url", "html").join(wanted.select("url").distinct(), "url", "left_semi")
    # parsed once and stored: what follows reads the parts in filters, dates and scores
    joined = cut_lineage(wanted.join(opened.select("url", html.body_parts("html").alias("_b")), "url"))
    text = html.article_body(F.col("_b"), rules.sentence_pattern, rules.navigation_markers, rules.tail_markers)
    rows = joined.withColumn("raw_text", text).withColumn("logged_in_status", lk.access_state("_b.body", rules))
    rows = rows.where(lk.usable_body("raw_text", "_b.body", rules))
    rows = rows.withColumn("published_date", normalize_local_date_text("_b.body"))
    rows = rows.withColumn("_status", text_window_status("published_date", day, profile))
    rows = rows.where(status_keeps(F.col("_status")))
    articles = rows.select(
        "seq", "url", first_text("_b.h1", "_b.title", "_link_title").alias("title_original"), "published_date",
        F.lit(rules.source).alias("source"), "source_section", "raw_text", cut("raw_text").alias("raw_text_preview"),
        append_warning(F.lit(""), F.col("_status")).alias("extraction_warning"), "logged_in_status",
        url_host("url").alias("source_domain"), F.lit(rules.country_region).alias("country_region"),
        F.lit(rules.language).alias("language"), F.lit(rules.priority).alias("source_priority"),
        F.lit("login_browser").alias("source_type"),
    )
    articles = without_excluded(articles, settings.terms)
    scored = score_articles(articles, settings, samples, keep=("seq", "logged_in_status"))
    return scored.orderBy(F.desc("score"), F.asc("seq")).limit(limit)
