"""Link discovery, source diagnosis and the older one-pass fetch over crawled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import LinkRules, Profile
from pressmill.functions import html
from pressmill.functions.dates import status_keeps, text_window_status, window_multiplier
from pressmill.functions.text import first_text, let, text_array
from pressmill.functions.urls import expand_entry_urls, is_feed_url, public_url_error, same_host, url_host
from pressmill.operators import links as lk
from pressmill.operators.diagnosis import diagnose
from pressmill.operators.keyed import first_per_key, top_per_key
from pressmill.operators.lineage import cut_lineage
from pressmill.sources.readers import feed_articles, feed_items

# source, entry page and place on the page as one number
_ENTRY_STEP = 1 << 20
_SOURCE_STEP = 1 << 32


def entry_urls(sources: DataFrame, run_date: Column) -> DataFrame:
    """Entry pages of each source in order: ``source, entry_no, entry_url`` and limits."""
    given = F.when(F.size("discovery_urls") > 0, F.col("discovery_urls")).otherwise(F.array("section_url"))
    return sources.select(
        F.col("name").alias("source"), "source_no", "source_type", "base_url", "link_selectors",
        "include_url_patterns", "exclude_url_patterns", "max_articles_per_run", "tightly_scoped",
        F.posexplode(expand_entry_urls(given, run_date)).alias("entry_no", "entry_url"),
    )


def page_link_rows(pages: DataFrame, *, url: str = "url", base: str = "base_url", selectors: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per anchor of a page: ``pos, url, title, own_text`` and the page's columns."""
    wanted = F.col(selectors) if selectors else F.lit(None).cast("array<string>")
    parsed = pages.select(
        F.col(url).alias("page_url"), *([F.col(base).alias("base_url")] if base in pages.columns else [F.lit("").alias("base_url")]),
        *[F.col(c) for c in keep], F.explode(html.page_links("html", url, wanted)).alias("a"),
    )
    return parsed.select(
        "page_url", "base_url", *keep, F.col("a.pos").alias("pos"), F.col("a.url").alias("url"),
        F.col("a.title").alias("title"), F.col("a.own_text").alias("own_text"), F.col("a.selector_rank").alias("selector_rank"),
    )


def discovered_candidates(entries: DataFrame, pages: DataFrame, feeds: DataFrame | None, rules: LinkRules, run_date: Column, profile: Profile) -> DataFrame:
    """Links of all entry pages and feeds before limits: ``source, url, title_original, seq``.

    Pages are joined to their entries first, so only pages that serve a source are parsed.
    """
    target = lk.target_limit("max_articles_per_run", window_multiplier(run_date, profile))
    limited = entries.withColumn("target", target).withColumn("scan", lk.scan_limit(F.col("target"), "tightly_scoped"))
    keep = ("source", "source_no", "entry_no", "include_url_patterns", "exclude_url_patterns", "scan")
    listing = limited.where(F.col("source_type") != "rss").join(pages.select(F.col("url").alias("entry_url"), "html"), "entry_url")
    rows = page_link_rows(listing, url="entry_url", selectors="link_selectors", keep=keep)
    origin = first_text("base_url", "page_url")
    rows = rows.where(same_host("url", origin)).select(*keep, "pos", "url", F.col("title").alias("title_original"))
    relevant = lk.link_relevance("url", "title_original", "source", "include_url_patterns", "exclude_url_patterns", rules)
    rows = rows.where(relevant)
    rows = top_per_key(
        rows.withColumn("seq", F.col("entry_no").cast("bigint") * _ENTRY_STEP + F.col("pos")),
        ["source", "entry_no"], [F.col("pos")], F.col("scan") * 4, seq="seq",
    )
    rows = lk.longest_title_per_url(rows, keys=["source", "entry_no"])
    if feeds is not None:
        given = limited.join(feeds.select(F.col("url").alias("entry_url"), "xml"), "entry_url")
        # the scan limit never exceeds 300 entries per feed
        items = feed_items(given.select(*keep, F.col("entry_url").alias("url"), "xml"), 300)
        items = items.where((F.col("pos") < F.col("scan"))).select(
            *keep, "pos", F.col("link").alias("url"), F.col("title").alias("title_original"),
            (F.col("entry_no").cast("bigint") * _ENTRY_STEP + F.col("pos")).alias("seq"),
        )
        rows = rows.unionByName(items.where(relevant))
    return rows


def discover(
    pages: DataFrame, feeds: DataFrame | None, sources: DataFrame, stored: DataFrame, previous: DataFrame | None,
    run_date: str, profile: Profile = Profile(), rules: LinkRules = LinkRules(), *, include_login: bool = False,
) -> DataFrame:
    """Discovered links of all active sources for one run date.

    ``stored``: ``run_date, url`` of articles already kept; ``previous``: links of an
    earlier discovery of the same day.
    """
    day = F.lit(run_date).cast("date")
    active = lk.active_sources(sources, include_login)
    rows = discovered_candidates(entry_urls(active, day), pages, feeds, rules, day, profile)
    rows = lk.attach_source(rows, active)
    rows = first_per_key(rows, ["source", "url"], ["seq"])
    rows = lk.without_stored(rows, stored, day)
    status = text_window_status("published_date", day, profile)
    rows = rows.where(let(status, lambda s: status_keeps(s) | (s == fv.NO_DATE)))
    rows = settled(rows, active, previous, stored, day)
    rows = rows.withColumn("seq", F.col("source_no").cast("bigint") * _SOURCE_STEP + F.col("seq"))
    return rows.drop("scan", "entry_no", "pos", "include_url_patterns", "exclude_url_patterns")


def settled(rows: DataFrame, active: DataFrame, previous: DataFrame | None, stored: DataFrame, day: Column) -> DataFrame:
    """What each source keeps when the sources take their turns in registry order.

    A source takes its first ``scan`` links that no earlier source has kept; a source left without
    links takes its previous ones that nobody before it keeps. Starting from every source on its
    own, all turns are taken anew against the last outcome until it stays the same: what the first
    sources keep is right at once and what source n keeps at most n rounds later, in practice after
    two or three. The rounds carry keys only.
    """
    rows = rows.withColumn("carried_over", F.lit(False))
    if previous is not None:
        old = previous.where((F.coalesce(F.col("source"), F.lit("")) != "") & (F.coalesce(F.col("url"), F.lit("")) != "") & ~is_feed_url("url"))
        old = lk.without_stored(first_per_key(old, ["source", "url"], ["seq"]), stored, day)
        numbers = active.select(F.col("name").alias("source"), "source_no")
        old = old.drop("source_no").join(numbers, "source").withColumns(
            {"carried_over": F.lit(True), "seq": F.pmod(F.col("seq").cast("bigint"), F.lit(_SOURCE_STEP))}
        )
        rows = rows.unionByName(old, allowMissingColumns=True)
    key = ["source", "url", "carried_over"]
    rows = cut_lineage(rows)
    narrow = rows.select(*key, "source_no", "seq", "scan")
    kept, before = narrow.limit(0), None
    while True:
        owners = kept.groupBy(F.col("url").alias("_url")).agg(F.min("source_no").alias("_owner"))
        free = narrow.join(owners, F.col("url") == F.col("_url"), "left").where(
            F.col("_owner").isNull() | (F.col("_owner") >= F.col("source_no"))
        ).select(narrow.columns)
        found = top_per_key(free.where(~F.col("carried_over")), ["source"], [F.col("seq")], F.col("scan"), seq="seq")
        silent = free.where("carried_over").join(found.select("source").distinct(), "source", "left_anti")
        kept = cut_lineage(found.unionByName(silent))
        now = kept.agg(F.count("*"), F.sum(F.xxhash64(*key).cast("decimal(38,0)"))).first()
        if now == before:
            return rows.join(kept.select(*key), key, "left_semi")
        before = now


def legacy_fetch(
    pages: DataFrame, feeds: DataFrame | None, manual: DataFrame | None, sources: DataFrame, *, limit: int = 20,
    rules: LinkRules = LinkRules(),
) -> DataFrame:
    """Older fetch: one section page or feed per source, laxer link test, no dates from pages."""
    open_sources = sources.where(F.col("enabled") & ~F.col("requires_login"))
    attributes = ("country_region", "language", "priority", "source_type", "tags")
    patterns = F.size("include_url_patterns") + F.size("exclude_url_patterns") > 0
    selectors = F.when(F.size("link_selectors") > 0, F.col("link_selectors")).otherwise(text_array(fv.LISTING_SELECTORS))
    listing = (
        open_sources.where(~F.col("source_type").isin("rss", "manual"))
        .withColumn("selectors", selectors)
        .join(pages.select(F.col("url").alias("section_url"), "html"), "section_url")
    )
    keep = ("name", "source_no", "include_url_patterns", "exclude_url_patterns", *attributes)
    rows = page_link_rows(listing, url="section_url", selectors="selectors", keep=keep)
    rows = rows.where(same_host("url", "page_url"))
    strict = lk.link_relevance("url", "own_text", "name", "include_url_patterns", "exclude_url_patterns", rules)
    rows = rows.where(F.when(patterns, strict).otherwise(lk.listing_relevance("url", "own_text")))
    rows = rows.withColumn("seq", F.col("pos").cast("bigint"))
    rows = first_per_key(rows, ["name", "url"], ["seq"])
    rows = top_per_key(rows, ["name"], [F.col("seq")], limit, seq="seq")
    target = pages.select(F.col("url").alias("_u"), F.col("html").alias("_h"))
    opened = rows.join(target, F.col("url") == F.col("_u")).withColumn("_a", html.opened_parts("_h"))
    articles = opened.select(
        first_text("own_text", "_a.title").alias("title_original"), F.col("name").alias("source"), *attributes,
        F.lit("").alias("published_date"), "url", F.col("_a.text").alias("raw_text"),
    ).where((F.col("title_original") != "") | (F.col("raw_text") != ""))
    if feeds is not None:
        given = open_sources.where(F.col("source_type") == "rss").select(
            F.col("name").alias("source"), *attributes, F.col("section_url").alias("url")
        ).join(feeds.select("url", "xml"), "url")
        items = feed_items(given, limit)
        parsed = pages.join(items.select(F.col("link").alias("url")).distinct(), "url").withColumn("_a", html.article_parts("html"))
        extracted = parsed.select("url", F.col("_a.title").alias("title"), F.col("_a.text").alias("text"))
        articles = articles.unionByName(feed_articles(items, extracted), allowMissingColumns=True)
    if manual is not None:
        articles = articles.unionByName(manual, allowMissingColumns=True)
    return articles.withColumn("source_domain", url_host("url")).withColumn("raw_text_preview", F.trim(F.substring("raw_text", 1, 500)))


def diagnose_sources(sources: DataFrame, pages: DataFrame, rules: LinkRules = LinkRules(), *, sample_size: int = 2, max_entries: int = 4, feeds: DataFrame | None = None) -> DataFrame:
    """Diagnosis of each source from the crawled copies of its entry pages and candidates.

    ``feeds``: ``url, xml`` of entries answered with XML. They and all entries of rss sources, also
    those whose copy is among the pages, are read as feeds, the others as HTML.
    """
    given = F.when(F.size("discovery_urls") > 0, F.col("discovery_urls")).otherwise(F.array(first_text("section_url", "base_url")))
    entries = sources.select(
        F.col("name").alias("source"), "source_type", "base_url", "link_selectors", "include_url_patterns",
        "exclude_url_patterns", F.posexplode(F.slice(given, 1, max_entries)).alias("entry_no", "entry_url"),
    ).withColumn("refused", public_url_error("entry_url"))
    content = pages.select(F.col("url").alias("entry_url"), "html")
    joined = entries.join(content, "entry_url", "left")
    answered = F.when(F.col("source_type") == "rss", F.col("html"))
    if feeds is not None:
        joined = joined.join(feeds.select(F.col("url").alias("entry_url"), "xml"), "entry_url", "left")
        answered = F.coalesce("xml", answered)
    joined = joined.withColumn("xml", answered)
    crawled = F.col("html").isNotNull() | F.col("xml").isNotNull()
    checked = joined.select(
        "source", "entry_no",
        ((F.col("refused") == "") & crawled).alias("reachable"),
        F.when(F.col("refused") != "", F.concat_ws(": ", "entry_url", "refused"))
        .when(~crawled, F.concat(F.col("entry_url"), F.lit(": not crawled"))).otherwise("").alias("error"),
    )
    open_entries = joined.where((F.col("refused") == "") & crawled)
    open_pages = open_entries.where("xml is null")
    keep = ("source", "entry_no", "include_url_patterns", "exclude_url_patterns")
    rows = page_link_rows(open_pages, url="entry_url", selectors="link_selectors", keep=keep)
    rows = rows.where(same_host("url", first_text("base_url", "page_url"), empty_host_ok=False))
    relevant = lk.link_relevance("url", "title", "source", "include_url_patterns", "exclude_url_patterns", rules)
    rows = rows.where(relevant)
    seq = (F.col("entry_no").cast("bigint") * _ENTRY_STEP + F.col("pos")).alias("seq")
    rows = rows.withColumn("seq", seq)
    rows = top_per_key(rows, ["source", "entry_no"], [F.col("seq")], 60, seq="seq")
    items = feed_items(open_entries.where("xml is not null").select(*keep, F.col("entry_url").alias("url"), "xml"), 50)
    items = items.select(*keep, F.col("link").alias("url"), "title", seq).where(relevant)
    columns = ("source", "url", "title", "seq")
    candidates = rows.select(*columns).unionByName(items.select(*columns))
    detected = open_pages.select(
        "source", "entry_no", F.posexplode(html.page_feeds("html", "entry_url")).alias("pos", "feed_url")
    ).select("source", "feed_url", (F.col("entry_no").cast("bigint") * _ENTRY_STEP + F.col("pos")).alias("seq"))
    first = top_per_key(first_per_key(candidates, ["source", "url"], ["seq"]), ["source"], [F.col("seq")], sample_size, seq="seq")
    sampled = first.join(pages.select(F.col("url").alias("_u"), "html"), F.col("url") == F.col("_u")).withColumn("_a", html.article_parts("html"))
    samples = sampled.select("source", F.col("_a.title").alias("title"), F.length("_a.text").alias("text_chars"))
    return diagnose(sources, checked, candidates, detected, samples)
