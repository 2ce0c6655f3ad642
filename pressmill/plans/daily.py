"""One run date end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.config import LinkRules, RankedSiteRules, ScoreSettings
from pressmill.plans.candidates import candidates, combine_pools
from pressmill.plans.collect import collect, collect_ranked, ranked_links, section_page_links
from pressmill.plans.discover import discover


def daily_run(
    pages: DataFrame, feeds: DataFrame | None, sources: DataFrame, stored: DataFrame, previous: DataFrame | None,
    run_date: str, settings: ScoreSettings, *, samples: DataFrame | None = None, reported: DataFrame | None = None,
    link_rules: LinkRules = LinkRules(), section_pages: DataFrame | None = None,
    ranked_rules: RankedSiteRules | None = None, ranked_limit: int = 10, translate=None,
    regions: Sequence[tuple[str, str]] = (), quotas: Sequence[tuple[str, int]] = (),
) -> DataFrame:
    """Discovery, collection, candidates, the ranked site if given, and the combined pool."""
    found = discover(pages, feeds, sources, stored, previous, run_date, settings.profile, link_rules)
    articles = collect(found, pages).withColumn("run_date", F.lit(run_date).cast("date"))
    pools = {}
    first_source = ""
    if ranked_rules is not None and section_pages is not None:
        links = section_page_links(section_pages, ranked_rules, min(240, ranked_limit * 4))
        best = ranked_links(links, settings, ranked_rules, min(60, ranked_limit * 2), samples)
        pools["ranked"] = collect_ranked(best, pages, settings, ranked_rules, run_date, ranked_limit, samples)
        first_source = ranked_rules.source
    pools["public"] = candidates(articles, settings, samples, reported)
    return combine_pools(
        pools, run_date, settings, samples, reported, translate,
        first_source=first_source, regions=regions, quotas=quotas,
    )
