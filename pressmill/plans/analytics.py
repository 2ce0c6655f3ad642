"""Acceptance reports from documents, digests and candidate metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pressmill.config import TitleRules
from pressmill.operators import analytics as an


def records(entries: DataFrame | None, digest_items: DataFrame, candidate_rows: DataFrame, rules: TitleRules) -> DataFrame:
    """Analytics records: of the document if it has entries, else of the digests alone."""
    digests = an.digest_metadata(digest_items)
    if entries is None or entries.isEmpty():
        return an.sorted_records(an.digest_records(digests, rules))
    return an.sorted_records(an.analytics_records(entries, digests, an.candidate_metadata(candidate_rows), rules))


def reports(rows: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """All report tables of one period."""
    chosen = an.between_dates(rows, start, end)
    daily = an.daily_counts(chosen)
    by_type, by_source = an.distribution(chosen, "type"), an.distribution(chosen, "source")
    return {
        "detail": an.detail_table(chosen),
        "summary": an.summary_metrics(chosen),
        "daily": daily,
        "type": an.share_of_total(by_type),
        "soft_hard": an.share_of_total(an.distribution(chosen, "soft_hard")),
        "source": by_source,
        "keywords": an.keyword_counts(chosen, 30),
        "dashboard": an.dashboard_counts(chosen),
        "best_day": an.best_day(daily),
        "best_source": an.best_value(by_source, "source"),
        "main_type": an.main_value(by_type, "type"),
    }
