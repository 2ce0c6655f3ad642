"""Candidate pools: from articles, from other pools, and the review of a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import ScoreSettings
from pressmill.operators import review as rv
from pressmill.operators.digests import translate_titles
from pressmill.operators.scored import rescore_pool, score_articles
from pressmill.operators.similar import near_duplicates


def score_all(articles: DataFrame, settings: ScoreSettings, samples: DataFrame | None = None) -> DataFrame:
    """Scored and de-duplicated articles, without window test or caps."""
    return near_duplicates(score_articles(articles, settings, samples))


def candidates(
    articles: DataFrame, settings: ScoreSettings, samples: DataFrame | None = None, reported: DataFrame | None = None,
    translate=None,
) -> DataFrame:
    """Candidate pool of every ``run_date`` in the articles, best first.

    Cheap filters run before the score, so nothing rejected reaches the similarity step.
    """
    rows = rv.candidate_gate(articles, "run_date", settings.profile, settings.terms)
    if reported is not None:
        rows = rv.without_reported(rows, reported, F.col("run_date")) if _single_day(reported) else _reported_by_day(rows, reported)
    pool = near_duplicates(score_articles(rows, settings, samples))
    pool = _cap_by_day(pool, settings)
    if translate is not None:
        pool = translate_titles(pool, translate)
    return pool.orderBy("run_date", F.desc("score"), "seq")


def _single_day(reported: DataFrame) -> bool:
    return "date" not in reported.columns


def _reported_by_day(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """Left anti join on the canonical URL with ``date < run_date``, for many run dates at once.

    Only the earliest report of a URL matters, so the right side holds one row per URL.
    """
    from pressmill.functions.urls import canonical_key
    from pressmill.operators.keyed import _spread_key

    undated = F.to_date(F.lit("0001-01-01"))
    first = (
        reported.select(canonical_key("url").alias("_known"), F.coalesce(F.col("date"), undated).alias("_since"))
        .where(F.col("_known").isNotNull()).groupBy("_known").agg(F.min("_since").alias("_since"))
    )
    keyed = rows.withColumn("_key", _spread_key(canonical_key("url"), "seq"))
    hit = (F.col("_key") == F.col("_known")) & (F.col("_since") < F.col("run_date"))
    return keyed.join(first, hit, "left_anti").drop("_key")


def _cap_by_day(pool: DataFrame, settings: ScoreSettings) -> DataFrame:
    """Per-source cap within each run date."""
    if "max_articles_per_run" not in pool.columns:
        return pool
    tagged = pool.withColumn("_day_source", F.concat_ws("\u0000", F.col("run_date").cast("string"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))))
    return rv.source_cap(tagged, "run_date", settings.profile, source="_day_source").drop("_day_source")


def combine_pools(
    pools: dict[str, DataFrame], run_date: str, settings: ScoreSettings, samples: DataFrame | None = None,
    reported: DataFrame | None = None, translate=None, *, first_source: str = "", regions: Sequence[tuple[str, str]] = (),
    quotas: Sequence[tuple[str, int]] = (),
) -> DataFrame:
    """Pools united, gated, rescored, de-duplicated and interleaved for review."""
    day = F.lit(run_date).cast("date")
    whole = rv.with_display_columns(rv.union_pools(pools))
    # a row's place: its pool first, then its own order
    whole = whole.withColumn("seq", F.col("pool_no").cast("bigint") * (1 << 60) + F.col("seq"))
    if reported is not None:
        whole = rv.without_reported(whole, reported, day)
    whole = rv.candidate_gate(whole, day, settings.profile, settings.terms)
    whole = rv.best_per_url_or_title(rescore_pool(whole, settings, samples))
    if translate is not None:
        whole = translate_titles(whole, translate)
    bucket = rv.review_bucket("source", "country_region", first_source or "\u0000", regions)
    placed = rv.weighted_interleave(whole.withColumn("selected", F.lit(False)).withColumn("bucket", bucket), "bucket", quotas)
    front = [c for c in fv.CANDIDATE_COLUMNS if c in placed.columns]
    rest = [c for c in placed.columns if c not in front]
    return placed.select(*front, *rest)


def review(pool: DataFrame, edits: DataFrame, settings: ScoreSettings, full_text: DataFrame, *, editable: Sequence[str] = ("selected", "notes", "title_translated_candidate", "suggested_type", "suggested_soft_hard"), defaults: dict[str, object] | None = None, **filters) -> DataFrame:
    """Edited pool without excluded topics, filtered, with defaults filled for saving."""
    edited = rv.apply_edits(rv.with_display_columns(pool), edits, editable)
    shown = rv.review_filter(rv.without_excluded(edited, settings.terms), **filters)
    return rv.prepare_reviewed(shown, full_text, defaults or {})
