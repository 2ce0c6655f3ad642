"""From reviewed candidates to daily digests, cumulative digest and document text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.config import Profile
from pressmill.operators import analytics as an
from pressmill.operators import digests as dg
from pressmill.operators.documents import render_blocks
from pressmill.operators.keyed import positions
from pressmill.operators.review import reviewed_over_stored
from pressmill.plans.collect import enrich_selected
from pressmill.sources.readers import reviewed_candidates


def digests(
    reviewed: DataFrame, stored: DataFrame, pages: DataFrame, fn, profile: Profile = Profile(), *,
    seq: str = "seq", batch_size: int = 20, partitions: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted digests, the quality report and the full-text report of a reviewed table."""
    chosen = reviewed_over_stored(reviewed_candidates(reviewed), stored)
    usable, text_report = enrich_selected(chosen, pages)
    made = dg.generate(usable, fn, profile, batch_size=batch_size, partitions=partitions)
    good = positions(dg.accepted_digests(made), ["run_date"] if "run_date" in made.columns else [], [], seq, "order_index")
    return good, dg.quality_report(made), text_report


def merge_cumulative(cumulative: DataFrame, day_items: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Cumulative items with one day replaced, and the document text of all blocks."""
    merged = an.merge_day(cumulative, day_items, day)
    numbered = positions(merged, ["date", "block_seq"], [], "pos", "order_index")
    return merged, render_blocks(numbered, block="block_seq").orderBy("date", "block_seq", "order_index", "part")
