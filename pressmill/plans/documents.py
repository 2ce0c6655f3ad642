"""History ingestion and acceptance of digest documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.config import ScoreSettings
from pressmill.functions import keywords as kw
from pressmill.functions.scoring import suggested_soft_hard, suggested_type
from pressmill.functions.urls import url_host
from pressmill.operators import analytics as an
from pressmill.operators import documents as dc
from pressmill.sources.readers import accepted_references


def history_references(paragraphs: DataFrame, settings: ScoreSettings) -> DataFrame:
    """Historical items with matched terms and suggested classes."""
    items = dc.history_items(paragraphs).withColumn("_all", F.concat_ws(" ", "title_cn", "summary_cn"))
    rows = items.withColumn("_m", kw.match_keywords(F.lower("_all"), settings.keywords))
    return rows.select(
        F.col("doc_id").alias("source_file"), "paragraph_index", "date_block", "title_cn", "summary_cn", "url",
        url_host("url").alias("source_domain"), kw.matched_terms("_m").alias("keywords_candidate"),
        suggested_type("_m", F.lower(F.col("_all")), settings.terms).alias("type_candidate"),
        suggested_soft_hard("_m", F.col("_all"), settings.terms).alias("soft_hard_candidate"),
    )


def ingest_reference(paragraphs: DataFrame, sheet: DataFrame | None, settings: ScoreSettings, sheet_name: str = "accepted") -> DataFrame:
    """Document items, then sheet rows, each URL or title once."""
    rows = history_references(paragraphs, settings).withColumn("seq", F.struct(
        F.lit(0).alias("part"), F.col("source_file").alias("file"), F.col("paragraph_index").cast("bigint").alias("row")
    )).drop("paragraph_index")
    if sheet is not None:
        listed = accepted_references(sheet, sheet_name).withColumn(
            "keywords_candidate",
            F.filter(F.transform(F.split("keywords_candidate", "[,;；、]"), lambda p: F.trim(p)), lambda w: w != ""),
        ).withColumn("seq", F.struct(F.lit(1).alias("part"), F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))
        rows = rows.unionByName(listed, allowMissingColumns=True)
    return an.distinct_references(rows).drop("seq")


def acceptance(paragraphs: DataFrame) -> DataFrame:
    return dc.sorted_entries(dc.acceptance_entries(paragraphs))


def apply_acceptance(entries: DataFrame, accepted: DataFrame) -> DataFrame:
    return dc.sorted_entries(dc.apply_acceptance(entries, accepted))
