"""Candidate pools and the review table: gates, caps, interleaving, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import Profile, TermLists
from pressmill.functions.dates import status_keeps, text_window_status, window_multiplier
from pressmill.functions.scoring import excluded_topic
from pressmill.functions.text import (
    append_warning, candidate_id, clean, col, first_text, is_selected,
)
from pressmill.functions.urls import canonical_key, is_feed_url
from pressmill.operators.keyed import first_per_key, positions, top_per_key, without_known
from pressmill.operators.lineage import cut_lineage

MIN_TEXT = 250


def with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]], *, ignore_case: bool = True) -> DataFrame:
    """One column per field: the first non-blank of its alias headers, tidied.

    Exact names come first; names that differ only in case are tried after them.
    """
    folded = {c.lower(): c for c in df.columns}
    out = []
    for field, names in aliases.items():
        chosen = [n for n in names if n in df.columns]
        if ignore_case:
            chosen += [folded[n.lower()] for n in names if n.lower() in folded and folded[n.lower()] not in chosen]
        tidy = [F.nullif(clean(F.col(f"`{c}`").cast("string")), F.lit("")) for c in chosen]
        out.append(F.coalesce(*tidy, F.lit("")).alias(field))
    return df.select(*out)


def body_text() -> Column:
    return F.trim(first_text("raw_text", "raw_text_preview"))


def without_excluded(df: DataFrame, terms: TermLists) -> DataFrame:
    return df.where(~excluded_topic(clean("title_original"), clean(first_text("raw_text", "raw_text_preview")), terms))


def candidate_gate(df: DataFrame, run_date: Column | str, profile: Profile, terms: TermLists) -> DataFrame:
    """In the window, not a feed, long enough, not an excluded topic; status goes to the warnings."""
    day = col(run_date)
    checked = df.where(~is_feed_url("url") & (F.length(body_text()) >= MIN_TEXT)).withColumn(
        "_status", text_window_status("published_date", day, profile)
    )
    kept = checked.where(status_keeps(F.col("_status")))
    kept = kept.withColumn("extraction_warning", append_warning("extraction_warning", F.col("_status")))
    return without_excluded(kept.drop("_status"), terms)


def without_reported(df: DataFrame, reported: DataFrame, run_date: Column | None, *, seq: str = "seq") -> DataFrame:
    """Drop rows whose canonical URL was in a digest dated before ``run_date``.

    Digests without a usable date always count; rows without URL always stay.
    """
    before = reported
    if run_date is not None:
        before = reported.where(F.col("date").isNull() | (F.col("date") < run_date))
    return without_known(df, before, canonical_key("url"), canonical_key("url"), spread=seq)


def source_cap(df: DataFrame, run_date: Column | str, profile: Profile, *, source: str = "source", score: str = "score", limit: str = "max_articles_per_run", seq: str = "seq") -> DataFrame:
    """Best rows of each source: its largest positive limit times the window multiplier.

    A source without a limit keeps everything, so its rows are never ranked.
    """
    name = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown"))
    wanted = F.col(limit).cast("string").try_cast("double").cast("int")
    named = cut_lineage(df.withColumn("_source", name))  # read for the limits, for whole sources and for the rest
    limits = named.groupBy("_source").agg(
        F.max(F.when(wanted > 0, wanted)).alias("_base"), F.count(F.lit(1)).alias("_size")
    )
    k = F.greatest(F.lit(1), F.least(F.col("_size"), F.col("_base") * window_multiplier(col(run_date), profile)))
    joined = named.join(limits, "_source").withColumn("_k", k)
    whole = F.col("_base").isNull() | (F.col("_k") >= F.col("_size"))
    ranked = top_per_key(
        joined.where(~whole), ["_source"], [F.desc(score), F.asc(seq)], F.col("_k"), seq=seq
    )
    return joined.where(whole).unionByName(ranked).drop("_source", "_base", "_size", "_k")


def best_per_url_or_title(df: DataFrame, *, seq: str = "seq", score: str = "score") -> DataFrame:
    url, title = F.trim(F.coalesce("url", F.lit(""))), F.trim(F.coalesce("title_original", F.lit("")))
    key = F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("title::"), title))
    return first_per_key(df, [key], [-F.coalesce(F.col(score), F.lit(0.0)), F.col(seq)], position=seq)


def review_bucket(source: Column | str, country: Column | str, first_source: str, regions: Sequence[tuple[str, str]]) -> Column:
    """Named source first, then buckets by region, then the rest."""
    name, region = F.lower(F.coalesce(col(source), F.lit(""))), F.lower(F.coalesce(col(country), F.lit("")))
    out = F.when(F.contains(name, F.lit(first_source.lower())), first_source)
    for region_name, bucket in regions:
        out = out.when(region == region_name.lower(), bucket)
    return out.otherwise("other")


def weighted_interleave(df: DataFrame, bucket: str, quotas: Sequence[tuple[str, int]], *, score: str = "score", seq: str = "seq") -> DataFrame:
    """Merge buckets in cycles: ``quotas`` gives how many of each bucket a cycle takes.

    A row's place follows from its position in its bucket, so the merge is one sort.
    """
    ranked = positions(df, [bucket], [(score, True)], seq, "_rn")
    quota, offset, start = F.lit(1), F.lit(0), 0
    for name, size in quotas:
        quota = F.when(F.col(bucket) == name, size).otherwise(quota)
        offset = F.when(F.col(bucket) == name, start).otherwise(offset)
        start += size
    placed = ranked.withColumn("cycle", F.floor((F.col("_rn") - 1) / quota)).withColumn(
        "slot", offset + (F.col("_rn") - 1) % quota
    )
    return placed.orderBy("cycle", "slot").drop("_rn")


def with_display_columns(df: DataFrame, columns: Sequence[str] = fv.CANDIDATE_COLUMNS) -> DataFrame:
    """Add missing columns as blanks, derive the id when absent, parse the selected flag."""
    out = df
    for c in columns:
        if c not in df.columns and c != "candidate_id":
            out = out.withColumn(c, F.lit(""))
    if "candidate_id" not in df.columns:
        out = out.withColumn("candidate_id", candidate_id("url", "title_original"))
    return out.withColumn("selected", is_selected("selected"))


def review_filter(df: DataFrame, *, search: str = "", source: str = fv.ALL_SOURCES, min_score: float = 0.0, selected_only: bool = False, warning_only: bool = False, literal: bool = False) -> DataFrame:
    """All given conditions; the search text is a case-insensitive pattern over both titles."""
    out, query = df, search.strip()
    if query:
        def found(name: str) -> Column:
            text = F.coalesce(F.col(name), F.lit(""))
            if literal:
                return F.contains(F.lower(text), F.lit(query.lower()))
            return text.rlike(f"(?i){query}")

        tests = [found(c) for c in ("title_original", "title_translated_candidate") if c in df.columns]
        condition = F.lit(False)
        for test in tests:
            condition = condition | test
        out = out.where(condition)
    if source and source != fv.ALL_SOURCES and "source" in df.columns:
        out = out.where(F.col("source") == source)
    if min_score > 0 and "score" in df.columns:
        out = out.where(F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0)) >= min_score)
    if selected_only and "selected" in df.columns:
        out = out.where(is_selected("selected"))
    if warning_only and "extraction_warning" in df.columns:
        out = out.where(F.trim(F.coalesce("extraction_warning", F.lit(""))) != "")
    return out


def apply_edits(df: DataFrame, edits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Set edited cells: matched by candidate id, by URL when the edit has no id.

    Of several edits of one cell the latest counts.  Edits of unknown rows or columns
    are ignored.
    """
    known = [c for c in columns if c in df.columns]
    cells = edits.where(F.col("column").isin(*known)) if known else edits.where(F.lit(False))
    has_id = F.coalesce(F.col("candidate_id"), F.lit("")) != ""
    latest = [
        F.max(F.when(F.col("column") == c, F.struct("edit_seq", "value"))).alias(f"_{c}") for c in known
    ]
    by_id = cells.where(has_id).groupBy(F.col("candidate_id").alias("_id")).agg(*latest)
    by_url = cells.where(~has_id & (F.coalesce(F.col("url"), F.lit("")) != "")).groupBy(F.col("url").alias("_url")).agg(*latest)
    out = df.join(by_id, F.col("candidate_id") == F.col("_id"), "left")
    for c in known:
        out = out.withColumnRenamed(f"_{c}", f"_a_{c}")
    out = out.join(by_url, F.col("url") == F.col("_url"), "left")
    for c in known:
        edit = F.greatest(F.col(f"_a_{c}"), F.col(f"_{c}"))
        out = out.withColumn(c, F.when(edit.isNotNull(), edit["value"].cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out.select(*df.columns)


def restore_by_id(df: DataFrame, stored: DataFrame, column: str, *, key: str = "candidate_id") -> DataFrame:
    """Fill a blank ``column`` from another table by id."""
    values = stored.select(F.col(key).alias("_id"), F.col(column).alias("_stored"))
    values = first_per_key(values, ["_id"], [F.when(F.coalesce("_stored", F.lit("")) == "", 1).otherwise(0), "_stored"])
    current = F.col(column) if column in df.columns else F.lit("")
    return (
        df.join(values, F.col(key) == F.col("_id"), "left")
        .withColumn(column, first_text(current, "_stored")).drop("_id", "_stored")
    )


def prepare_reviewed(df: DataFrame, full_text: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Review table as saved: yes/blank flag, default columns, full text restored by id."""
    out = df.withColumn("selected", F.when(is_selected("selected"), "yes").otherwise(""))
    for c in ("title_original", "url", "source", "published_date"):
        if c not in df.columns:
            out = out.withColumn(c, F.lit(""))
    if "candidate_id" not in df.columns:
        out = out.withColumn("candidate_id", candidate_id("url", "title_original"))
    out = restore_by_id(out, full_text, "raw_text")
    for c, value in defaults.items():
        if c not in df.columns:
            out = out.withColumn(c, F.lit(value))
    return out


def reviewed_over_stored(reviewed: DataFrame, stored: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Reviewed rows completed with stored columns they lack; reviewed values win, blanks too."""
    extra = [c for c in stored.columns if c != key and c not in reviewed.columns]
    return reviewed.join(stored.select(key, *extra), key, "left")


def union_pools(pools: dict[str, DataFrame]) -> DataFrame:
    """Union of pools with different columns; file name and order recorded."""
    whole = None
    for i, (name, pool) in enumerate(pools.items()):
        tagged = pool.withColumn("candidate_file", F.lit(name)).withColumn("pool_no", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    texts = [f.name for f in whole.schema if f.dataType.simpleString() == "string"]
    return whole.fillna("", subset=texts)


def source_summary(df: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(fv.UNKNOWN_SOURCE))
    warned = F.trim(F.coalesce("extraction_warning", F.lit(""))) != ""
    return df.groupBy(name.alias("source")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(warned).alias("warnings")
    ).orderBy(F.desc("items"), "source")


def pool_summary(df: DataFrame, *, seq: str = "seq") -> DataFrame:
    warning = F.trim(F.coalesce("extraction_warning", F.lit("")))
    return df.agg(
        F.count_if(F.trim(F.coalesce("title_original", F.lit(""))) != "").alias("titled"),
        F.coalesce(F.min_by(warning, F.when(warning != "", F.col(seq))), F.lit("")).alias("first_warning"),
    )


def selected_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(is_selected("selected")).alias("selected"))
