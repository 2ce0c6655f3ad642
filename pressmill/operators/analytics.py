"""Acceptance statistics: counts, distributions, keywords, targets, metadata joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill import fixed_values as fv
from pressmill.config import TitleRules
from pressmill.functions.dates import period_end, period_start, safe_iso_text, weekdays_between
from pressmill.functions.scoring import (
    keywords_from_title, metadata_quality, soft_hard_from_title, type_from_title,
)
from pressmill.functions.text import (
    clean, col, first_known, first_text, is_missing, keywords_from_array, keywords_from_text,
    or_unclassified, text_array,
)
from pressmill.functions.urls import canonical_key, source_from_url
from pressmill.operators.keyed import first_per_key

def _accepted() -> Column:
    return F.sum(F.col("accepted").cast("int")).cast("bigint")


def _items() -> Column:
    return F.count(F.lit(1))


def _rate(accepted: Column, items: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(accepted, items) * 100, 1), F.lit(0.0))


def daily_counts(records: DataFrame, date: str = "date") -> DataFrame:
    return records.groupBy(date).agg(_items().alias("items"), _accepted().alias("accepted_items")).orderBy(date)


def distribution(records: DataFrame, column: str) -> DataFrame:
    """Items, accepted items and rate per value; an unknown column gives an empty table."""
    if column not in records.columns:
        return records.sparkSession.createDataFrame(
            [], f"`{column}` string, items bigint, accepted_items bigint, acceptance_rate double"
        )
    counts = records.groupBy(column).agg(_items().alias("items"), _accepted().alias("accepted_items"))
    return counts.withColumn("acceptance_rate", _rate(F.col("accepted_items"), F.col("items"))).orderBy(
        F.desc("items"), F.desc("accepted_items"), column
    )


def summary_metrics(records: DataFrame) -> DataFrame:
    totals = records.agg(_items().alias("total"), F.coalesce(_accepted(), F.lit(0)).alias("accepted"))
    return totals.select(
        "total", "accepted", _rate(F.col("accepted"), F.col("total")).alias("acceptance_rate"),
        (F.col("total") - F.col("accepted")).alias("unaccepted"),
    )


def keyword_counts(records: DataFrame, limit: int = 10, keywords: str = "keywords") -> DataFrame:
    words = records.select(F.explode(keywords).alias("word"), "accepted").select(clean("word").alias("keyword"), "accepted")
    words = words.where(F.col("keyword") != "")
    return words.groupBy("keyword").agg(_items().alias("occurrences"), _accepted().alias("accepted_occurrences")).orderBy(
        F.desc("occurrences"), "keyword"
    ).limit(limit)


def between_dates(records: DataFrame, start: str | dt.date, end: str | dt.date, date: str = "date") -> DataFrame:
    """Closed range with swapped ends put right; undated rows go; bad bounds keep all."""
    low, high = _as_date(start), _as_date(end)
    if low is None or high is None:
        return records
    return records.where(F.col(date).between(F.lit(min(low, high)), F.lit(max(low, high))))


def _as_date(value: str | dt.date | None) -> dt.date | None:
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value or "", "%Y-%m-%d").date()
    except ValueError:
        return None


def period_range(anchors: DataFrame, anchor: str, period: str) -> DataFrame:
    return anchors.withColumn("start_date", period_start(F.col(anchor), period)).withColumn(
        "end_date", period_end(F.col(anchor), period)
    )


def target_metrics(ranges: DataFrame, start: str = "start_date", end: str = "end_date", anchor: str | None = None) -> DataFrame:
    """Reporting days and targets of each range, up to the anchor if it lies inside."""
    low, high = F.least(start, end), F.greatest(start, end)
    last = high
    if anchor is not None:
        last = F.when(F.col(anchor).between(low, high), F.col(anchor)).otherwise(high)
    days = F.coalesce(weekdays_between(low, last), F.lit(0))
    return ranges.select(
        *[c for c in ranges.columns if c not in (start, end)],
        F.coalesce(low, F.col(start)).alias(start), F.coalesce(last, F.col(end)).alias(end),
        days.alias("reporting_days"),
        (days * fv.TARGET_ITEMS_PER_DAY).alias("target_items"),
        (days * fv.TARGET_ACCEPTED_PER_DAY).alias("target_accepted"),
        F.lit(fv.TARGET_RATE).alias("target_rate"),
    )


def count_delta(current: Column | str, previous: Column | str) -> Column:
    d = col(current).cast("bigint") - col(previous).cast("bigint")
    sign = F.when(d > 0, "+").otherwise("")
    return F.when(d == 0, fv.DELTA_EQUAL).otherwise(F.concat(sign, d.cast("string"), F.lit(fv.DELTA_COUNT_SUFFIX)))


def rate_delta(current: Column | str, previous: Column | str) -> Column:
    d = F.bround(col(current) - col(previous), 1)
    sign = F.when(d > 0, "+").otherwise("")
    return F.when(d == 0, fv.DELTA_EQUAL).otherwise(F.concat(sign, d.cast("string"), F.lit("%")))


def share_of_total(counts: DataFrame, items: str = "items") -> DataFrame:
    """Percentage of the total per row; the total is a scalar subquery, not a window."""
    total = counts.agg(F.sum(items)).scalar()
    return counts.withColumn("share", F.coalesce(F.bround(F.try_divide(F.col(items), total) * 100, 1), F.lit(0.0)))


def dashboard_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(F.col("type") == fv.UNCLASSIFIED).alias("unclassified"),
        F.count_if(F.contains(F.col("data_source"), F.lit("rules"))).alias("rule_inferred"),
    )


def best_day(daily: DataFrame, date: str = "date") -> DataFrame:
    return _top_one(daily, [F.desc("accepted_items"), F.desc("items"), F.desc(date)], date)


def best_value(dist: DataFrame, column: str) -> DataFrame:
    return _top_one(dist, [F.desc("accepted_items"), F.desc("acceptance_rate"), F.desc("items"), F.asc(column)], column)


def main_value(dist: DataFrame, column: str) -> DataFrame:
    top = dist.orderBy(F.desc("items"), F.desc("accepted_items"), F.asc(column)).limit(1)
    return top.select(F.col(column).cast("string").alias("best"), "items", "accepted_items")


def _top_one(counts: DataFrame, order: Sequence[Column], column: str) -> DataFrame:
    """Top row by acceptance; says so when nothing was accepted at all."""
    top = counts.orderBy(*order).limit(1)
    label = F.when(F.col("accepted_items") == 0, fv.NO_ACCEPTED).otherwise(F.col(column).cast("string"))
    return top.select(label.alias("best"), "items", "accepted_items")


# ---------------------------------------------------------------------------
# records of reported items


def record_key(date: Column | str, title: Column | str, url: Column | str) -> Column:
    """``url::...``, else ``title::date::title``, else NULL."""
    by_url = F.concat(F.lit("url::"), canonical_key(url))
    day = F.nullif(col(date).cast("string"), F.lit(""))
    heading = F.nullif(F.lower(clean(title)), F.lit(""))
    return F.coalesce(by_url, F.concat(F.lit("title::"), day, F.lit("::"), heading))


def normalized_keywords(df: DataFrame, column: str) -> Column:
    """Keyword arrays are tidied, keyword text is split; by the column's type."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return keywords_from_array(column)
    return keywords_from_text(column)


def digest_metadata(items: DataFrame, *, seq: str = "seq") -> DataFrame:
    """Digest rows by record key, the last block winning.

    ``items``: ``seq, pos, date, order_index, title_cn, title_original, url, source, type,
    soft_hard, keywords``; ``seq`` orders blocks, ``pos`` counts from 1 inside a block.
    """
    title = clean(first_text("title_cn", "title_original"))
    rows = items.withColumn("date", safe_iso_text("date")).where(F.col("date") != "")
    rows = rows.withColumn("title", title).withColumn(
        "order_index", F.coalesce(F.nullif(F.col("order_index").try_cast("int"), F.lit(0)), F.col("pos"))
    )
    rows = rows.withColumn("keywords", normalized_keywords(items, "keywords")).withColumn(
        "record_key", record_key("date", "title", "url")
    )
    keep = ["record_key", "date", "order_index", "title", "url", "source", "type", "soft_hard", "keywords", seq, "pos"]
    rows = rows.where(F.col("record_key").isNotNull()).select(*keep)
    return first_per_key(rows, ["record_key"], [-F.col(seq), -F.col("pos")]).drop(seq, "pos")


def candidate_metadata(rows: DataFrame, *, seq: str = "seq") -> DataFrame:
    """Candidate rows by record key: the fullest row wins, the first one on ties.

    Each row is found under the keys of its translated and original titles and of its URL.
    """
    title = clean(first_text("title_cn", "title_translated_candidate", "title_original"))
    tidy = rows.select(
        F.col(seq).alias("seq"), safe_iso_text("run_date").alias("date"), title.alias("title"),
        clean("title_original").alias("title_original"), clean("url").alias("url"), clean("source").alias("source"),
        clean(first_text("type", "suggested_type")).alias("type"),
        clean(first_text("soft_hard", "suggested_soft_hard")).alias("soft_hard"),
        first_text("keywords", "matched_keywords").alias("keyword_text"),
    ).where((F.col("url") != "") | (F.col("title") != ""))
    keys = F.array_distinct(F.array_compact(F.array(
        record_key("date", "title", "url"), record_key("date", "title_original", "url"),
        record_key(F.lit(""), F.lit(""), "url"),
    )))
    quality = metadata_quality("source", "type", "soft_hard", "keyword_text", "url")
    spread = tidy.withColumn("quality", quality).withColumn("record_key", F.explode(keys))
    best = first_per_key(spread, ["record_key"], [-F.col("quality"), F.col("seq")])
    return best.withColumn("keywords", keywords_from_text("keyword_text")).drop("seq", "keyword_text", "title_original")


def analytics_records(entries: DataFrame, digests: DataFrame, candidates: DataFrame, rules: TitleRules) -> DataFrame:
    """Document entries completed from digest metadata, then candidate metadata, then title rules.

    ``entries``: ``date, order_index, title, url, accepted``; the other two come from
    :func:`digest_metadata` and :func:`candidate_metadata`.
    """
    fields = ("url", "source", "type", "soft_hard", "keywords")
    d = digests.select(F.col("record_key").alias("_dk"), *[F.col(c).alias(f"_d_{c}") for c in fields])
    c = candidates.select(F.col("record_key").alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in fields])
    e = entries.withColumn("record_key", record_key("date", "title", "url"))
    joined = e.join(d, F.col("record_key") == F.col("_dk"), "left").join(c, F.col("record_key") == F.col("_ck"), "left")

    has_d, has_c = F.col("_dk").isNotNull(), F.col("_ck").isNotNull()
    words = lambda p: F.coalesce(F.col(f"{p}_keywords"), text_array([]))
    merged = F.when(F.size(words("_d")) > 0, words("_d")).otherwise(words("_c"))
    meta = lambda c: first_known(f"_d_{c}", f"_c_{c}")
    kind = type_from_title(meta("type"), "title", "url", rules)
    origin = (
        F.when(has_d & has_c, "word+digest_json+candidate_metadata").when(has_d, "word+digest_json")
        .when(has_c, "word+candidate_metadata").otherwise("word+rules")
    )
    return joined.select(
        "date", "order_index", "title",
        first_text("url", meta("url")).alias("url"),
        F.coalesce(F.nullif(clean(meta("source")), F.lit("")), source_from_url("url", rules.source_markers)).alias("source"),
        kind.alias("type"),
        soft_hard_from_title(meta("soft_hard"), "title", "url", kind, rules).alias("soft_hard"),
        F.when(F.size(merged) > 0, merged).otherwise(keywords_from_title("title", rules)).alias("keywords"),
        "accepted",
        origin.alias("data_source"),
    )


def digest_records(digests: DataFrame, rules: TitleRules) -> DataFrame:
    """Records from digest metadata alone, for when there is no document; none accepted."""
    return digests.select(
        "date", "order_index", "title", "url",
        F.coalesce(F.nullif(clean("source"), F.lit("")), source_from_url("url", rules.source_markers)).alias("source"),
        or_unclassified("type").alias("type"), or_unclassified("soft_hard").alias("soft_hard"),
        "keywords", F.lit(False).alias("accepted"), F.lit("digest_json").alias("data_source"),
    )


def sorted_records(records: DataFrame) -> DataFrame:
    return records.orderBy("date", "order_index", "title")


def detail_table(records: DataFrame) -> DataFrame:
    """Records for display and export, newest day first."""
    return records.withColumn("keywords", F.array_join("keywords", "、")).withColumnRenamed(
        "keywords", "keywords_text"
    ).orderBy(F.desc("date"), F.asc("order_index"))


# ---------------------------------------------------------------------------
# reference statistics


def reference_statistics(samples: DataFrame, *, keywords: str = "keywords_candidate", domain: str = "source_domain", kind: str = "type_candidate", soft_hard: str = "soft_hard_candidate", top_keywords: int = 100, top_domains: int = 50) -> DataFrame:
    """Tall table ``metric, value, items``: all rows, top keywords, top domains, classes."""
    total = samples.agg(F.count(F.lit(1)).alias("items")).select(F.lit("reference_count").alias("metric"), F.lit("").alias("value"), "items")
    if isinstance(samples.schema[keywords].dataType, T.ArrayType):
        words = F.col(keywords)
    else:
        words = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), "[,;；、]"), lambda p: F.trim(p)), lambda w: w != "")

    def top(rows: DataFrame, metric: str, limit: int | None) -> DataFrame:
        counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("items"))
        if limit is not None:
            counts = counts.orderBy(F.desc("items"), "value").limit(limit)
        return counts.select(F.lit(metric).alias("metric"), "value", "items")

    given = lambda c: samples.select(F.col(c).alias("value")).where(F.coalesce("value", F.lit("")) != "")
    out = total.unionByName(top(samples.select(F.explode(words).alias("value")), "keyword", top_keywords))
    out = out.unionByName(top(given(domain), "domain", top_domains))
    return out.unionByName(top(given(kind), "type", None)).unionByName(top(given(soft_hard), "soft_hard", None))


def distinct_references(rows: DataFrame, *, seq: str = "seq", url: str = "url", title: str = "title_cn") -> DataFrame:
    """First row per URL, else per title, else per whole row."""
    body = [c for c in rows.columns if c != seq]
    key = F.coalesce(
        F.nullif(F.col(url), F.lit("")), F.nullif(F.col(title), F.lit("")), F.to_json(F.struct(*body))
    )
    return first_per_key(rows, [key], [seq])


# ---------------------------------------------------------------------------
# cumulative digest


def deduplicate_blocks(items: DataFrame, *, date: str = "date", block: str = "block_seq", pos: str = "pos", url: str = "url") -> DataFrame:
    """A URL stays in its earliest block; items without URL stay; emptied blocks vanish."""
    key = F.nullif(F.trim(F.coalesce(F.col(url), F.lit(""))), F.lit(""))
    place = F.struct(F.col(date), F.col(block), F.col(pos))
    return first_per_key(items.withColumn("_place", place), [key], ["_place"], keyless_id="_place").drop("_place")


def merge_day(cumulative: DataFrame, day_items: DataFrame, day: dt.date | str, *, date: str = "date") -> DataFrame:
    """Replace one day of the cumulative table, then keep each URL once."""
    if day_items.isEmpty():
        raise ValueError(f"no digest items for {day}")
    others = cumulative.where(~F.col(date).eqNullSafe(F.lit(day).cast("date")))
    fresh = day_items.withColumn(date, F.lit(day).cast("date")).withColumn("block_seq", F.lit(1 << 30))
    return deduplicate_blocks(others.unionByName(fresh, allowMissingColumns=True), date=date)


def cumulative_totals(items: DataFrame, date: str = "date") -> DataFrame:
    """Blocks and items; days are counted by a two-phase distinct."""
    per_day = items.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
