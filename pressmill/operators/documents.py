"""Digest documents as ordered paragraphs: segmentation, history, rendering, updates.

Input: ``doc_id, paragraph_index, text[, highlighted]`` with consecutive indices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions.text import clean, col, marker_id
from pressmill.operators.ordered import carry_forward, look_ahead, running_total

_ITEM = r"^\s*(\d+)[.．、]\s*(.+?)\s*$"
_NUMBERED = r"^\d+[.．、]"
_URL = r"https?://\S+"


def heading_digits(text: Column | str, prefix: str = fv.HEADING_PREFIX) -> Column:
    """Eight digits of a block heading, NULL for other paragraphs."""
    return F.nullif(F.regexp_extract(col(text), rf"^{prefix}\s*(\d{{8}}).*$", 1), F.lit(""))


def heading_date(text: Column | str, prefix: str = fv.HEADING_PREFIX) -> Column:
    """ISO date of a heading; digits that are no date stay as they are."""
    digits = heading_digits(text, prefix)
    return F.coalesce(F.try_to_date(digits, "yyyyMMdd").cast("string"), digits)


def item_index(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), _ITEM, 1), F.lit("")).try_cast("int")


def item_title(text: Column | str) -> Column:
    return clean(F.regexp_extract(col(text), _ITEM, 2))


def first_url(text: Column | str) -> Column:
    return F.regexp_extract(col(text), _URL, 0)


def with_block_dates(paragraphs: DataFrame, *, keys: Sequence[str] = ("doc_id",), index: str = "paragraph_index", prefix: str = fv.HEADING_PREFIX) -> DataFrame:
    """Tidy text and the date of the heading each paragraph stands under."""
    tidy = paragraphs.withColumn("text", clean("text"))
    return carry_forward(tidy, list(keys), index, heading_date("text", prefix), "block_date")


def with_following_url(paragraphs: DataFrame, *, keys: Sequence[str] = ("doc_id",), index: str = "paragraph_index", reach: int = 4, prefix: str = fv.HEADING_PREFIX) -> DataFrame:
    """First URL in the next paragraphs, not looking past the next heading or item."""
    stop = heading_digits("text", prefix).isNotNull() | item_index("text").isNotNull()
    step = F.struct(stop.alias("stop"), F.when(stop, F.lit("")).otherwise(first_url("text")).alias("url"))
    ahead = look_ahead(paragraphs, list(keys), index, step, reach, "_ahead")
    decided = F.get(F.filter("_ahead", lambda s: s["stop"] | (s["url"] != "")), F.lit(0))
    return ahead.withColumn("following_url", F.coalesce(decided["url"], F.lit(""))).drop("_ahead")


def acceptance_entries(paragraphs: DataFrame, *, keys: Sequence[str] = ("doc_id",), index: str = "paragraph_index", prefix: str = fv.HEADING_PREFIX) -> DataFrame:
    """One row per numbered item under a dated heading."""
    dated = with_block_dates(paragraphs, keys=keys, index=index, prefix=prefix)
    linked = with_following_url(dated, keys=keys, index=index, prefix=prefix)
    items = linked.where(
        heading_digits("text", prefix).isNull() & F.col("block_date").isNotNull() & item_index("text").isNotNull()
    )
    rows = items.select(
        *keys, F.col("block_date").alias("date"), item_index("text").alias("order_index"),
        item_title("text").alias("title"), F.col("following_url").alias("url"),
        F.coalesce("highlighted", F.lit(False)).alias("accepted"), F.col(index).alias("paragraph_index"),
    ).where(F.col("title") != "")
    return rows.withColumn("marker_id", marker_id(F.col("date"), F.col("order_index"), F.col("title"), F.col("url")))


def sorted_entries(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("date"), F.asc("order_index"), F.desc("title"))


def apply_acceptance(entries: DataFrame, accepted: DataFrame, marker: str = "marker_id") -> DataFrame:
    """Flag every entry by membership in the accepted ids; blank ids are ignored."""
    chosen = accepted.select(F.col(marker).alias("_m")).where(F.coalesce("_m", F.lit("")) != "").distinct()
    return entries.join(chosen, F.col(marker) == F.col("_m"), "left").withColumn(
        "accepted", F.col("_m").isNotNull()
    ).drop("_m")


def split_title(text: Column | str) -> Column:
    """``struct<title, summary>`` of a numbered paragraph that may hold its summary too."""
    body = F.regexp_replace(F.trim(col(text)), r"^\s*\d+[.．、]\s*", "")
    lines = F.filter(F.transform(F.split(body, r"[\r\n]+"), clean), lambda p: p != "")
    compact = clean(body)
    end = F.regexp_instr(compact, F.lit(r"[。；;]\s*"))
    head = F.regexp_extract(compact, r"^[^。；;]*[。；;]", 0)
    tail = F.trim(F.regexp_replace(compact, r"^[^。；;]*[。；;]\s*", ""))
    sentence = (end > 0) & (end <= 81)
    return (
        F.when(
            F.size(lines) >= 2,
            F.struct(F.get(lines, F.lit(0)).alias("title"),
                     F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), " ").alias("summary")),
        )
        .when(sentence, F.struct(head.alias("title"), tail.alias("summary")))
        .otherwise(F.struct(compact.alias("title"), F.lit("").alias("summary")))
    )


def history_items(paragraphs: DataFrame, *, keys: Sequence[str] = ("doc_id",), index: str = "paragraph_index", prefix: str = fv.HEADING_PREFIX) -> DataFrame:
    """Items of a historical document: ``date_block, title_cn, summary_cn, url``.

    A numbered paragraph opens an item; the next URL, number or heading closes it.  The
    text before a closing URL on its line still belongs to the item.
    """
    keys = list(keys)
    raw = paragraphs.withColumn("raw", F.trim("text")).withColumn("text", clean("text")).where(F.col("text") != "")
    digits = F.nullif(F.regexp_extract("text", rf"{prefix}(\d{{8}})", 1), F.lit(""))
    url = first_url("text")
    kind = F.when(digits.isNotNull(), "heading").when(url != "", "url").when(
        F.col("text").rlike(_NUMBERED), "item"
    ).otherwise("text")
    rows = raw.withColumn("kind", kind).withColumn("digits", digits)
    rows = carry_forward(rows, keys, index, F.col("digits"), "date_block")
    rows = running_total(rows, keys, index, (F.col("kind") != "text").cast("bigint"), "_edges")
    rows = rows.withColumn("_item", F.col("_edges") - (F.col("kind") == "url").cast("bigint"))
    opened = rows.where(F.col("kind") == "item").select(*keys, "_item")
    members = rows.join(opened, [*keys, "_item"], "left_semi")
    pieces = split_title("raw")
    piece = (
        F.when(F.col("kind") == "item", pieces["summary"])
        .when(F.col("kind") == "url", clean(F.regexp_extract("text", r"^(.*?)https?://", 1)))
        .otherwise(F.col("text"))
    )
    is_item = F.col("kind") == "item"
    members = members.withColumn("_piece", piece).withColumn("_title", F.when(is_item, pieces["title"]))
    grouped = members.groupBy(*keys, "_item").agg(
        F.max(F.when(is_item, F.col("date_block"))).alias("date_block"),
        F.max("_title").alias("title_cn"),
        F.sort_array(F.collect_list(F.when(F.col("_piece") != "", F.struct(F.col(index), F.col("_piece"))))).alias("_parts"),
        F.max(F.when(F.col("kind") == "url", F.regexp_replace(url, r"[。)）]+$", ""))).alias("url"),
        F.min(F.when(is_item, F.col(index))).alias("paragraph_index"),
    )
    return grouped.where(F.col("title_cn") != "").select(
        *keys, "paragraph_index", F.coalesce("date_block", F.lit("")).alias("date_block"), "title_cn",
        clean(F.array_join(F.col("_parts")["_piece"], " ")).alias("summary_cn"),
        F.coalesce("url", F.lit("")).alias("url"),
    )


def block_title(date: Column | str, template: str = fv.DIGEST_TITLE_TEMPLATE) -> Column:
    before, _, after = template.partition("{date}")
    return F.concat(F.lit(before), F.date_format(col(date).cast("date"), "yyyyMMdd"), F.lit(after))


def render_blocks(items: DataFrame, *, date: str = "date", block: str | None = None, index: str = "order_index", template: str = fv.DIGEST_TITLE_TEMPLATE, blank_lines: int = 2) -> DataFrame:
    """Digest text as paragraphs ``date, [block,] order_index, part, text``.

    Sorted by those columns it reads: block title, then number and title, summary and URL
    of each item; blank lines (order 0, parts below 0) stand between blocks. A day is one
    block, or several told apart by the ``block`` column.
    """
    keys = [date] if block is None else [date, block]
    lines = F.array(
        F.concat(F.col(index).cast("string"), F.lit("."), F.coalesce("title_cn", F.lit(""))),
        F.coalesce("summary_cn", F.lit("")), F.trim(F.coalesce("url", F.lit(""))),
    )
    body = items.select(*keys, F.col(index).cast("bigint").alias("order_index"), F.posexplode(lines).alias("part", "text"))
    blocks = items.select(*keys).distinct()
    first = items.agg(F.min(F.struct(*keys))).scalar()
    head = blocks.select(*keys, F.lit(0).cast("bigint").alias("order_index"), F.lit(0).alias("part"), block_title(date, template).alias("text"))
    gaps = blocks.where(F.struct(*keys) > first).select(
        *keys, F.lit(0).cast("bigint").alias("order_index"),
        F.explode(F.sequence(F.lit(-blank_lines), F.lit(-1))).alias("part"), F.lit("").alias("text"),
    )
    return gaps.unionByName(head).unionByName(body)


def replace_block(document: DataFrame, rendered: DataFrame, day: str, *, index: str = "paragraph_index", prefix: str = fv.HEADING_PREFIX, replace_existing: bool = True) -> DataFrame:
    """Put a day's block into an ordered document: in the place of the old one, else at the end.

    ``rendered``: ``doc_id, line_no, text``.  Output is ordered by ``place, line_no``.
    """
    digits = day.replace("-", "")
    marked = carry_forward(document, ["doc_id"], index, heading_digits(F.trim("text"), prefix), "_digits")
    marked = marked.withColumn("_head", heading_digits(F.trim("text"), prefix).isNotNull().cast("bigint"))
    marked = running_total(marked, ["doc_id"], index, F.col("_head"), "_block_no")
    firsts = marked.where((F.col("_digits") == digits) & (F.col("_head") == 1)).groupBy("doc_id").agg(
        F.min("_block_no").alias("_target"), F.min(index).alias("_start")
    )
    ends = document.groupBy("doc_id").agg((F.max(index) + 1).alias("_end"), F.max(F.trim("text") != "").alias("_filled"))
    plan = ends.join(firsts, "doc_id", "left")
    if not replace_existing:
        plan = plan.withColumn("_target", F.lit(None).cast("bigint")).withColumn("_start", F.lit(None).cast("bigint"))
    kept = marked.join(plan.select("doc_id", "_target"), "doc_id", "left").where(
        F.col("_target").isNull() | (F.col("_block_no") != F.col("_target"))
    ).select("doc_id", F.col(index).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("line_no"), "text")
    # a new block at the end of a filled document starts with a blank line
    lead = plan.where(F.col("_start").isNull() & F.col("_filled")).select(
        "doc_id", F.col("_end").cast("bigint").alias("place"), F.lit(-1).cast("bigint").alias("line_no"), F.lit("").alias("text")
    )
    fresh = rendered.join(plan, "doc_id")
    fresh = fresh.select(
        "doc_id", F.coalesce("_start", "_end").cast("bigint").alias("place"), F.col("line_no").cast("bigint").alias("line_no"), "text"
    )
    return kept.unionByName(lead).unionByName(fresh)
