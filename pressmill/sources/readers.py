"""Readers: line JSON, digest JSON, imported sheets, feeds and partitioned tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.config import Source
from pressmill.functions.dates import feed_entry_date
from pressmill.functions.text import clean, col, first_text, is_selected
from pressmill.functions.urls import url_host
from pressmill.operators.keyed import FEW
from pressmill.operators.lineage import cut_lineage
from pressmill.operators.review import with_aliases
from pressmill.sources import schemas


def _missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line JSON with a declared schema; a path that does not exist reads as empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as exc:
        if _missing(exc):
            return spark.createDataFrame([], schema)
        raise


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if _missing(exc):
            return spark.createDataFrame([], schema)
        raise


def _compact_date_of_file(column: Column, pattern: str) -> Column:
    digits = F.regexp_extract(column, pattern, 1)
    return F.when(digits != "", F.try_to_date(digits, "yyyyMMdd"))


def _items_in_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of the JSON arrays in files, a row each, with ``file`` and ``pos`` in it; broken files give no rows.

    Spark's reader makes rows of the elements of an array, so a file is never one value. Its rows come in order and
    within one partition, so ids that grow with the rows give their places.
    """
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True)
    rows = cut_lineage(rows.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id")))
    bounds = rows.groupBy("file").agg(F.min("_id").alias("_first"), F.max(F.col("_broken").isNotNull()).alias("_bad"))
    # one row a file: sent along if there are few
    bounds = F.broadcast(bounds) if bounds.count() <= FEW else bounds
    return rows.join(bounds, "file").where(~F.col("_bad")).withColumn("pos", (F.col("_id") - F.col("_first") + 1).cast("int")).drop("_id", "_first", "_broken", "_bad")


def read_daily_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest arrays of files ``final_digest_YYYYMMDD.json`` or folders ``final_digest=YYYY-MM-DD``: one row per item.

    Files whose name holds no date and files that are not valid JSON give no rows.
    """
    rows = _items_in_files(spark, path, schemas.DIGEST)
    name = F.regexp_replace("file", r"final_digest=(\d{4})-(\d\d)-(\d\d)/[^/]*$", "final_digest_$1$2$3.json")
    date = _compact_date_of_file(name, r"final_digest_(\d{8})\.json$")
    names = [c for c in rows.columns if c not in ("file", "pos", "final_digest")]
    return rows.select(date.alias("date"), "file", "pos", *names).where(F.col("date").isNotNull())


def read_cumulative(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative digest JSON, as an object with ``date_blocks`` or as a bare list of blocks.

    The blocks of a list are rows from the start; those of an object are once it is read. Blocks of a digest that was
    written as several files bring their number and the items of their day in earlier files.
    """
    block = f"date string, no int, before int, items array<struct<{_inline(schemas.DIGEST)}>>"
    rows = _items_in_files(spark, path, f"{block}, date_blocks array<struct<{_inline(block)}>>")
    listed = rows.where("date_blocks is null").select("file", (F.col("pos") - 1).alias("block_seq"), "date", "no", "before", "items")
    held = rows.select("file", F.posexplode("date_blocks").alias("block_seq", "block")).select("file", "block_seq", "block.date", "block.no", "block.before", "block.items")
    return (
        listed.unionByName(held).select(F.coalesce("no", "block_seq").alias("block_seq"), "date", "before", F.posexplode("items").alias("pos", "item"))
        .select("block_seq", "date", (F.col("pos") + F.coalesce("before", F.lit(0)) + 1).alias("pos"), "item.*")
    )


def _inline(schema: str) -> str:
    return ",".join(":".join(part.strip().split(" ", 1)) for part in schema.split(","))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sheet exported as CSV with a header; everything stays text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def manual_articles(sheet: DataFrame, source: Source) -> DataFrame:
    rows = with_aliases(sheet, schemas.MANUAL_ALIASES, ignore_case=False)
    rows = rows.where((F.col("title_original") != "") | (F.col("raw_text") != ""))
    return rows.select(
        "*", F.lit(source.name).alias("source"), F.lit(source.country_region).alias("country_region"),
        F.lit(source.language).alias("language"), F.lit(source.priority).alias("source_priority"),
        F.lit(source.source_type).alias("source_type"),
        F.array(*[F.lit(t) for t in source.tags]).cast("array<string>").alias("tags"),
        url_host("url").alias("source_domain"), F.substring("raw_text", 1, 500).alias("raw_text_preview"),
    )


def accepted_samples(sheet: DataFrame) -> DataFrame:
    rows = with_aliases(sheet, schemas.ACCEPTED_ALIASES, ignore_case=False)
    return rows.where((F.col("title") != "") | (F.col("keywords") != ""))


def accepted_references(sheet: DataFrame, file_name: str) -> DataFrame:
    """Sheet of accepted items as reference samples."""
    rows = with_aliases(sheet, schemas.REFERENCE_ALIASES)
    rows = rows.where((F.col("title_cn") != "") | (F.col("keywords_candidate") != ""))
    return rows.select(F.lit(file_name).alias("source_file"), "*", url_host("url").alias("source_domain"))


def read_first_sheet(spark: SparkSession, *paths: str) -> DataFrame | None:
    """First of several sheets that exists."""
    for path in paths:
        try:
            return read_sheet(spark, path)
        except AnalysisException as exc:
            if not _missing(exc):
                raise
    return None


def reference_samples(references: DataFrame) -> DataFrame:
    """Reference rows as samples ``title, keywords, type, soft_hard``."""
    return references.select(
        clean("title_cn").alias("title"), clean(F.array_join("keywords_candidate", ",")).alias("keywords"),
        clean("type_candidate").alias("type"), clean("soft_hard_candidate").alias("soft_hard"),
    )


def feed_items(feeds: DataFrame, limit: int, *, url: str = "url", xml: str = "xml") -> DataFrame:
    """First ``limit`` entries of RSS and Atom feeds; entries without a link are dropped.

    Broken XML yields no rows.  The limit counts entries before links are checked.
    """
    content = F.regexp_replace(col(xml), r"^\s*<\?xml[^>]*\?>", "")
    is_atom = content.rlike(r"(?s)^\s*(?:<!--.*?-->\s*)*<(?:\w+:)?feed[\s>]")
    options = {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true"}
    parsed = feeds.withColumn("_rss", F.from_xml(F.when(~is_atom, content), schemas.RSS, options)).withColumn(
        "_atom", F.from_xml(F.when(is_atom, content), schemas.ATOM, options)
    )
    rss = F.transform(
        F.col("_rss.channel.item"),
        lambda e: F.struct(
            e["link"].alias("link"), e["title"].alias("title"), feed_entry_date(e["pubDate"], e["updated"], e["created"]).alias("entry_date"),
            first_text(e["summary"], e["description"]).alias("summary"),
        ),
    )
    atom = F.transform(
        F.col("_atom.entry"),
        lambda e: F.struct(
            F.coalesce(
                F.get(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)),
                F.get(e["link"], F.lit(0)),
            )["_href"].alias("link"),
            e["title"].alias("title"), feed_entry_date(e["published"], e["updated"], e["created"]).alias("entry_date"),
            first_text(e["summary"]).alias("summary"),
        ),
    )
    rows = parsed.select(
        col(url).alias("feed_url"), *[c for c in feeds.columns if c not in (url, xml)],
        F.posexplode(F.slice(F.coalesce(rss, atom), 1, limit)).alias("pos", "e"),
    )
    kept = [c for c in rows.columns if c != "e"]
    return rows.select(
        *kept, clean("e.link").alias("link"), clean("e.title").alias("title"),
        F.coalesce("e.entry_date", F.lit("")).alias("entry_date"), clean("e.summary").alias("summary"),
    ).where(F.col("link") != "")


def feed_articles(items: DataFrame, extracted: DataFrame) -> DataFrame:
    """Feed items joined to extracted pages ``url, title, text``; feed title and page text first."""
    pages = extracted.select(F.col("url").alias("_url"), F.col("title").alias("_title"), F.col("text").alias("_text"))
    joined = items.join(pages, F.col("link") == F.col("_url"), "left")
    rows = joined.select(
        *[c for c in items.columns if c not in ("title", "summary", "entry_date", "link")],
        F.col("link").alias("url"), first_text("title", "_title").alias("title_original"),
        first_text("_text", "summary").alias("raw_text"), F.col("entry_date").alias("published_date"),
    )
    return rows.where((F.col("title_original") != "") | (F.col("raw_text") != ""))


def day_rows(table: DataFrame, run_date: str, *order: Column | str) -> DataFrame:
    """One run date of a partitioned table, in the wanted order."""
    return table.where(F.col("run_date") == F.lit(run_date).cast("date")).orderBy(*order)


def candidates_of_day(table: DataFrame, run_date: str) -> DataFrame:
    return day_rows(table, run_date, F.desc("score"), F.asc("candidate_id"))


def articles_of_day(table: DataFrame, run_date: str) -> DataFrame:
    return day_rows(table, run_date, "ingest_seq")


def digests_of_day(table: DataFrame, run_date: str) -> DataFrame:
    words = F.coalesce(F.from_json("keywords_json", "array<string>"), F.array().cast("array<string>"))
    return day_rows(table, run_date, "order_index").withColumn("keywords", words).drop("keywords_json")


def reviewed_candidates(sheet: DataFrame) -> DataFrame:
    return sheet.where(is_selected("selected"))


def candidate_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Candidate metadata rows of all sheets of a folder, dated by their file names."""
    sheets = read_sheet(spark, path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    digits = F.get(F.filter(F.split(name, "_"), lambda p: p.rlike(r"^\d{8}$")), F.lit(0))
    return sheets.withColumn("run_date", F.try_to_date(digits, "yyyyMMdd").cast("string")).withColumn("file", name)


METADATA_FIELDS = (
    "run_date", "title_cn", "title_translated_candidate", "title_original", "url", "source", "type",
    "suggested_type", "soft_hard", "suggested_soft_hard", "keywords", "matched_keywords",
)


def metadata_rows(sheets: DataFrame | None, table: DataFrame | None) -> DataFrame:
    """Sheet rows before table rows, ordered by ``seq``; rows without URL and title dropped.

    ``seq`` packs the part, the partition and the row, so it needs no global sort.
    """
    parts = []
    for part_no, rows in enumerate((sheets, table)):
        if rows is None:
            continue
        fields = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in METADATA_FIELDS]
        file = F.col("file") if "file" in rows.columns else F.lit("")
        row_id = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
        parts.append(rows.select(*fields, F.struct(F.lit(part_no).alias("part"), file.alias("file"), row_id.alias("row")).alias("seq")))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    title = first_text("title_cn", "title_translated_candidate", "title_original")
    return whole.where((clean("url") != "") | (clean(title) != ""))


def read_daily_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Daily digests as this package writes them: one ``date=...`` folder per day."""
    rows = _items_in_files(spark, path, f"{schemas.DIGEST}, date date")
    return rows.select("date", "pos", *[c for c in rows.columns if c not in ("file", "pos", "date")])
