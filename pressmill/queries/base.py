"""Query registry and the article-like views shared by queries and reference SQL.

Each view exists twice: as a DataFrame function and as SQL text with the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.config import Keyword, Profile, ScoreSettings, TermLists, TitleRules
from pressmill.operators.lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Rows and bytes of whole texts or pages that go to a Python worker at once; Spark's own are 10,000 and 64 MB, of which a worker holds several copies.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = {_BATCH: ("10000", BATCH_ROWS), _BYTES: ("67108864b", BATCH_BYTES)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. A session that has not chosen its own batches for Python gets small ones."""
    for key, (default, small) in _SPARKS_OWN.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------------------
# SQL pieces


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_hits(text: str, terms) -> str:
    """Number of terms contained in lower-cased text."""
    return "(" + (" + ".join(f"CAST(contains({text}, {sql_text(t.lower())}) AS INTEGER)" for t in terms) or "0") + ")"


def sql_any(text: str, terms) -> str:
    return "(" + (" OR ".join(f"contains({text}, {sql_text(t.lower())})" for t in terms) or "false") + ")"


def sql_canonical(u: str) -> str:
    """Canonical form of the URLs in the given tables: no escapes, no session ids."""
    head = f"regexp_extract({u}, '^([a-zA-Z]+)://', 1)"
    host = f"regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)"
    path = f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    query_text = f"regexp_extract({u}, '\\?([^#]*)', 1)"
    keys = "'fbclid','gclid','yclid','mc_cid','mc_eid','n_cid','ref','referrer','source'"
    kept = (
        f"list_filter(string_split({query_text}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({keys}) "
        f"AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_'))"
    )
    return (
        f"lower({head}) || '://' || lower({host}) || (CASE WHEN {path} IN ('', '/') THEN '/' ELSE rtrim({path}, '/') END) || "
        f"(CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"
    )


# ---------------------------------------------------------------------------
# articles: documents seen as fetched news articles; the title is the start of the first line

FIRST_DAY = "2024-01-01"


def _of_five(values) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(F.col("seq") % len(values) == i, F.lit(values[i])).otherwise(out)
    return out


def articles(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 30).cast("int"))
    published = F.date_sub(day, (F.col("doc_id") % 4).cast("int"))
    era = F.concat(F.lit("令和6年"), F.month(published).cast("string"), F.lit("月"), F.dayofmonth(published).cast("string"), F.lit("日 10:30"))
    era = F.when(F.year(published) == 2024, era).otherwise(F.date_format(published, "yyyy/M/d"))
    kind = F.col("doc_id") % 5
    text = (
        F.when(kind == 0, F.date_format(published, "yyyy-MM-dd"))
        .when(kind == 1, F.concat(F.date_format(published, "yyyy/M/d"), F.lit(" 9:05")))
        .when(kind == 2, F.concat(F.year(published).cast("string"), F.lit("年"), F.month(published).cast("string"), F.lit("月"), F.dayofmonth(published).cast("string"), F.lit("日")))
        .when(kind == 3, era)
        .otherwise(F.concat(F.date_format(published, "yyyy.MM.dd"), F.lit(" 23:10")))
    )
    rows = d.select(
        F.col("doc_id").alias("seq"), day.alias("run_date"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title_original"),
        F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("raw_text"), F.substring("text", 1, 500).alias("raw_text_preview"), "source",
        F.col("lang").alias("language"), text.alias("published_date"),
    )
    return (
        rows.withColumn("source_type", _of_five(["official", "rss", "html", "login_browser"]))
        .withColumn("source_priority", (F.col("seq") % 6).cast("int"))
        .withColumn("country_region", F.when(F.col("language") == "en", "Global").when(F.col("language") == "de", "Japan").otherwise("Korea"))
        .withColumn("extraction_warning", F.when(F.col("seq") % 7 == 0, "short_text; page_partial").otherwise(""))
        .withColumn("max_articles_per_run", F.when(F.length("source") > 4, "3").otherwise(""))
    )


_DAY = f"CAST(DATE '{FIRST_DAY}' + CAST(doc_id % 30 AS INTEGER) AS DATE)"
_PUB = f"CAST({_DAY} - CAST(doc_id % 4 AS INTEGER) AS DATE)"
ART = f"""art0 AS (
  SELECT doc_id AS seq, {_DAY} AS run_date, {_PUB} AS pub_day,
         substr(split_part(text, chr(10), 1), 1, 60) AS title_original,
         'https://example.com/' || source || '/' || doc_id AS url, text AS raw_text, source, lang AS language
  FROM documents),
art AS (
  SELECT *, CASE seq % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'rss' WHEN 2 THEN 'html' ELSE 'login_browser' END AS source_type,
         CAST(seq % 6 AS INTEGER) AS source_priority,
         CASE language WHEN 'en' THEN 'Global' WHEN 'de' THEN 'Japan' ELSE 'Korea' END AS country_region,
         CASE WHEN seq % 7 = 0 THEN 'short_text; page_partial' ELSE '' END AS extraction_warning,
         CASE WHEN length(source) > 4 THEN 3 ELSE NULL END AS max_articles,
         seq % 5 IN (1, 4) OR (seq % 5 = 3 AND year(pub_day) = 2024) AS has_time,
         CASE WHEN seq % 5 = 1 THEN CAST(pub_day AS TIMESTAMP) + INTERVAL 545 MINUTE
              WHEN seq % 5 = 4 THEN CAST(pub_day AS TIMESTAMP) + INTERVAL 1390 MINUTE
              WHEN seq % 5 = 3 AND year(pub_day) = 2024 THEN CAST(pub_day AS TIMESTAMP) + INTERVAL 630 MINUTE
              ELSE CAST(pub_day AS TIMESTAMP) END AS published_ts
  FROM art0)"""

# the reporting window of a run date, and the status of a published time in it
WINDOW_START = "(CAST(run_date - CAST(CASE WHEN isodow(run_date) = 1 THEN 3 ELSE 1 END AS INTEGER) AS TIMESTAMP) + INTERVAL 10 HOUR)"
WINDOW_END = "(CAST(run_date AS TIMESTAMP) + INTERVAL 86399 SECOND)"


def sql_status(ts: str, has_time: str) -> str:
    outside = f"'outside_collection_window:' || strftime({WINDOW_START}, '%Y-%m-%d %H:%M')"
    return f"""CASE WHEN {ts} IS NULL THEN 'missing_published_datetime'
      WHEN {has_time} AND {ts} BETWEEN {WINDOW_START} AND {WINDOW_END} THEN 'within_collection_window'
      WHEN {has_time} THEN {outside}
      WHEN CAST({ts} AS DATE) > CAST({WINDOW_START} AS DATE) AND CAST({ts} AS DATE) <= run_date THEN 'within_collection_window_date_only'
      WHEN CAST({ts} AS DATE) = CAST({WINDOW_START} AS DATE) THEN 'boundary_date_without_time'
      ELSE {outside} END"""


# ---------------------------------------------------------------------------
# records: articles with the label table's quality flag as acceptance


def records(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality"))
    joined = d.join(labels, "doc_id", "left")
    title = F.substring_index("text", "\n", 1)
    return joined.select(
        F.col("doc_id").alias("seq"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        title.alias("title"),
        F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "source", F.when(F.col("lang") == "en", "未分类").otherwise(F.col("lang")).alias("type"),
        F.col("lang"), F.split(F.lower(title), " ").alias("keywords"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("accepted"),
        F.when(F.col("doc_id") % 3 == 0, "word+rules").otherwise("word+digest_json").alias("data_source"),
    )


REC = f"""rec AS (
  SELECT d.doc_id AS seq, CAST(DATE '{FIRST_DAY}' + CAST(d.doc_id % 30 AS INTEGER) AS DATE) AS date,
         split_part(d.text, chr(10), 1) AS title,
         'https://example.com/' || d.source || '/' || d.doc_id AS url, d.source,
         CASE WHEN d.lang = 'en' THEN '未分类' ELSE d.lang END AS type, d.lang,
         string_split(lower(split_part(d.text, chr(10), 1)), ' ') AS keywords,
         coalesce(l.quality, 0) = 1 AS accepted,
         CASE WHEN d.doc_id % 3 = 0 THEN 'word+rules' ELSE 'word+digest_json' END AS data_source
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

# ---------------------------------------------------------------------------
# a small dictionary and term lists made of what the invented texts contain

KEYWORDS = (
    Keyword("law", "license", 8.0), Keyword("law", "erons", 6.0), Keyword("contact", "@", 4.0),
    Keyword("contact", "hath", 1.5), Keyword("language", "sch", 2.0), Keyword("language", " que ", 2.0),
    Keyword("language", "ción", 2.0), Keyword("general", "The ", 1.0), Keyword("general", "ai", 1.0),
    Keyword("general", "bles", 3.0),
)
TERMS = TermLists(
    strategic=("license", "über", "eaux"), novelty=("éçr", "bles", "ción"), high_value_policy=("erons", "ngañ"),
    policy_topic=("ai",), negative=("%",), low_value_business=("202",), low_scope_consumer=("éçr", "erons"),
    market_title=("%%",), market_body=("nm", "bles", "hath"), sports_title=("thth",), sports_technology=("ing",),
    core_topic=("sch", "tion", "aux"), operational=("ngañ",), operational_strategic=("ción",),
    low_priority_global=("@",), target_region=("sch",), policy_categories=("law",), industry_categories=("contact",),
)
PROFILE = Profile(preferred_regions=("Japan",), region_terms=("sch", "japan"), require_preferred_region=True)
SETTINGS = ScoreSettings(keywords=KEYWORDS, terms=TERMS, profile=PROFILE)
TITLE_RULES = TitleRules(
    policy=("sch",), industry=("ing",), soft=("und", "sch"), hard=("the",), keywords=("The", "en", "tion", "de"),
    max_keywords=2, source_markers=(("blog.", "Blogs"), ("m.", "Mobile"), ("example.com", "Example"), ("example.org", "Org")),
)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Historical samples: the first 60 characters of a benchmark text as title, the whole text for keywords."""
    b = table(spark, folder, "benchmark")
    return b.select("item_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("keywords"))


def scratch(spark: SparkSession) -> str:
    """New folder for a round trip below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"
