"""Round trips through the readers and writers, on tables derived from the given ones."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import Source
from pressmill.functions.urls import url_host
from pressmill.operators import analytics as an
from pressmill.operators.scored import known_history_terms
from pressmill.plans.digests import merge_cumulative
from pressmill.queries.base import ART, REC, SETTINGS, articles, query, records, samples, scratch, sql_clean, table
from pressmill.sources import readers, registry, schemas, writers

_FLAT = "replace(replace({x}, chr(13), ' '), chr(10), ' ')"


@query("s1_s2_jsonl_round_trip", "SELECT event_id, event_type, value, props FROM events")
def s1(spark, d):
    path = scratch(spark)
    writers.write_jsonl(table(spark, d, "events").select("event_id", "event_type", "value", "props"), path)
    return readers.read_jsonl(spark, path, "event_id bigint, event_type string, value double, props string")


@query("s1_missing_path", "SELECT CAST(count(*) AS BIGINT) AS documents, CAST(0 AS BIGINT) AS missing FROM documents")
def s1_missing(spark, d):
    absent = readers.read_jsonl(spark, f"{scratch(spark)}/nothing", "doc_id bigint")
    both = table(spark, d, "documents").select("doc_id", F.lit(0).alias("m")).unionByName(absent.withColumn("m", F.lit(1)))
    return both.agg(F.count_if(F.col("m") == 0).alias("documents"), F.count_if(F.col("m") == 1).alias("missing"))


def _digest_rows(spark, d):
    r = records(spark, d)
    return r.select("date", F.col("seq").alias("order_index"), F.concat(F.lit("c"), F.col("seq").cast("string")).alias("candidate_id"), F.col("title").alias("title_cn"), F.lit("s").alias("summary_cn"), "keywords", "type", F.lit("硬科学").alias("soft_hard"), "source", "url")


_DROW = f"WITH {REC}, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY seq) AS pos FROM rec)"


@query("s20_daily_digests", f"{_DROW} SELECT CAST(date AS VARCHAR) AS date, CAST(pos AS INTEGER) AS pos, title AS title_cn, url, array_to_string(keywords, '/') AS keywords FROM o")
def s20(spark, d):
    path = scratch(spark)
    writers.write_daily_json(_digest_rows(spark, d), path)
    got = readers.read_daily_partitions(spark, path)
    return got.select(F.col("date").cast("string").alias("date"), "pos", "title_cn", "url", F.array_join("keywords", "/").alias("keywords"))


@query("s3_daily_files", f"{_DROW} SELECT CAST(date AS VARCHAR) AS date, CAST(pos AS INTEGER) AS pos, title AS title_cn, url, array_to_string(keywords, '/') AS keywords FROM o")
def s3(spark, d):
    """Digest arrays that carry their day in the name only; the folder of items without a day has none."""
    path = scratch(spark)
    rows = _digest_rows(spark, d).withColumn("final_digest", F.col("date"))
    rows = rows.unionByName(rows.where("order_index % 3 = 0").withColumn("final_digest", F.lit(None).cast("date")))
    writers.write_daily_json(rows.drop("date"), path, date="final_digest")
    got = readers.read_daily_digests(spark, path)
    return got.select(F.col("date").cast("string").alias("date"), "pos", "title_cn", "url", F.array_join("keywords", "/").alias("keywords"))


@query("s4_cumulative_file", f"{_DROW} SELECT CAST(dense_rank() OVER (ORDER BY date) - 1 AS INTEGER) AS block_seq, CAST(date AS VARCHAR) AS date, CAST(pos AS INTEGER) AS pos, title AS title_cn, source FROM o")
def s4_file(spark, d):
    """The whole file as any JSON reader sees it."""
    path = scratch(spark)
    writers.write_cumulative(_digest_rows(spark, d), path)
    return readers.read_cumulative(spark, path).select(F.col("block_seq").cast("int").alias("block_seq"), "date", "pos", "title_cn", "source")


@query("s4_cumulative_round_trip", f"{_DROW} SELECT CAST(date AS VARCHAR) AS date, CAST(pos AS INTEGER) AS pos, title AS title_cn, source FROM o")
def s4(spark, d):
    path = scratch(spark)
    writers.write_cumulative(_digest_rows(spark, d), path)
    return writers.read_cumulative_lines(spark, path).select("date", "pos", "title_cn", "source")


_SHEET = f"trim({_FLAT.format(x='title_original')})"


def _sheet(spark, d, path):
    a = articles(spark, d)
    flat = F.trim(F.regexp_replace("title_original", "[\r\n]", " "))
    sheet = a.select(F.when(F.col("seq") % 4 == 0, "").otherwise(flat).alias("标题"), F.col("url").alias("URL"), F.when(F.col("seq") % 8 == 0, "").otherwise(F.concat(F.lit("body "), F.col("seq").cast("string"))).alias("正文"), F.col("run_date").cast("string").alias("发布日期"))
    sheet.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return readers.read_sheet(spark, path)


@query("s5_manual_articles", f"WITH {ART} SELECT CASE WHEN seq % 4 = 0 THEN '' ELSE {sql_clean(_SHEET)} END AS title_original, url, 'body ' || seq AS raw_text, CAST(run_date AS VARCHAR) AS published_date, 'Desk' AS source, 'example.com' AS source_domain FROM art WHERE seq % 8 <> 0")
def s5(spark, d):
    got = readers.manual_articles(_sheet(spark, d, scratch(spark)), Source("Desk", "Japan", "ja", source_type="manual"))
    return got.select("title_original", "url", "raw_text", "published_date", "source", "source_domain")


@query("s6_accepted_samples", f"WITH {ART} SELECT {sql_clean(_SHEET)} AS title, source AS keywords, language AS type FROM art")
def s6(spark, d):
    path, flat = scratch(spark), F.trim(F.regexp_replace("title_original", "[\r\n]", " "))
    articles(spark, d).select(flat.alias("中文标题"), F.col("source").alias("关键词"), F.col("language").alias("类型")).write.option("header", True).option("escape", '"').csv(path)
    sheet = readers.read_first_sheet(spark, f"{path}-absent", path)
    return readers.accepted_samples(sheet).select("title", "keywords", "type")


@query("s6_accepted_references", f"WITH {ART} SELECT {sql_clean(_SHEET)} AS title_cn, url, 'example.com' AS source_domain, source AS keywords_candidate, 'w' || (seq % 5) AS week FROM art")
def s6_refs(spark, d):
    flat = F.trim(F.regexp_replace("title_original", "[\r\n]", " "))
    sheet = articles(spark, d).select(flat.alias("题目"), F.col("url").alias("Url"), F.col("source").alias("KEYWORDS"), F.concat(F.lit("w"), (F.col("seq") % 5).cast("string")).alias("周次"))
    return readers.accepted_references(sheet, "x").select("title_cn", "url", "source_domain", "keywords_candidate", "week")


@query("s7_reference_samples", f"SELECT {sql_clean('text')} AS title, {sql_clean('text')} || ',b' AS keywords, 'Type' AS type FROM benchmark")
def s7(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "benchmark").select(F.col("text").alias("title_cn"), F.array("text", F.lit("b")).alias("keywords_candidate"), F.lit(" Type ").alias("type_candidate"), F.lit("").alias("soft_hard_candidate"))
    writers.write_jsonl(rows, path)
    return readers.reference_samples(readers.read_jsonl(spark, path, schemas.REFERENCE)).select("title", "keywords", "type")


@query("s8_source_registry", "WITH p AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS name, regexp_extract(url, '^[a-z]+', 0) AS scheme FROM pages) SELECT name, min(scheme) || '://' || name || '/' AS section_url, true AS enabled, CAST(20 AS INTEGER) AS max_articles_per_run FROM p GROUP BY name")
def s8(spark, d):
    return registry.sources_from_pages(table(spark, d, "pages")).select("name", "section_url", "enabled", "max_articles_per_run")


@query("s9_keyword_table", "WITH w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) SELECT lang AS category, trim(t) AS term, CAST(CASE WHEN i = 1 THEN doc_id WHEN doc_id % 2 = 0 THEN 3.0 ELSE 5.0 END AS DOUBLE) AS weight FROM w WHERE trim(t) <> ''")
def s9(spark, d):
    words = F.split("text", " ")
    entries = F.transform(words, lambda t, i: F.struct(t.alias("term"), F.when(i == 0, F.col("doc_id").cast("double")).alias("weight")))
    rows = table(spark, d, "documents").select(F.col("lang").alias("category"), F.when(F.col("doc_id") % 2 == 0, 3.0).alias("default_weight"), entries.alias("keywords"))
    return registry.keywords_from_table(rows)


def _stored_candidates(spark, d):
    path = scratch(spark)
    a = articles(spark, d).select("seq", "run_date", F.lpad(F.col("seq").cast("string"), 12, "0").alias("candidate_id"), ((F.col("seq") * 37) % 101).cast("double").alias("score"))
    writers.replace_run_dates(a, path)
    writers.replace_run_dates(a.where(F.col("run_date") == F.lit("2024-01-05").cast("date")).withColumn("score", F.col("score") + 1000), path)
    return readers.read_parquet_or_empty(spark, path, "seq bigint, run_date date, candidate_id string, score double")


@query("s16_replace_run_dates", f"WITH {ART} SELECT seq, CAST(run_date AS VARCHAR) AS run_date, CAST((seq * 37) % 101 AS DOUBLE) + CASE WHEN run_date = DATE '2024-01-05' THEN 1000 ELSE 0 END AS score FROM art")
def s16(spark, d):
    return _stored_candidates(spark, d).select("seq", F.col("run_date").cast("string").alias("run_date"), "score")


@query("s13_candidates_of_day", f"WITH {ART} SELECT seq, CAST((seq * 37) % 101 AS DOUBLE) + 1000 AS score FROM art WHERE run_date = DATE '2024-01-05' ORDER BY score DESC")
def s13(spark, d):
    return readers.candidates_of_day(_stored_candidates(spark, d), "2024-01-05").select("seq", "score")


def _article_rows(spark, d):
    a = articles(spark, d)
    url = F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit("https://example.com/"), F.floor(F.col("seq") / 60).cast("string"), F.lit("/"), (F.col("seq") % 30).cast("string")))
    return a.select(F.col("seq").alias("ingest_seq"), "run_date", url.alias("url"))


_AROW = f"{ART}, ar AS (SELECT seq, run_date, CASE WHEN seq % 5 = 0 THEN '' ELSE 'https://example.com/' || (seq // 60) || '/' || (seq % 30) END AS url FROM art), fi AS (SELECT *, row_number() OVER (PARTITION BY run_date, url ORDER BY seq) AS rn FROM ar)"


@query("s14_first_wins_articles", f"WITH {_AROW} SELECT seq AS ingest_seq, url FROM fi WHERE (url = '' OR rn = 1) AND (url = '' OR NOT EXISTS (SELECT 1 FROM ar o WHERE o.seq % 7 = 0 AND o.url = fi.url AND o.run_date = fi.run_date))")
def s14(spark, d):
    rows = _article_rows(spark, d)
    stored = rows.where(F.col("ingest_seq") % 7 == 0)
    return writers.new_articles(rows, stored).select("ingest_seq", "url")


@query("s14_articles_of_day", f"WITH {_AROW} SELECT seq AS ingest_seq, url FROM fi WHERE run_date = DATE '2024-01-09' AND (url = '' OR rn = 1) ORDER BY seq")
def s14_day(spark, d):
    path = scratch(spark)
    writers.append_articles(_article_rows(spark, d), path, None)
    return readers.articles_of_day(spark.read.parquet(path), "2024-01-09").select("ingest_seq", "url")


@query("s15_digests_of_day", f"WITH {REC}, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY seq) AS n FROM rec) SELECT CAST(n AS INTEGER) AS order_index, title AS title_cn, array_to_string(keywords, '/') AS keywords FROM o WHERE date = DATE '2024-01-09'")
def s15(spark, d):
    path = scratch(spark)
    rows = _digest_rows(spark, d).withColumnRenamed("date", "run_date").withColumnRenamed("order_index", "seq")
    writers.replace_run_dates(writers.digest_table(rows), path)
    got = readers.digests_of_day(spark.read.parquet(path), "2024-01-09")
    return got.select("order_index", "title_cn", F.array_join("keywords", "/").alias("keywords"))


@query("s17_s18_candidate_sheet", f"WITH {ART} SELECT {sql_clean(_SHEET)} AS title_original, url, '' AS notes, source FROM art WHERE seq % 2 = 0")
def s17(spark, d):
    path, flat = scratch(spark), F.trim(F.regexp_replace("title_original", "[\r\n]", " "))
    rows = articles(spark, d).select(flat.alias("title_original"), "url", "source", F.when(F.col("seq") % 2 == 0, "采纳").otherwise("").alias("selected"))
    writers.fixed_columns(rows).write.option("header", True).option("escape", '"').csv(path)
    got = readers.reviewed_candidates(readers.read_sheet(spark, path))
    from pressmill.functions.text import clean

    return got.select(clean("title_original").alias("title_original"), "url", F.coalesce("notes", F.lit("")).alias("notes"), "source")


@query("s19_analytics_export", f"WITH {REC} SELECT CAST(date AS VARCHAR) AS date, CAST(count(*) AS VARCHAR) AS items FROM rec GROUP BY date")
def s19(spark, d):
    r = records(spark, d).withColumnRenamed("seq", "order_index").withColumn("soft_hard", F.lit("x"))
    base = writers.export_analytics(r, scratch(spark), "2024-01-01", "2024-01-30")
    return readers.read_sheet(spark, f"{base}/daily").select("date", "items")


@query("s21_reference_export", "WITH w AS (SELECT unnest(string_split(text, ' ')) AS value FROM documents) SELECT value, CAST(count(*) AS BIGINT) AS items FROM w GROUP BY value ORDER BY items DESC, value LIMIT 100")
def s21(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "documents").select(F.split("text", " ").alias("keywords_candidate"), F.lit("d").alias("source_domain"), F.col("lang").alias("type_candidate"), F.lit("h").alias("soft_hard_candidate"))
    writers.write_reference(rows, path)
    return readers.read_jsonl(spark, f"{path}/reference_keywords", "metric string, value string, items bigint").select("value", "items")


@query("s23_candidate_metadata_rows", f"WITH {ART} SELECT CAST(run_date AS VARCHAR) AS run_date, url, CAST(CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS part FROM art WHERE seq % 6 <> 0 OR trim(title_original) <> ''")
def s23(spark, d):
    a = articles(spark, d).withColumn("run_date", F.col("run_date").cast("string"))
    sheets, stored = a.where(F.col("seq") % 2 == 0), a.where(F.col("seq") % 2 == 1)
    return readers.metadata_rows(sheets, stored).select("run_date", "url", F.col("seq.part").alias("part"))


@query("s24_ranked_output", f"WITH {ART} SELECT title_original, url, substr(raw_text, 1, 500) AS raw_text_preview, '' AS logged_in_status FROM art")
def s24(spark, d):
    rows = articles(spark, d).withColumn("raw_text_preview", F.col("raw_text"))
    return writers.ranked_output(rows, empty_warning="nothing collected", home="https://example.com/", source="Example").select("title_original", "url", "raw_text_preview", "logged_in_status")


@query("c10_merge_cumulative", f"""WITH {REC}, i AS (SELECT seq, date, 0 AS blk, url, title FROM rec WHERE date <> DATE '2024-01-05' UNION ALL SELECT seq, DATE '2024-01-05', 1073741824, url, title FROM rec WHERE date = DATE '2024-01-20'),
k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY url ORDER BY date, seq) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY date, blk ORDER BY seq) AS no FROM k),
b AS (SELECT DISTINCT date, blk FROM k),
t AS (SELECT date, blk, no, 0 AS part, no || '.' || title AS text FROM n UNION ALL SELECT date, blk, no, 1, 's' FROM n UNION ALL SELECT date, blk, no, 2, trim(url) FROM n
UNION ALL SELECT date, blk, 0, 0, '每日科技要闻报送摘要' || strftime(date, '%Y%m%d') || '：' FROM b UNION ALL SELECT date, blk, 0, range - 2, '' FROM b, range(2) WHERE (date, blk) > (SELECT min((date, blk)) FROM b))
SELECT CAST(date AS VARCHAR) AS date, CAST(blk AS BIGINT) AS block_seq, CAST(no AS BIGINT) AS order_index, CAST(part AS INTEGER) AS part, text FROM t""")
def c10(spark, d):
    r = records(spark, d).select("date", F.lit(0).cast("bigint").alias("block_seq"), F.col("seq").alias("pos"), "url", F.col("title").alias("title_cn"), F.lit("s").alias("summary_cn"))
    day = r.where(F.col("date") == F.lit("2024-01-20").cast("date"))
    _, text = merge_cumulative(r, day, "2024-01-05")
    return text.select(F.col("date").cast("string").alias("date"), F.col("block_seq").cast("bigint").alias("block_seq"), "order_index", "part", "text")
