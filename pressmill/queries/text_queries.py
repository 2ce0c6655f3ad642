"""Text, URL and date expressions."""

from pyspark.sql import functions as F

from pressmill.config import Profile
from pressmill.functions import dates as dt
from pressmill.functions import text as tx
from pressmill.functions import urls as ul
from pressmill.queries.base import (
    ART, WINDOW_END, WINDOW_START, articles, query, sql_canonical, sql_clean, sql_status, table,
)

_CLEAN = sql_clean("text")


@query("f1_clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def f1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean("text").alias("cleaned"))


@query("f2_preview", f"SELECT doc_id, CASE WHEN length({_CLEAN}) > 500 THEN rtrim(substr({_CLEAN}, 1, 500)) || '...' ELSE {_CLEAN} END AS preview FROM documents")
def f2(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.preview("text").alias("preview"))


_PATH = "regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_VARIANT = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '.html', '') || '.xml' WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '.RSS' ELSE replace(url, '/en/', '/rss/') END"


@query("f3_is_feed_url", f"WITH v AS (SELECT page_id, {_VARIANT} AS u FROM pages), p AS (SELECT page_id, lower({_PATH.format(u='u')}) AS p FROM v) SELECT page_id, ends_with(p, '.xml') OR ends_with(p, '.rss') OR contains(p, '/rss/') AS is_feed FROM p")
def f3(spark, d):
    k, url = F.col("page_id") % 4, F.col("url")
    u = (
        F.when(k == 0, url).when(k == 1, F.concat(F.replace(url, F.lit(".html"), F.lit("")), F.lit(".xml")))
        .when(k == 2, F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit(".RSS")))
        .otherwise(F.replace(url, F.lit("/en/"), F.lit("/rss/")))
    )
    return table(spark, d, "pages").select("page_id", ul.is_feed_url(u).alias("is_feed"))


@query("f4_canonical_url", f"SELECT page_id, {sql_canonical('url')} AS canonical FROM pages")
def f4(spark, d):
    return table(spark, d, "pages").select("page_id", ul.canonical_url("url").alias("canonical"))


@query("f4_canonical_groups", f"SELECT {sql_canonical('url')} AS canonical, CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1")
def f4_groups(spark, d):
    return table(spark, d, "pages").groupBy(ul.canonical_url("url").alias("canonical")).agg(F.count(F.lit(1)).alias("pages"))


@query("f5_strip_session", "SELECT page_id, url AS plain FROM pages")
def f5(spark, d):
    k = F.col("page_id") % 2
    base, rest = F.regexp_extract("url", "^([^?#]*)", 1), F.regexp_extract("url", "^[^?#]*(.*)$", 1)
    dressed = F.when(k == 0, F.concat(base, F.lit(";jsessionid=A1B2"), rest)).otherwise(F.concat(base, F.lit(";JSESSIONID=9"), rest))
    return table(spark, d, "pages").select("page_id", ul.strip_session_id(dressed).alias("plain"))


@query("f6_url_parts", "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme, regexp_extract(url, '//([^/?#]*)', 1) AS host, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def f6(spark, d):
    return table(spark, d, "pages").select(
        "page_id", ul.url_scheme("url").alias("scheme"), ul.url_host("url").alias("host"), ul.url_path("url").alias("path"),
        ul.url_query("url").alias("query"), ul.url_fragment("url").alias("fragment"),
    )


_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("f7_resolve_link", f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_ROOT} || '/a/b.html' WHEN 1 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.com/x' WHEN 2 THEN 'https://other.example.org/y' ELSE {_ROOT} || regexp_replace(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '[^/]*$', '') || 'next' END AS link FROM pages")
def f7(spark, d):
    k = F.col("page_id") % 4
    href = F.when(k == 0, "/a/b.html").when(k == 1, "//cdn.example.com/x").when(k == 2, "https://other.example.org/y").otherwise("next")
    return table(spark, d, "pages").select("page_id", ul.resolve_link("url", href).alias("link"))


@query("f9_date_from_url", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CASE WHEN year(day) < 2000 AND o_orderkey % 6 NOT IN (4) THEN '' WHEN o_orderkey % 6 = 4 THEN '20' || strftime(day, '%y-%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS url_date FROM o""")
def f9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k, f = F.col("o_orderkey") % 6, lambda p: F.date_format("day", p)
    site = F.lit("https://news.example.com")
    url = (
        F.when(k == 0, F.concat(site, F.lit("/news/release_"), f("yyyyMMdd"), F.lit(".html")))
        .when(k == 1, F.concat(site, F.lit("/press/"), f("yyyy/MM"), F.lit("/"), f("yyyyMMdd"), F.lit("_j.html")))
        .when(k == 2, F.concat(site, F.lit("/view/AKR"), f("yyyyMMdd"), F.lit("123")))
        .when(k == 3, F.concat(site, F.lit("/pt"), f("yyyyMMdd"), F.lit("0001.html")))
        .when(k == 4, F.concat(site, F.lit("/articles/"), f("yyMM"), F.lit("/"), f("d"), F.lit("/news1.html")))
        .otherwise(F.concat(site, F.lit("/economy/"), f("yyyy/M/d"), F.lit("/x/")))
    )
    return o.select("o_orderkey", ul.date_from_url(url).alias("url_date"))


_DAYS = "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query("f14_normalize_date_text", f"{_DAYS} SELECT o_orderkey, CASE WHEN year(day) < 2000 THEN '' WHEN o_orderkey % 4 = 3 THEN strftime(day, '%Y-%m-%d') || ' 08:30' ELSE strftime(day, '%Y-%m-%d') END AS normal, CASE WHEN year(day) < 2000 THEN '' WHEN o_orderkey % 4 = 2 THEN strftime(day, '%Y-%m-%d') || ' 07:05' ELSE strftime(day, '%Y-%m-%d') END AS local FROM o")
def f14(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k, f = F.col("o_orderkey") % 4, lambda p: F.date_format("day", p)
    loose = F.when(k == 0, F.concat(F.lit("on "), f("yyyy/M/d"))).when(k == 1, f("yyyy.MM.dd")).when(k == 2, f("yyyy年M月d日")).otherwise(F.concat(f("yyyy-MM-dd"), F.lit("T8:30")))
    local = F.when(k == 0, f("yyyy/M/d")).when(k == 1, f("yyyy.MM.dd")).when(k == 2, F.concat(f("yyyy年M月d日"), F.lit("(月) 7:05"))).otherwise(f("yyyy年 M月 d日"))
    return o.select("o_orderkey", dt.normalize_date_text(loose).alias("normal"), dt.normalize_local_date_text(local).alias("local"))


@query("f18_boilerplate_trim", "SELECT doc_id, CASE WHEN length(text) > 200 THEN text ELSE 'menu [[TOP]] ' || text || ' [[TOP]] ' || text END AS kept FROM documents")
def f18(spark, d):
    text = F.concat(F.lit("menu [[TOP]] "), F.col("text"), F.lit(" [[TOP]] "), F.col("text"))
    kept = tx.keep_tail(text, ["[[TOP]] "], 200)
    return table(spark, d, "documents").select("doc_id", kept.alias("kept"))


@query("f19_parse_datetime", f"WITH {ART} SELECT seq, strftime(published_ts, '%Y-%m-%d %H:%M') AS ts, has_time FROM art")
def f19(spark, d):
    a = articles(spark, d).withColumn("p", dt.article_time("published_date"))
    return a.select("seq", F.date_format("p.ts", "yyyy-MM-dd HH:mm").alias("ts"), F.col("p.has_time").alias("has_time"))


@query("f19_parse_five_notations", f"""{_DAYS} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN strftime(day, '%Y-%m-%d') WHEN year(day) < 2000 THEN NULL WHEN o_orderkey % 5 = 3 THEN strftime(day, '%Y-%m-%d') || ' 21:07' ELSE strftime(day, '%Y-%m-%d') END AS parsed FROM o""")
def f19_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k, f = F.col("o_orderkey") % 5, lambda p: F.date_format("day", p)
    era = F.concat(F.lit("平成"), (F.year("day") - 1988).cast("string"), f("年M月d日"))
    text = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy/M/d")).when(k == 2, f("yyyy年M月d日")).when(k == 3, F.concat(f("yyyy.MM.dd"), F.lit("T21:07 JST"))).otherwise(era)
    return o.select("o_orderkey", F.nullif(dt.format_time(dt.article_time(text)), F.lit("")).alias("parsed"))


_PLAIN = Profile()


@query("f20_collection_window", f"WITH r AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date FROM events) SELECT CAST(run_date AS VARCHAR) AS run_date, strftime({WINDOW_START}, '%Y-%m-%d %H:%M:%S') AS first, strftime({WINDOW_END}, '%Y-%m-%d %H:%M:%S') AS last, CASE WHEN isodow(run_date) = 1 THEN 3 ELSE 1 END AS multiplier, strftime({WINDOW_START}, '%Y-%m-%d %H:%M') || ' 至 ' || strftime({WINDOW_END}, '%Y-%m-%d %H:%M') || '（local time）' AS label FROM r")
def f20(spark, d):
    r = table(spark, d, "events").select(F.col("ts").cast("date").alias("run_date")).distinct()
    day, shown = F.col("run_date"), "yyyy-MM-dd HH:mm:ss"
    return r.select(
        day.cast("string").alias("run_date"), F.date_format(dt.window_start(day, _PLAIN), shown).alias("first"),
        F.date_format(dt.window_end(day), shown).alias("last"), dt.window_multiplier(day, _PLAIN).alias("multiplier"),
        dt.window_label(day, _PLAIN).alias("label"),
    )


@query("f20_window_status", f"WITH e AS (SELECT event_id, ts, CAST(CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS DATE) AS run_date, event_id % 4 <> 0 AS timed FROM events) SELECT event_id, {sql_status('(CASE WHEN timed THEN ts ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END)', 'timed')} AS status FROM e")
def f20_status(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("event_id") % 4 != 0).alias("timed"),
        F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int")).alias("run_date"),
    )
    ts = F.when(F.col("timed"), F.col("ts")).otherwise(F.col("ts").cast("date").cast("timestamp_ntz"))
    return e.select("event_id", dt.window_status(ts, F.col("timed"), F.col("run_date"), _PLAIN).alias("status"))


@query("f20_events_in_window_daily", f"WITH e AS (SELECT ts, CAST(CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS DATE) AS run_date FROM events) SELECT CAST(run_date AS VARCHAR) AS run_date, CAST(count(*) AS BIGINT) AS items FROM e WHERE ts BETWEEN {WINDOW_START} AND {WINDOW_END} GROUP BY run_date")
def f20_daily(spark, d):
    e = table(spark, d, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int")).alias("run_date")
    )
    status = dt.window_status(F.col("ts"), F.lit(True), F.col("run_date"), _PLAIN)
    return e.where(dt.status_keeps(status)).groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("items"))


@query("f21_append_warning", f"""WITH {ART}, s AS (SELECT seq, extraction_warning AS w, {sql_status('published_ts', 'has_time')} AS st FROM art)
SELECT seq, CASE WHEN st IN ('within_collection_window', 'within_collection_window_date_only') THEN w WHEN w = '' THEN st ELSE w || '; ' || st END AS warning, CASE WHEN w = '' THEN 'page_partial; late' ELSE w || '; late' END AS merged FROM s""")
def f21(spark, d):
    a = articles(spark, d).withColumn("p", dt.article_time("published_date"))
    status = dt.window_status(F.col("p.ts"), F.col("p.has_time"), F.col("run_date"), _PLAIN)
    return a.select("seq", tx.append_warning("extraction_warning", status).alias("warning"), tx.merge_warnings("extraction_warning", F.lit("page_partial；late")).alias("merged"))


@query("f22_best_published_date", f"""WITH {ART} SELECT seq, CASE seq % 4 WHEN 0 THEN strftime(pub_day, '%Y-%m-%d') WHEN 1 THEN CASE WHEN has_time THEN strftime(published_ts, '%Y-%m-%d %H:%M') ELSE strftime(published_ts, '%Y-%m-%d') END WHEN 2 THEN strftime(run_date, '%Y-%m-%d') ELSE strftime(pub_day, '%Y-%m-%d') || ' 06:00' END AS best FROM art""")
def f22(spark, d):
    a, k = articles(spark, d), F.col("seq") % 4
    pub = F.date_sub("run_date", k.cast("int"))
    extracted = F.when(k == 0, F.date_format(pub, "yyyy/MM/dd")).otherwise("2024-02-31")
    discovered = F.when(k == 1, F.col("published_date")).otherwise("")
    labelled = F.when(k == 2, F.concat(F.lit("x 2023-01-01 公開日： "), F.date_format("run_date", "yyyy年M月d日"))).when(k == 3, F.concat(F.date_format(pub, "yyyy-MM-dd"), F.lit(" 06:00 first"))).otherwise("")
    return a.select("seq", dt.published_date(extracted, discovered, F.lit("t"), labelled).alias("best"))


@query("f23_extraction_warning", f"WITH {ART} SELECT seq, concat_ws('; ', CASE WHEN title_original = '' THEN 'missing_title' END, CASE WHEN length(raw_text) < 200 THEN 'short_text' END, CASE WHEN seq % 3 = 0 THEN 'missing_or_unparsed_date' END) AS warning FROM art")
def f23(spark, d):
    a = articles(spark, d)
    return a.select("seq", tx.extraction_warning("title_original", "raw_text", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("published_date"))).alias("warning"))


@query("f24_ids", f"WITH {ART} SELECT seq, substr(sha1({sql_clean('url')}), 1, 12) AS by_url, substr(sha1({sql_clean('title_original')}), 1, 12) AS by_title, substr(sha1(CAST(run_date AS VARCHAR) || '|' || seq || '|' || {sql_clean('title_original')} || '|' || url), 1, 16) AS marker FROM art")
def f24(spark, d):
    a = articles(spark, d)
    return a.select(
        "seq", tx.candidate_id("url", "title_original").alias("by_url"), tx.candidate_id(F.lit(""), "title_original").alias("by_title"),
        tx.marker_id(F.col("run_date").cast("string"), F.col("seq"), F.col("title_original"), F.col("url")).alias("marker"),
    )


@query("f37_keyword_lists", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
n AS (SELECT doc_id, i, trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g')) AS w FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)),
c AS (SELECT doc_id, i, unnest(string_split(translate(w, ',;|', '、、、'), '、')) AS part, generate_subscripts(string_split(translate(w, ',;|', '、、、'), '、'), 1) AS j FROM n),
f AS (SELECT doc_id, trim(part) AS part, min(i * 100000 + j) AS pos FROM c WHERE trim(part) <> '' GROUP BY ALL)
SELECT doc_id, string_agg(part, '/' ORDER BY pos) AS words FROM f GROUP BY doc_id""")
def f37(spark, d):
    doc = table(spark, d, "documents")
    text = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("cat:"), w)), "；")
    words = tx.keywords_from_text(text)
    return doc.select("doc_id", F.array_join(words, "/").alias("words")).where(F.col("words") != "")


@query("f43_heading_and_items", """SELECT conv_id, turn, CASE WHEN turn = 0 THEN '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') END AS heading, CASE WHEN turn > 0 THEN CAST(turn AS INTEGER) END AS item FROM conversations WHERE length(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) > 0""")
def f43(spark, d):
    from pressmill.operators.documents import heading_date, item_index

    p = digest_paragraphs(spark, d).where(F.length(tx.clean("words")) > 0)
    return p.select(F.col("doc_id").cast("bigint").alias("conv_id"), F.col("paragraph_index").cast("bigint").alias("turn"), heading_date("text").alias("heading"), item_index("text").alias("item"))


def digest_paragraphs(spark, d):
    """Conversations as numbered paragraphs: turn 0 is the dated heading."""
    c = table(spark, d, "conversations")
    head = F.concat(F.lit("每日科技要闻报送摘要 202401"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("："))
    item = F.concat(F.col("turn").cast("string"), F.lit("."), tx.clean("text"))
    return c.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("paragraph_index"),
        F.when(F.col("turn") == 0, head).otherwise(item).alias("text"), F.col("text").alias("words"),
        (F.col("role") == "assistant").alias("highlighted"),
    )


@query("f44_date_formats", f"{_DAYS} SELECT o_orderkey, strftime(day, '%Y%m%d') AS compact, CASE WHEN o_orderkey % 3 = 0 THEN CAST(day AS VARCHAR) END AS strict, CAST(day AS VARCHAR) AS from_compact FROM o")
def f44(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "yyyy/MM/dd")).otherwise("2023-02-30")
    return o.select("o_orderkey", dt.compact_date("day").alias("compact"), dt.iso_date(text).cast("string").alias("strict"), dt.date_from_compact(F.date_format("day", "yyyyMMdd")).cast("string").alias("from_compact"))


@query("f45_romanize", "SELECT doc_id, 'Hanguk 中 ' || doc_id || ' Gamdok' AS latin FROM documents")
def f45(spark, d):
    text = F.concat(F.lit("한국 中 "), F.col("doc_id").cast("string"), F.lit(" 감독"))
    return table(spark, d, "documents").select("doc_id", tx.normalize_translation(text).alias("latin"))


@query("f46_valid_translation", "SELECT doc_id, doc_id % 4 = 0 AS valid, doc_id % 3 = 0 AND doc_id % 4 <> 0 AS needed FROM documents")
def f46(spark, d):
    k = F.col("doc_id") % 4
    new = F.when(k == 0, F.concat(F.lit("科技 "), F.col("doc_id").cast("string"))).when(k == 1, "科技 한국").when(k == 2, "").otherwise("plain")
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("한국 "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("t "), F.col("doc_id").cast("string")))
    doc = table(spark, d, "documents")
    return doc.select("doc_id", tx.valid_translation(new, title).alias("valid"), tx.needs_translation(title, new, "lang").alias("needed"))


@query("f49_model_json", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def f49(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).when(k == 2, F.concat(F.lit("<think>{</think>"), F.col("props"))).otherwise("no json {")
    return table(spark, d, "events").select("event_id", F.try_variant_get(tx.model_json(raw), "$.k", "bigint").alias("k"))


@query("f50_json_tags", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '/' || source ELSE '' END AS tags FROM documents")
def f50(spark, d):
    doc = table(spark, d, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise("[broken")
    return doc.select("doc_id", F.array_join(tx.json_tags(raw), "/").alias("tags"))


@query("f51_source_text", f"WITH {ART} SELECT seq, CASE WHEN seq % 2 = 0 THEN {sql_clean('raw_text')} ELSE {sql_clean('substr(raw_text, 1, 500)')} END AS source_text, CASE WHEN seq % 2 = 0 THEN CAST(run_date AS VARCHAR) ELSE 'day ' || seq END AS date_text FROM art")
def f51(spark, d):
    a, even = articles(spark, d), F.col("seq") % 2 == 0
    return a.select(
        "seq", tx.source_text(F.when(even, F.col("raw_text")).otherwise(""), "raw_text_preview").alias("source_text"),
        dt.safe_iso_text(F.when(even, F.col("run_date").cast("string")).otherwise(F.concat(F.lit("day "), F.col("seq").cast("string")))).alias("date_text"),
    )
