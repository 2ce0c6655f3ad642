"""Counts, distributions, targets and metadata joins."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import scoring as sc
from pressmill.functions.dates import safe_iso_text
from pressmill.functions.urls import source_from_url
from pressmill.operators import analytics as an
from pressmill.operators.keyed import first_per_key
from pressmill.plans import analytics as plan
from pressmill.queries.base import (
    ART, FIRST_DAY, REC, TITLE_RULES, articles, query, records, sql_any, sql_canonical, sql_clean, table,
)

_COUNTS = "CAST(count(*) AS BIGINT) AS items, CAST(sum(CAST(accepted AS INTEGER)) AS BIGINT) AS accepted_items"
_RATE = "CAST(round_even(accepted_items * 100.0::DOUBLE / items, 1) AS DOUBLE)"


def _day(df, name="date"):
    return df.withColumn(name, F.col(name).cast("string"))


@query("a1_daily_counts", f"WITH {REC} SELECT CAST(date AS VARCHAR) AS date, {_COUNTS} FROM rec GROUP BY date")
def a1(spark, d):
    return _day(an.daily_counts(records(spark, d)))


@query("a1_events_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS items, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS accepted_items FROM events GROUP BY 1")
def a1_events(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), (F.col("event_type") == "purchase").alias("accepted"))
    return _day(an.daily_counts(e))


def _dist_sql(column, source=f"WITH {REC}", rel="rec"):
    return f"{source} SELECT *, round_even(accepted_items * 100.0::DOUBLE / items, 1)::DOUBLE AS acceptance_rate FROM (SELECT {column}, {_COUNTS} FROM {rel} GROUP BY {column})"


@query("a2_distribution_source", _dist_sql("source"))
def a2_source(spark, d):
    return an.distribution(records(spark, d), "source")


@query("a2_distribution_type", _dist_sql("type"))
def a2_type(spark, d):
    return an.distribution(records(spark, d), "type")


@query("a2_distribution_returnflag", _dist_sql("l_returnflag", "WITH li AS (SELECT l_returnflag, l_quantity > 25 AS accepted FROM lineitem)", "li"))
def a2_lineitem(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("accepted"))
    return an.distribution(li, "l_returnflag")


@query("a3_summary_metrics", f"WITH {REC}, t AS (SELECT {_COUNTS} FROM rec) SELECT items AS total, accepted_items AS accepted, {_RATE} AS acceptance_rate, items - accepted_items AS unaccepted FROM t")
def a3(spark, d):
    return an.summary_metrics(records(spark, d))


@query("a4_keyword_counts", f"""WITH {REC}, w AS (SELECT {sql_clean('k')} AS keyword, accepted FROM (SELECT unnest(keywords) AS k, accepted FROM rec))
SELECT keyword, CAST(count(*) AS BIGINT) AS occurrences, CAST(sum(CAST(accepted AS INTEGER)) AS BIGINT) AS accepted_occurrences
FROM w WHERE keyword <> '' GROUP BY keyword ORDER BY occurrences DESC, keyword LIMIT 30""")
def a4(spark, d):
    return an.keyword_counts(records(spark, d), 30)


def _digest_items(spark, d):
    """Two generations of digest blocks over the articles; a third of them share a URL."""
    r = records(spark, d)
    shared = F.concat(F.lit("https://Example.com/item/"), F.floor(F.col("seq") / 3).cast("string"), F.lit("/?utm_source=x"))
    return r.select(
        (F.col("seq") % 2).alias("seq"), F.col("seq").alias("pos"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.when(F.col("seq") % 4 == 0, 0).otherwise(F.col("seq") % 10).alias("order_index"), F.col("title").alias("title_cn"),
        F.lit("").alias("title_original"), F.when(F.col("seq") % 5 == 0, "").otherwise(shared).alias("url"),
        F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("source")).alias("source"), F.col("type"),
        F.lit("").alias("soft_hard"), F.array_join("keywords", ",").alias("keywords"),
    )


_DIG = f"""{REC}, dig AS (
  SELECT seq % 2 AS block, seq AS pos, CAST(date AS VARCHAR) AS date,
         CASE WHEN seq % 4 = 0 OR seq % 10 = 0 THEN seq ELSE seq % 10 END AS order_index,
         {sql_clean('title')} AS title,
         CASE WHEN seq % 5 = 0 THEN '' ELSE 'https://Example.com/item/' || (seq // 3) || '/?utm_source=x' END AS url,
         CASE WHEN seq % 3 = 0 THEN '' ELSE source END AS source, type,
         CASE WHEN seq % 5 <> 0 THEN 'url::https://example.com/item/' || (seq // 3)
              WHEN {sql_clean('title')} <> '' THEN 'title::' || CAST(date AS VARCHAR) || '::' || lower({sql_clean('title')}) END AS record_key
  FROM rec),
dm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY block DESC, pos DESC) AS rn FROM dig WHERE record_key IS NOT NULL) WHERE rn = 1)"""


@query("a5_digest_metadata", f"WITH {_DIG} SELECT record_key, date, CAST(order_index AS BIGINT) AS order_index, title, url, source, type FROM dm")
def a5(spark, d):
    return an.digest_metadata(_digest_items(spark, d)).select(
        "record_key", "date", F.col("order_index").cast("bigint").alias("order_index"), "title", "url", "source", "type"
    )


def _candidate_rows(spark, d):
    r = records(spark, d)
    return r.select(
        "seq", F.date_format("date", "yyyy-MM-dd").alias("run_date"), F.lit("").alias("title_cn"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit("t "), F.col("title"))).otherwise("").alias("title_translated_candidate"),
        F.col("title").alias("title_original"),
        F.when(F.col("seq") % 4 == 0, "").otherwise(F.concat(F.lit("https://example.com/item/"), F.floor(F.col("seq") / 2).cast("string"))).alias("url"),
        F.when(F.col("seq") % 3 == 1, "").otherwise(F.col("source")).alias("source"), F.lit("").alias("type"),
        F.col("type").alias("suggested_type"), F.lit("").alias("soft_hard"), F.when(F.col("seq") % 5 == 0, "软科学").otherwise("").alias("suggested_soft_hard"),
        F.lit("").alias("keywords"), F.array_join("keywords", ",").alias("matched_keywords"),
    )


_CAN = f"""cand AS (
  SELECT seq, CAST(date AS VARCHAR) AS date, CASE WHEN seq % 2 = 0 THEN {sql_clean("'t ' || title")} ELSE {sql_clean('title')} END AS title,
         {sql_clean('title')} AS title_original,
         CASE WHEN seq % 4 = 0 THEN '' ELSE 'https://example.com/item/' || (seq // 2) END AS url,
         CASE WHEN seq % 3 = 1 THEN '' ELSE source END AS source, type, CASE WHEN seq % 5 = 0 THEN '软科学' ELSE '' END AS soft_hard,
         {sql_clean("array_to_string(keywords, ',')")} AS kw
  FROM rec),
keyed AS (
  SELECT DISTINCT seq, unnest(CASE WHEN url <> '' THEN ['url::' || url] ELSE
      ['title::' || date || '::' || lower(title)] || (CASE WHEN title_original <> '' THEN ['title::' || date || '::' || lower(title_original)] ELSE [] END) END) AS record_key,
      date, title, url, source, type, soft_hard,
      CAST(source <> '' AS INTEGER) + CAST(type NOT IN ('', '未分类') AS INTEGER) + CAST(soft_hard <> '' AS INTEGER) + CAST(kw <> '' AS INTEGER) + CAST(url <> '' AS INTEGER) AS quality
  FROM cand WHERE url <> '' OR title <> ''),
cm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY quality DESC, seq) AS rn FROM keyed) WHERE rn = 1)"""


@query("a6_candidate_metadata", f"WITH {REC}, {_CAN} SELECT record_key, date, title, url, source, type, soft_hard, quality FROM cm")
def a6(spark, d):
    return an.candidate_metadata(_candidate_rows(spark, d)).select("record_key", "date", "title", "url", "source", "type", "soft_hard", "quality")


def _entries(spark, d):
    r = records(spark, d)
    return r.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("seq").alias("order_index"), "title",
        F.when(F.col("seq") % 5 == 1, "").otherwise(F.concat(F.lit("https://example.com/item/"), F.floor(F.col("seq") * 2 / 3).cast("string"))).alias("url"),
        "accepted",
    )


def _entry_key():
    return f"""ent AS (SELECT CAST(date AS VARCHAR) AS date, seq AS order_index, title, accepted,
  CASE WHEN seq % 5 = 1 THEN '' ELSE 'https://example.com/item/' || CAST(floor(seq * 2 / 3.0::DOUBLE) AS BIGINT) END AS url FROM rec),
ek AS (SELECT *, CASE WHEN url <> '' THEN 'url::' || url WHEN {sql_clean('title')} <> '' THEN 'title::' || date || '::' || lower({sql_clean('title')}) END AS record_key FROM ent)"""


_KNOWN = "CASE WHEN {d} NOT IN ('', '未知', '未分类') THEN {d} WHEN {c} NOT IN ('', '未知', '未分类') THEN {c} ELSE coalesce({d}, {c}, '') END"
_TYPE = f"""CASE WHEN mtype IN ('政策', '技术', '产业') THEN mtype WHEN {sql_any(f"lower({sql_clean('title')})", TITLE_RULES.policy)} THEN '政策'
  WHEN {sql_any(f"lower({sql_clean('title')})", TITLE_RULES.industry)} THEN '产业' WHEN {sql_clean('title')} <> '' OR url <> '' THEN '技术' ELSE '未分类' END"""
_J4 = f"""WITH {_DIG}, {_CAN}, {_entry_key()},
j AS (SELECT e.date, e.order_index, e.title, e.url, e.accepted, {_KNOWN.format(d='dm.type', c='cm.type')} AS mtype,
        {_KNOWN.format(d='dm.source', c='cm.source')} AS msource, coalesce(nullif(e.url, ''), nullif(dm.url, ''), nullif(cm.url, ''), '') AS out_url,
        CASE WHEN dm.record_key IS NOT NULL AND cm.record_key IS NOT NULL THEN 'word+digest_json+candidate_metadata' WHEN dm.record_key IS NOT NULL THEN 'word+digest_json'
             WHEN cm.record_key IS NOT NULL THEN 'word+candidate_metadata' ELSE 'word+rules' END AS data_source
      FROM ek e LEFT JOIN dm USING (record_key) LEFT JOIN cm USING (record_key))"""


@query("j4_metadata_merge", f"""{_J4} SELECT date, order_index, title, accepted, data_source, out_url AS url, {_TYPE} AS type,
  CASE WHEN msource <> '' THEN msource WHEN url LIKE '%example.com%' THEN 'Example' ELSE '未知' END AS source FROM j""")
def j4(spark, d):
    got = an.analytics_records(_entries(spark, d), an.digest_metadata(_digest_items(spark, d)), an.candidate_metadata(_candidate_rows(spark, d)), TITLE_RULES)
    return got.select("date", "order_index", "title", "accepted", "data_source", "url", "type", "source")


@query("j4_orders_lineitem_merge", """WITH li AS (SELECT * FROM (SELECT l_orderkey, l_shipdate, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_returnflag) rn FROM lineitem) WHERE rn = 1),
c AS (SELECT c_custkey, c_mktsegment FROM customer)
SELECT o_orderkey, coalesce(l_returnflag, substr(c_mktsegment, 1, 1), '') AS flag,
 CASE WHEN l_orderkey IS NOT NULL AND c_custkey IS NOT NULL THEN 'both' WHEN l_orderkey IS NOT NULL THEN 'first' WHEN c_custkey IS NOT NULL THEN 'second' ELSE 'none' END AS data_source
FROM orders LEFT JOIN li ON o_orderkey = l_orderkey LEFT JOIN c ON o_custkey = c_custkey""")
def j4_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = first_per_key(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag"), ["l_orderkey"], ["l_shipdate", "l_returnflag"])
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    a, b = F.col("l_orderkey").isNotNull(), F.col("c_custkey").isNotNull()
    return j.select(
        "o_orderkey", F.coalesce("l_returnflag", F.substring("c_mktsegment", 1, 1), F.lit("")).alias("flag"),
        F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("none").alias("data_source"),
    )


@query("c13_digest_only_records", f"WITH {_DIG} SELECT date, CAST(order_index AS BIGINT) AS order_index, title, url, CASE WHEN source <> '' THEN source WHEN url = '' THEN '未知' ELSE 'Example' END AS source, coalesce(nullif(type, ''), '未分类') AS type, false AS accepted FROM dm")
def c13_digests(spark, d):
    got = plan.records(None, _digest_items(spark, d), None, TITLE_RULES)
    return got.select("date", F.col("order_index").cast("bigint").alias("order_index"), "title", "url", "source", "type", "accepted")


@query("c13_records_by_type", f"""{_J4}, r AS (SELECT accepted, {_TYPE} AS type FROM j) SELECT type, {_COUNTS} FROM r GROUP BY type""")
def c13(spark, d):
    got = plan.records(_entries(spark, d), _digest_items(spark, d), _candidate_rows(spark, d), TITLE_RULES)
    return an.distribution(got, "type").select("type", "items", "accepted_items")


@query("a7_reference_statistics", """WITH r AS (SELECT doc_id, string_split(text, ' ') AS kws, lang, source FROM documents),
k AS (SELECT 'keyword' AS metric, kw AS value, CAST(count(*) AS BIGINT) AS items FROM (SELECT unnest(kws) AS kw FROM r) GROUP BY kw ORDER BY items DESC, value LIMIT 100),
s AS (SELECT 'domain' AS metric, source || '.example.com' AS value, CAST(count(*) AS BIGINT) AS items FROM r GROUP BY 2 ORDER BY items DESC, value LIMIT 50)
SELECT 'reference_count' AS metric, '' AS value, CAST(count(*) AS BIGINT) AS items FROM r UNION ALL SELECT * FROM k UNION ALL SELECT * FROM s
UNION ALL SELECT 'type', lang, CAST(count(*) AS BIGINT) FROM r GROUP BY lang UNION ALL SELECT 'soft_hard', CASE WHEN doc_id % 2 = 0 THEN '软科学' ELSE '硬科学' END, CAST(count(*) AS BIGINT) FROM r GROUP BY 2""")
def a7(spark, d):
    r = table(spark, d, "documents").select(
        F.split("text", " ").alias("keywords_candidate"),
        F.concat("source", F.lit(".example.com")).alias("source_domain"), F.col("lang").alias("type_candidate"),
        F.when(F.col("doc_id") % 2 == 0, "软科学").otherwise("硬科学").alias("soft_hard_candidate"),
    )
    return an.reference_statistics(r)


@query("a11_reference_dedup", """WITH r AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'https://example.com/' || (doc_id // 7) ELSE '' END AS url, CASE WHEN doc_id % 11 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title_cn, source FROM documents)
SELECT seq, url, title_cn FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url WHEN title_cn <> '' THEN title_cn ELSE 'row:' || source END ORDER BY seq) AS rn FROM r) WHERE rn = 1""")
def a11(spark, d):
    r = records(spark, d).select(
        "seq", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://example.com/"), F.floor(F.col("seq") / 7).cast("string"))).otherwise("").alias("url"),
        F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("title")).alias("title_cn"), "source",
    )
    return an.distinct_references(r).select("seq", "url", "title_cn")


@query("a17_dashboard_counts", f"WITH {REC} SELECT CAST(sum(CASE WHEN type = '未分类' THEN 1 ELSE 0 END) AS BIGINT) AS unclassified, CAST(sum(CASE WHEN contains(data_source, 'rules') THEN 1 ELSE 0 END) AS BIGINT) AS rule_inferred FROM rec")
def a17(spark, d):
    return an.dashboard_counts(records(spark, d))


@query("a18_share_of_total", f"WITH {REC}, c AS (SELECT source, CAST(count(*) AS BIGINT) AS items FROM rec GROUP BY source) SELECT source, items, CAST(round_even(items::DOUBLE / (SELECT sum(items) FROM c)::DOUBLE * 100, 1) AS DOUBLE) AS share FROM c")
def a18(spark, d):
    return an.share_of_total(an.distribution(records(spark, d), "source").select("source", "items"))


_CUM = f"""{REC}, blk AS (SELECT seq, date, seq % 2 AS block_seq, seq AS pos, CASE WHEN seq % 6 = 0 THEN '' ELSE 'https://example.com/i/' || (seq // 4) END AS url FROM rec)"""


def _blocks(spark, d):
    r = records(spark, d)
    return r.select(
        "seq", "date", (F.col("seq") % 2).cast("bigint").alias("block_seq"), F.col("seq").alias("pos"),
        F.when(F.col("seq") % 6 == 0, "").otherwise(F.concat(F.lit("https://example.com/i/"), F.floor(F.col("seq") / 4).cast("string"))).alias("url"),
    )


@query("w8_cumulative_dedup", f"WITH {_CUM} SELECT seq, CAST(date AS VARCHAR) AS date, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date, block_seq, pos) AS rn FROM blk) WHERE url = '' OR rn = 1")
def w8(spark, d):
    return _day(an.deduplicate_blocks(_blocks(spark, d)).select("seq", "date", "url"))


@query("u6_merge_day", f"""WITH {_CUM}, m AS (SELECT seq, date, block_seq, pos, url FROM blk WHERE date <> DATE '2024-01-05'
  UNION ALL SELECT seq, DATE '2024-01-05', 1 << 30, pos, url FROM blk WHERE date = DATE '2024-01-20')
SELECT seq, CAST(date AS VARCHAR) AS date, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date, block_seq, pos) AS rn FROM m) WHERE url = '' OR rn = 1""")
def u6(spark, d):
    b = _blocks(spark, d)
    day = b.where(F.col("date") == F.lit("2024-01-20").cast("date"))
    return _day(an.merge_day(b, day, "2024-01-05").select("seq", "date", "url"))


@query("a20_cumulative_totals", f"WITH {_CUM} SELECT CAST(count(DISTINCT date) AS BIGINT) AS blocks, CAST(count(*) AS BIGINT) AS items FROM blk")
def a20(spark, d):
    return an.cumulative_totals(_blocks(spark, d))


@query("w7_block_order_index", f"WITH {REC} SELECT CAST(date AS VARCHAR) AS date, seq, CASE WHEN seq % 10 = 0 THEN seq + 1 ELSE seq % 10 END AS order_index FROM rec")
def w7(spark, d):
    r = records(spark, d).withColumn("given", F.col("seq") % 10)
    return _day(r.select("date", "seq", F.coalesce(F.nullif("given", F.lit(0)), F.col("seq") + 1).alias("order_index")))


@query("p16_date_range", f"WITH {REC} SELECT seq, CAST(date AS VARCHAR) AS date FROM rec WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'")
def p16(spark, d):
    return _day(an.between_dates(records(spark, d), "2024-01-21", "2024-01-08").select("seq", "date"))


@query("t2_ordered_records", f"WITH {REC} SELECT CAST(date AS VARCHAR) AS date, seq, title FROM rec ORDER BY date, seq, title")
def t2(spark, d):
    r = records(spark, d).withColumnRenamed("seq", "order_index")
    return _day(an.sorted_records(r).select("date", F.col("order_index").alias("seq"), "title"))


@query("t4_detail_display", f"WITH {REC} SELECT CAST(date AS VARCHAR) AS date, seq AS order_index, array_to_string(keywords, '、') AS keywords_text FROM rec ORDER BY date DESC, seq")
def t4(spark, d):
    r = records(spark, d).withColumnRenamed("seq", "order_index")
    return _day(an.detail_table(r).select("date", "order_index", "keywords_text"))


@query("t5_best_day", f"WITH {REC}, c AS (SELECT date, {_COUNTS} FROM rec GROUP BY date) SELECT CASE WHEN accepted_items = 0 THEN '暂无采纳' ELSE CAST(date AS VARCHAR) END AS best, items, accepted_items FROM c ORDER BY accepted_items DESC, items DESC, date DESC LIMIT 1")
def t5_day(spark, d):
    return an.best_day(an.daily_counts(records(spark, d)))


@query("t5_best_source", f"WITH {REC}, c AS (SELECT source, {_COUNTS} FROM rec GROUP BY source) SELECT source AS best, items, accepted_items FROM c ORDER BY accepted_items DESC, {_RATE} DESC, items DESC, source LIMIT 1")
def t5_source(spark, d):
    return an.best_value(an.distribution(records(spark, d), "source"), "source")


@query("t5_main_type", f"WITH {REC}, c AS (SELECT type, {_COUNTS} FROM rec GROUP BY type) SELECT type AS best, items, accepted_items FROM c ORDER BY items DESC, accepted_items DESC, type LIMIT 1")
def t5_type(spark, d):
    return an.main_value(an.distribution(records(spark, d), "type"), "type")


_ORD = "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query("f40_period_range", f"""{_ORD} SELECT o_orderkey, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week_start, CAST(CAST(date_trunc('week', day) AS DATE) + 6 AS VARCHAR) AS week_end,
 CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month_start, CAST(last_day(day) AS VARCHAR) AS month_end FROM o""")
def f40(spark, d):
    from pressmill.functions.dates import period_end, period_start

    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    day = F.col("day")
    return o.select(
        "o_orderkey", period_start(day, fv.PERIOD_WEEK).cast("string").alias("week_start"), period_end(day, fv.PERIOD_WEEK).cast("string").alias("week_end"),
        period_start(day, fv.PERIOD_MONTH).cast("string").alias("month_start"), period_end(day, fv.PERIOD_MONTH).cast("string").alias("month_end"),
    )


@query("f41_target_metrics", f"""{_ORD}, r AS (SELECT o_orderkey, CAST(date_trunc('month', day) AS DATE) AS a, CASE WHEN o_orderkey % 3 = 0 THEN last_day(day) ELSE day END AS b FROM o)
SELECT o_orderkey, CAST(n AS INTEGER) AS reporting_days, CAST(n * 10 AS INTEGER) AS target_items, CAST(n * 2 AS INTEGER) AS target_accepted, CAST(20.0 AS DOUBLE) AS target_rate
FROM (SELECT o_orderkey, len(list_filter(range(a::TIMESTAMP, (b + 1)::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS n FROM r)""")
def f41(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    r = an.period_range(o, "day", fv.PERIOD_MONTH).withColumn("anchor", F.when(F.col("o_orderkey") % 3 != 0, F.col("day")))
    return an.target_metrics(r, anchor="anchor").select("o_orderkey", "reporting_days", "target_items", "target_accepted", "target_rate")


@query("f42_delta_labels", """WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) - 3 AS d, round_even(CAST(o_totalprice AS DOUBLE) - 250000.0::DOUBLE, 1)::DOUBLE AS r FROM orders)
SELECT o_orderkey, CASE WHEN d = 0 THEN '持平' WHEN d > 0 THEN '+' || d || ' 条' ELSE d || ' 条' END AS count_label, CASE WHEN r = 0 THEN '持平' WHEN r > 0 THEN 'up' ELSE 'down' END AS rate_kind FROM x""")
def f42(spark, d):
    o = table(spark, d, "orders")
    label = an.rate_delta("o_totalprice", F.lit(250000.0))
    return o.select(
        "o_orderkey", an.count_delta(F.col("o_orderkey") % 7, F.lit(3)).alias("count_label"),
        F.when(label == fv.DELTA_EQUAL, label).when(label.startswith("+"), "up").otherwise("down").alias("rate_kind"),
    )


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query("f8_source_names", f"SELECT page_id, CASE WHEN contains({_HOST}, 'blog.') THEN 'Blogs' WHEN contains({_HOST}, 'm.') THEN 'Mobile' WHEN contains({_HOST}, 'example.com') THEN 'Example' WHEN contains({_HOST}, 'example.org') THEN 'Org' ELSE '未知' END AS name FROM pages")
def f8(spark, d):
    return table(spark, d, "pages").select("page_id", source_from_url("url", TITLE_RULES.source_markers).alias("name"))


@query("f25_record_key", f"""WITH {ART} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'url::' || url WHEN {sql_clean('title_original')} <> '' THEN 'title::' || CAST(run_date AS VARCHAR) || '::' || lower({sql_clean('title_original')}) END AS record_key FROM art""")
def f25(spark, d):
    a = articles(spark, d)
    return a.select("seq", an.record_key("run_date", "title_original", F.when(F.col("seq") % 3 == 0, F.col("url")).otherwise("")).alias("record_key"))


_LT = f"lower({sql_clean('title_original')})"
_KIND = f"CASE WHEN {sql_any(_LT, TITLE_RULES.policy)} THEN '政策' WHEN {sql_any(_LT, TITLE_RULES.industry)} THEN '产业' ELSE '技术' END"
_KEPT = " || ".join(f"CASE WHEN contains({sql_clean('title_original')}, '{t}') THEN ['{t}'] ELSE [] END" for t in TITLE_RULES.keywords)


@query("f36_title_rules", f"""WITH {ART}, k AS (SELECT *, {_KIND} AS kind, ({_KEPT})[1:2] AS kw FROM art)
SELECT seq, kind AS type, CASE WHEN kind = '政策' AND {sql_any(_LT, TITLE_RULES.soft)} THEN '软科学' ELSE '硬科学' END AS soft_hard, array_to_string(kw, ',') AS keywords FROM k""")
def f36(spark, d):
    a = articles(spark, d)
    kind = sc.type_from_title(F.lit(""), "title_original", "url", TITLE_RULES)
    return a.select(
        "seq", kind.alias("type"), sc.soft_hard_from_title(F.lit(""), "title_original", "url", kind, TITLE_RULES).alias("soft_hard"),
        F.array_join(sc.keywords_from_title("title_original", TITLE_RULES), ",").alias("keywords"),
    )


@query("f38_metadata_quality", f"WITH {REC} SELECT seq, CASE WHEN type = '未分类' THEN source ELSE type END AS first_known, 1 + CAST(type <> '未分类' AS INTEGER) AS quality FROM rec")
def f38(spark, d):
    from pressmill.functions.text import first_known

    r = records(spark, d)
    return r.select("seq", first_known("type", "source").alias("first_known"), sc.metadata_quality("type", "source", F.lit("未知")).alias("quality"))
