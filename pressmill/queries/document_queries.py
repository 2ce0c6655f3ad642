"""Digest documents: conversations serve as ordered paragraphs."""

from pyspark.sql import functions as F

from pressmill.functions.text import clean
from pressmill.operators import analytics as an
from pressmill.operators import documents as dc
from pressmill.plans import documents as plan
from pressmill.queries.base import REC, SETTINGS, query, records, sql_clean, table

_TEXT = sql_clean("text")
# turn 0 is a dated heading, odd turns are numbered items, every other even turn holds a URL
_PARAS = f"""p AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS idx, role,
  CASE WHEN turn % 6 = 0 THEN 'H' WHEN turn % 2 = 1 THEN 'I' WHEN turn % 4 = 2 THEN 'U' ELSE 'T' END AS kind,
  CASE WHEN turn % 6 = 0 THEN '202401' || lpad(CAST((conv_id + turn) % 28 + 1 AS VARCHAR), 2, '0') END AS digits,
  {sql_clean('text')} AS words, conv_id, turn FROM conversations)"""


def paragraphs(spark, d):
    c = table(spark, d, "conversations")
    turn = F.col("turn")
    digits = F.concat(F.lit("202401"), F.lpad(((F.col("conv_id") + turn) % 28 + 1).cast("string"), 2, "0"))
    words = clean("text")
    url = F.concat(F.lit("https://example.com/c/"), F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    text = (
        F.when(turn % 6 == 0, F.concat(F.lit("每日科技要闻报送摘要"), digits, F.lit("：")))
        .when(turn % 2 == 1, F.concat(turn.cast("string"), F.lit(". "), words))
        .when(turn % 4 == 2, F.concat(words, F.lit(" "), url, F.lit("。")))
        .otherwise(words)
    )
    return c.select(
        F.col("conv_id").cast("string").alias("doc_id"), turn.cast("int").alias("paragraph_index"), text.alias("text"),
        (F.col("role") == "assistant").alias("highlighted"), words.alias("words"),
    )


_DATED = f"""{_PARAS}, dt AS (SELECT *, last_value(digits IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM p)"""
_ISO = "substr(dd, 1, 4) || '-' || substr(dd, 5, 2) || '-' || substr(dd, 7, 2)"


@query("w3_segment_blocks", f"WITH {_DATED} SELECT doc_id, idx AS paragraph_index, {_ISO} AS block_date FROM dt")
def w3(spark, d):
    return dc.with_block_dates(paragraphs(spark, d)).select("doc_id", "paragraph_index", "block_date")


_FOLLOW = f"""{_DATED}, n AS (SELECT a.doc_id, a.idx, min(b.idx) AS nxt FROM dt a JOIN dt b ON a.doc_id = b.doc_id AND b.idx > a.idx AND b.idx <= a.idx + 4 AND (b.kind IN ('H', 'U') OR (b.kind = 'I' AND b.words <> '')) GROUP BY ALL),
f AS (SELECT a.*, CASE WHEN b.kind = 'U' THEN 'https://example.com/c/' || a.conv_id || '/' || b.turn || '。' ELSE '' END AS url FROM dt a LEFT JOIN n ON n.doc_id = a.doc_id AND n.idx = a.idx LEFT JOIN dt b ON b.doc_id = n.doc_id AND b.idx = n.nxt)"""


@query("w4_following_url", f"WITH {_FOLLOW} SELECT doc_id, idx AS paragraph_index, url AS following_url FROM f")
def w4(spark, d):
    tidy = paragraphs(spark, d).withColumn("text", clean("text"))
    return dc.with_following_url(tidy).select("doc_id", "paragraph_index", "following_url")


_ENTRIES = f"{_FOLLOW}, en AS (SELECT doc_id, idx, {_ISO} AS date, idx AS order_index, words AS title, url, role = 'assistant' AS accepted, substr(sha1({_ISO} || '|' || idx || '|' || words || '|' || url), 1, 16) AS marker_id FROM f WHERE kind = 'I' AND words <> '')"


@query("c12_acceptance_entries", f"WITH {_ENTRIES} SELECT doc_id, date, order_index, title, url, accepted, idx AS paragraph_index, marker_id FROM en")
def c12(spark, d):
    return plan.acceptance(paragraphs(spark, d))


@query("t3_ordered_entries", f"WITH {_ENTRIES} SELECT date, order_index, title FROM en ORDER BY date DESC, order_index, title DESC")
def t3(spark, d):
    return dc.sorted_entries(dc.acceptance_entries(paragraphs(spark, d))).select("date", "order_index", "title")


@query("j12_apply_acceptance", f"WITH {_ENTRIES} SELECT doc_id, order_index, length(title) % 3 = 0 AS accepted FROM en")
def j12(spark, d):
    entries = dc.acceptance_entries(paragraphs(spark, d))
    chosen = entries.where(F.length("title") % 3 == 0).select("marker_id")
    blank = chosen.limit(1).select(F.lit("").alias("marker_id"))
    return plan.apply_acceptance(entries, chosen.unionByName(blank)).select("doc_id", "order_index", "accepted")


@query("c12_acceptance_by_day", f"WITH {_ENTRIES} SELECT date, CAST(count(*) AS BIGINT) AS items, CAST(sum(CAST(accepted AS INTEGER)) AS BIGINT) AS accepted_items FROM en GROUP BY date")
def c12_daily(spark, d):
    return an.daily_counts(dc.acceptance_entries(paragraphs(spark, d)))


# an item collects the words of its own line, of plain lines and of the line of its closing URL
_HIST = f"""{_DATED}, l AS (SELECT *, CASE WHEN kind = 'I' AND words = '' THEN 'I' WHEN kind = 'T' AND words = '' THEN NULL ELSE kind END AS k FROM dt),
e AS (SELECT *, sum(CASE WHEN k <> 'T' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) - CASE WHEN k = 'U' THEN 1 ELSE 0 END AS item FROM l WHERE k IS NOT NULL),
s AS (SELECT *, strpos(words, '。') AS d1, strpos(words, ';') AS d2 FROM e),
o AS (SELECT doc_id, item, dd, idx, CASE WHEN d2 > 0 THEN substr(words, 1, d2) ELSE words END AS title, CASE WHEN d2 > 0 THEN trim(substr(words, d2 + 1)) ELSE '' END AS rest FROM s WHERE k = 'I' AND words <> ''),
m AS (SELECT o.doc_id, o.item, string_agg(CASE WHEN s.k IN ('T', 'U') AND s.words <> '' THEN s.words END, ' ' ORDER BY s.idx) AS body, max(CASE WHEN s.k = 'U' THEN 'https://example.com/c/' || s.conv_id || '/' || s.turn END) AS url FROM o JOIN s ON s.doc_id = o.doc_id AND s.item = o.item GROUP BY ALL)
SELECT o.doc_id, o.idx AS paragraph_index, o.dd AS date_block, o.title AS title_cn, trim(coalesce(nullif(o.rest, '') || ' ', '') || coalesce(m.body, '')) AS summary_cn, coalesce(m.url, '') AS url FROM o JOIN m USING (doc_id, item)"""


@query("w5_history_items", "WITH " + _HIST)
def w5(spark, d):
    return dc.history_items(paragraphs(spark, d))


@query("w6_split_title", f"""WITH t AS (SELECT doc_id, {_TEXT} AS c, string_split_regex(trim(text), '[\\r\\n]+') AS ls FROM documents), n AS (SELECT doc_id, c, list_filter(list_transform(ls, lambda x: {sql_clean('x')}), lambda x: x <> '') AS ls FROM t)
SELECT doc_id, CASE WHEN len(ls) >= 2 THEN ls[1] WHEN strpos(c, ';') BETWEEN 1 AND 81 THEN substr(c, 1, strpos(c, ';')) ELSE c END AS title, CASE WHEN len(ls) >= 2 THEN array_to_string(ls[2:], ' ') WHEN strpos(c, ';') BETWEEN 1 AND 81 THEN trim(substr(c, strpos(c, ';') + 1)) ELSE '' END AS summary FROM n""")
def w6(spark, d):
    doc = table(spark, d, "documents").select("doc_id", dc.split_title(F.concat(F.lit("7、"), F.trim("text"))).alias("s"))
    return doc.select("doc_id", "s.title", "s.summary")


@query("c11_ingest_reference", "WITH h AS (" + "WITH " + _HIST + f"), w AS (SELECT *, lower(title_cn || ' ' || summary_cn) AS low, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url ELSE title_cn END ORDER BY doc_id, paragraph_index) AS rn FROM h) SELECT title_cn, url, date_block, contains(low, 'the') AS has_term FROM w WHERE rn = 1")
def c11(spark, d):
    from pressmill.config import Keyword, ScoreSettings

    got = plan.ingest_reference(paragraphs(spark, d), None, ScoreSettings(keywords=(Keyword("g", "the", 1.0),)))
    return got.select("title_cn", "url", "date_block", (F.size("keywords_candidate") == 1).alias("has_term"))


@query("s22_render_blocks", f"""WITH {REC}, i AS (SELECT date, seq AS order_index, title, url FROM rec), f AS (SELECT min(date) AS m FROM rec)
SELECT CAST(date AS VARCHAR) AS date, order_index, CAST(part AS INTEGER) AS part, CASE part WHEN 0 THEN (order_index || '.' || title) WHEN 1 THEN 'S' || order_index ELSE url END AS text FROM i, range(3) t(part)
UNION ALL SELECT CAST(date AS VARCHAR), 0, 0, '每日科技要闻报送摘要' || strftime(date, '%Y%m%d') || '：' FROM (SELECT DISTINCT date FROM rec)
UNION ALL SELECT CAST(date AS VARCHAR), 0, CAST(-g AS INTEGER), '' FROM (SELECT DISTINCT date FROM rec), f, range(1, 3) t(g) WHERE date > m""")
def s22(spark, d):
    r = records(spark, d).select("date", F.col("seq").alias("order_index"), F.col("title").alias("title_cn"), F.concat(F.lit("S"), F.col("seq").cast("string")).alias("summary_cn"), "url")
    return dc.render_blocks(r).withColumn("date", F.col("date").cast("string"))


@query("w10_replace_block", f"""WITH {_PARAS}, b AS (SELECT *, sum(CASE WHEN kind = 'H' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS blk FROM p),
t AS (SELECT doc_id, min(blk) AS target, min(idx) AS start FROM b WHERE digits = '20240105' GROUP BY doc_id), e AS (SELECT doc_id, max(idx) + 1 AS fin FROM p GROUP BY doc_id)
SELECT b.doc_id, CAST(b.idx AS BIGINT) AS place, CAST(0 AS BIGINT) AS line_no, length(b.words) AS n FROM b LEFT JOIN t USING (doc_id) WHERE t.target IS NULL OR b.blk <> t.target
UNION ALL SELECT e.doc_id, CAST(coalesce(t.start, e.fin) AS BIGINT), l, -1 FROM e LEFT JOIN t USING (doc_id), range(2) x(l)
UNION ALL SELECT e.doc_id, CAST(e.fin AS BIGINT), -1, 0 FROM e LEFT JOIN t USING (doc_id) WHERE t.start IS NULL""")
def w10(spark, d):
    p = paragraphs(spark, d)
    rendered = p.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(F.lit("NEW title"), F.lit("NEW item"))).alias("line_no", "text"))
    got = dc.replace_block(p, rendered, "2024-01-05")
    lengths = p.select("doc_id", F.col("paragraph_index").cast("bigint").alias("place"), F.length("words").alias("w"))
    joined = got.join(lengths, ["doc_id", "place"], "left")
    n = F.when(F.col("text").startswith("NEW"), F.lit(-1)).when(F.col("line_no") == -1, 0).otherwise(F.col("w"))
    return joined.select("doc_id", "place", "line_no", n.cast("bigint").alias("n"))


