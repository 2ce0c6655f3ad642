"""Keyword matches, scores, similarity, near-duplicates and candidate pools."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import keywords as kw
from pressmill.functions import scoring as sc
from pressmill.functions.text import clean
from pressmill.operators import links as lk
from pressmill.operators.scored import known_history_terms, rescore_pool, score_articles, score_parts
from pressmill.operators.similar import best_similarity, near_duplicates
from pressmill.plans.candidates import candidates, combine_pools, score_all
from pressmill.plans.collect import ranked_links
from pressmill.queries.base import (
    ART, KEYWORDS, PROFILE, SETTINGS, TERMS, articles, query, samples, sql_any, sql_clean, sql_hits, sql_status, sql_text, table,
)
from pressmill.queries.link_queries import RANKED
from pressmill.queries.review_queries import sql_excluded

_DOC_LOW = f"lower({sql_clean('text')})"


def _groups(low):
    """SQL for keyword text: categories in order of first match, terms in dictionary order."""
    parts = []
    for category in dict.fromkeys(k.category for k in KEYWORDS):
        words = " || ".join(f"CASE WHEN contains({low}, {sql_text(k.term.lower())}) THEN [{sql_text(k.term.strip())}] ELSE [] END" for k in KEYWORDS if k.category == category)
        parts.append(f"CASE WHEN len({words}) > 0 THEN '{category}: ' || array_to_string({words}, ', ') END")
    return f"concat_ws('; ', {', '.join(parts)})"


def _kw_terms():
    return [(k.category, k.term.strip(), k.term.strip().lower(), k.weight) for k in KEYWORDS]


def _kw_hit(low, term):
    return f"contains({low}, {sql_text(term)})"


def _kw_text(low):
    parts = []
    for category in dict.fromkeys(c for c, *_ in _kw_terms()):
        words = " || ".join(f"CASE WHEN {_kw_hit(low, t)} THEN [{sql_text(s)}] ELSE [] END" for c, s, t, _ in _kw_terms() if c == category)
        parts.append(f"CASE WHEN len({words}) > 0 THEN '{category}: ' || array_to_string({words}, ', ') END")
    return f"concat_ws('; ', {', '.join(parts)})"


def _kw_sum(low):
    return "least(30.0::DOUBLE, " + " + ".join(f"CASE WHEN {_kw_hit(low, t)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for _, _, t, w in _kw_terms()) + ")"


@query("j7_keyword_match", "WITH l AS (SELECT doc_id, " + _DOC_LOW + " AS low FROM documents) " + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, {sql_text(s)} AS keyword, {w}::DOUBLE AS weight FROM l WHERE {_kw_hit('low', t)}" for c, s, t, w in _kw_terms()))
def j7(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.lower(clean("text")).alias("low"))
    return doc.select("doc_id", F.inline(kw.match_keywords("low", KEYWORDS)))


@query("j7_keyword_totals", "WITH l AS (SELECT doc_id, " + _DOC_LOW + " AS low FROM documents), m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {sql_text(s)} AS keyword FROM l WHERE {_kw_hit('low', t)}" for c, s, t, _ in _kw_terms()) + ") SELECT category, keyword, CAST(count(*) AS BIGINT) AS documents FROM m GROUP BY category, keyword")
def j7_totals(spark, d):
    doc = table(spark, d, "documents").select(F.lower(clean("text")).alias("low"))
    found = doc.select(F.inline(kw.match_keywords("low", KEYWORDS)))
    return found.groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("documents"))


@query("f26_keyword_score", f"WITH l AS (SELECT doc_id, {_DOC_LOW} AS low FROM documents) SELECT doc_id, {_kw_sum('low')} AS score, {_kw_text('low')} AS shown FROM l")
def f26(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.lower(clean("text")).alias("low")).withColumn("m", kw.match_keywords("low", KEYWORDS))
    return doc.select("doc_id", kw.keyword_score("m").alias("score"), kw.keyword_text("m").alias("shown"))


_HIST = "hist AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[,;；、\\s]+')) AS w FROM benchmark))"
_HIST_SUM = "least(5.0::DOUBLE, 1.5::DOUBLE * (" + " + ".join(
    f"CASE WHEN {_kw_hit('low', t)} AND EXISTS (SELECT 1 FROM hist WHERE w = {sql_text(t)}) THEN 1 ELSE 0 END" for _, _, t, _ in _kw_terms() if len(t) >= 2) + "))"


@query("j8_history_overlap", f"WITH {_HIST}, l AS (SELECT doc_id, {_DOC_LOW} AS low FROM documents) SELECT doc_id, {_HIST_SUM} AS bonus FROM l")
def j8(spark, d):
    history = known_history_terms(samples(spark, d), SETTINGS)
    doc = table(spark, d, "documents").select("doc_id", F.lower(clean("text")).alias("low")).withColumn("m", kw.match_keywords("low", KEYWORDS))
    return doc.select("doc_id", kw.history_bonus("m", history).alias("bonus"))


_INFO = [r"[0-9]+(\.[0-9]+)?\s?(billion|million|trillion|亿美元|亿日元|万亿|兆|%|％)", r"[0-9]{4}年|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|FY[0-9]{4}|20[0-9]{2}",
         r"roadmap|timeline|target|pilot|trial|clinical|量产|投资|预算|计划|工厂", r"nm|qubit|MW|GW|GWh|TOPS|FLOPS|nanometer"]
_INFO_SQL = " + ".join(f"CASE WHEN regexp_matches(al, '(?i){p}') THEN 1 ELSE 0 END" for p in _INFO)
_D = "::DOUBLE"
_PARTS = f"""{ART}, tx AS (SELECT *, {sql_clean('title_original')} AS t, {sql_clean('raw_text')} AS x FROM art),
al AS (SELECT *, t || ' ' || x || ' ' || extraction_warning AS al FROM tx), lw AS (SELECT *, lower(al) AS low, lower(t) AS lt, lower(x) AS lx FROM al),
rg AS (SELECT *, ({sql_any('low', ('sch',))} OR ({sql_any('low', ('sch', 'japan'))} AND NOT {sql_any('low', TERMS.low_priority_global)})) AS entity, country_region = 'Japan' AS home, {sql_any('low', TERMS.low_priority_global)} AS lowp FROM lw),
pt AS (SELECT *, {_kw_sum('low')} AS relevance, least(25.0{_D}, ({_INFO_SQL} + CASE WHEN length(al) > 800 THEN 1 ELSE 0 END) * 5.0{_D}) AS info,
  least(20.0{_D}, {sql_hits('low', TERMS.strategic)} * 5.0{_D}) AS strategy, least(10.0{_D}, {sql_hits('low', TERMS.novelty)} * 3.0{_D}) AS novelty,
  CASE source_type WHEN 'official' THEN least(10.0{_D}, 5 + p) WHEN 'rss' THEN least(10.0{_D}, 3 + p) WHEN 'login_browser' THEN least(6.0{_D}, 2 + p * 0.6{_D}) ELSE least(10.0{_D}, p * 1.5{_D}) END AS authority,
  CASE WHEN t = '' THEN 0.0{_D} WHEN length(x) >= 500 THEN 5.0{_D} WHEN length(x) >= 200 THEN 3.0{_D} WHEN length(x) > 0 THEN 1.0{_D} ELSE 0.0{_D} END AS compilable,
  CASE WHEN {sql_hits('low', TERMS.high_value_policy)} > 0 THEN least(18.0{_D}, least(12.0{_D}, {sql_hits('low', TERMS.high_value_policy)} * 3.0{_D}) + CASE WHEN source_type = 'official' THEN 4.0{_D} ELSE 0.0{_D} END + CASE WHEN {sql_any('low', TERMS.policy_topic)} THEN 3.0{_D} ELSE 0.0{_D} END) ELSE 0.0{_D} END AS policy,
  least(15.0{_D}, CASE WHEN entity THEN 12.0{_D} WHEN home THEN 4.0{_D} ELSE 0.0{_D} END) AS region_bonus,
  least(25.0{_D}, CASE WHEN entity OR home THEN 0.0{_D} ELSE 18.0{_D} END + CASE WHEN lowp AND entity THEN 4.0{_D} WHEN lowp THEN 10.0{_D} ELSE 0.0{_D} END) AS region_penalty,
  least(35.0{_D}, CAST({sql_hits('low', TERMS.negative)} * 4 + {sql_hits('low', TERMS.low_value_business)} * 3 + {sql_hits('low', TERMS.low_scope_consumer)} * 8 + {sql_hits('low', TERMS.market_title)} * 12 + {sql_hits('low', TERMS.market_body)} * 5
     + CASE WHEN {sql_any('low', ('missing_or_unparsed_date', 'missing_published_datetime'))} THEN 8 ELSE 0 END + CASE WHEN length(al) < 150 THEN 6 ELSE 0 END AS DOUBLE)) AS negative,
  ({sql_any('low', TERMS.low_scope_consumer)} AND NOT {sql_any('low', TERMS.core_topic)}) AS consumer, {sql_excluded('lt', 'lx')} AS excluded
  FROM (SELECT *, CAST(CASE WHEN source_priority = 0 THEN 1 ELSE source_priority END AS DOUBLE) AS p FROM rg))"""
_TOTAL = f"CASE WHEN excluded THEN 0.0{_D} ELSE round_even(least(CASE WHEN consumer THEN 32.0{_D} ELSE 100.0{_D} END, greatest(0.0{_D}, relevance + info + strategy + novelty + authority + compilable + policy + region_bonus - negative - region_penalty)), 1)::DOUBLE END"




def sql_scored(rows: str) -> str:
    """Rows of the given query, which has the columns of an article, with their parts and score."""
    return f"(WITH art AS ({rows}){_PARTS.removeprefix(ART)} SELECT *, {_TOTAL} AS score FROM pt)"


@query("f27_score_parts", f"WITH {_PARTS} SELECT seq, relevance, info, strategy, novelty, authority, compilable, policy FROM pt")
def f27(spark, d):
    return score_parts(articles(spark, d), SETTINGS).select("seq", *[F.col(f"part_{c}").alias(c) for c in ("relevance", "info", "strategy", "novelty", "authority", "compilable", "policy")])


@query("f28_region_preference", f"WITH {_PARTS} SELECT seq, region_bonus, region_penalty, entity AS region_entity, home AND NOT entity AS from_region FROM pt")
def f28(spark, d):
    return score_parts(articles(spark, d), SETTINGS).select("seq", *[F.col(f"part_{c}").alias(c) for c in ("region_bonus", "region_penalty", "region_entity", "from_region")])


@query("f29_negative_penalty", f"WITH {_PARTS} SELECT seq, negative FROM pt")
def f29(spark, d):
    return score_parts(articles(spark, d), SETTINGS).select("seq", F.col("part_negative_penalty").alias("negative"))


@query("f30_excluded_topic", f"WITH {_PARTS} SELECT seq, consumer, excluded FROM pt")
def f30(spark, d):
    return score_parts(articles(spark, d), SETTINGS).select("seq", F.col("part_consumer").alias("consumer"), F.col("part_excluded").alias("excluded"))


@query("f32_total_score", f"WITH {_PARTS} SELECT seq, {_TOTAL} AS score FROM pt")
def f32(spark, d):
    return score_articles(articles(spark, d), SETTINGS).select("seq", "score")


_LABELS = f"""concat_ws('；', CASE WHEN relevance > 0 THEN '方向相关' END, CASE WHEN info > 0 THEN '信息具体' END, CASE WHEN strategy > 0 THEN '具战略意义' END, CASE WHEN novelty > 0 THEN '有新颖性' END, CASE WHEN authority > 0 THEN '来源较权威' END, CASE WHEN compilable > 0 THEN '材料可编译' END,
 CASE WHEN policy > 0 THEN '重点政策/科研资助信息' END, CASE WHEN entity THEN 'Japan相关' END, CASE WHEN home AND NOT entity THEN 'Japan来源' END, CASE WHEN negative > 0 THEN '低相关内容降权' END, CASE WHEN consumer THEN '普通消费/食品商业新闻降权' END, CASE WHEN excluded THEN '非科委要闻主题，已排除' END, CASE WHEN region_penalty > 0 THEN '非当前 Profile 重点地区内容降权' END)"""


@query("f34_explanation", f"WITH {_PARTS} SELECT seq, {_LABELS} AS reason FROM pt")
def f34(spark, d):
    return score_articles(articles(spark, d), SETTINGS).select("seq", F.col("recommended_reason").alias("reason"))


@query("f35_suggested_classes", f"""WITH {_PARTS} SELECT seq, CASE WHEN {_kw_hit('low', 'license')} OR {_kw_hit('low', 'erons')} OR contains(low, 'policy') OR contains(low, '政策') THEN '政策' WHEN {_kw_hit('low', '@')} OR {_kw_hit('low', 'hath')} OR {sql_any('low', TERMS.industry_text)} THEN '产业' ELSE '技术' END AS kind,
 CASE WHEN {sql_any('al', TERMS.soft_text)} THEN '软科学' ELSE '硬科学' END AS soft_hard FROM pt""")
def f35(spark, d):
    return score_articles(articles(spark, d), SETTINGS).select("seq", F.col("suggested_type").alias("kind"), F.col("suggested_soft_hard").alias("soft_hard"))


_REF = "least(10.0::DOUBLE, least(5.0::DOUBLE, value / 100 * 5) + least(5.0::DOUBLE, (event_id % 5) * 1.5::DOUBLE)) / 10 * 100"


@query("f33_reference_score", f"SELECT event_id, round_even(CAST(CAST({_REF} AS VARCHAR) AS DECIMAL(30, 18)), 1)::DOUBLE AS reference_score FROM events")
def f33(spark, d):
    """Ties are decided on the decimal digits shown, on both sides."""
    history = F.least(F.lit(5.0), (F.col("event_id") % 5) * F.lit(1.5))
    e = table(spark, d, "events")
    return e.select("event_id", sc.reference_score(sc.similarity_bonus(F.col("value") / 100), history).alias("reference_score"))


@query("j9_title_similarity")
def j9(spark, d):
    """Best ratio of every article title against every historical sample title."""
    a = articles(spark, d).select("seq", "title_original")
    return best_similarity(a, samples(spark, d), "title_original", "title").select("seq", F.round("title_similarity", 4).alias("similarity"))


@query("a9_near_duplicates")
def a9(spark, d):
    scored = score_articles(articles(spark, d), SETTINGS)
    return near_duplicates(scored).select("seq", F.col("run_date").cast("string").alias("run_date"), "score", "duplicate_group", "group_size")


@query("u5_term_intersection", f"WITH l AS (SELECT doc_id, {_DOC_LOW} AS low FROM documents) SELECT doc_id, CAST({sql_hits('low', ['license', 'bles', 'ai'])} AS INTEGER) AS shared FROM l")
def u5(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.lower(clean("text")).alias("low")).withColumn("m", kw.match_keywords("low", KEYWORDS))
    known = F.array(F.lit("license"), F.lit("bles"), F.lit("ai"), F.lit("absent"))
    return doc.select("doc_id", F.size(F.array_intersect(kw.matched_terms("m"), known)).alias("shared"))


_COMB = "lower(t || ' ' || source)"
_RANK = f"({_TOTAL} + CASE WHEN {sql_any(_COMB, RANKED.high_value_terms)} THEN 80.0{_D} ELSE 0.0{_D} END + CASE WHEN contains(source, 'src1') OR contains(source, 'src7') THEN 35.0{_D} ELSE 20.0{_D} END + CASE WHEN contains({_COMB}, 'que') OR contains({_COMB}, 'bles') THEN 30.0{_D} ELSE 0.0{_D} END)"


@query("t6_link_ranking", f"WITH {_PARTS} SELECT seq, {_RANK} AS link_rank_score FROM pt ORDER BY link_rank_score DESC, seq LIMIT 60")
def t6(spark, d):
    scored = score_articles(articles(spark, d), SETTINGS, keep=("seq",)).withColumn("source_section", F.col("source"))
    return lk.rank_links(scored, RANKED, 60).select("seq", "link_rank_score")


@query("u7_rescore_pool", f"WITH {_PARTS} SELECT seq, {_TOTAL} AS score, CASE WHEN seq % 2 = 0 THEN 'kept' ELSE '' END || CASE WHEN seq % 2 = 1 THEN substr(sha1(url), 1, 12) ELSE '' END AS candidate_id, {_kw_text('low')} AS matched_keywords FROM pt")
def u7(spark, d):
    pool = articles(spark, d).withColumn("candidate_id", F.when(F.col("seq") % 2 == 0, "kept").otherwise("")).withColumn("score", F.lit(1.0))
    return rescore_pool(pool, SETTINGS).select("seq", "score", "candidate_id", "matched_keywords")


@query("c5_score_all")
def c5(spark, d):
    return score_all(articles(spark, d), SETTINGS, samples(spark, d)).select("seq", "score", "duplicate_group", "reference_similarity_score", "suggested_type")


def reported(spark, d):
    a = articles(spark, d).where(F.col("seq") % 11 == 0)
    return a.select("url", F.date_sub("run_date", (F.col("seq") % 3).cast("int")).alias("date"))


@query("c4_candidates")
def c4(spark, d):
    pool = candidates(articles(spark, d), SETTINGS, samples(spark, d), reported(spark, d))
    return pool.select(F.col("run_date").cast("string").alias("run_date"), "seq", "score", "duplicate_group", "recommended_reason", "matched_keywords", "suggested_type", "extraction_warning")


# the two pools of one day, gated, as the articles that are scored
_POOL = f"""pool AS (SELECT * REPLACE (pool_no * (1::BIGINT << 60) + seq AS seq, CASE WHEN st = 'boundary_date_without_time' THEN CASE WHEN extraction_warning = '' THEN st ELSE extraction_warning || '; ' || st END ELSE extraction_warning END AS extraction_warning)
  FROM (SELECT *, {sql_status('published_ts', 'has_time')} AS st FROM (
    SELECT * REPLACE (DATE '2024-01-09' AS run_date), 0 AS pool_no FROM art WHERE source_type = 'login_browser'
    UNION ALL SELECT * REPLACE (DATE '2024-01-09' AS run_date), 1 FROM art WHERE source_type <> 'official'))
  WHERE st IN ('within_collection_window', 'within_collection_window_date_only', 'boundary_date_without_time') AND length(trim(raw_text)) >= 250
    AND url NOT IN (SELECT url FROM art WHERE seq % 11 = 0 AND run_date - CAST(seq % 3 AS INTEGER) < DATE '2024-01-09')
    AND NOT {sql_excluded(f"lower({sql_clean('title_original')})", f"lower({sql_clean('raw_text')})")})"""
_POOL_PARTS = _PARTS.replace(ART, f"{ART}, {_POOL}").replace("FROM art), al", "FROM pool), al").replace("FROM art),\nal", "FROM pool),\nal")


@query("c6_combine_pools", f"""WITH {_POOL_PARTS}, k AS (SELECT *, {_TOTAL} AS score, row_number() OVER (PARTITION BY url ORDER BY {_TOTAL} DESC, seq) AS place, min(seq) OVER (PARTITION BY url) AS first_seq FROM pt),
b AS (SELECT *, CASE WHEN contains(lower(source), 'src7') THEN 'src7' WHEN country_region = 'Japan' THEN 'japan' WHEN country_region = 'Korea' THEN 'korea' ELSE 'other' END AS bucket FROM k WHERE place = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, first_seq) - 1 AS rn FROM b)
SELECT substr(sha1(url), 1, 12) AS candidate_id, score, source, bucket, CAST(CASE bucket WHEN 'src7' THEN rn // 2 ELSE rn END AS BIGINT) AS cycle, CAST(CASE bucket WHEN 'src7' THEN rn % 2 WHEN 'japan' THEN 2 WHEN 'korea' THEN 3 ELSE 4 END AS BIGINT) AS slot FROM r""")
def c6(spark, d):
    """Two overlapping pools of one day united for review."""
    day = "2024-01-09"
    a = articles(spark, d)
    pools = {"ranked": a.where(F.col("source_type") == "login_browser"), "public": a.where(F.col("source_type") != "official")}
    got = combine_pools(pools, day, SETTINGS, None, reported(spark, d), first_source="src7", regions=[("Japan", "japan"), ("Korea", "korea")], quotas=[("src7", 2), ("japan", 1), ("korea", 1), ("other", 1)])
    return got.select("candidate_id", "score", "source", "bucket", F.col("cycle").cast("bigint").alias("cycle"), F.col("slot").cast("bigint").alias("slot"))
