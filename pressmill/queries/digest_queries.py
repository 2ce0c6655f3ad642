"""Requests, responses, quality gate, repair and translation over the article view."""

import json

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.config import Profile
from pressmill.functions.text import needs_translation
from pressmill.operators import digests as dg
from pressmill.plans.digests import digests
from pressmill.queries.base import ART, articles, query, sql_clean, table

LOOSE = Profile(require_simplified_chinese=False, max_summary_chars=100)
STRICT = Profile()
_LONG = "本研究团队针对能源材料寿命不足的问题开发了新型制备方法并在工厂完成验证结果显示成本下降百分之三十寿命提高两倍预计明年投入使用"


def _digest_rows(spark, d):
    k = F.col("seq") % 7
    a = articles(spark, d)
    summary = (
        F.when(k == 0, "").when(k == 1, F.lit(_LONG)).when(k == 2, F.concat(F.lit(_LONG), F.lit("ニュース"))).when(k == 3, F.concat(F.lit(_LONG), F.lit("建议结合原文链接复核")))
        .when(k == 4, F.lit(_LONG[:30])).when(k == 5, F.col("raw_text")).otherwise(F.lit(_LONG))
    )
    return a.withColumn("title_cn", F.lit("科技标题")).withColumn("summary_cn", summary)


@query("p21_quality_gate", f"WITH {ART} SELECT seq, CASE seq % 7 WHEN 0 THEN '标题或摘要为空' WHEN 1 THEN '' WHEN 2 THEN '标题或摘要不是完整简体中文' WHEN 3 THEN '检测到通用占位文字：建议结合原文链接复核' WHEN 4 THEN '摘要中的有效中文信息过少' WHEN 5 THEN CASE WHEN {sql_clean('raw_text')} = '' THEN '标题或摘要为空' ELSE '标题或摘要不是完整简体中文' END ELSE '' END AS issue, CASE WHEN seq % 7 = 0 OR (seq % 7 = 5 AND {sql_clean('raw_text')} = '') THEN '标题或摘要为空' WHEN seq % 7 = 3 THEN '检测到通用占位文字：建议结合原文链接复核' WHEN seq % 7 = 5 AND length({sql_clean('raw_text')}) >= 80 THEN '' ELSE 'Summary contains too little information' END AS loose FROM art")
def p21(spark, d):
    rows = _digest_rows(spark, d)
    return rows.select("seq", dg.quality_issue("title_cn", "summary_cn", STRICT).alias("issue"), dg.quality_issue("title_cn", "summary_cn", LOOSE).alias("loose"))


@query("p23_translation_targets", f"WITH {ART} SELECT seq FROM art WHERE trim(title_original) <> '' AND (seq % 3 = 0 OR seq % 5 = 0) AND seq % 2 = 0")
def p23(spark, d):
    a = articles(spark, d)
    title = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("한국 "), F.col("title_original"))).otherwise(F.col("title_original"))
    language = F.when(F.col("seq") % 3 == 0, "KO").otherwise("ja")
    done = F.when(F.col("seq") % 2 == 0, F.lit("한국 科技")).otherwise(F.concat(F.lit("科技 "), F.col("seq").cast("string")))
    return a.where(F.trim("title_original") != "").where(needs_translation(title, done, language)).select("seq")


@query("m2_requests", f"WITH {ART} SELECT seq, title_original AS title, source, url, language, {sql_clean('raw_text')} AS news_text FROM art")
def m2(spark, d):
    a = articles(spark, d)
    asked = a.select("seq", F.from_json(dg.request_json(a), "title_original string, source string, url string, language string, news_text string").alias("r"))
    return asked.select("seq", F.col("r.title_original").alias("title"), "r.source", "r.url", "r.language", "r.news_text")


def echo_model(requests):
    """Stand-in for a model: answers from the request alone, fails on some inputs."""
    answers = []
    for text in requests:
        r = json.loads(text)
        n = int(r["url"].rsplit("/", 1)[1])
        if n % 10 == 9:
            raise RuntimeError("model refused")
        body = {"title_cn": f"Title {n}", "keywords": f"a{n}, b", "type": "政策" if n % 2 else "other"}
        body["summary_cn"] = r["news_text"][:150] if n % 3 else ""
        answers.append(("Here it is: " if n % 4 == 0 else "") + json.dumps(body, ensure_ascii=False))
    return answers


_N = "seq % 10 = 9"


@query("m1_with_generated", f"WITH {ART} SELECT seq, CASE WHEN {_N} THEN 'model refused' END AS error, NOT ({_N}) AS answered FROM art")
def m1(spark, d):
    a = articles(spark, d)
    got = dg.with_generated(a.select("seq", dg.request_json(a).alias("request")), echo_model)
    return got.select("seq", "error", F.col("response").isNotNull().alias("answered"))


@query("m3_normalise_response", f"""WITH {ART}, x AS (SELECT *, {sql_clean('raw_text')} AS x FROM art WHERE NOT ({_N}))
SELECT seq, 'Title ' || seq AS title_cn, substr({sql_clean("CASE WHEN seq % 3 <> 0 AND substr(x, 1, 150) <> '' THEN substr(x, 1, 150) ELSE substr(raw_text, 1, 500) END")}, 1, 100) AS summary_cn, 'a' || seq || '/b' AS keywords, CASE WHEN seq % 2 = 1 THEN '政策' ELSE 'other' END AS type, '硬科学' AS soft_hard FROM x""")
def m3(spark, d):
    a = articles(spark, d)
    got = dg.with_generated(a.withColumn("request", dg.request_json(a)), echo_model).where(F.col("error").isNull())
    out = dg.normalize_response(got, LOOSE)
    return out.select("seq", "title_cn", "summary_cn", F.array_join("keywords", "/").alias("keywords"), "type", "soft_hard")


def repairing_model(requests):
    """Bad first answers for some rows; a repair request succeeds for half of them."""
    answers = []
    for text in requests:
        r = json.loads(text)
        n = int(r["url"].rsplit("/", 1)[1]) if "url" in r else None
        good = {"title_cn": "科技标题", "summary_cn": _LONG, "keywords": ["能源"], "type": "技术", "soft_hard": "硬科学"}
        bad_script = {**good, "summary_cn": _LONG + "カナ"}
        if n is None:  # clean-up request: the previous text comes back without kana
            answers.append(json.dumps({**good, "title_cn": r["title_cn"]}, ensure_ascii=False))
        elif "repair_attempt" in r:
            answers.append(json.dumps(good if n % 2 else bad_script if n % 3 else {**good, "summary_cn": "短"}, ensure_ascii=False))
        else:
            answers.append(json.dumps(good if n % 4 == 0 else bad_script, ensure_ascii=False))
    return answers


@query("m4_repair_routing", f"WITH {ART} SELECT seq, seq % 4 = 0 OR seq % 2 = 1 OR seq % 3 <> 0 AS accepted FROM art")
def m4(spark, d):
    got = dg.generate(articles(spark, d), repairing_model, STRICT)
    return got.select("seq", (F.col("issue") == "").alias("accepted"))


@query("m5_fallback_digest", f"WITH {ART} SELECT seq, CASE WHEN seq % 2 = 0 THEN source || '发布' || 'key' || seq || '相关科技动态' ELSE source || '发布技术相关科技动态' END AS title_cn, source || '发布一项与' || CASE WHEN seq % 2 = 0 THEN 'key' || seq || '、second' ELSE '技术' END || '相关的科技动态。该消息来自已选候选新闻，涉及科技政策、产业应用或前沿技术进展，可作为当日科技要闻线索，建议结合原文链接复核具体细节。' AS summary_cn FROM art")
def m5(spark, d):
    a = articles(spark, d).withColumn("matched_keywords", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("cat: key"), F.col("seq").cast("string"), F.lit(", second, カナ"))).otherwise(""))
    return dg.with_fallback_digest(a.withColumn("suggested_type", F.lit("技术"))).select("seq", "title_cn", "summary_cn")


@query("m6_quality_report", f"WITH {ART} SELECT seq % 7 AS k, issue, CAST(count(*) AS BIGINT) AS n FROM (SELECT seq, CASE seq % 7 WHEN 0 THEN '标题或摘要为空' WHEN 2 THEN '标题或摘要不是完整简体中文' WHEN 3 THEN '检测到通用占位文字：建议结合原文链接复核' WHEN 4 THEN '摘要中的有效中文信息过少' WHEN 5 THEN CASE WHEN {sql_clean('raw_text')} = '' THEN '标题或摘要为空' ELSE '标题或摘要不是完整简体中文' END END AS issue FROM art) WHERE issue IS NOT NULL GROUP BY ALL")
def m6(spark, d):
    rows = _digest_rows(spark, d).withColumn("generation_mode", F.lit("model"))
    rows = rows.withColumn("issue", dg.quality_issue("title_cn", "summary_cn", STRICT))
    report = dg.quality_report(rows).withColumn("k", F.substring_index("url", "/", -1).cast("bigint") % 7)
    return report.groupBy("k", "issue").agg(F.count(F.lit(1)).alias("n"))


def translating_model(requests):
    """Answers batches of many titles badly, single ones well."""
    answers = []
    for text in requests:
        r = json.loads(text)
        n = int(r["candidate_id"][1:])
        title = {0: f"科技 {n}", 1: "한국어만", 2: f"科技 한국 {n}"}[n % 3] if len(requests) > 1 or n % 3 != 1 or n % 2 else f"补充 {n}"
        answers.append(json.dumps({"title_cn": title}, ensure_ascii=False))
    return answers


@query("m7_translate_titles", f"""WITH {ART} SELECT seq, CASE WHEN seq % 4 <> 0 THEN '' WHEN seq % 3 = 0 THEN '科技 ' || seq WHEN seq % 3 = 2 THEN '科技 Hanguk ' || seq WHEN seq % 2 = 0 THEN '补充 ' || seq ELSE '' END AS translated FROM art""")
def m7(spark, d):
    a = articles(spark, d).withColumn("candidate_id", F.concat(F.lit("c"), F.col("seq").cast("string"))).withColumn("title_translated_candidate", F.lit(""))
    a = a.withColumn("title_original", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("한국 "), F.col("title_original"))).otherwise(F.col("title_original"))).withColumn("language", F.lit("ja"))
    return dg.translate_titles(a, translating_model).select("seq", F.col("title_translated_candidate").alias("translated"))


@query("m8_demo_digest", f"WITH {ART}, x AS (SELECT *, {sql_clean('raw_text')} AS x FROM art) SELECT seq, {sql_clean('title_original')} AS title_cn, CASE WHEN length(x) > 200 THEN rtrim(substr(x, 1, 200)) || '。' WHEN x = '' THEN '该新闻包含科技政策、产业或技术动态信息，建议人工复核后补充摘要正文。' ELSE x END AS summary_cn FROM x")
def m8(spark, d):
    return dg.with_demo_digest(articles(spark, d), allow_demo=True).select("seq", "title_cn", "summary_cn")


@query("c9_digests", f"""WITH {ART} SELECT seq, CAST(run_date AS VARCHAR) AS run_date, CAST(row_number() OVER (PARTITION BY run_date ORDER BY seq) AS BIGINT) AS order_index, '科技标题' AS title_cn, '' AS issue
FROM art WHERE seq % 2 = 0 AND (seq % 4 = 0 OR seq % 3 <> 0)""")
def c9(spark, d):
    """Accepted digests of the reviewed half of the articles, numbered per run date."""
    a = articles(spark, d).withColumn("candidate_id", F.concat(F.lit("c"), F.col("seq").cast("string")))
    reviewed = a.withColumn("selected", F.when(F.col("seq") % 2 == 0, "yes").otherwise("")).drop("language")
    pages = a.select("url", F.concat(F.lit("<html><head><title>T</title></head><body><article>"), F.col("raw_text"), F.lit("</article></body></html>")).alias("html"))
    good, _, _ = digests(reviewed, a.select("candidate_id", "language"), pages, repairing_model)
    return good.select("seq", F.col("run_date").cast("string").alias("run_date"), "order_index", "title_cn", "issue")
