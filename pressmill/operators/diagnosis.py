"""Health of configured sources from crawled entry pages and sample articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators.keyed import first_per_key, top_per_key
from pressmill.functions.urls import url_host, url_path

MIN_SAMPLE_TEXT = 250

# fixed values: recommendation texts per status
READY = "入口发现和正文抽取均通过，可以添加并启用。"
WARNING = "已发现候选链接，但样本正文抽取不稳定；建议先保存为禁用配置并检查页面结构。"
NEEDS_RULES = "入口可以访问，但没有识别出文章链接；请换成更具体的栏目/RSS，或配置链接选择器与 URL 规则。"
UNREACHABLE = "入口无法访问；请检查 URL、网络、robots/服务条款或站点访问限制。"
NEEDS_ADAPTER = "该网站需要登录；公开版只能检查入口，正式采集需要合法登录会话和专用适配器。"
FEED_FOUND = "检测到 RSS/Atom，可另行诊断并优先使用："


def distinct_candidates(links: DataFrame, *, source: str = "source", url: str = "url", seq: str = "seq") -> DataFrame:
    return first_per_key(links.where(F.coalesce(F.col(url), F.lit("")) != ""), [source, url], [seq])


def suggested_patterns(candidates: DataFrame, *, source: str = "source", url: str = "url", seq: str = "seq", sample: int = 30) -> DataFrame:
    """Include pattern per source from the first candidates: commonest first segment and host."""
    heads = top_per_key(candidates.select(source, url, seq), [source], [F.col(seq)], sample, seq=seq)
    parts = heads.select(
        source, seq, url_host(url).alias("host"),
        F.nullif(F.regexp_extract(url_path(url), "^/*([^/]+)", 1), F.lit("")).alias("segment"),
    )

    def commonest(column: str) -> DataFrame:
        counts = parts.where(F.col(column).isNotNull()).groupBy(source, column).agg(
            F.count(F.lit(1)).alias("n"), F.min(seq).alias("first")
        )
        return counts.groupBy(source).agg(
            F.min_by(F.struct(F.col(column), F.col("n")), F.struct(-F.col("n"), F.col("first"))).alias(column)
        )

    sizes = parts.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"))
    joined = sizes.join(commonest("segment"), source).join(commonest("host"), source)
    enough = (F.col("rows") >= 3) & (F.col("segment.n") >= F.greatest(F.lit(3), F.floor(F.col("segments") / 2)))
    quoted = lambda c: F.regexp_replace(c, r"([()\[\]{}?*+\-|^$\\.&~#\s])", r"\\$1")
    pattern = F.concat(F.lit("^https?://"), quoted(F.col("host.host")), F.lit("/"), quoted(F.col("segment.segment")), F.lit("/"))
    return joined.where(enough).select(source, pattern.alias("include_url_pattern"))


def diagnose(sources: DataFrame, entries: DataFrame, candidates: DataFrame, feeds: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per source: status, counts, examples, feeds, recommendation, suggested pattern.

    ``entries``: ``source, reachable, error, entry_no``; ``candidates``: ``source, url,
    title, seq``; ``feeds``: ``source, feed_url, seq``; ``samples``: ``source, title,
    text_chars`` of a few fetched candidates.
    """
    unique = distinct_candidates(candidates)
    per_entry = entries.groupBy("source").agg(F.bool_or("reachable").alias("reachable"))
    first_errors = top_per_key(entries.where(F.col("error") != ""), ["source"], [F.col("entry_no")], 5, seq="entry_no")
    errors = first_errors.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("entry_no", "error")))["error"].alias("errors"))
    counts = unique.groupBy("source").agg(F.count(F.lit(1)).alias("candidate_count"))
    examples = top_per_key(unique, ["source"], [F.col("seq")], 8, seq="seq").groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("seq", "url", "title"))).alias("candidate_examples")
    )
    found = top_per_key(first_per_key(feeds, ["source", "feed_url"], ["seq"]), ["source"], [F.col("seq")], 8, seq="seq")
    found = found.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("seq", "feed_url")))["feed_url"].alias("detected_feeds"))
    passed = samples.groupBy("source").agg(
        F.count_if((F.coalesce("title", F.lit("")) != "") & (F.col("text_chars") >= MIN_SAMPLE_TEXT)).alias("passed_samples")
    )
    out = sources.select(F.col("name").alias("source"), "source_type", "requires_login")
    for table in (per_entry, errors, counts, examples, found, passed, suggested_patterns(unique)):
        out = out.join(table, "source", "left")
    login = F.col("requires_login") | (F.col("source_type") == "login_browser")
    reachable = F.coalesce("reachable", F.lit(False))
    any_candidate = F.coalesce("candidate_count", F.lit(0)) > 0
    any_pass = F.coalesce("passed_samples", F.lit(0)) > 0
    status = (
        F.when(login, "needs_adapter").when(reachable & any_candidate & any_pass, "ready")
        .when(reachable & any_candidate, "warning").when(reachable, "needs_rules").otherwise("unreachable")
    )
    advice = (
        F.when(F.col("status") == "needs_adapter", NEEDS_ADAPTER).when(F.col("status") == "ready", READY)
        .when(F.col("status") == "warning", WARNING).when(F.col("status") == "needs_rules", NEEDS_RULES)
        .otherwise(UNREACHABLE)
    )
    feed_tip = F.when(
        (F.col("status") != "needs_adapter") & (F.col("source_type") != "rss") & (F.size("detected_feeds") > 0),
        F.concat(F.lit(FEED_FOUND), F.get("detected_feeds", F.lit(0))),
    )
    shown = ~login
    return out.withColumn("status", status).select(
        "source", "status", (shown & reachable).alias("reachable"),
        F.when(shown, F.coalesce("candidate_count", F.lit(0))).otherwise(0).alias("candidate_count"),
        "candidate_examples", "detected_feeds", "errors",
        F.coalesce("passed_samples", F.lit(0)).alias("passed_samples"), "include_url_pattern",
        F.array_compact(F.array(advice, feed_tip)).alias("recommendations"),
    )
