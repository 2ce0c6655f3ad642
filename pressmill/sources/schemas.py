"""Declared schemas of the tables the engine reads."""

PAGE = "url string, html string"
FEED = "url string, xml string"

SOURCE = (
    "name string, country_region string, language string, section_url string, source_type string, "
    "requires_login boolean, priority int, base_url string, tags array<string>, discovery_urls array<string>, "
    "link_selectors array<string>, include_url_patterns array<string>, exclude_url_patterns array<string>, "
    "rate_limit_seconds double, max_articles_per_run int, enabled boolean, tightly_scoped boolean"
)

LINK = (
    "source string, source_type string, source_priority int, country_region string, language string, "
    "base_url string, url string, source_domain string, title_original string, published_date string, "
    "tags array<string>, rate_limit_seconds double, max_articles_per_run int, extraction_warning string"
)

ARTICLE = (
    "title_original string, source string, country_region string, language string, published_date string, "
    "url string, raw_text string, raw_text_preview string, source_priority int, source_type string, "
    "source_domain string, tags array<string>, extraction_warning string, max_articles_per_run string"
)

DIGEST = (
    "candidate_id string, title_cn string, summary_cn string, keywords array<string>, type string, "
    "soft_hard string, source string, url string, source_text_chars int, generation_mode string, "
    "order_index int, title_original string"
)

REFERENCE = (
    "source_file string, date_block string, title_cn string, summary_cn string, url string, "
    "source_domain string, keywords_candidate array<string>, type_candidate string, "
    "soft_hard_candidate string, week string, weekly_accepted_count string, monthly_report_count string"
)

PARAGRAPH = "doc_id string, paragraph_index int, text string, highlighted boolean"

RSS = "channel struct<item:array<struct<link:string,title:string,pubDate:string,updated:string,created:string,description:string,summary:string>>>"
ATOM = (
    "entry array<struct<link:array<struct<_href:string,_rel:string>>,title:string,published:string,"
    "updated:string,created:string,summary:string>>"
)

# fixed values: header names a field may have in an imported sheet
MANUAL_ALIASES = {
    "title_original": ("title", "标题", "title_original"),
    "url": ("url", "URL", "链接"),
    "raw_text": ("raw_text", "正文", "content"),
    "published_date": ("published_date", "发布日期"),
}
ACCEPTED_ALIASES = {
    "title": ("title", "标题", "title_cn", "中文标题", "title_original", "原始标题"),
    "keywords": ("keywords", "关键词", "matched_keywords"),
    "type": ("type", "类型"),
    "soft_hard": ("soft_hard", "软/硬科学", "软硬科学"),
}
REFERENCE_ALIASES = {
    "date_block": ("日期", "date", "published_date"),
    "title_cn": ("被采纳要闻题目", "标题", "题目", "title", "title_cn"),
    "summary_cn": ("摘要", "summary", "summary_cn"),
    "url": ("URL", "url", "链接"),
    "keywords_candidate": ("关键词", "keywords", "matched_keywords"),
    "type_candidate": ("类型", "type"),
    "soft_hard_candidate": ("软/硬科学", "软硬科学", "soft_hard"),
    "week": ("周次", "week"),
    "weekly_accepted_count": ("周采纳总数",),
    "monthly_report_count": ("月采纳/上报数",),
}
