"""The page parser on broken and large pages, and sources taking turns."""

import time

import pandas as pd
from pyspark.sql import functions as F

from pressmill.functions import html
from pressmill.functions.selectors import select
from pressmill.plans.digests import merge_cumulative
from pressmill.plans.discover import diagnose_sources, legacy_fetch, settled
from pressmill.sources.registry import sources_from_pages


def texts(page, selector):
    return [n.text() for n in select(html.parse(page), selector)]


def test_selectors():
    page = "<div class='c a'><p class=d><a href=x>1</a></p><span>s</span><a href=y rel='z q'>2</a></div><a lang=en-US class=x>3</a>"
    assert texts(page, "div > a") == ["2"]
    assert texts(page, "div.c a, p.d a") == ["1", "2"]
    assert texts(page, "a:not(.x)") == ["1", "2"]
    assert texts(page, "a:not([rel], .x)") == ["1"]
    assert texts(page, "[rel~=q]") == texts(page, "span + a") == texts(page, "p ~ a") == ["2"]
    assert texts(page, "[lang|=en]") == ["3"] and texts(page, "[href^=x], [href$='y']") == ["1", "2"]
    assert texts(page, "a[[") == texts(page, "a:hover") == texts(page, "> a") == texts(page, "") == []
    assert texts("<ul><li>1</li><li>2</li></ul>", "li:first-child") == ["1"]


def test_broken_markup_does_not_end_a_job():
    assert html.parse("<![foo[bar]]><p>x</p>").text() == "x"
    assert html.parse("<![ foo").text() == ""
    assert html.parse("<![CDATA[x]]><p>z</p>").text() == "z"
    assert html.parse(None).text() == ""
    feeds = html.page_feeds.func(pd.Series(["<link rel=alternate type='application/rss+xml' href='http://[bad'>"]), pd.Series(["http://h"]))
    assert feeds[0] == ["http://[bad"]
    links = html.page_links.func(pd.Series(["<a href='/x'>t</a>"]), pd.Series(["http://[bad"]), pd.Series([None]))
    assert links[0][0]["url"] == "/x"


def test_thousands_of_image_links():
    cards = "".join(f"<div class=card><a href='/{i}'><img src=x></a><p>text {i}</p></div>" for i in range(5000))
    start = time.process_time()
    links = html.page_links.func(pd.Series([f"<main>{cards}</main>"]), pd.Series(["http://h"]), pd.Series([None]))[0]
    assert [x["title"] for x in links[:3]] == ["text 0", "text 1", "text 2"] and len(links) == 5000
    assert time.process_time() - start < 10


def test_sources_take_turns(spark):
    rows = [("A", 0, k, f"u{k}", 3) for k in (1, 2, 3)] + [("B", 1, k, f"u{k}", 3) for k in range(1, 7)] + [("C", 2, k, f"u{k}", 3) for k in (4, 5, 6)]
    rows = spark.createDataFrame(rows, "source string, source_no int, seq long, url string, scan int")
    active = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "name string, source_no int")
    previous = spark.createDataFrame([("C", 1, "u9"), ("C", 2, "u5"), ("B", 1, "u8"), ("X", 1, "u7")], "source string, seq long, url string")
    stored = spark.createDataFrame([], "url string, run_date date")
    day = F.lit("2024-01-09").cast("date")
    kept = lambda p: sorted((r.source, r.url, r.carried_over) for r in settled(rows, active, p, stored, day).collect())
    first = [("A", f"u{k}", False) for k in (1, 2, 3)] + [("B", f"u{k}", False) for k in (4, 5, 6)]
    assert kept(None) == first
    # C is silent: what it had before stays, but for what B keeps now
    assert kept(previous) == [*first, ("C", "u9", True)]


def test_blocks_of_a_day_are_numbered_from_one(spark):
    kind = "date date, block_seq long, pos long, url string, title_cn string, summary_cn string"
    from datetime import date

    old = spark.createDataFrame([(date(2024, 1, 1), 0, 1, "u1", "t1", "s"), (date(2024, 1, 2), 0, 1, "u1", "again", "s"), (date(2024, 1, 2), 0, 2, "u2", "t2", "s")], kind)
    new = spark.createDataFrame([(date(2024, 1, 3), 0, 1, "u3", "t3", "s")], kind)
    _, text = merge_cumulative(old, new, "2024-01-03")
    lines = [r.text for r in text.collect() if r.part == 0 and r.order_index > 0]
    assert lines == ["1.t1", "1.t2", "1.t3"]


def test_diagnosis_reads_feeds(spark):
    rss = "<?xml version='1.0'?><rss><channel>" + "".join(f"<item><title>story {k}</title><link>https://other.org/a/{k}</link></item>" for k in (1, 2, 2)) + "<item><title>off</title><link>https://other.org/b/1</link></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>story</title><link href='https://e.com/a/9'/></entry></feed>"
    listing = "<main><a href='/a/7'>story seven</a></main>"
    entries = {"given": "rss", "among": "rss", "xml": "html", "site": "html", "broken": "rss", "absent": "rss"}
    rows = [(n, kind, "", "", False, [], ["/a/"], [], [f"https://e.com/{n}"]) for n, kind in entries.items()]
    sources = spark.createDataFrame(rows, "name string, source_type string, base_url string, section_url string, requires_login boolean, link_selectors array<string>, include_url_patterns array<string>, exclude_url_patterns array<string>, discovery_urls array<string>")
    story = "<html><head><title>Story</title></head><body><article><p>" + "word and word " * 60 + "</p></article></body></html>"
    pages = spark.createDataFrame([("https://e.com/among", rss), ("https://e.com/site", listing), ("https://other.org/a/1", story)], "url string, html string")
    feeds = spark.createDataFrame([("https://e.com/given", rss), ("https://e.com/xml", atom), ("https://e.com/broken", "<rss><broken")], "url string, xml string")
    got = {r.source: (r.status, r.candidate_count) for r in diagnose_sources(sources, pages, feeds=feeds).collect()}
    assert got == {"given": ("ready", 2), "among": ("ready", 2), "xml": ("warning", 1), "site": ("warning", 1), "broken": ("needs_rules", 0), "absent": ("unreachable", 0)}
    alone = {r.source: r.status for r in diagnose_sources(sources, pages).collect()}
    assert (alone["given"], alone["among"], alone["site"]) == ("unreachable", "ready", "warning")


def test_older_fetch_parses_opened_pages_only(spark):
    listing = "<main><ul>" + "".join(f"<li><a href='/news/{i}'>{t}</a></li>" for i, t in ((1, "a story of the first page"), (2, "a story of the other page"))) + "</ul></main>"
    pages = [("http://h.example/", listing)] + [(f"http://h.example/news/{i}", f"<title>t{i}</title><article>text {i}</article>") for i in range(1, 40)]
    pages = spark.createDataFrame(pages, "url string, html string")
    got = legacy_fetch(pages, None, None, sources_from_pages(pages)).select("url", "title_original", "raw_text")
    assert sorted(map(tuple, got.collect())) == [
        ("http://h.example/news/1", "a story of the first page", "text 1"), ("http://h.example/news/2", "a story of the other page", "text 2"),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # once, and above the join that opens the pages: below it every page of the crawl would be parsed
    assert plan.count("ArrowEvalPython [article_parts(") == 1
    assert plan.index("ArrowEvalPython [article_parts(") < plan.index("Join ")
