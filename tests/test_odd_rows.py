"""Rows the small tables do not hold: queries and their reference SQL agree on them too."""

import json
import os
from pathlib import Path

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from pressmill.queries import ORACLES, QUERIES
from pressmill.sources import readers, writers


def folder_with(spark, base, target, **tables):
    """The tables of a folder, some of them replaced by given rows."""
    for name in os.listdir(base):
        if name.removesuffix(".parquet") not in tables:
            (target / name).symlink_to(Path(base) / name)
    for name, rows in tables.items():
        like = spark.read.parquet(f"{base}/{name}.parquet").schema
        spark.createDataFrame(rows, like).toPandas().to_parquet(target / f"{name}.parquet")
    return str(target)


def page(no, body, title="A plain title", url=None, end="</body></html>"):
    return (no, url or f"https://example.org/en/{no}", f"<!DOCTYPE html><html><head><title>{title}</title></head><body><nav><ul><li><a href=\"/a\">ciónes</a></li></ul></nav><article><h1>{title}</h1><p>{body}</p></article>{end}")


@pytest.mark.parametrize("name, rows", [
    ("f10_page_title", [page(1, "x", title="Than end&amp")]),
    ("f12_main_text", [page(1, "cut here&amp")]),
    ("p26_article_rows", [page(1, "cut here&amp")]),
    ("c2_collect", [page(1, "cut here&amp"), page(2, "one " * 60, url="https://example.org/same"), page(3, "two " * 90, url="https://example.org/same")]),
    ("c8_enrich_selected", [page(1, "cut here&amp"), page(2, "one " * 60, url="https://example.org/same"), page(3, "two " * 190, url="https://example.org/same")]),
    ("f13_page_date", [page(2, "4537 words", title="4537960215 words")]),
    ("f17_article_body", [page(1, "ANES!! BLETI!! " * 40)]),
    ("c15_collect_ranked", [page(8, "the words of one. " * 60, end=""), page(17, "the words of two. " * 60)]),
])
def test_pages(spark, sf_dir, tmp_path, name, rows):
    folder = folder_with(spark, sf_dir, tmp_path, pages=rows)
    assert compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name]) == ""


def test_site_predicates(spark, sf_dir, tmp_path):
    text = "Que que la"
    folder = folder_with(spark, sf_dir, tmp_path, documents=[(6042, text, "es", "src2", len(text))])
    assert compare(spark, connect(folder), folder, QUERIES["p18_site_predicates"], ORACLES["p18_site_predicates"]) == ""


def test_longer_text_without_title_or_source(spark, sf_dir, tmp_path):
    texts = {1: "\nshort", 3: " " * 70 + "short", 604: "x" * 700, 607: "y " * 400, 608: None, 611: ""}
    rows = [(i, text, "en", None if i in (607, 608) else "src2", len(text or "")) for i, text in texts.items()]
    folder = folder_with(spark, sf_dir, tmp_path, documents=rows)
    assert compare(spark, connect(folder), folder, QUERIES["j11_longer_text"], ORACLES["j11_longer_text"]) == ""


def test_each_day_is_one_whole_file(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.range(20_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.nullif(F.col("id") % 30, F.lit(7)).cast("int")).alias("date"),
        F.col("id").alias("order_index"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title_cn"),
    )
    writers.write_daily_json(rows, path)
    found = {}
    for file in Path(path).glob("*/*.txt"):
        assert file.parent.name not in found
        found[file.parent.name] = [x["title_cn"] for x in json.loads(file.read_text())]
    assert len(found) == 30
    assert found["date=2024-01-01"] == [f"t{i}" for i in range(0, 20_000, 30)]
    # items without a date share a folder
    assert found["date=__HIVE_DEFAULT_PARTITION__"] == [f"t{i}" for i in range(7, 20_000, 30)]


@pytest.mark.parametrize("part_bytes, least", [(1 << 20, 1), (5_000, 5)])
def test_cumulative_digest_in_bounded_files(spark, tmp_path, part_bytes, least):
    path = str(tmp_path / "whole")
    rows = spark.range(600).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"),
        F.col("id").alias("order_index"), F.concat(F.lit('t"{\n'), F.col("id").cast("string")).alias("title_cn"),
    )
    writers.write_cumulative(rows, path, part_bytes=part_bytes)
    files = sorted(Path(path).glob("*.txt"))
    assert least <= len(files) and all(f.stat().st_size < 2 * part_bytes for f in files)
    whole = {}
    for file in files:
        for block in json.loads(file.read_text())["date_blocks"]:
            whole.setdefault(block["date"], []).extend(x["title_cn"] for x in block["items"])
    assert whole == {f"2024-01-0{k + 1}": [f't"{{\n{i}' for i in range(k, 600, 3)] for k in range(3)}
    want = sorted((k, f"2024-01-0{k + 1}", n + 1, f't"{{\n{i}') for k in range(3) for n, i in enumerate(range(k, 600, 3)))
    got = readers.read_cumulative(spark, path).select("block_seq", "date", "pos", "title_cn")
    assert sorted(map(tuple, got.collect())) == want
    lines = writers.read_cumulative_lines(spark, path).select("date", "pos", "title_cn")
    assert sorted(map(tuple, lines.collect())) == [w[1:] for w in want]


def test_empty_cumulative_digest(spark, tmp_path):
    rows = spark.range(0).select(F.lit("2024-01-01").cast("date").alias("date"), F.col("id").alias("order_index"), F.lit("t").alias("title_cn"))
    writers.write_cumulative(rows, str(tmp_path / "none"))
    assert readers.read_cumulative(spark, str(tmp_path / "none")).isEmpty()


def test_texts_go_to_python_in_small_batches(spark, sf_dir):
    from pressmill.queries import base

    before = spark.conf.get(base._BATCH)
    try:
        spark.conf.set(base._BATCH, "10000")
        base.table(spark, sf_dir, "documents")
        assert spark.conf.get(base._BATCH) == str(base.BATCH_ROWS)
        spark.conf.set(base._BATCH, "77")
        base.table(spark, sf_dir, "documents")
        assert spark.conf.get(base._BATCH) == "77"
    finally:
        spark.conf.set(base._BATCH, before)


def test_long_texts_go_to_python_in_small_batches(spark, sf_dir):
    import pandas as pd

    from pressmill.queries import base

    @F.pandas_udf("long")
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(map(len, texts))] * len(texts))

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        base.table(spark, sf_dir, "documents")
        texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        sizes = [r.n for r in texts.select(batch_bytes("text").alias("n")).collect()]
        # 30 MB in all; a batch ends with the row that reaches the limit
        assert len(sizes) == 300 and max(sizes) <= (4 << 20) + 100_000
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
