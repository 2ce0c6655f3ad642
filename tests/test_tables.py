"""Readers, registries and invariances of table operators."""

import json

import pytest
from pyspark.sql import functions as F

from pressmill.config import Profile
from pressmill.operators import analytics as an
from pressmill.operators import keyed
from pressmill.operators.keyed import first_per_key, positions, top_per_key
from pressmill.operators.ordered import carry_forward, look_ahead, running_total
from pressmill.queries import QUERIES
from pressmill.sources import readers, registry, writers


def test_daily_files_with_bad_names_or_content_are_skipped(spark, tmp_path):
    good = [{"title_cn": "一", "url": "u1", "keywords": ["a"]}, {"title_cn": "二", "url": ""}]
    (tmp_path / "final_digest_20240105.json").write_text(json.dumps(good, ensure_ascii=False))
    (tmp_path / "final_digest_2024.json").write_text(json.dumps(good))
    (tmp_path / "final_digest_20240106.json").write_text("{broken")
    got = readers.read_daily_digests(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(str(r.date), r.pos, r.title_cn) for r in got] == [("2024-01-05", 1, "一"), ("2024-01-05", 2, "二")]


@pytest.mark.parametrize("kind", ["date", "string"])
def test_daily_arrays_are_written_item_by_item(spark, tmp_path, kind):
    rows = [(f"2024-01-0{1 + i % 3}", 7 * i, f'a "{i}"\nline', ["k", "é"]) for i in range(300)]
    items = spark.createDataFrame(rows, "date string, order_index long, title_cn string, keywords array<string>").withColumn("date", F.col("date").cast(kind)).repartition(5)
    writers.write_daily_json(items, str(tmp_path / "days"))
    for day in (1, 2, 3):
        (part,) = (tmp_path / "days" / f"date=2024-01-0{day}").glob("part-*")
        assert [x["title_cn"] for x in json.loads(part.read_text())] == [r[2] for r in rows if r[0].endswith(str(day))]
        assert len(part.read_text().splitlines()) == 102
    got = readers.read_daily_partitions(spark, str(tmp_path / "days")).collect()
    assert sorted((str(r.date), r.pos, r.title_cn, r.keywords) for r in got) == sorted((r[0], 1 + i // 3, r[2], r[3]) for i, r in enumerate(rows))


def test_cumulative_file_is_one_json_document(spark, tmp_path):
    rows = [(f"2024-01-{1 + i % 12:02}", 1000 - i, f't "{i}" {{,}}', ["k"]) for i in range(240)]
    items = spark.createDataFrame(rows, "date string, order_index long, title_cn string, keywords array<string>").repartition(4)
    writers.write_cumulative(items, str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("part-*")
    blocks = json.loads(part.read_text())["date_blocks"]
    want = [(d, [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == d]) for d in sorted({r[0] for r in rows})]
    assert [(b["date"], [x["title_cn"] for x in b["items"]]) for b in blocks] == want
    for got in (readers.read_cumulative(spark, str(part)), writers.read_cumulative_lines(spark, str(tmp_path / "all"))):
        assert sorted((r.date, r.pos, r.title_cn) for r in got.collect()) == sorted((d, k + 1, t) for d, ts in want for k, t in enumerate(ts))


@pytest.mark.parametrize("bare", [True, False])
def test_cumulative_as_list_or_object(spark, tmp_path, bare):
    blocks = [{"date": "2024-01-05", "items": [{"title_cn": "a"}, {"title_cn": "b"}]}, {"date": "2024-01-06", "items": []}]
    path = tmp_path / "cumulative.json"
    path.write_text(json.dumps(blocks if bare else {"date_blocks": blocks}, indent=2))
    got = readers.read_cumulative(spark, str(path)).collect()
    assert [(r.date, r.pos, r.title_cn) for r in got] == [("2024-01-05", 1, "a"), ("2024-01-05", 2, "b")]


def test_registry_and_dictionary(spark):
    sources = registry.sources_from_yaml("sources:\n- {name: A, section_url: 'https://a/', priority: 3, include_url_patterns: ['[', 'x']}\n- {name: B, priority: bad}\n- {section_url: 'https://c/'}\n")
    assert [s.name for s in sources] == ["A"]
    row = registry.sources_frame(spark, sources).first()
    assert (row.base_url, row.include_url_patterns, row.max_articles_per_run) == ("https://a/", ["x"], 20)
    words = registry.keywords_from_yaml("categories:\n  c: {default_weight: 2, keywords: [a, {term: b, weight: 7}, '']}\n  d: {keywords: [e]}\n")
    assert [(k.category, k.term, k.weight) for k in words] == [("c", "a", 2.0), ("c", "b", 7.0), ("d", "e", 5.0)]
    assert registry.proposed_source({"base_url": "https://n.example/"}).name == "n.example"


def test_profile_defaults():
    p = Profile.from_mapping({"date_window": {"start_hour": 8}, "scoring": {"preferred_regions": ["X"]}})
    assert (p.window_start_hour, p.monday_lookback_days, p.preferred_regions) == (8, 3, ("X",))


@pytest.fixture(scope="module")
def ordered(spark):
    rows = [(k, i, (i * 7 + len(k)) % 5) for k in ("a", "bb") for i in range(40)]
    return spark.createDataFrame(rows, "k string, i int, v int"), rows


def test_ordered_operators_do_not_depend_on_the_block_size(ordered):
    df, rows = ordered
    hit = F.when(F.col("v") == 0, F.col("i"))
    for build in (
        lambda b: carry_forward(df, ["k"], "i", hit, "o", block=b),
        lambda b: running_total(df, ["k"], "i", F.col("v"), "o", block=b),
        lambda b: look_ahead(df, ["k"], "i", F.col("v"), 4, "o", block=b),
    ):
        small, large = ({(r.k, r.i): r.o for r in build(b).collect()} for b in (8, 1000))
        assert small == large and len(small) == len(rows)


@pytest.mark.parametrize("step", [1, 1 << 20, 1 << 50])
def test_positions_and_caps(spark, step):
    rows = [("hot" if i % 3 else None if i % 2 else "cold", None if i % 17 == 5 else float(i * 13 % 4), (i - 100) * step) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s double, seq long").repartition(7)
    found = positions(df, ["k"], [("s", True)], "seq")
    got = {r.seq: r.position for r in found.collect()}
    assert len(got) == 200
    for k in ("hot", "cold", None):
        want = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))]
        assert [got[s] for s in want] == list(range(1, len(want) + 1))
    assert positions(df, [], [], "seq").orderBy("seq").select("position").limit(3).collect() == [(1,), (2,), (3,)]
    assert positions(df.limit(0), ["k"], [], "seq").count() == 0
    capped = top_per_key(df, ["k"], [F.desc("s"), F.asc("seq")], F.when(F.col("k") == "hot", 7).otherwise(3), seq="seq")
    assert {r.seq for r in capped.collect()} == {s for s, p in got.items() if p <= (7 if {r[2]: r[0] for r in rows}[s] == "hot" else 3)}


def test_position_summary_does_not_grow_with_sparse_numbers(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), (F.col("id") * (1 << 20)).alias("seq"))
    stored = []
    cut = keyed.cut_lineage
    monkeypatch.setattr(keyed, "cut_lineage", lambda frame: stored.append(cut(frame)) or stored[-1])
    found = positions(rows, ["k"], [], "seq")
    assert found.agg({"position": "max"}).first()[0] == 13_333
    assert len(stored) == 2 and stored[0].count() == 20_000 and stored[1].count() < 200


def test_rows_without_key_are_kept(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u"), (3, None), (4, None)], "seq long, url string")
    assert sorted(r.seq for r in first_per_key(df, ["url"], ["seq"], keyless_id="seq").collect()) == [1, 3, 4]


def test_merging_a_day_twice_changes_nothing(spark):
    items = spark.createDataFrame([("2024-01-01", 0, 1, "u1"), ("2024-01-02", 1, 1, "u1"), ("2024-01-02", 1, 2, "u2")], "date string, block_seq long, pos long, url string").withColumn("date", F.to_date("date"))
    day = spark.createDataFrame([("2024-01-02", 0, 1, "u3"), ("2024-01-02", 0, 2, "u1")], "date string, block_seq long, pos long, url string").withColumn("date", F.to_date("date"))
    once = an.merge_day(items, day, "2024-01-02")
    twice = an.merge_day(once, day, "2024-01-02")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.url for r in once.collect()} == {"u1", "u3"}
    with pytest.raises(ValueError):
        an.merge_day(items, day.limit(0), "2024-01-02")


def test_unknown_distribution_column_is_empty(spark):
    df = spark.createDataFrame([(True,)], "accepted boolean")
    assert an.distribution(df, "nope").count() == 0
    empty = an.summary_metrics(df.limit(0)).first()
    assert (empty.total, empty.acceptance_rate) == (0, 0.0)


@pytest.mark.parametrize("name", ["c4_candidates", "w2_interleave", "w5_history_items"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, sf_dir, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(str, QUERIES[name](spark, sf_dir).collect()))

    try:
        assert rows("3") == rows("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
