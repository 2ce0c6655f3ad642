"""Planted passages of more than 50 words on both sides of the 400 bytes that the suffix-array operator removes."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("pressmill.llm")

import corpus_pipeline  # noqa: E402
from pressmill.llm import repeats  # noqa: E402

WORDS = {51: 0, 60: 0, 64: 0, 70: 1, 90: 1, 200: 1}  # by number of words: whether a passage has 400 bytes
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Every passage is in three documents, between texts of their own; the first document of each passage is doc_id % 3 = 0."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = {n: say(n) for n in WORDS}
    rows = []
    for k, n in enumerate(WORDS):
        for c in range(3):
            rows.append((3 * k + c, f"{say(60)} {passages[n]} {say(60)}", "en", f"s{c}", 1))
    rows += [(100 + k, say(150), "en", "s0", 1) for k in range(40)]
    path = str(tmp_path_factory.mktemp("passages"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, passages


def removed_by_document(before, after):
    return {i: len(before[i].encode()) - len(after[i].encode()) for i in before}


def test_bytes_removed_for_each_passage(spark, planted):
    path, passages = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    digest = {r.doc_id: r for r in repeats.removal_digest(docs).collect()}
    for k, (n, removable) in enumerate(WORDS.items()):
        size = len(passages[n])
        assert (size >= repeats.LENGTH) == bool(removable)
        for c in range(3):
            # the blank on either side is the same in all three documents, so it goes along; n_bytes is the size of the input
            got = digest[3 * k + c]
            assert (got.n_removed, got.n_spans) == ((size + 2, 1) if size + 2 >= repeats.LENGTH else (0, 0))
            assert got.n_bytes == len(before[3 * k + c])
    assert all(digest[i].n_removed == 0 for i in before if i >= 100)


def test_bytes_removed_after_the_earlier_stages(spark, planted):
    path, passages = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, path)
        # passages inside longer lines are no lines and no copies: the stages before leave all of them
        assert docs.count() == 58, name
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, path).collect()}
    assert before.keys() == after.keys()  # bytes go, rows stay
    gone = removed_by_document(before, after)
    for k, (n, removable) in enumerate(WORDS.items()):
        expected = len(passages[n]) + 2 if removable else 0
        assert [gone[3 * k + c] for c in range(3)] == [expected] * 3
        assert all((passages[n] in after[3 * k + c]) != bool(removable) for c in range(3))
    assert all(gone[i] == 0 for i in before if i >= 100)


def test_memory_of_a_task_is_bounded():
    """Hashing and sorting take many times their input: both get little enough of it at once."""
    rng = random.Random(3)
    data = bytes(rng.choices(b"abcdefgh ", k=repeats.CHUNK))
    parts = [data[k : k + 600] for k in range(0, min(len(data), repeats.SHARD), 600)]
    parts = [x for x in parts if len(x) == 600]
    while sum(map(len, parts)) < repeats.SHARD:
        parts.append(bytes(rng.choices(b"abcdefgh ", k=600)))
    tracemalloc.start()
    try:
        repeats.contexts_of(np.frombuffer(data, np.uint8), np.array([len(data)]))
        hashing = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        list(repeats.solve_shard([7] * len(parts), list(range(len(parts))), [1] * len(parts), [0] * len(parts), parts))
        sorting = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert hashing < 64 << 20 and sorting < 64 << 20


def test_repeats_across_pieces_of_long_texts(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    edge = repeats.CHUNK
    long = say(2 * edge + 5000)
    shared = long[edge - 300 : edge + 500]
    other = say(999) + "A" + shared + "B" + say(edge)
    rows = [(1, long), (2, other), (3, say(700)), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in repeats.removal_digest(docs).collect()}
    assert {i: (r.n_removed, r.n_spans) for i, r in got.items()} == {1: (800, 1), 2: (800, 1), 3: (0, 0), 4: (0, 0)}
    cleaned = repeats.without_repeats(docs)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # decoding needs no second Python worker
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert left == {1: long[: edge - 300] + long[edge + 500 :], 2: other.replace(shared, ""), 3: rows[2][1], 4: ""}
