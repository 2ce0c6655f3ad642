"""The pipeline's stages, each on what the one before it kept, against plain versions of them."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("pressmill.llm")

import corpus_pipeline  # noqa: E402
from pressmill.llm import lines, repeats, simhash, toxicity  # noqa: E402
from pressmill.llm.queries import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage = say(90)
    rows, labels = [], []
    for k in range(150):
        parts = [say(50), say(30)]
        if k % 5 == 0:
            parts[0] = parts[0].replace(" ", " vilest ", 3).replace(" ", " vermin ", 2)
        if k % 7 == 1:
            parts.append(f"Page {k} of 300")
        if k % 10 == 2:
            parts[1] = passage + " " + say(5)
        rows.append((k, "\n".join(parts), "en", f"src{k % 3}", 1))
        labels.append((k, 1, int(k % 5 == 0)))
    rows += [(200 + k, rows[3][1], "en", "src0", 1) for k in range(4)]  # copies
    rows += [(300, rows[6][1] + " oneword", "en", "src1", 1), (400, None, None, None, None), (401, "", "en", "", 0), (402, "", "en", "", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_each_stage(spark, folder, tmp_path):
    import duckdb
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], folder)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    before, clean, lined, single, cut, pieces = kept

    scores = {r.doc_id: r.score for r in toxicity.toxicity(before, labels).collect()}
    assert texts_of(clean) == {i: t for i, t in texts_of(before).items() if scores[i] < 0.7}
    assert not {k for k in range(0, 150, 5)} & set(texts_of(clean))
    assert {k for k in range(150) if k % 5} <= set(texts_of(clean))

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(texts_of(clean).items()))
    sql = "with" + lines.CLEANED_SQL.format(docs="documents") + " select doc_id, text from cleaned"
    assert texts_of(lined) == dict(con.execute(sql).fetchall())
    assert "Page 1 of 300" in texts_of(lined)[1] and "Page" not in texts_of(lined)[8]

    prints = {i: simhash.fingerprint(t) for i, t in texts_of(lined).items()}
    root = {i: i for i in prints}
    for _ in prints:  # smallest id within reach, over and over
        root = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    assert texts_of(single) == {i: t for i, t in texts_of(lined).items() if root[i] == i}

    given = texts_of(single)
    data = {i: (t or "").encode() for i, t in given.items()}
    seen: dict[bytes, list] = {}
    for i, b in data.items():
        for p in range(len(b) - repeats.LENGTH + 1):
            seen.setdefault(b[p : p + repeats.LENGTH], []).append((i, p))
    marks = {i: np.zeros(len(b), bool) for i, b in data.items()}
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            marks[i][p : p + repeats.LENGTH] = True
    assert any(m.any() for m in marks.values())
    left = {i: bytes(np.frombuffer(b, np.uint8)[~marks[i]]).decode("utf-8", "ignore") for i, b in data.items()}
    assert {i: t or "" for i, t in texts_of(cut).items()} == left
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    held: dict[int, bytes] = {}
    for r in pieces.orderBy("doc_id", "start").collect():
        held[r.doc_id] = held.get(r.doc_id, b"") + bytes(r.ids)
    assert held == {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in left.items()}


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    key = lambda frame: sorted((r.doc_id, r.start, bytes(r.ids)) for r in frame.collect() if r.length == r.doc_tokens)
    assert key(corpus_pipeline.run(spark, folder)) and {x[0] for x in key(out)} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, folder).selectExpr("sum(length)").first()[0] == out.selectExpr("sum(length)").first()[0]
