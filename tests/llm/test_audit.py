"""Clustering, divergence audit and phrase index against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("pressmill.llm")

from pressmill.llm import divergence, drift_means, phrase_index  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, cluster string, ids string, distance string"
DOCS = "doc_id long, text string, lang string, source string, term string, run string, spans string, items string"


# ---- clustering -------------------------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "c", "i", "d") for i, v in rows], VECTORS)


def brute_clusters(rows, size, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def own(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[own(v)[1]].append(v)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centres)]
    found = [(i, *own(v)) for i, v in kept]
    by = Counter()
    for _, d, j in found:
        by[j] += d
    top = (1 << 63) - 1
    return sorted(
        ((i, j, min(d, top), min(by[j], top), min(sum(by.values()), top), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found),
        key=str,
    )


def rows_of_clusters(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 40.0, 1e9, 1e17])
def test_clusters_equal_brute_force(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, scale) for _ in range(6)]) for i in range(150)]
    rows += [(900 + i, list(rows[3][1])) for i in range(40)] + [(7, [0.0] * 6), (7, [0.0] * 6), (None, [1.0] * 6)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [None] * 6), (504, [float("nan")] * 6), (505, [float("inf")] + [0.0] * 5)]
    got = drift_means.cluster_digest(vectors_of(spark, rows), size=6)
    assert rows_of_clusters(got) == brute_clusters(rows, 6)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 6), (2, [0.5] * 6), (3, [-0.5] * 6)]
    assert rows_of_clusters(drift_means.cluster_digest(vectors_of(spark, rows), size=6)) == brute_clusters(rows, 6)
    assert rows_of_clusters(drift_means.cluster_digest(vectors_of(spark, rows[:1]), size=6)) == brute_clusters(rows[:1], 6)
    assert drift_means.cluster_digest(vectors_of(spark, []), size=6).count() == 0


def test_bounds_skip_vectors_of_clear_clusters(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 3, (16, 6))
    rows = [(i, (middles[i % 16] + rng.normal(0, 0.05, 6)).tolist()) for i in range(3200)]
    blocks, _ = drift_means.clustered(vectors_of(spark, rows), size=6)
    assert rows_of_clusters(drift_means.cluster_digest(vectors_of(spark, rows), size=6)) == brute_clusters(rows, 6)
    assert blocks.selectExpr("sum(scanned)").first()[0] < 1600  # of the last assignment


def test_planar_bound_holds_and_is_below_the_drift():
    rng = np.random.default_rng(4)
    saved = 0
    for _ in range(300):
        centre, before = rng.normal(0, 10, 5), rng.normal(0, 10, 5)
        after, radius = before + rng.normal(0, 2, 5), float(rng.uniform(0, 8))
        drift = float(np.linalg.norm(after - before))
        bound = drift_means.nearer(centre, radius, before, after, drift)
        x = rng.normal(0, 1, (4000, 5))
        x = centre + radius * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 1, (4000, 1)) ** 0.2
        assert (np.linalg.norm(x - before, axis=1) - np.linalg.norm(x - after, axis=1)).max() <= bound + 1e-9
        saved += bound < 0.9 * drift
    assert saved > 100


# ---- divergence audit -------------------------------------------------------------------------------------------


def brute_audit(rows):
    docs = [(lang or "", source or "", re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())) for text, lang, source in rows]
    holders, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        holders[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in {(a, b) for a, b, _ in docs}:
        kept = sorted(t for t, n in holders[lang].items() if n >= 3)
        whole = Counter()
        for (a, _), c in counts.items():
            if a == lang:
                whole.update(c)

        def chances(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p, found = chances(counts[lang, source]), []
        for other in {b for a, b, _ in docs if a == lang} - {source}:
            q = chances(counts[lang, other])
            found.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode()))
        q = chances(whole)
        terms = sorted((-((p[t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t])[:200]
        for part, ranked in (("pair", sorted(found)), ("term", terms)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r, "t", "r", "s", "i") for i, r in enumerate(rows)], DOCS)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(frame, **options).collect())


def some_documents(sources):
    rng = random.Random(8)
    words = ["The", "the,", "(the)", "a-b-a", "Éa x", "cat", "Cat.", "dog", "12", "don't", "x" * 3000] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de"]), f"s{rng.randrange(sources)}") for _ in range(160)]
    rows += [(None, "en", "only null"), ("", None, None), ("12 34", "fr", "digits"), ("tie tie", "it", "é"), ("tie", "it", "z"), ("tie", "it", "z"), ("tie", "it", "ä")]
    return rows + [("one copy of a text\twith\x0btabs\x00zero", "en", "hot")] * 60


def test_audit_equals_a_plain_version(spark):
    rows = some_documents(5)
    assert audited(spark, rows) == brute_audit(rows)
    assert audited(spark, rows, run=40) == brute_audit(rows)
    assert audited(spark, []) == []


def test_audit_in_many_tiles(spark):
    rows = some_documents(9)
    assert audited(spark, rows, run=200, tile=(7, 3)) == brute_audit(rows)


def test_chance_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n, total, kept = 9_000_000_000_000, 9_000_000_000_123, 77_777
    row = spark.range(1).select(divergence.chance(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + kept)


# ---- phrase index -----------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute_phrases(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows[tuple(w[s : s + n])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, held = words_of(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    held |= {str(i) for i in windows[tuple(w[s : s + n])] if i is not None}
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "en", "s", "t", "r", "x", "y") for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, doc_id string"),
    )


def planted():
    rng = random.Random(3)
    words = ["the"] * 8 + ["É", "2nd", "a_b"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 9, 10, 11, 40])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, " .,; "), (103, "the " * 14), (104, "Lone"), (7, items[0][1]), (None, items[1][1]), (105, items[2][1].upper())]
    docs = []
    for i in range(80):
        w = rng.choices(words, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            source = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            start = rng.randrange(len(source) + 1)
            w[at:at] = source[start : start + rng.randrange(40)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (90, ""), (None, items[4][1]), (91, "x" * 100_000), (92, "the " * 5000), (93, items[4][1]), (93, items[4][1])]
    # a window must not lead from one document into the next
    return [*docs, (94, " ".join(items[4][1].split()[:4])), (95, " ".join(items[4][1].split()[4:]))], items


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_phrases_equal_a_plain_version(spark, segment):
    docs, items = planted()
    d, i = frames(spark, docs, items)
    found = phrase_index.contaminated(d, i) if segment > 50 else None
    if found is None:
        index = phrase_index.index_of(d, segment)
        assert index.count() > 20
        spans = {(r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), tuple(r["items"])) for r in phrase_index.phrases(index, i).collect()}
        assert {(a, b, c, len(x)) for a, b, c, x in spans} == {x[:4] for x in brute_phrases(docs, items)}
    else:
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute_phrases(docs, items)


def test_items_in_many_blocks(spark, monkeypatch):
    docs, items = planted()
    d, i = frames(spark, docs, items)
    blocks = phrase_index.items_in_blocks
    monkeypatch.setattr(phrase_index, "items_in_blocks", lambda x: blocks(x, 300))
    assert len(list(blocks(i, 300))) > 5
    assert sorted((tuple(r) for r in phrase_index.contaminated(d, i).collect()), key=str) == brute_phrases(docs, items)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b c")], [])
    assert [tuple(r)[:4] for r in phrase_index.contaminated(d, i).collect()] == [(1, 3, 0, 0)]
    d, i = frames(spark, [], [(1, "a")])
    assert phrase_index.contaminated(d, i).count() == 0


def test_near_equals_a_plain_version(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choices(words, k=5))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=40))) for i in range(15)] + [(50, "w1"), (51, None)]
    d, i = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id, r.window) for r in phrase_index.near(phrase_index.index_of(d, 100), i, width=4, reach=6).collect()}
    expected = set()
    for doc, text in docs:
        w = words_of(text)
        for item, source in items:
            s = words_of(source)
            for k in range(len(s) - 3):
                if any(set(s[k : k + 4]) <= set(w[a : a + 6]) for a in range(len(w))):
                    expected.add((doc, str(item), k))
    assert got == expected and 20 < len(got) < 15 * 24


def test_without_contaminated(spark):
    docs, items = [(1, "a b c d e f g h i j"), (2, "other words")], [(1, "x a b c d e f g h i j")]
    d, i = frames(spark, docs, items)
    assert [r.doc_id for r in phrase_index.without_contaminated(d, i).collect()] == [2]


def test_each_hit_is_found_at_its_words():
    segment = phrase_index.Segment()
    segment.add(1, b"a b c a b c d")
    segment.add(2, b"d e")
    lists = phrase_index.Lists(segment.row(0))
    number = lists.numbers({b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"e": 4, b"none": 5})
    assert [lists.list_of(int(number[t])).tolist() for t in range(5)] == [[0, 3], [1, 4], [2, 5], [6, 8], [9]] and number[5] == -1
    assert [(i, a.tolist(), b.tolist()) for i, a, b in phrase_index.phrase_spans(lists, [[2, 3]], [[0]], number, 2)] == [(0, [5], [6])]
    assert list(phrase_index.phrase_spans(lists, [[3, 3]], [[0]], number, 2)) == []
