"""Similarity and near-duplicate groups against brute force with the standard library."""

import random
from difflib import SequenceMatcher

import pytest

from pressmill.functions.ratio import best_ratios, pair_ratios
from pressmill.operators.similar import best_similarity, near_duplicates


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def word(rng, n, letters="etaoin shrdlu"):
    return "".join(rng.choice(letters) for _ in range(n))


def vary(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and out:
            out.pop(min(at, len(out) - 1))
        else:
            out.insert(at, rng.choice("xyz "))
    return "".join(out)


def test_ratios_equal_the_sequence_matcher():
    rng = random.Random(3)
    first = [word(rng, rng.randrange(0, 60), "abc ") for _ in range(400)]
    second = [vary(rng, a, rng.randrange(6)) if i % 2 else word(rng, rng.randrange(0, 240), "abcdef") for i, a in enumerate(first)]
    got = pair_ratios(first, second)
    assert all(x == pytest.approx(ratio(a, b) if a or b else 0) for a, b, x in zip(first, second, got))
    best = best_ratios(first[:40], [b for b in second[:30] if b])
    assert all(x == pytest.approx(max(ratio(a, b) for b in second[:30] if b)) for a, x in zip(first[:40], best))


def test_ratios_at_the_width_of_a_word():
    rng = random.Random(4)
    for letters in ("ab", "abc ", "etaoin shrdlu", "日本語の見出し"):
        first = [word(rng, rng.choice([0, 1, 2, 20, 60, 63, 64, 65, 130]), letters) for _ in range(60)]
        second = [vary(rng, a, 9)[:199] if rng.random() < 0.5 else word(rng, rng.choice([0, 1, 60, 64, 65, 199]), letters) for a in first]
        want = [ratio(a, b) if a or b else 0 for a, b in zip(first, second, strict=True)]
        assert pair_ratios(first, second).tolist() == want
        assert [x if x >= 0.7 else 0 for x in pair_ratios(first, second, 0.7)] == [x if x >= 0.7 else 0 for x in want]
        known = [b for b in second if b]
        assert best_ratios(first, known).tolist() == [max(ratio(a, b) for b in known) for a in first]


def test_few_samples_of_a_title_reach_the_exact_ratio(monkeypatch):
    from pressmill.functions import ratio as module

    rng = random.Random(12)
    syllables = [word(rng, rng.randrange(2, 5), "etaoinshrdlucmfwyp") for _ in range(40)]
    line = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(12))[:60]
    titles, known = [line() for _ in range(200)], [line() for _ in range(200)]
    compared, exact = [], module._matched_words
    monkeypatch.setattr(module, "_matched_words", lambda words, *sizes: compared.append(words.shape[1]) or exact(words, *sizes))
    got = best_ratios(titles, known)
    assert 0 < sum(compared) < len(titles) * len(known) / 5
    assert got[:20].tolist() == [max(ratio(a, b) for b in known) for a in titles[:20]]


@pytest.mark.parametrize("bound", [1000, 3])
def test_best_similarity_with_few_and_many_samples(spark, bound):
    rng = random.Random(5)
    samples = [word(rng, 30) for _ in range(20)]
    titles = [vary(rng, rng.choice(samples), 4) for _ in range(30)] + ["", "  "]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    known = spark.createDataFrame([(s,) for s in samples], "sample string")
    got = {r.id: r.s for r in best_similarity(df, known, "title", "sample", "s", sample_bound=bound, titles_per_task=7).collect()}
    tidy = lambda t: " ".join(t.split())
    for i, t in enumerate(titles):
        want = max(ratio(tidy(t), tidy(s)) for s in samples) if tidy(t) else 0.0
        assert got[i] == pytest.approx(want)


def brute_force(rows):
    """Greedy grouping in score order: (seq kept, label, group size)."""
    seen, groups = set(), []
    for row in sorted(rows, key=lambda r: (-r["score"], r["seq"])):
        if row["url"] and row["url"] in seen:
            continue
        seen.add(row["url"])
        title = " ".join(row["title_original"].split())
        for group in groups:
            head = " ".join(group[0]["title_original"].split())
            if title and head and ratio(title, head) >= 0.86:
                group.append(row)
                break
        else:
            groups.append([row])
    out = set()
    for i, group in enumerate(groups, 1):
        rank = lambda r: (r["score"] + (10 if r["source_type"] == "official" else 0), len(r["raw_text"]), len(r["matched_keywords"]))
        kept = max(group, key=rank)
        out.add((kept["seq"], f"D{i:03d}" if len(group) > 1 else "", len(group)))
    return out


def make_rows(seed, n):
    rng = random.Random(seed)
    seeds = [word(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 20, 45])) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:  # a third of the rows are copies of one title
            title = seeds[0] + "common headline of the day"
        elif kind < 0.6:  # a family of near copies with one score
            title = vary(rng, "common headline of the other day, number", 2)
        elif kind < 0.9:
            title = vary(rng, rng.choice(seeds), rng.randrange(4))
        else:
            title = " " * rng.randrange(3)
        rows.append({
            "run_date": "2024-01-01" if rng.random() < 0.8 else "2024-01-02", "seq": i, "score": float(rng.randrange(6) * 10),
            "title_original": title, "url": rng.choice(["", f"u{i}", f"u{i // 3}"]),
            "source_type": rng.choice(["official", "html"]), "raw_text": "x" * rng.randrange(9), "matched_keywords": "k" * rng.randrange(3),
        })
    return rows


@pytest.mark.parametrize("seed,n,block,budget", [(1, 150, 4096, 2e8), (2, 200, 16, 2e8), (3, 300, 128, 2000.0)])
def test_near_duplicates_equal_the_greedy_loop(spark, seed, n, block, budget):
    rows = make_rows(seed, n)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "run_date string, seq long, score double, title_original string, url string, source_type string, raw_text string, matched_keywords string")
    got = near_duplicates(df.repartition(5), first_block=block, pair_budget=budget).collect()
    for day in ("2024-01-01", "2024-01-02"):
        want = brute_force([r for r in rows if r["run_date"] == day])
        assert {(r.seq, r.duplicate_group, r.group_size) for r in got if r.run_date == day} == want


def test_near_duplicates_of_long_titles(spark):
    """From 200 characters on the ratio leaves popular characters out, and leaders are found by wide grams."""
    rng = random.Random(9)
    seeds = [" ".join(word(rng, rng.randrange(2, 9), "etaoinshrdlucmfwypvbgkqjxz") for _ in range(n)) for n in (30, 33, 34, 40, 45, 60, 90)]
    rows = []
    for i in range(140):
        title = vary(rng, rng.choice(seeds), rng.choice([0, 2, 8, 20, 30]))
        rows.append({"run_date": "2024-01-01", "seq": i, "score": float(rng.randrange(6) * 10), "title_original": title, "url": f"u{i}", "source_type": "html", "raw_text": "x" * rng.randrange(9), "matched_keywords": ""})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "run_date string, seq long, score double, title_original string, url string, source_type string, raw_text string, matched_keywords string")
    got = {(r.seq, r.duplicate_group, r.group_size) for r in near_duplicates(df).collect()}
    assert got == brute_force(rows) and len(got) < 100


def test_few_pairs_of_a_tile_reach_the_exact_ratio(spark):
    import numpy as np

    from pressmill.operators.similar import Titles, resolved

    rng = random.Random(11)
    syllables = [word(rng, rng.randrange(2, 5), "etaoinshrdlucmfwyp") for _ in range(60)]
    titles = list(dict.fromkeys(" ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(10)) for _ in range(300)))
    titles += [vary(rng, t, 2) for t in titles[:20]]
    made = Titles(titles)
    rows = np.arange(len(titles))
    i, j = made.near(rows, made, rows, 0.86)
    assert (i > j).sum() < len(titles) ** 2 / 50
    near = set(zip(i.tolist(), j.tolist(), strict=True))
    close = {(a, b) for a in range(len(titles)) for b in range(a) if ratio(titles[a], titles[b]) >= 0.86}
    assert close and close <= near
    lead = resolved(made, 0.86)
    for a in range(len(titles)):
        assert lead[a] == next((b for b in range(a) if lead[b] == b and (a, b) in close), a)


@pytest.mark.parametrize("letters", ["etaoin shrdlu", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))])
def test_first_filter_leaves_few_pairs(monkeypatch, letters):
    """Titles are numbered in slices, and the narrow matrix product leaves few pairs, whatever the alphabet."""
    import numpy as np

    from pressmill.operators import similar

    rng = random.Random(13)
    titles = list(dict.fromkeys([word(rng, rng.choice([3, 20, 60]), letters) for _ in range(150)] + [word(rng, 700, letters)]))
    titles += [vary(rng, t, 3) for t in titles[:40]] + [""]
    monkeypatch.setattr(similar, "_FLAT", 500)
    first, second = similar.Titles(titles[:100]), similar.Titles(titles[100:])
    left, right = first._against(second, 0.86)
    assert left.shape[1] <= 256 and (left @ right.T >= -1e-3).mean() < 0.25
    rows, columns = np.arange(100)[::-1], np.arange(len(titles) - 100)
    near = {(rows[i], columns[j]) for i, j in zip(*first.near(rows, second, columns, 0.86), strict=True)}
    close = {(a, b) for a in range(100) for b in columns if titles[100 + b] and ratio(titles[a], titles[100 + b]) >= 0.86}
    assert len(close) >= 10 and close <= near and len(near) < 2_000


def test_small_batches_of_titles_are_gathered_within_bounds():
    import pandas as pd

    from pressmill.operators.similar import _gathered

    sizes = [3] * 40 + [500] + [3] * 40
    batches = [pd.Series(["x" * n] * 4) for n in sizes] + [pd.Series([], dtype=object)]
    got = list(_gathered(batches, rows=32, cells=1000))
    assert [len(t) for part in got for t in part] == [n for n in sizes for _ in range(4)]
    assert max(map(len, got)) == 32 and [len(part) for part in got if len(part[-1]) == 500] == [4]
    assert list(_gathered([])) == []
