"""Main text of web pages by a recurrent block labeller.

Contract. Every row of pages gives ``page_id, url, text, n_chars``. A page is read whole into blocks:
the text between tags that are no inline tags, character references decoded, white space runs one
space, trimmed; scripts, styles, templates, titles, comments and markup are no text. The blocks that
the labeller takes for the article are joined in page order by two line feeds. A null or empty page,
or one without such a block, gives an empty text. Repeated rows give repeated rows, ids may be null,
broken markup is read as far as it goes, an empty table gives an empty result.

Model. A page is the sequence of its blocks. A block is a vector of its tag path (tags and the words
of their classes, ids and roles, hashed) and of its words (hashed), its length and its share of link
text. A bidirectional LSTM in numpy reads the sequence both ways, so each label depends on the whole
page. There are no labelled pages, so it is trained when the operator runs, on SAMPLE pages at most
(smallest hashes of id and address): their blocks labelled by what their own tags say, and the same
texts put in LAYOUTS times as many invented layouts with known labels, most of them without telling
tags around the article, so that sidebars, notices, forms and comments of other sites are known too.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: LONGEST is the length of a window in training; longer pages are several windows.
SAMPLE, LAYOUTS, LONGEST = 200, 3, 96
PATH, WORDS, HIDDEN, EPOCHS = 192, 32, 16, 14
SEED = 5
#: Blocks labelled at once, padding included.
BATCH = 20_000

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
UNREAD = frozenset("script style template noscript iframe svg textarea select title canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = frozenset("p li dt dd option tr td th".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*)?((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_WORD = re.compile(r"[a-z]+")


def attribute_tokens(text: str) -> list[str]:
    out = []
    for name, value in ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("~hidden")
        elif name not in ("style", "aria-hidden"):
            out += ["." + x for x in NAME_WORD.findall(value)]
    return out


def blocks_of(page: str) -> list[tuple[frozenset, str, float]]:
    """``(path tokens, text, share of link characters)`` of each block with text, in page order.

    A path leaves out a token only if the teacher does not read it and another one has set its bucket, so
    vectors and labels are those of all tokens and a path holds PATH and the TELLING ones at most.
    """
    out: list[tuple[frozenset, str, float]] = []
    root: frozenset = frozenset()
    stack: list[tuple[str, frozenset, int]] = []  # the number has a bit for each bucket of the path
    depth: dict[str, int] = {}
    parts: list[str] = []
    linked, where, at = 0, root, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((where, text, min(1.0, linked / max(1, sum(map(len, parts))))))
            parts.clear()
        linked = 0

    def pop(name: str) -> None:
        while stack:
            last = stack.pop()[0]
            depth[last] -= 1
            if last == name:
                break

    def add(text: str) -> None:
        nonlocal where, linked
        if not parts:
            if not text.strip():
                return
            where = stack[-1][1] if stack else root
        parts.append(text)
        if depth.get("a"):
            linked += len(text)

    length = len(page)
    while at < length:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        found = TAG.match(page, lt)
        if found is None or found[2] is None and not (found[0].startswith("<!") or found[0].startswith("<?") or found[0].startswith("</")):
            add("<")  # a lone sign
            at = lt + 1
            continue
        at = max(found.end(), lt + 1)
        if found[2] is None or found[1] in ("!", "?"):
            continue
        name = found[2].lower()
        if found[1] == "/":
            if name not in INLINE:
                close()
            if depth.get(name):
                pop(name)
            continue
        if name in UNREAD:
            if not found[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else length
            if name not in INLINE:
                close()
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name not in INLINE:
            close()
            while stack and stack[-1][0] in INLINE and not depth.get("a"):
                pop(stack[-1][0])  # an inline tag left open does not hold blocks
        if name in VOID:
            continue
        if name in CLOSED_BY_NEXT and stack and stack[-1][0] == name:
            pop(name)
        _, path, bits = stack[-1] if stack else ("", root, 0)
        tokens = [name, *(attribute_tokens(found[3]) if found[3] and "=" in found[3] or "hidden" in (found[3] or "") else [])]
        new = []
        for token in tokens:
            if token not in path:
                bit = 1 << path_bucket(token)
                if not bits & bit or token in TELLING:
                    bits |= bit
                    new.append(token)
        stack.append((name, path.union(new) if new else path, bits))
        depth[name] = depth.get(name, 0) + 1
    close()
    return out


def bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) * 2654435761 % (1 << 32) * size >> 32


@lru_cache(20_000)
def path_bucket(token: str) -> int:
    return bucket(token, PATH)


class Features:
    """Vectors of blocks; hashes of path tokens are kept."""

    def __init__(self) -> None:
        self.rows: dict[frozenset, list[int]] = {}

    def of(self, blocks: list[tuple[frozenset, str, float]]) -> np.ndarray:
        x = np.zeros((len(blocks), PATH + WORDS + 4), np.float32)
        if len(self.rows) > 20_000:
            self.rows.clear()
        for k, (path, _, _) in enumerate(blocks):
            if path not in self.rows:
                self.rows[path] = sorted({path_bucket(t) for t in path})
            x[k, self.rows[path]] = 1
        texts = pa.array([b[1] for b in blocks], pa.large_string())
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        number = np.array([bucket(w, WORDS) for w in coded.dictionary.to_pylist()], np.int64)
        counts = np.diff(split.offsets.to_numpy())
        owner = np.repeat(np.arange(len(blocks)), counts)
        if len(owner):
            words = np.bincount(owner * WORDS + number[coded.indices.to_numpy()], minlength=len(blocks) * WORDS)
            x[:, PATH : PATH + WORDS] = words.reshape(-1, WORDS) / np.maximum(counts, 1)[:, None]
        lengths = np.array([len(b[1]) for b in blocks], float)
        x[:, -4] = np.log1p(lengths) / 8
        x[:, -3] = [b[2] for b in blocks]
        x[:, -2] = np.log1p(counts) / 8
        x[:, -1] = 1
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per step."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            rng = np.random.default_rng(SEED)
            inputs = PATH + WORDS + 4
            weights = {"out": rng.normal(0, 0.3, (2 * HIDDEN + 1, 1))}
            for way in "fb":
                weights["x" + way] = rng.normal(0, inputs**-0.5, (inputs, 4 * HIDDEN))
                weights["h" + way] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False):
        """Hidden states of one direction; x is pages by steps by inputs, masked steps pass the state on."""
        pages, steps, _ = x.shape
        given = x @ self.w["x" + way]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, tape = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = given[:, t] + h @ self.w["h" + way]
            gate = sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            states[:, t] = h
        return states, tape

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        ahead, _ = self.read(x, mask, "f")
        back, _ = self.read(x, mask, "b")
        return (np.concatenate([ahead, back, np.ones((*mask.shape, 1), np.float32)], 2) @ self.w["out"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        both = {way: self.read(x, mask, way, True) for way in "fb"}
        top = np.concatenate([both["f"][0], both["b"][0], np.ones((*mask.shape, 1), np.float32)], 2)
        miss = (sigmoid((top @ self.w["out"])[..., 0]) - y) * mask / mask.sum()
        out = {"out": np.einsum("pti,pt->i", top, miss)[:, None]}
        for k, way in enumerate("fb"):
            down = miss[..., None] * self.w["out"][k * HIDDEN : (k + 1) * HIDDEN, 0]
            given = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            grad_h = np.zeros_like(self.w["h" + way])
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, th, m in reversed(both[way][1]):
                dh = dh + down[:, t]
                inner, rest_h, rest_c = dh * m, dh * (1 - m), dc * (1 - m)
                dnew = dc * m + inner * o * (1 - th**2)
                da = np.concatenate(
                    [dnew * g * i * (1 - i), dnew * c * f * (1 - f), inner * th * o * (1 - o), dnew * i * (1 - g**2)], 1
                )
                given[:, t] = da
                grad_h += h.T @ da
                dh = da @ self.w["h" + way].T + rest_h
                dc = dnew * f + rest_c
            out["x" + way] = x.reshape(-1, x.shape[2]).T @ given.reshape(-1, 4 * HIDDEN)
            out["h" + way] = grad_h
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(SEED)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [pages[k : k + 24] for k in range(0, len(pages), 24)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.02 if epoch < EPOCHS // 2 else 0.005
            for k in rng.permutation(len(batches)):
                step += 1
                for name, g in self.gradients(*padded(batches[k])).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g**2
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                    self.w[name] -= (rate * move).astype(np.float32)

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is article text, for pages of any length."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        group: list[int] = []
        for k in [*order, None]:
            if group and (k is None or (len(group) + 1) * len(pages[k]) > BATCH):
                x, mask, _ = padded([(pages[j], np.zeros(len(pages[j]))) for j in group])
                score = self.score(x, mask)
                for row, j in enumerate(group):
                    out[j] = score[row, : len(pages[j])] > 0
                group = []
            group.append(k)
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(p[0]) for p in pages)
    x = np.zeros((len(pages), steps, pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((len(pages), steps), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, (a, b) in enumerate(pages):
        x[k, : len(a)], mask[k, : len(a)], y[k, : len(a)] = a, 1, b
    return x, mask, y


#: Words of tags, classes, ids and roles that say what a part of a page is.
ASIDE = frozenset(
    "nav aside form button menu footer ~hidden .nav .navbar .menu .sidebar .ad .ads .advert .advertisement .banner .cookie "
    ".consent .notice .promo .sponsored .comment .comments .reply .replies .disqus .share .social .related .breadcrumb .breadcrumbs "
    ".pagination .widget .newsletter .subscribe .popup .modal .login .search .footer .copyright .alert .toolbar .complementary "
    ".navigation .contentinfo .skip .tags .toc".split()
)
EDGE = frozenset("header .header .masthead .topbar".split())
INSIDE = frozenset("article main .article .articlebody .main .content .post .entry .story".split())
RUNNING = frozenset("p h1 h2 h3".split())
TELLING = ASIDE | EDGE | INSIDE | RUNNING


def told_by_tags(blocks: list[tuple[frozenset, str, float]]) -> np.ndarray:
    """Labels from what the tags say; where they say nothing, running text with few links is article."""
    framed = any(path & INSIDE for path, _, _ in blocks)
    out = []
    for path, text, links in blocks:
        inside = bool(path & INSIDE)
        if path & ASIDE or path & EDGE and not inside:
            out.append(False)
        else:
            out.append(inside if framed else links < 0.5 and (len(text) >= 25 or bool(path & RUNNING)))
    return np.array(out, float)


def invented(texts: list[str], rng: np.random.Generator) -> tuple[list[tuple[frozenset, str, float]], np.ndarray]:
    """A page of another layout from given texts, and its labels."""
    def some(low: int, high: int, short: bool = False) -> list[str]:
        picked = [texts[k] for k in rng.integers(0, len(texts), rng.integers(low, high + 1))]
        return [" ".join(x.split()[: int(rng.integers(1, 9))]) for x in picked] if short else picked

    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    out: list[tuple[frozenset, str, float]] = []
    label: list[float] = []

    def put(path: str, items: list[str], good: bool, links: float = 0.0) -> None:
        for item in items:
            if item:
                out.append((frozenset(("html body " + path).split()), item, links))
                label.append(float(good))

    wrap = pick("", "div", "div .page", "div .wrapper .container")
    for part in ("header", "nav", "notice", "ad"):
        if rng.random() < 0.5:
            if part == "header":
                put(f"{wrap} {pick('header', 'div .header', 'div .masthead', 'header .site')} {pick('h1', 'p', 'div', 'a')}", some(1, 2, True), False, pick(0.0, 1.0))
            elif part == "nav":
                put(f"{wrap} {pick('nav', 'div .menu', 'ul .nav', 'div .navbar', 'nav .main')} ul li a", some(2, 9, True), False, 1.0)
            elif part == "notice":
                put(f"{wrap} div {pick('.cookie', '.notice', '.consent', '.alert', '.banner', '.popup')} {pick('p', 'div', 'span')}", some(1, 2), False)
            else:
                put(f"{wrap} {pick('div .ad', 'div .advert', 'aside .ads', 'div .sponsored', 'div .promo', 'div .advertisement')} {pick('', 'p', 'a')}", some(1, 2), False, pick(0.0, 1.0))
    body = pick("article", "main", "main article", "div .content", "div .post", "div .entry .content", "div .story", "div .article .body", "section", "div", "td")
    put(f"{wrap} {body} {pick('h1', 'h1', 'h2', 'header h1')}", some(0, 1, True), True)
    for _ in range(int(rng.integers(1, 5))):
        put(f"{wrap} {body} {pick('p', 'p', 'p', 'p', 'blockquote p', 'ul li', 'h2', 'pre', 'p b', 'div')}", some(1, 4), True)
        if rng.random() < 0.25:
            put(f"{wrap} {body} {pick('aside', 'div .related', 'div .ad', 'div .share', 'div .newsletter', 'form', 'aside .sidebar')} {pick('p', 'ul li a', 'a', '')}", some(1, 3, bool(rng.integers(0, 2))), False, pick(0.0, 1.0))
    for part in ("comments", "sidebar", "form", "footer"):
        if rng.random() < 0.5:
            if part == "comments":
                put(f"{wrap} {pick('div .comments', 'section .comments', 'ol .comment .list', 'div .comment', 'div .disqus')} {pick('p', 'div', 'li p', 'article p')}", some(1, 4), False)
            elif part == "sidebar":
                put(f"{wrap} {pick('aside', 'div .sidebar', 'aside .sidebar', 'div .widget', 'div .related')} {pick('p', 'ul li a', 'h3', 'div')}", some(1, 4), False, pick(0.0, 1.0))
            elif part == "form":
                put(f"{wrap} form {pick('label', 'p', 'div', 'button', '.search', '.newsletter p')}", some(1, 3, True), False)
            else:
                put(f"{wrap} {pick('footer', 'div .footer', 'footer .site')} {pick('', 'p', 'ul li a', 'div .copyright')}", some(1, 3), False, pick(0.0, 1.0))
    return out, np.array(label)


def windows(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A page in even pieces of LONGEST blocks at most."""
    n = -(-len(x) // LONGEST)
    return list(zip(np.array_split(x, n), np.array_split(y, n), strict=True))


def trained(pages: list[str]) -> Labeller:
    rng, features = np.random.default_rng(SEED), Features()
    parsed = [b for b in map(blocks_of, pages) if b]
    examples = [w for b in parsed for w in windows(features.of(b), told_by_tags(b))]
    texts = [b[1] for page in parsed for b in page] or ["text"]
    for _ in range(LAYOUTS * max(20, len(parsed))):
        blocks, label = invented(texts, rng)
        if blocks:
            examples += windows(features.of(blocks), label)
    model = Labeller()
    model.fit(examples)
    return model


def fit(pages: DataFrame) -> Labeller:
    """Trains in one task on a bounded sample; the weights are a few hundred kilobytes."""
    sample = (
        pages.where("html is not null").select("html", F.xxhash64("page_id", "url").alias("draw"))
        .orderBy("draw", F.md5("html")).limit(SAMPLE).select("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in batch.column(0).to_pylist()]
        for name, value in sorted(trained(texts).w.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([value.shape[0]], pa.int64()), pa.array([value.astype("<f4").tobytes()], pa.binary())],
                names=["name", "rows", "data"],
            )

    found = sample.coalesce(1).mapInArrow(run, "name string, rows long, data binary").collect()
    return Labeller({x["name"]: np.frombuffer(x["data"], "<f4").reshape(x["rows"], -1) for x in found})


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; see the module."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages).w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, features = Labeller(model.value), Features()

        def texts(pages: list[list[tuple]]) -> list[str]:
            flat = [b for page in pages for b in page]
            x = features.of(flat)
            ends = np.cumsum([len(p) for p in pages])
            vectors = np.split(x, ends[:-1]) if pages else []
            return [
                "\n\n".join(b[1] for b, good in zip(page, label, strict=True) if good)
                for page, label in zip(pages, labeller.labels(vectors), strict=True)
            ]

        for batch in batches:
            out: list[str] = []
            group: list[list[tuple]] = []
            size = 0
            for value in batch.column(2):
                blocks = blocks_of(value.as_py() or "")
                group.append(blocks)
                size += len(blocks)
                if size >= BATCH:
                    out += texts(group)
                    group, size = [], 0
            if group:
                out += texts(group)
            counts = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), counts], names=["page_id", "url", "text", "n_chars"]
            )

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
