"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Contract. Every row of documents gets ``doc_id, held_out, score, predicted``, and as evidence the
labelled neighbours with their cosines. held_out is crc32(doc_id as text) mod 3 = 1; those labels are
never learned from. score is from 0 to 1, predicted is 1 from 0.7 on. Only the text is scored.
A null or empty text, and a text without a single informative term, get the base score of such texts.
Repeated rows are scored each; null ids are held out of training and get held_out false. Null labels
count as missing, the larger of contradicting labels counts. Without toxic examples all scores are 0.

Model. EXAMPLES labelled rows at most are learned from, chosen by hash of their id, one of each group of
copies; this bounds the whole model whatever the input. Terms are letter runs of the lower-cased text and their leading 4, 5
and 6 letters. VOCABULARY terms at most are informative: seen in three toxic examples at least, and
more often there than chance allows (Yang and Pedersen, 1997, on selection for nearest neighbours).
The index holds for every term its examples in blocks of BLOCK with the block's largest weight. A
search bounds each block by the sum of the terms' block maxima, visits blocks from the highest bound
down and ends when no block can hold a better neighbour, so its NEIGHBOURS are exact (ties to the
smaller id). The neighbours vote with the square of their cosine; a logistic curve over votes and
matched weight, fitted on the examples without themselves, makes it a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm.common import cut, give_back

EXAMPLES = 8000
VOCABULARY = 4000
NEIGHBOURS = 12
BLOCK = 64
#: Least chi-square, and least ratio of the shares of toxic and clean examples with a term, to be informative.
GAIN, RATE = 40.0, 8.0
THRESHOLD = 0.7
#: Bytes of text scored at once, and different terms that a task counts before it passes them on.
BYTES, TERMS = 1 << 22, 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """Letter runs of a word, and their beginnings marked by a star."""
    out = []
    for run in LETTERS.findall(word):
        out.append(run)
        out += [run[:k] + "*" for k in (4, 5, 6) if len(run) >= k]
    return out


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(document, word number)`` of all words of a batch, and the different words."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    coded = split.flatten().dictionary_encode()
    document = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    return document, coded.indices.to_numpy(), coded.dictionary.to_pylist()


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    piece = np.cumsum(lengths, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(lengths)]
    for low, high in zip(edges, edges[1:], strict=False):
        if high > low:
            yield batch.slice(low, high - low)


class Model:
    """Vocabulary, index and calibration; a few megabytes at most."""

    def __init__(self, idf: dict[str, float], examples: list[tuple[int, int, dict[str, int]]]):
        self.number = {term: k for k, term in enumerate(sorted(idf))}
        self.idf = np.array([idf[x] for x in sorted(idf)])
        rows = [(doc_id, toxic, self.vector({self.number[x]: n for x, n in terms.items()})) for doc_id, toxic, terms in examples]
        rows = sorted((x for x in rows if len(x[2][0])), key=lambda x: (x[0], x[1]))
        self.ids = np.array([x[0] for x in rows], np.int64)
        self.toxic = np.array([x[1] for x in rows], float)
        self.blocks = -(-len(rows) // BLOCK)
        term = np.concatenate([x[2][0] for x in rows]) if rows else np.zeros(0, int)
        weight = np.concatenate([x[2][1] for x in rows]) if rows else np.zeros(0)
        owner = np.repeat(np.arange(len(rows)), [len(x[2][0]) for x in rows])
        order = np.lexsort((owner, term))
        self.owner, self.weight = owner[order], weight[order]
        # postings of a term in a block: start[term * blocks + block] .. start[... + 1]
        cell = term[order] * max(1, self.blocks) + self.owner // BLOCK
        self.start = np.searchsorted(cell, np.arange(len(self.number) * max(1, self.blocks) + 1))
        self.most = np.zeros(len(self.number) * max(1, self.blocks))
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(self.number), max(1, self.blocks))
        self.curve = np.zeros(3)
        self.base = 0.0

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Terms, unit TF-IDF weights and the length before scaling."""
        term = np.array(sorted(counts), int)
        weight = (1 + np.log([counts[x] for x in term])) * self.idf[term] if len(term) else np.zeros(0)
        length = float(np.sqrt((weight**2).sum()))
        return term, weight / length if length else weight, length

    def nearest(self, term: np.ndarray, weight: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The NEIGHBOURS examples of largest cosine above zero, ties to the smaller place."""
        bound = weight @ self.most[term]
        best_place, best_score = np.zeros(0, int), np.zeros(0)
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or len(best_score) == NEIGHBOURS and bound[block] < best_score[-1] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(term, weight, strict=True):
                low, high = self.start[t * self.blocks + block], self.start[t * self.blocks + block + 1]
                score[self.owner[low:high] - block * BLOCK] += w * self.weight[low:high]
            if without is not None and without // BLOCK == block:
                score[without % BLOCK] = 0
            hit = np.flatnonzero(score > 0)
            place = np.concatenate([best_place, hit + block * BLOCK])
            value = np.concatenate([best_score, score[hit]])
            order = np.lexsort((place, -value))[:NEIGHBOURS]
            best_place, best_score = place[order], value[order]
        return best_place, best_score

    def votes(self, counts: dict[int, int], without: int | None = None):
        """Signed votes of the neighbours from -1 to 1, the matched weight, neighbours and cosines."""
        term, weight, length = self.vector(counts)
        if not len(term) or not self.blocks:
            return None
        place, cosine = self.nearest(term, weight, without)
        if not len(place):
            return None
        power = cosine**2
        return float((power * (2 * self.toxic[place] - 1)).sum() / power.sum()), float(np.log1p(length)), place, cosine

    def calibrate(self, examples: list[tuple[int, int, dict[str, int]]]) -> None:
        """Fits the curve on the examples, each searched without itself."""
        ordered = sorted((x for x in examples if x[2]), key=lambda x: (x[0], x[1]))
        points, labels = [], []
        bare = [x[1] for x in examples if not x[2]]
        for place, (_, toxic, terms) in enumerate(ordered):
            found = self.votes({self.number[x]: n for x, n in terms.items()}, place)
            if found is None:
                bare.append(toxic)
            else:
                points.append(found[:2])
                labels.append(toxic)
        self.base = sum(bare) / (len(bare) + 1)
        if not points:
            return
        x = np.column_stack([np.ones(len(points)), np.array(points)])
        y = np.array(labels, float)
        curve = np.zeros(3)
        for _ in range(30):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            slope = x.T @ (y - p) - 0.1 * curve
            bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
            move = np.linalg.solve(bend, slope)
            curve += move
            if np.abs(move).max() < 1e-9:
                break
        self.curve = curve

    def score(self, counts: dict[int, int]):
        found = self.votes(counts)
        if found is None:
            return self.base, None
        value = 1 / (1 + np.exp(-np.clip(self.curve @ np.array([1.0, *found[:2]]), -30, 30)))
        return float(value), found


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)``: the bounded sample that is learned from."""
    known = (
        labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("l_id is not null and toxic is not null").where(~held_out("l_id"))
        .groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(EXAMPLES)
    )
    # EXAMPLES rows of two numbers: a bounded broadcast
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))
        .select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(1).to_pylist():
                words = (text or "").lower().split()
                shingles = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
                least.append(min(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in shingles))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "least"])

    # copies and most near copies share the least hash of a shingle: one of them is enough, as a term
    # that many copies of one text repeat is not seen often
    return rows.mapInArrow(run, "doc_id long, text string, toxic int, least long").groupBy("toxic", "least").agg(
        F.min(F.struct("doc_id", "text")).alias("one")
    ).select("one.doc_id", "one.text", "toxic")


def term_table(sample: DataFrame) -> DataFrame:
    """``(term, toxic, clean)``: examples of either kind that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            terms = sorted(counts[0].keys() | counts[1].keys())
            out = [pa.array(terms, pa.string()), *(pa.array([counts[k][x] for x in terms], pa.int64()) for k in (1, 0))]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays(out, names=["term", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(set(terms_of((text or "").lower())))
                if len(counts[0]) + len(counts[1]) > TERMS:
                    yield told()
        yield told()
        give_back()

    return (
        sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = cut(labelled(docs, labels))
    size = {x["toxic"]: x["count"] for x in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    if not toxic:
        return Model({}, [])
    # chance that a term of these counts is no sign of toxicity: a two-cell chi-square test
    expected = (F.col("toxic") + F.col("clean")) * F.lit(toxic / (toxic + clean))
    gain = F.pow(F.col("toxic") - expected, 2) / expected / F.lit(max(clean, 1) / (toxic + clean))
    rate = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / (clean + 1))
    chosen = (
        term_table(sample).where("toxic >= 3").where((gain > GAIN) & (rate > RATE))
        .orderBy(gain.desc(), "term").limit(VOCABULARY).collect()
    )
    idf = {x["term"]: float(np.log((toxic + clean + 1) / (x["toxic"] + x["clean"]))) for x in chosen}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [
                [x for x in Counter(t for t in terms_of((text or "").lower()) if t in idf).items()]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(maps, pa.map_(pa.string(), pa.int64()))],
                names=["doc_id", "toxic", "terms"],
            )

    rows = sample.mapInArrow(run, "doc_id long, toxic int, terms map<string,bigint>").collect()  # EXAMPLES at most
    examples = [(x["doc_id"], int(x["toxic"] > 0), dict(x["terms"])) for x in rows]
    model = Model(idf, examples)
    model.calibrate(examples)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of docs with ``__score`` and ``__evidence`` (doc_id, cosine, toxic of the neighbours)."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("text"), BYTES):
                document, word, words = word_counts(batch.column("text"))
                # numbers of the informative terms of each different word
                own = {k: t for k, x in enumerate(words) if (t := [model.number[y] for y in terms_of(x) if y in model.number])}
                informative = np.zeros(len(words), bool)
                informative[list(own)] = True
                at = np.flatnonzero(informative[word]) if len(word) else []
                counts: dict[int, Counter] = {}
                for k in at:
                    counts.setdefault(int(document[k]), Counter()).update(own[int(word[k])])
                score, evidence = np.full(len(batch), model.base), [[]] * len(batch)
                for k, terms in counts.items():
                    score[k], found = model.score(terms)
                    if found is not None:
                        evidence[k] = [
                            {"doc_id": int(model.ids[p]), "cosine": float(c), "toxic": int(model.toxic[p])}
                            for p, c in zip(found[2], found[3], strict=True)
                        ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(score), pa.array(evidence, kind)],
                    names=[*batch.schema.names, "__score", "__evidence"],
                )
        give_back()

    neighbour = T.StructType().add("doc_id", "long").add("cosine", "double").add("toxic", "integer")
    schema = T.StructType(list(docs.schema)).add("__score", "double").add("__evidence", T.ArrayType(neighbour))
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` of every row."""
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__evidence").alias("evidence"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    return scored(docs, labels).where(F.col("__score") < THRESHOLD).select(*docs.columns)
