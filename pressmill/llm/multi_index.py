"""Approximate nearest neighbours with an inverted multi-index.

Contract. Every query gets the ``k`` nearest of the candidates that the index gives it (all others,
if the table has fewer), by Euclidean distance in double precision of the original vectors, nearest
first, ties to the smaller id; never rows of its own id. Null ids, null, empty or zero vectors and
those with null or non-finite components take no part; vectors of another length than the query's are
no candidates. Rows that repeat an id and vector count once. An empty table gives an empty result.

Index. Vectors are cut in two halves, each quantised by its own CENTROIDS (k-means on SAMPLE vectors
of smallest hash at most). A cell is a pair of centroids, and every vector is in the cell of its two
nearest. For a query a heap yields the cells by rising sum of the two squared distances
(multi-sequence algorithm, Babenko and Lempitsky, 2012) until they hold CANDIDATES vectors or SHARE of
all, whichever is more. The vectors of those cells, and of cells as near as the last, are reranked
exactly. SHARE suits vectors without any structure, spread evenly over a sphere of 64 dimensions: to
find nine of ten true neighbours of those takes a third of all. Clustered ones need far less.

Plan. Equal vectors are folded, so a vector that a third of all rows share is one entry. The sizes of
the cells, at most CENTROIDS² numbers, are broadcast. Vectors are dealt by first centroid to shards of
about GROUP vectors; a first centroid with more is spread over several. A query goes to the shards
that hold one of its cells, with the bound on the summed distance, and brings back its best k.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import cut
from pressmill.llm.vectors import best, folded, matrix

K = 10
SAMPLE, CENTROIDS, ROUNDS, SEED = 20_000, 256, 12, 11
CANDIDATES, SHARE = 2000, 0.35
GROUP = 20_000


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T, 0)


def centroids(points: np.ndarray, count: int) -> np.ndarray:
    """k-means from spread-out starts; a centre without points stays where it is."""
    rng = np.random.default_rng(SEED)
    centres = points[[int(rng.integers(len(points)))]]
    nearest = squares(points, centres)[:, 0]
    while len(centres) < min(count, len(points)) and nearest.sum() > 0:
        one = points[[int(rng.choice(len(points), p=nearest / nearest.sum()))]]
        centres = np.concatenate([centres, one])
        nearest = np.minimum(nearest, squares(points, one)[:, 0])
    for _ in range(ROUNDS):
        owner = squares(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        counts = np.bincount(owner, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def cells_of(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: int) -> Iterator[tuple[float, int, int]]:
    """Cells with vectors by rising summed distance, until they hold ``wanted`` vectors."""
    half = books[0].shape[1]
    first, second = squares(q[None, :half], books[0])[0], squares(q[None, half:], books[1])[0]
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    first, second, held = first[a].tolist(), second[b].tolist(), 0
    sizes = sizes[a][:, b].tolist()
    # a pair is pushed once both pairs before it are out: reached[i] is the next open column of row i
    reached = [0] * (len(a) + 1)
    heap = [(first[0] + second[0], 0, 0)]
    while heap and held < wanted:
        total, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        if sizes[i][j]:
            held += sizes[i][j]
            yield total, int(a[i]), int(b[j])
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; both frames have vec_id and v, doubles, of any lengths."""
    found = None
    # vectors of each length have an index of their own; as a rule there is one length
    entries = cut(folded(vectors, "v", k + 1))
    for (size,) in sorted(entries.select(F.size("v")).distinct().collect()):
        one = nearest_of(entries.where(F.size("v") == size), queries.where(F.size("v") == size), size, k)
        found = one if found is None else found.unionAll(one)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def nearest_of(entries: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    spark = entries.sparkSession
    total = entries.count()
    half = (size + 1) // 2
    # a bounded sample: SAMPLE vectors
    sample = entries.select("v", F.xxhash64("v").alias("draw")).orderBy("draw").limit(SAMPLE)
    points = matrix(sample.select("v").toPandas()["v"], np.float64)
    count = max(1, min(CENTROIDS, total // 16))
    rest = points[:, half:] if size > 1 else np.zeros((len(points), 1))
    books = (centroids(points[:, :half], count), centroids(rest, count))
    known = spark.sparkContext.broadcast(books)

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :half], x[:, half:] if size > 1 else np.zeros((len(x), 1))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                a, b = halves(matrix(part["v"], np.float64))
                yield part.assign(i=squares(a, known.value[0]).argmin(1), j=squares(b, known.value[1]).argmin(1))

    placed = cut(entries.mapInPandas(place, "v array<double>, ids array<bigint>, i int, j int"))
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    for row in placed.groupBy("i", "j").count().collect():  # CENTROIDS² rows at most
        sizes[row["i"], row["j"]] = row["count"]
    # shards of first centroids: each begins where another GROUP vectors are full
    held = sizes.sum(axis=1)
    salts = np.maximum(1, -(-held // GROUP))
    base = np.zeros(len(held), np.int64)
    shard, load = 0, 0
    for i in range(len(held)):
        if load and load + held[i] > GROUP:
            shard, load = shard + 1, 0
        base[i] = shard
        load += held[i]
        if salts[i] > 1:
            shard, load = shard + int(salts[i]), 0
    told = spark.sparkContext.broadcast((sizes, salts, base))
    wanted = max(CANDIDATES, int(total * SHARE))

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, salts, base = told.value
        for part in parts:
            rows = []
            for query_id, v in zip(part["query_id"], part["v"], strict=True):
                both = np.concatenate(halves(np.asarray(v, np.float64)[None, :]), axis=1)[0]
                visited, bound = set(), 0.0
                for bound, i, _ in cells_of(both, known.value, sizes, wanted):
                    visited.add(i)
                shards = {int(base[i]) + n for i in visited for n in range(int(salts[i]))}
                rows += [(query_id, v, bound, x) for x in sorted(shards)]
            yield pd.DataFrame(rows, columns=["query_id", "v", "bound", "shard"])

    asked = queries.select(F.col("vec_id").alias("query_id"), "v").distinct().mapInPandas(
        visits, "query_id long, v array<double>, bound double, shard int"
    )
    number = lambda x: F.element_at(F.array(*[F.lit(int(y)) for y in x]), F.col("i") + 1)
    dealt = placed.withColumn("shard", (number(base) + F.pmod(F.xxhash64("v"), number(salts))).cast("int"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values(["i", "j"], kind="stable")
            points = matrix(left["v"], np.float64)
            cell = left["i"].to_numpy().astype(np.int64) * len(known.value[1]) + left["j"].to_numpy()
            # the inverted lists of the shard: a run of rows for each cell
            cells, start = np.unique(cell, return_index=True)
            lengths = np.diff(np.concatenate([start, [len(cell)]]))
            ids = [np.asarray(x, np.int64) for x in left["ids"]]
            for query_id, v, bound in zip(right["query_id"], right["v"], right["bound"], strict=True):
                q = np.asarray(v, np.float64)
                a, b = halves(q[None, :])
                summed = squares(a, known.value[0])[0][cells // len(known.value[1])] + squares(b, known.value[1])[0][cells % len(known.value[1])]
                at = np.flatnonzero(np.repeat(summed <= bound + 1e-9 * (1 + bound), lengths))
                if not len(at):
                    continue
                distance = np.sqrt(((points[at] - q) ** 2).sum(axis=1))
                # k + 1 vectors hold k candidates at least besides the query's own; ties at the edge stay
                edge = np.partition(distance, min(k, len(distance) - 1))[min(k, len(distance) - 1)]
                near = [
                    (d, x) for p, d in zip(at[distance <= edge], distance[distance <= edge], strict=True)
                    for x in ids[p] if x != query_id
                ]
                out += [(query_id, int(x), float(d)) for d, x in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        rerank, "query_id long, vec_id long, score double"
    )
    return best(found, [F.col("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
