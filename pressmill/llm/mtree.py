"""Exact search for the largest inner products with M-trees.

Contract. Vectors are whole numbers (for the query floor(256 * x)). Every query gets the ``k`` other
vectors of its length with the largest inner product, ties to the smaller id; fewer if there are
fewer. Null ids, null or empty vectors and null or non-finite components take no part. Rows that
repeat an id and vector count once; a query never meets rows of its own id. Sums beyond 2**53 are
not supported. An empty table gives an empty result.

Metric. With one more coordinate sqrt(M² - |x|²) for data and 0 for queries, M the longest length,
the squared Euclidean distance is |q|² + M² - 2 q·x, so the nearest are those of largest product.

Plan. Equal vectors are folded. The vectors are dealt to shards of SHARD by hash; each shard becomes
one M-tree, stored as a row. Every tree meets every block of queries in a task of bounded size, and
the trees' best are ranked once more. (Each query has to be answered against all rows; trees times
blocks is the least such work, and the bounds below save most distance computations within it.)

Search. Best first: a heap of nodes by the least distance their ball allows. Within a node an entry is
dropped without a computation if the stored distance to the parent already rules it out (triangle
inequality), else its distance is computed and its ball tested. Only bounds are rounded, and they
leave room for that; scores are whole numbers.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import cut
from pressmill.llm.vectors import best, folded, matrix

K = 5
#: Vectors of a tree, entries of a page, queries of a block.
SHARD, PAGE, BLOCK = 4096, 128, 512


class MTree:
    """Pages of entries. For every entry its distance to the page's router; in inner pages also the
    covering radius and the page below."""

    def __init__(self, points: np.ndarray):
        self.points = points
        squares = (points.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(squares.max())
        self.lift = np.sqrt(np.maximum(self.top - squares, 0))
        # sums of products are whole numbers below 2**53, which doubles hold exactly
        self.exact = points.astype(np.float64)
        #: (entries, their vectors, distance to the parent's router, covering radius, page below); the last two None in a leaf
        self.pages: list[tuple] = []
        self.root, _ = self.build(np.arange(len(points)), int(squares.argmax()))
        del self.exact  # the pages hold it

    def between(self, one: int, others: np.ndarray) -> np.ndarray:
        gap = (self.points[others] - self.points[one]).astype(np.float64)
        return np.sqrt((gap**2).sum(axis=1) + (self.lift[others] - self.lift[one]) ** 2)

    def build(self, members: np.ndarray, router: int) -> tuple[int, float]:
        """Bulk load: members go to the nearest of PAGE spread-out routers, again and again. Returns page and radius."""
        reach = self.between(router, members)
        if len(members) <= PAGE:
            self.pages.append((members, self.exact[members], reach, None, None))
            return len(self.pages) - 1, float(reach.max(initial=0))
        chosen = [int(members[reach.argmax()])]
        nearest = self.between(chosen[0], members)
        owner = np.zeros(len(members), int)
        wanted = min(PAGE, -(-len(members) // PAGE))
        while len(chosen) < max(2, wanted) and nearest.max() > 0:
            chosen.append(int(members[nearest.argmax()]))
            distance = self.between(chosen[-1], members)
            owner[distance < nearest] = len(chosen) - 1
            nearest = np.minimum(nearest, distance)
        if len(chosen) == 1:  # equal points only: cut evenly
            owner = np.arange(len(members)) // PAGE
            chosen = [chosen[0]] * (int(owner.max()) + 1)
        below, radius = [], []
        for k, one in enumerate(chosen):
            page, r = self.build(members[owner == k], one)
            below.append(page)
            radius.append(r)
        entries = np.array(chosen)
        self.pages.append((entries, self.exact[entries], self.between(router, entries), np.array(radius), below))
        return len(self.pages) - 1, float(reach.max())

    def search(self, q: np.ndarray, own: int, ids: list[np.ndarray], k: int) -> tuple[list[tuple[int, int]], int]:
        """The best ``(-product, id)`` in order, and the number of distances computed."""
        q = q.astype(np.float64)
        base = float(q @ q) + self.top
        room = 1e-6 * (1 + np.sqrt(base))
        found: list[tuple[int, int]] = []  # the best so far, worst first: (product, -id)
        limit, count = np.inf, 0
        heap: list[tuple[float, int, float]] = [(0.0, self.root, np.nan)]
        while heap:
            least, page, near = heapq.heappop(heap)
            if least > limit + room:
                break
            entries, vectors, to_parent, radius, below = self.pages[page]
            if near == near and limit < np.inf:
                able = np.abs(near - to_parent) <= (limit + room if radius is None else radius + (limit + room))
                at = np.flatnonzero(able)
                if not len(at):
                    continue
                if len(at) < len(entries):
                    entries, vectors = entries[at], vectors[at]
            else:
                at = np.arange(len(entries))
            product = vectors @ q
            count += len(at)
            distance = np.sqrt(np.maximum(base - 2.0 * product, 0))
            if radius is None:
                for place in np.flatnonzero(distance <= limit + room):
                    for one in ids[entries[place]]:
                        if one != own:
                            item = (int(product[place]), -int(one))
                            if len(found) < k:
                                heapq.heappush(found, item)
                            elif item > found[0]:
                                heapq.heapreplace(found, item)
                if len(found) == k:
                    limit = np.sqrt(max(base - 2.0 * found[0][0], 0))
            else:
                least_of = np.maximum(distance - radius[at], 0)
                for place in np.flatnonzero(least_of <= limit + room):
                    heapq.heappush(heap, (float(least_of[place]), below[at[place]], float(distance[place])))
        return sorted((-a, -b) for a, b in found), count


def largest_products(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; both frames have vec_id and v, whole numbers."""
    entries = cut(folded(vectors, "v", k + 1))
    shards = max(1, -(-entries.count() // SHARD))
    queries = cut(queries.select(F.col("vec_id").alias("query_id"), "v").distinct())
    blocks = max(1, -(-queries.count() // BLOCK))

    def load(part: pd.DataFrame) -> pd.DataFrame:
        points = matrix(part["v"], np.int64)
        tree = MTree(points)
        ids = [np.asarray(x, np.int64) for x in part["ids"]]
        return pd.DataFrame({
            "shard": [part["shard"].iloc[0]], "size": [points.shape[1]], "tree": [pickle.dumps((vars(tree), ids))],
        })

    size = F.size("v").alias("size")
    trees = cut(
        entries.select("v", "ids", size, F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard")).groupBy("size", "shard")
        .applyInPandas(load, "shard long, size int, tree binary")
    )
    dealt_trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt_queries = queries.select(
        "query_id", "v", size, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(left) and len(right):
            stored, ids = pickle.loads(left["tree"].iloc[0])  # written by load() above
            tree = MTree.__new__(MTree)
            vars(tree).update(stored)
            for query_id, q in zip(right["query_id"], right["v"], strict=True):
                rows += [(query_id, b, -a) for a, b in tree.search(np.asarray(q, np.int64), query_id, ids, k)[0]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["size", "shard", "block"]
    found = dealt_trees.groupBy(*key).cogroup(dealt_queries.groupBy(*key)).applyInPandas(
        run, "query_id long, vec_id long, score long"
    )
    return best(found, [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
