"""Centroid clustering with exact integers, pruned by geometric drift bounds.

Contract. Vectors with exactly SIZE components, none null or non-finite, take part; a component x becomes
floor(SCALE * x), taken as a double. Centroids start as the ``k`` vectors with the smallest sha256 of
``1:<vec_id>`` (of equal ids the one with the smaller components); rows with a null id are clustered and
returned, but start no centroid. ``rounds`` times every vector goes to its nearest centroid (squared
Euclidean distance, ties to the smaller number), then every centroid with vectors moves to the floor of
their mean; after that all vectors are assigned once more. All of it is exact at any magnitude; only a
distance or inertia beyond a long is given as the largest long. Repeated rows are vectors of their own.
With fewer than ``k`` vectors with ids there are as many centroids; an empty table gives an empty result.
Columns other than vec_id and embedding are not read.

Bounds. A vector keeps an upper bound on the distance to its own centroid and a lower bound on that to all
others. When centroids move, the lower bound of cluster i would have to give way by the largest drift. Less
is enough: the cluster lies in a ball around its old centroid, and in the plane of that centroid and the
old and new place of another one, ``|x - old| - |x - new|`` is at most the drift times the cosine of the
smallest angle, seen from the middle of the two places, between the drift and a point of the ball (the
asymptote of the hyperbola that touches the ball; Rysavy and Hamerly, 2016, tighten Hamerly's bound so).
Vectors whose bounds still part after that keep their centroid unseen; for the others the distance to
their own centroid is computed, and where that does not decide, all of them, exactly. Bounds are rounded
outwards, so rounding never decides; ties are always scanned.

Plan. One row holds a block of vectors, as bytes if they fit, with cluster and bounds, and the exact sums of
its clusters. A round is one pass over the blocks and one grouping of those sums: k rows of SIZE numbers a
block, added up before the shuffle. The driver sees k centroids and nothing else. Blocks are stored in the
checkpoint folder after every round, so a lost executor repeats a part of one pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import cut

SIZE, SCALE = 64, 64
K, ROUNDS = 16, 3
BLOCK = 4096
#: A sum is cut into limbs of so many bits, which Spark adds up as longs without overflow.
LIMB = 32
LARGEST = (1 << 63) - 1
#: Products of components up to this size add up exactly in doubles.
EXACT = 1 << 22
OUTWARDS = 1e-12

BLOCKS = (
    "ids array<bigint>, narrow boolean, comps binary, owner binary, upper binary, lower binary, scanned bigint, "
    "stats array<struct<cluster:int,n:bigint,reach:double,limb:int,sums:array<bigint>>>"
)


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """``(vec_id, v)``: vectors of ``size`` finite components, quantised."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    scaled = F.transform("v", lambda x: x.cast("double") * SCALE)
    infinite = F.lit(float("inf"))
    return (
        rows.where(F.size("v") == size).select("vec_id", scaled.alias("v"))
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)))
    )


def starts(rows: DataFrame, k: int) -> list[list[int]]:
    """The first centroids: ``k`` vectors of smallest hash, by a limit that every task applies first."""
    hashed = rows.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy("hash", "v").limit(k).orderBy("hash", "v")
    return [[int(np.floor(x)) for x in r["v"]] for r in first.select("v").collect()]


def squared(points: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Exact squared distances of every point to every centre: doubles that are integers, or Python's integers."""
    widest = max((abs(x) for c in centres for x in c), default=0)
    if not len(points) or max(float(np.abs(points).max()), widest) <= EXACT:
        p, c = points.astype(np.float64), np.array(centres, np.float64).reshape(len(centres), points.shape[1])
        return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]
    p = np.array([[int(x) for x in row] for row in points], dtype=object)
    return np.stack([((p - np.array(c, dtype=object)) ** 2).sum(1) for c in centres], axis=1)


def own_squared(points: np.ndarray, owner: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Exact squared distance of every point to the centre of its cluster."""
    widest = max((abs(x) for c in centres for x in c), default=0)
    if not len(points) or max(float(np.abs(points).max()), widest) <= EXACT:
        gap = points.astype(np.float64) - np.array(centres, np.float64)[owner]
        return (gap * gap).sum(1)
    p, c = np.array([[int(x) for x in row] for row in points], dtype=object), np.array(centres, dtype=object)
    return ((p - c[owner]) ** 2).sum(1)


def scan(points: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre (ties to the smaller number), bound above its distance, bound below the second one."""
    distances = squared(points, centres)
    owner = distances.argmin(1).astype(np.int64)
    near = np.sqrt(distances[np.arange(len(points)), owner].astype(np.float64))
    if len(centres) == 1:
        return owner, near * (1 + OUTWARDS), np.full(len(points), np.inf)
    second = np.partition(distances.astype(np.float64), 1, axis=1)[:, 1]
    return owner, near * (1 + OUTWARDS), np.sqrt(second) * (1 - OUTWARDS)


def loosening(old: list[list[int]], new: list[list[int]], reach: list[float | None]) -> np.ndarray:
    """By cluster: how much nearer any other centroid may have come to a point in its ball.

    ``reach`` is the radius of each cluster's ball around its old centroid, None for an empty cluster.
    """
    before, after, drift = np.array(old, np.float64), np.array(new, np.float64), drifts(old, new)
    fine = max(float(np.abs(before).max()), float(np.abs(after).max())) <= EXACT  # else doubles are too coarse for angles
    out = np.zeros(len(old))
    for i, radius in enumerate(reach):
        if radius is None:
            continue
        others = [j for j in np.flatnonzero(drift).tolist() if j != i]
        out[i] = max((nearer(before[i], radius, before[j], after[j], drift[j]) if fine else drift[j] for j in others), default=0.0)
    return out * (1 + 1e-9)


def drifts(old: list[list[int]], new: list[list[int]]) -> np.ndarray:
    return np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(old, new, strict=True)])


def nearer(centre: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray, drift: float) -> float:
    """Bound on ``|x - before| - |x - after|`` for every x in the ball.

    In the plane through the line of the drift and the ball's centre the function only depends on the
    place along the line and the distance from it, so the ball becomes a disc. From the middle of the two
    places a point in direction phi gains at most drift * cos(phi), and nothing beyond a right angle.
    """
    along = float((centre - (before + after) / 2) @ (after - before)) / drift
    away = float(np.sqrt(max(((centre - (before + after) / 2) ** 2).sum() - along**2, 0.0)))
    far = float(np.hypot(along, away))
    if far <= radius * (1 + 1e-9):
        return drift  # the middle lies in the ball: every direction occurs
    least = max(np.arctan2(away, along) - np.arcsin(min(radius * (1 + 1e-9) / far, 1.0)) - 1e-7, 0.0)
    return drift * max(float(np.cos(least)), 0.0)


def limbs(value: int) -> list[int]:
    """The value in digits of LIMB bits, lowest first; the last one carries the sign."""
    out = []
    while not -(1 << (LIMB - 1)) <= value < 1 << (LIMB - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def sums_of(points: np.ndarray, owner: np.ndarray, upper: np.ndarray, k: int) -> list[dict]:
    """The clusters of a block: size, radius and exact sums, cut in limbs."""
    out = []
    exact = not len(points) or float(np.abs(points).max()) * len(points) < 2**53
    for cluster in np.unique(owner).tolist():
        mine = owner == cluster
        columns = points[mine].astype(np.float64).sum(0) if exact else [sum(int(x) for x in col) for col in points[mine].T]
        digits = [limbs(int(x)) for x in columns]
        for limb in range(max(map(len, digits))):
            out.append({
                "cluster": cluster, "n": int(mine.sum()) if limb == 0 else 0, "reach": float(upper[mine].max()),
                "limb": limb, "sums": [d[limb] if limb < len(d) else 0 for d in digits],
            })
    return out


def packed(ids: list, points: np.ndarray, owner: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, k: int) -> dict:
    narrow = not len(points) or float(np.abs(points).max()) <= 127
    return {
        "ids": ids, "narrow": narrow, "comps": points.astype(np.int8 if narrow else np.float64).tobytes(),
        "owner": owner.astype(np.int32).tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(),
        "scanned": scanned, "stats": sums_of(points, owner, upper, k),
    }


def unpacked(block: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer(block["comps"], np.int8 if block["narrow"] else np.float64).reshape(-1, size)
    owner = np.frombuffer(block["owner"], np.int32).astype(np.int64)
    return points, owner, np.frombuffer(block["upper"], np.float64), np.frombuffer(block["lower"], np.float64)


def to_rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def block_schema() -> pa.Schema:
    stats = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("reach", pa.float64()), ("limb", pa.int32()), ("sums", pa.list_(pa.int64()))]))
    return pa.schema([
        ("ids", pa.list_(pa.int64())), ("narrow", pa.bool_()), ("comps", pa.binary()), ("owner", pa.binary()),
        ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64()), ("stats", stats),
    ])


def first_blocks(rows: DataFrame, centres: list[list[int]], size: int, block: int) -> DataFrame:
    """Blocks of vectors, each assigned by a full scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = block_schema()
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                points = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                owner, upper, lower = scan(points, centres)
                yield to_rows([packed(part.column("vec_id").to_pylist(), points, owner, upper, lower, len(points), len(centres))], schema)

    return rows.mapInArrow(run, BLOCKS)


def moved_blocks(blocks: DataFrame, old: list[list[int]], new: list[list[int]], reach: list[float | None], size: int) -> DataFrame:
    """The blocks after the centroids moved: only vectors whose bounds overlap are looked at."""
    give = loosening(old, new, reach)
    drift = drifts(old, new) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = block_schema()
        for batch in batches:
            for row in batch.to_pylist():
                points, owner, upper, lower = unpacked(row, size)
                upper = (upper + drift[owner]) * (1 + OUTWARDS)
                lower = lower - give[owner] - OUTWARDS * np.where(np.isfinite(lower), np.abs(lower) + give[owner], 0)
                unsure = np.flatnonzero(upper >= lower)
                upper[unsure] = np.sqrt(own_squared(points[unsure], owner[unsure], new).astype(np.float64)) * (1 + OUTWARDS)
                unsure = unsure[upper[unsure] >= lower[unsure]]
                if len(unsure):
                    owner[unsure], upper[unsure], lower[unsure] = scan(points[unsure], new)
                yield to_rows([packed(row["ids"], points, owner, upper, lower, len(unsure), len(new))], schema)

    return blocks.mapInArrow(run, BLOCKS)


def totals(blocks: DataFrame, size: int) -> dict[int, tuple[int, float, list[int]]]:
    """By cluster: number of vectors, radius, exact sums. k rows and their limbs come to the driver."""
    parts = blocks.select(F.inline("stats")).groupBy("cluster", "limb").agg(
        F.sum("n").alias("n"), F.max("reach").alias("reach"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(size)]
    )
    out: dict[int, tuple[int, float, list[int]]] = {}
    for r in parts.collect():
        n, reach, sums = out.get(r["cluster"], (0, 0.0, [0] * size))
        sums = [s + (r[f"s{d}"] << (LIMB * r["limb"])) for d, s in enumerate(sums)]
        out[r["cluster"]] = (n + r["n"], max(reach, r["reach"]), sums)
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """Blocks of the last assignment and the final centroids; ``vectors`` has vec_id and embedding."""
    rows = kept(vectors, size)
    centres = starts(rows, k)
    if not centres:
        # no vector with an id: those without one have nothing to be assigned to
        return rows.sparkSession.createDataFrame([], BLOCKS), []
    blocks = cut(first_blocks(rows, centres, size, block))
    for _ in range(rounds):
        found = totals(blocks, size)
        moved = [[s // found[i][0] for s in found[i][2]] if i in found else c for i, c in enumerate(centres)]
        blocks = cut(moved_blocks(blocks, centres, moved, [found[i][1] if i in found else None for i in range(len(centres))], size))
        centres = moved
    return blocks, centres


def cluster_digest(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector."""
    blocks, centres = clustered(vectors, k, rounds, size)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]

    def distances(row: dict) -> tuple[np.ndarray, np.ndarray]:
        points, owner, _, _ = unpacked(row, size)
        return owner, own_squared(points, owner, centres)

    def inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("part", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                owner, found = distances(row)
                out = []
                for c in np.unique(owner).tolist():
                    digits = limbs(sum(int(x) for x in found[owner == c]))
                    out += [{"cluster": c, "limb": i, "part": x} for i, x in enumerate(digits)]
                yield to_rows(out, schema)

    by_cluster = [0] * len(centres)
    summed = blocks.mapInArrow(inertia, "cluster int, limb int, part long").groupBy("cluster", "limb").agg(F.sum("part").alias("part"))
    for r in summed.collect():
        by_cluster[r["cluster"]] += r["part"] << (LIMB * r["limb"])
    total = min(sum(by_cluster), LARGEST)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                owner, found = distances(row)
                of = pd.Series(owner)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(owner, pa.int32()),
                    pa.array([min(int(x), LARGEST) for x in found], pa.int64()),
                    pa.array(of.map(lambda c: min(by_cluster[c], LARGEST)).tolist(), pa.int64()),
                    pa.array([total] * len(owner), pa.int64()), pa.array(of.map(lambda c: hashes[c]).tolist(), pa.string()),
                ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def rounds_sql(k: int = K, rounds: int = ROUNDS) -> str:
    """The same by brute force: every distance in every round."""
    steps = [f"""
    kept as materialized (
        select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) as v
        from embeddings
        where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    comps as materialized (select r, unnest(range({SIZE})) as d, unnest(v) as x from kept),
    c0 as materialized (
        select s.cluster, t.d, t.x from (
            select r, row_number() over (order by sha256('1:' || vec_id), v) - 1 as cluster from kept where vec_id is not null
        ) s join comps t using (r) where s.cluster < {k}
    )"""]
    for i in range(rounds + 1):
        steps.append(f"""
    p{i} as materialized (
        select r, cluster, distance from (
            select r, cluster, distance, row_number() over (partition by r order by distance, cluster) as place from (
                select r, cluster, sum((p.x - c.x) * (p.x - c.x)) as distance from comps p join c{i} c using (d) group by r, cluster
            )
        ) where place = 1
    )""")
        if i < rounds:
            # a / b on huge integers is a double: // cuts towards zero, so negative sums are moved first
            steps.append(f"""
    m{i} as materialized (
        select cluster, d, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x
        from p{i} join comps using (r) group by cluster, d
    ),
    c{i + 1} as materialized (
        select c.cluster, c.d, coalesce(m.x, c.x) as x from c{i} c left join m{i} m on c.cluster = m.cluster and c.d = m.d
    )""")
    return f"""
    with {','.join(steps)},
    hashes as (select cluster, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from c{rounds} group by cluster)
    select k.vec_id, cast(p.cluster as integer) as cluster, cast(distance as bigint) as distance,
           cast(sum(distance) over (partition by p.cluster) as bigint) as cluster_inertia,
           cast(sum(distance) over () as bigint) as inertia, centroid_sha256
    from p{rounds} p join kept k using (r) join hashes h on p.cluster = h.cluster"""
