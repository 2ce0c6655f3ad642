"""Near-duplicates by SimHash, with pivot distance tables for the search.

Contract. A text is lower-cased in A-Z, its words are runs of anything but space and \\t..\\r, its
shingles are three words joined by one space, repeats included (fewer words: the whole sequence).
A fingerprint bit is set if over half of the shingles' XXH64 (seed 42) have it. No words, also for
a null text, give fingerprint zero, which links like any other. Fingerprints with at most two
differing bits are linked; a document's class is the smallest document id it reaches.

Repeated rows of one id count as one document with the smallest fingerprint; rows without an id are
not part of the result. An empty table gives an empty result. Further columns are ignored.

Search. Only distinct fingerprints are compared. Two of them that differ in two bits at most agree
in two of four quarters at least, so each is dealt to six blocks (one for each pair of quarters and
its value); no other pair can be linked. Blocks only spread the work. Inside a block, every
fingerprint's Hamming distances to many reference fingerprints form a table sorted by the first
distance; a pair is discarded as soon as one coordinate differs by more than two (triangle
inequality), and survivors are verified on all 64 bits. Of the links of a block a spanning forest
is passed on, which has the same classes: a row for each fingerprint at most, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import classes, cut, give_back, small_batches

SEED = 42
WORDS = 3
RADIUS = 2
#: Reference fingerprints of the pivot table: fixed, spread evenly over the space.
PIVOTS = 32
#: Fingerprints of a block compared at once; bounds the memory of a task.
STRIP = 1024


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:], strict=False)]
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bits of a very long text, a piece at a time
        part = np.array(hashes[start : start + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, bits)``, one row per document; bits is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "bits"])
        give_back()

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.where("doc_id is not null").mapInArrow(run, "doc_id long, bits long")


def pivot_table(bits: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot, one row per fingerprint."""
    return np.bitwise_count(bits[:, None] ^ pivots[None, :]).astype(np.int8)


def reference_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, count, np.uint64)


def linked_pairs(bits: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct fingerprints at distance 2 or less, a strip of the sorted table at a time."""
    coordinates = pivot_table(bits, pivots)
    order = np.argsort(coordinates[:, 0], kind="stable")
    table, ordered = coordinates[order], bits[order]
    first = table[:, 0]
    reach = np.searchsorted(first, first + RADIUS, side="right")
    for start in range(0, len(bits), STRIP):
        stop = min(start + STRIP, len(bits))
        for low in range(start, int(reach[stop - 1]), STRIP):
            high = min(low + STRIP, int(reach[stop - 1]))
            alive = np.abs(table[start:stop, 0][:, None] - table[low:high, 0][None, :]) <= RADIUS
            a, b = np.nonzero(alive & (np.arange(start, stop)[:, None] < np.arange(low, high)[None, :]))
            for column in range(1, len(pivots)):
                keep = np.abs(table[start + a, column] - table[low + b, column]) <= RADIUS
                if not len(keep):
                    break
                a, b = a[keep], b[keep]
            near = np.bitwise_count(ordered[start + a] ^ ordered[low + b]) <= RADIUS
            if near.any():
                yield order[start + a[near]], order[low + b[near]]


def forest(bits: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest index of its class within the block."""
    root = np.arange(len(bits))
    for a, b in linked_pairs(bits, pivots):
        while True:  # take over the smaller root along all links until nothing moves
            low = np.minimum(root[a], root[b])
            moved = (root[a] != low) | (root[b] != low)
            if not moved.any():
                break
            a, b, low = a[moved], b[moved], low[moved]
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while not np.array_equal(root, root[root]):
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(bits)))
    return child, root[child]


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)`` of distinct fingerprints (column bits): links with the classes of all pairs within RADIUS."""
    quarter = lambda k: F.shiftrightunsigned("bits", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = [
        F.struct(F.lit(no).alias("pair"), (quarter(i) * F.lit(65536) + quarter(j)).alias("value"))
        for no, (i, j) in enumerate(combinations(range(4), 2))
    ]
    dealt = distinct.select("bits", F.explode(F.array(*keys)).alias("key")).select("bits", "key.pair", "key.value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block is finished when the next one begins."""
        pivots, held = reference_fingerprints(), []

        def solve(parts: list) -> pa.RecordBatch | None:
            bits = np.unique(np.concatenate(parts)).view(np.uint64)
            if len(bits) < 2:
                return None
            child, root = forest(bits, pivots)
            if not len(child):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(bits[child].view(np.int64)), pa.array(bits[root].view(np.int64))], names=["a", "b"]
            )

        last = None
        for batch in batches:
            bits = batch.column(0).to_numpy()
            pair, value = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(bits):
                continue
            key = pair.astype(np.int64) << 32 | value
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            lengths = np.diff(starts)
            for at in np.flatnonzero((lengths > 1) | (starts[:-1] == 0) | (starts[1:] == len(key))):
                low, high = starts[at], starts[at + 1]
                if held and key[low] != last:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                held.append(bits[low:high])
                last = key[low]
        if held and (out := solve(held)) is not None:
            yield out

    return (
        dealt.repartition("pair", "value").sortWithinPartitions("pair", "value")
        .mapInArrow(run, "a long, b long").distinct()
    )


def simhash_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document; see the module."""
    prints = cut(fingerprints(docs).groupBy("doc_id").agg(F.min("bits").alias("bits")))
    distinct = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = classes(links(distinct.select("bits")))
    # a class of fingerprints takes the smallest document id of all its members
    named = distinct.join(roots, F.col("bits") == F.col("node"), "left").withColumn("root", F.coalesce("root", "bits"))
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    known = named.join(least, F.col("root") == F.col("of")).select(F.col("bits").alias("fp"), "component_id")
    return prints.join(known, F.col("bits") == F.col("fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which the id is the smallest of its class, all columns kept; one row per id.

    Rows that repeat an id count as copies of one document: one of them stays (the smallest text).
    Rows without an id stay as they are.
    """
    keep = simhash_classes(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id"))
    kept = docs.join(keep, docs["doc_id"] == F.col("__kept_id"), "left_semi")
    order = Window.partitionBy("doc_id").orderBy("text")  # shares the exchange of the join
    one = kept.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return one.unionByName(docs.where("doc_id is null"))
