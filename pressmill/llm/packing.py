"""Packing along a space-filling curve.

Contract. Every row of documents becomes the ids of its whole text (null: empty) by the named
tokenizer without special tokens added, and then END. The ids are cut into pieces, each id in exactly
one, that fill sequences of LENGTH tokens without a gap. Repeated rows and null ids are packed like
any others. An empty table gives no pieces. Further columns are ignored.

Order. Token ids are hashed to signed directions; a document's mean direction is a vector of few
dimensions, and the place of that vector on a Hilbert curve is the document's key. Documents are
range-sorted by key and id, so those of one language and kind lie next to each other, and a group of
copies, which all have one key, is still dealt over several partitions. Each partition is packed
along the curve on its own; only its last sequence is not full, so padding is below LENGTH tokens
for about PARTITION tokens.

Tokens are stored in the shared checkpoint folder before the sort, which else would make them twice
(ranges are sampled first).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import cut
from pressmill.llm.toxicity import slices

LENGTH = 2048
END = 1
#: Dimensions of the projection and bits of each on the curve.
DIMENSIONS, BITS = 4, 15
#: Tokens that a packing task gets, about.
PARTITION = 1 << 22
#: Bytes of text handled at once.
BYTES = 1 << 22


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points of ``bits`` bits (Skilling, 2004, the transposed form)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess work of rotations and reflections
        low = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        turn ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> bit) & 1
    return key


def directions(count: int) -> np.ndarray:
    """A fixed pseudo-random vector from -1 to 1 for each token id."""
    seed = np.arange(1, count + 1, dtype=np.uint64)
    out = np.empty((count, DIMENSIONS), np.float32)
    for k in range(DIMENSIONS):
        x = (seed + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (x >> np.uint64(40)).astype(float) / (1 << 23) - 1
    return out


class Encoder:
    """The tokenizer of a file for the library tokenizers.

    Byte-level BPE whose merges are numbered in order (as here) is run by the faster library tiktoken
    from the same file; it gives the same ids. Texts with the string of a special token, and any
    other kind of tokenizer, go to tokenizers itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.fast = self.ranks(json.loads(self.tokenizer.to_str()))
        self.toward = directions(self.size)

    def ranks(self, told: dict):
        """The vocabulary as byte strings by rank, if merge order is id order."""
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if told.get("normalizer") or not plain or model.get("type") != "BPE":
            return None
        import tiktoken

        # bytes that are no visible characters of Latin-1 are written as characters from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in visible]
        to_byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(hidden)}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(to_byte[x] for x in token): no for token, no in model["vocab"].items() if token not in self.special}
        if len(ranks) != 256 + len(merges):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # byte-level pre-tokenizer
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The text's ids and END."""
        if self.fast is None or any(x in text for x in self.special):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        found.append(END)
        return np.array(found, self.dtype)

    def point(self, ids: np.ndarray) -> np.ndarray:
        """The document's place in few dimensions: the mean direction of its tokens, as whole numbers."""
        total = np.zeros(DIMENSIONS)
        for start in range(0, len(ids), 1 << 16):
            total += self.toward[ids[start : start + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return np.clip((total / len(ids) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, key, tokens, ids)`` of every row; ids are compressed little-endian words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, squeeze = Encoder(tokenizer), zstandard.ZstdCompressor(level=1).compress
        width = bytes([encoder.dtype.itemsize])
        for whole in batches:
            for batch in slices(whole, 1, BYTES):
                points, tokens, packed = [], [], []
                for text in batch.column(1):
                    ids = encoder.ids(text.as_py() or "")
                    points.append(encoder.point(ids))
                    tokens.append(len(ids))
                    packed.append(width + squeeze(ids.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(hilbert_key(np.array(points))), pa.array(tokens, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "key", "tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, key long, tokens long, ids binary"
    )


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``; ids are little-endian
    unsigned 32-bit words."""
    stored = cut(tokenized(docs, tokenizer))
    total = stored.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def emit(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            out, size = [[] for _ in names], 0
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer().to_pybytes()
                ids = np.frombuffer(expand(raw[1:]), "<u4" if raw[0] == 4 else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(length - offset, len(ids) - start)
                    row = (doc_id, start, n, ids[start : start + n].tobytes(), len(ids), sequence, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start, offset, size = start + n, offset + n, size + n
                    if offset == length:
                        sequence, offset = sequence + 1, 0
                if size > 1 << 22:
                    yield emit(out)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield emit(out)

    order = [F.col("key"), F.col("doc_id"), F.xxhash64("ids")]
    return (
        stored.repartitionByRange(max(1, -(-total // PARTITION)), *order).sortWithinPartitions(*order).select("doc_id", "ids")
        .mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )


def packing_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return packed(docs, tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
