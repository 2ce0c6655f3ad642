"""Removal of long repeated substrings with suffix arrays over shards.

Contract. Every text is its UTF-8 bytes (null: none). A byte is removed if some LENGTH-byte string
that covers it also starts at another place of any document, the same one included; overlaps count,
strings are judged on the input, and no match crosses documents. Texts shorter than LENGTH stay.
Rows that repeat an id are documents of their own (equal rows are exact copies of each other); rows
with null ids take part like any other. An empty table gives an empty result. Further columns are
carried along by ``without_repeats`` and ignored otherwise.

Plan.

1. *Routing.* A window of LENGTH bytes is represented by the least hash among its GRAM-byte grams,
   the leftmost if equal. Equal windows have the same one at the same offset. Consecutive windows
   with one representative form a context; a text has about one for 170 bytes. Contexts whose
   gram occurs once in the whole table hold no repeated window and leave here.
2. *Folding.* Contexts with equal bytes are counted as one before anything is gathered, so a group
   of copies costs one context, whatever its size.
3. *Suffix arrays.* Contexts with equal grams meet in one shard of bounded size. Larsson-Sadakane
   refinement sorts the windows of a shard, Kasai's walk gives the common prefixes, and a window is
   repeated if it shares LENGTH bytes with its neighbour in the array. A gram with more than SPLIT
   different contexts is spread over several shards.
4. *Merging.* For those grams every shard also passes on its sorted distinct windows as 128-bit
   fingerprints, in slices by value; the lists of a slice are merged by binary search, and a
   window that two shards hold is repeated.
5. The repeated windows of a context are those of all documents that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm.common import cut, give_back, small_batches
from pressmill.llm.suffix_array import kasai, suffix_array, words_at

LENGTH = 400
GRAM = 64
#: Bytes of documents hashed at once; a longer document is hashed in such pieces. Hashing takes about 80 times as much memory.
CHUNK = 1 << 18
#: Bytes of contexts in a suffix array (sorting takes about 110 times as much), and the different contexts of one gram that one may hold.
SHARD = 1 << 18
SPLIT = 1000
#: Fingerprints of windows that a merging task gets at once, about.
SLICE = 500_000

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on (GRAM is a power of two of 8 at least)."""
    out, length = mixed(words_at(data)), 8
    while length < GRAM:
        out = mixed(out[: len(out) - length] * BASE + out[length:])
        length *= 2
    return out[: max(0, len(data) - GRAM + 1)]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    filled = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(first window, windows, gram hash, hash of the bytes)`` of the contexts of joined texts.

    ends: where each text ends in data.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    hashes = gram_hashes(data)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(hashes >> np.uint64(24) << np.uint64(24) | place, LENGTH - GRAM + 1)
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    whole = np.arange(len(least)) + LENGTH <= ends[text]
    window = np.flatnonzero(whole)
    if not len(window):
        return none, none, none, none
    least, text = least[window], text[window]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    start = np.flatnonzero(new)
    first, count = window[start], np.diff(np.concatenate([start, [len(window)]]))
    gram = hashes[(least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)]
    # hash of bytes first .. first + count - 1 + LENGTH, from sums of byte values times powers
    table = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
    powers = np.full(len(data), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(table[data] * powers)])
    powers = np.full(len(data), INVERSE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    last = first + count - 1 + LENGTH
    content = mixed((sums[last] - sums[first]) * powers[first] + count.astype(np.uint64))
    return first, count, gram.view(np.int64), content.view(np.int64)


def with_keys(docs: DataFrame) -> DataFrame:
    """Names each row by id and hash of the text; equal rows share the name and all that is found."""
    return docs.withColumns({
        "__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
        "__th": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
    })


def contexts(named: DataFrame) -> DataFrame:
    """``(gram, content, __did, __th, at)``; at holds the first window and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            group, size = [], 0

            def solve(group: list) -> pa.RecordBatch:
                data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
                lengths = np.array([len(x[2]) for x in group])
                ends = np.cumsum(lengths)
                first, count, gram, content = contexts_of(data, ends)
                of = np.searchsorted(ends, first, side="right")
                row = np.array([x[0] for x in group])[of]
                offset = np.array([x[1] for x in group])[of] + first - (ends - lengths)[of]
                arrays = [gram, content, did[row], th[row], offset << 10 | count]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["gram", "content", "did", "th", "at"])

            for row, value in enumerate(batch.column(2)):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                for start in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
                    piece = data[start : start + CHUNK + LENGTH - 1]
                    if len(piece) >= LENGTH:
                        group.append((row, start, piece))
                        size += len(piece)
                    if size >= CHUNK:
                        yield solve(group)
                        group, size = [], 0
            if group:
                yield solve(group)
        give_back()

    return named.select("__did", "__th", F.col("text").cast("string").alias("text")).where(
        F.octet_length("text") >= LENGTH
    ).mapInArrow(run, "gram long, content long, __did long, __th long, at long")


def cut_out(rows: DataFrame) -> DataFrame:
    """Bytes of the contexts that ``wanted`` names in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer()
                for x in wanted.values.to_pylist():
                    first, count = x["at"] >> 10, x["at"] & 1023
                    for column, value in zip(out, (
                        x["gram"], x["content"], x["copies"], x["salts"], x["contexts"],
                        data[first : first + count - 1 + LENGTH].to_pybytes(),
                    ), strict=True):
                        column.append(value)
                if sum(map(len, out[5][-1:])) and len(out[5]) >= 4096:
                    yield packed(out)
                    out = [[], [], [], [], [], []]
            if out[0]:
                yield packed(out)
        give_back()

    def packed(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)],
            names=["gram", "content", "copies", "salts", "contexts", "bytes"],
        )

    return rows.mapInArrow(run, "gram long, content long, copies long, salts long, contexts long, bytes binary")


def fingerprints(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of the LENGTH bytes from each start on, as rows of two words."""
    words = words_at(data)
    out = np.zeros((len(starts), 2), np.uint64)
    for k in range(0, LENGTH, 8):  # LENGTH is a multiple of 8
        word = words[starts + k]
        out[:, 0] = mixed(out[:, 0] * BASE + word)
        out[:, 1] = mixed(out[:, 1] * MIX ^ word)
    return out


def solve_shard(grams: list, names: list, copies: list, slices: list, parts: list) -> Iterator[tuple]:
    """Repeated runs ``(gram, content, first byte, end byte, None, None)`` of a shard's contexts; for grams
    spread over shards also ``(gram, content, None, None, slice, sorted windows)``."""
    lengths = np.array([len(x) for x in parts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = ends - lengths
    counts = lengths - LENGTH + 1
    wanted = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    of_byte = np.repeat(ends, lengths)
    order = suffix_array(data, of_byte, wanted, LENGTH)
    shared = kasai(data, of_byte, order, LENGTH) >= LENGTH
    repeated = np.zeros(len(data), bool)
    repeated[order[shared]] = True
    repeated[order[np.flatnonzero(shared) - 1]] = True
    for k in range(len(parts)):
        if copies[k] == 1:  # folded contexts are repeated as a whole
            windows = np.concatenate([[False], repeated[begin[k] : begin[k] + counts[k]], [False]])
            edges = np.flatnonzero(windows[1:] != windows[:-1])
            for first, end in zip(edges[::2], edges[1::2], strict=True):
                yield grams[k], names[k], int(first), int(end) - 1 + LENGTH, None, None
    spread = np.flatnonzero(np.array(slices) > 0)
    if not len(spread):
        return
    # one window of each group of equals, the groups' later members are marked already
    later = np.zeros(len(data), bool)
    later[order[shared]] = True
    for gram in np.unique(np.array(grams)[spread]):
        own = [k for k in spread if grams[k] == gram]
        start = np.concatenate([np.arange(begin[k], begin[k] + counts[k]) for k in own])
        name = np.repeat(np.array([names[k] for k in own]), counts[own])
        offset = start - np.repeat(begin[own], counts[own])
        alone = ~later[start]
        start, name, offset = start[alone], name[alone], offset[alone]
        prints = fingerprints(data, start)
        place = np.lexsort((prints[:, 1], prints[:, 0]))
        prints, name, offset = prints[place], name[place], offset[place]
        n = slices[own[0]]
        slice_of = (prints[:, 0] >> np.uint64(40)).astype(np.int64) * n >> 24
        for k in np.unique(slice_of):
            low, high = np.searchsorted(slice_of, [k, k + 1])
            table = np.column_stack([
                prints[low:high].view(np.int64), name[low:high].astype(np.int64), offset[low:high]
            ])
            yield int(gram), 0, None, None, int(k), table.astype("<i8").tobytes()


def shards(cuts: DataFrame) -> DataFrame:
    """Suffix arrays over the contexts dealt by gram and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram and salt; a shard takes whole groups until it is full."""
        held: list[list] = [[], [], [], [], []]
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(solve_shard(*held))
            for column in held:
                column.clear()
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["gram", "content", "first", "end", "slice", "windows"],
                )

        for batch in batches:
            gram, content, copies, salt, slices = (batch.column(k).to_pylist() for k in range(5))
            for k, value in enumerate(batch.column(5)):
                key = (gram[k], salt[k])
                if size >= SHARD and key != last:
                    yield from flush()
                    size = 0
                last, part = key, value.as_buffer().to_pybytes()
                for column, x in zip(held, (gram[k], content[k], copies[k], slices[k], part), strict=True):
                    column.append(x)
                size += len(part)
        if held[0]:
            yield from flush()
        give_back()

    dealt = cuts.select(
        "gram", "content", "copies", F.pmod("content", "salts").alias("salt"),
        F.when(F.col("salts") > 1, F.ceil(F.col("contexts") * LENGTH / SLICE)).otherwise(0).cast("long").alias("slices"),
        "bytes",
    ).repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return dealt.mapInArrow(run, "gram long, content long, first long, end long, slice long, windows binary")


def merge_sorted(lists: list[np.ndarray]) -> np.ndarray:
    """Merges lists sorted by their first two columns, two at a time, each into the other by binary search."""
    def keys(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x[:, :2].astype("<u8").astype(">u8")).view("S16").ravel()

    while len(lists) > 1:
        merged = []
        for a, b in zip(lists[::2], lists[1::2], strict=False):
            # a fixed-length byte string drops zeros at its end, which keeps the order of these keys
            into = np.searchsorted(keys(a), keys(b), side="right") + np.arange(len(b))
            out = np.empty((len(a) + len(b), a.shape[1]), a.dtype)
            mine = np.ones(len(out), bool)
            mine[into] = False
            out[into], out[mine] = b, a
            merged.append(out)
        lists = merged + (lists[-1:] if len(lists) % 2 else [])
    return lists[0]


def merged_shards(windows: DataFrame) -> DataFrame:
    """Windows that several shards of a gram hold, as runs like those of ``shards``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            table = merge_sorted(held)
            same = (table[1:, 0] == table[:-1, 0]) & (table[1:, 1] == table[:-1, 1])
            twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if twice.any():
                hit = table[twice]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), last[0])), pa.array(hit[:, 2]), pa.array(hit[:, 3]), pa.array(hit[:, 3] + LENGTH)],
                    names=["gram", "content", "first", "end"],
                )

        for batch in batches:
            for gram, part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (gram, part) != last:
                    yield from flush()
                    held = []
                last = (gram, part)
                held.append(np.frombuffer(value.as_buffer(), "<i8").reshape(-1, 4))
        if held:
            yield from flush()

    return (
        windows.select("gram", "slice", "windows").repartition("gram", "slice").sortWithinPartitions("gram", "slice")
        .mapInArrow(run, "gram long, content long, first long, end long")
    )


def repeated_spans(named: DataFrame) -> DataFrame:
    """``(__did, __th, __spans)`` of the texts with repeated bytes; spans are pairs of first and end byte, unmerged."""
    everything = cut(contexts(named))
    # stored, so that both sides of the join are plain exchanges and Spark can split a hot gram
    grams = cut(everything.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("of")))
    common = cut(everything.join(grams, F.col("gram") == F.col("of"), "left_semi"))
    del everything
    folded = common.groupBy("gram", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("__did", "__th", "at")).alias("one")
    )
    folded = cut(folded)
    several = cut(folded.groupBy(F.col("gram").alias("of")).agg(F.count("*").alias("contexts")).where("contexts > 1"))
    wanted = (
        folded.join(several, F.col("gram") == F.col("of"))
        .withColumn("salts", F.ceil(F.col("contexts") / SPLIT))
        .groupBy(F.col("one.__did").alias("w_did"), F.col("one.__th").alias("w_th"))
        .agg(F.collect_list(F.struct("gram", "content", "copies", "salts", "contexts", F.col("one.at").alias("at"))).alias("wanted"))
    )
    # equal rows share a name; their contexts are cut out of one of them
    texts = named.select("__did", "__th", "text").where(F.octet_length("text") >= LENGTH)
    sources = texts.join(wanted, (F.col("__did") == F.col("w_did")) & (F.col("__th") == F.col("w_th"))).select("text", "wanted")
    found = cut(shards(cut_out(sources)))
    runs = found.where("first is not null").select("gram", "content", "first", "end")
    across = merged_shards(found.where("windows is not null"))
    whole = folded.where("copies > 1").select(
        "gram", "content", F.lit(0).cast("long").alias("first"), (F.col("one.at").bitwiseAND(F.lit(1023)) - 1 + LENGTH).alias("end")
    )
    spans = whole.unionAll(runs).unionAll(across).select(
        F.col("gram").alias("f_gram"), F.col("content").alias("f_content"), "first", "end"
    )
    start = F.shiftright("at", 10)
    return (
        common.join(spans, (F.col("gram") == F.col("f_gram")) & (F.col("content") == F.col("f_content")))
        .select("__did", "__th", F.struct((start + F.col("first")).alias("first"), (start + F.col("end")).alias("end")).alias("span"))
        .groupBy(F.col("__did").alias("__s_did"), F.col("__th").alias("__s_th")).agg(F.collect_set("span").alias("__spans"))
    )


def kept_parts(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of data without the spans, the bytes removed and their maximal runs."""
    out, at, removed, runs = [], 0, 0, 0
    first = end = None
    for x in [*sorted((x["first"], x["end"]) for x in spans), (len(data) + 1, len(data) + 1)]:
        if first is None:
            first, end = x
        elif x[0] <= end:
            end = max(end, x[1])
        else:
            out.append(data[at:first])
            removed, runs, at = removed + end - first, runs + 1, end
            first, end = x
    out.append(data[at:])
    return b"".join(out), removed, runs


def with_kept(docs: DataFrame, decode: bool = False) -> DataFrame:
    """All rows and columns of docs but text, with ``__kept`` (the remaining bytes), ``__bytes``, ``__removed``, ``__runs``.

    decode: ``__kept`` as text; characters cut in two at the edge of a removal go whole.
    """
    small_batches(docs.sparkSession)
    named = with_keys(docs)
    found = repeated_spans(named)
    others = [x for x in docs.columns if x != "text"]
    joined = named.join(found, (F.col("__did") == F.col("__s_did")) & (F.col("__th") == F.col("__s_th")), "left").select(
        *others, "text", "__spans"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed, runs = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("__spans"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                parts = kept_parts(data, spans.as_py()) if spans.is_valid else (data, 0, 0)
                left = parts[0].decode("utf-8", "ignore") if decode else parts[0]
                for column, value in zip((kept, total, removed, runs), (left, len(data), *parts[1:]), strict=True):
                    column.append(value)
            counts = [pa.array(x, pa.int64()) for x in (total, removed, runs)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in others), pa.array(kept, pa.string() if decode else pa.binary()), *counts],
                names=[*others, "__kept", "__bytes", "__removed", "__runs"],
            )
        give_back()

    out = T.StructType([docs.schema[x] for x in others])
    out = out.add("__kept", "string" if decode else "binary").add("__bytes", "long").add("__removed", "long").add("__runs", "long")
    return joined.mapInArrow(run, out)


def removal_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    return with_kept(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"),
        F.col("__runs").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the remaining text; characters cut in two at the edge of a removal go whole."""
    return with_kept(docs, decode=True).withColumnRenamed("__kept", "text").select(*docs.columns)
