"""Benchmark decontamination with a distributed positional inverted index.

Contract. A-Z are lower-cased; words are runs of digits, letters a-z and everything beyond ASCII, over whole
texts. A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.
A document word inside an occurrence of a window is hit. Every row of documents is a document, also
with a null or repeated id; null has no words. Item rows that share an id are one item; rows with a null
id hit words but are no item to count or list. Empty tables on either side give no hits. Columns other than
doc_id, text and item_id, text are not read.

Index. Documents are indexed where they lie, in segments of about SEGMENT words (a longer document is a
segment of its own): the terms, and for each one the sorted positions of all its occurrences. Positions run
on through a segment with a gap between documents, so no run of words leads from one into the next.
Segments are stored; ``phrases`` and ``near`` both search them, for any number of item tables.

Search. Every window looks for its rarest term first (by its count over all segments; terms of the items
only are counted). Windows that overlap as a rule share that term, so a place of an item is the anchor of all
the windows in which it is the rarest: its position list, moved by the offset of a neighbouring
term, is intersected with that term's list, outwards in both directions, and what is left are the runs
that hold a window. An item's anchors cover all its windows, so all occurrences are found. The lists of one
segment are spread out once into an array by position, which makes an intersection one look-up a candidate.

``near`` returns the windows all of whose different words lie within ``reach`` words of a document, in any
order, again from the rarest list: candidates lose those without the next rarest term nearby, and so on.

Scale. Nothing is shuffled for the index, and a document is never in two tasks. Items are the query set: they
are cut into blocks of at most BLOCK_BYTES, and each is sent to all segments; findings of several blocks are
merged by document, which is the only shuffle of a search. A word or passage that is in every document costs its
occurrences and nothing more. A lost executor repeats its segments.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import cut, give_back

WIDTH = 10
SEGMENT = 1 << 20
#: Bytes of item texts that are searched for at once, and bytes of a text that are split at once.
BLOCK_BYTES, SLICE = 4 << 20, 1 << 22

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
OTHER = re.compile(rb"[^0-9a-z\x80-\xff]")

SEGMENTS = (
    "segment long, docs array<bigint>, starts array<bigint>, words array<bigint>, terms binary, ends binary, lists binary, at binary"
)
FOUND = "segment long, place int, doc_id long, n_words long, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that fit in memory; no word is cut."""
    low, start = text.lower(), 0
    while start < len(low):
        end = start + SLICE
        if end < len(low):
            edge = OTHER.search(low, end)
            end = edge.start() if edge else len(low)
        yield WORD.findall(low, start, end)
        start = end


class Segment:
    """A segment while it is filled: ids of its terms and the documents with their first position."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.parts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.words: list[int] = []
        self.size = 0

    def add(self, doc: int | None, text: bytes) -> None:
        """Ids of terms are 1 and more; 0 marks the gap after a document."""
        self.docs.append(doc)
        self.starts.append(self.size)
        for found in words_of(text):
            self.parts.append(np.fromiter(map(self.ids.__getitem__, found), np.uint32, len(found)) + 1)
            self.size += len(found)
        self.words.append(self.size - self.starts[-1])
        self.parts.append(np.zeros(1, np.uint32))
        self.size += 1

    def row(self, number: int) -> dict:
        tokens = np.concatenate(self.parts)
        if len(self.ids) < 1 << 16:
            tokens = tokens.astype(np.uint16)  # sorted by radix
        order = np.argsort(tokens, kind="stable").astype(np.uint32)
        counts = np.bincount(tokens, minlength=len(self.ids) + 1)
        terms = list(self.ids)
        return {
            "segment": number, "docs": self.docs, "starts": self.starts, "words": self.words, "terms": b"".join(terms),
            "ends": np.cumsum([len(t) for t in terms], dtype=np.uint64).tobytes(),
            "lists": np.cumsum(counts[1:], dtype=np.uint64).tobytes(), "at": order[counts[0] :].tobytes(),
        }


def segment_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([
        ("segment", pa.int64()), ("docs", longs), ("starts", longs), ("words", longs),
        ("terms", pa.large_binary()), ("ends", pa.large_binary()), ("lists", pa.large_binary()), ("at", pa.large_binary()),
    ])


def index_of(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The stored index of all rows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, kinds = segment_schema(), pa.schema([(f.name, pa.binary() if f.type == pa.large_binary() else f.type) for f in segment_schema()])
        number, open_one = TaskContext.get().partitionId() << 32, Segment()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                open_one.add(doc, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if open_one.size >= segment:
                    yield pa.RecordBatch.from_pylist([open_one.row(number)], schema=schema).cast(kinds)
                    number, open_one = number + 1, Segment()
        if open_one.docs:
            yield pa.RecordBatch.from_pylist([open_one.row(number)], schema=schema).cast(kinds)
        give_back()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEGMENTS))


class Lists:
    """A stored segment as a search reads it."""

    def __init__(self, row: dict) -> None:
        self.docs, self.words = row["docs"], row["words"]
        self.starts = np.array(row["starts"], np.int64)
        self.ends = np.frombuffer(row["ends"], np.uint64).astype(np.int64)
        self.terms = row["terms"]
        self.stops = np.concatenate([[0], np.frombuffer(row["lists"], np.uint64).astype(np.int64)])
        self.at = np.frombuffer(row["at"], np.uint32)

    def numbers(self, wanted: dict[bytes, int]) -> np.ndarray:
        """For each wanted term its number in this segment, -1 if it is not there."""
        out, start = np.full(len(wanted), -1, np.int64), 0
        for number, end in enumerate(self.ends.tolist()):
            place = wanted.get(self.terms[start:end])
            if place is not None:
                out[place] = number
            start = end
        return out

    def list_of(self, number: int) -> np.ndarray:
        return self.at[self.stops[number] : self.stops[number + 1]].astype(np.int64)

    def by_position(self) -> np.ndarray:
        """All lists at once: the term at each position, -1 in the gaps."""
        out = np.full(int(self.starts[-1]) + self.words[-1] + 1, -1, np.int64)
        out[self.at] = np.repeat(np.arange(len(self.stops) - 1), np.diff(self.stops))
        return out


def items_in_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items with words, in blocks of at most ``most`` bytes of text (one item may be longer).

    Blocks are fetched one after the other, so the driver holds one block and what is sent of it.
    """
    sized = cut(items.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("text")).where("text is not null"))
    # blocks by range of a running size: rows of one hash slice are summed in it, slices are as many as blocks could be
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, 2 * total // most)
    inside = Window.partitionBy("slice").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sized.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))).withColumn(
        "block", F.floor(F.coalesce(F.sum(F.length("text")).over(inside), F.lit(0)) / most)
    )
    blocks = [(r["slice"], r["block"]) for r in dealt.select("slice", "block").distinct().orderBy("slice", "block").collect()]
    for slice_no, block in blocks:
        rows = dealt.where((F.col("slice") == slice_no) & (F.col("block") == block)).select("item_id", "text").collect()
        read = [(r["item_id"], [w for part in words_of(bytes(r["text"])) for w in part]) for r in sorted(rows, key=lambda r: (r["item_id"] or "", bytes(r["text"])))]
        yield [(i, w) for i, w in read if w]


def term_counts(index: DataFrame, wanted: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each wanted term in all segments."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row | {"docs": [], "words": [], "starts": [], "at": b""})
                number = lists.numbers(sent.value)
                here = number >= 0
                total[here] += np.diff(lists.stops)[number[here]]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["term", "n"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "ends", "lists").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def anchors_of(terms: Sequence[int], counts: np.ndarray, width: int) -> list[int]:
    """Places of an item that are the rarest of a window: every window holds one of them."""
    rare = counts[np.array(terms)]
    windows = np.lib.stride_tricks.sliding_window_view(rare, min(width, len(terms)))
    return np.unique(windows.argmin(1) + np.arange(len(windows))).tolist()


def phrase_spans(lists: Lists, items: list[list[int]], anchors: list[list[int]], number: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(item, first positions, last positions)`` of the runs of item words that hold a window."""
    by_position = lists.by_position()
    for item, terms in enumerate(items):
        wanted = number[np.array(terms)]
        size = min(width, len(terms))
        for place in anchors[item]:
            if wanted[place] < 0:
                continue
            at = lists.list_of(int(wanted[place]))
            left = reach(by_position, at, wanted, place, -1, size)
            right = reach(by_position, at, wanted, place, 1, size)
            whole = left + right + 1 >= size
            if whole.any():
                yield item, at[whole] - left[whole], at[whole] + right[whole]


def reach(by_position: np.ndarray, at: np.ndarray, wanted: np.ndarray, place: int, step: int, size: int) -> np.ndarray:
    """How many item words in a row follow (or precede) each candidate, size - 1 at most."""
    out, alive = np.zeros(len(at), np.int64), np.arange(len(at))
    for far in range(1, size):
        other = place + step * far
        if not 0 <= other < len(wanted) or wanted[other] < 0 or not len(alive):
            break
        spot = at[alive] + step * far
        inside = (spot >= 0) & (spot < len(by_position))
        alive, spot = alive[inside], spot[inside]
        alive = alive[by_position[spot] == wanted[other]]
        out[alive] = far
    return out


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order])
    opens = np.concatenate([[True], first[1:] > end[:-1] + 1])
    return first[opens], end[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(end) - 1]])]


def phrases(index: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every document with its hit spans (word numbers from 0) and the ids of its items, as FOUND names them."""
    found = [block_phrases(index, block, width) for block in items_in_blocks(items)]
    if len(found) == 1:
        return found[0]
    # the empty block gives every document its row, whatever the items are
    both = block_phrases(index, [], width)
    for one in found:
        both = both.unionAll(one.where((F.size("spans") > 0) | (F.size("items") > 0)))
    return both.groupBy("segment", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        one_by_one(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def one_by_one(spans: Column) -> Column:
    """Sorted spans with overlaps joined."""
    kind = "array<struct<first:bigint,last:bigint>>"
    joins = lambda done, x: x["first"] <= F.element_at(done, -1)["last"] + 1

    def add(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        grown = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))
        return F.when((F.size(done) > 0) & joins(done, x), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def block_phrases(index: DataFrame, block: list[tuple[str | None, list[bytes]]], width: int) -> DataFrame:
    wanted = {t: i for i, t in enumerate(sorted({w for _, words in block for w in words}))}
    counts = term_counts(index, wanted) if wanted else np.zeros(0, np.int64)
    numbers = [[wanted[w] for w in words] for _, words in block]
    sent = index.sparkSession.sparkContext.broadcast((wanted, [i for i, _ in block], numbers, [anchors_of(x, counts, width) for x in numbers]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, names, numbers, anchors = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                yield found_in(Lists(row), row["segment"], wanted, names, numbers, anchors, width)
        give_back()

    return index.mapInArrow(run, FOUND)


def found_in(lists: Lists, segment: int, wanted: dict, names: list, numbers: list, anchors: list, width: int) -> pa.RecordBatch:
    of_doc: dict[int, set[str]] = {}
    firsts, lasts = [], []
    for item, first, last in phrase_spans(lists, numbers, anchors, lists.numbers(wanted), width):
        firsts.append(first)
        lasts.append(last)
        if names[item] is not None:
            for doc in np.unique(np.searchsorted(lists.starts, first, "right") - 1).tolist():
                of_doc.setdefault(doc, set()).add(names[item])
    spans: list[list[dict]] = [[] for _ in lists.docs]
    if firsts:
        first, last = merged(np.concatenate(firsts), np.concatenate(lasts))
        for doc, a, b in zip((np.searchsorted(lists.starts, first, "right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
            base = int(lists.starts[doc])
            spans[doc].append({"first": a - base, "last": b - base})
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.RecordBatch.from_arrays([
        pa.array([segment] * len(lists.docs), pa.int64()), pa.array(range(len(lists.docs)), pa.int32()), pa.array(lists.docs, pa.int64()),
        pa.array(lists.words, pa.int64()), pa.array(spans, span),
        pa.array([sorted(of_doc.get(d, ())) for d in range(len(lists.docs))], pa.list_(pa.string())),
    ], names=["segment", "place", "doc_id", "n_words", "spans", "items"])


def near(index: DataFrame, items: DataFrame, width: int = WIDTH, reach: int = 2 * WIDTH) -> DataFrame:
    """``(doc_id, item_id, window, first)``: the windows of items (numbered by their first word) whose different words all
    lie within ``reach`` words of a document, from word ``first`` of it on; one row for each rarest word that begins none earlier."""
    found = [block_near(index, block, width, reach) for block in items_in_blocks(items)]
    out = index.sparkSession.createDataFrame([], "doc_id long, item_id string, window int, first long")
    for one in found:
        out = out.unionAll(one)
    return out.distinct()


def block_near(index: DataFrame, block: list[tuple[str | None, list[bytes]]], width: int, reach: int) -> DataFrame:
    wanted = {t: i for i, t in enumerate(sorted({w for _, words in block for w in words}))}
    counts = term_counts(index, wanted) if wanted else np.zeros(0, np.int64)
    windows = []
    for name, words in block:
        numbers, size = [wanted[w] for w in words], min(width, len(words))
        for start in range(len(words) - size + 1):
            terms = sorted(set(numbers[start : start + size]), key=lambda t: (counts[t], t))
            windows.append((name, start, terms))
    sent = index.sparkSession.sparkContext.broadcast((wanted, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, windows = sent.value
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("window", pa.int32()), ("first", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row)
                number, out = lists.numbers(wanted), []
                for name, window, terms in windows:
                    for first in near_starts(lists, number[np.array(terms)], reach).tolist():
                        doc = int(np.searchsorted(lists.starts, first, "right")) - 1
                        out.append({"doc_id": lists.docs[doc], "item_id": name, "window": window, "first": first - int(lists.starts[doc])})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return index.mapInArrow(run, "doc_id long, item_id string, window int, first long")


def near_starts(lists: Lists, terms: np.ndarray, reach: int) -> np.ndarray:
    """First positions of the tightest stretches of at most ``reach`` words of one document that hold all terms.

    ``terms`` are numbers of this segment, rarest first. For each occurrence of the rarest one every stretch of
    ``reach`` words around it is a candidate; a term's list keeps those that it reaches into.
    """
    if (terms < 0).any():
        return np.zeros(0, np.int64)
    rare = lists.list_of(int(terms[0]))
    others = [lists.list_of(int(t)) for t in terms[1:]]
    for at in others:  # some occurrence close enough, or the candidate goes
        rare = rare[np.searchsorted(at, rare - reach + 1) < np.searchsorted(at, rare + reach)]
    doc = np.searchsorted(lists.starts, rare, "right") - 1
    begins = lists.starts[doc]
    starts = (rare[:, None] - np.arange(reach)[None, :]).ravel()
    low, high = np.repeat(begins, reach), np.repeat(begins + np.array(lists.words, np.int64)[doc], reach)
    holds = starts >= low
    firsts = np.repeat(rare, reach)
    for at in others:
        where = np.searchsorted(at, starts)
        hit = np.where(where < len(at), at[np.minimum(where, len(at) - 1)], np.iinfo(np.int64).max)
        holds &= (hit < starts + reach) & (hit < high)
        firsts = np.minimum(firsts, hit)
    # a stretch begins with its first term: of several that hold the same words one is left
    return np.unique(firsts[holds])


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row of docs."""
    found = phrases(index_of(docs), items, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that hold no window of any item; ids must be unique."""
    bad = contaminated(docs, items, width).where("contaminated").select(F.col("doc_id").alias("__hit_id"))
    return docs.join(bad, docs["doc_id"] == F.col("__hit_id"), "left_anti")


CONTAMINATED_SQL = f"""
    with d as materialized (
        select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
        from documents
    ),
    i as materialized (
        select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
        from benchmark
    ),
    win as materialized (
        select distinct item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as p
        from (select item_id, w, least(len(w), {WIDTH}) as n, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) as s from i where len(w) > 0)
    ),
    occ as materialized (
        select r, s, g.n, item_id from (
            select r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as p
            from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d cross join (select distinct n from win) where len(w) >= n)
        ) g join win on g.n = win.n and g.p = win.p
    ),
    hit as (select r, count(distinct k) as n_hit from (select r, unnest(range(s, s + n)) as k from (select distinct r, s, n from occ)) group by r),
    its as (
        select r, count(*) as n_items, string_agg(x, ',' order by x) as l
        from (select distinct r, cast(item_id as varchar) as x from occ where item_id is not null) group by r
    )
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
           sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (r) left join its using (r)"""
