"""Source divergence audit by chunk factorization.

Contract. Null text, lang and source read as ''. Terms are runs of letters and of everything beyond ASCII, with
only A-Z lower-cased. Every row is a document, also with a null or repeated id. Each lang keeps the V terms that
at least ``min_docs`` of its documents hold. A group (lang, source) and a lang as a whole give each kept term
``p = 1 + floor(SCALE * (count + 1) / (N + V))``, N the sum of its counts over kept terms. The divergence of a term
is ``floor((p - q)^2 / q)``. Part ``pair``: every other source of the lang, q its p, the sum over all kept terms, all ranks
(0 without kept terms; no row where the lang has one source). Part ``term``: every kept term of the group with p > q, q
the lang's p, ranks to ``top``. Ranks go by falling value, then by item in the order of its UTF-8 bytes. All arithmetic
is exact (long and decimal). An empty table gives an empty result; columns other than text, lang and source are not read.

Factorization. Words repeat, so texts are not tokenized one by one. Every document is cut at white space (ASCII, which no
term contains) and its chunks are counted; each chunk that occurs anywhere is tokenized once; and its terms are joined back
to all its occurrences. ``The``, ``the,`` and ``(the)`` are three chunks of one term, so documents are
only told apart after that join.

Plan. A task gathers the chunks of a run of documents: each different one with the documents of the run that hold it and
how often. Runs are stored, one packed row each. Only the different chunks of a run travel: dealt by hash, so that all
runs that hold a chunk send it to one task, once a run even if it is in every document. That task tokenizes it once and
sends its terms back to those runs, where the documents of a term are told apart. What travels is packed too, a row for
each run and hash bucket. Runs hold different documents, so their document counts of a term add up.

Pairs of sources are summed in tiles: a bounded range of terms by two bounded sets of sources. Terms that neither
source of a pair has add the same amount each and are only counted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import cut, give_back

SCALE = 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: Words (white-space chunks) that a run gathers, about, and terms and sources of a tile.
RUN, TERMS, SOURCES = 2_000_000, 4096, 64

TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A run: its groups, the group of each document, its chunks, and per chunk its documents and occurrences; packed numbers.
RUNS = "run long, groups array<struct<lang:string,source:string>>, of_doc binary, chunks binary, stops binary, docs binary, times binary"
TERMS_OF_RUN = "lang string, source string, term string, docs int, n long"


def shrunk(values: np.ndarray | bytes) -> bytes:
    """Bytes of an array (or text), compressed, after their number."""
    data = values if isinstance(values, bytes) else values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def apart(values: np.ndarray) -> bytes:
    """Numbers as 32-bit integers, all lowest bytes first, then the next ones: most of the rest is zero."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def together(data: bytes) -> np.ndarray:
    return np.frombuffer(grown(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)


class Run:
    """A run while it is filled."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.groups: dict[tuple[str, str], int] = {}
        self.of_doc: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        self.of_doc.append(self.groups.setdefault(group, len(self.groups)))
        # bytes are cut at ASCII white space only
        words = text.split()
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def row(self, number: int) -> dict:
        lengths = [len(p) for p in self.parts]
        count = max(len(self.of_doc), 1)
        pairs, times = np.unique(np.concatenate(self.parts) * count + np.repeat(np.arange(len(self.parts)), lengths), return_counts=True)
        chunks = list(self.ids)
        return {
            "run": number, "groups": [{"lang": a, "source": b} for a, b in self.groups], "of_doc": shrunk(np.array(self.of_doc, np.int32)),
            "chunks": shrunk(b" ".join(chunks)),
            "stops": shrunk(np.cumsum(np.bincount(pairs // count, minlength=len(chunks)), dtype=np.int64)),
            "docs": shrunk(apart(np.diff(pairs % count, prepend=0))), "times": shrunk(apart(times)),
        }


def runs_of(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The stored runs of all documents (text, lang, source; no nulls)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("run", pa.int64()), ("groups", pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())])))]
                          + [(c, pa.binary()) for c in ("of_doc", "chunks", "stops", "docs", "times")])
        number, open_one = TaskContext.get().partitionId() << 32, Run()
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, text in zip(groups, batch.column("text"), strict=True):
                open_one.add(group, text.as_buffer().to_pybytes())
                if open_one.size >= run:
                    yield pa.RecordBatch.from_pylist([open_one.row(number)], schema=kinds)
                    number, open_one = number + 1, Run()
        if open_one.of_doc:
            yield pa.RecordBatch.from_pylist([open_one.row(number)], schema=kinds)
        give_back()

    return cut(docs.select("text", "lang", "source").mapInArrow(gather, RUNS))


def dealt_chunks(runs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, run, nos, chunks)``: the different chunks of every run by hash, with their numbers in the run."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("nos", pa.binary()), ("chunks", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                chunks = grown(row["chunks"]).split()
                bucket = np.fromiter(map(zlib.crc32, chunks), np.int64, len(chunks)) % buckets
                order = np.argsort(bucket, kind="stable").astype(np.int32)
                stops = np.cumsum(np.bincount(bucket, minlength=buckets))
                out = []
                for b, (start, stop) in enumerate(zip(np.append(0, stops).tolist(), stops.tolist(), strict=False)):
                    if stop > start:
                        nos = order[start:stop]
                        out.append({"bucket": b, "run": row["run"], "nos": shrunk(apart(np.diff(nos, prepend=0))), "chunks": shrunk(b" ".join([chunks[n] for n in nos.tolist()]))})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        give_back()

    return runs.select("run", "chunks").mapInArrow(deal, "bucket int, run long, nos binary, chunks binary")


def terms_of(chunk: bytes) -> bytes:
    """The terms of a chunk, a space between them, each with its number of occurrences if there are several."""
    return b" ".join(t if n == 1 else b"%s\x00%d" % (t, n) for t, n in Counter(TERM.findall(chunk.lower())).items())


def with_terms(chunks: DataFrame, buckets: int) -> DataFrame:
    """``(run, nos, terms)``: the terms of the dealt chunks. All rows of a chunk meet in one task, which tokenizes it once."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for chunks in batch.column("chunks"):
                found = []
                for chunk in grown(chunks.as_py()).split():
                    terms = known.get(chunk)
                    if terms is None:
                        terms = known[chunk] = terms_of(chunk)
                    found.append(terms)
                out.append(shrunk(b"\n".join(found)))
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("nos"), pa.array(out, pa.binary())], names=["run", "nos", "terms"])
        give_back()

    return chunks.repartition(buckets, "bucket").select("run", "nos", "chunks").mapInArrow(tokenize, "run long, nos binary, terms binary")


def term_entries(terms: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a run, and for every (chunk, term) the number of each and the occurrences of the term in the chunk."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    chunk, term, times = [], [], []
    for row in terms.select(["nos", "terms"]).to_pylist():
        for no, found in zip(np.cumsum(together(row["nos"])).tolist(), grown(row["terms"]).split(b"\n"), strict=True):
            for one in found.split():
                name, _, n = one.partition(b"\x00")
                chunk.append(no)
                term.append(ids[name])
                times.append(int(n or 1))
    return [t.decode() for t in ids], np.array(chunk, np.int64), np.array(term, np.int64), np.array(times, np.int64)


def terms_of_run(run: pa.Table, terms: pa.Table) -> pa.Table:
    """Documents and occurrences of each term in each group of a run."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int32()), ("n", pa.int64())])
    if not len(terms):
        return kind.empty_table()
    row = run.to_pylist()[0]
    of_doc, stops = (np.frombuffer(grown(row[c]), t) for c, t in (("of_doc", np.int32), ("stops", np.int64)))
    docs, times = np.cumsum(together(row["docs"])), together(row["times"])
    names, chunk, term, each = term_entries(terms)
    if not len(term):
        return kind.empty_table()
    # every (chunk, term) with the documents of the chunk
    first = np.concatenate([[0], stops])[chunk]
    size = stops[chunk] - first
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    count = len(of_doc)
    key = np.repeat(term, size) * count + docs[place]
    n = times[place] * np.repeat(each, size)
    pairs, which = np.unique(key, return_inverse=True)
    n = np.bincount(which, n, len(pairs)).astype(np.int64)
    groups = len(row["groups"])
    cells, which = np.unique((pairs // count) * groups + of_doc[pairs % count], return_inverse=True)
    group = pa.array(cells % groups)
    return pa.Table.from_arrays([
        *(pa.array([g[c] for g in row["groups"]], pa.string()).take(group) for c in ("lang", "source")),
        pa.array(names, pa.string()).take(pa.array(cells // groups)), pa.array(np.bincount(which), pa.int32()),
        pa.array(np.bincount(which, n).astype(np.int64), pa.int64()),
    ], schema=kind)


def kept_counts(docs: DataFrame, min_docs: int, run: int = RUN) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)``: occurrences of the kept terms by group and lang; first marks one row a term."""
    runs = runs_of(docs, run)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = with_terms(dealt_chunks(runs, buckets), buckets)
    by_run = runs.drop("chunks").groupBy("run").cogroup(terms.groupBy("run")).applyInArrow(terms_of_run, TERMS_OF_RUN)
    of_term = Window.partitionBy("lang", "term")
    # dealt by (lang, term) once: nothing below moves rows
    counts = by_run.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return (
        counts.withColumn("in_lang", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("first", F.min("source").over(of_term) == F.col("source")).where(F.col("in_lang") >= min_docs).drop("docs", "in_lang")
    )


def chance(count: Column, total: Column, kept: Column) -> Column:
    """p of a term: exact in decimals, as SCALE times a count may exceed a long."""
    upper = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(29,0)")
    return (F.lit(1) + F.call_function("div", upper, (total + kept).cast("decimal(20,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def tile_sums(rows: pd.DataFrame, side_size: int) -> pd.DataFrame:
    """Sums of one tile: for every pair of its two sets of sources, over the terms that any of them has.

    Rows without a term name the sources of the tile, p then being that of a term with count 0.
    """
    lang, low, high = rows["lang"].iloc[0], int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    heads = rows[rows["term"].isna()].sort_values("place")
    cells = rows[rows["term"].notna()]
    places, (column, seen) = heads["place"].to_numpy(), pd.factorize(cells["term"])
    p = np.repeat(heads["p"].to_numpy(np.int64)[:, None], len(seen), axis=1)
    p[np.searchsorted(places, cells["place"].to_numpy()), column] = cells["p"].to_numpy(np.int64)
    here, there = np.flatnonzero(places // side_size == low), np.flatnonzero(places // side_size == high)
    sides = [(here, there)] if low == high else [(here, there), (there, here)]
    out = []
    for side, others in sides:
        for i in side.tolist():
            gap = p[i][None, :] - p[others]
            out.append(pd.DataFrame({"a": places[i], "b": places[others], "value": (gap * gap // p[others]).sum(1)}))
    both = pd.concat(out)
    return both[both["a"] != both["b"]].assign(lang=lang, seen=len(seen))[["lang", "a", "b", "value", "seen"]]


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, run: int = RUN, tile: tuple[int, int] = (TERMS, SOURCES)) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all documents (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = cut(kept_counts(docs, min_docs, run))
    groups = with_totals(docs, kept)
    # one row a group: sent along if there are few, else joined by group, where a large one is split
    named = F.broadcast(groups) if groups.count() <= 100_000 else groups
    cells = cut(
        kept.join(named, ["lang", "source"])
        .select("lang", "source", "term", "place", "sources", "v", chance(F.col("n"), F.col("total"), F.col("v")).alias("p"), chance(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    )
    return pair_part(cells, groups, *tile).unionByName(term_part(cells, top))


def with_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group with its number within the lang, the groups of the lang, its N, the lang's N and V."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("v"))
    of_lang = Window.partitionBy("lang")
    return cut(
        docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "v"])
        .select(
            "lang", "source", "total", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count("*").over(of_lang).alias("sources"),
            F.sum("total").over(of_lang).alias("lang_total"), F.sum("v").over(of_lang).alias("v"),
        )
    )


def pair_part(cells: DataFrame, groups: DataFrame, terms_each: int, sources_each: int) -> DataFrame:
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / terms_each)).cast("long")
    part = F.floor(F.col("place") / sources_each).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / sources_each).cast("int")))
    key = ["lang", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    terms = cells.withColumn("block", F.pmod(F.xxhash64("term"), blocks)).withColumn("part", part).withColumn("other", other)
    zero = F.when(F.col("v") > 0, chance(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)
    heads = (
        groups.where("sources > 1").withColumn("p", zero).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("part", part).withColumn("other", other)
    )
    rows = terms.where("sources > 1").select(*key, "term", "place", "p").unionByName(heads.select(*key, F.lit(None).cast("string").alias("term"), "place", "p"))
    sums = (
        rows.groupBy("lang", "block", "low", "high").applyInPandas(lambda tile: tile_sums(tile, sources_each), "lang string, a int, b int, value long, seen long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    one = groups.select("lang", F.col("place").alias("a"), "source", "v", zero.alias("p"))
    two = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"), zero.alias("q"))
    unseen = F.when(F.col("v") > F.col("seen"), (F.col("v") - F.col("seen")) * divergence(F.col("p"), F.col("q"))).otherwise(0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        sums.join(one, ["lang", "a"]).join(two, ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + unseen).alias("value"))
        .withColumn("rank", F.row_number().over(order))
    )


def term_part(cells: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


AUDIT_SQL = f"""
    with d as materialized (
        select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
        from documents
    ),
    occ as materialized (select lang, source, term, r, count(*) as n from (select lang, source, r, unnest(w) as term from d) group by all),
    kept as materialized (select lang, term, sum(n) as n from occ group by lang, term having count(*) >= {MIN_DOCS}),
    g as materialized (select distinct lang, source from d),
    v as materialized (select lang, count(*) as v, sum(n) as total from kept group by lang),
    cnt as materialized (select o.lang, o.source, o.term, sum(o.n) as n from occ o join kept k on o.lang = k.lang and o.term = k.term group by all),
    tot as materialized (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join cnt using (lang, source) group by all),
    p as materialized (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
               1 + {SCALE} * (cast(coalesce(c.n, 0) as hugeint) + 1) // (cast(t.total as hugeint) + v.v) as p,
               1 + {SCALE} * (cast(k.n as hugeint) + 1) // (cast(v.total as hugeint) + v.v) as q
        from g join kept k on g.lang = k.lang join v on v.lang = g.lang join tot t on t.lang = g.lang and t.source = g.source
        left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term
    ),
    pairs as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
        from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    )
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from (
        select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
            left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
            union all
            select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q
        )
    ) where part = 'pair' or rank <= {TOP}"""
