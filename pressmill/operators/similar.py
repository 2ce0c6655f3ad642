"""Title similarity and near-duplicate groups with the matching-blocks ratio."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.ratio import best_ratios, pair_ratios
from pressmill.functions.text import clean, col
from pressmill.operators.keyed import first_per_key, join_on, positions
from pressmill.operators.lineage import cut_lineage

THRESHOLD = 0.86
LOWEST = 0.85
SAMPLE_BOUND = 5_000
TITLES_PER_TASK = 20_000


# ---------------------------------------------------------------------------
# best similarity against accepted samples


def _tasks(df: DataFrame) -> int:
    """Partitions for steps that are heavy in time but light in bytes.

    An explicit number keeps adaptive execution from merging them into one task.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best_similarity(
    df: DataFrame, samples: DataFrame, title: str, sample_title: str, out: str = "title_similarity",
    *, sample_bound: int = SAMPLE_BOUND, titles_per_task: int = TITLES_PER_TASK,
) -> DataFrame:
    """Highest ratio of each title to any sample title; 0 for blank titles or no samples.

    Equal titles are compared once.  Up to ``sample_bound`` distinct samples travel with
    the function; more of them are cut into slices of that size, and every slice meets
    every slice of titles in a task of bounded size.
    """
    spark = df.sparkSession
    rows = df.withColumn("_title", clean(title))
    distinct_titles = rows.where(F.col("_title") != "").select("_title").distinct()
    known = samples.select(clean(sample_title).alias("_sample")).where(F.col("_sample") != "").distinct()
    head = [r[0] for r in known.limit(sample_bound + 1).collect()]
    if len(head) <= sample_bound:
        shared = spark.sparkContext.broadcast(sorted(head, key=len))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for titles in _gathered(pdf["_title"] for pdf in batches):
                yield pd.DataFrame({"_title": titles, "_best": best_ratios(titles, shared.value)})

        spread = distinct_titles.repartition(_tasks(df), F.xxhash64("_title"))
        scored = spread.mapInPandas(best, "_title string, _best double")
    else:
        scored = _sliced_similarity(distinct_titles, known, sample_bound, titles_per_task)
    joined = rows.join(scored, "_title", "left")
    return joined.withColumn(out, F.coalesce("_best", F.lit(0.0))).drop("_best", "_title")


def _gathered(batches: Iterable[pd.Series], rows: int = 2048, cells: int = 1 << 20) -> Iterator[list[str]]:
    """The titles of several small batches at a time: so many rows, and so many characters if all were as long as the longest."""
    held: list[str] = []
    longest = 0
    for batch in batches:
        more = list(batch)
        top = max([longest, *map(len, more)])
        if held and (len(held) + len(more) > rows or (len(held) + len(more)) * top > cells):
            yield held
            held, top = [], max(map(len, more), default=0)
        held, longest = held + more, top
    if held:
        yield held


def _sliced_similarity(titles: DataFrame, samples: DataFrame, per_sample: int, per_title: int) -> DataFrame:
    sample_slices = max(1, math.ceil(samples.count() / per_sample))
    title_slices = max(1, math.ceil(titles.count() / per_title))
    numbered = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = titles.withColumn("_t", F.pmod(F.xxhash64("_title"), F.lit(title_slices))).withColumn(
        "_s", F.explode(numbered(sample_slices))
    )
    right = samples.withColumn("_s", F.pmod(F.xxhash64("_sample"), F.lit(sample_slices))).withColumn(
        "_t", F.explode(numbered(title_slices))
    )

    def compare(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        found = list(t["_title"])
        return pd.DataFrame({"_title": found, "_best": best_ratios(found, sorted(s["_sample"], key=len))})

    pairs = left.groupBy("_t", "_s").cogroup(right.groupBy("_t", "_s"))
    return pairs.applyInPandas(compare, "_title string, _best double").groupBy("_title").agg(F.max("_best").alias("_best"))


# ---------------------------------------------------------------------------
# near-duplicate groups


#: Titles of one tile; how many of it are resolved at a time, and how many leaders are looked up at a time.
_TILE, _STEP, _LOOKUP = 8192, 512, 1024
#: Numbered characters with a column of their own, columns that the others share, bins of a title's numbered pairs of characters,
#: characters numbered at a time.
_OWN, _SHARED, _BINS, _FLAT = 126, 64, 1024, 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _numbered(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and grams (below 2**42) in order, and which copy of its gram in its row each one is."""
    keys = np.sort((row.astype(np.uint64) << np.uint64(42)) | gram)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    copy = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return (keys >> np.uint64(42)).astype(np.int64), keys & np.uint64((1 << 42) - 1), copy.astype(np.uint64)


class Titles:
    """Titles with what the filters read: lengths, numbered characters, and which bins their numbered pairs of characters fall into.

    The n-th copy of a character or of a pair is a token of its own, so two titles share as many tokens as their bags do.
    """

    def __init__(self, titles: Sequence[str]):
        self.texts = np.array(titles, dtype=object)
        self.sizes = np.array([len(t) for t in titles], dtype=np.float32)
        self.bits = np.zeros((len(titles), _BINS // 64), dtype=np.uint64)
        self.lost = np.zeros(len(titles), dtype=np.float32)  # pairs whose bin another one of the title holds
        rows, tokens = [], []
        # a slice of rows has a bounded number of characters, or is one title
        part = np.cumsum(self.sizes, dtype=np.int64) // _FLAT
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(titles) else np.zeros(1, np.int64)
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = titles[start:stop]
            codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(stop - start), [len(t) for t in some])
            at, gram, copy = _numbered(row, codes)
            rows.append(at + start)
            tokens.append((gram << np.uint64(32)) | copy)
            inside = row[1:] == row[:-1]
            at, gram, copy = _numbered(row[1:][inside], ((codes[:-1] << np.uint64(21)) | codes[1:])[inside])
            hashed = ((gram + np.uint64(1)) * _MULTIPLIER ^ copy) * _MULTIPLIER
            held = np.zeros((stop - start, _BINS), dtype=bool)
            held[at, (hashed >> np.uint64(40)).astype(np.int64) % _BINS] = True
            self.bits[start:stop] = np.packbits(held, axis=1, bitorder="little").view("<u8")
            self.lost[start:stop] = np.bincount(at, minlength=stop - start) - held.sum(axis=1)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self._made: tuple | None = None

    def _counted(self, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the given numbered characters and of bins of the others, and what lost ones and the length add to those needed."""
        held = np.zeros((len(self.texts), _OWN + _SHARED + 2), dtype=np.float32)
        place = np.minimum(np.searchsorted(own, self.tokens), max(len(own) - 1, 0))
        other = own[place] != self.tokens if len(own) else np.ones(len(self.tokens), dtype=bool)
        place[other] = _OWN + ((self.tokens[other] * _MULTIPLIER) >> np.uint64(40)).astype(np.int64) % _SHARED
        held[self.rows, place] = 1
        lost = np.bincount(self.rows, minlength=len(self.texts)) - held.sum(axis=1)
        return held, (lost - threshold * self.sizes) / 2

    def _against(self, others: Titles, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Matrices whose product is the shared numbered characters (at most) less those needed."""
        key = None if others is self else others
        if self._made is None or self._made[0] is not key or self._made[1] != threshold:
            found, counts = np.unique(np.concatenate([self.tokens, others.tokens]), return_counts=True)
            own = np.sort(found[np.argsort(-counts, kind="stable")[:_OWN]])
            left, add = self._counted(own, threshold)
            left[:, -2], left[:, -1] = add, 1
            right, add = others._counted(own, threshold)
            right[:, -2], right[:, -1] = 1, add
            self._made = (key, threshold, left, right)
        return self._made[2:]

    def near(self, rows: np.ndarray, others: Titles, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows and columns that may reach the threshold; no other pair does.

        M matched characters out of la + lb are shared characters, and M >= threshold/2 * (la + lb): the most frequent
        numbered characters have columns of their own in a matrix product, the others share some, and of those lost there a
        pair shares at most half of what both lost. At most la + lb - 2M + 1 blocks are matched, so at least 3M - (la + lb) - 1
        numbered pairs of characters are shared. Shared bins are no fewer than shared tokens less those lost in the title that
        lost fewer.
        """
        if not len(rows) or not len(columns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = self._against(others, threshold)
        right = right[columns].T
        # rounding of 32 bits grows with the length
        slack = 1e-3 + 1e-6 * float(max(self.sizes[rows].max(), others.sizes[columns].max()))
        found = []
        for start in range(0, len(rows), _STEP):
            some = rows[start : start + _STEP]
            i, j = np.divmod(np.flatnonzero(left[some] @ right >= -slack), len(columns))
            for at in range(0, len(i), _LOOKUP * 64):
                x, y = i[at : at + _LOOKUP * 64], j[at : at + _LOOKUP * 64]
                a, b = some[x], columns[y]
                shared = np.bitwise_count(self.bits[a] & others.bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(self.lost[a], others.lost[b])
                kept = shared >= (1.5 * threshold - 1) * (self.sizes[a] + others.sizes[b]) - (1 + slack)
                found.append(np.stack([x[kept] + start, y[kept]]))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return i, j


def first_leaders(titles: Titles, leaders: Titles, threshold: float) -> np.ndarray:
    """For each title the first of the leaders that is similar enough, or -1."""
    found = np.full(len(titles.texts), -1)
    for start in range(0, len(leaders.texts), _LOOKUP):
        some = np.arange(start, min(start + _LOOKUP, len(leaders.texts)))
        _claim(titles, np.nonzero(found < 0)[0], leaders, some, threshold, found)
    return found


def _claim(titles: Titles, rows: np.ndarray, leaders: Titles, some: np.ndarray, threshold: float, found: np.ndarray) -> None:
    i, j = titles.near(rows, leaders, some, threshold)
    i, j = rows[i], some[j]
    # the first of the leaders a title may follow, then the next two and so on: a large family is compared once a title
    width = 1
    while len(i):
        starts = np.nonzero(np.concatenate([[True], i[1:] != i[:-1]]))[0]
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        now = place < width
        row, lead = i[now], j[now]
        hit = pair_ratios(list(titles.texts[row]), list(leaders.texts[lead]), LOWEST) >= threshold
        row, lead = row[hit][::-1], lead[hit][::-1]
        found[row] = lead  # of several the last written: the first leader
        rest = ~now & (found[i] < 0)
        i, j, width = i[rest], j[rest], 2 * width


def resolved(titles: Titles, threshold: float) -> np.ndarray:
    """The leader of each title of a tile in rank order: the first earlier leader that is similar enough, or itself."""
    found = np.full(len(titles.texts), -1)
    for start in range(0, len(titles.texts), _STEP):
        some = np.arange(start, min(start + _STEP, len(titles.texts)))
        some = some[found[some] < 0]
        i, j = titles.near(some, titles, some, threshold)
        i, j = some[i[i > j]], some[j[i > j]]
        close = pair_ratios(list(titles.texts[i]), list(titles.texts[j]), LOWEST) >= threshold
        earlier: dict[int, list[int]] = {}
        for row, lead in zip(i[close].tolist(), j[close].tolist(), strict=True):
            earlier.setdefault(row, []).append(lead)
        for row in some.tolist():
            found[row] = next((lead for lead in earlier.get(row, ()) if found[lead] == lead), row)
        leaders = some[found[some] == some]
        later = np.arange(start + _STEP, len(titles.texts))
        _claim(titles, later[found[later] < 0], titles, leaders, threshold, found)
    return found


def title_leaders(titles: DataFrame, keys: Sequence[str], *, threshold: float = THRESHOLD, tile: int = _TILE) -> DataFrame:
    """Map each distinct title ``(_rank, _title)`` to the rank of its group's leader.

    Equivalent to visiting titles by rank and joining the first leader that is similar enough. The titles of a key are cut
    into tiles by rank. The first tile of every key is resolved in a task of its own, its leaders then claim titles of
    all later tiles, a task for each tile, and so on: a task never holds more than two tiles, no pair leaves its task, and a
    large family is compared with its leaders only. Every open title meets every leader, in a matrix product that
    rules out nearly all pairs.
    """
    if not LOWEST <= threshold <= 1.0:
        raise ValueError("the ratio is exact for thresholds from 0.85 to 1")
    names, tasks = list(keys), _tasks(titles)
    placed = positions(titles.select(*names, "_rank", "_title"), names, [], "_rank", "_place")
    rows = placed.withColumn("_tile", F.floor((F.col("_place") - 1) / tile).cast("int")).select(*names, "_rank", "_title", "_tile")
    open_titles = cut_lineage(rows)
    last = open_titles.agg(F.max("_tile")).first()[0]
    kinds = ", ".join(f"`{c}` {titles.schema[c].dataType.simpleString()}" for c in (*names, "_rank"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank", ignore_index=True)
        lead = resolved(Titles(list(pdf["_title"])), threshold)
        return pdf.assign(_lead=pdf["_rank"].to_numpy()[lead])[[*names, "_rank", "_lead", "_title"]]

    def claim(pdf: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("_rank", ignore_index=True)
        found = np.full(len(pdf), -1)
        if len(pdf) and len(leaders):
            found = first_leaders(Titles(list(pdf["_title"])), Titles(list(leaders["_title"])), threshold)
        ranks = np.append(leaders["_rank"].to_numpy(), 0).astype(np.int64)
        lead = pd.Series(ranks[found], index=pdf.index).astype("Int64").mask(found < 0)
        return pdf.assign(_lead=lead)[[*names, "_rank", "_title", "_tile", "_lead"]]

    done = None
    for no in range((-1 if last is None else last) + 1):
        # a number of partitions is given, as the rows are few for the work on them
        first = open_titles.where(F.col("_tile") == no).repartition(tasks, *names).groupBy(*names)
        found = cut_lineage(first.applyInPandas(resolve, f"{kinds}, _lead long, _title string"))
        out = found.select(*names, "_rank", "_lead")
        if no < last:
            leaders = found.where(F.col("_rank") == F.col("_lead")).select(*names, "_rank", "_title")
            leaders = leaders.withColumn("_tile", F.explode(F.sequence(F.lit(no + 1), F.lit(last))))
            by = [*names, "_tile"]
            right = leaders.repartition(tasks, *by).groupBy(*by)
            left = open_titles.where(F.col("_tile") > no).repartition(tasks, *by).groupBy(*by)
            rest = cut_lineage(left.cogroup(right).applyInPandas(claim, f"{kinds}, _title string, _tile int, _lead long"))
            out = out.unionByName(rest.where("_lead is not null").select(*names, "_rank", "_lead"))
            open_titles = rest.where("_lead is null").drop("_lead")
        done = out if done is None else done.unionByName(out)
    if done is None:
        return titles.select(*names, "_rank", F.col("_rank").alias("_lead"))
    return done


def near_duplicates(
    df: DataFrame, keys: Sequence[str] = ("run_date",), *, title: str = "title_original", url: str = "url",
    score: str = "score", seq: str = "seq", source_type: str = "source_type", text: str = "raw_text",
    keyword_text: str = "matched_keywords", threshold: float = THRESHOLD, first_block: int = _TILE,
    pair_budget: float = float(_TILE) ** 2,
) -> DataFrame:
    """Best row of each group of similar titles, with ``duplicate_group`` and ``group_size``.

    Rows are visited by score (``seq`` breaks ties) within each key.  A repeated URL is
    dropped, whatever its title.  Equal titles always share a group, so only distinct
    titles are compared, in tiles of ``first_block`` titles and up to ``pair_budget`` pairs.
    """
    keys = list(keys)
    # Grouping works on narrow rows; the full rows are written once and joined once.
    df = cut_lineage(df)
    size_of = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    official = F.when(F.col(source_type) == "official", 10.0).otherwise(0.0)
    narrow = df.select(
        *keys, F.col(seq).alias("_seq"), F.col(score).alias("_score"), clean(title).alias("_title"),
        F.nullif(col(url), F.lit("")).alias("_url"),
        F.struct(
            -(F.col(score) + official), -size_of(text), -size_of(keyword_text)
        ).alias("_preference"),
    )
    rows = first_per_key(narrow, [*keys, "_url"], [-F.col("_score"), F.col("_seq")], keyless_id="_seq")
    ranked = cut_lineage(positions(rows, keys, [("_score", True)], "_seq", "_rank").drop("_url", "_score"))
    titles = ranked.where(F.col("_title") != "").groupBy(*keys, "_title").agg(F.min("_rank").alias("_rank"))
    leads = title_leaders(titles, keys, threshold=threshold, tile=max(1, min(first_block, math.isqrt(int(pair_budget)))))
    by_title = titles.join(leads, [*keys, "_rank"]).select(*keys, "_title", "_lead")
    grouped = ranked.join(by_title, [*keys, "_title"], "left").withColumn("_lead", F.coalesce("_lead", "_rank"))
    best = grouped.groupBy(*keys, "_lead").agg(
        F.min_by("_seq", F.struct("_preference", "_rank")).alias("_seq"), F.count(F.lit(1)).alias("group_size")
    )
    numbered = positions(best, keys, [], "_lead", "group_no").drop("_lead")
    label = F.when(F.col("group_size") > 1, F.format_string("D%03d", F.col("group_no"))).otherwise("")
    kept = join_on(
        df.drop("duplicate_group"), numbered.withColumnRenamed("_seq", seq), [*keys, seq], "inner"
    )
    columns = [c for c in df.columns if c != "duplicate_group"]
    return kept.select(*columns, label.alias("duplicate_group"), "group_size", "group_no")
