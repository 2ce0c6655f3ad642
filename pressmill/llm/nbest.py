"""N-best encoding and decoding with a SentencePiece vocabulary.

Contract. Each text is given its N best segmentations into pieces of the model, best first. A
segmentation's score is the sum of its pieces' scores in the model, as whole numbers (times 10**6);
a character that is no piece counts as the lowest score less 10 and is written as its UTF-8 byte
pieces. As in the library, a space is put before the text and spaces belong to the word after them;
no piece holds a space after another character. Equal scores go by words: the ranks of the words'
own segmentations, last word first, then (in words of TIES characters at most) the shorter pieces
from the word's end. Texts with fewer segmentations have fewer rows; a null or empty text has one
without pieces. Decoding gives back every text exactly. Repeated rows are encoded each, null ids are
kept, further columns are ignored, an empty table gives no rows.

Method. Each different word is a lattice of pieces. Forward Viterbi scores are exact heuristics for a
backward A-star search: a hypothesis is a way from some place to the end of the word, its bound the
way's score and the best score up to that place, so the first N complete ones are the N best. A
text's N best take at most N - 1 of its single replacements of a word's best segmentation, the
cheapest, and their sums; so what the second segmentation costs more is known of every word (from the
Viterbi scores of both directions), and only the cheapest words are searched. Words are kept from
one text to the next; beyond CACHE of them those that recur stay, half of CACHE at most.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import give_back, small_batches
from pressmill.llm.toxicity import slices

N = 3
SCALE = 10**6
TIES = 64
CACHE = 200_000
#: Words of so many characters at most are segmented many at once.
MANY = 32
#: Bits of a hash in the table of likely pieces.
LIKELY = 19
#: Bytes of token ids and decoded texts in a batch of results.
BYTES = 1 << 22
#: Bytes of text of which the new words are segmented together.
TEXT = 1 << 22
SPACED = re.compile(r" +[^ ]*")


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def codes(words: list[str]) -> np.ndarray:
    """Characters of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def hashed(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all beginnings of the rows."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    for k in range(rows.shape[1]):
        out[:, k + 1] = out[:, k] * FACTOR + (rows[:, k] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


class Pieces:
    """The model's pieces, with real spaces for the library's mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: dict[str, tuple[int, int]] = {}
        self.bytes: dict[int, int] = {}
        self.data: list[bytes] = []
        lowest = 0
        for k in range(model.get_piece_size()):
            text = model.id_to_piece(k).replace("▁", " ")
            score = round(model.get_score(k) * SCALE)
            if model.is_byte(k):
                self.bytes[int(text[1:-1], 16)] = k
                self.data.append(bytes([int(text[1:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.data.append(b"")
            else:
                lowest = min(lowest, score)
                self.piece[text] = (score, (k,))
                self.data.append(text.encode())
        self.unknown = lowest - 10 * SCALE
        # the pieces once more, by hash of their characters, for many words at once
        texts = list(self.piece)
        self.most = max(map(len, texts), default=1)
        hashes = np.array([int(hashed(codes([x]))[0, -1]) for x in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes = np.concatenate([hashes[order], [np.iinfo(np.uint64).max]])
        self.hash_score = np.array([self.piece[texts[k]][0] for k in order] + [0], np.int64)
        # most substrings are no pieces: their hash's first bits already say so
        self.likely = np.zeros(1 << LIKELY, bool)
        self.likely[(hashes >> np.uint64(64 - LIKELY)).astype(np.int64)] = True
        self.hash_id = np.array([self.piece[texts[k]][1][0] for k in order] + [-1], np.int64)
        self.longest: dict[str, int] = {}
        for text in self.piece:
            self.longest[text[0]] = max(self.longest.get(text[0], 0), len(text))
        # the bytes of all pieces one after the other
        self.flat = np.frombuffer(b"".join(self.data), np.uint8)
        self.length = np.array([len(x) for x in self.data])
        self.start = np.cumsum(self.length) - self.length

    def text(self, ids: np.ndarray) -> str:
        """What the ids decode to."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.flat[at].tobytes()[1:].decode("utf-8", "replace")

    def lattice(self, word: str) -> tuple[list[list[tuple[int, int, tuple[int, ...]]]], list[int]]:
        """Edges ``(start, score, ids)`` by the place where they end, and the forward Viterbi scores."""
        size = len(word)
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        best = [0] * (size + 1)
        get, longest = self.piece.get, self.longest.get
        for start in range(size):
            reach = best[start]
            single = False
            for end in range(start + 1, min(size, start + longest(word[start], 0)) + 1):
                hit = get(word[start:end])
                if hit is not None:
                    single = single or end == start + 1
                    edges = into[end]
                    if not edges or reach + hit[0] > best[end]:
                        best[end] = reach + hit[0]
                    edges.append((start, *hit))
            if not single:
                end = start + 1
                if not into[end] or reach + self.unknown > best[end]:
                    best[end] = reach + self.unknown
                into[end].append((start, self.unknown, self.spell(word[start])))
        return into, best

    def spell(self, character: str) -> tuple[int, ...]:
        """Ids of the byte pieces of a character that is no piece."""
        return tuple(self.bytes[x] for x in character.encode("utf-8", "surrogatepass"))

    def best(self, word: str) -> tuple[int, tuple[int, ...], int | None]:
        """Score and ids of the word's best segmentation, and what the second costs more (None: there is none).

        The second best way is the best one over some edge that is not of the best way.
        """
        into, best = self.lattice(word)
        place, taken, ids = len(word), {}, []
        while place:
            # edges come by rising start, so the last of equals is the shortest piece
            start, _, own = max(
                (x for x in into[place] if best[x[0]] + x[1] == best[place]), key=lambda x: x[0]
            ) if len(into[place]) > 1 else into[place][0]
            taken[place] = start
            ids.append(own)
            place = start
        size = len(word)
        ahead: list[int | None] = [None] * size + [0]
        second = None
        for end in range(size, 0, -1):
            rest = ahead[end]
            if rest is None:
                continue
            for start, score, _ in into[end]:
                total = rest + score
                if ahead[start] is None or total > ahead[start]:
                    ahead[start] = total
                if taken.get(end) != start and (second is None or best[start] + total > second):
                    second = best[start] + total
        return best[size], tuple(x for own in reversed(ids) for x in own), None if second is None else best[size] - second

    def best_of_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``best`` says for words of one length: scores, ids (-1 where no piece ends, -2 - code for a
        character that is no piece), extra costs, and whether a word has such a character in its best way."""
        size, count, none = len(words[0]), len(words), np.iinfo(np.int64).min // 4
        code = codes(words)
        begun = hashed(code)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.most, FACTOR))])
        score: dict[tuple[int, int], np.ndarray] = {}
        piece: dict[tuple[int, int], np.ndarray] = {}
        for start in range(size):
            for end in range(start + 1, min(size, start + self.most) + 1):
                value = begun[:, end] - begun[:, start] * power[end - start]
                able = np.flatnonzero(self.likely[(value >> np.uint64(64 - LIKELY)).astype(np.int64)])
                at = np.full(count, len(self.hashes) - 1)
                at[able] = np.searchsorted(self.hashes, value[able])
                hit = self.hashes[at] == value
                if end == start + 1:
                    score[start, end] = np.where(hit, self.hash_score[at], self.unknown)
                elif hit.any():
                    score[start, end] = np.where(hit, self.hash_score[at], none)
                else:
                    continue
                piece[start, end] = np.where(hit, self.hash_id[at], -2 - code[:, start].astype(np.int64))
        best = np.full((size + 1, count), none)
        before = np.zeros((size + 1, count), np.int64)
        best[0] = 0
        for start, end in sorted(score, key=lambda x: (x[1], x[0])):  # the last of equals is the shortest piece
            total = best[start] + score[start, end]
            better = total >= best[end]
            best[end] = np.where(better, total, best[end])
            before[end] = np.where(better, start, before[end])
        ahead = np.full((size + 1, count), none)
        ahead[size] = 0
        for start, end in sorted(score, reverse=True):
            ahead[start] = np.maximum(ahead[start], score[start, end] + ahead[end])
        on = np.zeros((size + 1, count), bool)
        on[size] = True
        ids, spelled = np.full((count, size), -1), np.zeros(count, bool)
        second = np.full(count, none)
        for end in range(size, 0, -1):
            for start in range(max(0, end - self.most), end):
                if (start, end) not in score:
                    continue
                taken = on[end] & (before[end] == start)
                through = best[start] + score[start, end] + ahead[end]
                second = np.maximum(second, np.where(taken | (through < none // 2), none, through))
                on[start] |= taken
                ids[taken, end - 1] = piece[start, end][taken]
                spelled |= taken & (piece[start, end] < 0)
        extra = np.where(second == none, np.iinfo(np.int64).max, best[size] - second)
        return best[size], ids, extra, spelled

    def n_best(self, word: str, n: int = N) -> list[tuple[int, tuple[int, ...]]]:
        """``(score, ids)`` of the word's n best segmentations, by A-star search from its end."""
        size = len(word)
        into, best = self.lattice(word)
        out: list[tuple[int, tuple[int, ...]]] = []
        count = 0
        # (bound, tie, number, place, score to the end, ids from place on as a linked list)
        heap: list[tuple] = [(-best[size], (), 0, size, 0, None)]
        while heap and len(out) < n:
            bound, tie, _, place, score, chain = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while chain is not None:
                    ids += chain[0]
                    chain = chain[1]
                out.append((score, tuple(ids)))
                continue
            for start, piece_score, piece_ids in into[place]:
                count += 1
                total = score + piece_score
                way = (*tie, place - start) if size <= TIES else tie
                heapq.heappush(heap, (-(total + best[start]), way, count, start, total, (piece_ids, chain)))
        return out


def words_of(text: str) -> list[str]:
    """The text with a space before it, cut before each run of spaces."""
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return [" " + x for x in text.split(" ")]
    return SPACED.findall(" " + text)


class Encoder:
    """Words met so far: their best ids one after the other, and what the other segmentations cost more."""

    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.words: list[str] = []
        self.searched: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.score = np.zeros(1024, np.int64)
        self.extra = np.zeros(1024, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.used = np.zeros(1024, np.int64)
        self.flat = np.zeros(8192, "<u4")
        self.filled = 0

    def forget(self) -> None:
        """Drops the words that recur least, until half of CACHE are left at most."""
        size, least = len(self.words), 2
        while (self.used[:size] >= least).sum() > CACHE // 2:
            least *= 2
        stay = self.used[:size] >= least
        words, keep = list(compress(self.words, stay.tolist())), np.flatnonzero(stay)
        score, extra, start, length, used = (x[keep] for x in (self.score, self.extra, self.start, self.length, self.used))
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))]
        searched = {k: self.searched[old] for k, old in enumerate(keep.tolist()) if old in self.searched}
        self.reset()
        for word in words:
            self.number[word]
        self.words, self.searched = words, searched
        self.room(len(words))
        self.add(np.arange(len(words)), score, extra, ids, length)
        self.used[: len(words)] = used // 2

    def room(self, size: int) -> None:
        if size > len(self.score):
            self.score, self.extra, self.start, self.length, self.used = (
                np.concatenate([x, np.zeros(size + size // 4 - len(x), np.int64)]) for x in (self.score, self.extra, self.start, self.length, self.used)
            )

    def add(self, at: np.ndarray, score: np.ndarray, extra: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Takes over the words of numbers ``at`` with their best scores, extra costs and ids (all words' ids one after the other)."""
        if self.filled + len(ids) > len(self.flat):
            size = self.filled + len(ids)
            self.flat = np.concatenate([self.flat, np.zeros(size + size // 4 - len(self.flat), "<u4")])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.score[at], self.extra[at], self.length[at] = score, extra, length
        self.start[at] = self.filled + np.cumsum(length) - length
        self.filled += len(ids)

    def alone(self, k: int) -> None:
        """Finds the best segmentation of one word."""
        word = self.words[k]
        if len(word) <= TIES:
            score, ids, extra = self.pieces.best(word)
        else:
            found = self.pieces.n_best(word, 2)
            (score, ids), extra = found[0], found[0][0] - found[1][0] if len(found) > 1 else None
        extra = np.iinfo(np.int64).max if extra is None else extra
        self.add(np.array([k]), np.array([score]), np.array([extra]), np.array(ids), np.array([len(ids)]))

    def learn(self, texts: list[str | None]) -> list[np.ndarray]:
        """The texts as numbers of words; finds the best segmentations of all new words at once."""
        if len(self.words) > CACHE:
            self.forget()
        known, number = len(self.words), self.number.__getitem__
        out = [np.array(list(map(number, words_of(x))) if x else [], np.int64) for x in texts]
        self.words += islice(self.number, known, None)
        self.room(len(self.words))
        for numbers in out:
            self.used[numbers] += 1
        new: dict[int, list[int]] = {}
        for k in range(known, len(self.words)):
            new.setdefault(len(self.words[k]), []).append(k)
        for size, of in sorted(new.items()):
            if size > MANY:
                for k in of:
                    self.alone(k)
                continue
            for low in range(0, len(of), 4096):
                part = np.array(of[low : low + 4096])
                score, ids, extra, spelled = self.pieces.best_of_many([self.words[k] for k in of[low : low + 4096]])
                odd = np.flatnonzero(spelled)
                if len(odd):
                    own = [
                        [y for x in row if x != -1 for y in ((x,) if x >= 0 else self.pieces.spell(chr(-2 - x)))] for row in ids[odd].tolist()
                    ]
                    self.add(part[odd], score[odd], extra[odd], np.array([y for row in own for y in row]), np.array([len(row) for row in own]))
                whole = ~spelled
                ids = ids[whole]
                self.add(part[whole], score[whole], extra[whole], ids[ids >= 0], (ids >= 0).sum(axis=1))
        return out

    def others(self, k: int) -> list[tuple[int, tuple[int, ...]]]:
        """``(cost, ids)`` of the word's further segmentations; only words that a text may replace are asked for."""
        if k not in self.searched:
            (score, _), *rest = self.pieces.n_best(self.words[k], self.n)
            self.searched[k] = [(score - s, ids) for s, ids in rest]
        return self.searched[k]

    def n_best(self, text: str) -> list[tuple[int, np.ndarray]]:
        """``(score, ids)`` of the text's n best segmentations."""
        return self.n_best_of(self.learn([text])[0])

    def n_best_of(self, number: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """``(score, ids)`` of the n best segmentations of a text whose words have these numbers."""
        if not len(number):
            return [(0, np.zeros(0, "<u4"))]
        length = self.length[number]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[number] - (ends - length), length) + np.arange(int(ends[-1]))]
        score = int(self.score[number].sum())
        out = [(score, ids)]
        if self.n == 1:
            return out
        # the cheapest single replacements: (cost, word's place, rank among the word's segmentations)
        extra = self.extra[number]
        most = self.n - 1
        edge = np.partition(extra, most - 1)[most - 1] if len(extra) > most else np.iinfo(np.int64).max - 1
        places = np.concatenate([np.flatnonzero(extra < edge), np.flatnonzero((extra == edge) & (edge < np.iinfo(np.int64).max))[:most]])
        single = sorted(
            (cost, int(p), rank) for p in places for rank, (cost, _) in enumerate(self.others(int(number[p])), 1)
        )[:most]
        several = []
        for count in range(1, len(single) + 1):
            for chosen in combinations(single, count):
                if len({x[1] for x in chosen}) == count:
                    # ranks by word, last word first, as a sparse list: a later word weighs more
                    order = sorted(((x[1], x[2]) for x in chosen), reverse=True)
                    several.append((sum(x[0] for x in chosen), order))
        for cost, order in sorted(several)[: self.n - 1]:
            parts, at = [], 0
            for place, rank in reversed(order):
                begin = int(ends[place] - length[place])
                parts += [ids[at:begin], np.array(self.others(int(number[place]))[rank - 1][1], "<u4")]
                at = int(ends[place])
            out.append((score - cost, np.concatenate([*parts, ids[at:]])))
        return out


def encoded(docs: DataFrame, model: str, n: int = N, texts: bool = False) -> DataFrame:
    """``(doc_id, rank, score, ids)``: the n best of each row's text; ids are little-endian 32-bit words.

    texts: further column ``decoded``, what the row's ids decode to, found where the ids are.
    """
    small_batches(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "rank": pa.int32(), "score": pa.int64(), "ids": pa.binary()} | ({"decoded": pa.string()} if texts else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, n)

        def emit(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds.values(), strict=True)], names=list(kinds))

        for batch in (piece for whole in batches for piece in slices(whole, 1, TEXT)):
            out, size = [[] for _ in kinds], 0
            for doc_id, numbers in zip(batch.column(0).to_pylist(), encoder.learn(batch.column(1).to_pylist()), strict=True):
                for rank, (score, ids) in enumerate(encoder.n_best_of(numbers), 1):
                    row = (doc_id, rank, score, ids.tobytes(), *((encoder.pieces.text(ids),) if texts else ()))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += ids.nbytes + (len(row[-1]) if texts else 0)
                if size > BYTES:
                    yield emit(out)
                    out, size = [[] for _ in kinds], 0
            if out[0]:
                yield emit(out)
        del encoder
        give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, rank int, score long, ids binary" + ", decoded string" * texts)


def decoded(rows: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """The rows with the texts of their ids in ``decoded``, ids dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(column), TEXT)):
            texts = [pieces.text(np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, int)) for x in batch.column(column)]
            keep = [x for x in batch.schema.names if x != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    from pyspark.sql import types as T

    schema = T.StructType([x for x in rows.schema if x.name != column]).add("decoded", "string")
    return rows.mapInArrow(run, schema)


def n_best_digest(docs: DataFrame, model: str, n: int = N) -> DataFrame:
    """``(doc_id, rank, score, n_pieces, ids_crc32, text_md5)``; text_md5 is that of the decoded ids."""
    rows = encoded(docs, model, n, texts=True)
    return rows.select(
        "doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.md5("decoded").alias("text_md5"),
    )
