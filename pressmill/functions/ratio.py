"""Matching-blocks ratio of many string pairs at once.

The ratio is 2M / (len(a) + len(b)), where M adds up the longest common block, then the
longest blocks to its left and to its right, and so on.  All pairs of a batch advance
together: one step finds the longest block of every open stretch with array operations.
First strings of up to 64 characters are bits of one word: word j of a pair has the places
where the first string holds the second string's character j.  The blocks are a common
subsequence, so the length of the longest one, a few operations on a word, bounds M.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

# From this length of the second string on, the sequence matcher ignores popular characters.
POPULAR_FROM = 200
_CHUNK = 2048
_PAIRS = 1 << 14
_BINS = 64
#: Characters of a first string that fit a word, pairs of words handled at a time, samples bounded at a time, and words of a table.
_WORD, _COLUMNS, _GROUP, _TABLE = 64, 2048, 256, 1 << 22
_ONE, _FULL = np.uint64(1), ~np.uint64(0)


def _codes(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(int(sizes.max(initial=0)), 1)), pad, dtype=np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out, sizes


def _bags(codes: np.ndarray) -> np.ndarray:
    """Character counts in hashed bins; shared counts never fall below the true ones."""
    rows, cols = np.nonzero(codes >= 0)
    return np.bincount(rows * _BINS + codes[rows, cols] % _BINS, minlength=len(codes) * _BINS).reshape(len(codes), _BINS).astype(np.int32)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and end positions of the first longest common block of each column pair."""
    width, n = b.shape
    run, grown = np.zeros((width + 1, n), dtype=np.int16), np.zeros((width + 1, n), dtype=np.int16)
    same = np.empty((width, n), dtype=bool)
    best, end_a, end_b = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for i in range(len(a)):
        np.equal(b, a[i], out=same)
        np.add(run[:-1], 1, out=grown[1:])
        np.multiply(grown[1:], same, out=grown[1:])
        run, grown = grown, run
        length = run.max(axis=0)
        better = np.nonzero(length > best)[0]
        if len(better):
            best[better], end_a[better] = length[better], i + 1
            end_b[better] = run[:, better].argmax(axis=0)
    return best, end_a, end_b


def _low_bits(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set, 0 <= n <= 64."""
    return np.where(n > 0, _FULL >> (_WORD - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))


def _packed(wide: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Word of each row of 64 codes: the places that hold the row's code."""
    return np.packbits(wide == codes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _wide(codes: np.ndarray) -> np.ndarray:
    out = np.full((len(codes), _WORD), -1, dtype=np.int32)
    out[:, : min(codes.shape[1], _WORD)] = codes[:, :_WORD]
    return out


def _words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word j, p: the places where the first string of pair p holds character j of the second."""
    wide = _wide(a)
    return np.stack([_packed(wide, b[:, j]) for j in range(b.shape[1])])


def _common(words: np.ndarray, a_size: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    open_places = np.full(words.shape[1], _FULL)
    for word in words:
        used = open_places & word
        open_places = (open_places + used) | (open_places - used)
    return np.bitwise_count(~open_places & _low_bits(a_size)).astype(np.int64)


def _longest_bits(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and end positions of the first longest common block of each column of words."""
    n = cut.shape[1]
    best, end_a, end_b = (np.zeros(n, dtype=np.int64) for _ in range(3))
    column, run, length = np.arange(n), cut, 0
    ends = np.bitwise_or.reduce(run, axis=0)
    while True:
        live = ends != 0
        if not live.all():
            column, run, ends, cut = column[live], run[:, live], ends[live], cut[:, live]
        if not len(column):
            return best, end_a, end_b
        length += 1
        # blocks one character longer, by their ends
        longer = (run[:-1] << _ONE) & cut[length:]
        after = np.bitwise_or.reduce(longer, axis=0) if len(longer) else np.zeros(len(column), np.uint64)
        done = np.nonzero(after == 0)[0]
        if len(done):
            first = ends[done] & (~ends[done] + _ONE)
            best[column[done]] = length
            end_a[column[done]] = np.bitwise_count(first - _ONE).astype(np.int64) + 1
            end_b[column[done]] = ((run[:, done] & first) != 0).argmax(axis=0) + length
        run, ends = longer, after


def _matched_words(words: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """M of each pair from its words."""
    n = words.shape[1]
    total, zero = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    work = np.stack([np.arange(n), zero, a_size, zero, b_size], axis=1)
    while len(work):
        work = work[(work[:, 2] > work[:, 1]) & (work[:, 4] > work[:, 3])]
        work = work[np.argsort(work[:, 4] - work[:, 3], kind="stable")]
        opened = []
        for start in range(0, len(work), _COLUMNS):
            row, a_lo, a_hi, b_lo, b_hi = work[start : start + _COLUMNS].T
            at = b_lo + np.arange(int((b_hi - b_lo).max()))[:, None]
            inside = _low_bits(a_hi) & ~_low_bits(a_lo)
            cut = np.where(at < b_hi, words[np.minimum(at, len(words) - 1), row] & inside, np.uint64(0))
            best, end_a, end_b = _longest_bits(cut)
            np.add.at(total, row, best)
            hit = best > 0
            row, a_lo, a_hi, b_lo, b_hi, best = (v[hit] for v in (row, a_lo, a_hi, b_lo, b_hi, best))
            stop_a, stop_b = end_a[hit], b_lo + end_b[hit]
            opened.append(np.stack([row, a_lo, stop_a - best, b_lo, stop_b - best], axis=1))
            opened.append(np.stack([row, stop_a, a_hi, stop_b, b_hi], axis=1))
        work = np.concatenate(opened) if opened else work[:0]
    return total


def matched(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """M of each row pair of two padded code arrays (pads must differ); 0 allowed where it cannot reach ``least``."""
    total = np.zeros(len(a), dtype=np.int64)
    fits = a_size <= _WORD
    rows = np.nonzero(fits)[0]
    rows = rows[np.argsort(b_size[rows], kind="stable")]
    for start in range(0, len(rows), _COLUMNS):
        some = rows[start : start + _COLUMNS]
        words = _words(a[some], b[some, : max(int(b_size[some].max()), 1)])
        if least is not None:
            reach = np.nonzero(_common(words, a_size[some]) >= least[some])[0]
            some, words = some[reach], words[:, reach]
        total[some] = _matched_words(words, a_size[some], b_size[some])
    rows = np.nonzero(~fits)[0]
    if len(rows):
        total[rows] = _matched_long(a[rows], a_size[rows], b[rows], b_size[rows])
    return total


def _matched_long(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """M of each pair with first strings of any length."""
    total = np.zeros(len(a), dtype=np.int64)
    zero = np.zeros(len(a), dtype=np.int64)
    work = np.stack([np.arange(len(a)), zero, a_size, zero, b_size], axis=1)
    while len(work):
        work = work[(work[:, 2] > work[:, 1]) & (work[:, 4] > work[:, 3])]
        # similar widths together, so that little of a chunk is padding
        work = work[np.lexsort((work[:, 4] - work[:, 3], work[:, 2] - work[:, 1]))]
        opened = []
        for start in range(0, len(work), _CHUNK):
            row, a_lo, a_hi, b_lo, b_hi = work[start : start + _CHUNK].T
            best, end_a, end_b = _longest(_cut(a, row, a_lo, a_hi, -1), _cut(b, row, b_lo, b_hi, -2))
            np.add.at(total, row, best)
            hit = best > 0
            row, a_lo, a_hi, b_lo, b_hi, best = (v[hit] for v in (row, a_lo, a_hi, b_lo, b_hi, best))
            stop_a, stop_b = a_lo + end_a[hit], b_lo + end_b[hit]
            opened.append(np.stack([row, a_lo, stop_a - best, b_lo, stop_b - best], axis=1))
            opened.append(np.stack([row, stop_a, a_hi, stop_b, b_hi], axis=1))
        work = np.concatenate(opened) if opened else work[:0]
    return total


def _cut(codes: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, pad: int) -> np.ndarray:
    at = low + np.arange(int((high - low).max()))[:, None]
    inside = at < high
    return np.where(inside, codes[row, np.where(inside, at, 0)], pad).astype(np.int32)


def best_ratios(titles: Sequence[str], samples: Sequence[str]) -> np.ndarray:
    """Highest ratio of each title (first argument) to any sample (second argument)."""
    best = np.zeros(len(titles))
    if not len(titles):
        return best
    a, a_size = _codes(titles, -1)
    for sample in samples:
        if len(sample) >= POPULAR_FROM:
            _exact_long(titles, a_size, sample, best)
    short = [s for s in samples if len(s) < POPULAR_FROM]
    fits = np.nonzero(a_size <= _WORD)[0]
    for start in range(0, len(short), _GROUP):
        some = short[start : start + _GROUP]
        characters = np.unique(_codes(some, -2)[0])
        step = max(1, min(_COLUMNS, _TABLE // (len(characters) + 1)))
        for first in range(0, len(fits), step):
            rows = fits[first : first + step]
            best[rows] = _best_of_group(a[rows], a_size[rows], some, characters, best[rows])
    rows = np.nonzero(a_size > _WORD)[0]
    if len(rows):
        best[rows] = _best_long(a[rows], a_size[rows], short, best[rows])
    return best


def _best_of_group(a: np.ndarray, a_size: np.ndarray, samples: Sequence[str], characters: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Highest ratio of each title that fits a word, not below what is known of it.

    Samples are tried by the bound of their longest common subsequence, until none can be better.
    """
    b, b_size = _codes(samples, -2)
    wide = _wide(a)
    table = np.stack([_packed(wide, np.full(len(a), c, dtype=np.int32)) for c in characters])
    place = np.searchsorted(characters, b)
    both = np.maximum(a_size + b_size[:, None], 1)
    bound = np.stack([_common(table[place[s, :size]], a_size) for s, size in enumerate(b_size)]) * 2.0 / both
    order = np.argsort(-bound, axis=0, kind="stable")
    best = best.copy()
    start, width = 0, 1
    while start < len(samples):
        which = order[start : start + width]
        _, rows = tried = np.nonzero(np.take_along_axis(bound, which, axis=0) > best)
        if not len(rows):
            break  # bounds fall, so no later sample can be better
        which = which[tried]
        for at in range(0, len(rows), _COLUMNS):
            row, sample = rows[at : at + _COLUMNS], which[at : at + _COLUMNS]
            size = b_size[sample]
            words = table[place[sample, : max(int(size.max()), 1)].T, row]
            m = _matched_words(words, a_size[row], size)
            np.maximum.at(best, row, 2.0 * m / both[sample, row])
        start, width = start + width, min(2 * width, 16)
    return best


def _best_long(a: np.ndarray, a_size: np.ndarray, samples: Sequence[str], best: np.ndarray) -> np.ndarray:
    a_bags, best = _bags(a), best.copy()
    group = max(1, _PAIRS // len(a))
    for start in range(0, len(samples), group):
        b, b_size = _codes(samples[start : start + group], -2)
        both = np.maximum(a_size + b_size[:, None], 1)
        bound = np.stack([np.minimum(a_bags, bag).sum(axis=1) for bag in _bags(b)]) * 2.0 / both
        which, rows = np.nonzero(bound > best)
        if len(rows):
            m = _matched_long(a[rows], a_size[rows], b[which], b_size[which])
            np.maximum.at(best, rows, 2.0 * m / both[which, rows])
    return best


def _exact_long(titles: Sequence[str], a_size: np.ndarray, sample: str, best: np.ndarray) -> None:
    matcher = SequenceMatcher(None, "", sample)
    for i, title in enumerate(titles):
        if 2.0 * min(a_size[i], len(sample)) / (a_size[i] + len(sample)) > best[i]:
            matcher.set_seq1(title)
            if matcher.quick_ratio() > best[i]:
                best[i] = max(best[i], matcher.ratio())


def pair_ratios(first: Sequence[str], second: Sequence[str], at_least: float = 0.0) -> np.ndarray:
    """Ratio of each pair; pairs that cannot reach ``at_least`` get 0."""
    out = np.zeros(len(first))
    if not len(first):
        return out
    a, a_size = _codes(first, -1)
    b, b_size = _codes(second, -2)
    both = np.maximum(a_size + b_size, 1)
    bound = 2.0 * np.minimum(_bags(a), _bags(b)).sum(axis=1) / both
    rows = np.nonzero((bound >= at_least) & (b_size < POPULAR_FROM))[0]
    if len(rows):
        least = at_least * both[rows] / 2 - 1e-3
        out[rows] = 2.0 * matched(a[rows], a_size[rows], b[rows], b_size[rows], least) / both[rows]
    for i in np.nonzero((bound >= at_least) & (b_size >= POPULAR_FROM))[0]:
        out[i] = SequenceMatcher(None, first[i], second[i]).ratio()
    return out
