"""Suffix arrays of one shard in numpy: truncated Larsson-Sadakane refinement and Kasai prefixes.

A shard is a set of short byte strings ("contexts"). Only the suffixes that begin in the first
``starts[i]`` bytes of context i matter, and only their first ``depth`` bytes: the question is which
of them are equal that far. No suffix reads past the end of its context.
"""

from __future__ import annotations

import numpy as np

WORD = 8
#: Bytes that the first sort looks at; with the place they fit into one word.
FIRST = 5


def words_at(data: np.ndarray) -> np.ndarray:
    """For each byte the eight bytes from there on, as a big-endian number (padded with zeros)."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    n = len(data)
    two = padded[: n + 6] << np.uint64(8) | padded[1 : n + 7]
    four = two[: n + 4] << np.uint64(16) | two[2 : n + 6]
    return four[:n] << np.uint64(32) | four[4 : n + 4]


def sorted_pairs(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by (group, key); both are below 2**k. Number and pair go into one word where they fit,
    as numpy sorts plain words several times faster than it sorts an index."""
    n = len(group)
    bits = max(1, int(max(group.max(initial=0), key.max(initial=0), n)).bit_length())
    if 3 * bits > 64:
        return np.lexsort((key, group))
    shift = np.uint64(bits)
    packed = (group.astype(np.uint64) << shift | key.astype(np.uint64)) << shift | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def groups_of(new: np.ndarray) -> np.ndarray:
    """For each place of a sorted list the place at which its group of equals begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def first_ranks(data: np.ndarray) -> np.ndarray:
    """For each byte the place at which the group of its first FIRST bytes begins in sorted order."""
    key = (words_at(data) >> np.uint64(64 - 8 * FIRST)).astype(np.int64)
    n = len(data)
    bits = max(1, n.bit_length())
    if 8 * FIRST + bits > 64:
        order = np.argsort(key, kind="stable")
    else:
        packed = key.astype(np.uint64) << np.uint64(bits) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = groups_of(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return rank


def refine(rank: np.ndarray, active: np.ndarray, step: int) -> np.ndarray:
    """Doubles the sorted length: the groups of ``active`` are split by the rank ``step`` further on.

    Ranks are first places of groups, so a group of one is final and is never sorted again. Returns
    the positions whose group still has other members.
    """
    if not len(active):
        return active
    group, key = rank[active], rank[active + step]
    order = sorted_pairs(group, key)
    sorted_group, sorted_key = group[order], key[order]
    new_group = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])
    new = new_group | np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank[active[order]] = sorted_group + (groups_of(new) - groups_of(new_group))
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
    return active[order[np.repeat(size > 1, size)]]


def suffix_array(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions that may share their first ``depth`` bytes with another, in suffix order.

    ends: for each byte the end of its context. Every wanted position has ``depth`` bytes there.
    """
    if not len(wanted):
        return wanted
    room = ends - np.arange(len(data))
    rank = first_ranks(data)
    counts = np.bincount(rank, minlength=len(data))
    step = FIRST
    # a position takes part while it is not alone and its context has room for the longer prefix
    active = np.flatnonzero(counts[rank] > 1)
    while step * 2 <= depth:
        active = refine(rank, active[room[active] >= 2 * step], step)
        step *= 2
    is_wanted = np.zeros(len(data), bool)
    is_wanted[wanted] = True
    left = active[is_wanted[active]]
    if not len(left):
        return left
    # at last the wanted positions alone, by the rank that ends at the depth exactly
    return left[sorted_pairs(rank[left], rank[left + depth - step])]


def kasai(data: np.ndarray, ends: np.ndarray, suffixes: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``cap`` bytes.

    Kasai's walk in text order: the next position keeps all but one of the matched bytes, as long as
    both it and its neighbour moved on by one. All runs of consecutive positions walk side by side.
    """
    n = len(suffixes)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    words = words_at(data)
    before = np.concatenate([[-1], suffixes[:-1]])
    by_text = np.argsort(suffixes, kind="stable")
    position, neighbour = suffixes[by_text], before[by_text]
    goes_on = np.concatenate([[False], (np.diff(position) == 1) & (np.diff(neighbour) == 1) & (neighbour[:-1] >= 0)])
    start = np.flatnonzero(~goes_on)
    length = np.diff(np.concatenate([start, [n]]))
    start = start[np.argsort(-length, kind="stable")]
    length = np.sort(length)[::-1]
    matched = np.zeros(len(start), np.int64)
    for step in range(int(length[0])):
        lanes = int(np.searchsorted(-length, -step, side="left"))  # runs longer than step
        at = start[:lanes] + step
        i, j = position[at], neighbour[at]
        h = np.maximum(matched[:lanes] - 1, 0)
        limit = np.where(j >= 0, np.minimum(cap, np.minimum(ends[i] - i, ends[j] - j)), 0)
        h = np.minimum(h, limit)
        open_ = np.flatnonzero(h < limit)
        while len(open_):
            differ = words[i[open_] + h[open_]] ^ words[j[open_] + h[open_]]
            same = np.full(len(open_), WORD)
            for byte in range(WORD - 1, -1, -1):
                same[(differ >> np.uint64(8 * (WORD - 1 - byte))) & np.uint64(255) != 0] = byte
            h[open_] = np.minimum(h[open_] + same, limit[open_])
            open_ = open_[(same == WORD) & (h[open_] < limit[open_])]
        matched[:lanes] = h
        common[by_text[at]] = h
    return common
