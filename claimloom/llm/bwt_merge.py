"""Merging shard Burrows-Wheeler transforms by iterative interleave refinement.

Strings are read in symbols of STEP bytes, one starting at every byte, so a suffix's transform symbol is
the STEP bytes before it and the last-to-first step goes STEP bytes back. Symbols are numbered by their
hashes, which is an order as good as any other for finding equal prefixes; 0 stands before every string's
first STEP suffixes, and each string has STEP empty suffixes behind its last byte.

Each shard sorts its own suffixes once and keeps its transform. A merge never looks at suffixes again: it holds an
interleave, the shard of each place of the merged order, and blocks of places with equal prefixes. Beginning
with the shards one after another in one block, each round reads the merged transform along the interleave and
deals its symbols, in that order, to the buckets of a counting pass; the shards so dealt are the interleave that is right
for one symbol more. A block ends where the symbol changes or the block of the round before does, so blocks only ever
split, and the round in which two neighbours part is the length of their common prefix. Only at the end do places become
suffixes again: the j-th place of a shard is its j-th suffix.

Cases: no string gives no place. Strings shorter than a symbol have symbols of their own length.
"""

from __future__ import annotations

import numpy as np
from pandas._libs.algos import groupsort_indexer  # a stable counting pass

U = np.uint64
#: Suffixes of one shard, but for a longer string; three numbers below 2**21 fit a 64-bit key.
SHARD = 1 << 17


def symbols(hashes: np.ndarray) -> np.ndarray:
    """Dense numbers of symbols, in the order of their hashes."""
    return np.unique(hashes, return_inverse=True)[1].astype(np.int64)


def bucketed(values: np.ndarray, most: int) -> np.ndarray:
    """The places of values, dealt in order to one bucket for each value up to most."""
    return groupsort_indexer(np.ascontiguousarray(values, np.intp), most + 1)[0]


def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (first, second), ties by place; and dense ranks."""
    n = len(first)
    key = np.sort((first.astype(np.uint64) << U(42)) | (second.astype(np.uint64) << U(21)) | np.arange(n, dtype=np.uint64))
    order = (key & U((1 << 21) - 1)).astype(np.int64)
    pair = key >> U(21)
    new = np.zeros(n, np.int64)
    new[1:] = pair[1:] != pair[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def shard_order(symbol: np.ndarray, end: np.ndarray, step: int, words: int) -> np.ndarray:
    """A shard's suffixes sorted by their first words symbols. end: where each position's string ends, empty suffixes included."""
    n = len(symbol)
    place = np.arange(n)

    def ahead(rank: np.ndarray, d: int) -> np.ndarray:
        at = place + d * step
        return np.where(at < end, rank[np.minimum(at, n - 1)] + 1, 0)

    order, rank = _ranked(symbols(symbol), np.zeros(n, np.int64))
    ranks, have = {1: rank}, 1
    while have < words:
        more = max(d for d in ranks if have + d <= words)
        order, rank = _ranked(ranks[have], ahead(ranks[more], have))
        have += more
        ranks[have] = rank
    return order


def transform(symbol: np.ndarray, start: np.ndarray, order: np.ndarray, step: int) -> np.ndarray:
    """The Burrows-Wheeler transform of a sorted shard: the symbol before each suffix, 0 at a string's beginning."""
    before = order - step
    return np.where(before >= start[order], symbol[np.maximum(before, 0)], 0)


def merged(transforms: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(the shard of each place of the merged order; the common prefix of each place with the one before it, in symbols, words at most)."""
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    n = len(shard)
    common = np.full(n, words, np.int16)
    if not n:
        return shard, common
    joined = np.concatenate(transforms)
    most = int(joined.max())
    block, blocks = np.zeros(n, np.int64), 1
    before = np.empty(n, np.int64)
    for h in range(words):
        before[bucketed(shard, len(transforms) - 1)] = joined  # each shard's transform, along the interleave
        dealt = bucketed(before, most)
        shard, symbol, own = shard[dealt], before[dealt], block[dealt]
        new = np.ones(n, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | ((own[1:] != own[:-1]) & (symbol[1:] > 0))
        block = np.cumsum(new) - 1
        common[new & (common == words)] = h
        if block[-1] + 1 == blocks:
            break
        blocks = int(block[-1]) + 1
    return shard, common


def repeated(sums_of, size: int, start: np.ndarray, end: np.ndarray, counted: np.ndarray, step: int, words: int) -> np.ndarray:
    """For each position, whether a counted suffix there shares its first step * words bytes with another counted one.

    sums_of(a, b): hashes of the spans from a to b; strings lie end to end and shards hold whole strings.
    """
    if not size:
        return np.zeros(0, bool)
    place = np.arange(size)
    number = np.cumsum(np.append(True, start[1:] != start[:-1])) - 1
    own = place + number * step  # with room for the empty suffixes of the strings before
    total = size + (int(number[-1]) + 1) * step
    symbol, of = np.zeros(total, np.int64), np.full(total, -1)
    symbol[own] = symbols(sums_of(place, np.minimum(place + step, end))) + 1
    of[own] = place
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    begins = first + np.arange(len(first)) * step
    lengths = np.diff(np.append(begins, total))
    starts, ends = np.repeat(begins, lengths), np.repeat(begins + lengths, lengths)
    cuts = [0]
    while cuts[-1] < total:
        to = min(total, cuts[-1] + SHARD)
        if to < total:
            to = int(starts[to]) if starts[to] > cuts[-1] else int(ends[cuts[-1]])
        cuts.append(to)
    orders, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        order = shard_order(symbol[a:b], ends[a:b] - a, step, words)
        transforms.append(transform(symbol[a:b], starts[a:b] - a, order, step))
        orders.append(order + a)
    shard, common = merged(transforms, words)
    suffix = np.empty(total, np.int64)
    suffix[bucketed(shard, len(orders) - 1)] = np.concatenate(orders)
    where = of[suffix]
    some = (where >= 0) & counted[where]
    interval = np.cumsum(common < words) - 1
    counts = np.bincount(interval[some], minlength=int(interval[-1]) + 1)
    out = np.zeros(size, bool)
    out[where[some]] = counts[interval[some]] > 1
    return out
