"""Burrows-Wheeler transforms of text collections, and their merge by iterative interleave refinement.

A collection is texts of bytes 1 to 255, each ended by 0; ends compare by the order of their texts. The merge keeps, for
each place of the merged order, only the shard it comes from. At first that is all of one shard, then all of the next:
right for suffixes compared by no symbol. Each round goes through the places in order and hands the shard on to the
bucket of the two symbols before its suffix there, which makes the order right for two symbols more. Along with the shard
goes the number of its interval, places whose suffixes agree so far; an interval that is still whole in the end is a
repeat. No suffixes are compared or sorted again.
"""

from __future__ import annotations

import numpy as np


def collection(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, end of each symbol's text). Byte 255, which UTF-8 lacks, makes room for the end symbol."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8) + np.uint8(1)
    ends = np.flatnonzero(data == 0)
    return data, np.repeat(ends, np.diff(ends, prepend=-1))


def suffix_array(data: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes by depth symbols at least; equal ones up to an end by their texts' order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    at = np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        inside = at + k <= end
        key = key << np.uint64(8) | np.where(inside, padded[k : n + k], 0).astype(np.uint64)
    have = 8
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank_ = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]), dtype=np.uint64)
        if have >= depth:
            # ties by place: numbers that are all different need no stable sort, which takes longer
            rank_ <<= np.uint64(32)
            rank_ |= order.astype(np.uint64)
            rank_.sort()
            return (rank_ & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = rank_
        later = np.where(at + have <= end, rank[np.minimum(at + have, n - 1)], np.uint64(0))
        key = rank * np.uint64(n + 1) + later
        have *= 2


def transform(data: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order the two symbols before it, as one number; before a text's start comes its end."""
    ends = np.flatnonzero(data == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.concatenate([data[:1], data[:-1]])
    before[starts] = 0  # before a text's first symbol comes its end
    two = np.concatenate([before[:1], before[:-1]])
    two[starts] = data[np.maximum(ends - 1, starts)]  # and before that its last; of an empty text its end again
    return (two.astype(np.uint16) << np.uint16(8) | before)[order]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, interval) of each place of the merged order: suffixes are in one interval if depth symbols agree.

    depth must be even; the shards' own orders must be right to that depth.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    interval = np.zeros(len(shard), dtype=np.int32)
    # kept for all rounds: fresh memory for each would take longer than what is done with it
    symbols, seen = np.empty(len(shard), dtype=np.uint16), np.empty(len(shard), dtype=np.uint16)
    other, before = np.empty_like(shard), np.empty_like(interval)
    new, differ = np.empty(len(shard), dtype=bool), np.empty(len(shard), dtype=bool)
    for _ in range(0, depth, 2):
        if len(transforms) == 1:
            symbols = transforms[0]
        else:
            for s, t in enumerate(transforms):
                symbols[np.flatnonzero(np.equal(shard, s, out=differ))] = t
        order = np.argsort(symbols, kind="stable")
        np.take(shard, order, out=other, mode="clip")
        shard, other = other, shard
        np.take(interval, order, out=before, mode="clip")
        np.take(symbols, order, out=seen, mode="clip")
        new[:1] = True
        np.not_equal(seen[1:], seen[:-1], out=new[1:])
        np.not_equal(before[1:], before[:-1], out=differ[1:])
        new[1:] |= differ[1:]
        # suffixes with an end in their first two symbols stand in the order of texts, each in an interval of its own
        ended = np.flatnonzero((seen & np.uint16(255)) == 0) if seen.size else seen
        first = int(np.searchsorted(seen, 256))
        shard[:first].sort()
        new[:first] = True
        ended = ended[ended >= first]
        if ended.size:
            new[ended] = True
            new[np.minimum(ended + 1, len(new) - 1)] = True
            shard[ended] = shard[ended][np.lexsort((shard[ended], seen[ended]))]
        np.cumsum(new, dtype=np.int32, out=interval)
    return shard, interval


def repeats(texts: list[bytes], depth: int, shard_bytes: int = 2**21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, interval) of all substrings of depth bytes, in sorted order; equal ones have the same interval."""
    shards: list[list[int]] = [[]]
    size = 0
    for k, t in enumerate(texts):
        if size > shard_bytes and len(shards) < 255:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(t) + 1
    orders, transforms, owners, starts = [], [], [], []
    for members in shards:
        data, end = collection([texts[k] for k in members])
        order = suffix_array(data, end, depth)
        orders.append(order)
        transforms.append(transform(data, end, order))
        ends = np.flatnonzero(data == 0)
        which = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))[order]
        owners.append(np.array(members, dtype=np.int64)[which])
        starts.append(np.where(end[order] - order >= depth, order - np.concatenate([[0], ends[:-1] + 1])[which], -1))
    shard, interval = merge(transforms, depth)
    text, start = np.empty(len(shard), dtype=np.int64), np.empty(len(shard), dtype=np.int64)
    for s in range(len(shards)):
        here = shard == s
        text[here], start[here] = owners[s], starts[s]
    whole = start >= 0
    return text[whole], start[whole], interval[whole]
