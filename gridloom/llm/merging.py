"""BPE merges over length-bucketed padded numpy matrices."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Longest cut, in bytes, that goes through the matrices; a round per merge would take quadratic time beyond.
MATRIX_BYTES = 512
#: Cells of a matrix worked on at a time.
MATRIX_CELLS = 1 << 19
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing with linear probing, from (left id, right id) to the merge's rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slots, pending, self.probes = self._slots(keys), np.arange(len(keys)), 0
        while len(pending):
            at = (slots[pending] + self.probes) & self.mask
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slot], self.ranks[slot] = keys[pending[won]], rank[pending[won]]
            pending = np.delete(pending, won)
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair does not merge; negative ids never merge."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.int64) << 32) | right[todo]
        slot = self._slots(keys)
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (at >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
            if not len(todo):
                break
        return out.reshape(shape)


def merge_flat(raw: np.ndarray, first: np.ndarray, size: np.ndarray, start: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: PairTable, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the non-empty cuts raw[first : first + size], end to end, and how many each has.

    start(bytes matrix, sizes) gives the ids before any merge; merged the id that a
    merge of each rank makes.
    """
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # cuts, their counts of ids, their ids end to end
    bucket = np.maximum(1, np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64)
    for k in np.unique(bucket).tolist():
        width, members = 1 << k, np.flatnonzero(bucket == k)
        if width > MATRIX_BYTES:
            for m in members.tolist():
                cut = raw[first[m] : first[m] + size[m]].reshape(1, -1)
                ids = np.frombuffer(merge_one(start(cut, size[m : m + 1])[0], pairs, merged), "<u4")
                done.append((np.array([m]), np.array([len(ids)]), ids))
            continue
        step = max(1, MATRIX_CELLS // width)
        for at in range(0, len(members), step):
            part = members[at : at + step]
            n = size[part]
            inside = np.arange(width) < n[:, None]
            at_byte = first[part][:, None] + np.arange(width)
            ids = start(raw[np.where(inside, at_byte, first[part][:, None])], n)
            ids[~inside] = -1
            merge_rows(ids, n, part, pairs, merged, done)
    count = np.zeros(len(size), np.int64)
    for members, n, _ in done:
        count[members] = n
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint32)
    for members, n, ids in done:
        out[np.repeat(begin[members] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, count


def merge_rows(ids: np.ndarray, size: np.ndarray, rows: np.ndarray, pairs: PairTable, merged: np.ndarray, done: list) -> None:
    """Every round each row merges its leftmost pair of least rank and closes up; finished rows leave for done."""
    ranks = pairs.look_up(ids[:, :-1], ids[:, 1:])
    while True:
        if ranks.shape[1]:
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), place]
        else:
            place, best = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
        over = best == NONE
        if over.any():
            left = ids[over]
            done.append((rows[over], size[over], left[left >= 0]))
            keep = ~over
            rows, ids, ranks, size, place, best = rows[keep], ids[keep], ranks[keep], size[keep], place[keep], best[keep]
        if not len(rows):
            return
        size = size - 1
        width = int(size.max())
        ids[np.arange(len(rows)), place] = merged[best]
        source = np.arange(width)
        ids = np.take_along_axis(ids, source + (source > place[:, None]), axis=1)
        source = np.arange(max(width - 1, 0))
        ranks = np.take_along_axis(ranks, source + (source >= place[:, None]), axis=1)
        for beside in (place - 1, place):  # the pairs that hold the new id
            ok = np.flatnonzero((beside >= 0) & (beside < ranks.shape[1]))
            ranks[ok, beside[ok]] = pairs.look_up(ids[ok, beside[ok]], ids[ok, beside[ok] + 1])


def merge_one(start: np.ndarray, pairs: PairTable, merged: np.ndarray) -> bytes:
    """The same merges in the same order for one long cut, by a heap."""
    ids = start.tolist()
    first = pairs.look_up(start[:-1], start[1:]).tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    seen: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in seen:
            seen[a, b] = int(pairs.look_up(np.array([a]), np.array([b]))[0])
        return seen[a, b]

    while heap:
        r, k, a, b = heapq.heappop(heap)
        n = after[k]
        if ids[k] != a or n >= len(ids) or ids[n] != b:
            continue
        ids[k], ids[n] = int(merged[r]), -1
        after[k] = after[n]
        if after[k] < len(ids):
            before[after[k]] = k
            if (x := rank(ids[k], ids[after[k]])) != NONE:
                heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
        if (p := before[k]) >= 0 and (x := rank(ids[p], ids[k])) != NONE:
            heapq.heappush(heap, (x, p, ids[p], ids[k]))
    return np.array([x for x in ids if x >= 0], "<u4").tobytes()
